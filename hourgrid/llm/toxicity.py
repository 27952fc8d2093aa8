"""Toxicity by a linear-chain conditional random field over words."""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bytes_of, crc_of_id, mixed, spans, table

#: Labelled documents that the field is fitted on, at most: by label; and the bytes of the longest one that is taken.
SAMPLE, SAMPLE_TEXT = {1: 1000, 0: 2000}, 16_384
#: Buckets of hashed features; lengths of the prefixes that are features, in bytes.
BUCKET_BITS, PREFIXES = 20, (3, 4, 5, 6, 7, 8)
#: A feature marks toxic words if it is in so many toxic documents, stands out by so many standard deviations and
#: by this share of what the strongest one does, and at most this share of the documents that have it are clean.
#: Rounds of it on the toxic documents without a marked word, at most.
SEED_DOCS, SEED_DEVIATIONS, SEED_STRENGTH, SEED_CLEAN, SEED_ROUNDS = 5, 5.0, 0.25, 0.02, 8
#: Words of a block of a chain; messages pass between the blocks of a longer one.
CHAIN = 2048
#: Steps, step size and penalty of the fit.
STEPS, RATE, PENALTY = 20, 0.5, 1e-4
#: Bytes of text whose words are held at once; a longer text is held alone.
CHUNK = 4 << 20

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_of(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends, and texts of all words: runs of letters and non-ASCII bytes within a text."""
    inside = _WORD[buffer]
    first = np.zeros(len(buffer) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate([[False], inside])
    starts = np.flatnonzero(inside & (~before[:-1] | first[:-1]))
    after = np.append(inside[1:], False)
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _head_and_tail(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 8 folded bytes of each word, as numbers."""
    low = np.concatenate([_FOLD[buffer], np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(low, (len(low) - 7, 8), (1, 1))
    keep = _KEEP[np.minimum(ends - starts, 8)]
    return windows[starts].view("<u8")[:, 0] & keep, windows[np.maximum(ends - 8, starts)].view("<u8")[:, 0] & keep


def _key(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(head) ^ (tail * np.uint64(31)) ^ size.astype(np.uint64)


def word_keys(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each word that words with the same features share."""
    return _key(*_head_and_tail(buffer, starts, ends), ends - starts)


def each_feature(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Feature by feature the words' 64-bit digests: prefixes of the folded word, and the word itself. Only one feature's are held."""
    head, tail = _head_and_tail(buffer, starts, ends)
    for i, k in enumerate(PREFIXES):
        yield mixed((head & _KEEP[k]) * np.uint64(8) + np.uint64(i))
    yield mixed(_key(head, tail, ends - starts))


def feature_values(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[feature, word] -> its digest."""
    return np.stack(list(each_feature(buffer, starts, ends)))


def buckets_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class Field:
    """Weights of the features for label 1 against 0, transitions [from, to], and the document's score by the
    logarithm of the expected number of toxic words and the log-odds of the most toxic one."""

    weights: np.ndarray
    transitions: np.ndarray
    document: np.ndarray
    constant: float | None = None


def _blocks(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at most CHAIN words of one text: first words, lengths, and whether a text begins or ends with it."""
    place = np.arange(len(texts))
    change = np.flatnonzero(np.diff(texts, prepend=-1))
    of_text = np.repeat(change, np.diff(np.append(change, len(texts))))
    begins = np.flatnonzero((place - of_text) % CHAIN == 0)
    head = of_text[begins] == begins
    return begins, np.diff(np.append(begins, len(texts))), head, np.append(head[1:], True)


def _passed(scores: np.ndarray, step: np.ndarray, begins: np.ndarray, length: np.ndarray, head: np.ndarray) -> np.ndarray:
    """[block, label before it, label at its end] -> relative weight of all labels in between. Where a text begins
    with the block, the label before is that of the first word itself."""
    out = np.repeat(np.eye(2)[None], len(begins), axis=0)
    order = np.argsort(-length, kind="stable")
    for t in range(int(length.max(initial=0))):
        on = order[: np.searchsorted(-length[order], -t, "left")]
        moved = out[on] @ (step if t else np.where(head[on, None, None], np.eye(2), step))
        moved[:, :, 1] *= np.exp(np.clip(scores[begins[on] + t], -30, 30))[:, None]
        out[on] = moved / moved.sum(axis=(1, 2), keepdims=True)
    return out


def _messages(scores: np.ndarray, step: np.ndarray, blocks: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For every block the share of label 1 in the forward message that enters it (not used where a text begins)
    and in the backward message that reaches its last word (0.5 where a text ends)."""
    begins, length, head, tail = blocks
    enter, leave = np.full(len(begins), 0.5), np.full(len(begins), 0.5)
    parts = np.flatnonzero(~(head & tail))  # blocks of texts that have several
    weight = dict(zip(parts.tolist(), _passed(scores, step, begins[parts], length[parts], head[parts])))
    message = np.ones(2)
    for k in parts.tolist():
        if head[k]:
            message = np.ones(2)
        enter[k] = message[1] / message.sum()
        message = message @ weight[k]
        message = message / message.sum()
    for k in parts[::-1].tolist():
        if tail[k]:
            message = np.ones(2)
        leave[k] = message[1] / message.sum()
        message = weight[k] @ message
        message = message / message.sum()
    return enter, leave


def marginals(scores: np.ndarray, texts: np.ndarray, transitions: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """By the forward-backward algorithm: each word's probability of label 1, and the sum over words of the
    probabilities of (label before, label), zeros if they are not wanted; words of different texts are not neighbours."""
    out, pairs = np.zeros(len(scores)), np.zeros((2, 2))
    if not len(scores):
        return out, pairs
    step = np.exp(transitions)
    blocks = _blocks(texts)
    enter, leave = _messages(scores, step, blocks)
    order = np.argsort(-blocks[1], kind="stable")
    for group in np.array_split(order, max(1, len(order) // 256)):
        begins, length, head = (x[group] for x in blocks[:3])
        tall, wide = int(length.max()), len(begins)
        at = begins[None, :] + np.minimum(np.arange(tall)[:, None], length - 1)
        real = np.arange(tall)[:, None] < length
        e = np.exp(np.clip(scores[at], -30, 30))
        e[~real] = 1
        a1 = np.empty((tall + 1, wide))  # share of label 1 given the words up to here, from the one before the block on
        a1[0] = enter[group]
        for t in range(tall):
            one = (step[0, 1] + a1[t] * (step[1, 1] - step[0, 1])) * e[t]
            zero = step[0, 0] + a1[t] * (step[1, 0] - step[0, 0])
            if t == 0:
                one, zero = np.where(head, e[0], one), np.where(head, 1.0, zero)
            a1[t + 1] = one / (one + zero)
        b1 = np.empty((tall, wide))  # share of label 1 in the backward messages
        b1[-1] = leave[group]
        for t in range(tall - 2, -1, -1):
            x1, x0 = b1[t + 1] * e[t + 1], 1 - b1[t + 1]
            one, zero = step[1, 1] * x1 + step[1, 0] * x0, step[0, 1] * x1 + step[0, 0] * x0
            b1[t] = np.where(real[t + 1], one / (one + zero), b1[-1])
        one, zero = a1[1:] * b1, (1 - a1[1:]) * (1 - b1)
        p = one / (one + zero)
        out[at[real]] = p[real]
        if not with_pairs:
            continue
        both = real.copy()
        both[0] &= ~head
        x1, x0, before = b1 * e, 1 - b1, a1[:-1]
        joint = [(1 - before) * step[0, 0] * x0, (1 - before) * step[0, 1] * x1, before * step[1, 0] * x0, before * step[1, 1] * x1]
        total = sum(joint)
        pairs += np.array([(j / total)[both].sum() for j in joint]).reshape(2, 2)
    return out, pairs


def emissions(weights: np.ndarray, features: Iterable[np.ndarray], words: int) -> np.ndarray:
    """Each word's score for label 1, feature by feature, so that no table of all weights is made."""
    total = np.full(words, -2.0)
    for bucket in features:
        total += weights[bucket]
    return total


def _evidence(p: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """[text] -> 1, log of the expected number of toxic words, log-odds of the most toxic word."""
    most = np.zeros(n)
    np.maximum.at(most, texts, p)
    most = np.clip(most, 1e-5, 1 - 1e-5)
    return np.stack([np.ones(n), np.log(np.bincount(texts, p, n) + 1e-3), np.log(most / (1 - most))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _marks(values: np.ndarray, word: np.ndarray, text: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which words (types) are toxic: those with a feature that stands out in the toxic texts, with different words
    after it (else it may be one passage that is copied). What stands out is looked for again among the toxic texts
    without such a word, so that a frequent language does not hide a rare one, until nothing more is found."""
    names, features = np.unique(values, return_inverse=True)
    features, buckets, kinds = features.reshape(values.shape), len(names), values.shape[1]
    after = np.append(np.where(np.diff(text) == 0, word[1:], kinds), kinds)
    followed = _distinct((word * np.int64(kinds + 1) + after)[labels[text] == 1])
    pairs = _distinct(text * np.int64(kinds) + word)
    of_pair, word_of_pair = pairs // kinds, pairs % kinds
    varied = []
    for bucket in features:
        seen = _distinct(bucket[followed // (kinds + 1)] * np.int64(kinds + 1) + followed % (kinds + 1))
        varied.append(np.bincount(seen // (kinds + 1), minlength=buckets))
    varied = np.maximum.reduce(varied) >= SEED_DOCS
    marked, left = np.zeros(kinds, bool), np.ones(len(labels), bool)
    for _ in range(SEED_ROUNDS):
        toxic, every = np.zeros(buckets), np.zeros(buckets)
        use = left[of_pair]
        for bucket in features:
            of_text = _distinct(of_pair[use] * np.int64(buckets) + bucket[word_of_pair[use]])
            toxic += np.bincount(of_text % buckets, labels[of_text // buckets], buckets)
            every += np.bincount(of_text % buckets, minlength=buckets)
        expected = every * labels[left].mean()
        strength = (toxic - expected) / np.sqrt(np.maximum(expected, 1e-9))
        able = varied & (toxic >= SEED_DOCS) & (every - toxic <= SEED_CLEAN * every)
        stand_out = able & (strength >= max(SEED_DEVIATIONS, SEED_STRENGTH * strength[able].max(initial=0)))
        if not stand_out.any():
            break
        for bucket in features:
            marked |= stand_out[bucket]
        left = (labels == 0) | (np.bincount(of_pair, marked[word_of_pair], len(labels)) == 0)
    return marked


def fit_texts(texts: list[str] | pa.ChunkedArray, labels: np.ndarray) -> Field:
    """Fits the field on labelled texts.

    Words of toxic texts that carry a marking feature (SEED_*) are the toxic words, all words of clean texts are
    clean; toxic texts without a marked word are left out. The weights follow from the gradient of the chains'
    likelihood (observed less expected counts), the document's score from a logistic fit on the marginals."""
    n = len(texts)
    if not n or labels.min() == labels.max():
        return Field(np.zeros(0), np.zeros((2, 2)), np.zeros(3), float(labels.mean()) if n else 0.0)
    buffer, offsets = bytes_of(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string()))
    starts, ends, text = words_of(buffer, offsets)
    _, one_of, word = np.unique(word_keys(buffer, starts, ends), return_index=True, return_inverse=True)
    values = feature_values(buffer, starts[one_of], ends[one_of])  # of each different word
    buckets, kinds = 1 << BUCKET_BITS, len(one_of)
    y = (_marks(values, word, text, labels)[word] & (labels[text] == 1)).astype(float)
    features = buckets_of(values)
    usable = (labels == 0) | (np.bincount(text, y, n) > 0)
    use = usable[text]
    w, y, t = word[use], y[use], text[use]
    inner = np.diff(t, prepend=-1) == 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    weights, transitions = np.zeros(buckets), np.zeros((2, 2))
    squares, square_t = np.full(buckets, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        p, pairs = marginals(emissions(weights, features, kinds)[w], t, transitions)
        of_word = np.bincount(w, y - p, kinds)
        gradient = sum(np.bincount(k, of_word, buckets) for k in features) - PENALTY * len(y) * np.sign(weights) * 0.01 - PENALTY * weights
        squares += gradient**2
        weights += RATE * gradient / np.sqrt(squares)
        step = seen - pairs
        square_t += step**2
        transitions += RATE * step / np.sqrt(square_t)
    p, _ = marginals(emissions(weights, features, kinds)[word], text, transitions, with_pairs=False)
    return Field(weights.astype(np.float32), transitions, _logistic(_evidence(p, text, n), labels.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Field:
    """Fits on at most sample[label] labelled documents of each label, those whose ids have the least digests, and of
    these on the texts of at most SAMPLE_TEXT bytes, so the sample is bounded in rows and bytes. An id with
    two labels counts as toxic, one with several texts has the least of them."""
    chosen = None
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    for label, most in sample.items():
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where(F.octet_length("text") <= SAMPLE_TEXT).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return fit_texts(rows["text"], rows["toxic"].to_numpy().astype(float))


_SCORED = "struct<score double, span_starts array<bigint>, span_ends array<bigint>>"


def _scored(texts: Iterator[pa.Array], field: Field) -> Iterator[pa.Array]:
    for column in texts:
        buffer, offsets = bytes_of(column)
        for i, j in spans(offsets, CHUNK):
            data, at = buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if field.constant is None:
                starts, ends, text = words_of(data, at)
                emitted = emissions(field.weights, map(buckets_of, each_feature(data, starts, ends)), len(starts))
                p, _ = marginals(emitted, text, field.transitions, with_pairs=False)
                score = 1 / (1 + np.exp(-np.clip(_evidence(p, text, j - i) @ field.document, -30, 30)))
                bad = np.flatnonzero(p >= 0.5)
            else:
                starts = ends = text = bad = np.zeros(0, np.int64)
                score = np.full(j - i, field.constant)
            bounds = pa.array(np.searchsorted(text[bad], np.arange(j - i + 1)).astype(np.int32))
            from_, to = (pa.ListArray.from_arrays(bounds, pa.array((x[bad] - at[text[bad]]).astype(np.int64))) for x in (starts, ends))
            yield pa.StructArray.from_arrays([pa.array(score), from_, to], ["score", "span_starts", "span_ends"])


def scored(text: Column, field: Field) -> Column:
    """For every text a struct of score (0 to 1) and the byte offsets of words that are toxic with probability 0.5 or
    more (span_starts, span_ends).

    Whole texts are scored, in any order, without a shuffle; only texts go to Python. Null texts count as empty and
    get the score of no evidence, as every text without a word does. Where one label or none was to learn from, all
    get the share of label 1 (0 without labels)."""
    shared = SparkSession.active().sparkContext.broadcast(tuple(vars(field).values()))

    @F.arrow_udf(_SCORED)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _scored(texts, Field(*shared.value))

    return score(F.coalesce(text, F.lit("")))


def held_out(doc_id):
    return crc_of_id(doc_id) % 5 == 0


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Field:
    """The field learned from labels of documents that are not held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a field learned from four fifths of the labels; null and empty texts too."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", scored(F.col("text"), fitted(spark, sf_dir, docs)).alias("found"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.size("found.span_starts").alias("n_spans")
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is 0.5 or more go; all others stay as they are."""
    return docs.where(scored(F.col("text"), fitted(spark, sf_dir, docs)).score < 0.5)
