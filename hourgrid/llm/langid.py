"""Language identification by prediction by partial matching: code lengths under frozen context trees."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bytes_of, crc_of_id, spans, table

#: Bytes of context at most.
ORDER = 3
#: The sample: different whole texts of about so many bytes a language, chosen by a digest of the text.
SAMPLE_BYTES = 400_000
#: Tasks at most that count the sample.
TASKS = 4
#: Bytes of text that are scored at once; a longer text is scored in such blocks.
CHUNK = 1 << 20


def training_sample(rows: DataFrame, sample_bytes: int) -> DataFrame:
    """Different whole labelled texts (lang, text), of about sample_bytes bytes a language (all, where there are fewer).

    A text is taken if a digest of it is below its language's share, so that the choice needs no order; the text of
    the least digest is taken always, so that no language is left without one. Copies count once."""
    digest = F.xxhash64("text")
    place = F.pmod(F.col("digest"), F.lit(1_000_000))
    different = rows.groupBy("lang", digest.alias("digest"), F.octet_length("text").alias("size")).agg(F.lit(1))
    sizes = different.groupBy("lang").agg(F.sum("size").alias("held"), F.min(place).alias("least"))
    share = F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest(F.col("held"), F.lit(1)))
    rows = rows.withColumn("digest", digest).join(F.broadcast(sizes), "lang")
    return rows.where((place < share * 1_000_000) | (place == F.col("least"))).select("lang", "text").distinct()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of ORDER + 1 bytes over all texts of the task, the first ones of a text led in by blanks."""
    found: dict[str, dict[int, int]] = {}
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        for k, lang in enumerate(batch.column("lang").to_pylist()):
            counts = found.setdefault(lang, {})
            text = np.concatenate([np.full(ORDER, 32, np.uint8), folded(buffer[offsets[k] : offsets[k + 1]])]).astype(np.uint32)
            gram = sum(text[i : len(text) - ORDER + i] << np.uint32(8 * (ORDER - i)) for i in range(ORDER + 1))
            for g, n in zip(*(x.tolist() for x in np.unique(gram, return_counts=True))):
                counts[g] = counts.get(g, 0) + n
    for lang, counts in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"]
        )


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z, and white space as blanks."""
    return _FOLD[data]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


class Model:
    """Frozen statistics: one tree of byte contexts for each language.

    The order k node of a context gives a byte that followed it n / (all + distinct); what is escaped, distinct /
    (all + distinct), is dealt by the node of order k - 1 among the bytes not seen here (exclusion), and under order 0
    evenly among 256. A context that was never seen leaves all to the next shorter one, without a cost."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        self.trees = [self._tree(g, n) for g, n in zip(grams, counts)]

    @staticmethod
    def _tree(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For k = 0 to ORDER: strings of k + 1 bytes and the bits of their last byte, contexts and the bits to leave them."""
        tree = []
        before, p = np.zeros(1, np.int64), np.full(1, 1 / 256)  # under order 0
        for k in range(ORDER + 1):
            strings, place = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(place, counts, len(strings))
            contexts, node = np.unique(strings >> 8, return_inverse=True)
            total, distinct = np.bincount(node, n), np.bincount(node)
            shorter = p[np.searchsorted(before, strings & ((1 << 8 * k) - 1))]
            escapes = np.where(distinct < 256, distinct, 0)
            rest = np.where(distinct < 256, 1 - np.bincount(node, shorter), 1)
            before, p = strings, n / (total + escapes)[node]
            leave = np.where(distinct < 256, escapes, 1) / (total + escapes) / rest
            tree.append((strings, -np.log2(p), contexts, -np.log2(leave)))
        return tree

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """[string of ORDER + 1 bytes, language] -> bits of its last byte after the others."""
        return np.stack([self._bits(tree, grams) for tree in self.trees], axis=1)

    @staticmethod
    def _bits(tree: list[tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            strings, bits, contexts, leaving = tree[k]
            string = grams[left] & ((1 << 8 * (k + 1)) - 1)
            at, known = _found(strings, string)
            out[left[known]] += bits[at[known]]
            left, context = left[~known], string[~known] >> 8
            at, known = _found(contexts, context)
            out[left[known]] += leaving[at[known]]
        out[left] += 8
        return out


def _found(known: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sought value is in the sorted known ones, and whether it is there."""
    at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    return at, known[at] == sought


def fit(rows: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from (lang, text). The counts are gathered by Spark; their number is bounded by the sample.

    The sample is small, so TASKS tasks count it however many partitions its shuffle has: in each more, the same grams
    would be counted again as rows of their own."""
    sample = training_sample(rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"), sample_bytes)
    counted = sample.coalesce(TASKS).mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    mine = [counted[counted["lang"] == k].sort_values("gram") for k in langs]
    return Model(langs, [m["gram"].to_numpy(np.int64) for m in mine], [m["n"].to_numpy(np.int64) for m in mine])


def text_bits(model: Model, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[text, language] -> code length of the whole text, in bits."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    for i, j in spans(offsets, CHUNK):
        for a in range(offsets[i], offsets[j], CHUNK):
            b = min(a + CHUNK, offsets[j])
            data = folded(buffer[max(0, a - ORDER) : b])
            data = np.concatenate([np.full(ORDER - min(a, ORDER), 32, np.uint8), data])
            gram = np.zeros(b - a, np.uint32)
            starts = np.maximum(offsets[i:j], a) - a
            for k in range(ORDER + 1):
                part = data[k : k + b - a]
                if k < ORDER:  # before a text's first bytes stand blanks, not the end of another text
                    part = part.copy()
                    own = offsets[i:j] - a
                    for back in range(ORDER - k):
                        at = own + back
                        part[at[(at >= 0) & (at < b - a) & (back < np.diff(offsets[i : j + 1]))]] = 32
                gram = gram << np.uint32(8) | part
            different, place = np.unique(gram, return_inverse=True)
            cost = model.code_lengths(different.astype(np.int64)).take(place, axis=0)
            full = starts < np.minimum(offsets[i + 1 : j + 1], b) - a
            if full.any():
                out[i:j][full] += np.add.reduceat(cost, starts[full], axis=0)
    return out


def _predicted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        bits = text_bits(model, buffer, offsets)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        letters = batch.column("letters").to_numpy(zero_copy_only=False)
        lang = pa.array([model.langs[k] if ok else "und" for k, ok in zip(best, letters)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), lang, pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"]
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, and for every row the language whose tree codes the whole text shortest, with that
    language's share of the likelihoods as score.

    `und` with score 0 for null texts and texts without a letter, and for all texts if nothing was learned.
    Ties go to the first language by name. Rows are kept as they are; no shuffle."""
    held = (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint"), held, F.coalesce("text", F.lit("")).alias("text"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda batches: _predicted(batches, shared), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict() for documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(crc_of_id(F.col("doc_id")) % 4 != 2)))
