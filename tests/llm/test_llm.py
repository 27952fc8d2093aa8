"""Operators on documents and embeddings against plain Python, with nulls, empty texts, repeats and odd columns."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zipfile
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from hourgrid.llm import bpe, common, langid, licenses, media, minhash, mixing, sharding, suffixes, toxicity, vectors
from hourgrid.llm.common import bytes_of
from hourgrid.llm.graph import components

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, budget int, runs int, score double"
SYLLABLES = ["the", "ra", "lo", "in", "ter", "mi", "sen", "qua", "é", "ou", "zu"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, texts):
    """Rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 7 else None, len(t or ""), 1, 2, 0.9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FIELDS)


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    words = base.split()
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (3, 50, 90)]
    passage = prose(2, 60)
    out = [base, base, *near, None, "", " \n", "a", "A", "one two", prose(3, 40) + " " + passage + " " + prose(4, 40), passage + prose(5, 30), "é" * 130 + "\n" + "é" * 130, "\0" * 210, "!!! 123", prose(6, 4000)]
    return out + [prose(k, 20 + k) for k in range(10, 40)] + [prose(12, 32)] * 3


def of(df):
    return df.toPandas().sort_values(df.columns[0]).reset_index(drop=True)


def test_language_id(spark):
    rows = [(i, " ".join([["the cat sat on", "le chat est sur"][i % 2]] * 8) + f" {i}", ["en", "fr"][i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !", "fr"), (102, "the cat", None), (102, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = of(langid.predict(docs, langid.fit(docs)))
    assert len(got) == len(rows)
    assert got.lang_pred[:60].tolist() == [r[2] for r in rows[:60]]
    assert got.lang_pred[60:].tolist() == ["und", "und", "en", "en"]
    assert got.held_out.tolist() == [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    empty = docs.limit(0)
    assert set(of(langid.predict(docs, langid.fit(empty))).lang_pred) == {"und"}
    assert langid.predict(empty, langid.fit(docs)).count() == 0


def plain_ppm(texts, k, context):
    """Probabilities of all 256 bytes after a context, by the definition: tables of what followed, escapes, exclusion."""
    followed = collections.Counter()
    for text in texts:
        data = b" " * langid.ORDER + text
        for i in range(langid.ORDER, len(data)):
            if data[i - k : i] == context[len(context) - k :]:
                followed[data[i]] += 1
    lower = plain_ppm(texts, k - 1, context) if k else [1 / 256] * 256
    if not followed:
        return lower
    total, distinct = sum(followed.values()), len(followed) if len(followed) < 256 else 0
    rest = math.fsum(q for c, q in enumerate(lower) if c not in followed)
    return [followed[c] / (total + distinct) if c in followed else distinct / (total + distinct) * q / rest for c, q in enumerate(lower)]


def test_code_lengths_equal_a_plain_coder(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 16)  # texts of several blocks, and several texts a block
    learned = {"a": ["abracadabra \u00e9", "abba", "abba", bytes(range(128)).decode() * 2], "b": ["barbara bar", "\u00df zaz"]}
    docs = spark.createDataFrame([(lang, t) for lang, texts in learned.items() for t in texts], "lang string, text string")
    model = langid.fit(docs)
    texts = ["abrac zeb\u00df", "", "x", "barbara \u00e9\u4e2d abracadabra bar", "ab", "\0\x7f\n"]
    got = langid.text_bits(model, *bytes_of(pa.array(texts)))
    fold = lambda t: bytes(langid.folded(np.frombuffer(t.encode(), np.uint8)))
    for j, lang in enumerate(model.langs):
        known = [fold(t) for t in sorted(set(learned[lang]))]  # copies count once
        for i, text in enumerate(texts):
            data = b" " * langid.ORDER + fold(text)
            shares = [plain_ppm(known, langid.ORDER, data[k - langid.ORDER : k]) for k in range(langid.ORDER, len(data))]
            assert all(abs(math.fsum(p) - 1) < 1e-12 for p in shares)
            assert got[i, j] == pytest.approx(-sum(math.log2(p[c]) for p, c in zip(shares, data[langid.ORDER :])), abs=1e-9)


def test_every_byte_seen_leaves_no_escape():
    grams = np.array([int.from_bytes(b"abc" + bytes([c]), "big") for c in range(256)], np.int64)
    model = langid.Model(["x"], [grams], [np.ones(256, np.int64)])
    assert np.allclose(model.code_lengths(grams)[:, 0], 8)


def test_a_language_of_long_texts_has_a_sample(spark):
    docs = spark.createDataFrame([("en", f"{i} " + "the cat " * 400) for i in range(5)] + [("fr", "le chat")], "lang string, text string")
    sample = langid.training_sample(docs, 10).groupBy("lang").count().toPandas()
    assert sorted(sample.lang) == ["en", "fr"]
    copies = langid.training_sample(docs.union(docs), 10**6)
    assert copies.count() == 6


def test_partitions_add_no_counts(spark, monkeypatch):
    """Counts of a sample in many partitions are those of one, in TASKS times as many rows at most."""
    monkeypatch.setattr(langid, "training_sample", lambda rows, _: rows)
    made, counts = [], langid._grams

    def counted(batches):
        for batch in counts(batches):
            yield batch
            seen.add(batch.num_rows)

    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(langid, "_grams", counted)
    docs = spark.createDataFrame([("en", prose(k, 60)) for k in range(300)], "lang string, text string")
    for partitions in (1, 100):
        before = seen.value
        model = langid.fit(docs.repartition(partitions))
        made.append((model.trees[0][langid.ORDER], seen.value - before))
    (one, rows_of_one), (many, rows_of_many) = made
    assert all(np.array_equal(a, b) for a, b in zip(one, many))
    assert rows_of_one == len(one[0]) and rows_of_many <= langid.TASKS * rows_of_one


def test_media_round_trip(spark, texts, tmp_path):
    docs = frame(spark, texts)
    path = f"file://{tmp_path}/archives"
    media.write_archives(docs, path)
    got = of(media.media_features(media.read_archives(spark, path)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        assert got.n_bytes[i] == len(data) and got.payload_bytes[i] == len(payload)
        assert got.payload_sha256[i] == hashlib.sha256(payload).hexdigest() and got.tail_crc32[i] == zlib.crc32(payload[-64:])
    assert got.media_sha256[0] == got.media_sha256[1]
    empty = f"file://{tmp_path}/empty"
    media.write_archives(docs.limit(0), empty)
    assert media.read_archives(spark, empty).count() == 0


def test_archives_written_twice(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    for text in ("one", "two", "two"):
        media.write_archives(frame(spark, [text]), path)
    digest = lambda t: hashlib.sha256(media.to_picture(t.encode())).hexdigest()
    held = lambda: sorted(hashlib.sha256(r.payload).hexdigest() for r in media.read_archives(spark, path).collect())
    assert held() == sorted(map(digest, ("one", "two", "two")))
    rows = spark.createDataFrame([("7", media.to_picture(b"three"))], "name string, payload binary")
    rows.write.format("archives").mode("overwrite").save(path)
    assert held() == [digest("three")]
    with pytest.raises(Exception, match="absent"):
        media.read_archives(spark, f"file://{tmp_path}/absent").count()


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_a_member_that_fails_once_is_read_at_its_offset(tmp_path, kind):
    """Members of one name: the one at the offset is read, not the last of that name."""
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", kind) as out:
        for k in range(3):
            out.writestr(zipfile.ZipInfo("same"), bytes([k]) * 500, kind)

    class Failing:
        def read(self, member):
            raise OSError("once")

    with zipfile.ZipFile(path) as archive:
        got = [media.ArchiveReader._member(media.fs.LocalFileSystem(), path, Failing(), m) for m in archive.infolist()]
    assert got == [bytes([k]) * 500 for k in range(3)]


def test_a_broken_member_fails_after_retries(tmp_path, spark):
    path = f"file://{tmp_path}/archives"
    media.write_archives(frame(spark, ["x" * 1000]), path)
    (file,) = tmp_path.glob("archives/*.zip")
    data = bytearray(file.read_bytes())
    data[60] ^= 255
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="member at 0"):
        media.read_archives(spark, path).collect()


def test_bpe_equals_tiktoken(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    odd = ["".join(r.choice("abstmdrvel'''  \n\t é1٢９!?$中\U0001f600S") for _ in range(r.randint(0, 30))) for _ in range(300)]
    every = [*texts, *odd, "$" * 3000 + "a" * 500 + " " * 200, "it's we're 'llama they'll'd"]
    got = of(bpe.encode(frame(spark, every)))
    for i, t in enumerate(every):
        want = library.encode_ordinary(t or "")
        assert list(got.ids[i]) == want and got.n_tokens[i] == len(want)
        assert got.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest()
        assert got.ids_sha256[i] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def _leaves(texts, rows, shards):
    """Shards by plain Python: (text) -> shard. rows: (doc_id, text, lang, source)."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    crc = lambda x: zlib.crc32((x or "").encode())
    units = {}
    for i, t, lang, source in rows:
        data = (t or "").encode()
        known = -(2**63) if i is None else i
        dims = (crc(source), crc(lang), known >> 2, len(data) + 1)
        unit = units.setdefault(data, [0, dims, (zlib.crc32(data), signed(xxhash.xxh64(data, seed=42).intdigest()))])
        unit[0] += len(data) + 1
        unit[1] = tuple(map(min, unit[1], dims))
    span = lambda us, d: max(u[1][d] for u in us) - min(u[1][d] for u in us)
    out = {}

    def split(part, first, leaves):
        if leaves == 1 or not part:
            out.update(dict.fromkeys(part, first))
            return
        us = [units[k] for k in part]
        d = max(range(4), key=lambda d: (span(us, d) / whole[d], -d))
        order = sorted(part, key=lambda k: (units[k][1][d], units[k][2]))
        sums = np.cumsum([units[k][0] for k in order])
        left, both = sum(room[first : first + leaves // 2]), sum(room[first : first + leaves])
        left, both = (min(left, both - 1), both) if both else (leaves // 2, leaves)
        share = sums[-1] * left / both
        cut = int(np.searchsorted(sums, share, "right"))
        if sums[cut] - share < share - (sums[cut - 1] if cut else 0):
            cut += 1
        split(order[:cut], first, leaves // 2), split(order[cut:], first + leaves // 2, leaves - leaves // 2)

    total = sum(u[0] for u in units.values())
    large = sorted((k for k, u in units.items() if u[0] * sharding.LARGE * shards > total >= u[0] * shards), key=lambda k: (-units[k][0], units[k][2]))
    held = [0] * shards
    for k in large:
        out[k] = held.index(min(held))
        held[out[k]] += units[k][0]
    room = [max(0, total // shards - h) for h in held]
    whole = [max(1, span([u for k, u in units.items() if k not in out], d)) for d in range(4)] if len(large) < len(units) else None
    split([k for k in units if k not in out], 0, shards)
    return [out[(t or "").encode()] for t in texts]


@pytest.mark.parametrize("few, target", [(16_384, None), (8, None), (16_384, 900)])
def test_shards_equal_brute_force(spark, few, target, monkeypatch):
    monkeypatch.setattr(sharding, "FEW", few)
    texts = [prose(k % 150, 3 + k % 17) if k % 31 else None for k in range(400)]
    rows = [(i if i % 50 else None, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, shard int")
    got = sharding.kd_shards(docs, shards=8, target_bytes=target).toPandas()
    sizes = [len((t or "").encode()) + 1 for t in texts]
    shards = -(-sum(sizes) // target) if target else 8
    want = _leaves(texts, rows, shards)
    key = lambda i, t: (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32, got.shard)) == sorted((*key(i, t), w) for (i, t, _, _), w in zip(rows, want))
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("share", [0.14, 0.25, 0.6, 0.99])
def test_groups_that_fit_a_shard_stay_whole(spark, share):
    """Two equal texts of a quarter of a shard and more, also when there are several such pairs."""
    small = [prose(k, 40) for k in range(700)]
    shard = sum(map(len, small)) / (8 - 6 * share)
    texts = small + [t for k in range(6) for t in [prose(1000 + k, int(shard)).encode()[: int(share * shard / 2)].decode(errors="ignore")] * 2]
    got = sharding.kd_shards(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string"), shards=8).toPandas()
    assert got.groupby("text_crc32").shard.nunique().max() == 1 and len(got) == len(texts)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.05 * sums.min()


def test_a_heavy_group_is_dealt_in_pieces(spark):
    """A third of the rows is one text, and a third of those even one row; bytes stay near equal, other groups whole."""
    texts = [prose(1, 30)] * 300 + [prose(2 + k // 2, 30) for k in range(600)]
    rows = [(max(0, i - 100), t, "en", "s") for i, t in enumerate(texts)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and len(sums) == 8 and sums.max() < 1.1 * sums.min()
    groups = got.groupby("text_crc32").shard.nunique()
    assert groups.drop(zlib.crc32(texts[0].encode())).max() == 1 and groups.max() > 2
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert sharding.kd_shards(empty).count() == 0


def _sets(texts):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(fold))
        out.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    got = of(minhash.near_duplicates(frame(spark, texts)))
    sets = _sets(texts)
    component = list(range(len(texts)))
    for _ in range(5):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == component
    assert got.kept.tolist() == [i == c for i, c in enumerate(component)]
    assert minhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_unlike_members_of_a_bucket_meet(spark):
    """Many texts that share most of what is in a band, two of which are alike."""
    rows = [" ".join([*prose(50, 30).split(), *prose(100 + k, 12).split()]) for k in range(40)]
    rows.append(rows[17] + " end")
    got = of(minhash.near_duplicates(frame(spark, rows)))
    assert got.component_id[40] == got.component_id[17]


def test_a_link_behind_many_near_misses_is_found(spark):
    """Beside each asking text a family: 400 members at 176/222 (no link), one at 177/221 (a link)."""
    r = random.Random(3)
    rows = []
    for f in range(3):
        q = [f"q{f}x{k}" for k in range(200)]
        rows.append(q)
        for m in range(401):
            lost, at = 6 if m == 200 else 7, r.choice([*range(1, 85), *range(125, 190)])
            words = q[:108] + [f"b{f}x{k}" for k in range(14)] + q[122:]
            rows.append(words[:at] + [f"l{f}x{m}x{k}" for k in range(lost)] + words[at + lost :])
    texts = [" ".join(w) for w in rows]
    sets = _sets(texts)
    for f in range(3):
        linked = [100 * len(sets[402 * f] & s) >= 80 * len(sets[402 * f] | s) for s in sets[402 * f + 1 : 402 * f + 402]]
        assert linked == [m == 200 for m in range(401)]
    got = of(minhash.near_duplicates(frame(spark, texts)))
    assert got.component_id.tolist() == [i // 402 * 402 for i in range(len(texts))]


@pytest.mark.parametrize("block", [1024, 8])
def test_blocks_join_all_components(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "_stars", lambda shared, percent: shared.sparkSession.createDataFrame([], "a bigint, b bigint"))
    base = prose(60, 90).split()
    rows = [" ".join(base[: 90 - k % 30] + [f"y{k}"]) for k in range(40)]
    sets = _sets(rows)
    component = list(range(len(rows)))
    for _ in range(5):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    assert of(minhash.near_duplicates(frame(spark, rows))).component_id.tolist() == component


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_repeats_equal_brute_force(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SAMPLE", 64 if hot == 1000 else 1)
    got = of(suffixes.remove_repeats(frame(spark, texts)))
    seen = set()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            gone[s : s + 100] |= w in seen
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got.n_bytes[i], got.n_removed[i], got.n_spans[i], got.kept_sha256[i]) == (len(data), gone.sum(), spans, hashlib.sha256(kept).hexdigest()), i


def test_texts_that_share_an_id_are_different_documents(spark):
    passage, long = prose(300, 40), prose(301, 60)
    rows = [(None, long + " " + passage + " " + long), (None, "short " + prose(302, 30)), (5, prose(303, 50) + passage), (5, "brief"), (6, prose(304, 20) + long), (6, prose(304, 20) + long)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, n_chars bigint")
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, want = set(), {}
    for i, t in order:
        data = t.encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 99):
            gone[s : s + 100] |= data[s : s + 100] in seen
            seen.add(data[s : s + 100])
        lead = [len(t[:k].encode()) for k in range(len(t) + 1)]
        want[i, t] = int(gone.sum()), "".join(c for k, c in enumerate(t) if not gone[lead[k] : lead[k + 1]].all())
    cut = suffixes.remove_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in cut) == sorted((i or 0, len(t.encode()), want[i, t][0]) for i, t in rows)
    left = suffixes.stage_repeats(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted((i or 0, want[i, t][1]) for i, t in rows)


def test_windows_are_sought_in_order_of_bytes():
    """As Spark sorts them: bytes are unsigned, and bytes 0 at the end count."""
    rows = sorted(bytes(r) + b"\0" * k for k, r in [(0, [255] * 100), (0, [1] * 100), (1, [255] * 99), (2, [255] * 98), (100, []), (0, [128] * 100)])
    rows = [r for r in rows for _ in range(2)]
    at = list(range(len(rows)))
    batches = [pa.RecordBatch.from_arrays([pa.array(at[a:b]), pa.array([0] * (b - a)), pa.array(rows[a:b], pa.binary()), pa.array([k % 2 for k in at[a:b]])], ["id", "start", "window", "shard"]) for a, b in ((0, 3), (3, 12))]
    assert sorted(x for b in suffixes._merged(iter(batches)) for x in b.column("id").to_pylist()) == at[1::2]


def test_suffix_array_and_common_prefixes():
    words = [b"banana banana banana", b"anan", b"", b"a" * 60]
    buffer = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    left = np.concatenate([np.arange(len(w), 0, -1) for w in words])
    order = suffixes.suffix_array(buffer, left)
    strings = [bytes(buffer[i : i + left[i]]) for i in order]
    assert strings == sorted(strings)
    starts = (ends - [len(w) for w in words])[[0, 1, 3]]
    common = suffixes.common_prefixes(buffer, left, order, starts)
    for k in range(1, len(order)):
        a, b = strings[k - 1], strings[k]
        assert common[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


def test_shortened_texts_stay_valid(spark, texts):
    docs = frame(spark, texts)
    got = suffixes.stage_repeats(spark, docs, "")
    assert got.columns == docs.columns and got.count() == len(texts)
    rows = of(got)
    assert rows.text[1] == "" and rows.text[0] == texts[0] and (rows.n_chars == rows.text.str.len()).all()


def test_toxic_words_are_found(spark):
    r = random.Random(4)
    bad = ["gremlok", "vashtun", "plorgit"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(1000 + i, 40).split(), i % 4 == 0
        if toxic:
            for w in r.sample(bad, 2):
                words.insert(r.randint(0, 40), w + r.choice(["", "s", "ing"]))
        rows.append((i, " ".join(words), 0.9))
        labels.append((i, None, int(toxic)))
    rows += [(1000, None, 0.9), (1001, "", 0.9), (1002, prose(9, 9000), 0.9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    truth = spark.createDataFrame([*labels, (None, None, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    field = toxicity.fit(docs, truth.where(~toxicity.held_out(F.col("doc_id"))))
    got = of(docs.select("doc_id", toxicity.scored(F.col("text"), field).alias("found")).select("doc_id", "found.*"))
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)]
    right = [(got.score[i] >= 0.5) == bool(labels[i][2]) for i in range(400) if held[i]]
    assert np.mean(right) > 0.97 and (got.score[400:] < 0.5).all()
    row = next(i for i in range(400) if labels[i][2] and got.score[i] >= 0.5)
    data = rows[row][1].encode()
    assert any(data[a:b].decode().startswith(tuple(bad)) for a, b in zip(got.span_starts[row], got.span_ends[row]))
    nothing = toxicity.fit(docs, truth.limit(0))
    assert {r.found.score for r in docs.select(toxicity.scored(F.col("text"), nothing).alias("found")).collect()} == {0.0}


@pytest.mark.parametrize("chain", [2048, 2, 1])
def test_marginals_equal_enumeration(chain, monkeypatch):
    monkeypatch.setattr(toxicity, "CHAIN", chain)
    r = np.random.default_rng(2)
    scores, transitions, texts = r.normal(size=7), r.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 1, 2])
    p, pairs = toxicity.marginals(scores, texts, transitions)
    total = np.zeros((2, 2))
    for t in range(3):
        at = np.flatnonzero(texts == t)
        weight, ones = 0.0, np.zeros(len(at))
        joint = np.zeros((2, 2))
        for k in range(2 ** len(at)):
            y = [(k >> i) & 1 for i in range(len(at))]
            w = np.exp(sum(s * v for s, v in zip(scores[at], y)) + sum(transitions[a, b] for a, b in zip(y, y[1:])))
            weight, ones = weight + w, ones + w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        np.testing.assert_allclose(p[at], ones / weight, atol=1e-9)
        total += joint / weight
    np.testing.assert_allclose(pairs, total, atol=1e-9)


def test_blocks_of_a_chain_pass_messages(monkeypatch):
    r = np.random.default_rng(3)
    texts = np.repeat([0, 1, 3], [7000, 5, 2048])
    scores, transitions = r.normal(size=len(texts)), r.normal(size=(2, 2)) * 3
    in_blocks = toxicity.marginals(scores, texts, transitions)
    monkeypatch.setattr(toxicity, "CHAIN", 10_000)
    for a, b in zip(in_blocks, toxicity.marginals(scores, texts, transitions)):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_marks_need_different_neighbours():
    """A passage that is copied in toxic texts marks nothing; a word in many contexts does, in a rare language, too."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = prose(5000 + i, 30).split()
        if i % 3 == 0:
            words[r.randrange(29)] = "vashtun" if i > 60 else "gremlok"
        if i in range(0, 60, 3):
            words += ["zzcopied", "zzpassage", "zzalike"]
        rows.append(" ".join(words))
        labels.append(float(i % 3 == 0))
    buffer, offsets = bytes_of(pa.array(rows, pa.large_string()))
    starts, ends, text = toxicity.words_of(buffer, offsets)
    _, one, word = np.unique(toxicity.word_keys(buffer, starts, ends), return_index=True, return_inverse=True)
    marked = toxicity._marks(toxicity.feature_values(buffer, starts[one], ends[one]), word, text, np.array(labels))
    assert {bytes(buffer[a:b]).decode() for a, b in zip(starts[one][marked], ends[one][marked])} == {"vashtun", "gremlok"}


def test_budgets_pass_shortages_to_siblings(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 50), ("b", "x", "4", 10_000)]
    rows = spark.createDataFrame(leaves, "domain string, lang_key string, source_key string, tokens bigint")
    weights = {"domain": {"a": 1, "b": 1}, "lang_key": {}, "source_key": {}}
    got = {r.source_key: r.budget for r in mixing.leaf_budgets(rows, weights, 1, 0.18).collect()}
    # 2007 tokens: 1003 each; under a, y has 50 only, so x gets 953; there 1 has 100 only
    assert got == {"1": 100, "2": 853, "3": 50, "4": 1003}


def test_mix_takes_prefixes_of_whole_rows(spark, texts):
    docs = frame(spark, texts)
    got = mixing.mix(docs, fraction=0.5, max_epochs=2)
    rows = got.select("row.doc_id", "row.budget", "n_tokens", "epoch", "domain", "lang_key", "source_key", F.col("budget").alias("own")).toPandas()
    per_leaf = rows.groupby(["domain", "lang_key", "source_key"]).agg(used=("n_tokens", "sum"), own=("own", "first"))
    assert (per_leaf.used <= per_leaf.own).all() and (rows.budget == 1).all()
    again = mixing.mix(docs, fraction=0.5, max_epochs=2).select("row.doc_id", "epoch").toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, rows[["doc_id", "epoch"]].to_numpy()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.stage_mix(spark, docs, "").columns == docs.columns


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 16))
    near = x[:60] + r.normal(size=(60, 16)) * 0.15
    values = [*x.tolist(), *near.tolist(), x[0].tolist(), (2 * x[1]).tolist(), [0.0] * 16, None, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [], [1.0, 2.0], (x[2] * 1e200).tolist()]
    rows = spark.createDataFrame(list(enumerate(values)), "vec_id bigint, embedding array<double>")
    got = of(vectors.near_vectors(rows))
    ok = [i for i, v in enumerate(values) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = vectors.unit_of(np.array([values[i] for i in ok], float))
    linked = unit @ unit.T >= 0.9
    links = dict.fromkeys(range(len(values)), 0) | dict(zip(ok, (linked.sum(axis=1) - 1).tolist()))
    assert got.n_links.tolist() == [links[i] for i in range(len(values))]
    component = list(range(len(values)))
    for _ in range(6):
        for a, i in enumerate(ok):
            component[i] = min(component[ok[b]] for b in np.flatnonzero(linked[a]))
    assert got.component_id.tolist() == component
    assert vectors.near_vectors(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 64])
def test_blocks_of_a_filter_find_all_links(spark, block, monkeypatch):
    """One family of 700 vectors, a third of which are copies, in filters of many blocks."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(4)
    x = vectors.unit_of(r.normal(size=(1, 16)) + r.normal(size=(500, 16)) * 0.3)
    x = np.concatenate([x, x[:200], r.normal(size=(100, 16))])
    got = of(vectors.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")))
    unit = vectors.unit_of(x)
    linked = unit @ unit.T >= 0.9
    label = vectors._labels(linked)
    assert linked.sum() > 100_000 and got.n_links.tolist() == (linked.sum(axis=1) - 1).tolist()
    assert got.component_id.tolist() == label.tolist()


@pytest.mark.parametrize("hot", [1024, 4])
def test_components_of_stars_and_chains(spark, hot, monkeypatch):
    """A star whose centre is the greatest node, one whose centre is the least, a long chain, loops and null ends."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    edges = [(9999, k) for k in range(100, 400)] + [(1, k) for k in range(500, 800)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3), (3, None)] + [(1, 500)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: 100 for k in [*range(100, 400), 9999]} | {k: 1 for k in [1, *range(500, 800)]} | {k: 1000 for k in range(1000, 1101)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(k % 7 if k % 2 else None if k % 10 == 0 else 8, k) for k in range(60)], "k int, v int")
    facts = rows.groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("weight")).where("k <> 3")
    got = sorted(map(tuple, common.spread_join(rows, facts, "k", 60).collect()))
    assert got == sorted(map(tuple, rows.join(facts.drop("weight"), "k").collect())) and len({k for k, _, _ in got}) == 7


def test_filters_find_links_at_the_threshold():
    r = np.random.default_rng(9)
    for words in (4, 20):
        x = vectors.unit_of(r.normal(size=(1000, 64)))
        y = r.normal(size=(1000, 64))
        y = vectors.unit_of(y - (y * x).sum(1, keepdims=True) * x)
        a, b = vectors.decode(x, words), vectors.decode(0.9 * x + np.sqrt(1 - 0.81) * y, words)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.995


@pytest.mark.parametrize("dims, words", [(64, 4), (64, 20), (64, 100), (64, 200), (8, 100), (3, 50)])
def test_codes_grow_with_the_number_of_vectors(dims, words):
    r = np.random.default_rng(10)
    x = vectors.unit_of(r.normal(size=(1500, dims)))
    y = r.normal(size=(1500, dims))
    y = vectors.unit_of(y - (y * x).sum(1, keepdims=True) * x)
    a, b = vectors.decode(x, words), vectors.decode(0.9 * x + np.sqrt(1 - 0.81) * y, words)
    recall = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)])
    print(dims, words, "codes", len(vectors.code(dims, words, 0.9)[0]), "lists", np.mean([len(p) for p in a]), "recall", recall)
    assert recall >= 0.999


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_licenses(spark, few, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_DIGESTS", few)
    text = lambda k: next(t for t in licenses.LICENSES[k] if len(t) > 500)
    mit = text("MIT").replace("<year> <copyright holders>", "2020 Jane Doe")
    rows = [mit, mit.upper().replace("\n\n", "\n"), "Text.\nreleased under the MIT Licence\nMore.", "Licensed under CC BY-NC 4.0.", "", None, "licensed", "Licensed under CC BY-NC 4.0. And more"]
    whole = [k for k, v in licenses.LICENSES.items() if max(map(len, v)) > 500]
    rows += ["Copyright 1999 Somebody\n" + " ".join(text(k).split("\n")).replace("license", "Licence") if "opyright" not in k else "" for k in whole]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id bigint, text string, digest string, notices string")
    got = of(licenses.scan_licenses(docs))
    assert got.whole_license.fillna("").tolist()[:8] == ["MIT", "MIT", "", "CC-BY-NC-4.0", "", "", "", ""]
    assert got.notices.tolist()[2:4] == ["MIT", "CC-BY-NC-4.0"] and not got.licensed[7]
    assert got.digest.isna().tolist()[:8] == [False, False, False, False, True, True, False, False]
    wrapped = [k for k in whole if not re.search(r"(?m)^\s*(copyright|\(c\))", text(k).lower())]  # others lose lines in another place when rewrapped
    assert len(whole) >= 14 and len(wrapped) >= 3
    assert [got.whole_license[8 + whole.index(k)] for k in wrapped] == wrapped
    again = spark.createDataFrame([(i, text(k).swapcase()) for i, k in enumerate(whole)] + [(99, None), (99, None)], "doc_id bigint, text string")
    got = of(licenses.scan_licenses(again))
    assert got.whole_license.fillna("").tolist() == [*whole, "", ""]
    assert licenses.scan_licenses(again.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = prose(77, 60)
    rows = [(None, text), (3, text), (3, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near = minhash.near_duplicates(docs).toPandas()
    assert len(near) == 4 and near[near.doc_id == 3].kept.all()
    cut = suffixes.remove_repeats(docs).toPandas()
    assert len(cut) == 4 and cut[cut.doc_id.isna()].n_removed.tolist() == [0] and (cut[cut.doc_id == 3].n_removed == len(text.encode())).all()
    full = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert sharding.kd_shards(full).count() == 4 and mixing.mix(full, fraction=1.0, max_epochs=1).count() == 3
    assert isinstance(of(bpe.encode(docs)), pd.DataFrame)


def test_windows_of_several_suffix_arrays_are_merged():
    """Arrays of distinct windows, cut into batches anywhere: all but the first of equal windows are repeats."""
    r = random.Random(9)
    rows = []
    for shard in range(7):
        for k in r.sample(range(60), 40):
            rows.append((bytes([k]) * suffixes.LENGTH, r.randint(0, 5), 1000 * k + shard, shard << 32))
    rows.sort(key=lambda x: x[:3])
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    for size in (1, 3, 17, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size]), kinds)], ["window", "id", "start", "shard"]) for at in range(0, len(rows), size)]
        got = [(i, s + k) for b in suffixes._merged(iter(batches)) for i, s, n in zip(*(c.to_pylist() for c in b.columns)) for k in range(n)]
        want = [(b[1], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
        assert sorted(got) == sorted(want) and len(want) > 100


def test_scoring_holds_one_feature_at_a_time():
    """Memory of scoring, in 8-byte numbers a word: all features' digests at once would take more than 25."""
    texts = pa.array(["some words that are short " * 40] * 1000)
    words = 200_000
    field = toxicity.Field(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), np.zeros((2, 2)), np.zeros(3))
    tracemalloc.start()
    try:
        assert sum(map(len, toxicity._scored(iter([texts]), field))) == 1000
        assert tracemalloc.get_traced_memory()[1] < 20 * 8 * words
    finally:
        tracemalloc.stop()
