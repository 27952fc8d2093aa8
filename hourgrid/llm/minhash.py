"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bytes_of, mixed, spans, spread_join, staged, table
from hourgrid.llm.graph import components

#: Bins of the one permutation, and bins in a band. Two sets of similarity s share a band with probability
#: 1 - (1 - s^ROWS)^(BINS / ROWS): 0.999997 at 0.8, 0.03 at 0.3.
BINS, ROWS = 252, 6
#: Up to so many ids of candidates (40 bytes each, 160 MB) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Members of a bucket that are compared at once, and shingles that they may have together.
BLOCK, ELEMENTS = 1024, 1 << 20
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP, _PAIR, _LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_POWERS = np.cumprod(np.full(64, _STEP, np.uint64))


def word_hashes(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (folded A-Z), and the number of words before each text (and in all)."""
    solid = ~_SPACE[buffer]
    first = np.zeros(len(buffer) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(solid & (~np.concatenate([[False], solid])[:-1] | first[:-1]))
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lead = starts if starts[0] == 0 else np.concatenate([[0], starts])
    place = np.arange(len(buffer)) - np.repeat(lead, np.diff(np.append(lead, len(buffer))))
    power = _POWERS[place & 63]
    far = place > 63
    power[far] = mixed(place[far].astype(np.uint64) + _LENGTH)
    value = np.where(solid, _BYTE[buffer] * power, np.uint64(0))
    return mixed(np.add.reduceat(value, starts)), bounds


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its word shingles; of all its words, if they are fewer."""
    words, bounds = word_hashes(buffer, offsets)
    rolled = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        rolled = mixed(rolled * _PAIR + words[k : k + len(rolled)])
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= size:
            found = np.sort(rolled[a : b - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mixed(whole * _PAIR + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _probes() -> np.ndarray:
    """[attempt, bin] -> where an empty bin looks next, the same for all sets."""
    at = np.arange(BINS, dtype=np.uint64)[None, :] + np.arange(1, 8 * BINS + 1, dtype=np.uint64)[:, None] * np.uint64(BINS)
    return (mixed(at) % np.uint64(BINS)).astype(np.int64)


_PROBES = _probes()


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[set, bin] -> least hash of the bin (the bin is the hash's first bits). flat: the ascending hashes of all
    sets, one set after the other; at: where each begins. An empty bin takes that of the first filled one on its
    own random sequence of bins (optimal densification), so every bin agrees with probability s. The empty bins of
    all sets probe together, and those that have found a filled one drop out."""
    size = np.diff(np.append(at, len(flat)))
    cell = np.repeat(np.arange(len(at)) * BINS, size) + ((flat >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.concatenate([[True], cell[1:] != cell[:-1]])  # hashes ascend, so the first in a bin is its least
    out, has = np.zeros(len(at) * BINS, np.uint64), np.zeros(len(at) * BINS, bool)
    out[cell[least]], has[cell[least]] = flat[least], True
    empty = np.flatnonzero(~has)
    bins = empty % BINS
    for probe in _PROBES:
        if not len(empty):
            break
        source = empty - bins + probe[bins]
        hit = has[source]
        out[empty[hit]] = out[source[hit]]
        empty, bins = empty[~hit], bins[~hit]
    out[empty] = out[cell[at[empty // BINS]]]
    return out.reshape(-1, BINS)


def band_hashes(grid: np.ndarray) -> np.ndarray:
    """A hash of every band of each signature."""
    grid = grid.reshape(len(grid), BINS // ROWS, ROWS)
    bands = mixed(np.tile(np.arange(BINS // ROWS, dtype=np.uint64), (len(grid), 1)))
    for r in range(ROWS):
        bands = mixed(bands * _PAIR + grid[:, :, r])
    return bands


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        for i, j in spans(offsets, CHUNK):
            sets = shingle_sets(buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            counts = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(counts)
            digest = np.zeros((len(sets), 2), np.uint64)
            bands = np.zeros((0, BINS // ROWS), np.uint64)
            if len(full):
                flat, at = np.concatenate([sets[k] for k in full]), np.concatenate([[0], np.cumsum(counts[full])])[:-1]
                digest[full, 0], digest[full, 1] = np.add.reduceat(mixed(flat + _PAIR), at), np.add.reduceat(mixed(flat * _LENGTH), at)
                bands = band_hashes(signatures(flat, at))
            lists = np.zeros(len(sets) + 1, np.int32)
            lists[1:] = np.cumsum(np.where(counts > 0, BINS // ROWS, 0))
            columns = [batch.column("doc_id").slice(i, j - i), pa.array(counts), *(pa.array(digest[:, k].view(np.int64)) for k in (0, 1))]
            columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(bands.ravel().view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest1", "digest2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, shingles, bands) of each text that has a word."""
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        for i, j in spans(offsets, CHUNK):
            sets = shingle_sets(buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            full = np.flatnonzero([len(s) for s in sets])
            sets = [sets[k] for k in full]
            if not sets:
                continue
            starts = np.cumsum([0, *map(len, sets[:-1])])
            bands = band_hashes(signatures(np.concatenate(sets), starts))
            columns = [batch.column("doc_id").take(pa.array(full + i)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([b.tobytes() for b in bands], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "shingles", "bands"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of ids whose full sets are similar enough."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    with_both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return with_both.mapInArrow(lambda b: _confirmed(b, percent), "a bigint, b bigint")


def _stars(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's centre, if their sizes allow a link.

    The centre is the first by one of four orders, so that one text that is unlike its copies is not the centre of
    all their buckets. Centres are pre-aggregated and those of large buckets broadcast, so no task gets a large bucket."""
    order = F.xxhash64("id", F.pmod("bucket", F.lit(4)))
    centres = shared.groupBy("bucket").agg(F.min(F.struct(order, "id", "n")).alias("centre"), F.count("*").alias("weight"))
    pairs = spread_join(shared, centres, "bucket", shared.count()).where("id <> centre.id").where(100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
    return pairs.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()


def _open_rows(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component: bucket, id, component, asks (it is not in the bucket's
    largest component), and in how many blocks the bucket's members and its asking members are cut."""
    found = components(links)
    known = lambda rows: rows.join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component_id", "id")).drop("node", "component_id")
    counts = known(shared).groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    facts = counts.groupBy("bucket").agg(F.max(F.struct("m", "component", "s")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")
    cut = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / ELEMENTS)).cast("int")
    facts = facts.select("bucket", F.col("m").alias("weight"), F.col("main.component").alias("main"), cut(F.col("m"), F.col("s")).alias("blocks"), cut(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("ask_blocks"))
    return known(spread_join(shared, facts, "bucket", shared.count())).withColumn("asking", F.expr("component <> main")).drop("main", "n")


def _joining(group: pa.Table, percent: int) -> pa.Table:
    """Links, on full sets, of a group's asking rows with its members of other components: every pair that is not yet
    joined is looked at, and one link is given for each component that a row joins. A pair that shares several
    buckets is looked at in the first one, and from one side if both ask."""
    asks, asking, ids, component = (group.column(c).to_numpy() for c in ("asks", "asking", "id", "component"))
    component = component.copy()
    bands = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.int64).reshape(-1, BINS // ROWS)
    here = (bands == group.column("bucket")[0].as_py()).any(axis=0)
    before = bands[:, : here.argmax()]
    data, at = bytes_of(group.column("shingles"))
    begin, size = at[:-1] // 8, np.diff(at) // 8
    flat = np.unique(np.frombuffer(data.tobytes(), np.uint64), return_inverse=True)[1]
    mark = np.zeros(len(flat), np.uint8)
    members = np.flatnonzero(~asks)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in np.flatnonzero(asks):
        able = members[(component[members] != component[x]) & (100 * np.minimum(size[members], size[x]) >= percent * np.maximum(size[members], size[x]))]
        able = able[~asking[able] | (ids[able] < ids[x])]
        able = able[~(before[able] == before[x]).any(axis=1)]
        if not len(able):
            continue
        mine = flat[begin[x] : begin[x] + size[x]]
        mark[mine] = 1
        starts = np.cumsum(size[able]) - size[able]
        place = np.arange(size[able].sum()) + np.repeat(begin[able] - starts, size[able])
        both = np.add.reduceat(mark[flat[place]], starts, dtype=np.int64)
        mark[mine] = 0
        linked = able[100 * both >= percent * (size[x] + size[able] - both)]
        if len(linked):
            joined, first = np.unique(component[linked], return_index=True)
            near = ids[linked[first]]
            a.append(np.minimum(near, ids[x])), b.append(np.maximum(near, ids[x]))
            component[np.isin(component, joined)] = component[x]
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _between(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all components whose members share a bucket and are similar enough.

    A bucket is cut into blocks, and blocks of asking rows meet blocks of members, so no group exceeds two blocks.
    What leaves a group is at most a row for each component that it joins, not the pairs."""
    own = lambda blocks: f"CAST(pmod(xxhash64(id), {blocks}) AS INT)"
    as_member = f"transform(sequence(0, ask_blocks - 1), j -> struct({own('blocks')} AS i, j AS j, false AS asks))"
    as_asking = f"transform(sequence(0, blocks - 1), i -> struct(i AS i, {own('ask_blocks')} AS j, true AS asks))"
    dealt = F.expr(f"concat({as_member}, IF(asking, {as_asking}, array()))").alias("dealt")
    rows = open_rows.join(sets, "id").select("bucket", "id", "component", "asking", "shingles", "bands", F.explode(dealt).alias("d"))
    rows = rows.select("bucket", "d.i", "d.j", "d.asks", "asking", "id", "component", "shingles", "bands")
    return rows.groupBy("bucket", "i", "j").applyInArrow(lambda g: _joining(g, percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Texts with equal sets are one node, the least id among them. Nodes that share a band meet in a bucket, where
    each is a candidate for the bucket's centre (a star, not all pairs); candidates are confirmed on full sets.
    In buckets whose members are then of several components, those outside the largest one are compared on full
    sets with all members of other components, in blocks: every two nodes that share a band and are similar enough
    end up in one component.

    Null texts and texts without a word have an empty set and are linked with nothing. Rows with a null id get a
    null component and kept false; repeated rows of one id and text each give a row. An empty table gives an
    empty result. Extra columns are not looked at. Different texts of one id count as one document, whose links are
    confirmed on the greatest of them; n_shingles is each row's own."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = staged(texts.mapInArrow(lambda b: _signed(b, size), "doc_id bigint, n_shingles bigint, digest1 bigint, digest2 bigint, bands array<bigint>"))
    same = ["digest1", "digest2", "n_shingles"]
    nodes = staged(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("node")))
    node_bands = signed.join(nodes.select("node"), F.col("doc_id") == F.col("node"), "left_semi")
    members = node_bands.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    several = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = staged(members.join(several.select("bucket"), "bucket", "left_semi").distinct())
    ids = staged(shared.select("id").distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["id"], "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    sets = staged(wanted.mapInArrow(lambda b: _sets(b, size), "id bigint, shingles binary, bands binary"))
    stars = staged(_confirm(_stars(shared, percent), sets, percent))
    links = stars.unionByName(staged(_between(_open_rows(shared, stars), sets, percent)))
    found = nodes.join(components(links), "node", "left").select(*same, F.coalesce("component_id", "node").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return signed.select("doc_id", *same).join(found, same, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies of all documents by 2-word shingles; null and empty texts are linked with nothing."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five words, 0.8) the document of least id stays.

    Documents without an id are kept."""
    gone = near_duplicates(docs, size=5, percent=80).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
