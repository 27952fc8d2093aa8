"""Embedding near-dedup by spherical-cap filters of random product codes."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bytes_of, staged, table
from hourgrid.llm.graph import components

#: Parts of a product code; least number of independent codes; filters a vector exceeds in each, on average.
PARTS, CODES, LIST = 2, 8, 4
#: Share of links at exactly the least cosine that is to be found; codes are added until it is. Pairs that measure it.
RECALL, PAIRS = 0.9999, 500
#: Vectors for which one filter is meant, so that the code grows with the number of vectors.
PER_FILTER = 512
#: Vectors of one block: a filter with more of them is split into pairs of blocks.
BLOCK = 1024
SEED = 20


def fitting(dims: int, words: int) -> int:
    """Words of a part: in few dimensions more of them would only leave gaps between the filters."""
    return min(words, 2 ** (dims // 2))


@lru_cache(4)
def code(dims: int, words: int, least: float) -> tuple[list[np.ndarray], list[list[np.ndarray]], float]:
    """Rotations, codebooks of every part, and the threshold at which a random unit vector exceeds LIST filters
    of a code on average. A filter is one word of each part, scaled to unit length.

    Filters get narrower with words, so a code shows fewer of the links: how many it shows is measured on random
    pairs at cosine `least`, and codes are added until the product of what they miss is within RECALL."""
    words = fitting(dims, words)
    random = np.random.default_rng([SEED, dims, words])
    parts = np.array_split(np.arange(dims), min(PARTS, dims))
    probe = unit_of(random.normal(size=(2000, dims)))
    near, off = probe[:PAIRS], random.normal(size=(PAIRS, dims))
    off -= (off * near).sum(axis=1, keepdims=True) * near
    near = np.concatenate([near, least * near + np.sqrt(max(0.0, 1 - least**2)) * unit_of(off)]) if dims > 1 else np.concatenate([near, near])
    rotations, books, threshold, missed = [], [], 0.0, 1.0
    while len(books) < CODES or missed > 1 - RECALL:
        rotations.append(np.linalg.qr(random.normal(size=(dims, dims)))[0])
        book = [random.normal(size=(words, len(p))) for p in parts]
        books.append([b / np.linalg.norm(b, axis=1, keepdims=True) / np.sqrt(len(parts)) for b in book])
        if len(books) == 1:
            sums = _halves(probe @ rotations[0], books[0])
            filters = sums[0].shape[1] * sums[1].shape[1]
            pool = np.concatenate([(a[:, None] + b[None, :]).ravel() for a, b in zip(sums[0][:300], sums[1][:300])])
            threshold = float(np.quantile(pool, 1 - min(1.0, LIST / filters)))
        if len(books) > 64 and missed == 1:
            raise ValueError(f"no filter shows links at a cosine of {least}")
        row, filters = _exceeded(near @ rotations[-1], books[-1], threshold)
        shown = filters * PAIRS + row % PAIRS
        missed *= 1 - len(np.unique(np.intersect1d(shown[row < PAIRS], shown[row >= PAIRS]) % PAIRS)) / PAIRS
    return rotations, books, threshold


def _halves(x: np.ndarray, book: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inner products with all combinations of the first half of the parts, and of the second."""
    at, sums = 0, []
    for words in book:
        sums.append(x[:, at : at + words.shape[1]] @ words.T)
        at += words.shape[1]
    middle = (len(sums) + 1) // 2
    out = []
    for half in (sums[:middle], sums[middle:]):
        total = np.zeros((len(x), 1))
        for s in half:
            total = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
        out.append(total)
    return out[0], out[1]


def _exceeded(turned: np.ndarray, book: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for the filters of one code that rotated unit vectors exceed.

    Sums of the first half that do not reach the threshold with the row's greatest of the second half are left out;
    each of the others has at least one filter and is held against the second half."""
    first, second = _halves(turned, book)
    row, i = np.nonzero(-second.max(axis=1, keepdims=True) <= first - threshold)
    near, j = np.nonzero(-second[row] <= (first[row, i] - threshold)[:, None])
    return row[near], i[near] * second.shape[1] + j


def decode(unit: np.ndarray, words: int, least: float = 0.9) -> list[np.ndarray]:
    """For each unit vector the numbers of all filters it exceeds, ascending."""
    dims = unit.shape[1]
    rotations, books, threshold = code(dims, words, least)
    size = fitting(dims, words) ** min(PARTS, dims)
    found = [_exceeded(unit @ turn, book, threshold) for turn, book in zip(rotations, books)]
    row = np.concatenate([r for r, _ in found])
    filters = np.concatenate([k * size + f for k, (_, f) in enumerate(found)])
    order = np.lexsort((filters, row))
    return np.split(filters[order], np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])


def unit_of(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, also where squares would overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(batches: Iterator[pa.RecordBatch], words: int, least: float, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            sizes = np.array(rows.column("dims"))
            vectors = [np.array(v.values, float) for v in rows.column("embedding")]
            kept: list[tuple] = []
            for dims in np.unique(sizes):
                mine = np.flatnonzero(sizes == dims)
                unit = unit_of(np.stack([vectors[i] for i in mine]))
                kept += [(i, vectors[i].astype(kind).tobytes(), f.tolist()) for i, f in zip(mine, decode(unit, words, least))]
            pick = pa.array([k[0] for k in kept])
            yield pa.RecordBatch.from_arrays(
                [rows.column("rep").take(pick), rows.column("copies").take(pick), rows.column("dims").take(pick),
                 pa.array([k[1] for k in kept], pa.binary()), pa.array([k[2] for k in kept], pa.list_(pa.int32()))],
                ["rep", "copies", "dims", "vector", "filters"],
            )


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _both(rows: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """[n, name] -> whether the row has the name, without names of a single row."""
    found, place, count = np.unique(names, return_inverse=True, return_counts=True)
    kept = count > 1
    at = np.cumsum(kept) - 1
    mine = kept[place]
    has = np.zeros((n, int(kept.sum())), np.float32)
    has[rows[mine], at[place[mine]]] = 1
    return has


def _block(group: pa.Table, cross: bool, least: float, kind: str) -> pa.RecordBatch | None:
    """Of the vectors of one filter (or of two blocks of it): each linked one's links that no smaller filter
    shows, and the least vector that these rows link it with."""
    side = group.column("side").to_numpy()
    if cross:  # the first block's rows, then the second's
        group, middle = group.take(pa.array(np.argsort(side, kind="stable"))), int((side == side.min()).sum())
    else:
        middle = 0
    if not len(side) or cross and middle == len(side):
        return None
    unit = unit_of(np.frombuffer(bytes_of(group.column("vector"))[0].tobytes(), kind).reshape(len(side), -1).astype(float))
    linked = np.zeros((len(side), len(side)), bool)
    linked[: middle or None, middle:] = unit[: middle or None] @ unit[middle:].T >= least
    linked |= linked.T
    np.fill_diagonal(linked, False)
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    group, linked = group.take(pa.array(some)), linked[np.ix_(some, some)]
    rep, copies = (group.column(c).to_numpy() for c in ("rep", "copies"))
    smaller = group.column("smaller").combine_chunks()
    has = _both(np.repeat(np.arange(len(rep)), smaller.value_lengths().to_numpy()), smaller.flatten().to_numpy(), len(rep))
    new = linked & (has @ has.T == 0) if has.shape[1] else linked
    order = np.argsort(rep, kind="stable")
    label = np.empty(len(rep), np.int64)
    label[order] = rep[order][_labels(linked[np.ix_(order, order)])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, new @ copies, label)], ["rep", "links", "label"])


def _verified(batches: Iterator[pa.RecordBatch], least: float, kind: str) -> Iterator[pa.RecordBatch]:
    """The links of each group of rows with equal filter, dims, first and second; groups follow one another."""
    current: tuple | None = None
    held: list[pa.RecordBatch] = []

    def closed() -> Iterator[pa.RecordBatch]:
        found = _block(pa.Table.from_batches(held), current[2] != current[3], least, kind) if current else None
        if found:
            yield found

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("filter", "dims", "first", "second")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            key = tuple(keys[i].tolist())
            if key != current:
                yield from closed()
                held, current = [], key
            held.append(batch.slice(i, j - i))
    yield from closed()


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Equal vectors are one representative with a number of copies. Each representative is decoded to all filter
    directions it exceeds; rows meet by filter and are verified there by cosine in double precision, in blocks of
    at most BLOCK (a filter with more is split into pairs of blocks, so none is dropped). What leaves a block is
    one row for a linked vector, not the pairs. A link counts at the least filter its two vectors share.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component; vectors of different lengths never link. An empty table gives an empty result. Rows with equal
    vec_id and equal vectors count as copies of each other. Codes are added with the number of vectors, so that a
    link at exactly `least` is found with a probability of about RECALL, nearer ones more surely; the tests measure
    it at up to 200 words a part (5 million vectors)."""
    spark = vectors.sparkSession
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), value).alias("embedding"))
    reps = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = staged(reps.where("rep IS NOT NULL").withColumn("dims", F.size("embedding")))
    n = reps.count()
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    words = max(2, int(np.ceil((n * LIST / PER_FILTER) ** (1 / PARTS))))
    lists = staged(reps.repartition(max(8, n // 2000)).mapInArrow(lambda b: _filtered(b, words, least, kind), "rep bigint, copies bigint, dims int, vector binary, filters array<int>"))
    narrow = lists.select("dims", F.explode("filters").alias("filter"))
    crowds = narrow.groupBy("dims", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.expr(f"cast((n - 1) div {BLOCK} + 1 as int)")).drop("n")
    met = lists.select("*", F.posexplode("filters").alias("position", "filter")).join(crowds, ["dims", "filter"])
    met = met.withColumn("smaller", F.slice("filters", 1, F.col("position")))
    met = met.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("filter", "dims", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"), "rep", "copies", "side", "vector", "smaller")
    key = ["filter", "dims", "first", "second"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * LIST * CODES // 10_000)
    found = staged(met.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(lambda b: _verified(b, least, kind), "rep bigint, links bigint, label bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    known = (
        reps.select("embedding", "rep", "copies").join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.join(known, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors; those that are null, zero or hold a value that is not finite are linked with nothing."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
