"""Vector codes: k-means over the parts of vectors, where metric trees settle whole balls at once."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import staged, table

# Parts of a vector, entries of a codebook, rounds, steps of a whole unit.
PARTS, ENTRIES, ROUNDS, GRID = 4, 256, 4, 1024
#: Vectors of one block, whose parts have trees of their own, and vectors that one ball is not divided below.
BLOCK, LEAF = 4096, 32


def cuts(dims: int) -> list[int]:
    """Where the parts of a vector begin and end; if they cannot be equal, the first ones are one longer."""
    return np.cumsum([0, *(len(p) for p in np.array_split(np.arange(dims), PARTS))]).tolist()


def kind_of(values: np.ndarray) -> type:
    """A number type in which squared distances of these parts and of means of them are exact."""
    most = int(np.abs(values).max(initial=0)) + 1
    width = max(1, -(-values.shape[1] // PARTS))
    if 4 * width * most * most < 2**53:
        return np.float64
    if most < 2**53 and 4 * width * most * most < 2**63:
        return np.int64
    raise ValueError(f"components as large as {most / GRID:g} have no exact distances in 64 bits")


@dataclass
class Tree:
    """Balls over the rows of one part. order: rows, those of a ball together; low, high: a ball's rows in it; left,
    right: its two balls, -1 at a leaf; sums: of its rows; middle, radius: a ball that holds them."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray
    middle: np.ndarray
    radius: np.ndarray


def _anchors(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows dealt to anchors: each new one stands at the row that is farthest from its own anchor, and takes over the
    rows that are nearer to it. A row closer to its anchor than half the way to the new one cannot change over, so
    its distance is not looked at."""
    pivots = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    owner = np.zeros(len(x), np.int64)
    for k in range(1, most):
        new = int(far.argmax())
        if far[new] == 0:
            break
        way = np.sqrt(((x[pivots] - x[new]) ** 2).sum(axis=1))
        open_rows = np.flatnonzero(far > way[owner] / 2)
        near = np.sqrt(((x[open_rows] - x[new]) ** 2).sum(axis=1))
        change = near < far[open_rows]
        taken = open_rows[change]
        owner[taken], far[taken] = k, near[change]
        pivots.append(new)
    by = np.argsort(owner, kind="stable")
    return np.split(by, np.cumsum(np.bincount(owner, minlength=len(pivots)))[:-1])


def tree_of(part: np.ndarray) -> Tree:
    """The anchors hierarchy: about sqrt(n) anchors are the middle of the tree, the two whose common ball is smallest
    are joined until one is left, and each anchor is divided in the same way. Equal rows and no rows make one leaf."""
    x = part.astype(np.float64)
    left, right, rows = [], [], []

    def leaf(mine: np.ndarray) -> int:
        left.append(-1)
        right.append(-1)
        rows.append(mine)
        return len(rows) - 1

    def grown(mine: np.ndarray) -> int:
        groups = _anchors(x[mine], int(np.ceil(np.sqrt(len(mine))))) if len(mine) > LEAF else [np.arange(len(mine))]
        if len(groups) == 1:
            return leaf(mine)
        return joined([mine[g] for g in groups])

    def joined(groups: list[np.ndarray]) -> int:
        node = [grown(g) for g in groups]
        size = np.array([float(len(g)) for g in groups])
        middle = np.stack([x[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(((x[g] - m) ** 2).sum(axis=1).max()) for g, m in zip(groups, middle)])
        span = np.sqrt(((middle[:, None] - middle[None, :]) ** 2).sum(axis=2))
        cost = np.maximum((span + radius[:, None] + radius[None, :]) / 2, np.maximum(radius[:, None], radius[None, :]))
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(groups) - 1):
            a, b = divmod(int(cost.argmin()), len(groups))
            left.append(node[a])
            right.append(node[b])
            rows.append(np.zeros(0, np.int64))
            node[a] = len(rows) - 1
            both = (middle[a] * size[a] + middle[b] * size[b]) / (size[a] + size[b])
            radius[a] = max(np.linalg.norm(both - middle[a]) + radius[a], np.linalg.norm(both - middle[b]) + radius[b])
            middle[a], size[a] = both, size[a] + size[b]
            cost[b, :] = cost[:, b] = np.inf
            alive = np.isfinite(cost[a])
            reach = np.linalg.norm(middle[alive] - middle[a], axis=1)
            cost[a, alive] = cost[alive, a] = np.maximum((reach + radius[a] + radius[alive]) / 2, np.maximum(radius[a], radius[alive]))
        return node[int(size.argmax())]

    root = grown(np.arange(len(x)))
    renamed, walk, low, high, pending, start = np.zeros(len(rows), np.int64), [], [], [], [root], 0
    while pending:  # from the root on, left before right, so that a ball's rows lie together
        at = pending.pop()
        renamed[at] = len(walk)
        walk.append(at)
        low.append(start)
        start += len(rows[at])
        high.append(start)
        if left[at] >= 0:
            pending += [right[at], left[at]]
    down = lambda child: np.array([renamed[child[at]] if child[at] >= 0 else -1 for at in walk], np.int64)
    left, right, low, high = down(left), down(right), np.array(low), np.array(high)
    for k in range(len(walk) - 1, -1, -1):
        if left[k] >= 0:
            high[k] = high[right[k]]
    order = np.concatenate([rows[at] for at in walk])
    placed = part[order].astype(np.int64)
    running = np.concatenate([np.zeros((1, part.shape[1]), np.int64), np.cumsum(placed, axis=0)])
    sums = running[high] - running[low]
    middle = sums / np.maximum(high - low, 1)[:, None]
    real = placed.astype(np.float64)
    radius = np.array([np.sqrt(((real[a:b] - m) ** 2).sum(axis=1).max(initial=0.0)) for a, b, m in zip(low, high, middle)])
    return Tree(order, low, high, left, right, sums, middle, radius)


def assigned(part: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower one), and counts and sums of the rows of each entry.

    Balls are gone through level by level. A ball inherits the candidates of the one above, and drops those that lie,
    as seen from its whole ball, beyond the bisector with the candidate nearest to its middle. With one candidate left
    the ball is that entry's as a whole, by its cached sum and count; at a leaf the rows are compared with the
    candidates that are left. Distances of rows are exact; a candidate is dropped only by more than rounding."""
    kind = part.dtype.type
    entries = book.astype(kind)
    real = book.astype(np.float64)
    owner = np.zeros(len(part), np.int64)
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    first = np.sort(np.unique(book, axis=0, return_index=True)[1])  # of equal entries only the first owns anything
    squares, exact = (real**2).sum(axis=1), (entries**2).sum(axis=1)
    gaps = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * real @ real.T, 0))
    slack = 1e-9 * (1 + squares.max(initial=0.0) + (np.abs(tree.middle).max(initial=0.0) + tree.radius.max(initial=0.0)) ** 2)
    balls = np.zeros(1, np.int64) if len(part) else np.zeros(0, np.int64)
    open_ = np.zeros((len(balls), len(book)), bool)
    open_[:, first] = True
    while len(balls):
        middle = tree.middle[balls]
        far = squares[None, :] - 2 * middle @ real.T
        far[~open_] = np.inf
        best = far.argmin(axis=1)
        row = np.arange(len(balls))
        open_ &= far - far[row, best][:, None] <= 2 * tree.radius[balls][:, None] * gaps[best] * (1 + 1e-9) + slack
        single = open_.sum(axis=1) == 1
        for ball, entry in zip(balls[single], best[single]):
            a, b = tree.low[ball], tree.high[ball]
            owner[tree.order[a:b]] = entry
            counts[entry] += b - a
            sums[entry] += tree.sums[ball]
        at_leaf = ~single & (tree.left[balls] < 0)
        for ball, candidates in zip(balls[at_leaf], open_[at_leaf]):
            rows, left = tree.order[tree.low[ball] : tree.high[ball]], np.flatnonzero(candidates)
            mine = left[(exact[left][None, :] - 2 * part[rows] @ entries[left].T).argmin(axis=1)]
            owner[rows] = mine
            counts += np.bincount(mine, minlength=len(book))
            np.add.at(sums, mine, part[rows].astype(np.int64))
        deeper = ~single & ~at_leaf
        balls, open_ = np.concatenate([tree.left[balls[deeper]], tree.right[balls[deeper]]]), np.concatenate([open_[deeper], open_[deeper]])
    return owner, counts, sums


_INTS = ("order", "low", "high", "left", "right", "sums")
_FIELDS = (*_INTS, "middle", "radius")
_TREE = pa.struct([(f, pa.binary()) for f in _FIELDS])
_BLOCKS = "dims int, n int, vec_id array<bigint>, label array<{label}>, vectors binary, trees array<struct<" + ", ".join(f"{f}: binary" for f in _FIELDS) + ">>"


def _packed(tree: Tree) -> dict[str, bytes]:
    return {f: np.ascontiguousarray(getattr(tree, f)).tobytes() for f in _FIELDS}


def _unpacked(row: dict[str, bytes], width: int) -> Tree:
    held = {f: np.frombuffer(row[f], np.int64 if f in _INTS else np.float64) for f in _FIELDS}
    nodes = len(held["radius"])
    return Tree(**held | {f: held[f].reshape(nodes, width) for f in ("sums", "middle")})


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """In as few bytes a component as they need."""
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _wide(held: bytes, n: int, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(held) // max(1, n * dims), np.int64)
    return np.frombuffer(held, kind).astype(np.int64).reshape(n, dims)


def _blocked(batches: Iterator[pa.RecordBatch], label_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK vectors of one length, with a tree over each part."""
    held: dict[int, list[tuple]] = {}

    def block(dims: int, rows: list[tuple]) -> pa.RecordBatch:
        vectors = np.stack([r[2] for r in rows]).reshape(len(rows), dims)
        at, kind = cuts(dims), kind_of(vectors)
        trees = [_packed(tree_of(vectors[:, a:b].astype(kind))) for a, b in zip(at, at[1:])]
        columns = [pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                   pa.array([[r[1] for r in rows]], pa.list_(label_kind)), pa.array([_narrow(vectors).tobytes()], pa.binary()), pa.array([trees], pa.list_(_TREE))]
        return pa.RecordBatch.from_arrays(columns, ["dims", "n", "vec_id", "label", "vectors", "trees"])

    for batch in batches:
        column = batch.column("embedding")
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(v) for v in column)])
        steps = np.floor(GRID * flat.astype(np.float64))
        if np.abs(steps).max(initial=0) >= 2**53:
            kind_of(steps.reshape(1, -1).astype(object))
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            mine = held.setdefault(int(b - a), [])
            mine.append((ids[i], labels[i], steps[a:b].astype(np.int64)))
            if len(mine) == BLOCK:
                yield block(int(b - a), held.pop(int(b - a)))
        while sum(map(len, held.values())) > 4 * BLOCK:  # many lengths: the fullest block goes out as it is
            dims = max(held, key=lambda d: len(held[d]))
            yield block(dims, held.pop(dims))
    for dims, rows in held.items():
        yield block(dims, rows)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[Tree]]]:
    """Of each block: its place in the batch, its length, its vectors, its trees."""
    for i in range(batch.num_rows):
        dims, n = batch.column("dims")[i].as_py(), batch.column("n")[i].as_py()
        vectors, at = _wide(batch.column("vectors")[i].as_py(), n, dims), cuts(dims)
        yield i, dims, vectors, [_unpacked(t, b - a) for t, a, b in zip(batch.column("trees")[i].as_py(), at, at[1:])]


def _summed(batches: Iterator[pa.RecordBatch], books: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The count and the sums of the rows of each entry, added up over all blocks of a task."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for _, dims, vectors, trees in _parts(batch):
            at, kind = cuts(dims), kind_of(vectors)
            for p, tree in enumerate(trees):
                _, counts, sums = assigned(vectors[:, at[p] : at[p + 1]].astype(kind), tree, books[dims][p])
                known = total.setdefault((dims, p), [0, 0])
                known[0], known[1] = known[0] + counts, known[1] + sums
    rows = [(dims, p, e, [int(counts[e]), *sums[e].tolist()]) for (dims, p), (counts, sums) in total.items() for e in np.flatnonzero(counts)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["dims", "part", "entry", "sums"])


def _coded(batches: Iterator[pa.RecordBatch], books: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, dims, vectors, trees in _parts(batch):
            at, kind = cuts(dims), kind_of(vectors)
            code, error = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
            for p, tree in enumerate(trees):
                part, book = vectors[:, at[p] : at[p + 1]], books[dims][p]
                owner = assigned(part.astype(kind), tree, book)[0]
                code[:, p] = owner
                error += ((part - book[owner]) ** 2).sum(axis=1)
            text = code.tobytes().hex()
            codes = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
            columns = [batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(codes, pa.string()), pa.array(error), pa.array([dims] * len(code), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "dims"])


def _smallest(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """The vectors of blocks whose vec_id is at most `most`; None: all."""
    for batch in batches:
        for i in range(batch.num_rows):
            dims, n = batch.column("dims")[i].as_py(), batch.column("n")[i].as_py()
            vectors = _wide(batch.column("vectors")[i].as_py(), n, dims)
            ids = batch.column("vec_id")[i].values
            pick = [k for k, v in enumerate(ids.to_pylist()) if most is None or v is not None and v <= most]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pick, pa.int64())), pa.array([vectors[k].tolist() for k in pick], pa.list_(pa.int64()))], ["vec_id", "vector"])


def _first_books(blocks: DataFrame, dims: int) -> list[np.ndarray]:
    """The parts of the ENTRIES smallest vec_ids; rows of one id by their components, rows without an id last."""
    mine = blocks.where(F.col("dims") == dims)
    ids = mine.select(F.explode(F.slice(F.array_sort(F.array_compact("vec_id")), 1, ENTRIES)).alias("vec_id")).orderBy("vec_id").limit(ENTRIES)
    known = ids.agg(F.count("*"), F.max("vec_id")).first()
    most = known[1] if known[0] == ENTRIES else None
    near = mine if most is None else mine.where(F.array_min(F.array_compact("vec_id")) <= most)
    rows = near.select("dims", "n", "vec_id", "vectors").mapInArrow(lambda b: _smallest(b, most), "vec_id bigint, vector array<bigint>")
    chosen = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    vectors = np.array([r["vector"] for r in chosen], np.int64).reshape(len(chosen), dims)
    at = cuts(dims)
    return [vectors[:, a:b] for a, b in zip(at, at[1:])]


def _moved(blocks: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """The next books: entries at the floor of their rows' means; those without rows stay."""
    sums = blocks.mapInArrow(lambda b: _summed(b, books), "dims int, part int, entry int, sums array<bigint>")
    key = ["dims", "part", "entry", "place"]
    cells = sums.select("dims", "part", "entry", F.posexplode("sums").alias("place", "value")).groupBy(key).agg(F.sum("value").alias("value")).orderBy(key)
    out = {d: [b.copy() for b in book] for d, book in books.items()}
    for r in cells.collect():  # ENTRIES rows a component at most
        if r["place"] == 0:
            n = r["value"]
        else:
            out[r["dims"]][r["part"]][r["entry"], r["place"] - 1] = r["value"] // n
    return out


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are left out. Components become whole numbers, and
    all that is compared or added up is exact, so the result does not depend on how rows are dealt to tasks. Rows are
    packed into blocks once, each with an anchors hierarchy over every part; the blocks are written to the shared
    folder and read again in every round, and only counts and sums by entry leave a task. The driver holds the
    codebooks: ENTRIES entries for each length of vector.

    Vectors of different lengths have codebooks of their own; a length that PARTS does not divide has longer parts
    first, and parts without components cost nothing. Repeated rows count as often as they are there; rows of one
    vec_id are ordered by their components, rows without one come last. With fewer than ENTRIES vectors there are as
    many entries. Components whose squared distances exceed 64 bits end the job with a message. No vectors give an
    empty table."""
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("embedding"), "label").where(sound)
    label = dict(rows.dtypes)["label"]
    label_kind = pa.from_numpy_dtype(np.int64) if label == "bigint" else pa.int32() if label == "int" else pa.string()
    if label not in ("int", "bigint", "string"):
        raise TypeError(f"labels of type {label}")
    blocks = staged(rows.mapInArrow(lambda b: _blocked(b, label_kind), _BLOCKS.format(label=label)))
    books = {r["dims"]: _first_books(blocks, r["dims"]) for r in blocks.select("dims").distinct().collect()}  # a row a length
    for _ in range(ROUNDS):
        books = _moved(blocks, books)
    digests = {d: hashlib.sha256(",".join(str(x) for b in book for x in b.ravel().tolist()).encode()).hexdigest() for d, book in books.items()}
    coded = staged(blocks.mapInArrow(lambda b: _coded(b, books), f"vec_id bigint, label {label}, code string, error bigint, dims int"))
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    known = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair]) if digests else F.lit(None).cast("map<int, string>")
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.element_at(known, F.col("dims")).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors with whole components, their errors and the digest of the final codebooks."""
    return compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


_SQUARE = "sum((x.v - b.v) * (x.v - b.v))"


def _round_sql(k: int) -> str:
    return f"""near_{k} AS MATERIALIZED (SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT x.id, x.p, b.e, {_SQUARE} AS d FROM cells x JOIN book_{k} b ON b.p = x.p AND b.i = x.i GROUP BY ALL) GROUP BY id, p)"""


def _book_sql(k: int) -> str:
    return f"""book_{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.v, b.v) AS v FROM book_{k} b LEFT JOIN
  (SELECT n.p, n.e, x.i, CAST(floor(sum(x.v)::HUGEINT / count(*)) AS BIGINT) AS v FROM near_{k} n JOIN cells x ON x.id = n.id AND x.p = n.p GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.i = b.i)"""


#: For vectors of one length that four divides, each with an id of its own, as the tables have them.
SQL = f"""WITH kept AS (SELECT vec_id AS id, label, embedding AS v, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda z: NOT isfinite(z))) = 0),
cells AS MATERIALIZED (SELECT id, j // w AS p, j % w AS i, CAST(floor({GRID} * v[j + 1]::DOUBLE) AS BIGINT) AS v FROM (SELECT id, v, w, unnest(range(len(v))) AS j FROM kept)),
starts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book_0 AS MATERIALIZED (SELECT p, e, i, v FROM cells JOIN starts USING (id)),
{", ".join(_round_sql(k) + ", " + _book_sql(k) for k in range(ROUNDS))},
{_round_sql(ROUNDS)},
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book_{ROUNDS}),
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near_{ROUNDS} GROUP BY id)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), digest"""
