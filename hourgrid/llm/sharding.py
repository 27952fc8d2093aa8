"""K-d tree partitioning of documents into shards of equal bytes (DataFrame functions only)."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import staged, table

#: Ranges of one histogram pass, of all nodes together, and the least for a node; they are what the driver gets.
BUCKETS, LEAST_BUCKETS = 32_768, 64
#: So few units around the nodes' cuts, all together, are sorted by the driver instead of by a further pass.
FEW = 16_384
#: A group of equal texts that no shard can hold is dealt in pieces of about this share of a shard.
PIECE = 0.01
#: A group of more than 1 / LARGE of a shard gets its shard before the tree is grown; LARGE * shards are the most of them.
LARGE = 20
#: Rows for which one group of slots is meant.
SLOT_GROUP = 20_000

DIMENSIONS = ("source_code", "lang_code", "id_code", "size")
_TIES = ("text_crc32", "hash_high", "hash_low", "piece")
_TIE_RANGES = {"text_crc32": (0, 2**32 - 1), "hash_high": (-(2**31), 2**31 - 1), "hash_low": (0, 2**32 - 1), "piece": (0, 2**31 - 1)}


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: size in UTF-8 bytes plus one, digest, and the dimensions of the tree.

    Null text counts as empty, null lang and source as the empty string, a null id as the smallest id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        code("source").alias("source_code"),
        code("lang").alias("lang_code"),
        F.shiftright(known, 2).alias("id_code"),
        F.monotonically_increasing_id().alias("row"),
    )


def units_of(narrow: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts as what is dealt: (narrow with the piece each row is of, one row for each unit with its
    weight and the least of its rows' dimensions). heavy: (text_crc32, text_hash, pieces) of those that are cut."""
    text = ["text_crc32", "text_hash"]
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int")
    pieces = narrow.join(F.broadcast(heavy), text, "left").withColumn("piece", piece).drop("pieces")
    units = pieces.groupBy(*text, "piece").agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in DIMENSIONS])
    return pieces, units.withColumn("hash_high", F.shiftright("text_hash", 32)).withColumn("hash_low", F.col("text_hash").bitwiseAND(F.lit(2**32 - 1)))


@dataclass
class Node:
    """A node of the tree: shards first..first+leaves-1, and the search for its cut, at left / whole of its bytes."""

    first: int
    leaves: int
    total: int
    left: int
    whole: int
    dimension: str
    low: int
    high: int
    below: int = 0
    keep: bool = False
    found: list[int] = field(default_factory=list)

    @property
    def column(self) -> str:
        return (self.dimension, *_TIES)[len(self.found)]

    @property
    def open(self) -> bool:
        return len(self.found) < 1 + len(_TIES)

    def crosses(self, weight: int) -> bool:
        """Whether so much weight is more than the left child's share."""
        return weight * self.whole > self.total * self.left

    def end(self, key: tuple[int, ...], weight: int) -> None:
        """The cut is at key; the unit there goes to the side that is then nearer to its share."""
        self.found = list(key)
        self.keep = (2 * self.below + weight) * self.whole < 2 * self.total * self.left

    def settle(self, value: int) -> None:
        self.found.append(value)
        if self.open:
            self.low, self.high = _TIE_RANGES[self.column]


def _key(dimension: Column) -> Column:
    return F.coalesce(*[F.when(dimension == d, F.col(d)) for d in DIMENSIONS])


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of at most one row for each shard: its size is bounded by the number of shards."""
    return F.broadcast(spark.createDataFrame(rows, schema))


_STATE = [f"v{i}" for i in range(1 + len(_TIES))]


def _around(placed: DataFrame, nodes: list[Node], buckets: int) -> DataFrame:
    """The units in which the nodes' cuts are still sought, with `value`, the key that is narrowed now."""
    state = _small(
        placed.sparkSession,
        [(n.first, n.dimension, len(n.found), *(n.found + [0] * len(_STATE))[: len(_STATE)], n.low, n.high, (n.high - n.low) // buckets + 1) for n in nodes],
        f"node int, dimension string, depth int, {', '.join(f'{v} bigint' for v in _STATE)}, low bigint, high bigint, width bigint",
    )
    keys = [_key(F.col("dimension")), *[F.col(t) for t in _TIES]]
    inside = F.lit(True)
    for i, v in enumerate(_STATE):
        inside = inside & ((F.col("depth") <= i) | (keys[i] == F.col(v)))
    rows = placed.join(state, "node").where(inside).withColumn("k0", keys[0])
    rows = rows.withColumn("value", F.coalesce(*[F.when(F.col("depth") == i, k) for i, k in enumerate(keys)]))
    return rows.where(F.col("value").between(F.col("low"), F.col("high")))


def _cuts(placed: DataFrame, nodes: list[Node]) -> None:
    """Finds each node's cut: the least (dimension, ties) whose cumulative weight is beyond the left share.

    Every pass sums weights in ranges and goes on inside the range that holds the cut; the last few units of a node
    are put in order here. What the driver gets is bounded for all nodes together."""
    while active := [n for n in nodes if n.open]:
        buckets = max(LEAST_BUCKETS, BUCKETS // len(active))
        rows = (
            _around(placed, active, buckets).groupBy("node", F.expr("(value - low) div width").alias("bucket"))
            .agg(F.sum("weight").alias("weight"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
            .collect()
        )
        of_node: dict[int, list] = {}
        for r in rows:
            of_node.setdefault(r.node, []).append(r)
        few = []
        for n in active:
            for r in sorted(of_node.get(n.first, []), key=lambda r: r.bucket):
                if n.crosses(n.below + r.weight):
                    n.low, n.high = r.least, r.most
                    if r.n <= max(1, FEW // len(active)):
                        few.append(n)
                    elif r.least == r.most:
                        n.settle(r.least)
                    break
                n.below += r.weight
        if few:
            by_node: dict[int, list] = {}
            for r in _around(placed, few, buckets).select("node", "weight", "k0", *_TIES).collect():
                by_node.setdefault(r.node, []).append(((r.k0, *[r[t] for t in _TIES]), r.weight))
            for n in few:
                for key, weight in sorted(by_node[n.first]):
                    if n.crosses(n.below + weight):
                        n.end(key, weight)
                        break
                    n.below += weight


def _first(large: list[int], shards: int, share: int) -> tuple[list[int], list[int]]:
    """Shards of large groups, by weight, each in turn into the one that holds least so far, the heaviest
    first; and the bytes of its share that each shard has left."""
    held, out = [0] * shards, []
    for weight in large:
        k = held.index(min(held))
        held[k] += weight
        out.append(k)
    return out, [max(0, share - h) for h in held]


def _tree(units: DataFrame, room: list[int]) -> DataFrame:
    """units with their leaf as `node`, the number of the shard; room: the bytes each shard is to get."""
    shards = len(room)
    spark = units.sparkSession
    spread = [f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("min", F.min), ("max", F.max))]
    placed, open_leaves, whole = units.withColumn("node", F.lit(0)), {0: shards}, None
    while any(k > 1 for k in open_leaves.values()):
        rows = {r.node: r for r in placed.groupBy("node").agg(F.sum("weight").alias("total"), *spread).collect()}
        if not rows:
            return placed
        whole = whole or {d: max(1, rows[0][f"max_{d}"] - rows[0][f"min_{d}"]) for d in DIMENSIONS}
        nodes = []
        for first, leaves in open_leaves.items():
            if leaves > 1 and first in rows:
                r = rows[first]
                width = {d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d] for d in DIMENSIONS}
                d = max(DIMENSIONS, key=lambda d: (width[d], -DIMENSIONS.index(d)))
                left, all_ = sum(room[first : first + leaves // 2]), sum(room[first : first + leaves])
                left, all_ = (min(left, all_ - 1), all_) if all_ else (leaves // 2, leaves)
                nodes.append(Node(first, leaves, r.total, left, all_, d, r[f"min_{d}"], r[f"max_{d}"]))
        _cuts(placed, nodes)
        cut = _small(
            spark,
            [(n.first, n.dimension, n.leaves // 2, n.keep, *n.found) for n in nodes] or [(-1, "size", 0, False, *[0] * len(_STATE))],
            f"node int, dimension string, step int, keep boolean, {', '.join(f'{v} bigint' for v in _STATE)}",
        )
        left, same = F.lit(False), F.lit(True)
        for key, v in zip([_key(F.col("dimension")), *[F.col(t) for t in _TIES]], _STATE):
            left = left | (same & (key < F.col(v)))
            same = same & (key == F.col(v))
        left = left | (same & F.col("keep"))
        placed = placed.join(cut, "node", "left").select(
            *units.columns, F.when(F.col("step").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("step")).alias("node")
        )
        placed = staged(placed)
        open_leaves = {k: v for first, n in open_leaves.items() for k, v in ({first: n // 2, first + n // 2: n - n // 2} if n > 1 else {first: n}).items()}
    return placed


def kd_shards(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """Deals whole documents into shards by a k-d tree over source, language, id and size.

    Groups of equal texts stay together; their dimensions are the least of their rows. Only a group that is larger
    than a shard is cut into pieces. Groups of more than 1 / LARGE of a shard are dealt first, each to the shard that
    holds least; the tree then fills the room that is left. Each node is split at the weighted median of its widest
    dimension (its range against the range over all rows; weights are bytes, the halves are the room of the shards on
    either side), ties by digest of the text, until there are `shards` leaves, or as many as total / target_bytes asks
    for. The unit at a cut goes to the side that is nearer to its share, so shards differ by about a group at a cut.
    Slots number each shard's rows from 0.

    No row is lost: null texts have size 1 and are one group with empty ones. An empty table gives an empty
    result. Other columns are not looked at."""
    narrow = staged(metadata(docs))
    facts = narrow.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    total = facts.bytes or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    text = ["text_crc32", "text_hash"]
    held = narrow.groupBy(*text).agg(F.sum("size").alias("held")).where(F.col("held") * (LARGE * shards) > total)
    heavy = staged(held)  # LARGE * shards rows at most, as they hold more than 1 / LARGE of a shard each
    fits = heavy.where(F.col("held") * shards <= total).orderBy(F.desc("held"), *text).collect()
    homes, room = _first([r.held for r in fits], shards, total // shards)
    large = _small(docs.sparkSession, [(r.text_crc32, r.text_hash, k) for r, k in zip(fits, homes)], "text_crc32 bigint, text_hash bigint, node int")
    cut = heavy.where(F.col("held") * shards > total).select(*text, F.ceil(F.col("held") * shards / (PIECE * total)).cast("int").alias("pieces"))
    pieces, units = units_of(narrow, cut)
    units = staged(units)
    grown = _tree(units.join(large, text, "left_anti"), room).select(*text, "piece", F.col("node").alias("shard"))
    leaves = grown.unionByName(units.join(large, text).select(*text, "piece", F.col("node").alias("shard")))
    placed = pieces.join(leaves, [*text, "piece"]).select("doc_id", "size", "text_crc32", "shard")
    groups = max(1, facts.n // (SLOT_GROUP * shards) + 1)
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)).cast("int")
    placed = placed.withColumn("part", part)
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("text_crc32", "doc_id"))
    return placed.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + number - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, groups of equal texts together."""
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)
