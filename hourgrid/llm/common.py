"""What the operators share: reading tables, staging in the shared folder, and views of Arrow text."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new place below spark.checkpoint.dir, which the whole cluster sees. Where that is unset (tests), a temporary
    folder serves a session on one machine; on a cluster, whose executors would not share it, this fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-hourgrid-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and lost executors do not lose it."""
    path = shared_folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than 1 / HOT_KEYS of all rows is hot, so fewer than HOT_KEYS keys are.
HOT_KEYS = 1024


def spread_join(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the facts of their key. facts: one row a key, with the number of the key's rows as `weight`; total: at
    least the number of all rows.

    Hot keys are few whatever the data, so their facts are broadcast and their rows stay where they are; only the
    other rows are shuffled, and no task gets more than 1 / HOT_KEYS of all rows for one key. Rows without facts go."""
    hot = F.broadcast(facts.where(F.col("weight") * HOT_KEYS > total))
    near = rows.join(hot, key).drop("weight")
    rest = rows.join(hot.select(key, "weight"), key, "left").where("weight IS NULL").drop("weight")
    return near.unionByName(rest.join(facts.where(F.col("weight") * HOT_KEYS <= total).drop("weight"), key))


def guarded(docs: DataFrame, own: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but `own` under names that clash with nothing, and what selects the old columns back."""
    names = {c: c if c in own else f"__column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column, one after the other, and the offsets of the texts. Null: empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def spans(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes together, or one longer text."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every element."""
    x = x ^ (x >> _S)
    x *= _C1
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x
