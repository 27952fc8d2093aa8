"""Reading feeds and reports, writing datasets and reports."""

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.columns import number

#: Times that a report may hold; a bad one is null there.
REPORT_TIMES = ("origin_ts", "target_ts", "timestamp_utc")


def read_hourly_csv(spark: SparkSession, path: str, time_column: str, measures: list[str]) -> DataFrame:
    """A CSV feed: its time column as UTC `ts` (a bad time fails), measures as doubles (bad text is missing)."""
    raw = spark.read.option("header", True).csv(path)
    return coerce_numeric(raw.withColumn("ts", F.col(time_column).cast("timestamp_ntz")).drop(*{time_column} - {"ts"}), measures)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listed columns as doubles; those that are absent are passed over."""
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with its time column as UTC without zone, whatever the session's zone."""
    df = spark.read.parquet(path)
    kind = dict(df.dtypes).get("ts")
    if kind == "timestamp":
        at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz"))
        return df.withColumn("ts", at)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if kind else df


def write_dataset(hours: DataFrame, supervised: DataFrame, path: str) -> None:
    """The modelling tables: <path>/hourly and <path>/supervised (by split), each as parquet and csv. They are staged
    once, so that both forms hold the same rows and nothing is computed twice."""
    for name, df, by in (("hourly", hours, []), ("supervised", supervised, ["split"])):
        rows = staged(df)
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}/parquet")
        rows.write.mode("overwrite").partitionBy(*by).option("header", True).csv(f"{path}/{name}/csv")


def read_dataset(spark: SparkSession, path: str, name: str, kind: str, schema: str) -> DataFrame:
    """One of the modelling tables again: hourly or supervised, parquet or csv; schema has the columns wanted."""
    if kind == "parquet":
        return spark.read.schema(schema).parquet(f"{path}/{name}/parquet")
    raw = spark.read.option("header", True).csv(f"{path}/{name}/csv")
    kinds = dict(spark.createDataFrame([], schema).dtypes)
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV report; without the file an empty table, and bad times are null."""
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    times = {c: F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)") for c in REPORT_TIMES if c in df.columns}
    return df.withColumns(times) if times else df


def staged(df: DataFrame) -> DataFrame:
    """df written to a scratch place and read again: its lineage is cut, and lost executors do not lose it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new place below spark.checkpoint.dir. Where that is unset, a temporary folder serves a session on one
    machine; on a cluster, whose executors would not share it, this fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-hourgrid-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
