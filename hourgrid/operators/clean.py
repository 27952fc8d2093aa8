"""Unique hours, one gap-free grid, filled gaps."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import by_time, filled
from hourgrid.operators import buckets

Feed = tuple[DataFrame, list[str]]
# Rows that interpolation reaches into a gap from each side.
FILL_LIMITS = {
    "lmp": 24, "congestion": 24, "marginal_loss": 24, "load_mw": 12, "temp_c": 6, "dewpoint_c": 6, "rh_pct": 6, "wind_speed_ms": 6, "slp_hpa": 6,
    "cdd": 6, "hdd": 6, "n_stations": 6,
}
FILL_FROM, FILL_ZERO = {"heat_index_c": "temp_c", "wind_chill_c": "temp_c"}, ("precip_1h_mm", "precip_6h_mm")


def dedup_mean(df: DataFrame, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each hour of a series: means of the values present; rows without a time are left out."""
    return df.where("ts IS NOT NULL").groupBy(*keys, "ts").agg(*[F.avg(m).alias(m) for m in measures])


def hourly_spine(feeds: list[Feed], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every hour from the latest first hour of the feeds to their earliest last hour."""
    ends = [df.groupBy(*keys).agg(F.min("ts").alias(f"a{i}"), F.max("ts").alias(f"b{i}")) for i, (df, _) in enumerate(feeds)]
    both = reduce(lambda x, y: x.join(y, list(keys)) if keys else x.crossJoin(y), ends)  # without keys: one row each
    first, last = (F.col(f"{c}0") if len(feeds) == 1 else f(*[f"{c}{i}" for i in range(len(feeds))]) for c, f in (("a", F.greatest), ("b", F.least)))
    hours = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
    return both.select(*keys, F.explode(hours).alias("ts"))


def join_sources(spine: DataFrame, feeds: list[Feed], keys: tuple[str, ...] = ()) -> DataFrame:
    """The grid with each feed's unique hours beside it."""
    return reduce(lambda grid, feed: grid.join(dedup_mean(*feed, keys), [*keys, "ts"], "left"), feeds, spine)


def align(feeds: list[Feed], keys: tuple[str, ...] = ()) -> DataFrame:
    """dedup_mean, hourly_spine and join_sources at once: the grid and all feeds as one union, aggregated once."""
    spine = hourly_spine(feeds, keys).withColumn("on_grid", F.lit(1))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(*keys, "ts", *m) for df, m in feeds], spine)
    means = [F.avg(m).alias(m) for _, measures in feeds for m in measures]
    return rows.groupBy(*keys, "ts").agg(F.max("on_grid").alias("on_grid"), *means).where("on_grid = 1").drop("on_grid")


def fill_gaps(df: DataFrame, limits: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """<measure>_clean by interpolation with a limit."""
    rows = df.withColumn("_row", F.row_number().over(by_time(keys)))
    return rows.withColumns({f"{c}_clean": filled(F.col(c), F.col("_row"), n, keys) for c, n in limits.items()}).drop("_row")


def clean(df: DataFrame, keys: tuple[str, ...] = (), bucket_hours: int | None = None) -> DataFrame:
    """Flags of missing values, the observed price, and clean columns of all measures there are. bucket_hours: gaps are
    filled bucket by bucket, for series too long for one task; df is then read twice."""
    there = set(df.columns)
    known = [c for c in [*FILL_LIMITS, *FILL_FROM, *FILL_ZERO] if c in there]
    rows = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in known}).withColumn("lmp_observed", F.col("lmp"))
    limits = {c: n for c, n in FILL_LIMITS.items() if c in there}
    rows = buckets.fill_gaps(rows, limits, keys, bucket_hours) if bucket_hours else fill_gaps(rows, limits, keys)
    rest = {f"{c}_clean": F.coalesce(c, f"{other}_clean") for c, other in FILL_FROM.items() if c in there}
    rest |= {f"{c}_clean": F.coalesce(F.col(c), F.lit(0.0)) for c in FILL_ZERO if c in there}
    return rows.withColumns(rest) if rest else rows
