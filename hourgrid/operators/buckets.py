"""One series of any length in many tasks: buckets of time, halos around them, and what buckets pass on.

Windows over a whole series gather it in one task. Here hours are dealt to buckets of a fixed number of hours; work with
a bounded reach runs on each bucket with the neighbouring hours beside it, and what reaches further is carried from
bucket to bucket through a table of one row a bucket. All times that a timestamp can hold are 42,800 buckets, so the
windows over such tables are small, whatever the series' length."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import by_time, gap_value, hours_between

#: Hours of one bucket.
HOURS = 2048
Keys = tuple[str, ...]


def hour_number(ts: Column) -> Column:
    return hours_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def bucket_of(ts: Column, hours: int = HOURS) -> Column:
    return F.floor(hour_number(ts) / hours).cast("int")


def beside(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts of the same `on`; null is equal to null. Without `on` facts are one row."""
    if not on:
        return rows.join(F.broadcast(facts))
    facts = facts.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in facts.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return rows.join(facts, same, how).drop(*[f"_on_{c}" for c in on])


def over_buckets(df: DataFrame, work: Callable[[DataFrame, Keys], DataFrame], before: int, after: int, keys: Keys = (), hours: int = HOURS) -> DataFrame:
    """work(df, keys) for work that looks `before` rows back and `after` rows on at most, on a grid without gaps.

    Each hour goes to its own bucket and, near a border, to the neighbour's as well; work runs with the bucket as a
    further key, and each bucket keeps its own hours."""
    if max(before, after) > hours:
        raise ValueError(f"a reach of {max(before, after)} hours needs larger buckets than {hours} hours")
    own = bucket_of(F.col("ts"), hours)
    place = hour_number(F.col("ts")) - own * hours
    copies = F.array_compact(F.array(own, F.when(place >= hours - before, own + 1), F.when(place < after, own - 1)))
    rows = df.withColumn("_own", own).withColumn("_bucket", F.explode(copies))
    return work(rows, (*keys, "_bucket")).where("_own = _bucket").drop("_own", "_bucket")


def fill_gaps(df: DataFrame, limits: dict[str, int], keys: Keys = (), hours: int = HOURS) -> DataFrame:
    """<measure>_clean as the window form makes it (columns.filled), on a grid without gaps.

    The first and last known value of each bucket are a small table; over it, the last one of earlier buckets and the
    first one of later buckets are carried to each bucket, so a gap may cross any number of borders. df is read twice:
    stage what is dear to compute."""
    rows = df.withColumns({"_row": hour_number(F.col("ts")), "_bucket": bucket_of(F.col("ts"), hours)})
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("row"), F.col(c).alias("value"))) for c in limits}
    ends = rows.groupBy(*keys, "_bucket").agg(*[f(k).alias(f"_{name}_{c}") for c, k in known.items() for f, name in ((F.min, "first"), (F.max, "last"))])
    earlier, later = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_bucket", F.desc("_bucket")))
    carried = ends.select(
        *keys, "_bucket", *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}") for c in limits], *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_after_{c}") for c in limits]
    )
    series = (*keys, "_bucket")
    rising = by_time(series).rowsBetween(Window.unboundedPreceding, 0)
    falling = Window.partitionBy(*series).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c, limit in limits.items():
        before = F.coalesce(F.last(known[c], ignorenulls=True).over(rising), F.col(f"_before_{c}"))
        after = F.coalesce(F.last(known[c], ignorenulls=True).over(falling), F.col(f"_after_{c}"))
        out[f"{c}_clean"] = gap_value(F.col(c), F.col("_row"), before, after, limit)
    helpers = ["_row", "_bucket", *[f"_{side}_{c}" for c in limits for side in ("before", "after")]]
    return beside(rows, carried, list(series)).withColumns(out).drop(*helpers)


def next_complete(df: DataFrame, wanted: dict[str, tuple[str, ...]], keys: Keys = (), hours: int = HOURS) -> DataFrame:
    """df with, for each name, a struct of `ts` and the columns of the next row in time whose columns are all known.

    Within a bucket the running value in falling order; for the last rows the first complete row of later buckets."""
    rows = df.withColumn("_bucket", bucket_of(F.col("ts"), hours))
    whole = {n: F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in cols]), F.struct("ts", *cols)) for n, cols in wanted.items()}
    firsts = rows.groupBy(*keys, "_bucket").agg(*[F.min(w).alias(f"_first_{n}") for n, w in whole.items()])
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*keys, "_bucket", *[F.last(f"_first_{n}", ignorenulls=True).over(later).alias(f"_later_{n}") for n in wanted])
    falling = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.coalesce(F.last(w, ignorenulls=True).over(falling), F.col(f"_later_{n}")) for n, w in whole.items()}
    return beside(rows, carried, [*keys, "_bucket"]).withColumns(out).drop("_bucket", *[f"_later_{n}" for n in wanted])


def sessions(found: DataFrame, max_gap_hours: int = 3, keys: Keys = (), hours: int = HOURS) -> DataFrame:
    """start_utc and end_utc as events.sessions makes them: runs within buckets first; the first and the last run of
    each bucket, two rows a bucket, are then joined across borders, where a run may go on through many buckets."""
    rows = found.select(*keys, "ts").withColumn("_bucket", bucket_of(F.col("ts"), hours))
    order = by_time((*keys, "_bucket"))
    new = F.when(hours_between(F.lag("ts").over(order), F.col("ts")) <= max_gap_hours + 1, 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_bucket", "_run").agg(F.min("ts").alias("start_utc"), F.max("ts").alias("end_utc"))
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(*keys, "_bucket")))
    runs = runs.withColumn("_edge", edge)
    border = Window.partitionBy(*keys).orderBy("start_utc")
    far = F.when(hours_between(F.lag("end_utc").over(border), F.col("start_utc")) <= max_gap_hours + 1, 0).otherwise(1)
    # a bucket's own runs never touch: the last one only ever joins the first one of the next bucket with candidates
    edges = runs.where("_edge").withColumn("_far", far).withColumn("_whole", F.sum("_far").over(border.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edges.groupBy(*keys, "_whole").agg(F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"))
    return runs.where("NOT _edge").select(*keys, "start_utc", "end_utc").unionByName(merged.select(*keys, "start_utc", "end_utc"))


def row_numbers(df: DataFrame, at: str, name: str, keys: Keys = (), hours: int = HOURS) -> DataFrame:
    """df with the number of each row in the order of its time `at`: the rows of earlier buckets, and the place within
    the bucket."""
    rows = df.withColumn("_bucket", bucket_of(F.col(at), hours))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(at))
    return beside(rows, starts, [*keys, "_bucket"]).withColumn(name, (F.col("_start") + place).cast("int")).drop("_bucket", "_start")
