"""Quantiles of many groups at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.operators.buckets import beside
from hourgrid.sources.tables import staged

#: name -> (value, quantile); the value is a column or a name, and null values do not count.
Wanted = dict[str, tuple[Column | str, float]]
METHODS = ("percentile", "ranges", "approx")


def quantile_table(rows: DataFrame, by: list[str], wanted: Wanted, method: str = "percentile", accuracy: int = 10_000) -> DataFrame:
    """The wanted quantiles, a row for each group of `by` (one row without `by`), null for a group without values.

    percentile: exact, by interpolation. A group's different values are a map in one task: for groups like the hours of
    one series. ranges: the same results for groups of any size and number, see selected. approx: a value near the
    quantile, off by 1 / accuracy of the group's rows at most; not equal to the reference, so it has to be asked for."""
    if method == "ranges":
        return selected(rows, by, wanted)
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    one = (lambda c, q: F.percentile(c, q)) if method == "percentile" else (lambda c, q: F.percentile_approx(c, q, accuracy))
    return rows.groupBy(*by).agg(*[one(c, q).alias(name) for name, (c, q) in wanted.items()])


def in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows in ranges of `order`, with the range's number: the n-th range stands before the next one as a whole, so
    work along the order is done range by range, and a group of any size is many tasks'."""
    return staged(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def selected(rows: DataFrame, by: list[str], wanted: Wanted) -> DataFrame:
    """Exact quantiles by selection. Equal values of a group are one row with their number, which is added up before
    the shuffle, so a hot value is no matter. Values are dealt to ranges; from the ranges' counts follows in which one
    and at which place a wanted rank stands, and only ranges with such ranks are looked into. Groups and ranks stay in
    tables: nothing goes to the driver, whatever the number of groups."""
    names = list(wanted)
    columns = list(dict.fromkeys(str(c) for c, _ in wanted.values()))
    values = {str(c): (F.col(c) if isinstance(c, str) else c).cast("double") for c, _ in wanted.values()}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), values[c].alias("value")) for i, c in enumerate(columns)])).alias("x")
    long = rows.select(*by, each).select(*by, "x.of", "x.value").where("value IS NOT NULL")
    ranges = in_ranges(long.groupBy(*by, "of", "value").agg(F.count("*").alias("n")), *by, "of", "value")
    order, whole = Window.partitionBy(*by, "of").orderBy("range"), Window.partitionBy(*by, "of")
    totals = ranges.groupBy(*by, "of", "range").agg(F.sum("n").alias("inside"))
    placed = totals.withColumns({"start": F.sum("inside").over(order) - F.col("inside"), "total": F.sum("inside").over(whole)})
    asked = F.array(*[F.struct(F.lit(i).alias("name"), F.lit(columns.index(str(c))).alias("of"), F.lit(float(q)).alias("q")) for i, (c, q) in enumerate(wanted.values())])
    ranks = placed.select("*", F.explode(F.filter(asked, lambda a: a["of"] == F.col("of"))).alias("a")).withColumn("place", F.col("a.q") * (F.col("total") - 1))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).where("rank >= start AND rank < start + inside")
    key = [*by, "of", "range"]
    ranks = staged(ranks.select(*key, F.col("a.name").alias("name"), "place", (F.col("rank") - F.col("start")).alias("rank")))
    inside = beside(ranges, ranks.select(*key).distinct(), key)
    running = F.sum("n").over(Window.partitionBy(*key).orderBy("value"))
    found = beside(inside.withColumn("_to", running), ranks, key).where("rank < _to AND rank >= _to - n")
    low, high = F.min("value"), F.max("value")
    share = F.col("place") - F.floor("place")
    middle = found.groupBy(*by, "name", "place").agg(low.alias("low"), high.alias("high")).withColumn("value", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high")))
    out = middle.groupBy(*by).agg(*[F.max(F.when(F.col("name") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
    return beside(rows.select(*by).distinct(), out, by, "left").select(*by, *names) if by else out
