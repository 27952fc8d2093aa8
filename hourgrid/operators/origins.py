"""Forecast origins, their target hours, and forecasts that repeat the past."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import by_time, calendar, cyclic, finite, hours_between, local, plus_hours
from hourgrid.operators.buckets import beside
from hourgrid.operators.features import HORIZON, LAGS, REQUIRED, ROLLS


def sample_origins(df: DataFrame, step: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose whole hours since the earliest row of the set (and series) are a multiple of step."""
    if step <= 1:
        return df
    first = df.groupBy(*keys).agg(F.min("ts").alias("_first"))
    return beside(df, first, list(keys)).where(hours_between(F.col("_first"), F.col("ts")) % step == 0).drop("_first")


def hours_ahead(df: DataFrame, horizon: int = HORIZON, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each hour with the number of grid hours that follow within the horizon."""
    return df.withColumn("hours_ahead", F.count(F.lit(1)).over(by_time(keys).rowsBetween(1, horizon)))


def complete_horizon(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return df.where(F.col("hours_ahead") == horizon)


def choosable(hours: DataFrame, horizon: int = HORIZON, keys: tuple[str, ...] = ()) -> DataFrame:
    """The hours that features.supervised keeps, by counts instead of columns: all prices of the horizon observed, and
    the required features there. Of lags and leads only those that decide are made."""
    order = by_time(keys)
    seen = F.when(finite(F.col("lmp_observed")).isNotNull() & (F.col("lmp_missing") == 0), 1)
    mean, rows, least, f = next(r for n, r in ROLLS.items() if n == REQUIRED[-1])
    frame = order.rowsBetween(-rows, -1)
    past = [finite(F.lag(f"{m}_clean", 168).over(order)).isNotNull() for m in LAGS]
    past.append((F.count(f"{mean}_clean").over(frame) >= least) & finite(f(f"{mean}_clean").over(frame)).isNotNull())
    ahead = F.count(seen).over(order.rowsBetween(1, horizon)) == horizon
    return hours.withColumn("_open", reduce(Column.__and__, past, ahead)).where("_open").drop("_open")


def fan_out(origins: DataFrame, hours: DataFrame, horizon: int = HORIZON, keep: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each origin and horizon: target hour, observed price, and the prices a day and a week before the
    target as forecasts; null where an hour is not on the grid.

    Only the chosen origins unfold, to the three hours of each horizon; one join by (key, hour) with the narrow hours
    fetches all of them, and one aggregation puts them side by side."""
    refs = F.array(*[F.struct(F.lit(name).alias("name"), plus_hours(F.col("target_ts"), F.lit(-back)).alias("ts")) for name, back in (("y", 0), ("day", 24), ("week", 168))])
    rows = origins.select(*keys, F.col("ts").alias("origin_ts"), "split", *keep, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"))
    rows = rows.withColumn("target_ts", plus_hours(F.col("origin_ts"), F.col("horizon"))).withColumn("r", F.explode(refs))
    rows = rows.withColumns({"name": F.col("r.name"), "ts": F.col("r.ts")}).drop("r")
    met = beside(rows, hours.select(*keys, "ts", "lmp_observed", "lmp_clean"), [*keys, "ts"], "left")
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    rest = [F.first(c).alias(c) for c in ("target_ts", "split", *keep)]
    found = met.groupBy(*keys, "origin_ts", "horizon").agg(*rest, of("y", "lmp_observed").alias("y_true"), of("day", "lmp_clean").alias("seasonal_naive_24h"), of("week", "lmp_clean").alias("seasonal_naive_168h"))
    return found.select(*keys, "origin_ts", "target_ts", "split", *keep, "horizon", "y_true", "seasonal_naive_24h", "seasonal_naive_168h")


def controls_at(ts: Column) -> dict[str, Column]:
    """The nine calendar controls: a function of the hour alone."""
    fields = calendar(local(ts))
    controls = cyclic(fields["hour_local"], fields["weekday_local"], fields["month_local"])
    return {**controls, **{k: fields[k] for k in ("is_weekend", "is_summer", "is_winter")}}


def future_controls(rows: DataFrame) -> DataFrame:
    """The controls of every target hour."""
    return rows.withColumns(controls_at(F.col("target_ts")))


def attach_external(predictions: DataFrame, external: DataFrame | None, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Another model's forecasts beside the others; none: a null column."""
    if external is None:
        return predictions.withColumn(name, F.lit(None).cast("double"))
    return predictions.join(external.select(*keys, "origin_ts", "target_ts", "horizon", name), [*keys, "origin_ts", "target_ts", "horizon"], "left")


def first_origins(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("ts").limit(n)
