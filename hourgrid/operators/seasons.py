"""Yearly and daily tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import season_year
from hourgrid.operators.buckets import beside
from hourgrid.operators.quantiles import quantile_table


def _yearly(rows: DataFrame, season: str, by: str, extra: list, keys: tuple[str, ...], method: str) -> DataFrame:
    """The mark is the p95 of all the season's hours of the series."""
    inside = rows.where(F.col(f"is_{season}") == 1)
    mark = quantile_table(inside, list(keys), {"p95": ("lmp_clean", 0.95)}, method)
    return beside(inside, mark, list(keys)).groupBy(*keys, by).agg(
        F.count("*").alias("hours"), F.avg("lmp_clean").alias("mean_lmp"), F.median("lmp_clean").alias("median_lmp"), F.percentile("lmp_clean", 0.95).alias("p95_lmp"),
        F.max("lmp_clean").alias("max_lmp"), F.avg("load_mw_clean").alias("mean_load_mw"), F.max("load_mw_clean").alias("max_load_mw"), F.avg("temp_c_clean").alias("mean_temp_c"), *extra,
        F.coalesce(F.sum((F.col("lmp_clean") >= F.col("p95")).cast("int")), F.lit(0)).alias("high_price_hours"),
    )


def winter_yearly(hours: DataFrame, keys: tuple[str, ...] = (), method: str = "percentile") -> DataFrame:
    """Each winter; December counts to the next year's."""
    rows = hours.withColumn("winter_year", season_year(F.col("year_local"), F.col("month_local")))
    extra = [F.min("temp_c_clean").alias("min_temp_c"), F.avg("hdd_clean").alias("mean_hdd"), F.max("hdd_clean").alias("max_hdd"), F.max("wind_speed_ms_clean").alias("max_wind_speed_ms"),
             F.coalesce(F.sum("precip_1h_mm_clean"), F.lit(0.0)).alias("precip_1h_total_mm")]
    return _yearly(rows, "winter", "winter_year", extra, keys, method)


def summer_yearly(hours: DataFrame, keys: tuple[str, ...] = (), method: str = "percentile") -> DataFrame:
    extra = [F.max("temp_c_clean").alias("max_temp_c"), F.avg("cdd_clean").alias("mean_cdd"), F.max("cdd_clean").alias("max_cdd")]
    return _yearly(hours, "summer", "year_local", extra, keys, method)


def summer_hourly_profile(hours: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return hours.where("is_summer = 1").groupBy(*keys, "year_local", "hour_local").agg(
        F.avg("lmp_clean").alias("mean_lmp"), F.percentile("lmp_clean", 0.95).alias("p95_lmp"), F.avg("load_mw_clean").alias("mean_load_mw"),
        F.avg("temp_c_clean").alias("mean_temp_c"), F.avg("cdd_clean").alias("mean_cdd"),
    )


def daily_means(hours: DataFrame, measures: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of UTC days; days without rows are there, with nulls."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    means = hours.groupBy(*keys, day.alias("day")).agg(*[F.avg(m).alias(m) for m in measures])
    ends = hours.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(means, [*keys, "day"], "left")


def rolling_days(days: DataFrame, measures: list[str], n: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over the last n days, with one value at least."""
    frame = Window.partitionBy(*keys).orderBy("day").rowsBetween(-(n - 1), 0)
    return days.withColumns({f"{m}_{n}d": F.avg(m).over(frame) for m in measures})


def daily_forecast_means(errors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    day = F.date_trunc("day", "target_ts").cast("timestamp_ntz")
    return errors.groupBy(*keys, day.alias("day")).agg(F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"))
