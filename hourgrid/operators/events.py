"""Weather and price events: candidate hours, sessions, statistics, contexts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import by_time, hours_between, local, plus_hours
from hourgrid.operators import buckets
from hourgrid.operators.quantiles import quantile_table

# Predicates of the four kinds of event, in terms of season quantiles (season, column, q).
QUANTILES = {
    "winter_storm": {"wind_p85": ("winter", "wind_speed_ms_clean", 0.85), "lmp_p95": ("winter", "lmp_clean", 0.95)},
    "summer_sudden_heat": {"temp_p90": ("summer", "temp_c_change_24h", 0.9), "cdd_p90": ("summer", "cdd_change_24h", 0.9), "load_p80": ("summer", "load_mw_change_24h", 0.8)},
    "winter_cold_wave": {"temp_p10": ("winter", "temp_c_change_24h", 0.1), "hdd_p90": ("winter", "hdd_change_24h", 0.9), "load_p75": ("winter", "load_mw_change_24h", 0.75)},
    "summer_heat_price_event": {"lmp_p90": ("summer", "lmp_clean", 0.9), "cdd_p90": ("summer", "cdd_clean", 0.9), "load_p90": ("summer", "load_mw_clean", 0.9)},
}
PREDICATES = {
    "winter_storm": "is_winter = 1 AND ((hdd_clean >= 18.3 AND (precip_1h_mm_clean >= 0.25 OR wind_speed_ms_clean >= wind_p85)) OR (lmp_clean >= lmp_p95 AND hdd_clean >= 12.0))",
    "summer_sudden_heat": "is_summer = 1 AND temp_c_change_24h >= greatest(5.0, temp_p90) AND (cdd_change_24h >= greatest(2.0, cdd_p90) OR load_mw_change_24h >= load_p80)",
    "winter_cold_wave": "is_winter = 1 AND temp_c_change_24h <= least(-5.0, temp_p10) AND (hdd_change_24h >= greatest(4.0, hdd_p90) OR load_mw_change_24h >= load_p75)",
    "summer_heat_price_event": "is_summer = 1 AND (cdd_clean >= cdd_p90 OR load_mw_clean >= load_p90) AND lmp_clean >= lmp_p90",
}
#: Contexts, weakest first; a stronger one covers a weaker one.
CONTEXTS = ("other", "summer_all", "winter_all", "winter_storm", "winter_cold_wave", "summer_sudden_heat", "summer_heat_price_event")
EVENT_KINDS = CONTEXTS[3:]
PHASE_HOURS = 72


def season_quantiles(hours: DataFrame, wanted: dict[str, tuple[str, str, float]], keys: tuple[str, ...] = (), method: str = "percentile") -> DataFrame:
    """Quantiles of one season each, one row (for each series); method: see quantiles.quantile_table."""
    return quantile_table(hours, list(keys), {name: (F.when(F.col(f"is_{season}") == 1, F.col(c)), q) for name, (season, c, q) in wanted.items()}, method)


def candidates(hours: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The hours that fulfil a kind's predicate; a missing value does not."""
    marks = season_quantiles(hours, QUANTILES[kind], keys)
    return buckets.beside(hours, marks, list(keys)).where(F.expr(PREDICATES[kind])).select(*hours.columns)


def sessions(found: DataFrame, max_gap_hours: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """start and end of runs of candidate hours; hours up to max_gap_hours + 1 apart belong together."""
    order = by_time(keys)
    gap = hours_between(F.lag("ts").over(order), F.col("ts"))
    rows = found.withColumn("new", F.when(gap <= max_gap_hours + 1, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "session").agg(F.min("ts").alias("start_utc"), F.max("ts").alias("end_utc")).drop("session")


def numbered(runs: DataFrame, prefix: str, min_event_hours: int = 6, keys: tuple[str, ...] = (), bucket_hours: int | None = None) -> DataFrame:
    """Runs that span min_event_hours or more, numbered in time order; by buckets for series too long for one task."""
    rows = runs.withColumn("duration_hours", (hours_between(F.col("start_utc"), F.col("end_utc")) + 1).cast("int")).where(F.col("duration_hours") >= min_event_hours)
    if bucket_hours:
        rows = buckets.row_numbers(rows, "start_utc", "_number", keys, bucket_hours)
    else:
        rows = rows.withColumn("_number", F.row_number().over(Window.partitionBy(*keys).orderBy("start_utc")))
    return rows.withColumn("event_id", F.format_string("%s_%03d", F.lit(prefix), F.col("_number"))).drop("_number")


def detect(hours: DataFrame, kind: str, min_event_hours: int = 6, max_gap_hours: int = 3, keys: tuple[str, ...] = (), bucket_hours: int | None = None) -> DataFrame:
    found = candidates(hours, kind, keys)
    runs = buckets.sessions(found, max_gap_hours, keys, bucket_hours) if bucket_hours else sessions(found, max_gap_hours, keys)
    return numbered(runs, kind, min_event_hours, keys, bucket_hours)


def with_premium(hours: DataFrame, keys: tuple[str, ...] = (), method: str = "percentile") -> DataFrame:
    """normal_lmp, the median of the month and hour (local), and the premium over it."""
    at = [*keys, "month_local", "hour_local"]
    normal = quantile_table(hours, at, {"normal_lmp": ("lmp_clean", 0.5)}, method)
    return buckets.beside(hours, normal, at).withColumn("premium", F.col("lmp_clean") - F.col("normal_lmp"))


def event_hours(hours: DataFrame, spans: DataFrame, start: str = "start_utc", end: str = "end_utc", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every grid hour within the spans, candidate or not: spans are unfolded to hours and joined by equality."""
    unfolded = spans.withColumn("ts", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))))
    return unfolded.join(hours, [*keys, "ts"])


def peak_time() -> Column:
    """The hour of the highest price, the first on a tie; null prices are passed over."""
    return F.min_by("ts", F.when(F.col("lmp_clean").isNotNull(), F.struct(-F.col("lmp_clean"), F.col("ts"))))


def event_summary(hours: DataFrame, events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = event_hours(with_premium(hours, keys), events, keys=keys)
    out = rows.groupBy(*keys, "event_id", "start_utc", "end_utc", "duration_hours").agg(
        F.avg("lmp_clean").alias("mean_lmp"), F.max("lmp_clean").alias("max_lmp"), peak_time().alias("peak_utc"), F.avg("premium").alias("mean_premium"), F.max("premium").alias("max_premium"),
        F.avg("load_mw_clean").alias("mean_load_mw"), F.max("load_mw_clean").alias("max_load_mw"), F.avg("temp_c_clean").alias("mean_temp_c"), F.min("temp_c_clean").alias("min_temp_c"),
        F.max("temp_c_clean").alias("max_temp_c"), F.coalesce(F.sum("precip_1h_mm_clean"), F.lit(0.0)).alias("sum_precip_1h_mm"), F.max("wind_speed_ms_clean").alias("max_wind_speed_ms"),
        F.avg("hdd_clean").alias("mean_hdd"), F.avg("cdd_clean").alias("mean_cdd"),
    )
    return out.withColumns({f"{c}_local": local(F.col(f"{c}_utc")) for c in ("start", "end", "peak")})


def phases(events: DataFrame) -> DataFrame:
    """Before (72 hours), the event, and after (72 hours)."""
    start, end, one = F.col("start_utc"), F.col("end_utc"), F.lit(1)
    row = lambda name, a, b: F.struct(F.lit(name).alias("phase"), a.alias("phase_start"), b.alias("phase_end"))
    parts = F.array(
        row("pre_72h", plus_hours(start, F.lit(-PHASE_HOURS)), plus_hours(start, -one)), row("event", start, end), row("post_72h", plus_hours(end, one), plus_hours(end, F.lit(PHASE_HOURS)))
    )
    return events.withColumn("p", F.explode(parts)).select("*", "p.*").drop("p")


def phase_stats(hours: DataFrame, events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of each phase of each event; a phase without hours gives no row."""
    rows = event_hours(hours, phases(events).select(*keys, "event_id", "phase", "phase_start", "phase_end"), "phase_start", "phase_end", keys)
    return rows.groupBy(*keys, "event_id", "phase", "phase_start", "phase_end").agg(
        F.count("*").alias("hours"), F.avg("lmp_clean").alias("mean_lmp"), F.median("lmp_clean").alias("median_lmp"), F.max("lmp_clean").alias("max_lmp"), F.avg("load_mw_clean").alias("mean_load_mw"),
        F.max("load_mw_clean").alias("max_load_mw"), F.avg("temp_c_clean").alias("mean_temp_c"), F.min("temp_c_clean").alias("min_temp_c"), F.avg("hdd_clean").alias("mean_hdd"),
        F.max("hdd_clean").alias("max_hdd"), F.max("wind_speed_ms_clean").alias("max_wind_speed_ms"), F.coalesce(F.sum("precip_1h_mm_clean"), F.lit(0.0)).alias("precip_1h_total_mm"),
    )


def event_uplift(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """stats with the event's mean price less that of the hours before, on each phase; null without a phase before."""
    of = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("mean_lmp")))
    uplift = stats.groupBy(*keys, "event_id").agg((of("event") - of("pre_72h")).alias("event_uplift"))
    return stats.join(uplift, [*keys, "event_id"])


def major_events(summary: DataFrame, q: float = 0.9, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events whose highest price is at the quantile of all events' highest prices (of the series), or above."""
    mark = summary.groupBy(*keys).agg(F.percentile("max_lmp", q).alias("mark"))
    return buckets.beside(summary, mark, list(keys)).where("max_lmp >= mark").drop("mark")


def context_hours(hours: DataFrame, events: dict[str, DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """(ts, rank): the strongest event kind of each hour in any event. The kinds are one union, so labelling needs
    one join."""
    parts = [event_hours(hours.select(*keys, "ts"), e, keys=keys).select(*keys, "ts", F.lit(CONTEXTS.index(kind)).alias("rank")) for kind, e in events.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "ts").agg(F.max("rank").alias("rank"))


def label_context(predictions: DataFrame, ranked: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """predictions with the context of the target hour; months are local."""
    rows = predictions.join(ranked.withColumnRenamed("ts", "target_ts"), [*keys, "target_ts"], "left")
    month = F.month(local(F.col("target_ts")))
    base = F.when(month.isin(12, 1, 2, 3), 2).when(month.isin(6, 7, 8), 1).otherwise(0)
    return rows.withColumn("context", F.element_at(F.array(*[F.lit(c) for c in CONTEXTS]), F.coalesce("rank", base) + 1)).drop("rank")
