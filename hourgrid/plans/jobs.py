"""The jobs end to end: modelling table, forecasts with scores, and event patterns."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.columns import local, season, season_year, split_of
from hourgrid.operators import buckets, clean, dmdc, evaluate, events, features, origins
from hourgrid.operators.buckets import beside
from hourgrid.plans import adapter
from hourgrid.sources.tables import staged

#: Hours between the origins of the registered queries.
STEP = 6
#: name, end of training, first and last hour of the fold's origins.
FOLDS = (("2022q4", "2022-09-30 23:00:00", "2022-10-01 00:00:00", "2022-12-31 23:00:00"), ("2023q1", "2022-12-31 23:00:00", "2023-01-01 00:00:00", "2023-03-31 23:00:00"), ("2023q2", "2023-03-31 23:00:00", "2023-04-01 00:00:00", "2023-06-30 23:00:00"))


def feeds(spark: SparkSession, sf_dir: str) -> list[clean.Feed]:
    return [(adapter.price_feed(spark, sf_dir), adapter.PRICE), (adapter.load_feed(spark, sf_dir), adapter.LOAD), (adapter.weather_feed(spark, sf_dir), adapter.WEATHER)]


#: What events and forecasts need of the clean table.
CORE = ("lmp", "load_mw", "temp_c", "hdd", "cdd", "precip_1h_mm", "wind_speed_ms")
#: Rows that features look back and on.
REACH = {"before": 168, "after": features.HORIZON}


def cleaned(spark: SparkSession, sf_dir: str, measures: tuple[str, ...] = ()) -> DataFrame:
    """The clean table (of some measures only), its gaps filled bucket by bucket. The aligned feeds are staged, as they
    are read twice."""
    chosen = [(df, [m for m in own if not measures or m in measures]) for df, own in feeds(spark, sf_dir)]
    return clean.clean(staged(clean.align(chosen)), bucket_hours=buckets.HOURS)


def featured(table: DataFrame) -> DataFrame:
    """All features of a clean table, by buckets with a halo, so that a single series of any length is many tasks'."""
    return buckets.over_buckets(table, features.features, **REACH)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean hourly table with all features."""
    return featured(cleaned(spark, sf_dir))


def core_hours(spark: SparkSession, sf_dir: str, measures: tuple[str, ...] = CORE) -> DataFrame:
    """The clean table of what forecasts and yearly tables need, staged: where each branch of a job begins."""
    table = cleaned(spark, sf_dir, measures)
    return staged(table.select("ts", "lmp_observed", *[f"{m}{end}" for m in measures for end in ("_clean", "_missing")]))


def with_changes(hours: DataFrame) -> DataFrame:
    """Narrow hours with the calendar and the changes over a day: what events need."""
    return features.without_infinities(features.add_calendar(buckets.over_buckets(hours, lambda df, keys: features.add_changes(df, features.STATES, keys), 24, 0)))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_changes(core_hours(spark, sf_dir))


def staged_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly, with all measures staged."""
    return featured(staged(cleaned(spark, sf_dir)))


def state_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What state-space models need: their states, the prices, and the calendar, staged."""
    return staged(with_changes(core_hours(spark, sf_dir, (*CORE, "congestion", "marginal_loss"))))


def supervised_of(hours: DataFrame) -> DataFrame:
    return features.supervised(hours, adapter.TRAIN_END, adapter.VALIDATION_END)


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised_of(hourly(spark, sf_dir))


def choosable(hours: DataFrame) -> DataFrame:
    """The hours of the supervised table, with their split, without its columns; times only, staged."""
    open_hours = buckets.over_buckets(hours, lambda df, keys: origins.choosable(df, keys=keys), **REACH).select("ts")
    return staged(open_hours.withColumn("split", split_of(F.col("ts"), adapter.TRAIN_END, adapter.VALIDATION_END)))


def chosen_origins(hours: DataFrame, step: int = STEP) -> DataFrame:
    """(ts, split) of the sampled origins of validation and test, from narrow hours."""
    return origins.sample_origins(choosable(hours).where(F.col("split").isin("validation", "test")), step)


def predictions_of(hours: DataFrame, step: int = STEP) -> DataFrame:
    """Origins of validation and test with the two naive forecasts."""
    return origins.fan_out(chosen_origins(hours, step), hours)


def predictions(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    return predictions_of(core_hours(spark, sf_dir), step)


def fold_origins(hours: DataFrame, step: int = STEP) -> DataFrame:
    """(ts, split, fold, cv_train_end): each fold's sampled origins; splits are the folds' names."""
    rows, parts = choosable(hours), []
    for name, train_end, first, last in FOLDS:
        start, end, trained = (F.lit(x).cast("timestamp_ntz") for x in (first, last, train_end))
        inside = rows.where(F.col("ts").between(start, end)).withColumns({"split": F.lit(name), "fold": F.lit(name), "cv_train_end": trained})
        parts.append(origins.sample_origins(inside, step))
    return reduce(DataFrame.unionByName, parts)


def with_models(table: DataFrame, chosen: DataFrame, hours: DataFrame, fitted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """table (fanned-out origins) with the state-space forecasts; the residual model is added to the daily naive one."""
    states = hours.select("ts", *dict.fromkeys(s for m in dmdc.MODELS.values() for s in m))
    found = dmdc.forecast(fitted, chosen.select(*by, "ts").join(states, "ts", "left"), dmdc.MODELS, by=by)
    rows = beside(table, found, [*by, "origin_ts", "horizon"], "left")
    return rows.withColumn("dmdc_residual_24h", F.col("seasonal_naive_24h") + F.col("dmdc_residual_24h"))


def forecast_table(hours: DataFrame, step: int = STEP) -> DataFrame:
    """Origins of validation and test with all four forecasts, from state_hours; fitted on the training hours."""
    fitted = staged(dmdc.fit(hours, dmdc.MODELS, {"train": adapter.TRAIN_END}))
    chosen = chosen_origins(hours, step)
    return with_models(origins.fan_out(chosen, hours), chosen, hours, fitted, ())


def fold_predictions(spark: SparkSession, sf_dir: str, models: bool = False, step: int = STEP) -> DataFrame:
    """Expanding folds one after the other, with fold and cv_train_end. With models, one pass over the hours gives the
    sums of all folds' fits."""
    hours = state_hours(spark, sf_dir) if models else core_hours(spark, sf_dir)
    chosen = fold_origins(hours, step)
    table = origins.fan_out(chosen, hours, keep=("fold", "cv_train_end"))
    if not models:
        return table
    fitted = staged(dmdc.fit(hours, dmdc.MODELS, {name: train_end for name, train_end, *_ in FOLDS}))
    return with_models(table, chosen, hours, fitted, ("fold",))


def with_seasons(long: DataFrame) -> DataFrame:
    at = local(F.col("target_ts"))
    return long.withColumns({"season": season(F.month(at)), "season_year": season_year(F.year(at), F.month(at))}).where("season <> 'other'")


def all_events(hours: DataFrame, min_hours: dict[str, int]) -> dict[str, DataFrame]:
    return {kind: events.detect(hours, kind, min_hours[kind], bucket_hours=buckets.HOURS) for kind in events.EVENT_KINDS}


def train_threshold(hours: DataFrame, method: str = "percentile") -> DataFrame:
    return evaluate.price_threshold(hours.where(F.col("ts") <= F.lit(adapter.TRAIN_END).cast("timestamp_ntz")), method=method)
