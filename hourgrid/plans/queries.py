"""The registered queries over the given tables and their SQL twins.

A query is a Spark table, the SQL of the same table, and the columns both present: `name:d` is a double shown with
6 digits (moved by a fixed sliver, so that decimal ties fall on neither side of the last digit by chance), `name:m` one
with 3 digits, for what two solvers of the same equations agree on (`name:t` and `name:w` with 1 and none, where the
training hours hardly tell the equations apart), `name:i` a whole number, and a bare name is shown
as it is."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.columns import model_label, model_rank, season, season_year
from hourgrid.operators import buckets, clean, dmdc, evaluate, events, features, origins, seasons
from hourgrid.plans import adapter, jobs, sql
from hourgrid.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NAIVE = list(sql.MODELS)
MIN_HOURS = sql.MIN_HOURS


def _column(spec: str, engine: str) -> str:
    name, _, kind = spec.partition(":")
    if kind == "d":
        return f"round({name} + 3.3e-8{'D' if engine == 'spark' else ''}, 6) AS {name}"
    if kind in ("m", "t", "w"):
        return f"round({name}, {'wt.m'.index(kind)}) + 0 AS {name}"  # + 0: no negative zero
    return f"CAST({name} AS BIGINT) AS {name}" if kind == "i" else name


def query(name: str, columns: str, twin: str = "", source: str = "") -> Callable:
    """Registers a function; twin ends in common table expressions, of which `source` is shown."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        specs = columns.split()
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).selectExpr(*[_column(c, "spark") for c in specs])
        if twin:
            SQL[name] = f"{twin}\nSELECT {', '.join(_column(c, 'duckdb') for c in specs)} FROM {source}"
        return f

    return add


def _doubles(names: list[str]) -> str:
    return " ".join(f"{n}:d" for n in names)


def _ints(names: list[str]) -> str:
    return " ".join(f"{n}:i" for n in names)


H, S, P = sql.HOURLY, sql.SUPERVISED, sql.predictions_sql()
E = f"{H},\n{sql.events_sql()}"
METRICS = "n:i mae:d mse:d rmse:d r2:d bias:d"
MEASURES = sql.MEASURES


def _events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# --- sources and sinks


@query("coerce_numeric", "event_id value:d props:d", "WITH t AS (SELECT event_id, try_cast(value AS DOUBLE) AS value, try_cast(event_type AS DOUBLE) AS props FROM events)", "t")
def _(spark, d):
    rows = _events_raw(spark, d).withColumn("props", F.col("event_type"))
    return tables.coerce_numeric(rows, ["value", "props", "absent"])


@query("read_hourly_csv", "ts lmp:d", f"WITH {adapter.FEEDS_SQL}", "price")
def _(spark, d):
    path = tables.scratch(spark)
    feed = adapter.price_feed(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime_beginning_utc"), "lmp")
    feed.write.option("header", True).csv(path)
    return tables.read_hourly_csv(spark, path, "datetime_beginning_utc", ["lmp"])


@query("read_parquet_tables", "ts load_mw:d", f"WITH {adapter.FEEDS_SQL}", "load")
def _(spark, d):
    path = tables.scratch(spark)
    adapter.load_feed(spark, d).write.parquet(path)
    return tables.read_table(spark, path)


@query("write_dataset", "form part ts lmp_clean:d lmp_clean_lag_168h:d target_lmp_h24:d", f"""{S}, parts AS (SELECT 'hourly' AS part, ts, lmp_clean, lmp_clean_lag_168h, target_lmp_h24 FROM hourly UNION ALL SELECT split, ts, lmp_clean, lmp_clean_lag_168h, target_lmp_h24 FROM supervised),
  t AS (SELECT unnest(['parquet', 'csv']) AS form, parts.* FROM parts)""", "t")
def _(spark, d):
    path, hours = tables.scratch(spark), jobs.staged_hours(spark, d)
    tables.write_dataset(hours, jobs.supervised_of(hours), path)
    fields, parts = "ts timestamp_ntz, lmp_clean double, lmp_clean_lag_168h double, target_lmp_h24 double", []
    for form in ("parquet", "csv"):
        parts.append(tables.read_dataset(spark, path, "hourly", form, fields).select(F.lit(form).alias("form"), F.lit("hourly").alias("part"), "*"))
        parts.append(tables.read_dataset(spark, path, "supervised", form, f"{fields}, split string").withColumnRenamed("split", "part").withColumn("form", F.lit(form)))
    return reduce(DataFrame.unionByName, parts)


@query("write_reports", f"model split {METRICS}", f"{P}, t AS ({sql.metrics(['split'])})", "t")
def _(spark, d):
    path = tables.scratch(spark)
    report = evaluate.regression_metrics(evaluate.models_long(jobs.predictions(spark, d), NAIVE), ["split"])
    tables.write_report(report, path)
    return spark.read.option("header", True).schema(report.schema).csv(path)


@query("read_report_lenient", "origin_ts horizon:i", f"{P}, t AS (SELECT CASE WHEN horizon > 12 THEN origin_ts END AS origin_ts, horizon FROM predictions)", "t")
def _(spark, d):
    path = tables.scratch(spark)
    rows = jobs.predictions(spark, d)
    text = F.when(F.col("horizon") > 12, F.date_format("origin_ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time")
    tables.write_report(rows.select(text.alias("origin_ts"), "horizon"), path)
    missing = tables.read_report(spark, path + "-absent", "origin_ts timestamp_ntz, horizon string")
    return tables.read_report(spark, path, "").unionByName(missing)


# --- cleaning and projections


@query("dedup_mean", "ts lmp:d congestion:d marginal_loss:d", H, "price_h")
def _(spark, d):
    return clean.dedup_mean(adapter.price_feed(spark, d), adapter.PRICE)


@query("dedup_mean_by_key", "event_type ts value:d", "WITH t AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)", "t")
def _(spark, d):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return clean.dedup_mean(_events_raw(spark, d).withColumn("ts", hour), ["value"], ("event_type",))


@query("hourly_spine", "ts", H, "spine")
def _(spark, d):
    return clean.hourly_spine(jobs.feeds(spark, d))


@query("join_sources", f"ts {_doubles(MEASURES)}", H, "joined")
def _(spark, d):
    feeds = jobs.feeds(spark, d)
    return clean.join_sources(clean.hourly_spine(feeds), feeds)


_cleaned = jobs.cleaned


query("missing_flag", f"ts {_ints([m + '_missing' for m in MEASURES])}", H, "clean")(_cleaned)
query("fill_zero", "ts precip_1h_mm_clean:d precip_6h_mm_clean:d", H, "clean")(_cleaned)
query("fill_from_column", "ts heat_index_c_clean:d wind_chill_c_clean:d", H, "clean")(_cleaned)
query("keep_observed", "ts lmp_observed:d lmp_clean:d", H, "clean")(_cleaned)


@query("fill_gaps", "ts load_mw_clean:d slp_hpa_clean:d", f"{H}, t AS (SELECT ts, {sql.fill_value('load_mw', 1)} AS load_mw_clean, {sql.fill_value('slp_hpa', 2)} AS slp_hpa_clean FROM edges)", "t")
def _(spark, d):
    return buckets.fill_gaps(tables.staged(clean.align(jobs.feeds(spark, d))), {"load_mw": 1, "slp_hpa": 2}, hours=500)


@query("inf_to_null", "event_id ratio:d", "WITH t AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value / (event_id % 10) END AS ratio FROM events)", "t")
def _(spark, d):
    divisor = F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 10)
    ratio = F.coalesce(F.col("value") / divisor, F.lit(float("inf")))
    return features.without_infinities(_events_raw(spark, d).withColumn("ratio", ratio))


CALENDAR = ["year_local", "month_local", "day_local", "hour_local", "weekday_local", "is_weekend", "is_summer", "is_winter"]


def _with(work: Callable[[DataFrame, tuple[str, ...]], DataFrame], before: int, after: int, measures: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    """One kind of features over the clean table of some measures, by buckets with as much halo as it needs."""
    return lambda spark, d: features.without_infinities(buckets.over_buckets(_cleaned(spark, d, measures), work, before, after))


_calendar = lambda spark, d: features.add_calendar(_cleaned(spark, d))
query("calendar_features", f"ts ts_local {_ints(CALENDAR)}", H, "cal")(_calendar)
query("cyclic_features", f"ts {_doubles(['sin_hour', 'cos_hour', 'sin_dow', 'cos_dow', 'sin_month', 'cos_month'])}", H, "cal")(_calendar)
LAG_NAMES = [f"{m}_clean_lag_{n}h" for m, ns in features.LAGS.items() for n in ns]
query("lag_features", f"ts {_doubles(LAG_NAMES)}", H, "hourly")(_with(features.add_lags, 168, 0, features.STATES))
query("rolling_features", f"ts {_doubles(list(features.ROLLS))}", H, "hourly")(_with(features.add_rolling, 168, 0, features.STATES))
query("lead_targets", f"ts {_doubles(features.targets())} {_ints([t + '_is_missing' for t in features.targets()])}", H, "hourly")(_with(lambda df, keys: features.add_targets(df, keys=keys), 0, features.HORIZON, ("lmp",)))
query("change_24h", f"ts {_doubles([m + '_change_24h' for m in ('temp_c', 'hdd', 'cdd', 'load_mw')])}", H, "hourly")(_with(lambda df, keys: features.add_changes(df, keys=keys), 24, 0, features.STATES))
query("seasonal_residuals", f"ts split {_doubles([m + '_change_24h' for m in features.STATES])}", S, "supervised")(jobs.supervised)
query("chrono_split", "ts split", f"{H}, t AS (SELECT ts, {sql.SPLIT} AS split FROM hourly)", "t")(
    lambda spark, d: _cleaned(spark, d).withColumn("split", features.split_of(F.col("ts"), adapter.TRAIN_END, adapter.VALIDATION_END))
)
query("supervised_filter", "ts split lmp_clean:d target_lmp_h01:d target_lmp_h24:d lmp_clean_lag_168h:d", S, "supervised")(jobs.supervised)


@query("season_labels", "ts season season_year:i", f"{H}, t AS (SELECT ts, CASE WHEN is_summer = 1 THEN 'summer' WHEN is_winter = 1 THEN 'winter' ELSE 'other' END AS season, year_local + CASE WHEN month_local = 12 THEN 1 ELSE 0 END AS season_year FROM cal)", "t")
def _(spark, d):
    return _calendar(spark, d).withColumns({"season": season(F.col("month_local")), "season_year": season_year(F.col("year_local"), F.col("month_local"))})


def _long(spark, d):
    return evaluate.models_long(jobs.predictions(spark, d), NAIVE)


def _errors(spark, d):
    return evaluate.forecast_errors(jobs.predictions(spark, d), NAIVE[0])


def _scored(spark, d):
    hours = jobs.core_hours(spark, d)
    return evaluate.labelled(evaluate.models_long(jobs.predictions_of(hours), NAIVE), jobs.train_threshold(hours))


KEYS = "origin_ts target_ts split horizon:i"
query("high_price_label", f"{KEYS} model high:i", f"{P}, t AS (SELECT long.*, (y_true >= threshold)::INTEGER AS high FROM long, threshold)", "t")(_scored)
query("forecast_errors", f"{KEYS} actual:d predicted:d error:d abs_error:d", P, "errors")(_errors)
query("models_long", f"{KEYS} model pred:d y_true:d", P, "long")(_long)


@query("model_labels", "model label priority:i", """WITH t AS (SELECT DISTINCT model, CASE model WHEN 'seasonal_naive_24h' THEN 'Seasonal naive 24h' WHEN 'seasonal_naive_168h' THEN 'Seasonal naive 168h' ELSE upper(model[1]) || lower(model[2:]) END AS label,
  CASE model WHEN 'seasonal_naive_24h' THEN 1 WHEN 'seasonal_naive_168h' THEN 3 ELSE 5 END AS priority FROM (SELECT CASE event_type WHEN 'click' THEN 'seasonal_naive_24h' WHEN 'error' THEN 'seasonal_naive_168h' ELSE event_type END AS model FROM events))""", "t")
def _(spark, d):
    model = F.when(F.col("event_type") == "click", NAIVE[0]).when(F.col("event_type") == "error", NAIVE[1]).otherwise(F.col("event_type"))
    return _events_raw(spark, d).select(model.alias("model")).distinct().withColumns({"label": model_label(F.col("model")), "priority": model_rank(F.col("model"))})


# --- filters


@query("time_slice", "ts lmp_clean:d", f"{H}, t AS (SELECT * FROM clean WHERE ts BETWEEN TIMESTAMP '2022-10-01' AND TIMESTAMP '2022-12-31 23:00:00')", "t")
def _(spark, d):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2022-10-01 00:00:00", "2022-12-31 23:00:00"))
    return _cleaned(spark, d).where(F.col("ts").between(a, b))


query("split_filter", "ts split", f"{S}, t AS (SELECT * FROM supervised WHERE split IN ('validation', 'test'))", "t")(lambda spark, d: jobs.supervised(spark, d).where(F.col("split").isin("validation", "test")))
query("sample_origins", "ts split", P, "origins")(lambda spark, d: jobs.chosen_origins(jobs.core_hours(spark, d)))


@query("complete_horizon_filter", "ts hours_ahead:i", f"{H}, t AS (SELECT ts, count(*) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS hours_ahead FROM hourly QUALIFY hours_ahead = 24)", "t")
def _(spark, d):
    ahead = buckets.over_buckets(_cleaned(spark, d), lambda df, keys: origins.hours_ahead(df, keys=keys), 0, features.HORIZON)
    return origins.complete_horizon(ahead)


for _name, _kind in (("winter_storm_candidates", "winter_storm"), ("sudden_heat_candidates", "summer_sudden_heat"), ("cold_wave_candidates", "winter_cold_wave"), ("heat_price_candidates", "summer_heat_price_event")):
    query(_name, "ts lmp_clean:d", E, f"c_{_kind}")(lambda spark, d, kind=_kind: events.candidates(jobs.event_table(spark, d), kind))

_view = "split = 'test' AND horizon = 6 AND target_ts >= TIMESTAMP '2023-04-01' AND target_ts < TIMESTAMP '2023-05-16'"
SAFE = "avg(abs_error) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias, max(abs_error) AS max_abs_error"


@query("explore_forecasts", "mae:d rmse:d bias:d max_abs_error:d", f"{P}, t AS (SELECT {SAFE} FROM errors WHERE {_view})", "t")
def _(spark, d):
    return evaluate.safe_metrics(_errors(spark, d).where(_view.replace("TIMESTAMP", "TIMESTAMP_NTZ")))


query("safe_metrics", "mae:d rmse:d bias:d max_abs_error:d", f"{P}, t AS (SELECT {SAFE} FROM errors WHERE horizon > 24)", "t")(lambda spark, d: evaluate.safe_metrics(_errors(spark, d).where("horizon > 24")))
query("stress_lens", "lens n:i mean_actual:d mean_predicted:d mean_error:d miss_rate:d", f"""{P}, v AS (SELECT * FROM errors), m AS (SELECT quantile_cont(actual, 0.4) AS q40, quantile_cont(actual, 0.6) AS q60, quantile_cont(actual, 0.9) AS q90 FROM v),
  x AS (SELECT v.*, q90, unnest(list_filter([CASE WHEN month(target_ts) IN (6, 7, 8) AND actual >= q90 THEN 'heat' END, CASE WHEN month(target_ts) IN (12, 1, 2, 3) AND actual >= q90 THEN 'blizzard' END, CASE WHEN actual BETWEEN q40 AND q60 THEN 'normal' END], lambda z: z IS NOT NULL)) AS lens FROM v, m),
  t AS (SELECT lens, count(*) AS n, avg(actual) AS mean_actual, avg(predicted) AS mean_predicted, avg(error) AS mean_error, avg(CASE WHEN actual >= q90 THEN (predicted < q90)::INTEGER END) AS miss_rate FROM x GROUP BY lens)""", "t")(lambda spark, d: evaluate.stress_lens(_errors(spark, d)))

# --- joins

query("fan_out_horizons", f"{KEYS} y_true:d", P, "fan")(jobs.predictions)
query("naive_24h", f"{KEYS} seasonal_naive_24h:d", P, "predictions")(jobs.predictions)
query("naive_168h", f"{KEYS} seasonal_naive_168h:d", P, "predictions")(jobs.predictions)
CONTROLS = [c for c in dmdc.CONTROLS]
query("future_controls", f"{KEYS} {_doubles(CONTROLS)}", f"{P}, t AS (SELECT f.*, {', '.join(CONTROLS)} FROM fan f JOIN cal ON cal.ts = f.target_ts)", "t")(lambda spark, d: origins.future_controls(jobs.predictions(spark, d)))


@query("attach_external_forecast", f"{KEYS} sarimax:d", f"{P}, t AS (SELECT origin_ts, target_ts, split, horizon, CASE WHEN split = 'test' THEN seasonal_naive_24h + 1 END AS sarimax FROM predictions)", "t")
def _(spark, d):
    rows = jobs.predictions(spark, d)
    other = rows.where("split = 'test'").select("origin_ts", "target_ts", "horizon", (F.col("seasonal_naive_24h") + 1).alias("sarimax"))
    return origins.attach_external(rows, other, "sarimax")


def _with_storms(of: Callable[[DataFrame, DataFrame], DataFrame], kind: str = "winter_storm") -> Callable[[SparkSession, str], DataFrame]:
    """of(hours, events of the kind)."""

    def run(spark, d):
        hours = jobs.event_table(spark, d)
        return of(hours, events.detect(hours, kind, MIN_HOURS[kind], bucket_hours=buckets.HOURS))

    return run


query("event_hours", "event_id ts lmp_clean:d", f"{E}, t AS (SELECT event_id, ts, lmp_clean FROM e_winter_storm JOIN hourly ON ts BETWEEN start_utc AND end_utc)", "t")(_with_storms(events.event_hours))
_picked = f"{E}, picked AS (SELECT * FROM e_winter_storm), {sql.PHASES}"


@query("event_phase_hours", "event_id phase ts", f"{_picked}, t AS (SELECT event_id, phase, ts FROM phase_rows JOIN hourly ON ts BETWEEN phase_start AND phase_end)", "t")
def _(spark, d):
    return _with_storms(lambda hours, storms: events.event_hours(hours, events.phases(storms), "phase_start", "phase_end"))(spark, d)


STATS = "event_id phase phase_start phase_end hours:i mean_lmp:d median_lmp:d max_lmp:d mean_load_mw:d max_load_mw:d mean_temp_c:d min_temp_c:d mean_hdd:d max_hdd:d max_wind_speed_ms:d precip_1h_total_mm:d"
query("phase_stats", STATS, _picked, "stats")(_with_storms(events.phase_stats))


def _uplifts(spark, d):
    return events.event_uplift(_with_storms(events.phase_stats)(spark, d))


query("event_uplift", "event_id phase event_uplift:d", _picked, "study")(_uplifts)


def _with_context(spark, d):
    hours = jobs.core_hours(spark, d)
    table = jobs.with_changes(hours)
    return events.label_context(evaluate.models_long(jobs.predictions_of(hours), NAIVE), events.context_hours(table, jobs.all_events(table, MIN_HOURS)))


PE = f"{P},\n{sql.events_sql()},\n{sql.CONTEXT}"
PS = f"{P},\n{sql.SEASON}"
query("label_event_context", f"{KEYS} model context", PE, "with_context")(_with_context)

# --- aggregations

query("split_summary", "split n:i first_ts last_ts", f"{S}, t AS (SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM supervised GROUP BY split)", "t")(
    lambda spark, d: jobs.supervised(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
)
_quantiles = " ".join(f"{k}_{n}:d" for k, q in events.QUANTILES.items() for n in q)
query("season_quantiles", _quantiles, f"{E}, t AS (SELECT {', '.join(f'q_{k}.{n} AS {k}_{n}' for k, q in events.QUANTILES.items() for n in q)} FROM {', '.join('q_' + k for k in events.QUANTILES)})", "t")(
    lambda spark, d: events.season_quantiles(jobs.event_table(spark, d), {f"{k}_{n}": v for k, q in events.QUANTILES.items() for n, v in q.items()}, method="ranges")
)
query("train_price_threshold", "threshold:d", P, "threshold")(lambda spark, d: jobs.train_threshold(jobs.core_hours(spark, d), "ranges"))
query("regression_metrics", f"model split {METRICS}", f"{P}, t AS ({sql.metrics(['split'])})", "t")(lambda spark, d: evaluate.regression_metrics(_long(spark, d), ["split"]))
query("metrics_by_horizon", f"model split horizon:i {METRICS}", f"{P}, t AS ({sql.metrics(['split', 'horizon'])})", "t")(lambda spark, d: evaluate.regression_metrics(_long(spark, d), ["split", "horizon"]))
query("metrics_by_context", f"model split context {METRICS}", f"{PE}, t AS ({sql.metrics(['split', 'context'], 'with_context')})", "t")(lambda spark, d: evaluate.regression_metrics(_with_context(spark, d), ["split", "context"]))
_by_season = sql.metrics(["split", "season", "season_year"], "(SELECT * FROM with_season WHERE season <> 'other')")
query("metrics_by_season_year", f"model split season season_year:i {METRICS}", f"{PS}, t AS ({_by_season})", "t")(lambda spark, d: evaluate.regression_metrics(jobs.with_seasons(_long(spark, d)), ["split", "season", "season_year"]))
AUC = "n:i positives:i negatives:i auc:d"
query("roc_auc", f"model split {AUC}", f"{P}, {sql.roc_sql(['model', 'split'], 'long')}, t AS (SELECT * FROM auc WHERE auc IS NOT NULL)", "t")(lambda spark, d: evaluate.roc_auc(_scored(spark, d), ["model", "split"]))
_BY = ["model", "split", "season", "season_year"]
_roc_season = sql.roc_sql(_BY, "(SELECT * FROM with_season WHERE season <> 'other')")


def _scored_seasons(spark, d):
    hours = jobs.core_hours(spark, d)
    return evaluate.labelled(jobs.with_seasons(evaluate.models_long(jobs.predictions_of(hours), NAIVE)), jobs.train_threshold(hours))


query("roc_auc_season_year", f"model split season season_year:i {AUC}", f"{PS}, {_roc_season}", "auc")(lambda spark, d: evaluate.roc_auc(_scored_seasons(spark, d), _BY, keep_one_class=True))


def _points(rows: DataFrame) -> DataFrame:
    return rows.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


query("roc_curve", "model split point:i fpr:d tpr:d threshold:d", f"{P}, {sql.roc_sql(['model', 'split'], 'long')}", "points")(lambda spark, d: _points(evaluate.roc_curve(_scored(spark, d), ["model", "split"])))
query("roc_curve_season_year", "model split season season_year:i point:i fpr:d tpr:d threshold:d", f"{PS}, {_roc_season}", "points")(lambda spark, d: _points(evaluate.roc_curve(_scored_seasons(spark, d), _BY)))

_year = "count(*) AS hours, avg(lmp_clean) AS mean_lmp, median(lmp_clean) AS median_lmp, quantile_cont(lmp_clean, 0.95) AS p95_lmp, max(lmp_clean) AS max_lmp, avg(load_mw_clean) AS mean_load_mw, max(load_mw_clean) AS max_load_mw, avg(temp_c_clean) AS mean_temp_c"
_high = "sum((lmp_clean >= p95)::INTEGER) AS high_price_hours"
query("winter_yearly", "winter_year:i hours:i mean_lmp:d median_lmp:d p95_lmp:d max_lmp:d mean_load_mw:d max_load_mw:d mean_temp_c:d min_temp_c:d mean_hdd:d max_hdd:d max_wind_speed_ms:d precip_1h_total_mm:d high_price_hours:i",
      f"{H}, w AS (SELECT *, year_local + CASE WHEN month_local = 12 THEN 1 ELSE 0 END AS winter_year FROM hourly WHERE is_winter = 1), m AS (SELECT quantile_cont(lmp_clean, 0.95) AS p95 FROM w), t AS (SELECT winter_year, {_year}, min(temp_c_clean) AS min_temp_c, avg(hdd_clean) AS mean_hdd, max(hdd_clean) AS max_hdd, max(wind_speed_ms_clean) AS max_wind_speed_ms, sum(precip_1h_mm_clean) AS precip_1h_total_mm, {_high} FROM w, m GROUP BY winter_year)", "t")(lambda spark, d: seasons.winter_yearly(features.add_calendar(jobs.core_hours(spark, d))))
query("summer_yearly", "year_local:i hours:i mean_lmp:d median_lmp:d p95_lmp:d max_lmp:d mean_load_mw:d max_load_mw:d mean_temp_c:d max_temp_c:d mean_cdd:d max_cdd:d high_price_hours:i",
      f"{H}, w AS (SELECT * FROM hourly WHERE is_summer = 1), m AS (SELECT quantile_cont(lmp_clean, 0.95) AS p95 FROM w), t AS (SELECT year_local, {_year}, max(temp_c_clean) AS max_temp_c, avg(cdd_clean) AS mean_cdd, max(cdd_clean) AS max_cdd, {_high} FROM w, m GROUP BY year_local)", "t")(lambda spark, d: seasons.summer_yearly(features.add_calendar(jobs.core_hours(spark, d))))
query("summer_hourly_profile", "year_local:i hour_local:i mean_lmp:d p95_lmp:d mean_load_mw:d mean_temp_c:d mean_cdd:d",
      f"{H}, t AS (SELECT year_local, hour_local, avg(lmp_clean) AS mean_lmp, quantile_cont(lmp_clean, 0.95) AS p95_lmp, avg(load_mw_clean) AS mean_load_mw, avg(temp_c_clean) AS mean_temp_c, avg(cdd_clean) AS mean_cdd FROM hourly WHERE is_summer = 1 GROUP BY 1, 2)", "t")(lambda spark, d: seasons.summer_hourly_profile(features.add_calendar(jobs.core_hours(spark, d))))


_summary = _with_storms(events.event_summary)


SUMMARY = "event_id start_utc end_utc duration_hours:i mean_lmp:d max_lmp:d peak_utc mean_premium:d max_premium:d mean_load_mw:d max_load_mw:d mean_temp_c:d min_temp_c:d max_temp_c:d sum_precip_1h_mm:d max_wind_speed_ms:d mean_hdd:d mean_cdd:d"
_summed = f"{E},\n{sql.summary_sql()}"
query("event_summary", SUMMARY, _summed, "summary")(_summary)
query("event_peak", "event_id peak_utc max_lmp:d", f"{E},\n{sql.summary_sql('winter_cold_wave')}", "summary")(_with_storms(events.event_summary, "winter_cold_wave"))
query("top_events", "event_id max_lmp:d", f"{_summed}, t AS (SELECT * FROM summary ORDER BY max_lmp DESC, event_id LIMIT 10)", "t")(lambda spark, d: _summary(spark, d).orderBy(F.desc("max_lmp"), "event_id").limit(10))


@query("major_storm_study", f"{STATS} event_uplift:d", f"{_summed}, picked AS (SELECT * FROM summary WHERE max_lmp >= (SELECT quantile_cont(max_lmp, 0.9) FROM summary)), {sql.PHASES}", "study")
def _(spark, d):
    return _with_storms(lambda hours, storms: events.event_uplift(events.phase_stats(hours, events.major_events(events.event_summary(hours, storms)))))(spark, d)


@query("top_uplifts", "event_id event_uplift:d", f"{_picked}, t AS (SELECT DISTINCT event_id, event_uplift FROM study WHERE event_uplift IS NOT NULL ORDER BY event_uplift DESC, event_id LIMIT 5)", "t")
def _(spark, d):
    return _uplifts(spark, d).where("event_uplift IS NOT NULL").select("event_id", "event_uplift").distinct().orderBy(F.desc("event_uplift"), "event_id").limit(5)


_state = list(dmdc.FULL_STATES)
query("fit_scaler", "n:i " + " ".join(f"m{i}:d s{i}:d" for i in range(len(_state))), f"{H}, t AS (SELECT count(*) AS n, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(_state))} FROM hourly WHERE ts <= TIMESTAMP '{adapter.TRAIN_END}')", "t")(
    lambda spark, d: dmdc.fit_scaler(_cleaned(spark, d).where(F.col("ts") <= F.lit(adapter.TRAIN_END).cast("timestamp_ntz")), _state)
)


@query("fit_dmdc_moments", "row:i col:i value", f"{H}, x AS (SELECT [lmp_clean, load_mw_clean] AS x, lead([lmp_clean, load_mw_clean]) OVER (ORDER BY ts) AS y FROM hourly), c AS (SELECT [avg(lmp_clean), avg(load_mw_clean)] AS c FROM hourly), "
       "t AS (SELECT i AS row, j AS col, round(sum((x[i + 1] - c[i + 1]) * (CASE WHEN j < 2 THEN x[j + 1] - c[j + 1] ELSE y[j - 1] - c[j - 1] END)) / 1e6, 3) AS value FROM x, c, range(2) a(i), range(4) b(j) WHERE y IS NOT NULL GROUP BY 1, 2)", "t")  # fmt: skip
def _(spark, d):
    states = {"all": ("lmp_clean", "load_mw_clean")}
    sums = dmdc.moments(jobs.core_hours(spark, d), states, {"all": "9999-12-31 00:00:00"}, controls=(), bucket_hours=500)
    place = F.col("place") - 10  # behind 2 counts, 2 x 3 sums and the sums of 2 next states
    return sums.where(place >= 0).select(F.floor(place / 4).alias("row"), (place % 4).alias("col"), F.round(F.col("value") / 1e6, 3).alias("value"))


_DAILY = "SELECT day, lmp_clean, load_mw_clean, temp_c_clean FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM hourly), (SELECT date_trunc('day', max(ts)) FROM hourly), INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT date_trunc('day', ts) AS day, avg(lmp_clean) AS lmp_clean, avg(load_mw_clean) AS load_mw_clean, avg(temp_c_clean) AS temp_c_clean FROM hourly GROUP BY 1) USING (day)"
_daily_measures = ["lmp_clean", "load_mw_clean", "temp_c_clean"]
query("daily_means", f"day {_doubles(_daily_measures)}", f"{H}, t AS ({_DAILY})", "t")(lambda spark, d: seasons.daily_means(jobs.core_hours(spark, d), _daily_measures))
query("rolling_7d_mean", "day lmp_clean_7d:d", f"{H}, t AS (SELECT day, avg(lmp_clean) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS lmp_clean_7d FROM ({_DAILY}))", "t")(
    lambda spark, d: seasons.rolling_days(seasons.daily_means(jobs.core_hours(spark, d), ["lmp_clean"]), ["lmp_clean"])
)
query("daily_forecast_means", "day mean_actual:d mean_predicted:d", f"{P}, t AS (SELECT date_trunc('day', target_ts)::TIMESTAMP AS day, avg(actual) AS mean_actual, avg(predicted) AS mean_predicted FROM errors WHERE split = 'test' GROUP BY 1)", "t")(
    lambda spark, d: seasons.daily_forecast_means(_errors(spark, d).where("split = 'test'"))
)
query("error_histogram", "bin:i n:i", f"{P}, m AS (SELECT min(error) AS low, max(error) AS high FROM errors), t AS (SELECT least(floor((error - low) / ((high - low) / 60)), 59) AS bin, count(*) AS n FROM errors, m GROUP BY 1)", "t")(
    lambda spark, d: evaluate.error_histogram(_errors(spark, d))
)


@query("weekly_naive_improvement", "improvement:d", f"{P}, x AS ({sql.metrics(['split', 'horizon'])}), t AS (SELECT avg(mae) FILTER (WHERE model = '{NAIVE[1]}') - avg(mae) FILTER (WHERE model = '{NAIVE[0]}') AS improvement FROM x)", "t")
def _(spark, d):
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("mae")))
    return evaluate.regression_metrics(_long(spark, d), ["split", "horizon"]).agg((of(NAIVE[1]) - of(NAIVE[0])).alias("improvement"))


query("replay_summary", "origin_ts horizons:i mae:d rmse:d bias:d max_abs_error:d std_actual:d peak_actual:d peak_predicted:d worst_horizon:i within_spread tendency missed_peak", f"""{P}, x AS (SELECT origin_ts, count(*) AS horizons, avg(abs_error) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias, max(abs_error) AS max_abs_error, stddev_samp(actual) AS std_actual, max(actual) AS peak_actual, max(predicted) AS peak_predicted, arg_min(horizon, (-abs_error, horizon)) AS worst_horizon FROM errors GROUP BY 1),
  t AS (SELECT *, coalesce(mae < std_actual, false) AS within_spread, CASE WHEN bias > 0 THEN 'over' WHEN bias < 0 THEN 'under' ELSE 'even' END AS tendency, peak_actual > 1.2::DOUBLE * peak_predicted AS missed_peak FROM x)""", "t")(lambda spark, d: evaluate.replay_summary(_errors(spark, d)))  # fmt: skip
query("cumulative_abs_error", f"{KEYS} cumulative_abs_error:d", f"{P}, t AS (SELECT *, sum(abs_error) OVER (PARTITION BY origin_ts ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS cumulative_abs_error FROM errors)", "t")(
    lambda spark, d: evaluate.cumulative_error(_errors(spark, d))
)

# --- sessions

query("sessionize_events", "start_utc end_utc", E, "s_winter_storm")(lambda spark, d: buckets.sessions(events.candidates(jobs.event_table(spark, d), "winter_storm"), hours=240))
query("number_events", "event_id start_utc end_utc duration_hours:i", E, "e_summer_sudden_heat")(lambda spark, d: events.detect(jobs.event_table(spark, d), "summer_sudden_heat", MIN_HOURS["summer_sudden_heat"], bucket_hours=240))
query("heat_price_events", "event_id start_utc end_utc duration_hours:i", E, "e_summer_heat_price_event")(lambda spark, d: events.detect(jobs.event_table(spark, d), "summer_heat_price_event", MIN_HOURS["summer_heat_price_event"], bucket_hours=240))
query("normal_price", "ts normal_lmp:d premium:d", f"{H}, {sql.PREMIUM}", "premium")(lambda spark, d: events.with_premium(jobs.event_table(spark, d), method="ranges"))

# --- rankings, folds, pivots


def _by_split(spark, d):
    return evaluate.regression_metrics(_long(spark, d), ["split"])


_ms = f"{P}, x AS ({sql.metrics(['split'])})"
query("best_model_per_split", f"split model {METRICS}", f"{_ms}, t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY split ORDER BY mae, model) = 1)", "t")(lambda spark, d: evaluate.best_by(_by_split(spark, d), ["split"]))
query("best_model_per_context", f"split context model {METRICS}", f"{PE}, x AS ({sql.metrics(['split', 'context'], 'with_context')}), t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY split, context ORDER BY mae, model) = 1)", "t")(
    lambda spark, d: evaluate.best_by(evaluate.regression_metrics(_with_context(spark, d), ["split", "context"]), ["split", "context"])
)
query("best_test_model", f"split model {METRICS}", f"{_ms}, t AS (SELECT * FROM x ORDER BY CASE WHEN split = 'test' THEN 0 ELSE 1 END, mae, model, split LIMIT 1)", "t")(lambda spark, d: evaluate.best_test_model(_by_split(spark, d)))
query("rank_models", f"model split label {METRICS}", f"{_ms}, t AS (SELECT *, CASE model WHEN '{NAIVE[0]}' THEN 'Seasonal naive 24h' ELSE 'Seasonal naive 168h' END AS label FROM x ORDER BY r2 DESC)", "t")(lambda spark, d: evaluate.rank_models(_by_split(spark, d), "r2"))
query("worst_horizon", "model split horizon:i mae:d", f"{P}, x AS ({sql.metrics(['split', 'horizon'])}), t AS (SELECT * FROM x ORDER BY mae DESC, model, split, horizon LIMIT 1)", "t")(
    lambda spark, d: evaluate.regression_metrics(_long(spark, d), ["split", "horizon"]).orderBy(F.desc("mae"), "model", "split", "horizon").limit(1)
)
query("first_n_origins", "ts split", f"{P}, t AS (SELECT * FROM origins ORDER BY ts LIMIT 10)", "t")(lambda spark, d: origins.first_origins(jobs.chosen_origins(jobs.core_hours(spark, d)), 10))
query("distinct_origins", "origin_ts", f"{P}, t AS (SELECT DISTINCT origin_ts FROM predictions ORDER BY 1)", "t")(lambda spark, d: jobs.predictions(spark, d).select("origin_ts").distinct().orderBy("origin_ts"))
_pivot = lambda row, column, values, measures: ", ".join(f"max({m}) FILTER (WHERE {column} = '{v}') AS {v}_{m}" for v in values for m in measures)
_SPLITS = ["validation", "test"]
query("pivot_metrics", "model " + _doubles([f"{v}_{m}" for v in _SPLITS for m in ("mae", "rmse", "r2")]), f"{_ms}, t AS (SELECT model, {_pivot('model', 'split', _SPLITS, ('mae', 'rmse', 'r2'))} FROM x GROUP BY model)", "t")(
    lambda spark, d: evaluate.pivoted(_by_split(spark, d), "model", "split", _SPLITS, ["mae", "rmse", "r2"])
)
query("pivot_event_metrics", "context " + _doubles([f"{v}_{m}" for v in NAIVE for m in ("mae", "rmse")]), f"{PE}, x AS ({sql.metrics(['split', 'context'], 'with_context')}), t AS (SELECT context, {_pivot('context', 'model', NAIVE, ('mae', 'rmse'))} FROM x WHERE context NOT IN ('other', 'summer_all') GROUP BY context, split)", "t")(
    lambda spark, d: reduce(
        DataFrame.unionByName,
        [evaluate.pivoted(evaluate.regression_metrics(_with_context(spark, d), ["split", "context"]).where((F.col("split") == s) & ~F.col("context").isin("other", "summer_all")), "context", "model", NAIVE, ["mae", "rmse"]) for s in _SPLITS],
    )
)


def _fold_sql() -> str:
    parts, unions = [], []
    for name, train_end, first, last in jobs.FOLDS:
        parts.append(f"""o_{name} AS (SELECT * FROM supervised WHERE ts BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}'),
f_{name} AS (SELECT ts AS origin_ts, '{name}' AS split, '{name}' AS fold, TIMESTAMP '{train_end}' AS cv_train_end, h::INTEGER AS horizon, ts + to_hours(h::INTEGER) AS target_ts, ([{", ".join(features.targets())}])[h] AS y_true FROM o_{name}, range(1, 25) r(h) WHERE date_diff('hour', (SELECT min(ts) FROM o_{name}), ts) % {jobs.STEP} = 0)""")
        unions.append(f"SELECT * FROM f_{name}")
    return f"{S},\n{', '.join(parts)},\nfolds AS (SELECT u.*, c.lmp_clean AS seasonal_naive_24h FROM ({' UNION ALL '.join(unions)}) u LEFT JOIN clean c ON c.ts = u.target_ts - INTERVAL 24 HOUR)"


FOLD = "origin_ts target_ts split fold cv_train_end horizon:i y_true:d seasonal_naive_24h:d"
query("union_folds", FOLD, _fold_sql(), "folds")(jobs.fold_predictions)
_fold_long = f"{_fold_sql()}, long AS (SELECT *, 'seasonal_naive_24h' AS model, seasonal_naive_24h AS pred FROM folds WHERE y_true IS NOT NULL AND seasonal_naive_24h IS NOT NULL)"
_fold_threshold = f"threshold AS (SELECT quantile_cont(lmp_clean, 0.9) AS threshold FROM hourly WHERE ts <= TIMESTAMP '{adapter.TRAIN_END}')"


def _folds_long(spark, d):
    return evaluate.models_long(jobs.fold_predictions(spark, d).drop("seasonal_naive_168h"), NAIVE[:1])


query("fold_metrics", f"model fold {METRICS}", f"{_fold_long}, t AS ({sql.metrics(['fold'])})", "t")(lambda spark, d: evaluate.regression_metrics(_folds_long(spark, d), ["fold"]))
query("fold_roc_auc", f"model fold {AUC}", f"{_fold_long}, {_fold_threshold}, {sql.roc_sql(['model', 'fold'], 'long')}", "auc")(
    lambda spark, d: evaluate.roc_auc(evaluate.labelled(_folds_long(spark, d), jobs.train_threshold(jobs.core_hours(spark, d))), ["model", "fold"], keep_one_class=True)
)

# --- state-space forecasts; their twins fit and forecast in plain SQL, by elimination and recursion


@query("dmdc_fit", "model row:i state a b")
def _(spark, d):
    """A and B, row by row of the states. No twin: single entries are at the mercy of the solver where states are
    linearly dependent; the forecasts that follow from them are compared."""
    fitted = dmdc.fit(jobs.state_hours(spark, d), dmdc.MODELS, {"train": adapter.TRAIN_END})
    names = F.create_map(*[x for m, s in dmdc.MODELS.items() for x in (F.lit(m), F.array(*[F.lit(c) for c in s]))])
    rows = fitted.select("model", F.posexplode(F.element_at(names, F.col("model"))).alias("row", "state"), "a", "b", F.size(F.element_at(names, F.col("model"))).alias("n"))
    c = len(dmdc.CONTROLS)
    return rows.select("model", "row", "state", F.slice("a", F.col("row") * F.col("n") + 1, F.col("n")).alias("a"), F.slice("b", F.col("row") * c + 1, c).alias("b"))


_fits = ",\n".join(sql.fit_sql(m, m, adapter.TRAIN_END) for m in dmdc.MODELS)
_scales = " UNION ALL ".join(f"SELECT '{m}' AS model, (SELECT count(*) - 1 FROM v_{m}) AS pairs, unnest(range(len(mean))) AS place, unnest(mean) AS mean, unnest(scale) AS scale FROM m_{m}" for m in dmdc.MODELS)


@query("dmdc_fit_scaler", "model pairs:i place:i mean:d scale:d", f"{sql.recursive(H)}, {_fits}, t AS ({_scales})", "t")
def _(spark, d):
    fitted = dmdc.fit(jobs.state_hours(spark, d), dmdc.MODELS, {"train": adapter.TRAIN_END})
    return fitted.select("model", "pairs", F.posexplode(F.arrays_zip("mean", "scale")).alias("place", "x")).select("model", "pairs", "place", "x.mean", "x.scale")


def _forecasts(spark, d):
    return jobs.forecast_table(jobs.state_hours(spark, d))


MODELS = [*NAIVE, *dmdc.MODELS]
P4 = sql.all_forecasts_sql()


def _all_long(spark, d):
    return evaluate.models_long(_forecasts(spark, d), MODELS)


def _improvement(spark, d):
    of = lambda m: F.avg(F.when(F.col("model") == m, F.col("mae")))
    return evaluate.regression_metrics(_all_long(spark, d), ["split", "horizon"]).agg((of(NAIVE[0]) - of("dmdc_residual_24h")).alias("improvement"))


METRICS_3 = METRICS.replace(":d", ":m")
_raw = lambda text: text.replace(" + 3.3e-8, 6)", ", 12)")  # noqa: E731  sums of the twins before they are shown with 3 digits
_improved = f"{P4}, x AS ({_raw(sql.metrics(['split', 'horizon'], 'long_4'))}), t AS (SELECT avg(mae) FILTER (WHERE model = '{NAIVE[0]}') - avg(mae) FILTER (WHERE model = 'dmdc_residual_24h') AS improvement FROM x)"
query("dmdc_forecast", f"{KEYS} dmdc:m", P4, "table_4")(_forecasts)
query("dmdc_residual_forecast", f"{KEYS} dmdc_residual_24h:m", P4, "table_4")(_forecasts)
query("forecast_table", f"{KEYS} y_true:d seasonal_naive_24h:d seasonal_naive_168h:d dmdc:m dmdc_residual_24h:m", P4, "table_4")(_forecasts)
query("forecast_table_naive", f"{KEYS} y_true:d seasonal_naive_24h:d seasonal_naive_168h:d", P, "predictions")(_forecasts)
query("metrics_all_models", f"model split {METRICS_3}", f"{P4}, t AS ({_raw(sql.metrics(['split'], 'long_4'))})", "t")(lambda spark, d: evaluate.regression_metrics(_all_long(spark, d), ["split"]))
query("naive_improvement", "improvement:m", _improved, "t")(_improvement)
query("residual_improvement", "improvement:m", _improved, "t")(_improvement)


@query("roc_auc_all_models", f"model split {AUC.replace(':d', ':m')}", f"{P4}, {_raw(sql.roc_sql(['model', 'split'], 'long_4'))}, t AS (SELECT * FROM auc WHERE auc IS NOT NULL)", "t")
def _(spark, d):
    hours = jobs.state_hours(spark, d)
    return evaluate.roc_auc(evaluate.labelled(evaluate.models_long(jobs.forecast_table(hours), MODELS), jobs.train_threshold(hours)), ["model", "split"])


F4 = sql.all_folds_sql(_fold_sql(), jobs.FOLDS)
CV = f"{FOLD} seasonal_naive_168h:d dmdc:w dmdc_residual_24h:w"  # the first fold has seen no winter
FOLD_METRICS = "n:i mae:t mse:w rmse:t r2:t bias:t"


def _folds(spark, d):
    return jobs.fold_predictions(spark, d, models=True)


query("expanding_cv", CV, F4, "folds_4")(_folds)
query("expanding_cv_naive", FOLD, _fold_sql(), "folds")(_folds)


def _all_folds_long(spark, d):
    return evaluate.models_long(_folds(spark, d), MODELS)


def _folds_scored(spark, d):
    return evaluate.labelled(_all_folds_long(spark, d), jobs.train_threshold(jobs.core_hours(spark, d)))


_fold_roc = _raw(sql.roc_sql(["model", "fold"], "folds_long_4"))
query("fold_metrics_all_models", f"model fold {FOLD_METRICS}", f"{F4}, t AS ({_raw(sql.metrics(['fold'], 'folds_long_4'))})", "t")(lambda spark, d: evaluate.regression_metrics(_all_folds_long(spark, d), ["fold"]))
query("fold_metrics_by_horizon", f"model fold horizon:i {FOLD_METRICS}", f"{F4}, t AS ({_raw(sql.metrics(['fold', 'horizon'], 'folds_long_4'))})", "t")(lambda spark, d: evaluate.regression_metrics(_all_folds_long(spark, d), ["fold", "horizon"]))
query("fold_roc_auc_all_models", f"model fold {AUC.replace(':d', ':m')}", f"{F4}, {_fold_threshold}, {_fold_roc}", "auc")(lambda spark, d: evaluate.roc_auc(_folds_scored(spark, d), ["model", "fold"], keep_one_class=True))
query("fold_roc_curve_all_models", "model fold point:i fpr:m tpr:m threshold:m")(lambda spark, d: _points(evaluate.roc_curve(_folds_scored(spark, d), ["model", "fold"])))
query("fold_roc_curve", "model fold point:i fpr:d tpr:d threshold:d", f"{_fold_long}, {_fold_threshold}, {sql.roc_sql(['model', 'fold'], 'long')}", "points")(
    lambda spark, d: _points(evaluate.roc_curve(evaluate.labelled(_folds_long(spark, d), jobs.train_threshold(jobs.core_hours(spark, d))), ["model", "fold"]))
)


# --- many series at once: a key for each


def _event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return _events_raw(spark, sf_dir).select(
        "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), value.alias("lmp"), F.col("user_id").cast("double").alias("load_mw"),
        value.alias("temp_c"), F.greatest(18.3 - value, F.lit(0.0)).alias("hdd"), F.greatest(value - 18.3, F.lit(0.0)).alias("cdd"),
    )


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours of every event type as a series of its own, with all features."""
    key = ("event_type",)
    return features.features(clean.clean(clean.align([(_event_feed(spark, sf_dir), list(features.STATES))], key), key), key)


query(
    "keyed_features",
    "event_type ts lmp_missing:i lmp_clean:d load_mw_clean:d lmp_clean_lag_1h:d lmp_clean_lag_168h:d load_mw_clean_lag_24h:d lmp_roll_24h_mean:d lmp_roll_24h_std:d lmp_roll_168h_mean:d "
    "lmp_change_24h:d target_lmp_h01:d target_lmp_h24:d",
    sql.SERIES_FEATURES,
    "series",
)(_series)


@query("keyed_sessions", "event_type event_id start_utc end_utc duration_hours:i", sql.SERIES_RUNS, "runs")
def _(spark, d):
    key = ("event_type",)
    high = events.with_premium(_series(spark, d), key).where("premium > 1")
    return events.numbered(events.sessions(high, 1, key), "high", 3, key)


KEY = ("event_type",)
#: Hours between the origins of the series, and the end of their training.
KEYED_STEP, KEYED_END = 3, "2024-01-20 23:00:00"


def _keyed_hours(spark, d):
    return tables.staged(_series(spark, d).select("event_type", "ts", "ts_local", "month_local", "hour_local", "is_winter", "is_summer", "lmp_observed", *[c for m in features.STATES for c in (f"{m}_clean", f"{m}_missing", f"{m}_change_24h")]))


def _keyed_predictions(hours: DataFrame) -> DataFrame:
    chosen = tables.staged(origins.choosable(hours, keys=KEY).select("event_type", "ts", F.lit("test").alias("split")))
    return origins.fan_out(origins.sample_origins(chosen, KEYED_STEP, KEY), hours, keys=KEY)


def _keyed_errors(spark, d):
    return evaluate.forecast_errors(_keyed_predictions(_keyed_hours(spark, d)), NAIVE[0])


def _keyed_scored(spark, d):
    hours = _keyed_hours(spark, d)
    marks = evaluate.price_threshold(hours.where(F.col("ts") <= F.lit(KEYED_END).cast("timestamp_ntz")), keys=KEY, method="ranges")
    return evaluate.labelled(evaluate.models_long(_keyed_predictions(hours), NAIVE), marks, KEY)


K, KP = sql.SERIES_FEATURES, sql.keyed_predictions_sql(KEYED_STEP, KEYED_END)
_by_key = ["event_type", "model"]
query("keyed_predictions", "event_type origin_ts target_ts horizon:i y_true:d seasonal_naive_24h:d seasonal_naive_168h:d", KP, "predictions")(lambda spark, d: _keyed_predictions(_keyed_hours(spark, d)))
query("keyed_high_price_label", "event_type origin_ts horizon:i model threshold:d high:i", f"{KP}, t AS (SELECT *, (y_true >= threshold)::INTEGER AS high FROM long JOIN threshold USING (event_type))", "t")(_keyed_scored)
query("keyed_metrics", f"event_type model {METRICS}", f"{KP}, t AS ({sql.metrics(['event_type'])})", "t")(lambda spark, d: evaluate.regression_metrics(evaluate.models_long(_keyed_predictions(_keyed_hours(spark, d)), NAIVE), ["event_type"]))
_keyed_roc = sql.roc_sql(_by_key, "long", "long JOIN threshold USING (event_type)")
query("keyed_roc_auc", f"event_type model {AUC}", f"{KP}, {_keyed_roc}", "auc")(lambda spark, d: evaluate.roc_auc(_keyed_scored(spark, d), _by_key, keep_one_class=True))
query("keyed_roc_curve", "event_type model point:i fpr:d tpr:d threshold:d", f"{KP}, {_keyed_roc}", "points")(lambda spark, d: _points(evaluate.roc_curve(_keyed_scored(spark, d), _by_key)))
query("keyed_replay_summary", "event_type origin_ts horizons:i mae:d rmse:d bias:d max_abs_error:d std_actual:d worst_horizon:i", f"""{KP}, t AS (SELECT event_type, origin_ts, count(*) AS horizons, avg(abs_error) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias, max(abs_error) AS max_abs_error,
  stddev_samp(actual) AS std_actual, arg_min(horizon, (-abs_error, horizon)) AS worst_horizon FROM errors GROUP BY ALL)""", "t")(lambda spark, d: evaluate.replay_summary(_keyed_errors(spark, d), KEY))  # fmt: skip
query("keyed_cumulative_abs_error", "event_type origin_ts horizon:i cumulative_abs_error:d", f"{KP}, t AS (SELECT *, sum(abs_error) OVER (PARTITION BY event_type, origin_ts ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS cumulative_abs_error FROM errors)", "t")(
    lambda spark, d: evaluate.cumulative_error(_keyed_errors(spark, d), KEY)
)
query("keyed_stress_lens", "event_type lens n:i mean_actual:d mean_predicted:d mean_error:d miss_rate:d", f"""{KP}, m AS (SELECT event_type, quantile_cont(actual, 0.4) AS q40, quantile_cont(actual, 0.6) AS q60, quantile_cont(actual, 0.9) AS q90 FROM errors GROUP BY 1),
  x AS (SELECT e.*, q90, unnest(list_filter([CASE WHEN month(target_ts) IN (12, 1, 2, 3) AND actual >= q90 THEN 'blizzard' END, CASE WHEN actual BETWEEN q40 AND q60 THEN 'normal' END], lambda z: z IS NOT NULL)) AS lens FROM errors e JOIN m USING (event_type)),
  t AS (SELECT event_type, lens, count(*) AS n, avg(actual) AS mean_actual, avg(predicted) AS mean_predicted, avg(error) AS mean_error, avg(CASE WHEN actual >= q90 THEN (predicted < q90)::INTEGER END) AS miss_rate FROM x GROUP BY ALL)""", "t")(
    lambda spark, d: evaluate.stress_lens(_keyed_errors(spark, d), KEY)
)
query("keyed_season_quantiles", "event_type lmp_p95:d load_p75:d temp_p10:d", f"{K}, t AS (SELECT event_type, quantile_cont(lmp_clean, 0.95) AS lmp_p95, quantile_cont(load_mw_clean, 0.75) AS load_p75, quantile_cont(lmp_change_24h, 0.1) AS temp_p10 FROM series GROUP BY 1)", "t")(
    lambda spark, d: events.season_quantiles(_keyed_hours(spark, d), {"lmp_p95": ("winter", "lmp_clean", 0.95), "load_p75": ("winter", "load_mw_clean", 0.75), "temp_p10": ("winter", "lmp_change_24h", 0.1)}, KEY, "ranges")
)
query("keyed_daily_means", "event_type day lmp_clean:d load_mw_clean:d", f"{K}, t AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, avg(lmp_clean) AS lmp_clean, avg(load_mw_clean) AS load_mw_clean FROM series GROUP BY 1, 2)", "t")(
    lambda spark, d: seasons.daily_means(_keyed_hours(spark, d), ["lmp_clean", "load_mw_clean"], KEY)
)
query("keyed_bucket_features", "event_type ts lmp_clean:d lmp_clean_lag_168h:d lmp_roll_24h_mean:d lmp_roll_168h_mean:d target_lmp_h24:d", K, "series")(
    lambda spark, d: buckets.over_buckets(buckets.fill_gaps(_keyed_raw(spark, d), {"lmp": 24, "load_mw": 12, **dict.fromkeys(("temp_c", "hdd", "cdd"), 6)}, KEY, 100), features.features, 168, 24, KEY, 200)
)


def _keyed_raw(spark, d):
    """The grid of every series before its gaps are filled, staged."""
    return tables.staged(clean.align([(_event_feed(spark, d), list(features.STATES))], KEY).withColumns({"lmp_observed": F.col("lmp"), "lmp_missing": F.col("lmp").isNull().cast("int")}))


@query("keyed_dmdc_forecast", "event_type origin_ts target_ts horizon:i y_true:d dmdc_residual_24h")
def _(spark, d):
    """One fit for each series on the executors; tests compare such fits and forecasts with NumPy."""
    hours = _keyed_hours(spark, d)
    hours = hours.withColumns(origins.controls_at(F.col("ts")))
    model = {"dmdc_residual_24h": dmdc.RESIDUAL_STATES}
    fitted = tables.staged(dmdc.fit(hours, model, {"train": KEYED_END}, keys=KEY))
    table = _keyed_predictions(hours)
    chosen = table.select("event_type", F.col("origin_ts").alias("ts")).distinct()
    found = dmdc.forecast(fitted, buckets.beside(chosen, hours.select("event_type", "ts", *dmdc.RESIDUAL_STATES), ["event_type", "ts"]), model, by=KEY)
    rows = buckets.beside(table, found, ["event_type", "origin_ts", "horizon"], "left")
    return rows.withColumn("dmdc_residual_24h", F.col("seasonal_naive_24h") + F.col("dmdc_residual_24h"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm events, from the raw feeds on."""
    return QUERIES["event_summary"](spark, sf_dir)
