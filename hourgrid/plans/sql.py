"""SQL twins: the hourly work as common table expressions, from the feeds on."""

from hourgrid.operators.clean import FILL_FROM, FILL_LIMITS, FILL_ZERO
from hourgrid.operators.events import CONTEXTS, EVENT_KINDS, PREDICATES, QUANTILES
from hourgrid.operators.features import LAGS, REQUIRED, STATES, targets
from hourgrid.plans.adapter import FEEDS_SQL, LOAD, PRICE, TRAIN_END, VALIDATION_END, WEATHER

MEASURES = [*PRICE, *LOAD, *WEATHER]
MODELS = ("seasonal_naive_24h", "seasonal_naive_168h")
#: Least hours of an event by kind in the registered queries.
MIN_HOURS = {"winter_storm": 6, "summer_sudden_heat": 6, "winter_cold_wave": 6, "summer_heat_price_event": 1}


def _means(feed: str, measures: list[str]) -> str:
    return f"{feed}_h AS (SELECT ts, {', '.join(f'avg({m}) AS {m}' for m in measures)} FROM {feed} WHERE ts IS NOT NULL GROUP BY ts)"


def fill_parts(column: str, by: str = "") -> str:
    """Value and row before and after each row of a CTE that has `rn`; by: PARTITION BY of the series."""
    up, down = f"OVER ({by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({by} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {column} IS NOT NULL THEN rn END"
    return f"last_value({column} IGNORE NULLS) {up} AS {column}_p, last_value({at} IGNORE NULLS) {up} AS {column}_i, first_value({column} IGNORE NULLS) {down} AS {column}_n, first_value({at} IGNORE NULLS) {down} AS {column}_j"


def fill_value(column: str, limit: int) -> str:
    c, back, on = column, f"(rn - {column}_i)", f"({column}_j - rn)"
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NOT NULL AND {c}_n IS NOT NULL THEN {c}_p + ({c}_n - {c}_p) * (CASE WHEN {back} <= {limit} OR {on} <= {limit} THEN {back} ELSE {limit} END) / ({back} + {on}) ELSE coalesce({c}_p, {c}_n) END"


_clean = [f"{fill_value(c, n)} AS {c}_clean" for c, n in FILL_LIMITS.items()]
_rest = [f"coalesce({c}, {o}_clean) AS {c}_clean" for c, o in FILL_FROM.items()] + [f"coalesce({c}, 0) AS {c}_clean" for c in FILL_ZERO]
_lags = [f"lag({m}_clean, {n}) OVER w AS {m}_clean_lag_{n}h" for m, ns in LAGS.items() for n in ns]
_changes = [f"{m}_clean - lag({m}_clean, 24) OVER w AS {m}_change_24h" for m in STATES]
_rolls = [
    f"CASE WHEN count({m}_clean) OVER r{n} >= {least} THEN {f}({m}_clean) OVER r{n} END AS {name}"
    for name, m, n, least, f in (
        ("lmp_roll_24h_mean", "lmp", 24, 12, "avg"), ("lmp_roll_24h_std", "lmp", 24, 12, "stddev_samp"), ("lmp_roll_168h_mean", "lmp", 168, 72, "avg"),
        ("load_roll_24h_mean", "load_mw", 24, 12, "avg"), ("temp_roll_24h_mean", "temp_c", 24, 12, "avg"),
    )
]
_targets = [f"lead(lmp_observed, {h}) OVER w AS {t}, lead(lmp_missing, {h}) OVER w AS {t}_is_missing" for h, t in enumerate(targets(), 1)]
_turn = lambda name, value, n: f"sin(2 * pi() * {value} / {n}) AS sin_{name}, cos(2 * pi() * {value} / {n}) AS cos_{name}"
LOCAL = "(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"

HOURLY = f"""WITH {FEEDS_SQL},
{_means("price", PRICE)}, {_means("load", LOAD)}, {_means("weather", WEATHER)},
ends AS (SELECT greatest((SELECT min(ts) FROM price), (SELECT min(ts) FROM load), (SELECT min(ts) FROM weather)) AS a, least((SELECT max(ts) FROM price), (SELECT max(ts) FROM load), (SELECT max(ts) FROM weather)) AS b),
spine AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ends),
joined AS (SELECT * FROM spine LEFT JOIN price_h USING (ts) LEFT JOIN load_h USING (ts) LEFT JOIN weather_h USING (ts)),
numbered AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM joined),
edges AS (SELECT *, {", ".join(fill_parts(c) for c in FILL_LIMITS)} FROM numbered),
clean_1 AS (SELECT ts, {", ".join(MEASURES)}, lmp AS lmp_observed, {", ".join(f"({m} IS NULL)::INTEGER AS {m}_missing" for m in MEASURES)}, {", ".join(_clean)} FROM edges),
clean AS (SELECT *, {", ".join(_rest)} FROM clean_1),
local_1 AS (SELECT *, {LOCAL.format("ts")} AS ts_local FROM clean),
local_2 AS (SELECT *, year(ts_local)::INTEGER AS year_local, month(ts_local)::INTEGER AS month_local, day(ts_local)::INTEGER AS day_local, hour(ts_local)::INTEGER AS hour_local, (isodow(ts_local) - 1)::INTEGER AS weekday_local FROM local_1),
cal AS (SELECT *, (weekday_local >= 5)::INTEGER AS is_weekend, (month_local IN (6, 7, 8))::INTEGER AS is_summer, (month_local IN (12, 1, 2, 3))::INTEGER AS is_winter,
  {_turn("hour", "hour_local", 24)}, {_turn("dow", "weekday_local", 7)}, {_turn("month", "month_local", 12)} FROM local_2),
hourly AS (SELECT *, {", ".join(_lags)}, {", ".join(_rolls)}, {", ".join(_targets)}, {", ".join(_changes)} FROM cal
  WINDOW w AS (ORDER BY ts), r24 AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), r168 AS (ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))"""

_known = " AND ".join(f"{c} IS NOT NULL" for c in [*targets(), *REQUIRED])
_whole = " AND ".join(f"coalesce({t}_is_missing, 1) = 0" for t in targets())
SPLIT = f"CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts <= TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END"
SUPERVISED = f"""{HOURLY},
supervised AS (SELECT *, {SPLIT} AS split FROM hourly WHERE {_known} AND {_whole})"""


def predictions_sql(step: int = 6) -> str:
    """Origins of validation and test, fanned out, with the two naive forecasts."""
    return f"""{SUPERVISED},
chosen AS (SELECT * FROM supervised WHERE split IN ('validation', 'test')),
origins AS (SELECT * FROM chosen WHERE date_diff('hour', (SELECT min(ts) FROM chosen), ts) % {step} = 0),
fan AS (SELECT ts AS origin_ts, split, h::INTEGER AS horizon, ts + to_hours(h::INTEGER) AS target_ts, ([{", ".join(targets())}])[h] AS y_true FROM origins, range(1, 25) r(h)),
predictions AS (SELECT f.*, a.lmp_clean AS seasonal_naive_24h, b.lmp_clean AS seasonal_naive_168h FROM fan f
  LEFT JOIN clean a ON a.ts = f.target_ts - INTERVAL 24 HOUR LEFT JOIN clean b ON b.ts = f.target_ts - INTERVAL 168 HOUR),
long AS (SELECT * FROM (SELECT origin_ts, target_ts, split, horizon, y_true, unnest(['seasonal_naive_24h', 'seasonal_naive_168h']) AS model, unnest([seasonal_naive_24h, seasonal_naive_168h]) AS pred FROM predictions) WHERE pred IS NOT NULL AND y_true IS NOT NULL),
errors AS (SELECT *, y_true AS actual, seasonal_naive_24h AS predicted, seasonal_naive_24h - y_true AS error, abs(seasonal_naive_24h - y_true) AS abs_error FROM predictions WHERE seasonal_naive_24h IS NOT NULL AND y_true IS NOT NULL),
threshold AS (SELECT quantile_cont(lmp_clean, 0.9) AS threshold FROM hourly WHERE ts <= TIMESTAMP '{TRAIN_END}')"""


def r(expression: str, name: str) -> str:
    return f"round({expression} + 3.3e-8, 6) AS {name}"


def metrics(by: list[str], source: str = "long") -> str:
    total = "count(*) * var_pop(y_true)"
    inner = [r("avg(abs(pred - y_true))", "mae"), r("avg((pred - y_true) ** 2)", "mse"), r("sqrt(avg((pred - y_true) ** 2))", "rmse"), f"CASE WHEN {total} > 1e-12 THEN round(1 - sum((pred - y_true) ** 2) / ({total}) + 3.3e-8, 6) END AS r2", r("avg(pred - y_true)", "bias")]
    keys = ", ".join(["model", *by])
    return f"SELECT {keys}, count(*) AS n, {', '.join(inner)} FROM {source} GROUP BY {keys}"


def events_sql(kinds: tuple[str, ...] = EVENT_KINDS) -> str:
    """For every kind: q_, c_ (candidates), s_ (sessions), e_ (events)."""
    parts = []
    for k in kinds:
        marks = ", ".join(f"quantile_cont({c}, {q}) FILTER (WHERE is_{season} = 1) AS {name}" for name, (season, c, q) in QUANTILES[k].items())
        parts.append(f"""q_{k} AS (SELECT {marks} FROM hourly),
c_{k} AS (SELECT hourly.* FROM hourly, q_{k} WHERE {PREDICATES[k]}),
g_{k} AS (SELECT ts, CASE WHEN date_diff('hour', lag(ts) OVER (ORDER BY ts), ts) <= 4 THEN 0 ELSE 1 END AS fresh FROM c_{k}),
n_{k} AS (SELECT ts, sum(fresh) OVER (ORDER BY ts) AS session FROM g_{k}),
s_{k} AS (SELECT min(ts) AS start_utc, max(ts) AS end_utc FROM n_{k} GROUP BY session),
e_{k} AS (SELECT start_utc, end_utc, (date_diff('hour', start_utc, end_utc) + 1)::INTEGER AS duration_hours, printf('{k}_%03d', row_number() OVER (ORDER BY start_utc)) AS event_id FROM s_{k} WHERE date_diff('hour', start_utc, end_utc) + 1 >= {MIN_HOURS[k]})""")
    return ",\n".join(parts)


PREMIUM = """normal AS (SELECT month_local, hour_local, median(lmp_clean) AS normal_lmp FROM hourly GROUP BY ALL),
premium AS (SELECT h.*, normal_lmp, lmp_clean - normal_lmp AS premium FROM hourly h JOIN normal USING (month_local, hour_local))"""


def summary_sql(kind: str = "winter_storm") -> str:
    return f"""{PREMIUM},
summary AS (SELECT event_id, start_utc, end_utc, duration_hours, avg(lmp_clean) AS mean_lmp, max(lmp_clean) AS max_lmp, arg_min(ts, (-lmp_clean, ts)) FILTER (WHERE lmp_clean IS NOT NULL) AS peak_utc,
  avg(premium) AS mean_premium, max(premium) AS max_premium, avg(load_mw_clean) AS mean_load_mw, max(load_mw_clean) AS max_load_mw, avg(temp_c_clean) AS mean_temp_c, min(temp_c_clean) AS min_temp_c, max(temp_c_clean) AS max_temp_c,
  coalesce(sum(precip_1h_mm_clean), 0) AS sum_precip_1h_mm, max(wind_speed_ms_clean) AS max_wind_speed_ms, avg(hdd_clean) AS mean_hdd, avg(cdd_clean) AS mean_cdd
  FROM e_{kind} JOIN premium ON ts BETWEEN start_utc AND end_utc GROUP BY ALL)"""


PHASES = """phase_rows AS (SELECT event_id, unnest(['pre_72h', 'event', 'post_72h']) AS phase, unnest([start_utc - INTERVAL 72 HOUR, start_utc, end_utc + INTERVAL 1 HOUR]) AS phase_start,
  unnest([start_utc - INTERVAL 1 HOUR, end_utc, end_utc + INTERVAL 72 HOUR]) AS phase_end FROM picked),
stats AS (SELECT event_id, phase, phase_start, phase_end, count(*) AS hours, avg(lmp_clean) AS mean_lmp, median(lmp_clean) AS median_lmp, max(lmp_clean) AS max_lmp, avg(load_mw_clean) AS mean_load_mw, max(load_mw_clean) AS max_load_mw,
  avg(temp_c_clean) AS mean_temp_c, min(temp_c_clean) AS min_temp_c, avg(hdd_clean) AS mean_hdd, max(hdd_clean) AS max_hdd, max(wind_speed_ms_clean) AS max_wind_speed_ms, coalesce(sum(precip_1h_mm_clean), 0) AS precip_1h_total_mm
  FROM phase_rows JOIN hourly ON ts BETWEEN phase_start AND phase_end GROUP BY ALL),
uplift AS (SELECT event_id, max(mean_lmp) FILTER (WHERE phase = 'event') - max(mean_lmp) FILTER (WHERE phase = 'pre_72h') AS event_uplift FROM stats GROUP BY event_id),
study AS (SELECT * FROM stats JOIN uplift USING (event_id))"""

_ranks = " UNION ALL ".join(f"SELECT ts, {CONTEXTS.index(k)} AS rank FROM e_{k} JOIN spine ON ts BETWEEN start_utc AND end_utc" for k in EVENT_KINDS)
CONTEXT = f"""ranked AS (SELECT ts, max(rank) AS rank FROM ({_ranks}) GROUP BY ts),
with_context AS (SELECT l.*, ([{", ".join(f"'{c}'" for c in CONTEXTS)}])[coalesce(rank, CASE WHEN month({LOCAL.format("target_ts")}) IN (12, 1, 2, 3) THEN 2 WHEN month({LOCAL.format("target_ts")}) IN (6, 7, 8) THEN 1 ELSE 0 END) + 1] AS context
  FROM long l LEFT JOIN ranked k ON k.ts = l.target_ts)"""
SEASON = f"""with_season AS (SELECT *, CASE WHEN month(lt) IN (6, 7, 8) THEN 'summer' WHEN month(lt) IN (12, 1, 2, 3) THEN 'winter' ELSE 'other' END AS season, (year(lt) + CASE WHEN month(lt) = 12 THEN 1 ELSE 0 END)::INTEGER AS season_year
  FROM (SELECT *, {LOCAL.format("target_ts")} AS lt FROM long))"""


def roc_sql(by: list[str], source: str, joined: str = "") -> str:
    """steps (cumulative counts by falling score) and points (the curve's corners); joined: source with its thresholds."""
    g = ", ".join(by)
    w = f"PARTITION BY {g} ORDER BY pred DESC"
    return f"""scored AS (SELECT *, (y_true >= threshold)::INTEGER AS high FROM {joined or f"{source}, threshold"}),
sums AS (SELECT {g}, pred, sum(high) AS pos, sum(1 - high) AS neg FROM scored GROUP BY {g}, pred),
steps AS (SELECT *, sum(pos) OVER ({w}) AS tp, sum(neg) OVER ({w}) AS fp, sum(pos) OVER (PARTITION BY {g}) AS positives, sum(neg) OVER (PARTITION BY {g}) AS negatives FROM sums),
areas AS (SELECT *, neg * (tp + coalesce(lag(tp) OVER ({w}), 0)) / 2 AS area FROM steps),
auc AS (SELECT {g}, sum(pos + neg)::BIGINT AS n, max(positives)::BIGINT AS positives, max(negatives)::BIGINT AS negatives, CASE WHEN max(positives) > 0 AND max(negatives) > 0 THEN round(sum(area) / (max(positives) * max(negatives)) + 3.3e-8, 6) END AS auc FROM areas GROUP BY {g}),
bends AS (SELECT *, lead(fp) OVER ({w}) - 2 * fp + lag(fp) OVER ({w}) AS b1, lead(tp) OVER ({w}) - 2 * tp + lag(tp) OVER ({w}) AS b2 FROM steps WHERE positives > 0 AND negatives > 0),
corners AS (SELECT {g}, fp / negatives AS fpr, tp / positives AS tpr, pred AS threshold FROM bends WHERE b1 IS NULL OR b1 <> 0 OR b2 <> 0
  UNION ALL SELECT DISTINCT {g}, 0, 0, 'inf'::DOUBLE FROM bends),
points AS (SELECT {g}, (row_number() OVER (PARTITION BY {g} ORDER BY threshold DESC) - 1)::INTEGER AS point, round(fpr + 3.3e-8, 6) AS fpr, round(tpr + 3.3e-8, 6) AS tpr, CASE WHEN threshold < 'inf'::DOUBLE THEN round(threshold + 3.3e-8, 6) END AS threshold FROM corners)"""


#: Several series at once, one for each event type; limits, lags and windows are written out here.
SERIES = f"""WITH unique_hours AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS lmp, avg(user_id::DOUBLE) AS load_mw FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
bounds AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM unique_hours GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM bounds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM grid LEFT JOIN unique_hours USING (event_type, ts)),
edges AS (SELECT *, {fill_parts("lmp", "PARTITION BY event_type")}, {fill_parts("load_mw", "PARTITION BY event_type")} FROM numbered),
filled AS (SELECT event_type, ts, lmp AS lmp_observed, (lmp IS NULL)::INTEGER AS lmp_missing, {fill_value("lmp", 24)} AS lmp_clean, {fill_value("load_mw", 12)} AS load_mw_clean FROM edges)"""
SERIES_FEATURES = f"""{SERIES},
series AS (SELECT event_type, ts, lmp_missing, lmp_clean, load_mw_clean, lag(lmp_clean, 1) OVER w AS lmp_clean_lag_1h, lag(lmp_clean, 168) OVER w AS lmp_clean_lag_168h,
  lag(load_mw_clean, 24) OVER w AS load_mw_clean_lag_24h, CASE WHEN count(lmp_clean) OVER d >= 12 THEN avg(lmp_clean) OVER d END AS lmp_roll_24h_mean,
  CASE WHEN count(lmp_clean) OVER d >= 12 THEN stddev_samp(lmp_clean) OVER d END AS lmp_roll_24h_std, CASE WHEN count(lmp_clean) OVER k >= 72 THEN avg(lmp_clean) OVER k END AS lmp_roll_168h_mean,
  lmp_clean - lag(lmp_clean, 24) OVER w AS lmp_change_24h, lead(lmp_observed, 1) OVER w AS target_lmp_h01, lead(lmp_observed, 24) OVER w AS target_lmp_h24 FROM filled
  WINDOW w AS (PARTITION BY event_type ORDER BY ts), d AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), k AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))"""
SERIES_RUNS = f"""{SERIES},
local_hours AS (SELECT *, month({LOCAL.format("ts")}) AS m, hour({LOCAL.format("ts")}) AS h FROM filled),
normal AS (SELECT event_type, m, h, median(lmp_clean) AS normal_lmp FROM local_hours GROUP BY ALL),
high AS (SELECT event_type, ts FROM local_hours JOIN normal USING (event_type, m, h) WHERE lmp_clean - normal_lmp > 1),
begun AS (SELECT *, CASE WHEN date_diff('hour', lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts) <= 2 THEN 0 ELSE 1 END AS new FROM high),
joined AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS run FROM begun),
spans AS (SELECT event_type, min(ts) AS start_utc, max(ts) AS end_utc, date_diff('hour', min(ts), max(ts)) + 1 AS duration_hours FROM joined GROUP BY event_type, run),
runs AS (SELECT *, printf('high_%03d', row_number() OVER (PARTITION BY event_type ORDER BY start_utc)) AS event_id FROM spans WHERE duration_hours >= 3)"""


# Controls, states and penalty of the state-space models, written out once more.
CONTROL_COLUMNS = ["sin_hour", "cos_hour", "sin_dow", "cos_dow", "sin_month", "cos_month", "is_weekend", "is_summer", "is_winter"]
STATE_COLUMNS = {
    "dmdc": ["lmp_clean", "congestion_clean", "marginal_loss_clean", "load_mw_clean", "temp_c_clean", "hdd_clean", "cdd_clean", "wind_speed_ms_clean"],
    "dmdc_residual_24h": ["lmp_change_24h", "load_mw_change_24h", "temp_c_change_24h", "hdd_change_24h", "cdd_change_24h"],
}
PENALTY = 1e-6


def fit_sql(tag: str, model: str, train_end: str, source: str = "hourly") -> str:
    """The fit in plain SQL: rows standardised, products summed, and the penalised normal equations solved by
    elimination; m_<tag> has means and deviations, a_<tag> the rows [identity, coefficients]."""
    columns = [*STATE_COLUMNS[model], *CONTROL_COLUMNS]
    s, w = len(STATE_COLUMNS[model]), len(columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""v_{tag} AS MATERIALIZED (SELECT ts, [{", ".join(columns)}]::DOUBLE[] AS v FROM {source} WHERE ts <= TIMESTAMP '{train_end}' AND {known}),
m_{tag} AS MATERIALIZED (SELECT list(mean ORDER BY i) AS mean, list(scale ORDER BY i) AS scale FROM (SELECT i, avg(v[i]) AS mean, CASE WHEN stddev_pop(v[i]) > 0 THEN stddev_pop(v[i]) ELSE 1 END AS scale FROM v_{tag}, range(1, {w + 1}) r(i) GROUP BY i)),
z_{tag} AS MATERIALIZED (SELECT z, lead(z) OVER (ORDER BY ts) AS y FROM (SELECT ts, list_transform(range(1, {w + 1}), lambda i: (v[i] - mean[i]) / scale[i]) AS z FROM v_{tag}, m_{tag})),
g_{tag} AS MATERIALIZED (SELECT i, list(value ORDER BY j) AS r FROM (SELECT i, j, sum(z[i] * (CASE WHEN j <= {w} THEN z[j] ELSE y[j - {w}] END)) + (CASE WHEN i = j THEN {PENALTY} ELSE 0 END) AS value FROM z_{tag}, range(1, {w + 1}) a(i), range(1, {w + s + 1}) b(j) WHERE y IS NOT NULL GROUP BY i, j) GROUP BY i),
x_{tag} AS (SELECT 0 AS k, list(r ORDER BY i) AS a FROM g_{tag} UNION ALL SELECT k + 1, list_transform(a, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda q: q / a[k + 1][k + 1])
  ELSE list_transform(range(1, {w + s + 1}), lambda j: r[j] - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END) FROM x_{tag} WHERE k < {w}),
a_{tag} AS MATERIALIZED (SELECT a FROM x_{tag} WHERE k = {w})"""


def forecast_sql(tag: str, model: str, origins: str, horizon: int = 24) -> str:
    """f_<tag> (origin_ts, horizon, value): the recursion step by step over the rows of `origins`, which has the states."""
    states = STATE_COLUMNS[model]
    s, w = len(states), len(states) + len(CONTROL_COLUMNS)
    controls = f"[{', '.join(CONTROL_COLUMNS)}]::DOUBLE[]"
    return f"""s_{tag} AS (SELECT ts AS origin_ts, 0 AS h, list_transform(range(1, {s + 1}), lambda i: (v[i] - mean[i]) / scale[i]) AS x FROM (SELECT ts, [{", ".join(states)}]::DOUBLE[] AS v FROM {origins}), m_{tag}
  UNION ALL SELECT origin_ts, h + 1, list_transform(range(1, {s + 1}), lambda j: list_sum(list_transform(range(1, {w + 1}), lambda i: a[i][{w} + j] * (CASE WHEN i <= {s} THEN x[i] ELSE (u[i - {s}] - mean[i]) / scale[i] END))))
  FROM s_{tag} JOIN (SELECT ts AS at_ts, {controls} AS u FROM cal) ON at_ts = origin_ts + to_hours((h + 1)::INTEGER), a_{tag}, m_{tag} WHERE h < {horizon}),
f_{tag} AS (SELECT origin_ts, h AS horizon, x[1] * scale[1] + mean[1] AS value FROM s_{tag}, m_{tag} WHERE h > 0)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def all_forecasts_sql() -> str:
    """table_4: the fanned-out origins with all four forecasts."""
    fits = ",\n".join(f"{fit_sql(m, m, TRAIN_END)},\n{forecast_sql(m, m, 'origins')}" for m in STATE_COLUMNS)
    return f"""{recursive(predictions_sql())},
{fits},
table_4 AS MATERIALIZED (SELECT p.*, a.value AS dmdc, seasonal_naive_24h + b.value AS dmdc_residual_24h FROM predictions p
  LEFT JOIN f_dmdc a USING (origin_ts, horizon) LEFT JOIN f_dmdc_residual_24h b USING (origin_ts, horizon)),
long_4 AS (SELECT * FROM (UNPIVOT (SELECT origin_ts, target_ts, split, horizon, y_true, seasonal_naive_24h, seasonal_naive_168h, dmdc, dmdc_residual_24h FROM table_4)
  ON seasonal_naive_24h, seasonal_naive_168h, dmdc, dmdc_residual_24h INTO NAME model VALUE pred) WHERE y_true IS NOT NULL)"""


def all_folds_sql(folds_sql: str, folds: tuple) -> str:
    """folds_4: the folds' fanned-out origins with all four forecasts, each fold fitted anew on the hours up to its end."""
    parts, tables = [], []
    for name, train_end, *_ in folds:
        first = f"(SELECT min(ts) FROM o_{name})"
        parts.append(f"h_{name} AS (SELECT * FROM o_{name} WHERE date_diff('hour', {first}, ts) % 6 = 0)")
        parts += [f"{fit_sql(f'{m}_{name}', m, train_end)},\n{forecast_sql(f'{m}_{name}', m, f'h_{name}')}" for m in STATE_COLUMNS]
        tables.append(f"""SELECT f.*, c.lmp_clean AS seasonal_naive_168h, a.value AS dmdc, f.seasonal_naive_24h + b.value AS dmdc_residual_24h FROM folds f LEFT JOIN clean c ON c.ts = f.target_ts - INTERVAL 168 HOUR
  LEFT JOIN f_dmdc_{name} a USING (origin_ts, horizon) LEFT JOIN f_dmdc_residual_24h_{name} b USING (origin_ts, horizon) WHERE f.fold = '{name}'""")
    joined = ",\n".join(parts)
    return f"""{recursive(folds_sql)},
{joined},
folds_4 AS MATERIALIZED ({" UNION ALL ".join(tables)}),
folds_long_4 AS (SELECT * FROM (UNPIVOT (SELECT origin_ts, target_ts, fold, horizon, y_true, seasonal_naive_24h, seasonal_naive_168h, dmdc, dmdc_residual_24h FROM folds_4)
  ON seasonal_naive_24h, seasonal_naive_168h, dmdc, dmdc_residual_24h INTO NAME model VALUE pred) WHERE y_true IS NOT NULL)"""


def keyed_predictions_sql(step: int, train_end: str) -> str:
    """Origins of every event type, fanned out, with naive forecasts, errors of the daily one, and thresholds by type."""
    past = " AND ".join(f"lag({m}, 168) OVER w IS NOT NULL" for m in ("lmp_clean", "load_mw_clean"))
    return f"""{SERIES_FEATURES},
open_hours AS (SELECT event_type, ts FROM (SELECT *, {past} AND count(lmp_clean) OVER k >= 72 AND count(CASE WHEN lmp_missing = 0 THEN 1 END) OVER n = 24 AS ok FROM series
  WINDOW w AS (PARTITION BY event_type ORDER BY ts), k AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) WHERE ok),
origins AS (SELECT event_type, ts FROM open_hours JOIN (SELECT event_type, min(ts) AS first FROM open_hours GROUP BY 1) USING (event_type) WHERE date_diff('hour', first, ts) % {step} = 0),
predictions AS (SELECT o.event_type, o.ts AS origin_ts, o.ts + to_hours(h::INTEGER) AS target_ts, h::INTEGER AS horizon, y.lmp_observed AS y_true, a.lmp_clean AS seasonal_naive_24h, b.lmp_clean AS seasonal_naive_168h
  FROM origins o CROSS JOIN range(1, 25) r(h) LEFT JOIN filled y ON y.event_type = o.event_type AND y.ts = o.ts + to_hours(h::INTEGER)
  LEFT JOIN filled a ON a.event_type = o.event_type AND a.ts = o.ts + to_hours(h::INTEGER) - INTERVAL 24 HOUR LEFT JOIN filled b ON b.event_type = o.event_type AND b.ts = o.ts + to_hours(h::INTEGER) - INTERVAL 168 HOUR),
long AS (SELECT * FROM (SELECT *, unnest(['seasonal_naive_24h', 'seasonal_naive_168h']) AS model, unnest([seasonal_naive_24h, seasonal_naive_168h]) AS pred FROM predictions) WHERE pred IS NOT NULL AND y_true IS NOT NULL),
errors AS (SELECT *, y_true AS actual, seasonal_naive_24h AS predicted, seasonal_naive_24h - y_true AS error, abs(seasonal_naive_24h - y_true) AS abs_error FROM predictions WHERE seasonal_naive_24h IS NOT NULL AND y_true IS NOT NULL),
threshold AS (SELECT event_type, quantile_cont(lmp_clean, 0.9) AS threshold FROM filled WHERE ts <= TIMESTAMP '{train_end}' GROUP BY 1)"""
