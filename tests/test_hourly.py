"""Small tables with known answers, and comparisons with pandas and NumPy."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid.functions.columns import local, season_year
from hourgrid.operators import clean, evaluate, events, features, origins, quantiles
from hourgrid.sources import tables

T0 = datetime(2024, 1, 1)


def hours(spark, values, name="v"):
    rows = [(T0 + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ts timestamp_ntz, {name} double")


@pytest.mark.parametrize(
    "values, limit, expected",
    [
        ([0, None, None, None, None, 10], 1, [0, 2, 2, 2, 8, 10]),
        ([0, None, None, None, None, 10], 2, [0, 2, 4, 6, 8, 10]),
        ([None, None, 3, None, None], 1, [3, 3, 3, 3, 3]),
        ([None, None], 1, [None, None]),
    ],
)
def test_fill_gaps(spark, values, limit, expected):
    got = clean.fill_gaps(hours(spark, values), {"v": limit}).orderBy("ts").toPandas()["v_clean"]
    assert [None if np.isnan(x) else round(x, 9) for x in got] == expected


def test_fill_gaps_as_pandas(spark):
    random = np.random.default_rng(3)
    values = [None if random.random() < 0.6 else float(round(random.normal(), 3)) for _ in range(300)]
    got = clean.fill_gaps(hours(spark, values), {"v": 3}).orderBy("ts").toPandas()["v_clean"]
    index = pd.date_range(T0, periods=300, freq="h")
    want = pd.Series(values, index, dtype=float).interpolate("time", limit=3, limit_direction="both").ffill().bfill()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-9)


def test_alignment_by_union_equals_joins(spark):
    a = hours(spark, [1, 2, None, 4, 5], "a").unionByName(hours(spark, [3], "a"))
    b = hours(spark, [9, 8, 7, 6], "b").where("ts > TIMESTAMP_NTZ'2024-01-01 00:30:00'")
    feeds = [(a, ["a"]), (b, ["b"])]
    joined = clean.join_sources(clean.hourly_spine(feeds), feeds).orderBy("ts").collect()
    assert joined == clean.align(feeds).select("ts", "a", "b").orderBy("ts").collect()
    assert [r.a for r in joined] == [2.0, None, 4.0]


def test_sessions_and_numbers(spark):
    found = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in (0, 4, 8, 13)], "ts timestamp_ntz")
    runs = events.sessions(found, 3)
    assert runs.count() == 2
    (event,) = events.numbered(runs, "e", 6).collect()
    assert (event.event_id, event.duration_hours) == ("e_001", 9)


def test_rolling_needs_values(spark):
    rows = hours(spark, range(1, 14), "lmp_clean")
    for c in ("load_mw_clean", "temp_c_clean"):
        rows = rows.withColumn(c, F.col("lmp_clean"))
    got = features.add_rolling(rows).orderBy("ts").toPandas()["lmp_roll_24h_mean"]
    assert np.isnan(got[11]) and got[12] == 6.5


def _scored(spark, scores, labels):
    return spark.createDataFrame([("m", float(s), y) for s, y in zip(scores, labels)], "model string, pred double, high int")


def test_auc(spark):
    (row,) = evaluate.roc_auc(_scored(spark, [1, 1, 0], [1, 0, 0]), ["model"]).collect()
    assert row.auc == 0.75
    one = _scored(spark, [1, 2], [0, 0])
    assert evaluate.roc_auc(one, ["model"]).count() == 0
    assert evaluate.roc_auc(one, ["model"], keep_one_class=True).first().auc is None


def test_roc_corners(spark):
    points = evaluate.roc_curve(_scored(spark, [5, 4, 3, 2, 1], [1, 1, 1, 0, 0]), ["model"]).orderBy("point").collect()
    assert [(p.fpr, round(p.tpr, 6)) for p in points] == [(0.0, 0.0), (0.0, 0.333333), (0.0, 1.0), (1.0, 1.0)]


def test_r2_is_null_for_constant_actuals(spark):
    long = spark.createDataFrame([("m", 1.0, 1.0), ("m", 1.0, 2.0)], "model string, y_true double, pred double")
    assert evaluate.regression_metrics(long, []).first().r2 is None


def test_local_time_and_season_year(spark):
    row = spark.range(1).select(local(F.lit(datetime(2024, 7, 1, 3)).cast("timestamp_ntz")).alias("x"), season_year(F.lit(2023), F.lit(12)).alias("y")).first()
    assert row.x == datetime(2024, 6, 30, 23) and row.y == 2024


def test_origin_sampling(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 4),), (datetime(2024, 1, 1, 5),), (datetime(2024, 1, 2, 4),)], "ts timestamp_ntz")
    assert [r.ts.hour for r in origins.sample_origins(rows, 24).orderBy("ts").collect()] == [4, 4]


def test_stronger_context_covers(spark):
    one = spark.createDataFrame([("e_001", T0, T0)], "event_id string, start_utc timestamp_ntz, end_utc timestamp_ntz")
    ranked = events.context_hours(hours(spark, [1]), {"winter_storm": one, "winter_cold_wave": one})
    predictions = spark.createDataFrame([(T0,), (T0 + timedelta(hours=9),)], "target_ts timestamp_ntz")
    assert [r.context for r in events.label_context(predictions, ranked).orderBy("target_ts").collect()] == ["winter_cold_wave", "winter_all"]


def test_phases_at_the_first_hour(spark):
    rows = hours(spark, range(10), "lmp_clean")
    for c in ("load_mw_clean", "temp_c_clean", "hdd_clean", "wind_speed_ms_clean", "precip_1h_mm_clean"):
        rows = rows.withColumn(c, F.col("lmp_clean"))
    event = spark.createDataFrame([("e_001", T0, T0 + timedelta(hours=5))], "event_id string, start_utc timestamp_ntz, end_utc timestamp_ntz")
    study = events.event_uplift(events.phase_stats(rows, event)).collect()
    assert {r.phase for r in study} == {"event", "post_72h"} and all(r.event_uplift is None for r in study)


def test_reports_and_bad_numbers(spark, tmp_path):
    absent = tables.read_report(spark, str(tmp_path / "absent"), "origin_ts timestamp_ntz, n int")
    assert absent.columns == ["origin_ts", "n"] and absent.count() == 0
    rows = tables.coerce_numeric(spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string"), ["v", "w"])
    assert [r.v for r in rows.collect()] == [1.5, None, None, None]


def scored_rows(n, seed=1):
    r = random.Random(seed)
    return [(m, s, float(r.randint(0, 40)), int(r.random() < 0.3)) for m in ("a", "b") for s in ("x", None) for _ in range(n)]


def test_roc_over_many_ranges_equals_plain_python(spark):
    rows = scored_rows(120) + [("one", "x", 1.0, 1)]
    scored = spark.createDataFrame(rows, "model string, split string, pred double, high int").repartition(7)
    auc = {(r.model, r.split): r for r in evaluate.roc_auc(scored, ["model", "split"], keep_one_class=True).collect()}
    curve = evaluate.roc_curve(scored, ["model", "split"]).collect()
    for key in {r[:2] for r in rows}:
        mine = [r[2:] for r in rows if r[:2] == key]
        pos, neg = [p for p, h in mine if h], [p for p, h in mine if not h]
        got = auc[key]
        assert (got.n, got.positives, got.negatives) == (len(mine), len(pos), len(neg))
        if not neg:
            assert got.auc is None
            continue
        assert got.auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
        full = [(0, 0)] + [(sum(q >= t for q in neg), sum(p >= t for p in pos)) for t in sorted({p for p, _ in mine}, reverse=True)]
        bent = [k for k in range(len(full)) if k in (0, 1, len(full) - 1) or any(full[k + 1][i] - 2 * full[k][i] + full[k - 1][i] for i in (0, 1))]
        points = sorted((r.point, round(r.fpr * len(neg)), round(r.tpr * len(pos))) for r in curve if (r.model, r.split) == key)
        assert points == [(i, *full[k]) for i, k in enumerate(bent)]
    assert evaluate.roc_auc(scored.limit(0), ["model", "split"]).count() == 0 and evaluate.roc_curve(scored.limit(0), ["model"]).count() == 0


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [5.0] * 9, [None, *map(float, range(100, 0, -1))]])
def test_quantiles_equal_interpolation(spark, values):
    qs = [0.0, 0.4, 0.6, 0.9, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    known = [v for v in values if v is not None]
    got = list(quantiles.quantile_table(rows, [], {f"q{i}": ("v", q) for i, q in enumerate(qs)}, "ranges").first())
    assert got == [None] * 5 if not known else got == pytest.approx(np.quantile(known, qs).tolist())


def test_times_do_not_follow_the_session_zone(spark, tmp_path):
    path, zone = f"file://{tmp_path}", spark.conf.get("spark.sql.session.timeZone")
    (tmp_path / "feed.csv").write_text("at,lmp\n2023-03-12 02:30:00,1.5\n2023-11-05 01:00:00,bad\n")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        spark.sql("SELECT TIMESTAMP '2023-03-12 02:30:00 UTC' AS ts").write.parquet(f"{path}/table")
        feed = tables.read_hourly_csv(spark, f"{path}/feed.csv", "at", ["lmp"]).orderBy("ts").collect()
        assert [(str(r.ts), r.lmp) for r in feed] == [("2023-03-12 02:30:00", 1.5), ("2023-11-05 01:00:00", None)]
        assert str(tables.read_table(spark, f"{path}/table").first().ts) == "2023-03-12 02:30:00"
        report = tables.read_report(spark, f"{path}/feed.csv", "")
        assert "at" in report.columns
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dataset_is_written_in_both_forms(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2023, 1, 1, h), float(h) if h else None, "train" if h < 3 else "test") for h in range(5)], "ts timestamp_ntz, y double, split string")
    tables.write_dataset(rows.drop("split"), rows, f"file://{tmp_path}/out")
    for form in ("parquet", "csv"):
        found = tables.read_dataset(spark, f"file://{tmp_path}/out", "hourly", form, "ts timestamp_ntz, y double")
        parts = tables.read_dataset(spark, f"file://{tmp_path}/out", "supervised", form, "ts timestamp_ntz, y double, split string")
        assert {(r.ts, r.y) for r in found.collect()} == {(r.ts, r.y) for r in rows.collect()}
        assert {(r.ts, r.y, r.split) for r in parts.collect()} == {(r.ts, r.y, r.split) for r in rows.collect()}


def test_values_of_the_twins_written_out():
    """The SQL twins share these values with the Spark side, so they are stated here once more."""
    assert clean.FILL_LIMITS["lmp"] == clean.FILL_LIMITS["congestion"] == clean.FILL_LIMITS["marginal_loss"] == 24
    assert clean.FILL_LIMITS["load_mw"] == 12 and {clean.FILL_LIMITS[c] for c in ("temp_c", "dewpoint_c", "rh_pct", "wind_speed_ms", "slp_hpa", "cdd", "hdd", "n_stations")} == {6}
    assert features.LAGS["lmp"] == (1, 24, 48, 168) and {features.LAGS[m] for m in ("load_mw", "temp_c", "hdd", "cdd")} == {(1, 24, 168)}
    assert {n: x[:3] for n, x in features.ROLLS.items()} == {
        "lmp_roll_24h_mean": ("lmp", 24, 12), "lmp_roll_24h_std": ("lmp", 24, 12), "lmp_roll_168h_mean": ("lmp", 168, 72),
        "load_roll_24h_mean": ("load_mw", 24, 12), "temp_roll_24h_mean": ("temp_c", 24, 12),
    }
    assert len(features.targets()) == 24


def test_series_with_keys_do_not_meet(spark):
    """Two series in one run give what each gives alone; an empty table gives an empty one."""
    names = [*features.STATES]
    values = {"a": [1.0, None, None, 4.0, *map(float, range(30))], "b": [10.0 * i for i in range(40)]}
    rows = [(key, i, *[v] * 5) for key, series in values.items() for i, v in enumerate(series) if v is not None]
    schema = "zone string, i int, " + ", ".join(f"{m} double" for m in names)
    feed = spark.createDataFrame(rows, schema).selectExpr("zone", "timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(0, i) AS ts", *names)

    def run(df, keys):
        out = features.features(clean.clean(clean.align([(df, names)], keys), keys), keys)
        return sorted(map(tuple, out.select("ts", "lmp_clean", "lmp_clean_lag_24h", "lmp_roll_24h_mean", "target_lmp_h01", "load_mw_change_24h").collect()))

    alone = sorted(row for key in values for row in run(feed.where(feed.zone == key), ()))
    together = run(feed, ("zone",))
    assert str(together) == str(alone) and len(together) == 74
    assert run(feed.where("false"), ("zone",)) == run(feed.where("false"), ()) == []
