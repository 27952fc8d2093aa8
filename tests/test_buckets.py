"""Bucketed forms against the window forms and plain Python, over series that cross many buckets."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import buckets, clean, dmdc, evaluate, events, features, origins, quantiles, seasons
from hourgrid.sources.tables import staged

T0 = datetime(1969, 12, 28)  # buckets on both sides of hour 0
SHORT = 50


def series(spark, values, name="v", zone=None):
    rows = [(zone, T0 + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"zone string, ts timestamp_ntz, {name} double")


def shown(df):
    rows = df.select(*sorted(df.columns)).collect()
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def unpartitioned(df, order="ts"):
    """Windows over the whole series in the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and f"], [{order}#" in line and line.count("], [") < 2]


@pytest.mark.parametrize("limit", [1, 6, 24])
@pytest.mark.parametrize("hours", [7, SHORT])
def test_gaps_that_cross_buckets(spark, limit, hours):
    r = np.random.default_rng(limit)
    values = [None if 60 <= i < 290 or 400 <= i < 430 or r.random() < 0.5 else float(round(r.normal(), 3)) for i in range(600)]
    values[:30] = values[-45:] = [None] * 45
    got = buckets.fill_gaps(series(spark, values), {"v": limit}, hours=hours).orderBy("ts").toPandas()["v_clean"]
    want = pd.Series(values, pd.date_range(T0, periods=len(values), freq="h"), dtype=float).interpolate("time", limit=limit, limit_direction="both").ffill().bfill()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), atol=1e-9)


def test_gaps_of_several_series(spark):
    both = series(spark, [1, None, None, 4] * 40 + [None] * 200 + [9], zone="a").unionByName(series(spark, [None] * 120, zone="b")).unionByName(series(spark, [None, 2] * 90, zone=None))
    got = buckets.fill_gaps(both, {"v": 2}, ("zone",), hours=SHORT)
    assert shown(got) == shown(clean.fill_gaps(both, {"v": 2}, ("zone",)))
    assert buckets.fill_gaps(both.where("false"), {"v": 2}, ("zone",)).count() == 0


def table(spark, n=700, seed=1):
    r = np.random.default_rng(seed)
    rows = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range(T0, periods=n, freq="h"), **{m: r.normal(20, 9, n) for m in features.STATES}, "gap": r.random(n)}))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("lmp", F.when(F.col("gap") > 0.02, F.col("lmp"))).drop("gap")
    return staged(clean.clean(rows))


def test_features_by_buckets(spark):
    rows = table(spark)
    got = buckets.over_buckets(rows, features.features, 168, 24, hours=200)
    assert shown(got) == shown(features.features(rows)) and not unpartitioned(got) and unpartitioned(features.features(rows))
    with pytest.raises(ValueError, match="larger buckets"):
        buckets.over_buckets(rows, features.features, 168, 24, hours=100)


@pytest.mark.parametrize("hours", [9, 64, 4096])
def test_sessions_across_borders(spark, hours):
    r = random.Random(hours)
    at = sorted({h for start in r.sample(range(3000), 60) for h in range(start, start + r.choice([1, 3, 40, 200]), r.choice([1, 2, 4, 5]))})
    found = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in at] + [("b", T0 + timedelta(hours=h)) for h in at[::3]], "zone string, ts timestamp_ntz").repartition(5)
    plain = events.numbered(events.sessions(found, 3, ("zone",)), "e", 6, ("zone",))
    got = events.numbered(buckets.sessions(found, 3, ("zone",), hours), "e", 6, ("zone",), hours)
    assert shown(got) == shown(plain) and got.count() > 10
    alone = found.where("zone = 'a'").drop("zone")
    assert shown(buckets.sessions(alone, 3, hours=hours)) == shown(events.sessions(alone, 3)) and not unpartitioned(buckets.sessions(alone, 3, hours=hours))
    assert buckets.sessions(found.where("false"), 3, ("zone",)).count() == 0


def test_origins_first_equals_lags_and_leads(spark):
    rows = table(spark, 900, 2)
    wide = features.supervised(features.features(rows), "1970-01-10 00:00:00", "1970-01-20 00:00:00")
    open_hours = buckets.over_buckets(rows, lambda df, keys: origins.choosable(df, keys=keys), 168, 24, hours=200)
    assert shown(open_hours.select("ts")) == shown(wide.select("ts")) and 0 < wide.count() < 700
    chosen = staged(wide.select("ts", "split").where(F.hour("ts") == 5))
    got = origins.fan_out(chosen, rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and "lag(" not in plan
    prices = {x.ts: (x.lmp_observed, x.lmp_clean) for x in rows.collect()}
    want = [(o.ts, o.ts + timedelta(hours=h), o.split, h) for o in chosen.collect() for h in range(1, 25)]
    none = (None, None)
    want = [(o, t, s, h, prices.get(t, none)[0], prices.get(t - timedelta(hours=24), none)[1], prices.get(t - timedelta(hours=168), none)[1]) for o, t, s, h in want]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("method", ["percentile", "ranges"])
def test_quantiles_of_many_groups(spark, method):
    r = random.Random(3)
    rows = [(g, k, float(r.choice([0, 1, 5, 7.5, r.random()])) if r.random() < 0.9 else None) for g in ["a", "b", None, "one"] for k in (1, 2) for _ in range(1 if g == "one" else 200)]
    rows += [("hot", 1, 3.0)] * 900 + [("hot", 1, 4.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(6)
    wanted = {"low": ("v", 0.1), "middle": ("v", 0.5), "high": (F.when(F.col("v") > 1, F.col("v")), 0.9), "top": ("v", 1.0)}
    got = {(x.g, x.k): tuple(x)[2:] for x in quantiles.quantile_table(df, ["g", "k"], wanted, method).collect()}
    assert set(got) == {row[:2] for row in rows}
    for key, found in got.items():
        mine = [v for g, k, v in rows if (g, k) == key and v is not None]
        over = [v for v in mine if v > 1]
        want = [np.quantile(x, q) if x else None for x, q in ((mine, 0.1), (mine, 0.5), (over, 0.9), (mine, 1.0))]
        assert found == pytest.approx(want)
    assert tuple(quantiles.quantile_table(df, [], {"m": ("v", 0.5)}, method).first()) == pytest.approx((np.quantile([v for *_, v in rows if v is not None], 0.5),))
    assert quantiles.quantile_table(df.where("false"), [], {"m": ("v", 0.5)}, method).first().m is None
    assert quantiles.quantile_table(df.where("false"), ["g"], {"m": ("v", 0.5)}, method).count() == 0


def test_near_quantiles_have_to_be_asked_for(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    assert abs(quantiles.quantile_table(df, [], {"m": ("v", 0.9)}, "approx").first().m - 9000) <= 2
    with pytest.raises(ValueError, match="none of"):
        quantiles.quantile_table(df, [], {"m": ("v", 0.9)}, "guess")


def test_thresholds_of_series_do_not_meet(spark):
    long = spark.createDataFrame([("a", 5.0), ("b", 50.0), ("b", 200.0), ("c", 1.0)], "zone string, y_true double")
    marks = spark.createDataFrame([("a", 4.5), ("b", 104.5)], "zone string, threshold double")
    assert {(r.zone, r.y_true): r.high for r in evaluate.labelled(long, marks, ("zone",)).collect()} == {("a", 5.0): 1, ("b", 50.0): 0, ("b", 200.0): 1, ("c", 1.0): None}
    assert [r.high for r in evaluate.labelled(long, marks.limit(1)).orderBy("y_true").collect()] == [0, 1, 1, 1]
    with pytest.raises(Exception, match="(?i)more than one row"):
        evaluate.labelled(long, marks).collect()


def test_views_by_series(spark):
    """Replays, running errors, lenses and yearly tables of two series at once are those of each alone."""
    r = np.random.default_rng(4)
    rows = [(z, T0 + timedelta(hours=o), T0 + timedelta(hours=o + h), h, float(r.normal(k, 5)), float(r.normal(k, 5))) for k, z in ((10, "a"), (90, "b")) for o in range(0, 240, 24) for h in range(1, 25)]
    table_ = spark.createDataFrame(rows, "zone string, origin_ts timestamp_ntz, target_ts timestamp_ntz, horizon int, y_true double, m double")
    errors = evaluate.forecast_errors(table_, "m")
    year = spark.createDataFrame([(z, T0 + timedelta(hours=i), float(r.normal(k, 5))) for k, z in ((10, "a"), (90, "b")) for i in range(300)], "zone string, ts timestamp_ntz, lmp_clean double")
    for c in ("load_mw", "temp_c", "hdd", "cdd", "wind_speed_ms", "precip_1h_mm"):
        year = year.withColumn(f"{c}_clean", F.col("lmp_clean"))
    year = features.add_calendar(year)
    for df, f in ((errors, evaluate.replay_summary), (errors, evaluate.cumulative_error), (errors, evaluate.stress_lens), (errors, seasons.daily_forecast_means), (year, seasons.winter_yearly), (year, evaluate.price_threshold)):
        wanted = [x for z in ("a", "b") for x in shown(f(df.where(F.col("zone") == z)).withColumn("zone", F.lit(z)))]
        got = f(df, keys=("zone",))
        assert shown(got) == sorted(wanted, key=str) and got.where("zone = 'b'").count() > 0


def system(n, seed):
    r = np.random.default_rng(seed)
    x, u = np.zeros((n, 2)), r.normal(size=(n, 1))
    for t in range(n - 1):
        x[t + 1] = x[t] @ np.array([[0.8, 0.1], [-0.2, 0.7]]) + u[t] @ np.array([[0.5, 0.3]]) + r.normal(size=2) * 0.05
    return x + seed, u


def plain_fit(x, u):
    """Scaler and coefficients of complete rows, each with the next complete one."""
    both = np.hstack([x, u])
    both = both[~np.isnan(both).any(axis=1)]
    mean, scale = both.mean(0), np.where(both.std(0) > 0, both.std(0), 1)
    z = (both - mean) / scale
    return mean, scale, np.linalg.pinv(z[:-1].T @ z[:-1] + 1e-6 * np.eye(3)) @ z[:-1].T @ z[1:, :2]


def recursed(fit, state, control):
    mean, scale, found = fit
    out, s = [], (state - mean[:2]) / scale[:2]
    for u in control:
        s = np.hstack([s, (u - mean[2:]) / scale[2:]]) @ found
        out.append(s[0] * scale[0] + mean[0])
    return out


MODEL = {"m": ("s0", "s1")}


def test_fits_and_forecasts_by_series_and_fold(spark):
    """Every series and fold as NumPy fits it from its own rows, with gaps and over buckets; forecasts as the recursion."""
    n, zones, parts, known = 220, 12, [], {}
    for k in range(zones):
        x, u = system(n, k)
        x[40:47, 0] = x[90, 1] = np.nan
        known[f"z{k}"] = x, u
        parts.append(pd.DataFrame({"zone": f"z{k}", "ts": pd.date_range(T0, periods=n, freq="h"), "s0": x[:, 0], "s1": x[:, 1], "c0": u[:, 0]}))
    ends = {"first": 99, "second": 150, "all": 10_000}
    hours = spark.createDataFrame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("s0", "s1")}).repartition(5)
    names = {f: str(T0 + timedelta(hours=h)) for f, h in ends.items()}
    fitted = dmdc.fit(hours, MODEL, names, controls=("c0",), keys=("zone",), bucket_hours=30).cache()
    rows = {(r.zone, r.fold): r for r in fitted.collect()}
    assert len(rows) == zones * 3
    for (zone, fold), row in rows.items():
        x, u = known[zone]
        mean, scale, found = plain_fit(x[: ends[fold] + 1], u[: ends[fold] + 1])
        np.testing.assert_allclose(np.hstack([np.reshape(row.a, (2, 2)), np.reshape(row.b, (2, 1))]).T, found, atol=1e-8)
        np.testing.assert_allclose([row.mean, row.scale], [mean, scale], atol=1e-9)
    chosen = hours.where(F.col("ts").isin([T0 + timedelta(hours=h) for h in (42, 100, 160)])).withColumn("fold", F.lit("second"))
    control = {"c0": F.sin(buckets.hour_number(F.col("target_ts")))}
    got = dmdc.forecast(fitted, chosen, MODEL, control, by=("zone", "fold")).collect()
    assert len(got) == zones * 3 * 24 and "Python" not in dmdc.forecast(fitted, chosen, MODEL, control, by=("zone", "fold"))._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    by = {(r.zone, r.origin_ts, r.horizon): r.m for r in got}
    start = int((T0 - datetime(1970, 1, 1)) / timedelta(hours=1))
    for zone, (x, u) in known.items():
        fit = plain_fit(x[:151], u[:151])
        for h in (100, 160):
            want = recursed(fit, x[h], [np.array([np.sin(start + h + k)]) for k in range(1, 25)])
            np.testing.assert_allclose([by[zone, T0 + timedelta(hours=h), k] for k in range(1, 25)], want, atol=1e-7)
        assert all(by[zone, T0 + timedelta(hours=42), k] is None for k in range(1, 25))  # an unknown state


def test_thousands_of_series_without_the_driver(spark, monkeypatch):
    """One row for each of 2000 series; sums leave the tasks in groups, and nothing is collected while planning."""
    monkeypatch.setattr(dmdc, "GROUPS", 50)
    rows = spark.range(2000 * 12).select((F.col("id") % 2000).alias("zone"), F.timestamp_add("HOUR", F.floor(F.col("id") / 2000), F.lit(T0).cast("timestamp_ntz")).alias("ts"), *[F.rand(k).alias(c) for k, c in enumerate(("s0", "s1", "c0"))])
    fitted = dmdc.fit(rows, MODEL, {"all": "2000-01-01 00:00:00"}, controls=("c0",), keys=("zone",))
    found = fitted.agg(F.count("*"), F.count_distinct("zone"), F.sum("pairs")).first()
    assert tuple(found) == (2000, 2000, 2000 * 11)


def test_no_hours_no_fit(spark):
    hours = spark.createDataFrame([(T0, None, 1.0, 1.0)], "ts timestamp_ntz, s0 double, s1 double, c0 double")
    fitted = dmdc.fit(hours, MODEL, {"all": "2000-01-01 00:00:00"}, controls=("c0",))
    got = dmdc.forecast(fitted, hours, MODEL, {"c0": F.lit(1.0)}).collect()
    assert fitted.count() == 0 and len(got) == 24 and all(r.m is None for r in got)
