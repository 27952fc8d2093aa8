"""Linear state-space forecasts (DMD with control): x(t+1) = A x(t) + B u(t) on standardised rows.

Fits are tables: sums by series and period, merged over periods, and one small solve for each series and fold on the
executors. Forecasts are dot products with the fit's responses; no Python runs there."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import plus_hours
from hourgrid.operators.buckets import HOURS, beside, next_complete
from hourgrid.operators.features import HORIZON, STATES
from hourgrid.operators.origins import controls_at

# Controls, states and penalty of the two models.
CONTROLS = ("sin_hour", "cos_hour", "sin_dow", "cos_dow", "sin_month", "cos_month", "is_weekend", "is_summer", "is_winter")
FULL_STATES = ("lmp_clean", "congestion_clean", "marginal_loss_clean", "load_mw_clean", "temp_c_clean", "hdd_clean", "cdd_clean", "wind_speed_ms_clean")
RESIDUAL_STATES = tuple(f"{m}_change_24h" for m in STATES)
MODELS = {"dmdc": FULL_STATES, "dmdc_residual_24h": RESIDUAL_STATES}
RIDGE = 1e-6
#: name -> last hour of training, in time order.
Ends = dict[str, str]
#: Groups of sums that a task holds before it passes them on.
GROUPS = 1000


def fit_scaler(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each series): means, population deviations and counts of the columns (c0, c1, ... in order)."""
    each = [f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *each)


def moments(hours: DataFrame, models: dict[str, tuple[str, ...]], ends: Ends, controls: tuple[str, ...] = CONTROLS, keys: tuple[str, ...] = (), bucket_hours: int = HOURS) -> DataFrame:
    """(keys, model, fold, place, value): all sums that the fits of all models on the hours up to each end need.

    For a model, rows count if its states and the controls are known; each is paired with the next such row in time.
    Of z = [states, controls] less the series' mean, places hold: the number of rows, sums of z and of z squared; the
    number of pairs, sums of z and of the next states, and their products, row by row, with z and the next states.
    The mean is one fixed pivot of the whole series, so sums of periods (between two ends) simply add up, and a fold
    is the sum of its periods: the number of passes over the hours (pivot, first rows of buckets, sums) does not grow
    with folds or models. A pair belongs to the period of its later row."""
    columns = list(dict.fromkeys([c for s in models.values() for c in s] + list(controls)))
    place = {c: i for i, c in enumerate(columns)}
    times = [F.lit(x).cast("timestamp_ntz") for x in ends.values()]
    inside = hours.select(*keys, "ts", *columns).where(F.col("ts") <= times[-1])
    pivot = inside.groupBy(*keys).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_pivot_{i}") for c, i in place.items()])
    rows = next_complete(inside, {f"_next_{m}": (*s, *controls) for m, s in models.items()}, keys, bucket_hours)
    rows = beside(rows, pivot, list(keys))
    period = lambda ts: sum(((ts > t).cast("int") for t in times), F.lit(0))
    shifted = [(F.col(c) - F.col(f"_pivot_{i}")).alias(f"z{i}") for c, i in place.items()]
    later = [x for m, s in models.items() for x in (period(F.col(f"_next_{m}.ts")).alias(f"later_{m}"), *[(F.col(f"_next_{m}.{c}") - F.col(f"_pivot_{place[c]}")).alias(f"{m}_{j}") for j, c in enumerate(s)])]
    names = {m: ([f"z{place[c]}" for c in (*s, *controls)], [f"{m}_{j}" for j in range(len(s))]) for m, s in models.items()}

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v.tolist()) for k, v in total.items()], columns=[*keys, "model", "period", "sums"])
            total.clear()
            return out

        def add(key: tuple, at: int, values: np.ndarray, size: int) -> None:
            key = tuple(None if x is None or x is pd.NaT or x != x else x for x in key)
            total.setdefault(key, np.zeros(size))[at : at + len(values)] += values

        for batch in batches:
            for m, (now, then) in names.items():
                w, s = len(now), len(then)
                size = 2 + 3 * w + s + w * (w + s)
                whole = batch[batch[now].notna().all(axis=1)]
                for key, rows in whole.groupby([*keys, "period"], dropna=False, sort=False):
                    z = rows[now].to_numpy(float)
                    add((*key[:-1], m, int(key[-1])), 0, np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)]), size)
                paired = whole[whole[then].notna().all(axis=1)]
                for key, rows in paired.groupby([*keys, f"later_{m}"], dropna=False, sort=False):
                    z, y = rows[now].to_numpy(float), rows[then].to_numpy(float)
                    products = z.T @ np.hstack([z, y])
                    add((*key[:-1], m, int(key[-1])), 1 + 2 * w, np.concatenate([[len(z)], z.sum(axis=0), y.sum(axis=0), products.ravel()]), size)
            if len(total) > GROUPS:
                yield passed_on()
        yield passed_on()

    kinds = {f.name: f.dataType.simpleString() for f in inside.schema.fields}
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "model string, period int, sums array<double>"])
    sums = rows.select(*keys, period(F.col("ts")).alias("period"), *shifted, *later).mapInPandas(summed, fields)
    folds = F.array(*[F.lit(f) for f in ends])
    each = sums.select(*keys, "model", F.slice(folds, F.col("period") + 1, len(ends)).alias("folds"), F.posexplode("sums").alias("place", "value"))
    cells = each.select(*keys, "model", F.explode("folds").alias("fold"), "place", "value").groupBy(*keys, "model", "fold", "place").agg(F.sum("value").alias("value"))
    pivots = pivot.select(*keys, F.array(*[f"_pivot_{i}" for i in place.values()]).alias("pivot"))
    return beside(cells, pivots, list(keys))


def responses(a: np.ndarray, b: np.ndarray, mean: np.ndarray, scale: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the first state is after 1 to `horizon` steps, in its own units: offset[h] + by_state[h] . state +
    the sum over k up to h of by_lag[h - k] . control(k). by_state has rows e1'A^h, by_lag rows e1'A^l B."""
    s = len(a)
    power, by_state, by_lag = np.eye(s)[0], [], []
    for _ in range(horizon):
        by_lag.append(power @ b * scale[0] / scale[s:])
        power = power @ a
        by_state.append(power * scale[0] / scale[:s])
    by_state, by_lag = np.array(by_state), np.array(by_lag)
    offset = mean[0] - by_state @ mean[:s] - np.cumsum(by_lag @ mean[s:])
    return offset, by_state, by_lag


def solved(place: np.ndarray, value: np.ndarray, pivot: np.ndarray, s: int, ridge: float, horizon: int) -> dict[str, list]:
    """One fit from its sums: scaler, A and B, and responses. pivot: of the model's states and controls."""
    w = len(pivot)
    sums = np.zeros(2 + 3 * w + s + w * (w + s))
    sums[place] = value
    n, total, squares = sums[0], sums[1 : 1 + w], sums[1 + w : 1 + 2 * w]
    pairs, first, then = sums[1 + 2 * w], sums[2 + 2 * w : 2 + 3 * w], sums[2 + 3 * w : 2 + 3 * w + s]
    products = sums[2 + 3 * w + s :].reshape(w, w + s)
    shift = total / max(n, 1)
    spread = squares / max(n, 1) - shift**2
    # a column that does not vary is left at its own scale; what sums about the pivot cannot tell from 0 counts as 0
    scale = np.sqrt(np.where(spread > 1e-13 * squares / max(n, 1), spread, 1.0))
    both, ends = np.concatenate([first, then]), np.concatenate([shift, shift[:s]])
    centred = products - np.outer(first, ends) - np.outer(shift, both) + pairs * np.outer(shift, ends)
    centred /= np.outer(scale, np.concatenate([scale, scale[:s]]))
    # as the pseudo-inverse, but with no inverse written out, whose rounding would reach all coefficients
    found = np.linalg.lstsq(centred[:, :w] + ridge * np.eye(w), centred[:, w:], rcond=1e-15)[0]
    a, b, mean = found[:s].T, found[s:].T, pivot + shift
    offset, by_state, by_lag = responses(a, b, mean, scale, horizon)
    return {"pairs": int(round(pairs)), "mean": mean.tolist(), "scale": scale.tolist(), "a": a.ravel().tolist(), "b": b.ravel().tolist(), "offset": offset.tolist(), "by_state": by_state.ravel().tolist(), "by_lag": by_lag[::-1].ravel().tolist()}


_FIT = "pairs bigint, mean array<double>, scale array<double>, a array<double>, b array<double>, offset array<double>, by_state array<double>, by_lag array<double>"


def fit(hours: DataFrame, models: dict[str, tuple[str, ...]], ends: Ends, controls: tuple[str, ...] = CONTROLS, keys: tuple[str, ...] = (), ridge: float = RIDGE, horizon: int = HORIZON, bucket_hours: int = HOURS) -> DataFrame:
    """A row for each series, model and fold (a name of `ends`): scaler, A and B (row by row), and responses; by_lag
    has the largest lag first. Solves run on the executors, one for each row; a fold without hours has no row."""
    cells = moments(hours, models, ends, controls, keys, bucket_hours)
    columns = list(dict.fromkeys([c for s in models.values() for c in s] + list(controls)))
    own = {m: [columns.index(c) for c in (*s, *controls)] for m, s in models.items()}

    def solve(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        m = key[len(keys)]
        pivot = np.asarray(cells["pivot"].iloc[0], float)[own[m]]
        got = solved(cells["place"].to_numpy(), cells["value"].to_numpy(float), pivot, len(models[m]), ridge, horizon)
        return pd.DataFrame([{**{k: cells[k].iloc[0] for k in keys}, "model": m, "fold": key[len(keys) + 1], **got}])

    kinds = dict(cells.dtypes)
    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "model string, fold string", _FIT])
    return cells.groupBy(*keys, "model", "fold").applyInPandas(solve, fields)


def dot(xs: Column, cs: Column) -> Column:
    """Null if one of xs is."""
    return F.aggregate(F.zip_with(xs, cs, lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)


def forecast(fitted: DataFrame, origins: DataFrame, models: dict[str, tuple[str, ...]], control: dict[str, Column] | None = None, by: tuple[str, ...] = (), horizon: int = HORIZON) -> DataFrame:
    """(by, ts, horizon) and a column for each model, for every origin (row with `ts` and the states).

    by: what an origin shares with its fit, such as series and fold. control: the controls as columns of the target
    hour `target_ts`; by default the calendar's. An origin with an unknown state, or without a fit, has null forecasts;
    none is left out."""
    c = len(control) if control else len(CONTROLS)
    states = list(dict.fromkeys(s for m in models.values() for s in m))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: plus_hours(F.col("ts"), h))
    if control is None:
        wanted = controls_at(F.col("target_ts"))
        control = {name: wanted[name] for name in CONTROLS}
    steps = origins.select(*by, "ts", F.posexplode(ahead).alias("place", "target_ts")).select(*by, "ts", "place", F.array(*[x.cast("double") for x in control.values()]).alias("u"))
    packed = steps.groupBy(*by, "ts").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "u"))), lambda x: x["u"])).alias("controls"))
    rows = beside(origins.select(*by, "ts", *states), packed, [*by, "ts"])
    for m, own in models.items():
        fits = fitted.where(F.col("model") == m).select(*by, "offset", "by_state", "by_lag")
        state, s = F.array(*own), len(own)
        steps_of = lambda h: F.get("offset", h) + dot(state, F.slice("by_state", h * s + 1, s)) + dot(F.slice("controls", 1, (h + 1) * c), F.slice("by_lag", (horizon - 1 - h) * c + 1, (h + 1) * c))  # noqa: B023, E731
        rows = beside(rows, fits, list(by), "left") if by else rows.join(F.broadcast(fits), how="left")
        rows = rows.withColumn(m, F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), steps_of)).drop("offset", "by_state", "by_lag")
    each = rows.select(*by, "ts", F.posexplode(F.arrays_zip(*models)).alias("place", "f"))
    return each.select(*by, F.col("ts").alias("origin_ts"), (F.col("place") + 1).alias("horizon"), *[F.col(f"f.{m}").alias(m) for m in models])
