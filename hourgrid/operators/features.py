"""Calendar, lags, rolling means, targets and the supervised table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import by_time, calendar, cyclic, finite, local, split_of

HORIZON = 24
# Lags in hours, rolling windows, required features.
LAGS = {"lmp": (1, 24, 48, 168), "load_mw": (1, 24, 168), "temp_c": (1, 24, 168), "hdd": (1, 24, 168), "cdd": (1, 24, 168)}
#: name -> (measure, rows, least number of values, mean or sample deviation), over the rows before.
ROLLS = {
    "lmp_roll_24h_mean": ("lmp", 24, 12, F.avg), "lmp_roll_24h_std": ("lmp", 24, 12, F.stddev_samp), "lmp_roll_168h_mean": ("lmp", 168, 72, F.avg),
    "load_roll_24h_mean": ("load_mw", 24, 12, F.avg), "temp_roll_24h_mean": ("temp_c", 24, 12, F.avg),
}
REQUIRED = [*[f"{m}_clean_lag_168h" for m in LAGS], "lmp_roll_168h_mean"]
STATES = ("lmp", "load_mw", "temp_c", "hdd", "cdd")


def targets(horizon: int = HORIZON) -> list[str]:
    return [f"target_lmp_h{h:02d}" for h in range(1, horizon + 1)]


def add_calendar(df: DataFrame) -> DataFrame:
    rows = df.withColumn("ts_local", local(F.col("ts"))).withColumns(calendar(F.col("ts_local")))
    return rows.withColumns(cyclic(F.col("hour_local"), F.col("weekday_local"), F.col("month_local")))


def add_lags(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    order = by_time(keys)
    return df.withColumns({f"{m}_clean_lag_{n}h": F.lag(f"{m}_clean", n).over(order) for m, lags in LAGS.items() for n in lags})


def add_rolling(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Over the rows before each one; null below the least number of values."""
    out = {}
    for name, (measure, rows, least, f) in ROLLS.items():
        frame = by_time(keys).rowsBetween(-rows, -1)
        column = f"{measure}_clean"
        out[name] = F.when(F.count(column).over(frame) >= least, f(column).over(frame))
    return df.withColumns(out)


def add_targets(df: DataFrame, horizon: int = HORIZON, keys: tuple[str, ...] = ()) -> DataFrame:
    """Observed prices of the next hours, and whether they are missing."""
    order, out = by_time(keys), {}
    for h, name in enumerate(targets(horizon), 1):
        out[name] = F.lead("lmp_observed", h).over(order)
        out[f"{name}_is_missing"] = F.lead("lmp_missing", h).over(order)
    return df.withColumns(out)


def add_changes(df: DataFrame, measures: tuple[str, ...] = ("temp_c", "hdd", "cdd", "load_mw"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Value less the one 24 rows before."""
    order = by_time(keys)
    return df.withColumns({f"{m}_change_24h": F.col(f"{m}_clean") - F.lag(f"{m}_clean", 24).over(order) for m in measures})


def without_infinities(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t == "double"})


def features(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The clean hourly table: all of the above, infinities missing."""
    rows = add_changes(add_targets(add_rolling(add_lags(add_calendar(df), keys), keys), keys=keys), STATES, keys)
    return without_infinities(rows)


def supervised(df: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    """Rows with all targets and required features, none of whose targets is missing, with their split."""
    known = [*targets(), *REQUIRED]
    gaps = sum((F.coalesce(f"{t}_is_missing", F.lit(1)) for t in targets()), F.lit(0))
    return df.dropna(subset=known).where(gaps == 0).withColumn("split", split_of(F.col("ts"), train_end, validation_end))
