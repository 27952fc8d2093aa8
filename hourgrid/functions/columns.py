"""Column expressions over one hourly row."""

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F

LOCAL_ZONE = "America/New_York"
WINTER_MONTHS, SUMMER_MONTHS = (12, 1, 2, 3), (6, 7, 8)


def by_time(keys: tuple[str, ...] = ()) -> WindowSpec:
    """The window all hourly work shares: one series, in time order."""
    return Window.partitionBy(*keys).orderBy("ts")


def number(column: str) -> Column:
    """A measure as double: bad text and NaN are missing."""
    value = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    return F.when(~F.isnan(value), value)


def finite(column: Column) -> Column:
    """Infinite values are missing."""
    return F.when(F.abs(column) != float("inf"), column)


def filled(value: Column, row: Column, limit: int, keys: tuple[str, ...] = ()) -> Column:
    """A gap's value by interpolation over rows, `limit` rows from each side; further in, the last interpolated
    value goes on. Before the first and after the last value the nearest one stands. row: row number in time order.

    Both neighbours are running values, the next one in falling order: a frame up to the series' end would be
    gone through anew for every row."""
    order, falling = by_time(keys), Window.partitionBy(*keys).orderBy(F.desc("ts"))
    known = F.when(value.isNotNull(), F.struct(row.alias("row"), value.alias("value")))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    return gap_value(value, row, before, after, limit)


def gap_value(value: Column, row: Column, before: Column, after: Column, limit: int) -> Column:
    """value, or what stands in a gap between the known (row, value) before and after it."""
    back, on = row - before["row"], after["row"] - row
    steps = F.when((back <= limit) | (on <= limit), back).otherwise(F.lit(limit))
    inner = before["value"] + (after["value"] - before["value"]) * steps / (back + on)
    return F.coalesce(value, F.when(before.isNotNull() & after.isNotNull(), inner), before["value"], after["value"])


def local(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), ts)


def calendar(at: Column) -> dict[str, Column]:
    """Calendar fields of a local time; Monday is day 0."""
    month, day = F.month(at), F.weekday(at)
    return {
        "year_local": F.year(at), "month_local": month, "day_local": F.dayofmonth(at), "hour_local": F.hour(at), "weekday_local": day,
        "is_weekend": (day >= 5).cast("int"), "is_summer": month.isin(*SUMMER_MONTHS).cast("int"), "is_winter": month.isin(*WINTER_MONTHS).cast("int"),
    }


def cyclic(hour: Column, weekday: Column, month: Column) -> dict[str, Column]:
    out = {}
    for name, value, period in (("hour", hour, 24), ("dow", weekday, 7), ("month", month, 12)):
        turn = F.lit(2.0) * F.pi() * value / F.lit(period)
        out |= {f"sin_{name}": F.sin(turn), f"cos_{name}": F.cos(turn)}
    return out


def season(month: Column) -> Column:
    return F.when(month.isin(*SUMMER_MONTHS), "summer").when(month.isin(*WINTER_MONTHS), "winter").otherwise("other")


def season_year(year: Column, month: Column) -> Column:
    """December belongs to the winter of the next year."""
    return year + F.when(month == 12, 1).otherwise(0)


def split_of(ts: Column, train_end: str, validation_end: str) -> Column:
    ends = [F.lit(x).cast("timestamp_ntz") for x in (train_end, validation_end)]
    return F.when(ts <= ends[0], "train").when(ts <= ends[1], "validation").otherwise("test")


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


# Names of models on display, in their order.
MODEL_NAMES = {
    "dmdc_residual_24h": "Residual DMDc", "seasonal_naive_24h": "Seasonal naive 24h", "dmdc": "DMDc", "seasonal_naive_168h": "Seasonal naive 168h", "sarimax": "SARIMAX",
}


def model_label(model: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MODEL_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(known, model), F.initcap(F.replace(model, F.lit("_"), F.lit(" "))))


def model_rank(model: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, m in enumerate(MODEL_NAMES) for x in (m, i)])
    return F.coalesce(F.element_at(ranks, model), F.lit(len(MODEL_NAMES)))
