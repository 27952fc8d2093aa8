"""Scores of forecasts: errors, ROC, rankings, and views over them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import model_label, model_rank
from hourgrid.operators.buckets import beside
from hourgrid.operators.quantiles import in_ranges, quantile_table

RESERVED = {"origin_ts", "target_ts", "split", "horizon", "y_true", "fold", "cv_train_end", "context", "season", "season_year", "year", "series"}


def model_columns(predictions: DataFrame) -> list[str]:
    """Numeric columns that are not reserved are models'."""
    return [c for c, t in predictions.dtypes if t in ("double", "float", "int", "bigint") and c not in RESERVED]


def models_long(predictions: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A row for each model with a forecast and an observed price."""
    models = models or model_columns(predictions)
    ids = [c for c in predictions.columns if c not in models]
    return predictions.unpivot(ids, models, "model", "pred").where("pred IS NOT NULL AND y_true IS NOT NULL")


def forecast_errors(predictions: DataFrame, model: str) -> DataFrame:
    """actual, predicted, error and absolute error of one model; rows without both are left out."""
    rows = predictions.where(F.col(model).isNotNull() & F.col("y_true").isNotNull())
    error = F.col(model) - F.col("y_true")
    return rows.withColumns({"actual": F.col("y_true"), "predicted": F.col(model), "error": error, "abs_error": F.abs(error)})


def metric_columns() -> list[Column]:
    """n, mae, mse, rmse, r2 (null where the actual values do not vary), bias."""
    error = F.col("pred") - F.col("y_true")
    total = F.count("*") * F.var_pop("y_true")
    return [
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > 1e-12, 1 - F.sum(error * error) / total).alias("r2"), F.avg(error).alias("bias"),
    ]


def regression_metrics(long: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of each model and group; sums are pre-aggregated, so few large groups are no matter."""
    return long.groupBy("model", *by).agg(*metric_columns())


def safe_metrics(errors: DataFrame) -> DataFrame:
    """One row, all null on empty input."""
    return errors.agg(F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"), F.max("abs_error").alias("max_abs_error"))


def price_threshold(hours: DataFrame, q: float = 0.9, keys: tuple[str, ...] = (), method: str = "percentile") -> DataFrame:
    """The quantile of the clean price, one row (for each series)."""
    return quantile_table(hours, list(keys), {"threshold": ("lmp_clean", q)}, method)


def labelled(long: DataFrame, threshold: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """long with `high`: whether the observed price is at its series' threshold or above; null for a series without
    one. Without keys the table must be one row: more of them are an error when the query runs."""
    if keys:
        rows = beside(long, threshold.select(*keys, "threshold"), list(keys), "left")
    else:
        rows = long.withColumn("threshold", threshold.select(F.col("threshold").cast("double")).scalar())
    return rows.withColumn("high", (F.col("y_true") >= F.col("threshold")).cast("int"))


def roc_steps(scored: DataFrame, by: list[str]) -> DataFrame:
    """For each group and distinct score, falling: cumulative positives (tp) and negatives (fp), their totals, and
    the positives and negatives of the next score (null at the last).

    Rows are first summed by score. Sums run within ranges of scores; what stands before a range comes from the
    ranges' totals, of which there are as many as partitions and groups."""
    sums = scored.groupBy(*by, "pred").agg(F.sum("high").alias("pos"), F.sum(1 - F.col("high")).alias("neg"))
    ranges = in_ranges(sums, *by, F.desc("pred"))
    totals = ranges.groupBy(*by, "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max_by(F.struct("pos", "neg"), "pred").alias("first"))
    order, whole = Window.partitionBy(*by).orderBy("range"), Window.partitionBy(*by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    facts = totals.select(
        *by, "range", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("fp0"),
        F.sum("p").over(whole).alias("positives"), F.sum("n").over(whole).alias("negatives"), F.lead("first").over(order).alias("following"),
    )
    falling = Window.partitionBy(*by, "range").orderBy(F.desc("pred"))
    steps = beside(ranges, facts, [*by, "range"]).withColumns(
        {
            "tp": F.col("tp0") + F.sum("pos").over(falling), "fp": F.col("fp0") + F.sum("neg").over(falling),
            "next_pos": F.coalesce(F.lead("pos").over(falling), F.col("following.pos")), "next_neg": F.coalesce(F.lead("neg").over(falling), F.col("following.neg")),
        }
    )
    return steps.drop("tp0", "fp0", "following")


def roc_auc(scored: DataFrame, by: list[str], keep_one_class: bool = False) -> DataFrame:
    """n, positives, negatives, area under the curve by trapezoids. Groups of one class are left out, or kept with
    a null area."""
    steps = roc_steps(scored, by).withColumn("area", F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    out = steps.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"), F.sum("area").alias("area"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    out = out.withColumn("auc", F.when(both, F.col("area") / (F.col("positives") * F.col("negatives")))).drop("area")
    return out if keep_one_class else out.where(both)


def roc_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """point, fpr, tpr, threshold: the curve's corners, led by (0, 0) with an infinite threshold. An inner point
    where neither count bends is left out. Points are numbered range by range, as steps are summed."""
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    steps = roc_steps(scored, by).where("positives > 0 AND negatives > 0")
    corners = steps.where(first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    counts = corners.groupBy(*by, "range").agg(F.count("*").alias("points"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(*by, "range", F.coalesce(F.sum("points").over(before), F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy(*by, "range").orderBy(F.desc("pred")))
    points = beside(corners, places, [*by, "range"]).select(
        *by, (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"), F.col("pred").alias("threshold"), (F.col("earlier") + number).alias("point")
    )
    origin = counts.select(*by).distinct().select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("point"))
    return points.unionByName(origin)


def best_by(metrics: DataFrame, by: list[str]) -> DataFrame:
    """The model of least mae of each group; ties by name."""
    order = Window.partitionBy(*by).orderBy("mae", "model")
    return metrics.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def best_test_model(metrics: DataFrame) -> DataFrame:
    """The row of least mae of the test split, of all rows if there is no test split."""
    outside = F.when(F.col("split") == "test", 0).otherwise(1)
    return metrics.orderBy(outside, "mae", "model", "split").limit(1)


def rank_models(metrics: DataFrame, by: str = "mae") -> DataFrame:
    """Models with labels, best first: r2 falling, all others rising."""
    score = F.desc_nulls_last(by) if by == "r2" else F.asc_nulls_last(by)
    return metrics.withColumns({"label": model_label(F.col("model")), "priority": model_rank(F.col("model"))}).orderBy(score, "model")


def pivoted(metrics: DataFrame, row: str, column: str, values: list[str], measures: list[str]) -> DataFrame:
    """<value>_<measure> columns by row."""
    return metrics.groupBy(row).pivot(column, values).agg(*[F.first(m).alias(m) for m in measures])


def error_histogram(errors: DataFrame, bins: int = 60) -> DataFrame:
    """Counts in equal bins between the least and the largest error; the largest is in the last bin."""
    ends = errors.agg(F.min("error").alias("low"), F.max("error").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("error") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1))).otherwise(0)
    return errors.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cumulative_error(errors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running sum of absolute errors over the horizons of an origin (of a series)."""
    order = Window.partitionBy(*keys, "origin_ts").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    return errors.withColumn("cumulative_abs_error", F.sum("abs_error").over(order))


def replay_summary(errors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each origin (of each series): errors, peaks, the worst horizon, and flags."""
    worst = F.min_by("horizon", F.struct(-F.col("abs_error"), F.col("horizon")))
    out = errors.groupBy(*keys, "origin_ts").agg(
        F.count("*").alias("horizons"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"),
        F.max("abs_error").alias("max_abs_error"), F.stddev_samp("actual").alias("std_actual"), F.max("actual").alias("peak_actual"), F.max("predicted").alias("peak_predicted"), worst.alias("worst_horizon"),
    )
    return out.withColumns(
        {
            "within_spread": F.coalesce(F.col("mae") < F.col("std_actual"), F.lit(False)),
            "tendency": F.when(F.col("bias") > 0, "over").when(F.col("bias") < 0, "under").otherwise("even"),
            "missed_peak": F.col("peak_actual") > 1.2 * F.col("peak_predicted"),
        }
    )


def stress_lens(errors: DataFrame, keys: tuple[str, ...] = (), method: str = "ranges") -> DataFrame:
    """Heat, blizzard and normal hours (UTC months, quantiles of the rows given, those of its own series for each):
    means and missed high prices."""
    marks = quantile_table(errors, list(keys), {"q40": ("actual", 0.4), "q60": ("actual", 0.6), "q90": ("actual", 0.9)}, method)
    month, actual = F.month("target_ts"), F.col("actual")
    lenses = F.array(
        F.when(month.isin(6, 7, 8) & (actual >= F.col("q90")), "heat"),
        F.when(month.isin(12, 1, 2, 3) & (actual >= F.col("q90")), "blizzard"),
        F.when(actual.between(F.col("q40"), F.col("q60")), "normal"),
    )
    rows = beside(errors, marks, list(keys)).withColumn("lens", F.explode(F.array_compact(lenses)))
    high = F.when(actual >= F.col("q90"), (F.col("predicted") < F.col("q90")).cast("int"))
    return rows.groupBy(*keys, "lens").agg(
        F.count("*").alias("n"), F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"), F.avg("error").alias("mean_error"), F.avg(high).alias("miss_rate")
    )
