"""Result analytics over (method, model, metric…) tables.

Result tables are wide (one row per method × model, one column per metric)
and small compared with the data behind them, but every operator here is a
plain DataFrame plan — unpivot, group aggregates, rank windows partitioned by
(method, metric) — so nothing is looped on the driver and nothing assumes the
table fits in one task beyond one (method, metric) group of models.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.functions.numeric import clip, min_max_scale


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric",
         value: str = "value", label_format: str | None = "%.3f") -> DataFrame:
    """Wide → long (ids…, metric, value[, label]); label is ``format_string(fmt, value)``."""
    long = df.unpivot([quote(i) for i in ids], [quote(m).cast("double").alias(m) for m in metrics],
                      name, value)
    if label_format:
        long = long.withColumn("label", F.format_string(label_format, F.col(value)))
    return long


def valid(c) -> F.Column:
    c = quote(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def rank_desc(long: DataFrame, partition_cols: Sequence[str], value: str = "value",
              name: str = "rank") -> DataFrame:
    """Competition rank (ties share the minimum), largest value first.

    Null and NaN values receive no rank (they are kept with a null rank).
    """
    w = Window.partitionBy(*[quote(p) for p in partition_cols], valid(value).alias("_v")) \
        .orderBy(F.desc(value))
    return long.withColumn(name, F.when(valid(value), F.rank().over(w)).cast("bigint"))


def average_ranks(long: DataFrame, method: str = "method", model: str = "model",
                  metric: str = "metric", value: str = "value") -> DataFrame:
    """(model, metric, avg_rank): rank models within each (method, metric), average over methods."""
    r = rank_desc(long, [method, metric], value)
    return r.groupBy(model, metric).agg(F.avg("rank").alias("avg_rank"))


def rank_table(long: DataFrame, method: str = "method", model: str = "model",
               metric: str = "metric", value: str = "value") -> DataFrame:
    """Average-rank table with a display order: lowest mean rank first (order 1)."""
    ar = average_ranks(long, method, model, metric, value)
    # windows over the (models × metrics) table instead of a self-join, so the
    # source is computed once; dense_rank over (mean, model) numbers the models
    ar = ar.withColumn("mean_rank", F.avg("avg_rank").over(Window.partitionBy(model)))
    ar = ar.withColumn("model_order", F.dense_rank().over(
        Window.orderBy(F.asc(F.round("mean_rank", 9)), F.asc(model))).cast("bigint"))
    return ar.withColumn("cell_label", F.format_string("%.1f", F.round("avg_rank", 1)))


def borda(long: DataFrame, method: str = "method", model: str = "model", metric: str = "metric",
          value: str = "value", n_models: int | None = None) -> DataFrame:
    """(model, total_borda): Σ (N − rank) over method × metric.

    ``n_models`` fixes N (the original used a constant model count); by
    default N is the number of ranked models in each (method, metric) group.
    """
    r = rank_desc(long, [method, metric], value)
    if n_models is None:
        n = F.count(F.when(valid(value), F.lit(1))).over(Window.partitionBy(method, metric))
    else:
        n = F.lit(n_models)
    pts = r.withColumn("borda", (n - F.col("rank")).cast("double"))
    return pts.groupBy(model).agg(F.sum("borda").alias("total_borda"))


def mean_by_model(long: DataFrame, model: str = "model", metric: str = "metric",
                  value: str = "value") -> DataFrame:
    """(model, metric, mean_value) averaged over methods."""
    return long.groupBy(model, metric).agg(F.avg(value).alias("mean_value"))


def bump_ranks(long: DataFrame, model: str = "model", metric: str = "metric",
               value: str = "value") -> DataFrame:
    """Rank models per metric after averaging over methods; means equal to 9 places tie."""
    avg = mean_by_model(long, model, metric, value).withColumn("mean_value", F.round("mean_value", 9))
    return rank_desc(avg, [metric], "mean_value")


def model_display_order(long: DataFrame, metric_name: str, model: str = "model",
                        metric: str = "metric", value: str = "value",
                        descending: bool = True) -> DataFrame:
    """(model, mean, model_order): models ordered by their mean of one metric."""
    m = (long.where(F.col(metric) == metric_name).groupBy(model)
         .agg(F.avg(value).alias("mean")))
    o = F.desc(F.round("mean", 9)) if descending else F.asc(F.round("mean", 9))
    return m.withColumn("model_order", F.row_number().over(Window.orderBy(o, F.asc(model)))
                        .cast("bigint"))


def stability(long: DataFrame, method: str = "method", model: str = "model",
              metric: str = "metric", value: str = "value") -> DataFrame:
    """Per (model, metric) sample sd over methods, the model's mean sd, and an order (most stable first)."""
    sd = long.groupBy(model, metric).agg(F.stddev_samp(value).alias("sd"))
    sd = sd.withColumn("mean_sd", F.avg("sd").over(Window.partitionBy(model)))
    return sd.withColumn("model_order", F.dense_rank().over(
        Window.orderBy(F.asc(F.round("mean_sd", 9)), F.asc(model))).cast("bigint"))


def metric_correlation(wide: DataFrame, metrics: Sequence[str], digits: int = 2) -> DataFrame:
    """(metric_a, metric_b, r): Pearson r for every ordered pair, in one aggregate."""
    pairs = [(a, b) for a in metrics for b in metrics]
    one = wide.select(*[F.corr(quote(a), quote(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                             F.round(F.col(f"r{i}"), digits).alias("r"))
                    for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(arr))


def min_max_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Parallel-coordinates data: each metric min–max scaled over all rows (constant → /1)."""
    w = Window.partitionBy("metric")
    long = melt(wide, ids, metrics, label_format=None)
    return long.withColumn("scaled", min_max_scale(F.col("value"), F.min("value").over(w),
                                                   F.max("value").over(w)))


def generalisation_gap(test: DataFrame, cv: DataFrame, keys: Sequence[str],
                       metrics: Sequence[str]) -> DataFrame:
    """(keys…, metric, cv_mean, test_value, gap = test − cv) for the given metrics."""
    cvr = cv.select(*[quote(k) for k in keys], *[quote(f"{m}_mean") for m in metrics])
    j = test.select(*[quote(k) for k in keys], *[quote(m) for m in metrics]).join(cvr, list(keys), "inner")
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").cast("double").alias("cv_mean"),
                             quote(m).cast("double").alias("test_value")) for m in metrics])
    out = j.select(*[quote(k) for k in keys], F.inline(arr))
    return out.withColumn("gap", F.col("test_value") - F.col("cv_mean"))


def best_per_group(wide: DataFrame, group: str, metric: str, item: str) -> DataFrame:
    """(group, best_value, best_item): the maximum of ``metric`` and the item holding it.

    Ties go to the smallest item name (``max_by`` alone is order-dependent).
    """
    return wide.groupBy(group).agg(
        F.max(metric).alias("best_value"),
        F.min_by(quote(item), F.when(valid(metric), F.struct(-quote(metric), quote(item))))
        .alias("best_item"))


def leaderboard(wide: DataFrame, group: str, metric: str, name: str = "position") -> DataFrame:
    """Rank rows within ``group`` by ``metric`` descending (ties share the minimum)."""
    return rank_desc(wide, [group], metric, name)


def cv_bars(cv: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids…, metric, mean, sd, lower, upper) with mean ± sd clipped to [0, 1]."""
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), quote(f"{m}_mean").cast("double").alias("mean"),
                             quote(f"{m}_std").cast("double").alias("sd")) for m in metrics])
    out = cv.select(*[quote(i) for i in ids], F.inline(arr))
    return (out.withColumn("lower", clip(F.col("mean") - F.col("sd"), 0.0, 1.0))
            .withColumn("upper", clip(F.col("mean") + F.col("sd"), 0.0, 1.0)))


def operating_points(wide: DataFrame, ids: Sequence[str], specificity_min: float = 0.80,
                     sensitivity_min: float = 0.65) -> DataFrame:
    """Scatter data of three views with their reference-line flags."""
    sens, spec = F.col("ap_recall_sensitivity"), F.col("pd_specificity")
    prec, auc, ba = F.col("ap_precision"), F.col("auc_roc"), F.col("balanced_accuracy")
    return wide.select(
        *[quote(i) for i in ids], sens.alias("sensitivity"), spec.alias("specificity"),
        ((spec >= specificity_min) & (sens >= sensitivity_min)).alias("meets_operating_point"),
        prec.alias("precision"), ((prec + sens) >= 1.0).alias("pr_sum_at_least_one"),
        auc.alias("auc_roc"), ba.alias("balanced_accuracy"), (auc > ba).alias("auc_above_ba"))
