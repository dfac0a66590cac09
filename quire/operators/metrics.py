"""Binary classification metrics as aggregates.

Confusion counts are ``count_if`` aggregates (partial aggregation, one row
per group). The ROC AUC is exact and threshold-free: scores are grouped into
distinct values with positive/negative counts, and a distributed running sum
of negatives over the score order gives every positive its number of lower
negatives (ties count one half) — no pairwise comparison and no single-task
sort of all scores. Rounding to 4 places is half-to-even, as Python's round.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.functions.numeric import safe_ratio
from quire.operators.cumulative import running_sum

METRICS = ["balanced_accuracy", "ap_recall_sensitivity", "pd_specificity", "ap_precision",
           "f1_ap", "f1_ap_sklearn", "accuracy"]


def confusion_counts(df: DataFrame, label: str, prediction: str,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    y, p = quote(label), quote(prediction)
    return df.groupBy(*[quote(g) for g in group_cols]).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _r(c: Column, digits: int) -> Column:
    return F.bround(c, digits) if digits is not None else c


def metrics_from_counts(counts: DataFrame, group_cols: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall = safe_ratio(tp, tp + fn)
    precision = safe_ratio(tp, tp + fp)
    specificity = safe_ratio(tn, tn + fp)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    n = tn + fp + fn + tp
    return counts.select(
        *[quote(g) for g in group_cols],
        _r((recall + specificity) / 2, digits).alias("balanced_accuracy"),
        _r(recall, digits).alias("ap_recall_sensitivity"),
        _r(specificity, digits).alias("pd_specificity"),
        _r(precision, digits).alias("ap_precision"),
        _r(f1, digits).alias("f1_ap"),
        _r(f1, digits).alias("f1_ap_sklearn"),
        _r(safe_ratio(tp + tn, n), digits).alias("accuracy"))


def roc_auc(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (),
            num_slices: int | None = None, max_groups: int | None = None) -> DataFrame:
    """(group…, auc_roc) exact Mann–Whitney AUC, ties ½; null when a class is absent."""
    y = quote(label)
    by_score = (df.where(quote(score).isNotNull())
                .groupBy(*[quote(g) for g in group_cols], quote(score).cast("double").alias("_s"))
                .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")))
    return auc_from_score_counts(by_score, group_cols, num_slices, max_groups)


def auc_from_score_counts(by_score: DataFrame, group_cols: Sequence[str] = (),
                          num_slices: int | None = None, max_groups: int | None = None) -> DataFrame:
    """AUC from a (group…, _s, _pos, _neg) table with one row per distinct score."""
    groups = list(group_cols)
    cum = running_sum(by_score, groups, ["_s"], ["_neg"], num_slices=num_slices,
                      max_groups=max_groups if groups else 1)
    contrib = F.col("_pos") * (F.col("cum__neg") - F.col("_neg") + F.col("_neg") / 2.0)
    agg = cum.groupBy(*[quote(g) for g in groups]).agg(
        F.sum(contrib).alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return agg.select(*[quote(g) for g in groups],
                      F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                             F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc_roc"))


def evaluate(df: DataFrame, label: str, prediction: str, score: str | None = None,
             group_cols: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """The metric record (7 confusion metrics, plus ``auc_roc`` when a score is given)."""
    if score is None:
        return metrics_from_counts(confusion_counts(df, label, prediction, group_cols), group_cols, digits)
    # One scan: (group, score, prediction) → positives / negatives, materialised
    # once; the confusion counts and the AUC are both sums over this table.
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    y, p = quote(label), quote(prediction)
    compact = (df.groupBy(*[quote(g) for g in group_cols], quote(score).cast("double").alias("_s"),
                          p.alias("_pred"))
               .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
               .checkpoint(eager=True))
    pred1, pred0 = F.col("_pred") == 1, F.col("_pred") == 0
    counts = compact.groupBy(*[quote(g) for g in group_cols]).agg(
        F.sum(F.when(pred0, F.col("_neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(pred1, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(pred0, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(pred1, F.col("_pos")).otherwise(0)).alias("tp"))
    m = metrics_from_counts(counts, group_cols, digits)
    by_score = (compact.where(F.col("_s").isNotNull())
                .groupBy(*[quote(g) for g in group_cols], "_s")
                .agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")))
    auc = auc_from_score_counts(by_score, group_cols)
    auc = auc.select(*group_cols, _r(F.col("auc_roc"), digits).alias("auc_roc"))
    if not group_cols:
        # one number: attach it as a literal rather than joining two one-row frames
        value = auc.first()["auc_roc"]
        return m.withColumn("auc_roc", F.lit(value).cast("double"))
    return m.join(auc, list(group_cols), "left")


def classification_report(df: DataFrame, label: str, prediction: str,
                          class_names: dict[int, str] | None = None,
                          group_cols: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Per class precision / recall / f1 / support, then accuracy, macro and weighted averages.

    Zero divisions give 0. Rows: (group…, row, precision, recall, f1_score, support).
    """
    names = class_names or {0: "0", 1: "1"}
    counts = confusion_counts(df, label, prediction, group_cols)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def prf(tp_, fp_, fn_):
        p = safe_ratio(tp_, tp_ + fp_)
        r = safe_ratio(tp_, tp_ + fn_)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    acc = safe_ratio(tp + tn, n)
    rows = F.array(
        F.struct(F.lit(names[0]).alias("row"), p0.alias("precision"), r0.alias("recall"),
                 f0.alias("f1_score"), s0.alias("support")),
        F.struct(F.lit(names[1]).alias("row"), p1.alias("precision"), r1.alias("recall"),
                 f1.alias("f1_score"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1_score"), n.cast("double").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1_score"),
                 n.cast("double").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), safe_ratio(p0 * s0 + p1 * s1, n).alias("precision"),
                 safe_ratio(r0 * s0 + r1 * s1, n).alias("recall"),
                 safe_ratio(f0 * s0 + f1 * s1, n).alias("f1_score"), n.cast("double").alias("support")),
    )
    out = counts.select(*[quote(g) for g in group_cols], F.inline(rows))
    if digits is not None:
        out = out.select(*group_cols, "row", *[F.bround(c, digits).alias(c)
                                               for c in ("precision", "recall", "f1_score")], "support")
    return out


def fold_summary(per_fold: DataFrame, metric_cols: Sequence[str], group_cols: Sequence[str] = (),
                 digits: int = 4) -> DataFrame:
    """``{m}_mean`` and ``{m}_std`` (population sd) over folds, rounded half-to-even."""
    aggs = []
    for m in metric_cols:
        aggs.append(F.bround(F.avg(m), digits).alias(f"{m}_mean"))
        aggs.append(F.bround(F.stddev_pop(m), digits).alias(f"{m}_std"))
    return per_fold.groupBy(*[quote(g) for g in group_cols]).agg(*aggs)
