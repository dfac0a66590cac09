"""Registered evaluation queries: confusion metrics, exact AUC, report, CV summary, weights.

Predictions are a fixed rule on the labelled documents: score = n_chars,
prediction = 1 when n_chars ≥ 2000; groups = document language.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.metrics import (METRICS, classification_report, confusion_counts, evaluate,
                                     fold_summary, metrics_from_counts, roc_auc)
from quire.operators.split import stratified_folds
from quire.operators.weights import balanced_weights, class_weight_ratio
from quire.sources.tables import read_table

THRESHOLD = 2000


def scored(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").where(F.col("toxic").isin(0, 1))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = labels.join(docs, "doc_id")
    return j.select("doc_id", "lang", F.col("toxic").cast("int").alias("y"),
                    F.col("n_chars").cast("double").alias("score"),
                    (F.col("n_chars") >= THRESHOLD).cast("int").alias("prediction"),
                    F.floor(F.col("n_chars") / 1000).cast("double").alias("coarse_score"))


def q_confusion_by_lang(spark, sf_dir):
    return confusion_counts(scored(spark, sf_dir), "y", "prediction", ["lang"])


def q_metrics_by_lang(spark, sf_dir):
    return evaluate(scored(spark, sf_dir), "y", "prediction", "score", ["lang"])


def q_metric_record(spark, sf_dir):
    return evaluate(scored(spark, sf_dir), "y", "prediction", "score")


def q_auc_exact_by_lang(spark, sf_dir):
    a = roc_auc(scored(spark, sf_dir), "y", "score", ["lang"])
    return a.select("lang", F.round("auc_roc", 6).alias("auc_roc"))


def q_auc_with_ties(spark, sf_dir):
    a = roc_auc(scored(spark, sf_dir), "y", "coarse_score")
    return a.select(F.round("auc_roc", 6).alias("auc_roc"))


def q_classification_report(spark, sf_dir):
    r = classification_report(scored(spark, sf_dir), "y", "prediction", {0: "negative", 1: "positive"})
    return r.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
                    "support")


def q_cv_metric_summary(spark, sf_dir):
    s = scored(spark, sf_dir)
    folds = stratified_folds(s, "doc_id", "y", k=5, seed=42)
    per_fold = metrics_from_counts(confusion_counts(folds, "y", "prediction", ["fold"]), ["fold"])
    return fold_summary(per_fold, METRICS)


def q_class_weights(spark, sf_dir):
    s = scored(spark, sf_dir)
    w = balanced_weights(s, "y")
    r = class_weight_ratio(s, "y")
    return w.select("y", F.round("weight", 6).alias("weight")).unionByName(
            r.select(F.lit(-1).alias("y"), F.round("ratio", 6).alias("weight")))


QUERIES = {
    "confusion_by_lang": q_confusion_by_lang,
    "metrics_by_lang": q_metrics_by_lang,
    "metric_record": q_metric_record,
    "auc_exact_by_lang": q_auc_exact_by_lang,
    "auc_with_ties": q_auc_with_ties,
    "classification_report": q_classification_report,
    "cv_metric_summary": q_cv_metric_summary,
    "class_weights": q_class_weights,
}

_S = f"""s AS (
  SELECT l.doc_id, d.lang, CAST(l.toxic AS INTEGER) AS y, CAST(d.n_chars AS DOUBLE) AS score,
         CAST(d.n_chars >= {THRESHOLD} AS INTEGER) AS prediction,
         CAST(floor(d.n_chars / 1000) AS DOUBLE) AS coarse_score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.toxic IN (0, 1))"""


def _counts(group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""c AS (
  SELECT {g}count(*) FILTER (WHERE y = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE y = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE y = 1 AND prediction = 1) AS tp
  FROM s {gb})"""


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"


_RATES = f"""r AS (
  SELECT *, {_ratio('tp', 'tp + fn')} AS rec, {_ratio('tp', 'tp + fp')} AS prec,
         {_ratio('tn', 'tn + fp')} AS spec, {_ratio('tp + tn', 'tn + fp + fn + tp')} AS acc FROM c),
m AS (
  SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM r)"""


def _metric_cols(prefix: str = "") -> str:
    return ", ".join([f"round_even((rec + spec) / 2, 4) AS balanced_accuracy",
                      "round_even(rec, 4) AS ap_recall_sensitivity", "round_even(spec, 4) AS pd_specificity",
                      "round_even(prec, 4) AS ap_precision", "round_even(f1, 4) AS f1_ap",
                      "round_even(f1, 4) AS f1_ap_sklearn", "round_even(acc, 4) AS accuracy"])


def _auc(group: str, score: str) -> str:
    pg = f"PARTITION BY {group}" if group else ""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""ag AS (
  SELECT {g}{score} AS sc, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
  FROM s WHERE {score} IS NOT NULL GROUP BY {g}{score}),
ac AS (
  SELECT *, sum(neg) OVER ({pg} ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg FROM ag),
auc AS (
  SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      sum(CAST(pos AS DOUBLE) * (CAST(cneg AS DOUBLE) - neg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))
    END AS auc_roc
  FROM ac {gb})"""


SQL = {
    "confusion_by_lang": f"WITH {_S}, {_counts('lang')} SELECT * FROM c",
    "metrics_by_lang": f"""WITH {_S}, {_counts('lang')}, {_RATES}, {_auc('lang', 'score')}
SELECT m.lang, {_metric_cols()}, round_even(auc.auc_roc, 4) AS auc_roc FROM m LEFT JOIN auc USING (lang)""",
    "metric_record": f"""WITH {_S}, {_counts('')}, {_RATES}, {_auc('', 'score')}
SELECT {_metric_cols()}, round_even((SELECT auc_roc FROM auc), 4) AS auc_roc FROM m""",
    "auc_exact_by_lang": f"WITH {_S}, {_auc('lang', 'score')} SELECT lang, round(auc_roc, 6) AS auc_roc FROM auc",
    "auc_with_ties": f"WITH {_S}, {_auc('', 'coarse_score')} SELECT round(auc_roc, 6) AS auc_roc FROM auc",
    "classification_report": f"""WITH {_S}, {_counts('')},
p AS (
  SELECT {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0,
         {_ratio('tp', 'tp + fp')} AS p1, {_ratio('tp', 'tp + fn')} AS r1,
         CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1,
         CAST(tn + fp + fn + tp AS DOUBLE) AS n, {_ratio('tp + tn', 'tn + fp + fn + tp')} AS acc FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
             CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM p)
SELECT 'negative' AS row, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, s0 AS support FROM f
UNION ALL SELECT 'positive', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f
UNION ALL SELECT 'weighted avg', round(CASE WHEN n > 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0 END, 6),
  round(CASE WHEN n > 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0 END, 6),
  round(CASE WHEN n > 0 THEN (f0 * s0 + f1 * s1) / n ELSE 0 END, 6), n FROM f""",
    "cv_metric_summary": f"""WITH {_S},
folded AS (
  SELECT s.*, CAST((row_number() OVER (PARTITION BY y ORDER BY
      md5(concat_ws('|', '42', 'fold', CAST(doc_id AS VARCHAR))), doc_id) - 1) % 5 AS INTEGER) AS fold FROM s),
c AS (
  SELECT fold, count(*) FILTER (WHERE y = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE y = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE y = 1 AND prediction = 1) AS tp
  FROM folded GROUP BY fold), {_RATES},
pf AS (SELECT fold, {_metric_cols()} FROM m)
SELECT {", ".join(f"round_even(avg({k}), 4) AS {k}_mean, round_even(stddev_pop({k}), 4) AS {k}_std"
                  for k in METRICS)} FROM pf""",
    "class_weights": f"""WITH {_S},
c AS (SELECT y, count(*) AS n FROM s GROUP BY y),
t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT y, round(CAST(total AS DOUBLE) / (k * n), 6) AS weight FROM c, t
UNION ALL
SELECT -1 AS y, round(CAST(sum(n) FILTER (WHERE y = 0) AS DOUBLE) / greatest(coalesce(sum(n) FILTER (WHERE y = 1), 0), 1), 6)
FROM c""",
}
