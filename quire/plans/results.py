"""Method × model result tables derived from the given tables.

Stand-in for the per-method result files: ``method`` = order priority,
``model`` = market segment of the customer, and each metric is the share of
that group's orders meeting one fixed condition (a ratio of counts, so it is
exact in every engine). The test table is computed over all orders; the CV
table averages per-year values ("folds") with their population sd.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table

METRIC_COLS = ["balanced_accuracy", "ap_recall_sensitivity", "pd_specificity", "ap_precision",
               "f1_ap", "accuracy", "auc_roc"]
KEY_METRICS = ["balanced_accuracy", "auc_roc", "ap_recall_sensitivity", "f1_ap"]

# Each metric: the SQL condition whose share over a group's orders gives its value.
CONDITIONS = {
    "balanced_accuracy": "o_orderstatus = 'F'",
    "ap_recall_sensitivity": "o_orderstatus = 'O'",
    "pd_specificity": "o_totalprice < 150000",
    "ap_precision": "c_acctbal > 0",
    "f1_ap": "o_totalprice >= 50000",
    "f1_ap_sklearn": "o_totalprice >= 50000",
    "accuracy": "c_nationkey < 12",
    "auc_roc": "o_totalprice >= 100000",
}
ALL_METRICS = list(CONDITIONS)


def orders_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(F.col("o_orderpriority").alias("method"), F.col("c_mktsegment").alias("model"),
                    F.year("o_orderdate").alias("fold"),
                    *[F.expr(cond).cast("double").alias(m) for m, cond in CONDITIONS.items()])


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders_by_group(spark, sf_dir)
    return g.groupBy("method", "model").agg(*[F.bround(F.avg(m), 4).alias(m) for m in ALL_METRICS])


def cv_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.metrics import fold_summary
    g = orders_by_group(spark, sf_dir)
    per_fold = g.groupBy("method", "model", "fold").agg(*[F.bround(F.avg(m), 4).alias(m)
                                                          for m in ALL_METRICS])
    return fold_summary(per_fold, ALL_METRICS, ["method", "model"])


# SQL of the same two tables, for the oracle statements.
BASE_SQL = f"""
g AS (
  SELECT o.o_orderpriority AS method, c.c_mktsegment AS model, year(o.o_orderdate) AS fold,
         {", ".join(f"CAST({c} AS DOUBLE) AS {m}" for m, c in CONDITIONS.items())}
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
test AS (
  SELECT method, model, {", ".join(f"round_even(avg({m}), 4) AS {m}" for m in CONDITIONS)}
  FROM g GROUP BY method, model),
per_fold AS (
  SELECT method, model, fold, {", ".join(f"round_even(avg({m}), 4) AS {m}" for m in CONDITIONS)}
  FROM g GROUP BY method, model, fold),
cv AS (
  SELECT method, model,
    {", ".join(f"round_even(avg({m}), 4) AS {m}_mean, round_even(stddev_pop({m}), 4) AS {m}_std"
               for m in CONDITIONS)}
  FROM per_fold GROUP BY method, model),
long AS (
  SELECT * FROM (SELECT method, model, {", ".join(METRIC_COLS)} FROM test)
  UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(METRIC_COLS)})))"""
