"""Registered result-analytics queries (figure data) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import analytics as A
from quire.plans.results import (BASE_SQL, KEY_METRICS, METRIC_COLS, cv_results, test_results)


def _long(spark, sf_dir):
    return A.melt(test_results(spark, sf_dir), ["method", "model"], METRIC_COLS, label_format=None)


def q_results_test_table(spark, sf_dir):
    return test_results(spark, sf_dir)


def q_results_cv_table(spark, sf_dir):
    return cv_results(spark, sf_dir)


def q_results_long(spark, sf_dir):
    return _long(spark, sf_dir)


def q_rank_within_method(spark, sf_dir):
    return A.rank_desc(_long(spark, sf_dir), ["method", "metric"])


def q_average_rank_table(spark, sf_dir):
    t = A.rank_table(_long(spark, sf_dir))
    return t.select("model", "metric", F.round("avg_rank", 6).alias("avg_rank"),
                    F.round("mean_rank", 6).alias("mean_rank"), "model_order", "cell_label")


def q_borda_totals(spark, sf_dir):
    return A.borda(_long(spark, sf_dir))


def q_borda_fixed_n(spark, sf_dir):
    return A.borda(_long(spark, sf_dir), n_models=8)


def q_stability(spark, sf_dir):
    s = A.stability(_long(spark, sf_dir))
    return s.select("model", "metric", F.round("sd", 6).alias("sd"),
                    F.round("mean_sd", 6).alias("mean_sd"), "model_order")


def q_metric_correlation(spark, sf_dir):
    return A.metric_correlation(test_results(spark, sf_dir), METRIC_COLS, digits=2)


def q_parallel_coordinates(spark, sf_dir):
    p = A.min_max_long(test_results(spark, sf_dir), ["method", "model"], METRIC_COLS)
    return p.select("method", "model", "metric", "value", F.round("scaled", 6).alias("scaled"))


def q_generalisation_gap(spark, sf_dir):
    g = A.generalisation_gap(test_results(spark, sf_dir), cv_results(spark, sf_dir),
                             ["method", "model"], KEY_METRICS)
    return g.select("method", "model", "metric", "cv_mean", "test_value",
                    F.round("gap", 6).alias("gap"))


def q_bump_ranks(spark, sf_dir):
    b = A.bump_ranks(_long(spark, sf_dir))
    return b.select("model", "metric", F.round("mean_value", 6).alias("mean_value"), "rank")


def q_best_per_method(spark, sf_dir):
    return A.best_per_group(test_results(spark, sf_dir), "method", "balanced_accuracy", "model")


def q_leaderboard(spark, sf_dir):
    return A.leaderboard(test_results(spark, sf_dir), "method", "f1_ap").select(
        "method", "model", "f1_ap", "position")


def q_cv_bars(spark, sf_dir):
    b = A.cv_bars(cv_results(spark, sf_dir), ["method", "model"], METRIC_COLS)
    return b.select("method", "model", "metric", "mean", "sd", F.round("lower", 6).alias("lower"),
                    F.round("upper", 6).alias("upper"))


def q_operating_points(spark, sf_dir):
    return A.operating_points(test_results(spark, sf_dir), ["method", "model"])


def q_heatmap_by_balanced_accuracy(spark, sf_dir):
    long = _long(spark, sf_dir)
    order = A.model_display_order(long, "balanced_accuracy")
    return long.join(order.select("model", "model_order"), "model")


def q_ablation_key_metrics(spark, sf_dir):
    long = _long(spark, sf_dir)
    order = A.model_display_order(long, "balanced_accuracy")
    return (long.where(F.col("metric").isin(KEY_METRICS))
            .join(order.select("model", "model_order"), "model"))


def q_radar_profile(spark, sf_dir):
    m = A.mean_by_model(_long(spark, sf_dir))
    return m.select("model", "metric", F.round("mean_value", 6).alias("mean_value"))


QUERIES = {
    "results_test_table": q_results_test_table,
    "results_cv_table": q_results_cv_table,
    "results_long": q_results_long,
    "rank_within_method": q_rank_within_method,
    "average_rank_table": q_average_rank_table,
    "borda_totals": q_borda_totals,
    "borda_fixed_n": q_borda_fixed_n,
    "stability": q_stability,
    "metric_correlation": q_metric_correlation,
    "parallel_coordinates": q_parallel_coordinates,
    "generalisation_gap": q_generalisation_gap,
    "bump_ranks": q_bump_ranks,
    "best_per_method": q_best_per_method,
    "leaderboard": q_leaderboard,
    "cv_bars": q_cv_bars,
    "operating_points": q_operating_points,
    "heatmap_by_balanced_accuracy": q_heatmap_by_balanced_accuracy,
    "ablation_key_metrics": q_ablation_key_metrics,
    "radar_profile": q_radar_profile,
}

_W = f"WITH {BASE_SQL}"
_RANKED = f"""{_W},
ranked AS (SELECT *, CAST(rank() OVER (PARTITION BY method, metric ORDER BY value DESC) AS BIGINT) AS rank
           FROM long)"""
_AVG = f"""{_RANKED},
ar AS (SELECT model, metric, avg(rank) AS avg_rank FROM ranked GROUP BY model, metric)"""
_ORDER_BA = """
ord AS (SELECT model, CAST(row_number() OVER (ORDER BY round(avg(value), 9) DESC, model) AS BIGINT) AS model_order
        FROM long WHERE metric = 'balanced_accuracy' GROUP BY model)"""
_PAIRS = [(a, b) for a in METRIC_COLS for b in METRIC_COLS]
_KEYS = ", ".join(f"'{m}'" for m in KEY_METRICS)

SQL = {
    "results_test_table": f"{_W} SELECT * FROM test",
    "results_cv_table": f"{_W} SELECT * FROM cv",
    "results_long": f"{_W} SELECT * FROM long",
    "rank_within_method": f"{_RANKED} SELECT * FROM ranked",
    "average_rank_table": f"""{_AVG},
mr AS (SELECT model, avg(avg_rank) AS mean_rank FROM ar GROUP BY model),
o AS (SELECT model, mean_rank, CAST(row_number() OVER (ORDER BY round(mean_rank, 9), model) AS BIGINT) AS model_order
      FROM mr)
SELECT ar.model, ar.metric, round(ar.avg_rank, 6) AS avg_rank, round(o.mean_rank, 6) AS mean_rank,
       o.model_order, printf('%.1f', round(ar.avg_rank, 1)) AS cell_label
FROM ar JOIN o USING (model)""",
    "borda_totals": f"""{_RANKED}
SELECT model, sum(CAST(n - rank AS DOUBLE)) AS total_borda
FROM (SELECT *, count(*) OVER (PARTITION BY method, metric) AS n FROM ranked) GROUP BY model""",
    "borda_fixed_n": f"""{_RANKED}
SELECT model, sum(CAST(8 - rank AS DOUBLE)) AS total_borda FROM ranked GROUP BY model""",
    "stability": f"""{_W},
sd AS (SELECT model, metric, stddev_samp(value) AS sd FROM long GROUP BY model, metric),
ms AS (SELECT model, avg(sd) AS mean_sd FROM sd GROUP BY model),
o AS (SELECT model, mean_sd, CAST(row_number() OVER (ORDER BY round(mean_sd, 9), model) AS BIGINT) AS model_order
      FROM ms)
SELECT sd.model, sd.metric, round(sd.sd, 6) AS sd, round(o.mean_sd, 6) AS mean_sd, o.model_order
FROM sd JOIN o USING (model)""",
    "metric_correlation": f"{_W} " + " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 2) AS r FROM test"
        for a, b in _PAIRS),
    "parallel_coordinates": f"""{_W}
SELECT method, model, metric, value,
  round((value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w
        THEN max(value) OVER w - min(value) OVER w ELSE 1.0 END, 6) AS scaled
FROM long WINDOW w AS (PARTITION BY metric)""",
    "generalisation_gap": f"""{_W} """ + " UNION ALL ".join(
        f"""SELECT t.method, t.model, '{m}' AS metric, c.{m}_mean AS cv_mean, t.{m} AS test_value,
        round(t.{m} - c.{m}_mean, 6) AS gap FROM test t JOIN cv c USING (method, model)"""
        for m in KEY_METRICS),
    "bump_ranks": f"""{_W},
m AS (SELECT model, metric, round(avg(value), 9) AS mean_value FROM long GROUP BY model, metric)
SELECT model, metric, round(mean_value, 6) AS mean_value,
  CAST(rank() OVER (PARTITION BY metric ORDER BY mean_value DESC) AS BIGINT) AS rank FROM m""",
    "best_per_method": f"""{_W}
SELECT method, max(balanced_accuracy) AS best_value,
  arg_min(model, struct_pack(a := -balanced_accuracy, b := model)) AS best_item
FROM test GROUP BY method""",
    "leaderboard": f"""{_W}
SELECT method, model, f1_ap,
  CAST(rank() OVER (PARTITION BY method ORDER BY f1_ap DESC) AS BIGINT) AS position FROM test""",
    "cv_bars": f"{_W} " + " UNION ALL ".join(
        f"""SELECT method, model, '{m}' AS metric, {m}_mean AS mean, {m}_std AS sd,
        round(least(greatest({m}_mean - {m}_std, 0.0), 1.0), 6) AS lower,
        round(least(greatest({m}_mean + {m}_std, 0.0), 1.0), 6) AS upper FROM cv""" for m in METRIC_COLS),
    "operating_points": f"""{_W}
SELECT method, model, ap_recall_sensitivity AS sensitivity, pd_specificity AS specificity,
  pd_specificity >= 0.80 AND ap_recall_sensitivity >= 0.65 AS meets_operating_point,
  ap_precision AS precision, ap_precision + ap_recall_sensitivity >= 1.0 AS pr_sum_at_least_one,
  auc_roc, balanced_accuracy, auc_roc > balanced_accuracy AS auc_above_ba FROM test""",
    "heatmap_by_balanced_accuracy": f"""{_W}, {_ORDER_BA}
SELECT long.*, ord.model_order FROM long JOIN ord USING (model)""",
    "ablation_key_metrics": f"""{_W}, {_ORDER_BA}
SELECT long.*, ord.model_order FROM long JOIN ord USING (model) WHERE metric IN ({_KEYS})""",
    "radar_profile": f"""{_W}
SELECT model, metric, round(avg(value), 6) AS mean_value FROM long GROUP BY model, metric""",
}
