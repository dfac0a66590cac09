import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators import analytics as A
from quire.operators.metrics import classification_report, evaluate, roc_auc


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "y": (rng.random(500) < 0.3).astype(int),
                        "s": rng.integers(0, 20, 500).astype(float)})
    got = {r["g"]: r["auc_roc"] for r in roc_auc(spark.createDataFrame(pdf), "y", "s", ["g"], num_slices=4).collect()}
    for g, part in pdf.groupby("g"):
        assert abs(got[g] - brute_auc(part["y"].values, part["s"].values)) < 1e-12
    one = roc_auc(spark.createDataFrame(pdf), "y", "s").first()["auc_roc"]
    assert abs(one - brute_auc(pdf["y"].values, pdf["s"].values)) < 1e-12


def test_metric_record(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.6), (0, 0, 0.2), (0, 0, 0.3)]
    df = spark.createDataFrame(rows, "y int, p int, s double")
    r = evaluate(df, "y", "p", "s").first()
    assert r["ap_recall_sensitivity"] == 0.5 and r["pd_specificity"] == 0.75
    assert r["ap_precision"] == 0.5 and r["f1_ap"] == 0.5 and r["accuracy"] == round(4 / 6, 4)
    assert r["balanced_accuracy"] == 0.625 and r["auc_roc"] == round(brute_auc(
        np.array([1, 1, 0, 0, 0, 0]), np.array([0.9, 0.4, 0.1, 0.6, 0.2, 0.3])), 4)
    rep = {x["row"]: x for x in classification_report(df, "y", "p").collect()}
    assert rep["1"]["support"] == 2.0 and rep["accuracy"]["precision"] == 4 / 6


def test_rank_ties_nulls_nan(spark):
    df = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("m", "c", 0.2), ("m", "d", None),
                                ("m", "e", float("nan"))], "method string, model string, value double")
    r = {x["model"]: x["rank"] for x in A.rank_desc(df, ["method"]).collect()}
    assert r == {"a": 1, "b": 1, "c": 3, "d": None, "e": None}


def test_borda_and_average_rank(spark):
    rows = [(m, mod, met, v) for m in ("x", "y") for met in ("p", "q")
            for mod, v in (("a", 0.9), ("b", 0.5), ("c", 0.1))]
    df = spark.createDataFrame(rows, "method string, model string, metric string, value double")
    b = {r["model"]: r["total_borda"] for r in A.borda(df).collect()}
    assert b == {"a": 8.0, "b": 4.0, "c": 0.0}
    b8 = {r["model"]: r["total_borda"] for r in A.borda(df, n_models=8).collect()}
    assert b8 == {"a": 28.0, "b": 24.0, "c": 20.0}
    ar = {(r["model"], r["metric"]): r["avg_rank"] for r in A.average_ranks(df).collect()}
    assert ar[("a", "p")] == 1.0 and ar[("c", "q")] == 3.0
