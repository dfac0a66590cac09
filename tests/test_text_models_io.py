import json
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators.reducers.lsa import LSAReducer
from quire.operators.text import tfidf, truncate_normalise

DOCS = [(1, "Le chat dort. Le chien dort aussi!"), (2, "the cat sleeps; the dog sleeps too"),
        (3, "Le chat et le chien"), (4, "a b c the cat"), (5, ""), (6, "dort dort dort chat")]


def ref_tfidf(docs, min_df=2):
    toks = {k: re.findall(r"[^\W]{2,}", t.lower()) for k, t in docs}
    grams = {k: t + [a + " " + b for a, b in zip(t, t[1:])] for k, t in toks.items()}
    tf = {k: Counter(g) for k, g in grams.items()}
    df = Counter(term for c in tf.values() for term in c)
    vocab = {t for t, d in df.items() if d >= min_df}
    n = len(docs)
    out = {}
    for k, c in tf.items():
        raw = {t: v * (math.log((1 + n) / (1 + df[t])) + 1) for t, v in c.items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for t, x in raw.items():
            out[(k, t)] = x / norm
    return out


def test_tfidf_matches_reference(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    got = {(r["id"], r["term"]): r["tfidf"] for r in tfidf(df, "id", "text", min_df=2, max_features=None).collect()}
    exp = ref_tfidf(DOCS)
    assert set(got) == set(exp)
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_truncate_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0],), ([0.0, 0.0, 1.0],)], "v array<double>")
    out = [r[0] for r in df.select(truncate_normalise(F.col("v"), 2)).collect()]
    assert out[0] == [0.6, 0.8] and out[1] == [0.0, 0.0]


def test_lsa_matches_numpy(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, size=int(rng.integers(5, 40))))) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, text string")
    model = LSAReducer(n_components=3, min_df=3, max_features=None, n_iter=8).fit(df, "id", "text")
    w = model.weights(df).toPandas().pivot_table(index="id", columns="term", values="w", fill_value=0.0)
    a = w[model.terms].to_numpy()
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    # randomized subspace iteration: approximate, like any randomized truncated SVD
    assert np.allclose(model.singular_values, s[:3], rtol=1e-3)
    assert abs(float(vt[0] @ model.loadings[:, 0])) > 0.9999
    scores = model.transform(df).toPandas().sort_values("id")
    assert np.allclose(scores[model.names].to_numpy(), a @ model.loadings, atol=1e-9)


def test_lsa_keeps_the_whole_vocabulary(spark):
    # 5,600 equal frequent words and, rarest, "zz yy": a cut to 5,000 terms loses documents 8 to 10
    many = " . ".join(f"w{i}" for i in range(2800))
    df = spark.createDataFrame([(i, many) for i in range(8)] + [(i, "zz yy") for i in (8, 9, 10)], "id long, text string")
    model = LSAReducer(n_components=2).fit(df, "id", "text")
    assert model.idf.count() == 2800 + 2799 + 3
    scores = {r["id"]: r[1:] for r in model.transform(df).collect()}
    assert abs(scores[9][1]) > 0.99 and np.allclose(model.singular_values, [8 ** 0.5, 3 ** 0.5], rtol=1e-6)


def test_text_aware_selection_keeps_all_tokens(spark, monkeypatch):
    from quire.plans import experts
    seen = []

    class Vectorizer(experts.CountVectorizer):
        def _fit(self, df):
            seen.append(super()._fit(df))
            return seen[-1]
    monkeypatch.setattr(experts, "CountVectorizer", Vectorizer)
    df = spark.range(5200 * 2).select((F.col("id")).alias("k"), (F.col("id") % 2).cast("int").alias("y"), F.rand(3).alias("a"),
                                      F.floor(F.col("id") / 2).cast("string").alias("site"))
    experts.text_aware_selection(df, df.limit(5), "k", "y", ["a"], ["site"], min_df=2)
    assert len(seen[0].vocabulary) == 5200


def _toy(spark, n=240, seed=12):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.25).astype(int)
    pdf = pd.DataFrame({"k": np.arange(n), "y": y, "a": rng.normal(size=n) + 1.5 * y,
                        "b": rng.normal(size=n), "c": rng.integers(0, 3, n).astype(float)})
    return spark.createDataFrame(pdf)


def test_models_predict(spark):
    from quire.operators.models import build_model, positive_weight
    df = _toy(spark)
    train, test = df.where("k % 4 != 0"), df.where("k % 4 = 0")
    for name, params in [("logistic_regression", {}), ("random_forest", {"n_estimators": 20}),
                         ("svm", {"n_components": 30}), ("easy_ensemble", {"n_estimators": 3}),
                         ("lightgbm", {"n_estimators": 5})]:
        spec = build_model(name, params, positive_weight(train, "y"))
        pred = spec.fit(train, ["a", "b", "c"], "y").predict(test, keep=["k", "y"]).toPandas()
        assert len(pred) == 60 and pred["prediction"].isin([0, 1]).all(), name
        assert pred["score"].between(0, 1).all(), name


def test_experiment_and_sinks(spark, tmp_path):
    from quire.plans.experiment import run_experiment
    from quire.sources.results import load_results
    from quire.sources.sinks import write_json_record, write_table
    df = _toy(spark)
    r = run_experiment(df, ["a", "b", "c"], "k", "y", "pca", models=["logistic_regression"], cv_folds=3)
    t = r.test_results.toPandas()
    assert list(t["model"]) == ["logistic_regression"] and 0 <= t["auc_roc"][0] <= 1
    s = r.summary.first()
    assert s["n_train"] + s["n_test"] == 240 and s["dr_method"] == "pca"
    root = tmp_path / "results"
    write_table(r.test_results.coalesce(1), str(root / "pca" / "model_results.csv"))
    write_table(r.cv_results.coalesce(1), str(root / "pca" / "cv_results.csv"))
    write_json_record(r.summary.coalesce(1), str(root / "pca" / "experiment_summary.json"))
    tests, cvs, sums, skipped = load_results(spark, str(root), ["pca", "famd"],
                                             model_labels={"logistic_regression": "Logistic Reg."})
    assert skipped == ["famd"]
    row = tests.first()
    assert row["method"] == "pca" and row["model_label"] == "Logistic Reg."
    assert sums.first()["n_train"] == s["n_train"]


def test_csv_inventory(spark, tmp_path):
    from quire.sources.csv import csv_inventory
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x\n1\n")
    inv = {r["file"]: r for r in csv_inventory(spark, [str(tmp_path), str(tmp_path)]).collect()}
    assert inv["a.csv"]["n_rows"] == 2 and inv["a.csv"]["n_cols"] == 2 and inv["b.csv"]["n_rows"] == 1


def test_stream_scoring(spark, tmp_path):
    from quire.operators.preprocess import Preprocessor
    from quire.streaming import score_stream
    df = _toy(spark)
    model = Preprocessor().fit(df, ["a", "b"], "y")
    src = tmp_path / "in"
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    got = []
    q = score_stream(stream, model, ["k"], lambda b, i: got.extend(b.collect()), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert len(got) == 240 and set(got[0].asDict()) == {"k", "a", "b"}


def test_mixture_and_text_selection(spark):
    from quire.plans.experts import mixture_of_experts, text_aware_selection
    df = _toy(spark, n=300).withColumn("kind", F.when(F.col("a") > 1, "high").otherwise("low")) \
        .withColumn("site", F.concat(F.lit("s"), (F.col("k") % 3).cast("string")))
    train, test = df.where("k % 5 != 0"), df.where("k % 5 = 0")
    pred = mixture_of_experts(train, test, {"first": ["a"], "rest": ["b", "c"]}, "k", "y", k=3).toPandas()
    assert len(pred) == 60 and pred["score"].between(0, 1).all()
    assert {"p_first", "p_rest"} <= set(pred.columns)
    pred2, kept = text_aware_selection(train, test, "k", "y", ["a", "b"], ["kind", "site"], min_df=2)
    assert pred2.count() == 60 and len(kept) >= 1
    assert all(k in ("a", "b") or k.startswith("text:") for k in kept)
