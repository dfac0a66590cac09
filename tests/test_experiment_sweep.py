"""Concurrent sweep, saved experiments, ordered target statistics, random cuts and monotone quantifications."""
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import trees
from quire.operators.reducers.catpca import CATPCAReducer, monotone, pool_adjacent
from quire.operators.target_stats import ordered_target_means
from quire.plans.experiment import run_experiment, sweep
from quire.sources.results import load_results


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4)).round(3)
    y = (x[:, 0] + .4 * rng.normal(size=240) > .8).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(e=rng.integers(0, 3, 240).astype(float), k=np.arange(240), y=y)
    return spark.createDataFrame(pdf)


def test_sweep_equals_serial_runs(spark, cohort):
    features = list("abcde")
    bad = {"methods": [{"type": "no such reducer"}]}
    methods = ["pca", "famd", bad, "catpca", "hellinger"]
    kw = dict(models=["logistic_regression"], cv_folds=2)
    tests, cvs, failures = sweep(cohort, features, "k", "y", methods, parallelism=4, **kw)
    assert [name for name, _ in failures] == [str(bad)] and "ValueError" in failures[0][1]
    assert [r["method"] for r in tests.collect()] == ["pca", "famd", "catpca", "hellinger"] and cvs.count() == 4 * len(cvs.groupBy().agg(F.collect_set("metric")).first()[0]) if "metric" in cvs.columns else True
    for m in ("pca", "catpca"):
        one = run_experiment(cohort, features, "k", "y", m, **kw).test_results.toPandas()
        got = tests.where(F.col("method") == m).drop("method").toPandas()
        pd.testing.assert_frame_equal(got, one)


def test_saved_experiment_reads_back(spark, cohort, tmp_path):
    r = run_experiment(cohort, list("abcde"), "k", "y", "pca", models=["logistic_regression"], cv_folds=2, out_dir=str(tmp_path))
    tests, cvs, summary, skipped = load_results(spark, str(tmp_path), ["pca", "famd"], {"pca": "Principal components"}, {"logistic_regression": "Logistic"})
    assert skipped == ["famd"] and summary.first()["dr_method"] == "pca"
    row, saved = r.test_results.first().asDict(), tests.first().asDict()
    assert all(saved[c] == pytest.approx(v) for c, v in row.items() if isinstance(v, float))
    assert saved["method_label"] == "Principal components" and saved["model_label"] == "Logistic" and cvs.count() == r.cv_results.count()
    train = spark.read.parquet(f"{tmp_path}/data/method=pca/split=train")
    assert train.columns[:2] == ["k", "label"] and train.count() == summary.first()["n_train"]
    assert spark.read.parquet(f"{tmp_path}/data").groupBy("split").count().count() == 4


def test_ordered_target_means(spark):
    import hashlib
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice(["a", "b", None], p=[.8, .15, .05]), int(rng.random() < .3) if i % 11 else None) for i in range(500)]
    got = {r["k"]: r["c_target"] for r in ordered_target_means(spark.createDataFrame(rows, "k long, c string, y int"), ["c"], "y", "k", weight=2.0).collect()}
    known = [y for _, _, y in rows if y is not None]
    prior, seen = sum(known) / len(known), {}
    for k, c, y in sorted(rows, key=lambda r: hashlib.md5(f"42|order|{r[0]}".encode()).hexdigest()):
        n, s = seen.get(c, (0, 0))
        assert got[k] == pytest.approx((s + 2 * prior) / (n + 2))
        if y is not None:
            seen[c] = n + 1, s + y


def test_extra_trees_cut_at_random(spark, cohort):
    model = trees.fit_extra_trees(cohort, list("abcd"), "y", n_estimators=30, max_depth=6)
    got = model.predict(cohort, ["y"]).toPandas()
    assert (got["prediction"] == got["y"]).mean() > 0.85
    roots = {(t.feature[0], t.cut[0]) for t in model.trees}
    assert len(roots) > 15
    again = trees.fit_extra_trees(cohort.repartition(5), list("abcd"), "y", n_estimators=30, max_depth=6)
    assert [t.cut for t in again.trees] == [t.cut for t in model.trees]
    hist = np.zeros((2, trees.BINS, 3))
    hist[0, [3, 9], :] = 5
    hist[1, 7, :] = 10
    mask = trees.random_cuts(hist, [1, 2])
    assert mask[0].sum() == 1 and 3 <= mask[0].argmax() < 9 and not mask[1].any()


def test_pooling_equals_min_max_formula():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 8)
        v, w = rng.normal(size=n).round(2), rng.integers(1, 5, n).astype(float)
        want = [max(min(np.average(v[a:b + 1], weights=w[a:b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(pool_adjacent(v, w), want)
        m = monotone(v, w)
        assert (np.diff(m) >= -1e-12).all() or (np.diff(m) <= 1e-12).all()
        best = min(float(w @ (np.sort(x) * s - v) ** 2) for s in (1,) for x in [np.array(want)])
        assert float(w @ (m - v) ** 2) <= best + 1e-9


def test_ordered_catpca_is_monotone(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=400)
    pdf = pd.DataFrame({"a": base, "o": np.clip(np.round(base * 1.5 + rng.normal(size=400)), -2, 3), "t": rng.choice(["low", "mid", "top"], 400)})
    free = CATPCAReducer(n_components=1).fit(spark.createDataFrame(pdf), ["a", "o", "t"])
    kept = CATPCAReducer(n_components=1, ordered=True).fit(spark.createDataFrame(pdf), ["a", "o", "t"])
    for c in ("o", "t"):
        q = np.array([kept.quantifications[c][v] for v in sorted(kept.quantifications[c])])
        assert (np.diff(q) >= -1e-12).all() or (np.diff(q) <= 1e-12).all()
    assert free.quantifications.keys() == kept.quantifications.keys()
    assert len(list(itertools.chain(*kept.quantifications.values()))) == 9
