"""Forests whose subtrees stay in a table, and what trees cost the driver."""
import numpy as np
import pytest

from quire.operators import trees
from quire.operators.models import build_model

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)).round(2)
    y = ((x[:, 0] + .5 * x[:, 1] + .6 * rng.normal(size=500)) > 1.0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int").repartition(3).cache()


@pytest.mark.parametrize("name", ["random_forest", "balanced_random_forest", "extra_trees"])
@pytest.mark.parametrize("local", [trees.LOCAL_ROWS, 60], ids=["roots", "tops"])
def test_scores_are_the_mean_of_whole_trees(frame, monkeypatch, name, local):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    model = build_model(name, {"n_estimators": 6}, key="id").fit(frame, FEATURES, "y")
    whole = model.trees
    # The driver holds the nodes of many rows only.
    assert sum(len(t.feature) for t in model.tops.values()) < sum(len(t.feature) for t in whole) / 3
    pdf = frame.toPandas()
    bins = model.codes(pdf[FEATURES].to_numpy(dtype=float))
    want = np.mean([t.values(model.rule)[t.route(bins)] for t in whole], axis=0)
    got = model.predict(frame, ["id", "y"]).toPandas().set_index("id").loc[pdf["id"]]
    assert np.allclose(got["score"], want) and len(got) == 500
    assert ((got["score"] >= 0.5).astype(int) == got["prediction"]).all() and (got["prediction"] == got["y"]).mean() > 0.85


def test_rows_of_a_node_split_as_its_histogram_does():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, rule = int(rng.integers(2, 200)), trees.Rule(trial % 2 == 0, 0.1, 1.0, float(rng.integers(1, 4)), 0.2)
        bins = rng.integers(0, [3, 40, 256], (n, 3)).astype(np.uint8)
        stats = np.stack([rng.random(n), rng.random(n), np.ones(n)], axis=1)
        hist = trees.histogram(bins, stats, np.arange(3))
        for seed in (None, [trial, 1]):
            a, b = trees.split_rows(bins, stats, rule, seed), trees.best_split(hist, rule, seed)
            assert (a is None) == (b is None)
            assert a is None or (a[1:3] == b[1:3] and np.allclose(a[0], b[0]) and np.allclose(a[3], b[3]) and np.allclose(a[4], b[4]))


def test_wide_rows_leave_fewer_to_a_task():
    assert trees.local_rows(10) == trees.LOCAL_ROWS and trees.local_rows(4096) * 4096 <= trees.LOCAL_CELLS


def test_random_forest_bags_by_key(frame):
    fit = lambda f: build_model("random_forest", {"n_estimators": 5}, key="id").fit(f, FEATURES, "y")
    a, b = ({r["id"]: r["score"] for r in fit(f).predict(frame, ["id"]).collect()} for f in (frame, frame.repartition(7)))
    assert a == pytest.approx(b)
