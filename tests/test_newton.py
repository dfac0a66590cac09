"""Proximal Newton steps against proximal gradients, and what they cost."""
import math

import numpy as np

from quire.operators import proximal
from quire.operators.models import build_model

FEATURES = ["a", "b", "c", "d"]


def frame(spark, n=400):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 4)) * [1, 3, .2, 1]
    x[:, 3] = x[:, 0]  # a copy of another column
    y = ((x[:, 0] - .4 * x[:, 1] + rng.normal(size=n)) > 1).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y int, fold int").repartition(3).cache()


def test_newton_equals_gradients_in_few_passes(spark, monkeypatch):
    rows = proximal.prepared(frame(spark), FEATURES, "y", "fold")
    settings = [proximal.Setting(c, share, f) for c, share in ((0.1, 0.5), (0.02, 1.0), (5.0, 0.0)) for f in (None, 0, 2)]
    passes, whole = [], proximal._second_order
    monkeypatch.setattr(proximal, "_second_order", lambda *a: passes.append(1) or whole(*a))
    got = proximal.newton(rows, settings)
    assert len(passes) <= 15
    want = proximal.fit(rows, settings, tolerance=1e-9)
    # Copies may share a weight in any way under L1; margins and intercepts are unique.
    a, b = got.copy(), want.copy()
    a[0] += a[3]
    b[0] += b[3]
    assert np.allclose(np.delete(a, 3, 0), np.delete(b, 3, 0), atol=1e-5)


def test_logistic_preset_takes_few_jobs_and_knows_one_class(spark):
    df = frame(spark)
    sc = spark.sparkContext
    sc.setJobGroup("newton-test", "fit")
    model = build_model("logistic_regression").fit(df, FEATURES, "y")
    jobs = len(sc.statusTracker().getJobIdsForGroup("newton-test"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    got = model.predict(df, ["y"]).toPandas()
    assert (got["prediction"] == got["y"]).mean() > 0.75
    one = build_model("logistic_regression").fit(df.where("y = 1"), FEATURES, "y")
    assert one.intercept == math.inf and {r["score"] for r in one.predict(df).collect()} == {1.0}


def test_no_penalty(spark):
    df = frame(spark)
    free = build_model("logistic_regression", {"C": math.inf}).fit(df, FEATURES[:3], "y")
    rows = proximal.prepared(df, FEATURES[:3], "y")
    w = np.append(free.weights, free.intercept)[:, None]
    loss, g, _ = proximal._second_order(rows, w, np.array([-2]), np.array([[400 / (2 * n) for n in (df.where("y = 0").count(), df.where("y = 1").count())]]))[0]
    assert np.abs(g).max() < 1e-4
