"""Experts of all families and folds take their passes together."""
import numpy as np
import pytest

from quire.operators import proximal
from quire.plans.experts import mixture_of_experts

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] - .5 * x[:, 2] + rng.normal(size=300)) > .8).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int, fold int").repartition(3).cache()


def test_passes_do_not_grow_with_families(frame, monkeypatch):
    passes, whole = [], proximal._second_order
    monkeypatch.setattr(proximal, "_second_order", lambda *a: passes.append(1) or whole(*a))
    train, test = frame.where("id < 240").drop("fold"), frame.where("id >= 240").drop("fold")
    pred = mixture_of_experts(train, test, {"first": ["a"], "rest": ["b", "c"]}, "id", "y", k=3)
    # The experts' shared passes and the gate's.
    assert len(passes) <= 24 and pred.count() == 60
