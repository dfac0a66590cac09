"""Epochs in one task take the steps that passes over the table take."""
import numpy as np
import pytest

from quire.operators import mlp


def test_epochs_in_a_task_equal_passes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > .5)) for a, b in x], "a double, b double, y int").repartition(3).cache()
    calls, whole = [], mlp._pass
    monkeypatch.setattr(mlp, "_pass", lambda *a: calls.append(1) or whole(*a))
    kw = dict(hidden_layer_sizes=(6,), max_iter=3, batch_size=100, learning_rate_init=0.01)
    here = mlp.fit_perceptron(df, ["a", "b"], "y", **kw)
    assert not calls  # no job for a step
    monkeypatch.setattr(mlp, "LOCAL_CELLS", 0)
    passes = mlp.fit_perceptron(df, ["a", "b"], "y", **kw)
    assert calls and here.epochs == passes.epochs == 3
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(here.weights, passes.weights))
