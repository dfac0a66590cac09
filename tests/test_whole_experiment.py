"""experiment_pca asks for the whole experiment: all models, all trials of each, five folds."""
import inspect
from types import SimpleNamespace

import numpy as np
import pandas as pd

from quire.operators.models import DEFAULT_TRIALS, MODEL_NAMES
from quire.plans import experiment, model_queries


def test_no_parameter_leaves_out_work(monkeypatch):
    asked = {}

    def run(*args, **kw):
        call = inspect.signature(experiment.run_experiment).bind(*args, **kw)
        call.apply_defaults()
        asked.update(call.arguments)
        return SimpleNamespace(test_results="rows")

    monkeypatch.setattr(model_queries, "run_experiment", run)
    monkeypatch.setattr(model_queries, "cohort_features", lambda *_: None)
    assert model_queries.q_experiment_pca(None, "") == "rows"
    assert asked["skip_tuning"] is False and asked["n_trials"] is None and asked["cv_folds"] == 5 and asked["dr_config"] == "pca"
    assert set(asked["models"] or MODEL_NAMES) == set(DEFAULT_TRIALS)


def test_tuned_parameters_are_those_that_are_scored(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3)).round(3)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(k=np.arange(120), y=(x[:, 0] > .5).astype(int))
    built, build = [], experiment.tune
    monkeypatch.setattr(experiment, "tune", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    r = experiment.run_experiment(spark.createDataFrame(pdf), list("abc"), "k", "y", "pca", models=["logistic_regression", "mlp"],
                                  n_trials=2, skip_tuning=False, cv_folds=2)
    assert r.best_params == dict(zip(["logistic_regression", "mlp"], [params for params, _ in built]))
    assert [x["model"] for x in r.test_results.collect()] == ["logistic_regression", "mlp"]
    assert r.summary.first()["skip_tuning"] is False
