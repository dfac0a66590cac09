"""Models of all folds and families from shared passes equal models fitted one by one."""
import numpy as np
import pytest

from quire.operators import proximal
from quire.operators.models import build_model, fit_folds, held_out
from quire.plans.experiment import cross_validate

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] - .5 * x[:, 2] + rng.normal(size=300)) > .8).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int, fold int").repartition(3).cache()


def test_folds_and_families_equal_single_fits(frame):
    spec = build_model("logistic_regression")
    got = fit_folds(spec, frame, FEATURES, "y", [0, 1, 2, None], [["a"], ["c", "b"], FEATURES])
    for own, models in zip((["a"], ["c", "b"], FEATURES), got):
        for f, m in zip((0, 1, 2, None), models):
            one = spec.fit(frame if f is None else frame.where(f"fold <> {f}"), own, "y")
            assert m.features == own and np.allclose(m.weights, one.weights, atol=1e-7) and abs(m.intercept - one.intercept) < 1e-7
    rows = {r["id"]: r for r in held_out(got[2][:3], frame, ["id", "y"]).collect()}
    for f in range(3):
        for r in got[2][f].predict(frame.where(f"fold = {f}"), ["id"]).collect():
            assert rows[r["id"]]["score"] == pytest.approx(r["score"]) and rows[r["id"]]["prediction"] == r["prediction"]
    assert len(rows) == 300


def test_passes_do_not_grow_with_folds_and_families(frame, monkeypatch):
    passes, whole = [], proximal._second_order
    monkeypatch.setattr(proximal, "_second_order", lambda *a: passes.append(1) or whole(*a))
    row = cross_validate(build_model("logistic_regression"), frame.drop("fold"), FEATURES, "y", "id", k=5).first()
    assert len(passes) <= 12 and 0.6 < row["accuracy_mean"] < 1


def test_other_experts_are_fitted_one_by_one(frame, monkeypatch):
    got, = fit_folds(build_model("extra_trees", {"n_estimators": 3}), frame, FEATURES, "y", [0, 1, 2])
    assert held_out(got, frame, ["id"]).count() == 300


def test_a_fold_without_rows_counts_as_zero(frame):
    few = frame.where("id in (0, 1, 2)").select("id", *FEATURES, (frame["id"] % 2).cast("int").alias("y"))
    row = cross_validate(build_model("logistic_regression"), few, FEATURES, "y", "id", k=4).first()
    assert 0 <= row["accuracy_mean"] < 1
