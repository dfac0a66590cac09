"""The shared-pass proximal solver against plain numpy, and the Hellinger refinement that uses it."""
import numpy as np
import pandas as pd
import pytest

from quire.operators import proximal as P
from quire.operators.hellinger import HellingerSelector


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] - .8 * x[:, 1] + .5 * rng.normal(size=500) > .9).astype(int)
    return pd.DataFrame(x, columns=list("abcdef")).assign(y=y, fold=np.arange(500) % 5)


def plain(x, y, c, ratio, loss, intercept_penalty, steps=60_000):
    """Plain proximal gradient, small steps, no momentum."""
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    x = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / ((0.25 if loss == "log" else 2) * np.linalg.eigvalsh((x.T * w) @ x)[-1] + 1 / c)
    pen = np.ones(x.shape[1])
    pen[-1] = float(intercept_penalty)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        m = x @ b
        if loss == "log":
            d = 1 / (1 + np.exp(-m)) - y
        else:
            s = 2 * y - 1
            d = -2 * s * np.maximum(0, 1 - s * m)
        z = b - rate * (x.T @ (w * d) + (1 - ratio) / c * pen * b)
        new = np.sign(z) * np.maximum(np.abs(z) - rate * ratio / c * pen, 0)
        if np.abs(new - b).max() < 1e-9:
            return new
        b = new
    return b


@pytest.mark.parametrize("loss, penalised", [("log", False), ("squared_hinge", True)])
def test_many_models_equal_single_ones(spark, pdf, loss, penalised):
    rows = P.prepared(spark.createDataFrame(pdf), list("abcdef"), "y", "fold")
    settings = [P.Setting(c, r, f) for c, r in ((0.01, 1.0), (0.02, 0.3), (1.0, 0.0)) for f in (None, 2)]
    got = P.fit(rows, settings, loss, penalised, tolerance=1e-8)
    for k, s in enumerate(settings):
        own = pdf if s.fold is None else pdf[pdf["fold"] != s.fold]
        want = plain(own[list("abcdef")].to_numpy(), own["y"].to_numpy(), s.c, s.l1_ratio, loss, penalised)
        assert np.allclose(got[:, k], want, atol=2e-4), s
        assert ((np.abs(got[:, k]) > 0) == (np.abs(want) > 0)).all(), s


def test_zero_pattern_of_l1_weights(spark, pdf):
    got = P.l1_weights(spark.createDataFrame(pdf), list("abcdef"), "y", 0.01)
    want = plain(pdf[list("abcdef")].to_numpy(), pdf["y"].to_numpy(), 0.01, 1.0, "squared_hinge", True)
    assert [v != 0 for v in got.values()] == [v != 0 for v in want[:-1]] and any(v == 0 for v in got.values())


def test_held_out_f1(spark, pdf):
    rows = P.prepared(spark.createDataFrame(pdf), list("abcdef"), "y", "fold")
    settings = [P.Setting(c, 0.5, f) for c in (0.05, 2.0) for f in range(5)]
    w = P.fit(rows, settings)
    got = P.mean_f1(rows, w, settings)
    for c, f1 in zip((0.05, 2.0), got):
        each = []
        for k, s in enumerate(settings):
            if s.c == c:
                own = pdf[pdf["fold"] == s.fold]
                p = own[list("abcdef")].to_numpy() @ w[:-1, k] + w[-1, k] >= 0
                tp = (p & (own["y"] == 1)).sum()
                each.append(2 * tp / (2 * tp + (p & (own["y"] == 0)).sum() + (~p & (own["y"] == 1)).sum()))
        assert f1 == pytest.approx(np.mean(each))


def test_selector_outcomes(spark, pdf):
    df = spark.createDataFrame(pdf)
    names = list("abcdef")
    model = HellingerSelector(n_features=2, svm_c=0.01).fit(df, names, "y")
    assert model.outcome.startswith("refined") and set(model.selected) == {"a", "b"}
    few = HellingerSelector(n_features=5, svm_c=1e-5).fit(df, names, "y")
    assert few.outcome.startswith("ranked: only 0") and len(few.selected) == 5
    assert HellingerSelector(n_features=6).fit(df, names, "y").outcome == "ranked"
    texts = spark.createDataFrame(pdf.assign(t=np.where(pdf["y"] == 1, "p", "q")))
    mixed = HellingerSelector(n_features=2).fit(texts, [*names, "t"], "y")
    assert mixed.outcome.startswith("ranked: text") and mixed.selected[0] == "t" and dict(mixed.scores)["t"] == pytest.approx(1.0)
