"""Histogram trees, balanced bags and the perceptron against plain numpy."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import mlp, trees
from quire.operators.models import build_model

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)).round(2)
    y = ((x[:, 0] + .5 * x[:, 1] + .3 * rng.normal(size=600)) > 1.3).astype(int)
    rows = [(i, float(a), float(b) if i % 50 else None, float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(4).cache()


def plain_tree(bins, stats, rule, depth):
    """Level-wise growth with loops over features and cuts."""
    total = stats.sum(axis=0)
    if depth == 0:
        return total
    best = None
    for j in range(bins.shape[1]):
        for t in range(255):
            left = bins[:, j] <= t
            l, r = stats[left].sum(axis=0), stats[~left].sum(axis=0)
            if l[2] < rule.min_rows or r[2] < rule.min_rows or l[1] < rule.min_hessian or r[1] < rule.min_hessian:
                continue
            gain = rule.worth(l) + rule.worth(r) - rule.worth(total)
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                best = gain, j, t
    if best is None:
        return total
    left = bins[:, best[1]] <= best[2]
    return best[1], best[2], plain_tree(bins[left], stats[left], rule, depth - 1), plain_tree(bins[~left], stats[~left], rule, depth - 1)


def shape(tree, node=0):
    if tree.feature[node] < 0:
        return tree.sums[node]
    return tree.feature[node], tree.cut[node], shape(tree, tree.left[node]), shape(tree, tree.right[node])


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if isinstance(a, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return np.allclose(a, b, atol=1e-6)


@pytest.mark.parametrize("local", [trees.LOCAL_ROWS, 0], ids=["finished in a task", "by histograms"])
def test_first_boosted_tree(frame, monkeypatch, local):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    model = trees.fit_booster(frame, FEATURES, "y", "id", n_estimators=1, max_depth=3, min_child_samples=5, min_child_weight=0.5,
                              subsample=1.0, colsample_bytree=1.0, reg_alpha=0.2, reg_lambda=1.5, pos_weight=3.0)
    pdf = frame.toPandas()
    bins = model.codes(pdf[FEATURES].to_numpy(dtype=float))
    y = pdf["y"].to_numpy()
    w = np.where(y == 1, 3.0, 1.0)
    stats = np.stack([w * (0.5 - y), w * 0.25, np.ones(len(y))], axis=1)
    rule = trees.Rule(True, 0.2, 1.5, 5.0, 0.5)
    assert same(shape(model.trees[0]), plain_tree(bins, stats, rule, 3))
    leaf = model.trees[0].sums[-1]
    want = -math.copysign(max(abs(leaf[0]) - .2, 0), leaf[0]) / (leaf[1] + 1.5) * 0.05
    assert model.values[0][-1] == pytest.approx(want)


def test_leaf_wise_takes_largest_gains(frame, monkeypatch):
    kw = dict(n_estimators=1, subsample=1.0, colsample_bytree=1.0, min_child_samples=5)
    full = trees.fit_booster(frame, FEATURES, "y", "id", max_depth=8, **kw).trees[0]
    few = trees.fit_booster(frame, FEATURES, "y", "id", num_leaves=6, **kw).trees[0]
    assert sum(f < 0 for f in few.feature) == 6
    assert same(shape(few), shape(full.best_first(6)))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 0)
    assert same(shape(few), shape(trees.fit_booster(frame, FEATURES, "y", "id", num_leaves=6, **kw).trees[0]))


def test_margins_survive_refresh(frame, monkeypatch):
    kw = dict(n_estimators=7, max_depth=2, min_child_samples=5)
    a = trees.fit_booster(frame, FEATURES, "y", "id", **kw)
    monkeypatch.setattr(trees, "REFRESH", 2)
    b = trees.fit_booster(frame, FEATURES, "y", "id", **kw)
    assert all(same(shape(x), shape(y)) for x, y in zip(a.trees, b.trees))


@pytest.mark.parametrize("name, base, other", [
    ("lightgbm", {}, {"num_leaves": 3}), ("lightgbm", {}, {"reg_alpha": 5.0}), ("lightgbm", {}, {"reg_lambda": 50.0}), ("lightgbm", {}, {"min_child_samples": 60}),
    ("lightgbm", {}, {"subsample": 0.5}), ("lightgbm", {}, {"colsample_bytree": 0.4}), ("lightgbm", {}, {"learning_rate": 0.3}),
    ("xgboost", {}, {"max_depth": 2}), ("xgboost", {}, {"reg_alpha": 5.0}), ("xgboost", {}, {"reg_lambda": 50.0}), ("xgboost", {}, {"min_child_weight": 20}),
])
def test_booster_parameters_act(frame, name, base, other):
    scores = [[r["score"] for r in build_model(name, {"n_estimators": 3, **base, **p}, 2.0, key="id").fit(frame, FEATURES, "y").predict(frame, ["id"]).orderBy("id").collect()]
              for p in ({}, other)]
    assert scores[0] != scores[1]


def test_unknown_parameters_are_refused(frame):
    with pytest.raises(ValueError):
        build_model("lightgbm", {"leaves": 3}).fit(frame, FEATURES, "y")
    with pytest.raises(ValueError):
        build_model("random_forest", {"max_depth": 40}).fit(frame, FEATURES, "y")


def test_balanced_forest(frame, spark):
    fit = lambda f: build_model("balanced_random_forest", {"n_estimators": 40, "min_samples_leaf": 2}, key="id").fit(f, FEATURES, "y")
    model = fit(frame)
    got = {r["id"]: r["score"] for r in model.predict(frame, ["id"]).collect()}
    y = {r["id"]: r["y"] for r in frame.collect()}
    auc = np.mean([(got[i] > got[j]) + .5 * (got[i] == got[j]) for i in y if y[i] for j in y if not y[j]])
    assert auc > 0.95
    # Each tree's root holds its own bag, about the same size for both classes.
    sizes = np.array([t.sums[0] for t in model.trees])
    n1 = sum(y.values())
    assert len({tuple(s) for s in sizes.tolist()}) > 20 and np.allclose(sizes[:, :2].mean(axis=0), n1, rtol=0.1)
    assert np.allclose(sizes[:, 0] + sizes[:, 1], sizes[:, 2])
    # The bag depends on the key alone: other partitions, same model.
    again = {r["id"]: r["score"] for r in fit(frame.repartition(7)).predict(frame, ["id"]).collect()}
    assert again == pytest.approx(got)
    filled = frame.na.fill(0.0)
    plain = build_model("random_forest", {"n_estimators": 40, "min_samples_leaf": 2}).fit(filled, FEATURES, "y")
    assert {r["id"]: r["score"] for r in plain.predict(filled, ["id"]).collect()} != pytest.approx(got)


def test_bag_counts_columns_equal_numpy(spark):
    steps = [trees.poisson_steps(r) for r in trees.class_rates(900, 300)]
    line = trees.lines(3, 5)
    df = spark.range(1200).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    h1, h2 = trees.key_hashes(F.col("id"))
    rows = df.select("id", "y", h1.alias("h1"), h2.alias("h2"), *[trees.bag_count_column(h1, h2, F.col("y"), l, steps).alias(f"n{k}") for k, l in enumerate(line)]).toPandas()
    for k, l in enumerate(line):
        assert (trees.bag_counts(rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows["y"].to_numpy(), l, steps) == rows[f"n{k}"]).all()
        assert abs(rows[f"n{k}"].sum() - 600) < 120
    assert (rows["n0"] > 1).any() and np.corrcoef(rows["n0"], rows["n1"])[0, 1] < 0.2


def test_easy_ensemble(frame):
    model = trees.fit_easy_ensemble(frame, FEATURES, "y", "id", n_estimators=5, rounds=8)
    assert len(model.bags) == 5 and all(len(b) <= 8 for b in model.bags)
    pdf = frame.toPandas()
    x, y = pdf[FEATURES].to_numpy(dtype=float), pdf["y"].to_numpy()
    bins = model.codes(x)
    h = frame.select("id", *[c.alias(n) for c, n in zip(trees.key_hashes(F.col("id")), ("h1", "h2"))]).toPandas().set_index("id").loc[pdf["id"]]
    limits = [int(r * trees.PRIME) for r in trees.class_rates(int((y == 0).sum()), int((y == 1).sum()))]
    for k, own in enumerate(model.bags):
        used = trees.draw(h["h1"].to_numpy(), h["h2"].to_numpy(), trees.lines(5, 42)[k]) < np.where(y == 1, limits[1], limits[0])
        assert used[y == 1].all()
        w = np.ones(used.sum())
        for i, a in zip(own, model.weights[k]):
            best = min(np.minimum(w[l & (y[used] == 0)].sum(), w[l & (y[used] == 1)].sum()) + np.minimum(w[~l & (y[used] == 0)].sum(), w[~l & (y[used] == 1)].sum())
                       for j in range(3) for t in range(255) for l in [bins[used, j] <= t]) / w.sum()
            wrong = model.values[i][model.trees[i].route(bins[used])] != y[used]
            assert w[wrong].sum() / w.sum() == pytest.approx(best) and a == pytest.approx(math.log((1 - best) / best))
            w = w * np.exp(a * wrong)
    got = model.predict(frame, ["y"]).toPandas()
    assert (got["prediction"] == got["y"]).mean() > 0.85


def test_equal_rows_are_drawn_apart(spark):
    rows = spark.createDataFrame([(i, 1.0, i % 4 == 0) for i in range(400)], "id long, a double, y boolean").select("id", "a", F.col("y").cast("int").alias("y"))
    b = trees.binned(rows, ["a"], "y", trees.quantile_cuts(rows, ["a"]), "id").toPandas()
    used = trees.draw(b["h1"], b["h2"], trees.lines(1, 42)[0]) < trees.PRIME // 3
    assert 60 < used[b["y"] == 0].sum() < 140


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    for act in ("relu", "tanh"):
        w = mlp.start_weights([3, 5, 4, 1], act, 1)
        x, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
        _, grads = mlp.loss_and_gradient(w, x, y, act)
        for k, v in enumerate(w):
            for at in list(np.ndindex(v.shape))[:6]:
                old, e = v[at], 1e-6
                v[at] = old + e
                up = mlp.loss_and_gradient(w, x, y, act)[0]
                v[at] = old - e
                down = mlp.loss_and_gradient(w, x, y, act)[0]
                v[at] = old
                assert grads[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-5)


def test_perceptron_learns_and_parameters_act(frame):
    run = lambda **p: build_model("mlp", {"hidden_layer_sizes": (8,), "max_iter": 3, **p}).fit(frame, FEATURES, "y")
    base = run().weights
    for other in ({"activation": "tanh"}, {"alpha": 50.0}, {"learning_rate_init": 0.01}, {"batch_size": 32}, {"max_iter": 1}, {"hidden_layer_sizes": (8, 4)}):
        w = run(**other).weights
        assert len(w) != len(base) or any(not np.allclose(a, b) for a, b in zip(w, base)), other
    model = run(max_iter=60, learning_rate_init=0.02)
    assert model.epochs <= 60
    got = model.predict(frame, ["y"]).toPandas()
    assert (got["prediction"] == got["y"]).mean() > 0.9
