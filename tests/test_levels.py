"""Trees grown a level at a time, and leaf-wise trees from sibling histograms, split every node as its rows alone do."""
import math
import time

import numpy as np
import pytest

from quire.operators import trees


def data(n=700, seed=0):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, [3, 40, 256, 256, 2], (n, 5)).astype(np.uint8)
    y = ((bins[:, 2] / 64 + bins[:, 0] + 2 * rng.random(n)) > 4.5).astype(int)
    count = rng.integers(1, 4, n).astype(float)
    return bins, np.stack([.7 * count * (y == 0), 2.5 * count * (y == 1), count], axis=1), trees.logistic_stats(rng.normal(size=n), y, 3.0, np.ones(n, bool))


def check(tree, bins, stats, rule, columns, seed, depth):
    """Every inner node has the split that ``split_rows`` finds for its rows, every leaf has none."""
    rows, inner = {0: np.arange(len(bins))}, 0
    for node in range(len(tree.feature)):
        own = rows[node]
        assert np.allclose(tree.sums[node], stats[own].sum(axis=0))
        pure = not rule.newton and min(tree.sums[node][:2]) <= 0
        want = None
        if tree.depth[node] < depth and len(own) > 1 and not pure and stats[own][:, 2].sum() >= 2 * rule.min_rows:
            want = trees.split_rows(bins[own[:, None], columns(node)], stats[own], rule, seed(node))
        if tree.feature[node] < 0:
            assert want is None
            continue
        inner += 1
        assert (int(columns(node)[want[1]]), want[2]) == (tree.feature[node], tree.cut[node]) and want[0] == pytest.approx(tree.gain[node])
        left = bins[own, tree.feature[node]] <= tree.cut[node]
        rows[tree.left[node]], rows[tree.right[node]] = own[left], own[~left]
    return inner


@pytest.mark.parametrize("random", [False, True])
@pytest.mark.parametrize("newton", [False, True])
def test_levels_split_every_node_as_its_rows_do(random, newton):
    every, inner = np.arange(5), 0
    for trial in range(8):
        bins, shares, gradients = data(seed=trial)
        stats = gradients if newton else shares
        rule = trees.Rule(newton, 0.1, 1.0, float(1 + trial % 4), 0.05)
        columns = (lambda n: trees.node_columns(9, trial, n, every, 2)) if trial % 2 else (lambda n: every)
        seed = (lambda n: [9, trial, n, 3]) if random else (lambda n: None)
        depth = (3, 12, math.inf)[trial % 3]
        tree = trees.grow_here(bins, stats, rule, columns, depth, math.inf, seed)
        inner += check(tree, bins, stats, rule, columns, seed, depth)
    assert inner > 100


def test_leaves_from_sibling_histograms():
    every = np.arange(5)
    bins, _, stats = data(3000)
    rule = trees.Rule(True, 0.0, 1.0, 10.0, 1e-3)
    few = trees.grow_here(bins, stats, rule, lambda n: every, math.inf, 15)
    full = trees.grow_here(bins, stats, rule, lambda n: every, math.inf, math.inf).best_first(15)
    assert sum(f < 0 for f in few.feature) == 15
    assert few.feature == full.feature and few.cut == full.cut and np.allclose(few.sums, full.sums)


def test_no_rows_and_one_class():
    every, rule = np.arange(5), trees.Rule()
    bins, shares, _ = data(50)
    for leaves in (4, math.inf):
        assert trees.grow_here(bins[:0], shares[:0], rule, lambda n: every, 5, leaves).feature == [-1]
        one = shares * [1, 0, 1]
        assert trees.grow_here(bins, one, rule, lambda n: every, 5, leaves).feature == [-1]


def test_many_nodes_take_little_time():
    rng = np.random.default_rng(1)
    n, every = 40_000, np.arange(5)
    bins = rng.integers(0, 256, (n, 5)).astype(np.uint8)
    y = rng.integers(0, 2, n)
    stats = np.stack([y == 0, y == 1, np.ones(n)], axis=1).astype(float)
    began = time.process_time()
    tree = trees.grow_here(bins, stats, trees.Rule(min_rows=3.0), lambda n: every, math.inf, math.inf)
    # A node at a time takes about 0.2 ms a node.
    assert len(tree.feature) > 5000 and time.process_time() - began < 1e-4 * len(tree.feature) + 0.5


def test_a_task_boosts_many_rounds_a_job(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)).round(2)
    df = spark.createDataFrame([(i, *map(float, r), int(r[0] > .5)) for i, r in enumerate(x)], "id long, a double, b double, y int").cache()
    calls, whole = [], trees._boost_here
    monkeypatch.setattr(trees, "_boost_here", lambda *a: calls.append(1) or whole(*a))
    kw = dict(n_estimators=45, max_depth=2)
    a = trees.fit_booster(df, ["a", "b"], "y", "id", **kw)
    assert len(calls) == 1 and len(a.trees) == 45
    monkeypatch.setattr(trees, "HERE_ROWS", 0)
    b = trees.fit_booster(df, ["a", "b"], "y", "id", **kw)
    assert len(calls) == 4
    assert all(p.feature == q.feature and p.cut == q.cut and np.allclose(p.sums, q.sums) for p, q in zip(a.trees, b.trees))
