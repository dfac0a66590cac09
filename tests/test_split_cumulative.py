import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators.cumulative import global_row_number, running_sum
from quire.operators.split import allocate, stratified_folds, stratified_split, holdout_quota


def test_allocation():
    assert holdout_quota({0: 2852, 1: 171}) == {0: 571, 1: 34}
    q = holdout_quota({0: 10, 1: 1})
    assert sum(q.values()) == 3
    assert allocate({0: 5, 1: 5}, 3) == {0: 2, 1: 1}


def test_running_sum_skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))  # one group holds most rows
    pdf = pd.DataFrame({"g": g, "o": rng.permutation(n), "v": rng.integers(0, 5, n)})
    df = spark.createDataFrame(pdf)
    out = running_sum(df, ["g"], ["o"], ["v"], num_slices=7, max_groups=4).toPandas()
    exp = pdf.sort_values(["g", "o"]).assign(cum=lambda d: d.groupby("g")["v"].cumsum())
    m = out.merge(exp, on=["g", "o"])
    assert len(m) == n and (m["cum_v"] == m["cum"]).all()
    rn = global_row_number(df, [], ["o"], num_slices=5).toPandas()
    assert sorted(rn["rn"]) == list(range(1, n + 1))
    assert (rn.sort_values("o")["rn"].values == np.arange(1, n + 1)).all()


def test_split_exact_disjoint_deterministic(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.arange(1000), "y": (rng.random(1000) < 0.08).astype(int)})
    df = spark.createDataFrame(pdf)
    a = stratified_split(df, "k", "y").toPandas()
    b = stratified_split(df.repartition(7), "k", "y").toPandas()
    counts = pdf["y"].value_counts().to_dict()
    quota = holdout_quota(counts)
    got = a[a.is_test].groupby("y").size().to_dict()
    assert got == quota
    assert len(a) == 1000 and a["k"].is_unique
    assert set(a[a.is_test]["k"]) == set(b[b.is_test]["k"])
    f = stratified_folds(df, "k", "y", k=5).toPandas()
    sizes = f.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
