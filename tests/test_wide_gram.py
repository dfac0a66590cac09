"""Gram matrices in blocks, wide PCA and the reported missing values."""
import logging

import numpy as np
from pyspark.sql import functions as F

from quire.operators import linalg as L
from quire.operators.reducers import pca


def frame(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, x array<double>").repartition(3)
    return df.select("k", *[F.col("x")[j].alias(f"f{j}") for j in range(x.shape[1])])


def test_blocks_equal_numpy(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(50, 13))
    df = frame(spark, x)
    cols = [F.col(f"f{j}") for j in range(13)]
    monkeypatch.setattr(L, "PASS_NUMBERS", 40)
    n, s, blocks = L.gram_blocks(df, cols, block=5)
    g = x.T @ x
    assert n == 50 and np.allclose(s, x.sum(axis=0)) and blocks.count() == 6
    for r in L.block_entries(blocks, 13, 5).collect():
        assert r["i"] <= r["j"] and abs(g[r["i"], r["j"]] - r["value"]) < 1e-9
    assert L.block_entries(blocks, 13, 5).count() == 13 * 14 // 2
    q = np.random.default_rng(1).normal(size=(13, 4))
    assert np.allclose(L.block_product(blocks, q, 5), g @ q)
    w, v = L.top_eigen(lambda q: L.block_product(blocks, q, 5), 13, 3)
    want, vectors = L.sym_eig_desc(g)
    assert np.allclose(w, want[:3]) and np.allclose(v, vectors[:, :3], atol=1e-4)


def test_wide_pca_equals_narrow(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 12)) + .1 * rng.normal(size=(80, 12))
    x[:, 5] = 2.0
    df = frame(spark, x)
    names = [f"f{j}" for j in range(12)]
    narrow = pca.PCAReducer(n_components=3).fit(df, names)
    monkeypatch.setattr(pca, "GRAM_MAX_COLS", 4)
    wide = pca.PCAReducer(n_components=3).fit(df, names)
    assert np.allclose(wide.explained_variance_ratio, narrow.explained_variance_ratio, atol=1e-8)
    assert np.allclose(wide.weights, narrow.weights, atol=1e-4)
    target = pca.PCAReducer(variance_target=0.8).fit(df, names)
    assert 1 <= target.output_dim <= 3


def test_five_thousand_columns(spark):
    rng = np.random.default_rng(3)
    x = np.outer(rng.normal(size=30), rng.normal(size=5000)) + .05 * rng.normal(size=(30, 5000))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, x array<double>").repartition(2)
    n, s, blocks = L.gram_blocks(rows, F.col("x"), width=5000)
    assert n == 30 and blocks.count() == 15
    w, v = L.top_eigen(lambda q: L.block_product(blocks, q), 5000, 2)
    _, sing, vt = np.linalg.svd(x, full_matrices=False)
    assert abs(w[0] / sing[0] ** 2 - 1) < 1e-9 and abs(w[1] / sing[1] ** 2 - 1) < 0.01 and abs(abs(v[:, 0] @ vt[0]) - 1) < 1e-6


def test_missing_values_are_reported(spark, caplog):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with caplog.at_level(logging.WARNING):
        n, s, g = L.gram_stats(df, [F.col("a"), F.col("b")])
    assert n == 2 and s.tolist() == [3.0, 3.0] and "1 missing values" in caplog.text
