"""Latent semantic analysis: TF-IDF followed by a truncated SVD.

The TF-IDF matrix stays in cells (slice of terms, block of documents); the SVD is a
randomized subspace iteration over them (``grams.block_svd``; with ``max_features`` over the
long form, ``randomized_svd_long``). Coordinates of other documents are a join with the (term × k) loadings. The fitted state, idf
weights and loadings, is one table by term: no size is assumed for the vocabulary.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.grams import block_svd
from quire.operators.linalg import randomized_svd_long
from quire.operators.joins import spread_join
from quire.operators.text import term_counts, vocabulary, weighted
from quire.session import ensure_checkpoint_dir


@dataclass
class LSAModel:
    key: str
    text: str
    idf: DataFrame                       # (term, df, idf)
    factor: DataFrame | None             # (term, f0…)
    singular_values: np.ndarray
    prefix: str = "lsa"
    fitted: tuple | None = None          # the frame of the fit and its coordinates (key, f0…)

    @property
    def names(self):
        return [f"{self.prefix}_{i + 1:02d}" for i in range(self.output_dim)]

    @property
    def output_dim(self) -> int:
        return len(self.singular_values)

    @property
    def terms(self) -> list:
        """The sorted vocabulary, collected (for inspection of small models)."""
        return sorted(r["term"] for r in self.idf.select("term").collect())

    @property
    def loadings(self) -> np.ndarray:
        """The (term × k) loadings in the order of ``terms``, collected (for inspection of small models)."""
        rows = {r[0]: r[1:] for r in self.factor.collect()}
        return np.array([rows.get(t, [0.0] * self.output_dim) for t in self.terms], dtype=float).reshape(-1, self.output_dim)

    def weights(self, df: DataFrame) -> DataFrame:
        tc = term_counts(df, self.key, self.text)
        w = weighted(tc, self.idf)
        norm = F.sqrt(F.sum(F.col("raw") ** 2).over(Window.partitionBy(self.key)))
        return w.select(self.key, "term", (F.col("raw") / norm).alias("w"))

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        base = df.select(quote(self.key), *[quote(k) for k in keep if k != self.key])
        if not self.names:
            return base
        if self.fitted and df is self.fitted[0]:
            # A q of the fit's last pass is what the join below would sum anew.
            scores = self.fitted[1].select(F.col("key").alias(self.key), *[F.col(f"f{j}").alias(n) for j, n in enumerate(self.names)])
            return base.join(scores, self.key, "left").na.fill(0.0, subset=self.names)
        scores = spread_join(self.weights(df), self.factor.join(self.idf.select("term", "df"), "term"), "term", "df").groupBy(self.key).agg(
            *[F.sum(F.col("w") * F.col(f"f{j}")).alias(n) for j, n in enumerate(self.names)])
        return base.join(scores, self.key, "left").na.fill(0.0, subset=self.names)


class LSAReducer:
    def __init__(self, n_components: int = 20, min_df: int = 3, max_features: int | None = None,
                 n_iter: int = 4, seed: int = 42, prefix: str = "lsa"):
        self.n_components = n_components
        self.min_df = min_df
        self.max_features = max_features
        self.n_iter = n_iter
        self.seed = seed
        self.prefix = prefix

    def fit(self, df: DataFrame, key: str, text: str) -> LSAModel:
        if self.max_features is None:
            got = block_svd(df, key, text, self.n_components, self.min_df, n_iter=self.n_iter, seed=self.seed)
            return LSAModel(key, text, got.idf, got.factor, got.values, self.prefix, (df, got.scores))
        ensure_checkpoint_dir(df.sparkSession)
        tc = term_counts(df, key, text)
        n_docs = df.select(quote(key)).where(quote(key).isNotNull()).distinct().count()
        idf = vocabulary(tc, key, self.min_df, self.max_features).select(
            "term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")).checkpoint()
        model = LSAModel(key, text, idf, None, np.zeros(0), self.prefix)
        long = model.weights(df).checkpoint()
        if not long.isEmpty():
            model.singular_values, model.factor = randomized_svd_long(
                long, key, "term", "w", self.n_components, n_iter=self.n_iter, seed=self.seed)
        return model
