"""PCA on standardised features, components chosen by explained variance."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quire.functions.columns import quote
from quire.operators.linalg import GRAM_MAX_COLS, block_entries, block_product, gram_blocks, gram_stats, sym_eig_desc, top_eigen
from quire.operators.reducers.base import ProjectionModel, choose_k, names


def standardised_covariance(n: int, s: np.ndarray, g: np.ndarray):
    mean = s / n
    var = np.clip(np.diag(g) / n - mean ** 2, 0.0, None)
    sd = np.sqrt(var)
    sd[sd == 0] = 1.0
    cov = g / n - np.outer(mean, mean)
    return mean, sd, cov / np.outer(sd, sd)


class PCAReducer:
    """Standardise with population sd, then PCA; k = first count reaching ``variance_target``
    (or ``n_components``), capped by ``max_components`` and the feature count."""

    def __init__(self, variance_target: float = 0.85, n_components: int | None = None,
                 max_components: int = 50, prefix: str = "pc"):
        self.variance_target = variance_target
        self.n_components = n_components
        self.max_components = max_components
        self.prefix = prefix

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> ProjectionModel:
        features = list(features)
        if len(features) > GRAM_MAX_COLS:
            return self._fit_wide(df, features)
        n, s, g = gram_stats(df, [quote(c) for c in features])
        mean, sd, corr = standardised_covariance(n, s, g)
        w, v = sym_eig_desc(corr)
        evr = w / w.sum() if w.sum() > 0 else np.zeros_like(w)
        k = choose_k(evr, self.variance_target, self.n_components, self.max_components, len(features))
        return ProjectionModel([("col", c) for c in features], mean, sd, v[:, :k],
                               names(self.prefix, k), evr[:k])

    def _fit_wide(self, df: DataFrame, features: list[str]) -> ProjectionModel:
        """The same on a Gram matrix in blocks; of the spectrum only ``max_components`` values are taken."""
        n, s, blocks = gram_blocks(df, [quote(c) for c in features])
        mean = s / n
        squares = block_entries(blocks, len(features)).where("i = j").select("i", "value").toArrow()
        diagonal = np.zeros(len(features))
        diagonal[squares.column("i").to_numpy()] = squares.column("value").to_numpy()
        sd = np.sqrt(np.clip(diagonal / n - mean ** 2, 0.0, None))
        total = float((sd > 0).sum())
        sd[sd == 0] = 1.0

        def product(q: np.ndarray) -> np.ndarray:
            scaled = q / sd[:, None]
            return (block_product(blocks, scaled) / n - np.outer(mean, mean @ scaled)) / sd[:, None]

        most = min(self.n_components or self.max_components, self.max_components, len(features))
        w, v = top_eigen(product, len(features), most)
        evr = w / total if total else np.zeros_like(w)
        k = min(choose_k(evr, self.variance_target, self.n_components, self.max_components, len(features)), len(w))
        return ProjectionModel([("col", c) for c in features], mean, sd, v[:, :k], names(self.prefix, k), evr[:k])
