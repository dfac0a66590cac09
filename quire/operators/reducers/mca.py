"""Multiple correspondence analysis of the categorical columns.

Indicator matrix Z (n × J) over Q categorical columns, N = nQ, column masses
c = colsum/N. The standardised residual matrix S = D_r^{-1/2}(P − rcᵀ)D_c^{-1/2}
satisfies SᵀS = D_c^{-1/2}(n·ZᵀZ/N² − ccᵀ)D_c^{-1/2}, so its decomposition
needs only the Gram matrix of Z. Row principal coordinates are
(1/Q)·Σ_j z_j c_j^{-1/2} v_j. Explained inertia = eigenvalue / total.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quire.operators.categories import indicator
from quire.operators.linalg import gram_stats, sym_eig_desc
from quire.operators.reducers.base import ProjectionModel, choose_k, kinds_and_categories, names


class MCAReducer:
    def __init__(self, n_components: int | None = None, variance_target: float = 0.85,
                 max_components: int = 50, categorical_threshold: int = 10, prefix: str = "mca"):
        self.n_components = n_components
        self.variance_target = variance_target
        self.max_components = max_components
        self.categorical_threshold = categorical_threshold
        self.prefix = prefix

    def residuals(self, df: DataFrame, features: Sequence[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """The (column, value) inputs, their masses and SᵀS, the products of the standardised residuals."""
        _, cats = kinds_and_categories(df, features, self.categorical_threshold)
        if not cats:
            raise ValueError("MCA needs at least one categorical column")
        inputs = [(c, v) for c, vals in cats.items() for v, _ in vals]
        n, s, g = gram_stats(df, [indicator(*x) for x in inputs])
        big_n = n * len(cats)
        c = s / big_n
        inv = 1.0 / np.sqrt(np.where(c > 0, c, 1.0))
        return inputs, c, (n * g / big_n ** 2 - np.outer(c, c)) * np.outer(inv, inv)

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> ProjectionModel:
        pairs, c, sts = self.residuals(df, features)
        inputs = [("dummy", x) for x in pairs]
        q = len({x[0] for x in pairs})
        inv = 1.0 / np.sqrt(np.where(c > 0, c, 1.0))
        lam, v = sym_eig_desc(sts)
        keep = lam > 1e-12
        lam, v = lam[keep], v[:, keep]
        evr = lam / lam.sum() if lam.sum() > 0 else lam
        k = choose_k(evr, self.variance_target, self.n_components, self.max_components, len(lam))
        weights = (v[:, :k] * inv[:, None]) / q
        return ProjectionModel(inputs, np.zeros(len(inputs)), np.ones(len(inputs)), weights,
                               names(self.prefix, k), evr[:k])
