"""Factor analysis of mixed data.

Numeric columns are z-scored (population sd); each category of a categorical
column becomes an indicator scaled by 1/√p_j (p_j its train share, clipped to
[1e-6, 1 − 1e-6]) and by 1/√(number of categorical columns). The uncentred
matrix M is decomposed from its Gram matrix, which is derived algebraically
from one Gram pass over the raw [numeric | indicator] columns. A category
unseen in training contributes zeros. Explained variance of a component =
variance of its scores / total column variance of M.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quire.functions.columns import quote
from quire.operators.categories import indicator
from quire.operators.linalg import gram_stats, sym_eig_desc
from quire.operators.reducers.base import ProjectionModel, choose_k, kinds_and_categories, names


class FAMDReducer:
    def __init__(self, n_components: int | None = None, variance_target: float = 0.85,
                 max_components: int = 50, categorical_threshold: int = 10, prefix: str = "famd"):
        self.n_components = n_components
        self.variance_target = variance_target
        self.max_components = max_components
        self.categorical_threshold = categorical_threshold
        self.prefix = prefix

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> ProjectionModel:
        numeric, cats = kinds_and_categories(df, features, self.categorical_threshold)
        inputs = [("col", c) for c in numeric] + \
            [("dummy", (c, v)) for c, vals in cats.items() for v, _ in vals]
        exprs = [quote(c).cast("double") for c in numeric] + \
            [indicator(c, v) for c, vals in cats.items() for v, _ in vals]
        n, s, g = gram_stats(df, exprs)
        p_num = len(numeric)
        centre = np.zeros(len(inputs))
        scale = np.ones(len(inputs))
        mean = s[:p_num] / n
        sd = np.sqrt(np.clip(np.diag(g)[:p_num] / n - mean ** 2, 0.0, None))
        sd[sd == 0] = 1.0
        centre[:p_num], scale[:p_num] = mean, sd
        if cats:
            share = np.clip(s[p_num:] / n, 1e-6, 1 - 1e-6)
            weight = 1.0 / np.sqrt(max(len(cats), 1))
            scale[p_num:] = 1.0 / (weight / np.sqrt(share))
        w = 1.0 / scale
        gc = g - np.outer(s, centre) - np.outer(centre, s) + n * np.outer(centre, centre)
        mtm = gc * np.outer(w, w)
        colsum = w * (s - n * centre)
        lam, v = sym_eig_desc(mtm)
        score_mean = (colsum @ v) / n
        score_var = np.clip(lam / n - score_mean ** 2, 0.0, None)
        full_var = float(np.sum(np.diag(mtm) / n - (colsum / n) ** 2))
        evr = score_var / full_var if full_var > 0 else np.zeros_like(score_var)
        max_k = min(n - 1, len(inputs), self.max_components)
        if self.n_components is None:
            total = float(evr[:max_k].sum())
            target = min(self.variance_target, total - 1e-6)
            k = choose_k(evr[:max_k], target, None, self.max_components, max_k)
        else:
            k = choose_k(evr, self.variance_target, self.n_components, self.max_components, len(inputs))
        return ProjectionModel(inputs, centre, scale, v[:, :k], names(self.prefix, k), evr[:k])
