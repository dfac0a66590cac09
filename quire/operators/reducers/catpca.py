"""Categorical PCA by alternating least squares (optimal scaling), on the Gram matrix.

Categorical columns (≤ threshold distinct values) start from their rank codes
0…K−1; each iteration standardises the quantified matrix, takes the first
principal axis, and sets every category's quantification to the mean first
component score of its rows; it stops when the largest change is below ``tol``
after at least four iterations, or after ``max_iter``. A final PCA on the
quantified, standardised matrix gives the output.

With B = [numeric | indicators] and T the block matrix mapping indicators to
quantified columns, the quantified matrix is M = B·T, so every iteration uses
only G = BᵀB and the column sums of B from a single data pass:
cov(M) = TᵀGT/n − μμᵀ and the mean PC1 score of category k is
(G[k,:] · T · v/σ)/n_k − μ·v/σ. No further pass over the rows is needed.
Unseen categories quantify to 0. Categories are keyed by their exact value
(rank codes), not by an integer truncation of the value.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quire.functions.columns import quote
from quire.operators.categories import indicator
from quire.operators.linalg import fix_signs, gram_stats, sym_eig_desc
from quire.operators.reducers.base import ProjectionModel, choose_k, kinds_and_categories, names


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence (weighted squares): neighbours out of order are pooled to their mean."""
    pools: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values, weights):
        pools.append([float(v), float(w), 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest monotone sequence, rising or falling, whichever is nearer (rising on ties)."""
    up, down = pool_adjacent(values, weights), -pool_adjacent(-values, weights)
    cost = [float(weights @ (x - values) ** 2) for x in (up, down)]
    return up if cost[0] <= cost[1] else down


def als_quantify(n: int, s: np.ndarray, g: np.ndarray, p_num: int, blocks: list[list[int]],
                 quants: list[np.ndarray], max_iter: int = 50, tol: float = 1e-4, ordered: bool = False):
    """Run the ALS loop on Gram statistics; returns (quantifications, iterations).

    With ``ordered`` each step takes the closest quantification that is monotone in the order of the categories.
    """
    p_b = len(s)

    def t_matrix(qs):
        t = np.zeros((p_b, p_num + len(blocks)))
        t[:p_num, :p_num] = np.eye(p_num)
        for j, (rows, q) in enumerate(zip(blocks, qs)):
            t[rows, p_num + j] = q
        return t

    iterations = 0
    for it in range(max_iter):
        iterations = it + 1
        t = t_matrix(quants)
        mu = t.T @ s / n
        cov = t.T @ g @ t / n - np.outer(mu, mu)
        sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
        sd[sd == 0] = 1.0
        corr = cov / np.outer(sd, sd)
        _, v = sym_eig_desc(corr)
        a = v[:, 0] / sd
        offset = float(mu @ a)
        proj = g @ t @ a
        max_change = 0.0
        new = []
        for rows, q in zip(blocks, quants):
            counts = s[rows]
            nq = q.copy()
            hit = counts > 0
            nq[hit] = proj[rows][hit] / counts[hit] - offset
            if ordered:
                nq[hit] = monotone(nq[hit], counts[hit])
            if hit.any():
                max_change = max(max_change, float(np.max(np.abs(nq[hit] - q[hit]))))
            new.append(nq)
        quants = new
        if max_change < tol and it > 2:
            break
    return quants, iterations


class CATPCAReducer:
    def __init__(self, n_components: int | None = None, variance_target: float = 0.85,
                 max_components: int = 50, max_iter: int = 50, tol: float = 1e-4,
                 categorical_threshold: int = 10, prefix: str = "catpca", ordered: bool = False):
        self.n_components = n_components
        self.variance_target = variance_target
        self.max_components = max_components
        self.max_iter = max_iter
        self.tol = tol
        self.categorical_threshold = categorical_threshold
        self.prefix = prefix
        self.ordered = ordered
        self.iterations = 0

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> ProjectionModel:
        features = list(features)
        numeric, cats = kinds_and_categories(df, features, self.categorical_threshold)
        exprs = [quote(c).cast("double") for c in numeric]
        blocks, quants, values = [], [], []
        pos = len(numeric)
        for c, vals in cats.items():
            rows = list(range(pos, pos + len(vals)))
            pos += len(vals)
            blocks.append(rows)
            quants.append(np.arange(len(vals), dtype=float))
            values.append([v for v, _ in vals])
            exprs += [indicator(c, v) for v, _ in vals]
        n, s, g = gram_stats(df, exprs)
        quants, self.iterations = als_quantify(n, s, g, len(numeric), blocks, quants,
                                               self.max_iter, self.tol, self.ordered)
        # final standardisation + PCA on the quantified matrix
        p_num = len(numeric)
        t = np.zeros((len(s), p_num + len(blocks)))
        t[:p_num, :p_num] = np.eye(p_num)
        for j, (rows, q) in enumerate(zip(blocks, quants)):
            t[rows, p_num + j] = q
        mu = t.T @ s / n
        cov = t.T @ g @ t / n - np.outer(mu, mu)
        sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
        sd[sd == 0] = 1.0
        w, v = sym_eig_desc(cov / np.outer(sd, sd))
        evr = w / w.sum() if w.sum() > 0 else np.zeros_like(w)
        ceiling = min(n - 1, t.shape[1], self.max_components)
        k = choose_k(evr, self.variance_target, self.n_components, self.max_components, ceiling)
        inputs = [("col", c) for c in numeric] + \
            [("quant", (c, dict(zip(vals, q)))) for c, vals, q in zip(cats, values, quants)]
        model = ProjectionModel(inputs, mu, sd, fix_signs(v[:, :k]), names(self.prefix, k), evr[:k])
        model.quantifications = {c: dict(zip(vals, q)) for c, vals, q in zip(cats, values, quants)}
        return model
