"""Distributed linear-algebra building blocks.

``gram_stats``: one pass over the rows gives n, column sums s and the Gram
matrix G = AᵀA. Each task multiplies its Arrow batches with numpy and emits
one partial (s, G); the partials are summed by the ``Summarizer`` vector
aggregate (tree-reduced), so the driver receives p² + p + 1 numbers — bounded
by the schema width, not the row count. Used for p up to ``GRAM_MAX_COLS``;
``gram_blocks`` holds wider ones as a table of blocks, decomposed by ``top_eigen``.

``randomized_svd_long``: truncated SVD of a sparse matrix held in long form
(row, col, value) by randomized subspace iteration. Every product is a join of
the long table with a (col × k) or a (row × k) frame followed by a
group-by sum, so no pairs of entries are ever formed.

``project``: scores = ((x − centre) / scale) · W as native arithmetic.
"""
from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import spread_join
from quire.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)
GRAM_MAX_COLS = 2048
#: Columns of a block of a wide Gram matrix; numbers of block products that a task holds in one pass.
BLOCK_COLS, PASS_NUMBERS = 1024, 1 << 23
# Above this many multiply-adds a projection is written as array dot products,
# keeping generated code under the JVM method-size limit.
WIDE_PROJECTION_TERMS = 600


def gram_stats(df: DataFrame, cols: Sequence[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, column sums, AᵀA) of the double expressions ``cols``; missing values count as 0 and are reported in the log."""
    p = len(cols)
    if p > GRAM_MAX_COLS:
        raise ValueError(f"{p} columns: a dense Gram matrix is for at most {GRAM_MAX_COLS}, see gram_blocks")
    sel = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def partial(batches):
        import pandas as pd
        n, missing, s, g = 0, 0, np.zeros(p), np.zeros((p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            absent = np.isnan(x)
            missing += int(absent.sum())
            x = np.where(absent, 0.0, x)
            n += x.shape[0]
            s += x.sum(axis=0)
            g += x.T @ x
        yield pd.DataFrame({"n": [n], "missing": [missing], "v": [np.concatenate([s, g.ravel()]).tolist()]})

    parts = sel.mapInPandas(partial, "n long, missing long, v array<double>")
    row = parts.select(F.sum("n").alias("n"), F.sum("missing").alias("missing"),
                       Summarizer.sum(array_to_vector("v")).alias("v")).first()
    if row["missing"]:
        log.warning("%d missing values in %d columns count as 0", row["missing"], p)
    n = int(row["n"] or 0)
    v = row["v"].toArray() if row["v"] is not None else np.zeros(p + p * p)
    return n, v[:p], v[p:].reshape(p, p)


def gram_blocks(df: DataFrame, cols: Sequence[Column] | Column, block: int = BLOCK_COLS, width: int | None = None) -> tuple[int, np.ndarray, DataFrame]:
    """(n, column sums, blocks) of a matrix of any width; a block (bi, bj, g) holds the products of two blocks of columns, bi <= bj.

    The columns are double expressions, or one array column of ``width`` values without missing ones.

    Tasks emit their blocks, which are summed by block key; the blocks are written once and no task or driver ever holds the
    whole matrix. Where a task's products would be more than ``PASS_NUMBERS``, the rows are read again for the next blocks.
    Missing values count as 0.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if isinstance(cols, Column):
        p, x = int(width), cols.cast("array<double>")
    else:
        p, x = len(cols), F.array(*[F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols])
    starts = list(range(0, p, block))
    rows = df.select(x.alias("x"))
    pairs = [(i, j) for i in range(len(starts)) for j in range(i, len(starts))]
    per_pass = max(1, PASS_NUMBERS // block ** 2)

    def matrix(b):
        return b.column("x").flatten().to_numpy().reshape(b.num_rows, p)

    def sums(batches):
        n, s = 0, np.zeros(p)
        for b in batches:
            n += b.num_rows
            s += matrix(b).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tobytes()]})

    def products(wanted):
        def run(batches):
            held = {}
            for b in batches:
                x = matrix(b)
                for i, j in wanted:
                    g = x[:, starts[i]:starts[i] + block].T @ x[:, starts[j]:starts[j] + block]
                    held[i, j] = held[i, j] + g if (i, j) in held else g
            for (i, j), g in held.items():
                yield pa.RecordBatch.from_pydict({"bi": pa.array([i], pa.int32()), "bj": pa.array([j], pa.int32()), "g": [g.tobytes()]})
        return run

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_py()) for g in group.column("g"))
        return pa.table({"bi": pa.array([key[0].as_py()], pa.int32()), "bj": pa.array([key[1].as_py()], pa.int32()), "g": [total.tobytes()]})

    got = rows.mapInArrow(sums, "n long, s binary").collect()
    schema = "bi int, bj int, g binary"
    parts = [rows.mapInArrow(products(pairs[k:k + per_pass]), schema) for k in range(0, len(pairs), per_pass)]
    blocks = reduce(DataFrame.unionByName, parts).groupBy("bi", "bj").applyInArrow(add, schema).checkpoint()
    return sum(r["n"] for r in got), sum((np.frombuffer(r["s"]) for r in got), np.zeros(p)), blocks


def block_entries(blocks: DataFrame, p: int, block: int = BLOCK_COLS) -> DataFrame:
    """(i, j, value) of the upper triangle of a Gram matrix in blocks."""
    def run(batches):
        for b in batches:
            for bi, bj, raw in zip(*[b.column(c).to_pylist() for c in ("bi", "bj", "g")]):
                wide = min(block, p - bj * block)
                g = np.frombuffer(raw).reshape(-1, wide)
                i, j = np.nonzero(np.ones(g.shape) if bi != bj else np.triu(np.ones(g.shape)))
                yield pa.RecordBatch.from_pydict({"i": i + bi * block, "j": j + bj * block, "value": g[i, j]})

    return blocks.mapInArrow(run, "i long, j long, value double")


def block_product(blocks: DataFrame, q: np.ndarray, block: int = BLOCK_COLS) -> np.ndarray:
    """G · q for a Gram matrix in blocks; only matrices as narrow as q reach the driver."""
    shared = blocks.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = shared.value
        total = np.zeros(q.shape)
        for b in batches:
            for bi, bj, raw in zip(*[b.column(c).to_pylist() for c in ("bi", "bj", "g")]):
                right = q[bj * block:(bj + 1) * block]
                g = np.frombuffer(raw).reshape(-1, len(right))
                total[bi * block:(bi + 1) * block] += g @ right
                if bi != bj:
                    total[bj * block:(bj + 1) * block] += g.T @ q[bi * block:(bi + 1) * block]
        yield pa.RecordBatch.from_pydict({"y": [total.tobytes()]})

    return sum((np.frombuffer(r["y"]).reshape(q.shape) for r in blocks.mapInArrow(run, "y binary").collect()), np.zeros(q.shape))


def top_eigen(product, p: int, k: int, n_oversample: int = 10, n_iter: int = 60, tol: float = 1e-10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Largest k eigenvalues and sign-fixed vectors of a symmetric matrix given by ``product(q)``, by subspace iteration."""
    width = min(p, k + n_oversample)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))
    last = np.zeros(k)
    for _ in range(n_iter):
        y = product(q)
        w, u = sym_eig_desc(q.T @ y)
        if np.abs(w[:k] - last).max() <= tol * max(1.0, float(w[0])):
            break
        last = w[:k]
        q, _ = np.linalg.qr(y @ u)
    return w[:k], fix_signs((q @ u if len(u) == q.shape[1] else q)[:, :k])


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Flip each column so that its largest-magnitude entry is positive."""
    v = v.copy()
    for j in range(v.shape[1]):
        i = int(np.argmax(np.abs(v[:, j])))
        if v[i, j] < 0:
            v[:, j] = -v[:, j]
    return v


def sym_eig_desc(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending, clipped at 0) and sign-fixed eigenvectors of a symmetric matrix."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(w)[::-1]
    return np.clip(w[order], 0.0, None), fix_signs(v[:, order])


def first_reaching(cumulative: np.ndarray, target: float) -> int:
    """Number of leading components whose cumulative share first reaches ``target``."""
    return int(np.searchsorted(cumulative, target) + 1)


def project(exprs: Sequence[Column], weights: np.ndarray, names: Sequence[str],
            centre: Sequence[float] | None = None, scale: Sequence[float] | None = None) -> list[Column]:
    """Columns Σ_i ((x_i − c_i)/s_i)·W[i, j] for each output name j."""
    xs = []
    for i, e in enumerate(exprs):
        x = F.coalesce(e.cast("double"), F.lit(0.0))
        if centre is not None and centre[i] != 0.0:
            x = x - F.lit(float(centre[i]))
        if scale is not None and scale[i] != 1.0:
            x = x / F.lit(float(scale[i]))
        xs.append(x)
    out = []
    if len(xs) * len(names) > WIDE_PROJECTION_TERMS:
        # wide: one array of inputs, one array literal of weights per output, dot product
        arr = F.array(*xs)
        for j, name in enumerate(names):
            w = F.lit([float(x) for x in weights[:, j]])
            out.append(F.aggregate(F.zip_with(arr, w, lambda a, b: a * b), F.lit(0.0),
                                   lambda acc, v: acc + v).alias(name))
        return out
    for j, name in enumerate(names):
        total = None
        for i, x in enumerate(xs):
            w = float(weights[i, j])
            if w == 0.0:
                continue
            term = x * F.lit(w)
            total = term if total is None else total + term
        out.append((total if total is not None else F.lit(0.0)).alias(name))
    return out


def _matmul_long(long: DataFrame, row: str, col: str, val: str, right: DataFrame, on: str,
                 group: str, k: int, counts: DataFrame | None = None) -> DataFrame:
    """Σ over ``on`` of long.val · right.f_j grouped by ``group`` → (group, f_0 … f_{k-1}).

    ``counts`` has the entries of each ``on`` in ``_entries``: ids with a large share of them are not shuffled.
    """
    j = long.join(right, on) if counts is None else spread_join(long, right.join(counts, on), on, "_entries")
    return j.groupBy(group).agg(*[F.sum(F.col(val) * F.col(f"f{i}")).alias(f"f{i}") for i in range(k)])


def randomized_svd_long(long: DataFrame, row: str, col: str, val: str, k: int, n_oversample: int = 10,
                        n_iter: int = 4, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """Top-k singular values and right singular vectors (col, f0…) of a long-form matrix.

    Both factors, (row × l) and (col × l) with l = k + oversampling, stay distributed:
    each product is a join by id and a grouped sum, checkpointed so that the lineage does
    not grow. Only l × l Gram matrices reach the driver. The start is standard normal
    by column id (hashed), the same for any partitioning.
    """
    l_dim = k + n_oversample

    def uniform(j):
        return (F.pmod(F.xxhash64(F.col(col), F.lit(j), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def times(q, r):  # (id, f…) · r
        out = [sum((F.col(f"f{i}") * float(r[i, j]) for i in range(r.shape[0])), F.lit(0.0)).alias(f"f{j}") for j in range(r.shape[1])]
        return q.select(col, *out)

    def gram_of(z, dims):
        _, _, g = gram_stats(z, [F.col(f"f{i}") for i in range(dims)])
        return sym_eig_desc(g)

    def orthonormal(z, dims):
        for _ in range(2):  # the second pass removes what rounding left in the first
            w, u = gram_of(z, dims)
            keep = w > max(float(w[0]), 0.0) * 1e-14
            z = times(z, u[:, keep] / np.sqrt(w[keep])).checkpoint()
            dims = int(keep.sum())
        return z, dims

    normal = [(F.sqrt(-2.0 * F.log(uniform(2 * j))) * F.cos(2 * np.pi * uniform(2 * j + 1))).alias(f"f{j}") for j in range(l_dim)]
    q = long.select(col).distinct().select(col, *normal)
    dims = l_dim
    counts = long.groupBy(col).agg(F.count(F.lit(1)).alias("_entries")).checkpoint()
    for _ in range(n_iter):
        y = _matmul_long(long, row, col, val, q, col, row, dims, counts).checkpoint()
        z = _matmul_long(long, row, col, val, y, row, col, dims).checkpoint()   # Aᵀ A q
        q, dims = orthonormal(z, dims)
        if not dims:
            return np.zeros(0), q
    y = _matmul_long(long, row, col, val, q, col, row, dims, counts).checkpoint()
    # (A q)ᵀ (A q) = qᵀ AᵀA q: the small eigenproblem, from one Gram pass over y
    w, u = gram_of(y, dims)
    v = times(q, u[:, :k]).checkpoint()
    k = min(k, dims)
    # the entry of largest size of each vector is positive
    peak = v.agg(*[F.max_by(f"f{j}", F.struct(F.abs(f"f{j}"), F.col(col))) for j in range(k)]).first()
    signs = [F.col(f"f{j}") * (-1.0 if (peak[j] or 0.0) < 0 else 1.0) for j in range(k)]
    return np.sqrt(np.maximum(w[:k], 0.0)), v.select(col, *[c.alias(f"f{j}") for j, c in enumerate(signs)])
