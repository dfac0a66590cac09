"""Elastic-net linear classifiers by accelerated proximal gradients, many at once.

All models of a search (settings x folds) share every pass over the rows: a task multiplies its rows with the matrix of all
coefficients and returns one gradient matrix, the driver sums these (as many numbers as there are coefficients) and takes a
proximal step for each model. A search of 60 trials on 5 folds is therefore as many passes as its slowest
model has steps, not 300 times that. Steps use each model's own Lipschitz bound, momentum restarts when a model's step turns back,
and a model that has settled drops out.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.session import ensure_checkpoint_dir

MAX_STEPS, TOLERANCE = 5000, 1e-6


@dataclass(frozen=True)
class Setting:
    """One model: inverse strength ``c`` of the penalty, its L1 share, the fold left out (None: all rows) and, for Newton steps, the places of its features (None: all)."""
    c: float
    l1_ratio: float = 1.0
    fold: int | None = None
    columns: tuple[int, ...] | None = None


def prepared(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> DataFrame:
    """(x, y, fold, w) with balanced class weights n / (2 n_c), written once."""
    ensure_checkpoint_dir(df.sparkSession)
    x = F.array(*[F.coalesce(F.nanvl(quote(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])
    return df.where(quote(label).isin(0, 1)).select(
        x.alias("x"), quote(label).cast("int").alias("y"), (quote(fold) if fold else F.lit(-1)).cast("int").alias("fold")).checkpoint()


def _class_counts(rows: DataFrame, settings: Sequence[Setting]) -> list[tuple[float, float]]:
    """Rows of both classes that each setting learns from."""
    got = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [tuple(float(sum(n for (f, y), n in got.items() if y == k and (s.fold is None or f != s.fold))) for k in (0, 1)) for s in settings]


def losses(margin: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Derivative of the loss by the margin of class 1."""
    if loss == "log":
        return 0.5 * (1 + np.tanh(margin / 2)) - y
    sign = 2 * y - 1
    return -2 * sign * np.maximum(0.0, 1 - sign * margin)


def _gradient(rows: DataFrame, w: np.ndarray, folds: np.ndarray, weights: np.ndarray, loss: str) -> np.ndarray:
    """(features + 1, models) summed weighted gradients; the last row belongs to the intercepts."""
    shared = rows.sparkSession.sparkContext.broadcast((w, folds, weights))
    p = w.shape[0]

    def run(batches):
        w, folds, weights = shared.value
        g = np.zeros(w.shape)
        for b in batches:
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            x = np.hstack([b.column("x").flatten().to_numpy().reshape(len(y), p - 1), np.ones((len(y), 1))])
            d = losses(x @ w, y[:, None], loss) * weights[:, y].T
            g += x.T @ (d * (fold[:, None] != folds[None, :]))
        yield pa.RecordBatch.from_pydict({"g": [g.tobytes()]})

    return sum((np.frombuffer(r["g"]).reshape(w.shape) for r in rows.mapInArrow(run, "g binary").collect()), np.zeros(w.shape))


def _largest_eigenvalue(rows: DataFrame, folds: np.ndarray, weights: np.ndarray, p: int) -> np.ndarray:
    """An upper bound of the curvature of each model: the weighted trace of the products of features."""
    def run(batches):
        total = {}
        for b in batches:
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(len(y), p - 1)
            x = np.hstack([x, np.ones((len(y), 1))])
            for f in np.unique(fold):
                for k in (0, 1):
                    own = x[(fold == f) & (y == k)]
                    total[f, k] = total.get((f, k), np.zeros((p, p))) + own.T @ own
        for (f, k), m in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), "y": pa.array([k], pa.int32()), "m": [m.tobytes()]})

    sums: dict = {}
    for r in rows.mapInArrow(run, "fold int, y int, m binary").collect():
        key = r["fold"], r["y"]
        sums[key] = sums.get(key, np.zeros((p, p))) + np.frombuffer(r["m"]).reshape(p, p)
    known: dict = {}
    out = []
    for fold, weight in zip(folds, weights):
        key = int(fold), *weight
        if key not in known:
            m = sum((weight[k] * v for (f, k), v in sums.items() if f != fold), np.zeros((p, p)))
            known[key] = float(np.linalg.eigvalsh(m)[-1]) if m.any() else 1.0
        out.append(known[key])
    return np.array(out)


def fit(rows: DataFrame, settings: Sequence[Setting], loss: str = "log", intercept_penalty: bool = False, steps: int = MAX_STEPS,
        tolerance: float = TOLERANCE) -> np.ndarray:
    """(features + 1, models) coefficients minimising sum(w * loss) + penalty / c; the last row holds the intercepts.

    The penalty is l1_ratio |b| + (1 - l1_ratio) b**2 / 2; ``intercept_penalty`` includes the intercept, as linear SVM solvers do.
    """
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    p = len(first["x"]) + 1
    counts = _class_counts(rows, settings)
    weights = np.array([[(a + b) / (2 * a) if a else 0.0, (a + b) / (2 * b) if b else 0.0] for a, b in counts])
    folds = np.array([-2 if s.fold is None else s.fold for s in settings])
    curve = _largest_eigenvalue(rows, folds, weights, p) * (0.25 if loss == "log" else 2.0)
    l1 = np.array([s.l1_ratio / s.c for s in settings])
    l2 = np.array([(1 - s.l1_ratio) / s.c for s in settings])
    pen = np.ones((p, 1))
    pen[-1] = float(intercept_penalty)
    rate = 1.0 / (curve + l2)
    w = np.zeros((p, len(settings)))
    at, age = w.copy(), np.ones(len(settings))
    live = np.arange(len(settings))
    for _ in range(steps):
        v = at[:, live]
        g = _gradient(rows, v, folds[live], weights[live], loss) + l2[live] * pen * v
        z = v - rate[live] * g
        new = np.sign(z) * np.maximum(np.abs(z) - rate[live] * l1[live] * pen, 0.0)
        change = new - w[:, live]
        # Momentum starts anew where the step turns against it.
        back = ((v - new) * change).sum(axis=0) > 0
        t = np.where(back, 1.0, age[live])
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at[:, live] = new + np.where(back, 0.0, (t - 1) / nxt) * change
        w[:, live], age[live] = new, nxt
        settled = np.abs(change).max(axis=0) <= tolerance * np.maximum(1.0, np.abs(new).max(axis=0))
        live = live[~settled]
        if not len(live):
            break
    return w


def _second_order(rows: DataFrame, w: np.ndarray, folds: np.ndarray, weights: np.ndarray, own: Sequence[np.ndarray] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Log loss, gradient and Hessian of each model over its own coefficients, one row a model for the driver whatever the number of tasks."""
    p, models = w.shape
    own = own or [np.arange(p)] * models
    shared = rows.sparkSession.sparkContext.broadcast((w, folds, weights, own))

    def run(batches):
        w, folds, weights, places = shared.value
        total = [np.zeros(1 + len(at) + len(at) ** 2) for at in places]
        for b in batches:
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            x = np.hstack([b.column("x").flatten().to_numpy().reshape(len(y), p - 1), np.ones((len(y), 1))])
            margin = x @ w
            prob = 0.5 * (1 + np.tanh(margin / 2))
            own = weights[:, y].T * (fold[:, None] != folds[None, :])
            for m in range(models):
                c, z, q = own[:, m], prob[:, m], len(places[m])
                mine = x if q == p else x[:, places[m]]
                total[m][0] += (c * (np.logaddexp(0.0, margin[:, m]) - y * margin[:, m])).sum()
                total[m][1:1 + q] += mine.T @ (c * (z - y))
                total[m][1 + q:] += (mine.T @ (mine * (c * z * (1 - z))[:, None])).ravel()
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(models), pa.int32()), "g": [t.tobytes() for t in total]})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        # Parts come in any order; sorted ones give the same sum in every run.
        parts = sorted(group.column("g").to_pylist())
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([sum(np.frombuffer(r) for r in parts).tobytes()], pa.binary())})

    got = {r["model"]: np.frombuffer(r["g"]) for r in rows.mapInArrow(run, "model int, g binary").repartition(min(models, 8), "model").groupBy("model").applyInArrow(
        add, "model int, g binary").collect()}
    return [(float(got[m][0]), got[m][1:1 + len(at)], got[m][1 + len(at):].reshape(len(at), len(at))) for m, at in enumerate(own)]


def _direction(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """The step that minimises the quadratic model of the loss plus the penalties, by coordinates."""
    q = h + np.diag(l2 + 1e-10 * max(float(np.trace(h)), 1e-12) / len(b))
    slope = g + l2 * b
    if not l1.any():
        return np.linalg.lstsq(q, -slope, rcond=None)[0]
    d, r = np.zeros(len(b)), slope.copy()                  # r = slope + q d
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            at = b[j] + d[j]
            z = at - r[j] / q[j, j]
            move = math.copysign(max(abs(z) - l1[j] / q[j, j], 0.0), z) - at
            if move:
                d[j] += move
                r += q[:, j] * move
                most = max(most, abs(move))
        if most <= 1e-12 * max(1.0, float(np.abs(b + d).max())):
            break
    return d


def newton(rows: DataFrame, settings: Sequence[Setting], steps: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """What ``fit`` finds for the log loss, by proximal Newton steps: about ten passes for few features.

    A step that does not lower the objective enough is halved. With ``c`` infinite there is no penalty. A class without rows gives an infinite intercept.
    """
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    p = len(first["x"]) + 1
    counts = _class_counts(rows, settings)
    weights = np.array([[(a + b) / (2 * a) if a else 0.0, (a + b) / (2 * b) if b else 0.0] for a, b in counts])
    folds = np.array([-2 if s.fold is None else s.fold for s in settings])
    pen = np.ones(p)
    pen[-1] = 0.0
    own = [np.arange(p) if s.columns is None else np.array([*s.columns, p - 1]) for s in settings]
    l1, l2 = ([share / s.c * pen[at] for s, share, at in zip(settings, shares, own)] for shares in zip(*[(s.l1_ratio, 1 - s.l1_ratio) for s in settings]))
    w, step = np.zeros((p, len(settings))), np.ones(len(settings))
    ways: dict[int, np.ndarray] = {}
    worth, drop = np.full(len(settings), np.inf), np.zeros(len(settings))
    for m, (a, b) in enumerate(counts):
        if not a or not b:
            w[-1, m] = math.inf if b else -math.inf
    live = [m for m, (a, b) in enumerate(counts) if a and b]
    for _ in range(steps):
        if not live:
            break
        tried = w[:, live]
        for k, m in enumerate(live):
            tried[own[m], k] += step[m] * ways.get(m, 0.0)
        rest = []
        narrow = [own[m] for m in live] if any(len(own[m]) < p for m in live) else None
        for m, whole, (loss, g, h) in zip(list(live), tried.T, _second_order(rows, tried, folds[live], weights[live], narrow)):
            b = whole[own[m]]
            now = loss + float(l1[m] @ np.abs(b) + 0.5 * l2[m] @ (b * b))
            if m in ways and now > worth[m] + 1e-4 * step[m] * drop[m] + 1e-12 * abs(worth[m]) and step[m] > 1e-6:
                step[m] /= 2
                rest.append(m)
                continue
            w[own[m], m], worth[m], step[m] = b, now, 1.0
            ways[m] = _direction(g, h, b, l1[m], l2[m])
            drop[m] = float((g + l2[m] * b) @ ways[m] + l1[m] @ (np.abs(b + ways[m]) - np.abs(b)))
            if -drop[m] > tolerance * max(abs(now), 1e-12):
                rest.append(m)
            else:
                w[own[m], m] = b + ways[m]
        live = rest
    return w


def l1_weights(df: DataFrame, features: Sequence[str], label: str, c: float = 0.1) -> dict[str, float]:
    """Weights of an L1 squared-hinge classifier with balanced classes on median-filled columns."""
    from quire.operators.selection import medians
    filled = {k: (v or 0.0) for k, v in medians(df, list(features)).items()}
    data = df.select(quote(label), *[F.coalesce(F.nanvl(quote(k).cast("double"), F.lit(None)), F.lit(float(v))).alias(k) for k, v in filled.items()])
    w = fit(prepared(data, features, label), [Setting(c)], "squared_hinge", intercept_penalty=True, steps=MAX_STEPS, tolerance=1e-5)
    return dict(zip(features, w[:-1, 0].tolist()))


def scores(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """(y, fold, model, score): the probability of class 1 of each held-out row under every model (log loss)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = shared.value
        for b in batches:
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            x = np.hstack([b.column("x").flatten().to_numpy().reshape(len(y), w.shape[0] - 1), np.ones((len(y), 1))])
            prob = 0.5 * (1 + np.tanh(x @ w / 2))
            for m in range(w.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array(np.full(len(y), m), pa.int32()), pa.array(prob[:, m])],
                                                 ["y", "fold", "model", "score"])

    return rows.mapInArrow(run, "y int, fold int, model int, score double")


def mean_f1(rows: DataFrame, w: np.ndarray, settings: Sequence[Setting], rounded: int = 12) -> list[float]:
    """The mean over the left-out folds of F1 of class 1, for each distinct (c, l1_ratio) in order of first use."""
    folds = F.array(*[F.lit(-2 if s.fold is None else s.fold) for s in settings])
    held = scores(rows, w).where(F.col("fold") == F.get(folds, F.col("model")))
    yes = F.col("score") >= 0.5
    counts = held.groupBy("model").agg(F.count_if(yes & (F.col("y") == 1)).alias("tp"), F.count_if(yes & (F.col("y") == 0)).alias("fp"),
                                       F.count_if(~yes & (F.col("y") == 1)).alias("fn")).collect()
    f1 = {r["model"]: 2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1) for r in counts}
    out: dict[tuple, list[float]] = {}
    for i, s in enumerate(settings):
        out.setdefault((s.c, s.l1_ratio), []).append(f1.get(i, 0.0))
    return [round(math.fsum(v) / len(v), rounded) for v in out.values()]
