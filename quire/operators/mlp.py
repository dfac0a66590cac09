"""A multilayer perceptron trained by synchronous minibatch gradients.

Rows are dealt to minibatches by a hash of their number, one tenth of them to a held-out split. Every
step is one pass over a minibatch: tasks return summed gradients (as many numbers as the model has weights), the driver takes an Adam
step and broadcasts the new weights. Up to ``LOCAL_CELLS`` numbers (rows x features) one task holds the rows and takes the same steps,
``EPOCHS`` epochs a job. A minibatch has at least ``batch_size`` rows; an epoch has at most
``MAX_STEPS`` of them, so on large tables a minibatch grows with the table instead of the number of jobs. Training ends after
``PATIENCE`` epochs without a better held-out accuracy (by ``TOLERANCE``), and the best epoch's weights stay.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.session import ensure_checkpoint_dir

MAX_STEPS, PATIENCE, TOLERANCE, HELD_OUT = 32, 10, 1e-4, 10
LOCAL_CELLS, EPOCHS = 1 << 22, 20


def start_weights(layers: Sequence[int], activation: str, seed: int) -> list[np.ndarray]:
    """Uniform start weights (matrix and bias of each layer) bounded by the layer's width."""
    rng, out = np.random.default_rng([seed, 5]), []
    for a, b in zip(layers, layers[1:]):
        bound = math.sqrt((2.0 if activation == "logistic" else 6.0) / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def _act(z: np.ndarray, activation: str) -> np.ndarray:
    return np.maximum(z, 0.0) if activation == "relu" else np.tanh(z)


def forward(w: list[np.ndarray], x: np.ndarray, activation: str) -> list[np.ndarray]:
    """Inputs, hidden activations and the probability of class 1."""
    out = [x]
    for k in range(0, len(w) - 2, 2):
        out.append(_act(out[-1] @ w[k] + w[k + 1], activation))
    z = out[-1] @ w[-2] + w[-1]
    return [*out, 0.5 * (1 + np.tanh(z / 2))]


def loss_and_gradient(w: list[np.ndarray], x: np.ndarray, y: np.ndarray, activation: str) -> tuple[float, list[np.ndarray]]:
    """Summed log loss of some rows and its gradient (without weight decay)."""
    acts = forward(w, x, activation)
    p = np.clip(acts[-1][:, 0], 1e-15, 1 - 1e-15)
    loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    delta, grads = (acts[-1][:, 0] - y)[:, None], []
    for k in range(len(w) - 2, -1, -2):
        below = acts[k // 2]
        grads = [below.T @ delta, delta.sum(axis=0), *grads]
        if k:
            back = delta @ w[k].T
            delta = back * ((below > 0) if activation == "relu" else 1 - below * below)
    return loss, grads


@dataclass
class Perceptron:
    features: list[str]
    weights: list[np.ndarray]
    activation: str
    epochs: int = 0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, np.nan_to_num(x), self.activation)[-1][:, 0]

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, prediction (0/1 at a score of 0.5) and score."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                m = np.array([[np.nan if v is None else v for v in row] for row in x], dtype=np.float64).reshape(len(x), -1)
                yield pd.Series(model.value.scores(m) if len(x) else np.zeros(0))

        out = df.select(*[quote(k) for k in keep], score(F.array(*[quote(c).cast("double") for c in self.features])).alias("score"))
        return out.select(*[quote(k) for k in keep], (F.col("score") >= 0.5).cast("int").alias("prediction"), "score")


def _pass(rows: DataFrame, w: list[np.ndarray], activation: str, learn: bool) -> tuple[float, float, list[np.ndarray]]:
    """Rows, correct rows and (if learning) the summed gradient over (x, y) rows."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    size = sum(v.size for v in w)

    def run(batches):
        w = shared.value
        n = right = 0.0
        total = np.zeros(size if learn else 0)
        for b in batches:
            y = b.column("y").to_numpy().astype(np.float64)
            x = np.nan_to_num(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
            n += len(y)
            if learn:
                total += np.concatenate([g.ravel() for g in loss_and_gradient(w, x, y, activation)[1]])
            else:
                right += float(((forward(w, x, activation)[-1][:, 0] >= 0.5) == (y == 1)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([right]), pa.array([total.tobytes()])], ["n", "r", "g"])

    parts = rows.select("x", "y").mapInArrow(run, "n double, r double, g binary").collect()
    total = sum((np.frombuffer(p["g"]) for p in parts), np.zeros(size if learn else 0))
    grads, at = [], 0
    for v in w if learn else []:
        grads.append(total[at:at + v.size].reshape(v.shape))
        at += v.size
    return sum(p["n"] for p in parts), sum(p["r"] for p in parts), grads


@dataclass
class Training:
    """Weights, Adam's moments and the best epoch so far."""
    w: list[np.ndarray]
    alpha: float
    rate: float
    m: list[np.ndarray] = field(default_factory=list)
    v: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    best: float = -1.0
    since: int = 0
    t: int = 0
    epoch: int = 0

    def __post_init__(self):
        self.m, self.v, self.kept = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w], [x.copy() for x in self.w]

    def step(self, size: float, grads: list[np.ndarray]) -> None:
        if not size:
            return
        self.t += 1
        for i, g in enumerate(grads):
            # Weight decay acts on matrices, not on biases.
            g = (g + (self.alpha * self.w[i] if i % 2 == 0 else 0.0)) / size
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - self.rate * (self.m[i] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[i] / (1 - 0.999 ** self.t)) + 1e-8)

    def judge(self, share: float) -> None:
        """Ends an epoch with its share of correct held-out rows."""
        self.epoch += 1
        self.since = 0 if share > self.best + TOLERANCE else self.since + 1
        if share > self.best:
            self.best, self.kept = share, [x.copy() for x in self.w]


def _epochs_here(rows: DataFrame, run: Training, steps: int, activation: str, until: int) -> Training:
    """Several epochs in the one task that holds all rows (at most ``LOCAL_CELLS`` numbers); each step as the passes would take it."""
    import pickle

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending")]).combine_chunks()
        part, y = group.column("part").to_numpy(), group.column("y").to_numpy().astype(np.float64)
        x = np.nan_to_num(group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
        held = part < 0
        own = [np.flatnonzero(part == k) for k in range(steps)]
        state = pickle.loads(pickle.dumps(run))
        while state.epoch < until and state.since < PATIENCE:
            for rows_ in own:
                state.step(len(rows_), loss_and_gradient(state.w, x[rows_], y[rows_], activation)[1] if len(rows_) else [])
            right = (forward(state.w, x[held], activation)[-1][:, 0] >= 0.5) == (y[held] == 1)
            state.judge(float(right.mean()) if len(right) else 0.0)
        return pa.table({"state": pa.array([pickle.dumps(state)], pa.binary())})

    got = rows.groupBy(F.lit(0).alias("all")).applyInArrow(train, "state binary").collect()
    if not got:
        run.epoch = until
        return run
    return pickle.loads(got[0]["state"])


def fit_perceptron(train: DataFrame, features: Sequence[str], label: str, hidden_layer_sizes: Sequence[int] = (128, 64), activation: str = "relu",
                   alpha: float = 1e-4, learning_rate_init: float = 1e-3, batch_size: int = 64, max_iter: int = 500, seed: int = 42) -> Perceptron:
    ensure_checkpoint_dir(train.sparkSession)
    if activation not in ("relu", "tanh"):
        raise ValueError(f"activation must be relu or tanh, not {activation!r}")
    base = train.select(F.array(*[quote(c).cast("double") for c in features]).alias("x"), (quote(label) == 1).cast("int").alias("y")).where("y is not null")
    rows = base.withColumn("h", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).checkpoint()
    learn = rows.where(F.pmod("h", F.lit(HELD_OUT)) != 0)
    held = rows.where(F.pmod("h", F.lit(HELD_OUT)) == 0)
    n = learn.count()
    steps = max(1, min(MAX_STEPS, math.ceil(n / batch_size)))
    part = F.pmod(F.floor(F.col("h") / HELD_OUT), F.lit(steps))
    run = Training(start_weights([len(features), *hidden_layer_sizes, 1], activation, seed), alpha, learning_rate_init)
    if rows.count() * max(len(features), 1) <= LOCAL_CELLS:
        while run.epoch < max_iter and run.since < PATIENCE:
            run = _epochs_here(rows.select("x", "y", "h", F.when(F.pmod("h", F.lit(HELD_OUT)) == 0, -1).otherwise(part).cast("long").alias("part")), run, steps, activation, min(max_iter, run.epoch + EPOCHS))
        return Perceptron(list(features), run.kept, activation, run.epoch)
    for _ in range(max_iter):
        for k in range(steps):
            size, _, grads = _pass(learn.where(part == k), run.w, activation, True)
            run.step(size, grads)
        size, right, _ = _pass(held, run.w, activation, False)
        run.judge(right / size if size else 0.0)
        if run.since >= PATIENCE:
            break
    return Perceptron(list(features), run.kept, activation, run.epoch)
