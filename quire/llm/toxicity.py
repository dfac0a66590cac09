"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: each word (edge punctuation gone, A-Z lower-cased), each two
neighbours and each two words with one between, hashed to ``DIM`` places. Whole texts are read, in training and scoring.

Training rows are a bounded sample: of all labelled rows that may be learned from, those whose hashed
id lies below the share that gives ``TRAIN_ROWS`` rows (all of them where there are fewer). The sample's ids are
broadcast (``TRAIN_ROWS`` short rows), so no text crosses a join. A feature whose summed gradient can never
exceed the L1 bound, because too few sample rows hold it, keeps weight zero by the method's own rule;
only the others get a place in the model.

Each step of the regression is one job: the rows of one minibatch (dealt by hashed id, so results don't
depend on partitions) give their summed gradient by feature, and per-coordinate FTRL-proximal updates follow:
z += g - sigma * w, n += g * g, w = 0 where |z| <= L1, else -(z - sign(z) L1) / ((beta + sqrt n) / alpha + L2).
L1 grows with the root of the sample's label variance, the size of a chance gradient. What stays is a sorted array of the
features with a weight, broadcast for scoring: at most the places of the model, in practice some hundred.

Defined results: a null or empty text has no features and gets the score of the bias alone; without labelled
rows of both kinds every score is the share of toxic labels (0 if none); several label rows of one id count as toxic if one does; null labels
and label rows without id are not used; repeated rows get the same answer; an empty table gives no rows; other columns are never read.
"""
from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import read_table

from .common import beside, blocks, documents, fold_of, stable, words_of

DIM = 1 << 26
TRAIN_ROWS = 20_000
BATCHES, EPOCHS = 4, 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.1
THRESHOLD = 0.7
#: Characters whose features are made at a time.
BLOCK_CHARS = 1 << 19
EDGE = b".,;:!?\"'()[]{}<>*_-"
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, [w.strip(EDGE) for w in words]), np.uint64, len(words))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all features of some texts, with repeats."""
    split = [words_of(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in split])
    h = hashes([w for words in split for w in words])
    rows, places = [row], [h * np.uint64(_A)]
    for gap, factor in ((1, _B), (2, _C)):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        places.append(((h[:-gap] * np.uint64(_A)) ^ (h[gap:] * np.uint64(factor)))[same] * np.uint64(_C))
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(38)).astype(np.int64)


def present(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct feature places of each text."""
    row, place = features(texts)
    both = np.unique(row * DIM + place)
    cuts = np.searchsorted(both, np.arange(1, len(texts)) * DIM)
    return [x % DIM for x in np.split(both, cuts)] if texts else []


def sample(labels: DataFrame, may_learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y, batch): at most about ``rows`` labelled ids, chosen and dealt to minibatches by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn).groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    return stable(known.where(place < int(share * (1 << 40))).withColumn("batch", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(BATCHES)).cast("int")))


def training_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(y, batch, places) of the chosen rows; the chosen ids are broadcast (see ``sample``)."""
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        def run(texts):
            return {"places": [p for s, e in blocks([t or "" for t in texts], BLOCK_CHARS) for p in present(texts[s:e])]}
        return run

    return stable(beside(held, make, "places array<int>", keep=["y", "batch"]))


@dataclass
class Model:
    """Sorted places with their weights, and the bias."""
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.places):
            row, place = features(texts)
            maybe = self._low[place & 0xFFFFF]
            row, place = row[maybe], place[maybe]
            at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
            hit = self.places[at] == place
            both = np.unique(row[hit] * len(self.places) + at[hit])
            out += np.bincount(both // len(self.places), self.weights[both % len(self.places)], len(texts))
        return out

    def __post_init__(self):
        self._low = np.zeros(1 << 20, dtype=bool)
        self._low[self.places & 0xFFFFF] = True


def sigmoid(x):
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


def ftrl_step(z: np.ndarray, n: np.ndarray, w: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Updates z and n with the gradient g in place and returns the new weights."""
    sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
    z += g - sigma * w
    n += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def gradient(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Summed logistic gradient over (y, ids) rows; the last coordinate is the bias."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        import pyarrow as pa
        w = shared.value
        g = np.zeros(len(w))
        for b in batches:
            ids = b.column("ids")
            flat, row = ids.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), ids.value_lengths().to_numpy())
            margin = w[-1] + np.bincount(row, w[flat], b.num_rows)
            error = sigmoid(margin) - b.column("y").to_numpy()
            g += np.bincount(flat, error[row], len(w))
            g[-1] += error.sum()
        at = np.flatnonzero(g)
        for s in range(0, len(at), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(at[s:s + (1 << 14)]), pa.array(g[at[s:s + (1 << 14)]])], ["at", "g"])

    out = np.zeros(len(w))
    # Rounded, so that the order of summing leaves no trace.
    total = rows.mapInArrow(run, "at long, g double").groupBy("at").agg(F.round(F.sum("g"), 9).alias("g")).toArrow()
    out[total.column("at").to_numpy()] = total.column("g").to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """The model learned from the labelled rows that satisfy ``may_learn`` (on ``labels``)."""
    chosen = sample(labels, may_learn)
    rows = training_rows(docs, chosen)
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    none = np.zeros(0, dtype=np.int64)
    if not toxic or toxic == total:
        return Model(none, np.zeros(0), math.inf if toxic else -math.inf)
    share = toxic / total
    l1 = L1 * math.sqrt(total * share * (1 - share))
    # A feature's gradients over all epochs sum to less than its rows times the epochs.
    counts = rows.select(F.explode("places").alias("place")).groupBy("place").count().where(F.col("count") * EPOCHS > l1)
    places = np.sort(counts.select("place").toArrow().column("place").to_numpy().astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def make():
        places = np.append(shared.value, DIM)

        def run(lists):
            own = [np.asarray(p, dtype=np.int64) for p in lists]
            at = [np.searchsorted(places, p) for p in own]
            return {"ids": [a[places[a] == p].astype(np.int32) for a, p in zip(at, own)]}
        return run

    active = stable(beside(rows, make, "ids array<int>", keep=["y", "batch"], read=["places"]))
    z, n, w = (np.zeros(len(places) + 1) for _ in range(3))
    bound = np.append(np.full(len(places), l1), 0.0)
    w[-1] = math.log(share / (1 - share))
    for _ in range(EPOCHS):
        for k in range(BATCHES):
            bias = w[-1]
            g = gradient(active.where(F.col("batch") == k).select("y", "ids"), w)
            w = ftrl_step(z, n, w, g, bound)
            # The bias starts at the log odds and takes damped steps of its own.
            w[-1] = bias - g[-1] / max(1.0, total / BATCHES * share)
    some = np.flatnonzero(w[:-1])
    return Model(places[some], w[some], float(w[-1]))


def score(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def run(texts):
            parts = [model.margins(texts[s:e]) for s, e in blocks([t or "" for t in texts], BLOCK_CHARS)]
            return {"score": sigmoid(np.concatenate(parts)) if parts else []}
        return run

    return beside(docs, make, "score double", keep=["doc_id", *keep])


def op11_toxicity(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold_of("doc_id", 3) == 1).alias("held_out"))
    model = train(docs, read_table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return score(docs, model, ["held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
