"""Scores texts with a hashed maximum-entropy language model.

A word belongs to one of ``CLASSES`` classes (its hash; the text end has the
empty token). The model is class-factored: p(w | context) = p(class(w) | context)
* p(w | class). The class softmax is a maximum-entropy model over three hashed
features: the previous word, the word before that (skip) and both together. Inside
a class the softmax has the bias alone, whose likelihood optimum with add-one
smoothing is (c + 1) / (N_class + V_class + 1).

Training is distributed: in each round every task follows minibatch gradients
through its own training texts from the shared weights, and the tasks' weights are averaged
by tokens, feature row by feature row, on Spark (``ROUNDS`` passes over all training
texts). Only the weights (3 * ``ROWS`` * ``CLASSES`` numbers) and the class totals
reach the driver.

Word counts come from all training texts. Each task cuts its documents into blocks of
about ``BLOCK_CHARS`` characters and emits the block's distinct words with their
training counts; these are summed by word, joined back to the (block, word) rows and
dealt by block, so a block's texts meet the counts of exactly their own words. A
frequent word has one row a block, not one a document, and a block is the most any
group holds (a longer document is a block of its own). Blocks are cut anew when texts are dealt: ``docs`` must be a scan
or a written table, whose rows come in the same order again; else a word without a
count stops the job.

Defined results: a null or empty text is its end token alone; without training
texts all counts are 0 and the class softmax is uniform; repeated rows get the same answer; an empty table gives no rows;
ids of any type are kept, null ones too; other columns are never read.
"""
from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.session import ensure_checkpoint_dir

from .common import blocks, documents, fold_of, words_of

CLASSES, ROWS, ROUNDS = 32, 1 << 12, 1
RATE, MINIBATCH = 2.0, 8192
BLOCK_CHARS = 1 << 22
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and (3 x tokens) feature rows of one text's tokens; starts count as hash 1 and 2."""
    h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    one = np.concatenate([[1], h[:-1]])
    two = np.concatenate([[2, 1], h[:-2]])[: len(h)]
    both = (one * 0x9E3779B1 + two * 0x85EBCA77) >> 7
    return h % CLASSES, np.stack([one // CLASSES % ROWS, ROWS + two // CLASSES % ROWS, 2 * ROWS + both % ROWS]).astype(np.int16)


def activations(w: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class activations of each token (largest 0) and their exponentials."""
    z = w.take(feats[0], axis=0)
    z += w.take(feats[1], axis=0)
    z += w.take(feats[2], axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z, np.exp(z)


def class_logp(w: np.ndarray, cls: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class."""
    z, e = activations(w, feats)
    return z[np.arange(len(cls)), cls] - np.log(e.sum(axis=1))


def step(w: np.ndarray, cls: np.ndarray, feats: np.ndarray, rate: float) -> None:
    """One minibatch: each feature row moves by the mean gradient of its tokens, damped by their number."""
    _, g = activations(w, feats)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(cls)), cls] -= 1
    for f in feats:
        order = np.argsort(f, kind="stable")
        rows = f[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        n = np.diff(np.append(first, len(rows))).astype(np.float32)
        w[rows[first]] -= np.add.reduceat(g.take(order, axis=0), first, axis=0) * (rate / 3 / (n + 4))[:, None].astype(np.float32)


def minibatches(texts, size: int):
    """(classes, features) of whole texts, cut into minibatches."""
    cls, feats, n = [], [], 0
    for t in texts:
        c, f = features(tokens_of(t))
        for s in range(0, len(c), size):
            cls.append(c[s:s + size])
            feats.append(f[:, s:s + size])
            n += len(cls[-1])
            if n >= size:
                yield np.concatenate(cls), np.concatenate(feats, axis=1)
                cls, feats, n = [], [], 0
    if n:
        yield np.concatenate(cls), np.concatenate(feats, axis=1)


def train(training: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Averaged weights (3 * ROWS, CLASSES) after ``rounds`` passes over all training texts."""
    weights = np.zeros((3 * ROWS, CLASSES), dtype=np.float32)
    for k in range(rounds):
        shared = training.sparkSession.sparkContext.broadcast(weights)

        def run(batches, shared=shared, rate=rate / (k + 1)):
            w = shared.value.copy()
            seen = np.zeros(len(w), dtype=np.int64)
            for b in batches:
                for cls, feats in minibatches(b["text"], MINIBATCH):
                    step(w, cls, feats, rate)
                    seen += np.bincount(feats.ravel(), minlength=len(w))
            rows = np.flatnonzero(seen)
            for s in range(0, len(rows), 4096):
                part = rows[s:s + 4096]
                yield pd.DataFrame({"row": part, "n": seen[part], "w": list((w[part].astype(np.float64) * seen[part][:, None]))})

        parts = training.select("text").mapInPandas(run, "row int, n long, w array<double>")
        mean = parts.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(CLASSES)])
        for r in mean.select("row", F.array(*[F.col(f"w{i}") / F.col("n") for i in range(CLASSES)]).alias("w")).collect():
            weights[r["row"]] = r["w"]
    return weights


def _in_blocks(batches):
    """(block, record batches): the task's rows in blocks of about BLOCK_CHARS characters, numbered within the task."""
    task, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        for s, e in blocks(texts, BLOCK_CHARS):
            chars = sum(map(len, texts[s:e]))
            if held and size + chars > BLOCK_CHARS:
                yield task | n, held
                n, held, size = n + 1, [], 0
            held.append(b.slice(s, e - s))
            size += chars
    if held:
        yield task | n, held


def block_words(rows: DataFrame) -> DataFrame:
    """(block, word, n): the distinct words of each block, n of their tokens in training texts."""
    def run(batches):
        for block, parts in _in_blocks(batches):
            n: Counter = Counter()
            for part in parts:
                for t, held in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist()):
                    toks = tokens_of(t)
                    if held:
                        for w in toks:
                            n.setdefault(w, 0)
                    else:
                        n.update(toks)
            # Sorted words compress well in the written table.
            words = sorted(n)
            for s in range(0, len(words), 1 << 15):
                some = words[s:s + (1 << 15)]
                yield pa.RecordBatch.from_pydict({"block": [block] * len(some), "word": some, "n": [n[w] for w in some]},
                                                 schema=pa.schema([("block", pa.int64()), ("word", pa.binary()), ("n", pa.int64())]))

    return rows.select("held_out", "text").mapInArrow(run, "block long, word binary, n long")


def block_texts(rows: DataFrame) -> DataFrame:
    """The rows with the block that ``block_words`` counted them in."""
    def run(batches):
        for block, parts in _in_blocks(batches):
            for part in parts:
                for s in range(0, part.num_rows, 256):
                    some = part.slice(s, 256)
                    yield some.append_column("block", pa.array([block] * some.num_rows, pa.int64()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("block long").fields]))


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on the rows not held out."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    weights = train(rows.where("not held_out"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/words-{uuid.uuid4().hex}"
    block_words(rows).write.parquet(f"{base}/blocks")
    words = spark.read.parquet(f"{base}/blocks")
    words.groupBy("word").agg(F.sum("n").alias("c")).write.parquet(f"{base}/counts")
    counts = spark.read.parquet(f"{base}/counts")
    totals = {r["class"]: (r["n"], r["v"]) for r in counts.where("c > 0").groupBy((F.crc32("word") % CLASSES).alias("class")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_all, v_all = sum(n for n, _ in totals.values()), sum(v for _, v in totals.values())
    log_size = np.log10([sum(totals.get(c, (0, 0))) + 1.0 for c in range(CLASSES)])
    log_all = math.log10(n_all + v_all + 1)
    shared = spark.sparkContext.broadcast((weights, log_size))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def run(texts, vocabulary):
        w, log_size = shared.value
        logs = dict(zip(vocabulary.column("word").to_pylist(), np.log10(vocabulary.column("c").to_numpy().astype(np.float64) + 1)))
        out = []
        for t in texts.column("text").to_pylist():
            toks = tokens_of(t)
            own = np.fromiter(map(logs.__getitem__, toks), np.float64, len(toks))
            cls, feats = features(toks)
            model = sum(float(class_logp(w, cls[s:s + MINIBATCH], feats[:, s:s + MINIBATCH]).sum(dtype=np.float64))
                        for s in range(0, len(cls), MINIBATCH)) / math.log(10)
            total = float(own.sum())
            out.append((len(toks), int(np.count_nonzero(own)), n_all, total - len(toks) * log_all, total + model - float(log_size[cls].sum())))
        shape = to_arrow_schema(schema)
        new = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(shape)[2:])]
        return pa.table([texts.column("doc_id").cast(shape.field(0).type), texts.column("held_out"), *new], schema=shape)

    known = words.select("block", "word").join(counts, "word")
    return block_texts(rows).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def op10_lm_scoring(spark, sf_dir) -> DataFrame:
    return score(documents(spark, sf_dir), fold_of("doc_id", 7) == 2)
