"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector drawn from its code point; an n-gram's
vector binds (multiplies) its letters' vectors, each permuted (rolled) by its
place; a text's vector bundles (sums) its n-grams' vectors, and a language's
prototype bundles its training texts. The mean prototype is taken from all vectors,
and the language whose prototype has the largest cosine wins.

Training sums n-gram counts per language over all training documents (summed in
each task before the shuffle) and bundles them in numpy per task, so only
languages x ``DIM`` numbers reach the driver. Scoring bundles a block of texts as one
(texts x n-grams) by (n-grams x DIM) product.

Defined results: null text or text without a letter is ``und`` with score 0, as is every text when
nothing was learned; ties go to the first name; repeated rows get the same answer; an empty table
gives no rows; ids of any type are kept, null ones too; other columns are never read.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, documents, fold_of

DIM, GRAM, SEED = 1024, 3, 42
#: Characters bundled at a time; languages that prototypes may have (a bound on what is broadcast: 40 MB).
BLOCK_CHARS, MAX_LANGS = 1 << 17, 10_000
LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> str:
    """Lower-cased letter runs, one space around each; empty without letters.

    Word characters that are neither digits nor letters (numerals such as \u00b2, \u00bd, \u2167) part runs like spaces.
    """
    runs = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, runs)):
        runs = "".join(c if c.isalpha() else " " for r in runs for c in [*r, " "]).split()
    return f" {' '.join(runs)} " if runs else ""


def gram_codes(clean: str) -> np.ndarray:
    """int64 codes (21 bits a letter) of the letter trigrams."""
    cp = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return cp[:-2] << 42 | cp[1:-1] << 21 | cp[2:] if len(cp) >= GRAM else cp[:0]


class Letters:
    """Vectors of letters, made when first seen."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed, self.known = dim, seed, {}

    def of(self, cp: int) -> np.ndarray:
        if cp not in self.known:
            if len(self.known) > 1 << 14:
                self.known.clear()
            self.known[cp] = np.random.default_rng([self.seed, cp]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return self.known[cp]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """One bound vector for each n-gram code."""
        out = np.ones((len(codes), self.dim), dtype=np.int8)
        for place in range(GRAM):
            cps, at = np.unique(codes >> 21 * (GRAM - 1 - place) & (1 << 21) - 1, return_inverse=True)
            table = np.stack([np.roll(self.of(int(c)), GRAM - 1 - place) for c in cps])
            out *= table[at]
        return out


def _bundled(letters: Letters, codes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of weighted n-gram vectors by row, in blocks of n-grams."""
    total = np.zeros((n, letters.dim), dtype=np.float64)
    grams, at = np.unique(codes, return_inverse=True)
    for s in range(0, len(grams), 4096):
        held = (at >= s) & (at < s + 4096)
        block = grams[s:s + 4096]
        counts = np.bincount(rows[held] * len(block) + at[held] - s, weights=weights[held], minlength=n * len(block)).reshape(n, len(block))
        total += counts.astype(np.float32) @ letters.grams(block).astype(np.float32)
    return total


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes from all (text, lang) rows."""
    def count(batches):
        for b in batches:
            for lang, part in b.groupby("lang"):
                at = 0
                texts = [letters_of(t) for t in part["text"]]
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size < BLOCK_CHARS):
                        size += len(texts[end])
                        end += 1
                    codes, n = np.unique(np.concatenate([gram_codes(t) for t in texts[at:end]]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})
                    at = end

    def bundle(batches):
        letters = Letters()
        for b in batches:
            for lang, part in b.groupby("lang"):
                codes = part["gram"].to_numpy(np.int64)
                v = _bundled(letters, codes, np.zeros(len(codes), np.int64), part["n"].to_numpy(np.float64), 1)[0]
                yield pd.DataFrame({"lang": lang, "i": np.arange(DIM), "v": v})

    counts = training.where("lang is not null and text is not null").select("lang", "text").mapInPandas(
        count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counts.mapInPandas(bundle, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    per = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
    rows = sorted(per.limit(MAX_LANGS + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    table = np.array([[x["v"] for x in r["v"]] for r in rows]).reshape(-1, DIM)
    return [r["lang"] for r in rows], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, names: list[str], table: np.ndarray, keep: list[str] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, lang_pred, score (the cosine, at least 0)."""
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def make():
        names, table = shared.value
        letters = Letters()
        # What all languages share is taken from both sides before the cosine.
        mean = table.mean(axis=0) if len(table) > 1 else np.zeros(DIM)
        own = table - mean
        own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)

        def run(texts):
            clean = [letters_of(t) if t else "" for t in texts]
            best, score = np.full(len(clean), -1), np.zeros(len(clean))
            at = 0
            while names and at < len(clean):
                end, size = at, 0
                while end < len(clean) and (end == at or size < BLOCK_CHARS and end - at < 256):
                    size += len(clean[end])
                    end += 1
                codes = [gram_codes(t) for t in clean[at:end]]
                rows = np.repeat(np.arange(end - at), [len(c) for c in codes])
                flat = np.concatenate(codes)
                v = _bundled(letters, flat, rows, np.ones(len(flat)), end - at)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) - mean
                cos = v @ own.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                some = np.array([bool(t) for t in clean[at:end]])
                best[at:end] = np.where(some, cos.argmax(axis=1), -1)
                score[at:end] = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0)
                at = end
            return {"lang_pred": [names[i] if i >= 0 else "und" for i in best], "score": score}
        return run

    return beside(docs, make, "lang_pred string, score double", keep=["doc_id", *keep])


def op8_language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold_of("doc_id", 5) == 0).alias("held_out"))
    names, table = prototypes(docs.where("not held_out"))
    return identify(docs, names, table, ["held_out"])
