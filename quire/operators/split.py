"""Exact stratified split and stratified k-fold assignment.

Rows are ordered inside each class by a seeded hash of the key, and the first
``t_k`` rows of class ``k`` go to the test side, where ``t_k`` follows the
largest-remainder allocation of a stratified shuffle split (train quota
allocated first, ties broken by class value). Counts are exact — unlike
Bernoulli ``sampleBy`` — deterministic, disjoint and exhaustive. The split needs
no order of the rows, only the hash at each class's cut; the folds number rows by
counts of hash prefixes. A class holding most rows is never ranked in one task, and no wide row is written or sorted for the split.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.selection import hash_rank, select_hashes


def hash_order(key: str, seed: int = 42, method: str = "md5", salt: str | None = None) -> Column:
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt else []) + [quote(key).cast("string")]
    if method == "md5":
        return F.md5(F.concat_ws("|", *parts))
    if method == "xxhash64":
        return F.xxhash64(*parts)
    raise ValueError(f"unknown hash method {method!r}")


def allocate(class_counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of ``n_draws`` over classes; ties → smaller class value."""
    total = sum(class_counts.values())
    cont = {k: v / total * n_draws for k, v in class_counts.items()}
    floored = {k: math.floor(v) for k, v in cont.items()}
    need = n_draws - sum(floored.values())
    order = sorted(class_counts, key=lambda k: (-(cont[k] - floored[k]), k))
    for k in order[:need]:
        floored[k] += 1
    return floored


def holdout_quota(class_counts: dict, test_size: float = 0.2) -> dict:
    n = sum(class_counts.values())
    n_test = math.ceil(test_size * n)
    train = allocate(class_counts, n - n_test)
    return {k: class_counts[k] - train[k] for k in class_counts}


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     seed: int = 42, method: str = "md5", flag: str = "is_test") -> DataFrame:
    """Add boolean ``flag``: the row belongs to the test side.

    Per class the hash of the last test row is found (``selection.select_hashes``; one row per class and
    a bounded number of counts reach the driver); the split itself is a projection that compares
    each row's hash with its class's cut. Rows that repeat a key stay on one side.
    """
    h = hash_order(key, seed, method)
    # Hashes that are not text are compared as zero-padded hexadecimal text.
    h = h if method == "md5" else F.lower(F.lpad(F.hex(h), 16, "0"))
    counts = {r[label]: r["n"] for r in
              df.groupBy(quote(label).alias(label)).agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = select_hashes(df, h, label, holdout_quota(counts, test_size))
    test = F.lit(False)
    for k, cut in cuts.items():
        test = test | (quote(label).eqNullSafe(F.lit(k)) & (h <= F.lit(cut)))
    return df.withColumn(flag, test)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42,
                     method: str = "md5", fold_col: str = "fold") -> DataFrame:
    """Add ``fold`` ∈ [0, k): round-robin over the in-class hash order."""
    h = "_h"
    text = hash_order(key, seed, method, salt="fold")
    text = text if method == "md5" else F.lower(F.lpad(F.hex(text), 16, "0"))
    ranked = hash_rank(df.withColumn(h, text), h, label, [key], "_rn")
    return ranked.withColumn(fold_col, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn", h)
