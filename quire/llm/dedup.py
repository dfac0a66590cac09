"""Exact deduplication with two Bloom passes (built-in functions only).

Pass one hashes every normalised text to ``HASHES`` slots of a bit array, counts
the slots that two or more rows hit (partial sums before the shuffle, narrow
rows) and packs those into 4 KB bitmaps: a Bloom filter of the possibly
repeated hashes. Pass two probes it on the map side; only rows whose slots are
all set are shuffled by their SHA-256, every other row passes straight through.

The filter is broadcast, one table for each hash: ``bits`` is at most ``MAX_BITS``
(128 MB each, 256 MB in all) whatever the input, about 16 bits a row below that. A fuller filter lets
more rows through to the exact step; the result is the same.

Defined results: null text counts as empty; empty texts are equal to each
other; among equal texts the row with the largest ``doc_id`` stays (null ids
last); rows that repeat both id and text are one document, each gets the same
answer, and ``drop_copies`` leaves one of them (any one, if other columns differ); an empty table gives an empty table; other columns are never read.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, spread_join, stable, text_or_empty

HASHES = 2
MAX_BITS = 1 << 30
BITS_PER_ROW = 16
BITMAP_BITS = 32768


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of the normalised texts."""
    return docs.select("doc_id", F.sha2(ascii_lower(text_or_empty("text")).cast("binary"), 256).alias("text_sha256"))


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(BITMAP_BITS, 1 << math.ceil(math.log2(max(1, rows) * BITS_PER_ROW))))


def _slot(bits: int, k: int):
    return F.pmod(F.xxhash64("text_sha256", F.lit(k)), F.lit(bits))


def repeated_filter(rows: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (k, bucket, bitmap) of the slots that at least two rows hit."""
    slots = rows.select(F.posexplode(F.array(*[_slot(bits, k) for k in range(HASHES)])).alias("k", "slot"))
    twice = slots.groupBy("k", "slot").count().where("count > 1")
    return twice.groupBy("k", F.floor(F.col("slot") / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap"))


def probe(rows: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """Adds ``maybe_repeated``; the bitmaps are broadcast (at most bits * HASHES / 8 bytes)."""
    hit = F.lit(True)
    for k in range(HASHES):
        side = F.broadcast(bloom.where(F.col("k") == k).select(
            F.col("bucket").alias(f"_bucket{k}"), F.col("bitmap").alias(f"_bitmap{k}")))
        slot = _slot(bits, k)
        rows = rows.join(side, F.floor(slot / BITMAP_BITS) == F.col(f"_bucket{k}"), "left")
        at = slot % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{k}"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        hit = hit & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    drop = [f"_{n}{k}" for n in ("bucket", "bitmap") for k in range(HASHES)]
    return rows.withColumn("maybe_repeated", hit).drop(*drop)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stable(digests(docs))
    bits = filter_bits(rows.count())
    probed = probe(rows, repeated_filter(rows, bits), bits)
    again = probed.where("maybe_repeated").select("doc_id", "text_sha256")
    groups = stable(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    settled = spread_join(again, groups, "text_sha256", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    passed = probed.where(~F.col("maybe_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return passed.unionByName(settled)


def one_of_each(docs: DataFrame, judged: DataFrame, rows: str | None = None) -> DataFrame:
    """The documents whose (doc_id, text_sha256) is ``kept`` in ``judged``, with their own columns; of rows that repeat both, one.

    ``judged`` has a row for each document, or for several whose number is in the column ``rows``.
    Only the pairs that go, or stay but repeat, are joined against; rows of the latter meet as one row a key and task.
    """
    keys = stable(judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.sum(rows or F.lit(1)).alias("rows"))
                  .where("not kept or rows > 1").withColumnsRenamed({"doc_id": "_key_id", "text_sha256": "_key_sha"}))
    sha = F.sha2(ascii_lower(text_or_empty("text")).cast("binary"), 256)
    same = docs["doc_id"].eqNullSafe(keys["_key_id"]) & (sha == keys["_key_sha"])
    single = docs.join(keys.select("_key_id", "_key_sha"), same, "left_anti")
    twice = keys.where("kept")
    if twice.isEmpty():
        return single
    again = docs.join(twice, same).groupBy("_key_id", "_key_sha").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("_row"))
    return single.unionByName(again.select("_row.*"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts stays (the largest doc_id), with its own columns."""
    return one_of_each(docs, exact_dedup(docs))


def op4_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
