"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64-bit majority over the XXH64 of all word shingles. Equal
fingerprints are one node. The 64 bits are grouped into ``m`` partitions of
correlated bits; thresholds t_i with sum(t_i) = radius - m + 1 are chosen by
dynamic programming over estimated probe and candidate counts of the whole
table; two fingerprints within ``radius`` bits agree within t_i in at least one
partition i with t_i >= 0. Every node is probed under all values within t_i,
joined on (partition, value) and verified by its Hamming distance.

A partition value shared by more than ``HOT`` nodes is not paired. Its members
emit their 65 one-bit neighbours instead: two fingerprints are within two bits
exactly when these sets meet, and one neighbour has at most 65 owners, so hot
values cost linear work and lose no link (radius 2; other radii use pairs).

Connected components come from alternating large-star / small-star steps over
checkpointed edge tables. Nothing that grows with the corpus reaches the driver:
it sees 64 + 64*64 bit counts and the collision histograms of the partitions.

Defined results: null text is empty; a text without words has fingerprint zero
and is linked like any other; repeated rows share a fingerprint; null ids count after all others; of rows
that repeat id and text ``drop_near_copies`` leaves one; an empty table
gives no rows; other columns are never read.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, beside, documents, spread_join, stable, text_or_empty, words_of
from .dedup import one_of_each

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
HOT = 256
#: Hashes turned into bits at a time: bounds memory on very long texts.
BLOCK = 1 << 15
#: Buckets of the collision histogram of a partition.
HIST = 4096


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    words = words_of(text)
    if not words:
        return 0
    total = max(1, len(words) - n + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        h = np.array([digest(b" ".join(words[i:i + n]), SEED)
                      for i in range(at, min(total, at + BLOCK))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS, keep: tuple = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and fp, the unsigned fingerprint's two's complement long."""
    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, n) for t in texts], dtype="<u8").view("<i8")}

    return beside(docs, make, "fp long", keep=keep)


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits set together, over all nodes."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.float64)
            n += len(x)
        yield pd.DataFrame({"i": np.append(np.arange(4096), -1), "v": np.append(total.ravel(), n)})

    got = {r["i"]: r["v"] for r in nodes.select("fp").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return int(got.get(-1, 0)), np.array([got.get(i, 0.0) for i in range(4096)]).reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each is grown from a seed by the bits most correlated with it."""
    p = np.diag(both) / max(1, n)
    cov = both / max(1, n) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, parts = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [min(free, key=lambda b: (abs(p[b] - 0.5), b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def mask_of(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def collisions(nodes: DataFrame, parts: list[list[int]]) -> list[float]:
    """Estimated ordered pairs of nodes that agree on each partition, from hashed counts of all nodes."""
    slots = F.array(*[F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask_of(p)))), F.lit(HIST)) for p in parts])
    hist = nodes.select(F.posexplode(slots).alias("part", "slot")).groupBy("part", "slot").count()
    rows = hist.groupBy("part").agg(F.sum(F.col("count").cast("double") ** 2).alias("sq"), F.sum("count").alias("n")).collect()
    est = {r["part"]: max(0.0, (r["sq"] - r["n"] ** 2 / HIST) / (1 - 1 / HIST)) for r in rows}
    return [est.get(i, 0.0) for i in range(len(parts))]


def allocate(n: int, p: np.ndarray, parts, pairs, radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1 = partition unused) with the least estimated cost, by dynamic programming."""
    cost = []
    for bits, c0 in zip(parts, pairs):
        poly = np.array([1.0])
        for b in bits:
            d = 2 * p[b] * (1 - p[b])
            poly = np.convolve(poly, [1 - d, d])
        near = poly[: radius + 1] / max(poly[0], 1e-300)
        probes, line = 1, {-1: 0.0}
        for t in range(radius + 1):
            if t:
                probes = probes * (len(bits) - t + 1) // t
            before = line.get(t - 1, 0.0)
            line[t] = before + n * probes + c0 * min(near[t], float(n))
        cost.append(line)
    best = {0: (0.0, [])}
    for line in cost:
        nxt = {}
        for s, (c, ts) in best.items():
            for t, x in line.items():
                if s + t + 1 not in nxt or c + x < nxt[s + t + 1][0]:
                    nxt[s + t + 1] = (c + x, [*ts, t])
        best = nxt
    return best[radius + 1]


def plan(nodes: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The (bits, threshold) partitions to probe."""
    n, both = bit_counts(nodes)
    p = np.diag(both) / max(1, n)
    options = []
    for m in range(2, radius + 2):
        parts = group_bits(n, both, m)
        options.append((*allocate(n, p, parts, collisions(nodes, parts), radius), parts))
    _, ts, parts = min(options, key=lambda o: o[0])
    return [(bits, t) for bits, t in zip(parts, ts) if t >= 0]


def _flips(bits: list[int], t: int) -> list[int]:
    """Masks of up to t flipped bits."""
    from itertools import combinations
    return [mask_of(list(c)) for k in range(t + 1) for c in combinations(bits, k)]


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (u, v), u > v, that connect every pair of nodes within ``radius`` bits."""
    parts = plan(nodes, radius)
    fp = F.col("fp")
    index = nodes.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(mask_of(b))) for b, _ in parts])).alias("part", "value"))
    sizes = index.groupBy("part", "value").count()
    crowded = stable(sizes.where((F.col("count") > hot) & F.lit(radius == 2)).select("part", "value"))
    probes = reduce(DataFrame.unionByName, [
        nodes.select("fp", F.lit(i).alias("part"),
                     F.explode(F.array(*[fp.bitwiseAND(F.lit(mask_of(b))).bitwiseXOR(F.lit(x)) for x in _flips(b, t)])).alias("value"))
        for i, (b, t) in enumerate(parts)])
    cold = index.join(crowded, ["part", "value"], "left_anti")
    met = probes.alias("a").join(cold.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value"))
                                 & (F.col("a.fp") != F.col("b.fp"))
                                 & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
    pairs = met.select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v"))
    # A link across a crowded value: one side is a member, the other a prober, both emit their neighbours.
    members = probes.join(crowded, ["part", "value"], "left_semi").select("fp").distinct()
    around = members.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in _flips(list(range(64)), 1)])).alias("mid"))
    met_at = around.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met_at.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes with an edge."""
    e, last = stable(edges.select("u", "v")), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = stable(both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        m = big.groupBy("u").agg(F.min("v").alias("m"))
        e = stable(big.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _joined(rows: DataFrame, radius: int) -> DataFrame:
    """Adds the ``root`` (a fingerprint) and ``component_id`` of their component to written rows with doc_id and fp."""
    first = stable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("_rows")))
    linked = components(links(first.select("fp"), radius))
    named = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stable(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_nodes")))
    where = stable(spread_join(named.drop("first_id"), least, "root", "_nodes").drop("_nodes"))
    return spread_join(rows, where, "fp", "_rows").drop("_rows")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id of its component)."""
    return _joined(stable(fingerprints(docs, n)), radius).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays (the smallest doc_id, null ids last), with its own columns."""
    sha = F.sha2(ascii_lower(text_or_empty("text")).cast("binary"), 256)
    rows = stable(fingerprints(docs.select("doc_id", "text", sha.alias("text_sha256")), n, ("doc_id", "text_sha256")))
    found = stable(_joined(rows, radius).select("doc_id", "text_sha256", "root"))
    # Texts that share an id and a component are told apart by their digest, so one (id, digest) stays.
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")).alias("s")).select(
        F.col("s.doc_id").alias("_id"), F.col("s.text_sha256").alias("_sha"), F.lit(True).alias("_kept")).distinct()
    keys = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
    judged = keys.join(stays, keys["doc_id"].eqNullSafe(stays["_id"]) & (keys["text_sha256"] == stays["_sha"]), "left")
    return one_of_each(docs, judged.select("doc_id", "text_sha256", F.coalesce("_kept", F.lit(False)).alias("kept"), "_rows"), "_rows")


def op2_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
