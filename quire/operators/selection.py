"""Order statistics by refined histograms: no sort, no range exchange, no checkpoint.

To find the k-th smallest value every row is mapped by a non-decreasing function to one of a bounded number of bins,
and bins are counted map-side together with their smallest and largest value. The bin that holds rank k is then cut into
bins of its own, until its smallest and largest value are equal. Each pass shrinks a bin a thousandfold, so a
trillion rows take about five; what reaches the driver is at most ``BINS`` rows for each statistic asked for.
Text (hashes) is refined the same way, by the next ``DIGITS`` hexadecimal digits.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.functions.numeric import numeric_double

BINS = 1024
#: Hexadecimal digits that a pass over hashes refines by; length of an md5 hash.
DIGITS, HASH_DIGITS = 3, 32
LARGEST = 1.7976931348623157e308


@dataclass
class _Target:
    """Rank ``k`` (from 1) among the values of ``column`` in [lo, hi]."""
    column: str
    k: int
    lo: float
    hi: float


def _finite(c: str) -> Column:
    v = numeric_double(quote(c))
    # least() and greatest() skip nulls, so a missing value must be kept out explicitly.
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-LARGEST)), F.lit(LARGEST)))


def _bin(v: Column, t: _Target) -> Column:
    """Non-decreasing in v: 0 at lo, BINS - 1 at hi (halves keep the difference finite)."""
    share = (v / 2 - F.lit(t.lo / 2)) / F.lit(t.hi / 2 - t.lo / 2)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def _value(x: float) -> float:
    return math.copysign(math.inf, x) if abs(x) >= LARGEST else x


def select_values(df: DataFrame, ranks: dict[str, Sequence[int]], bounds: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """(column, rank) -> value, for ranks (from 1) among non-null values; ``bounds`` are each column's extremes."""
    out: dict[tuple[str, int], float] = {}
    open_ = {(c, k): _Target(c, k, *bounds[c]) for c, ks in ranks.items() for k in ks}
    while True:
        for key in [key for key, t in open_.items() if not t.lo < t.hi]:
            out[key] = _value(open_.pop(key).lo)
        if not open_:
            return out
        # Ranks of one column in the same bracket share its bins.
        brackets = sorted({(t.column, t.lo, t.hi) for t in open_.values()})
        entries = []
        for i, (c, lo, hi) in enumerate(brackets):
            v = _finite(c)
            inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
            entries.append(F.struct(F.lit(i).alias("bracket"), F.when(inside, _bin(v, _Target(c, 0, lo, hi))).alias("bin"), v.alias("v")))
        long = df.select(F.inline(F.array(*entries))).where(F.col("bin").isNotNull())
        cells = long.groupBy("bracket", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        found: dict[tuple, list] = {}
        for r in sorted(cells, key=lambda r: (r["bracket"], r["bin"])):
            found.setdefault(brackets[r["bracket"]], []).append(r)
        for key, t in open_.items():
            k = t.k
            for r in found[t.column, t.lo, t.hi]:
                if k <= r["n"]:
                    break
                k -= r["n"]
            open_[key] = _Target(t.column, k, r["lo"], r["hi"])


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values for even counts); None for a column without values."""
    if not cols:
        return {}
    row = df.select(*[x for i, c in enumerate(cols) for x in (
        F.count(_finite(c)).alias(f"n{i}"), F.min(_finite(c)).alias(f"lo{i}"), F.max(_finite(c)).alias(f"hi{i}"))]).first()
    stats = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}
    live = {c: s for c, s in stats.items() if s[0]}
    got = select_values(df, {c: sorted({(n + 1) // 2, n // 2 + 1}) for c, (n, _, _) in live.items()}, {c: (lo, hi) for c, (_, lo, hi) in live.items()})
    return {c: (got[c, (live[c][0] + 1) // 2] + got[c, live[c][0] // 2 + 1]) / 2 if c in live else None for c in cols}


def select_hashes(df: DataFrame, hashed: Column, group: str, ranks: dict) -> dict:
    """group value -> the hash of the given rank (from 1) in that group; groups asked for rank 0 are left out."""
    out: dict = {}
    open_ = {g: (k, "") for g, k in ranks.items() if k > 0}
    rows = df.select(quote(group).alias("g"), hashed.alias("h"))
    while open_:
        n = len(next(iter(open_.values()))[1]) + DIGITS
        inside = F.lit(False)
        for g, (_, prefix) in open_.items():
            inside = inside | (F.col("g").eqNullSafe(F.lit(g)) & F.col("h").startswith(prefix))
        cells = rows.where(inside).groupBy("g", F.substring("h", 1, n).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        for g, (k, _) in list(open_.items()):
            for r in sorted((r for r in cells if r["g"] == g), key=lambda r: r["bin"]):
                if k <= r["n"]:
                    break
                k -= r["n"]
            if r["lo"] == r["hi"] or n >= HASH_DIGITS:
                out[g] = r["lo"]
                del open_[g]
            else:
                open_[g] = (k, r["bin"])
    return out


def hash_rank(df: DataFrame, hashed: str, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the row number (from 1) within ``group`` in order of the column ``hashed``, then ``order``.

    The rows before a row are those of smaller hash prefixes (counted once; at most 16 ** (DIGITS + 1) prefixes a group)
    and those before it under its own prefix, so no group is ever in one task.
    """
    prefix = F.substring(F.col(hashed), 1, DIGITS + 1)
    counts = df.groupBy(quote(group).alias("_group"), prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_group", "_prefix", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(quote(group), prefix).orderBy(F.col(hashed), *[quote(c) for c in order])
    ranked = df.withColumn("_own", F.row_number().over(own)).withColumn("_prefix_of", prefix)
    joined = ranked.join(before, ranked[group].eqNullSafe(before["_group"]) & (ranked["_prefix_of"] == before["_prefix"]))
    return joined.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_prefix_of", "_group", "_prefix", "_before")
