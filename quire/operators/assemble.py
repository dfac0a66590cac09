"""Multi-way left assembly of keyed feature tables onto a labelled cohort.

Each feature table holds at most one row per key (see ``first_per_key``).
Only columns not yet present are joined ("new columns only"): a table that
adds nothing is not joined at all. With ``on_conflict="coalesce"`` a table
whose columns already exist fills the gaps per row instead (disjoint cohorts
of one instrument).

All joins are equi-joins on the one key. Deduplicated tables come out of a
hash aggregate on that key, so with equal partition counts the chain of
sort-merge joins shares one partitioning and adds no further exchanges; AQE
turns a join into a broadcast only from measured runtime sizes.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote


def assemble(cohort: DataFrame, tables: Sequence[DataFrame], key: str,
             on_conflict: str = "first_table") -> DataFrame:
    if on_conflict not in ("first_table", "coalesce"):
        raise ValueError("on_conflict must be 'first_table' or 'coalesce'")
    master = cohort.where(quote(key).isNotNull())
    for t in tables:
        if t is None or key not in t.columns:
            continue
        t = t.where(quote(key).isNotNull())
        new = [c for c in t.columns if c != key and c not in master.columns]
        clash = [c for c in t.columns if c != key and c in master.columns]
        if on_conflict == "coalesce" and clash:
            side = t.select(quote(key), *[quote(c).alias(f"__r_{i}") for i, c in enumerate(clash)],
                            *[quote(c) for c in new])
            joined = master.join(side, key, "left")
            repl = {c: F.coalesce(quote(c), F.col(f"__r_{i}")).alias(c) for i, c in enumerate(clash)}
            master = joined.select(*[repl.get(c, quote(c)) for c in master.columns],
                                   *[quote(c) for c in new])
        elif new:
            master = master.join(t.select(quote(key), *[quote(c) for c in new]), key, "left")
    return master
