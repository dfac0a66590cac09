"""Ordered target statistics of categories.

Rows are put in a random but fixed order (a seeded hash of the key). A row's statistic is the smoothed label mean of the rows
of its category that come before it, so no row sees its own label. The running sums are taken in two phases: within
(category, hash prefix), and over the prefixes of a category, of which there are at most 4096, so a category with
most rows is spread over many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.split import hash_order

PREFIX = 3


def ordered_target_means(df: DataFrame, columns: Sequence[str], label: str, key: str, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """Adds ``<column>_target``: (sum of earlier labels + weight * overall mean) / (earlier rows + weight).

    Null categories are a category of their own; rows with a null label have a statistic but add to none.
    """
    prior = df.agg(F.avg(quote(label).cast("double"))).first()[0] or 0.0
    out = df.withColumn("_h", hash_order(key, seed, salt="order")).withColumn("_p", F.substring("_h", 1, PREFIX)) \
        .withColumn("_y", quote(label).cast("double"))
    for c in columns:
        n, y = F.count("_y"), F.coalesce(F.sum("_y"), F.lit(0.0))
        parts = out.groupBy(quote(c).alias("_c"), F.col("_p").alias("_q")).agg(n.alias("_pn"), y.alias("_py"))
        earlier = Window.partitionBy("_c").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.select("_c", "_q", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}b") for x in ("_pn", "_py")])
        own = Window.partitionBy(quote(c), "_p").orderBy("_h", quote(key)).rowsBetween(Window.unboundedPreceding, -1)
        local = out.withColumn("_on", F.count("_y").over(own)).withColumn("_oy", F.coalesce(F.sum("_y").over(own), F.lit(0.0)))
        joined = local.join(before, local[c].eqNullSafe(before["_c"]) & (local["_p"] == before["_q"]))
        stat = (F.col("_oy") + F.col("_pyb") + weight * prior) / (F.col("_on") + F.col("_pnb") + weight)
        out = joined.withColumn(f"{c}_target", stat).drop("_on", "_oy", "_c", "_q", "_pnb", "_pyb")
    return out.drop("_h", "_p", "_y")
