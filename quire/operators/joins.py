"""Joins whose few hot keys stay where they are."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1 / HOT_KEYS of all rows: there are fewer than this, so their side can be broadcast.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a table of one row for each key that counts the key's rows in ``n``.

    Hot keys are broadcast; all others meet in a shuffle join, where none of them can fill a task.
    """
    most, total = table.agg(F.max(n), F.sum(n)).first()
    if not total or most * HOT_KEYS <= total:
        return rows.join(table, key)
    limit = total / HOT_KEYS
    hot = F.broadcast(table.where(F.col(n) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= limit), key)
    return rows.join(hot, key).unionByName(cold)


def apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` whole numbers that a shuffle by their hash spreads evenly over its partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = spark.range(32 * max(n, parts)).select(F.col("id").cast("int").alias("id"))
    turn = F.row_number().over(Window.partitionBy("p").orderBy("id"))
    rows = ids.withColumn("p", F.pmod(F.hash("id"), F.lit(parts))).select("id", turn.alias("turn"), "p").orderBy("turn", "p").limit(n)
    return [r["id"] for r in rows.collect()]
