"""Distributed running sums over a global order.

A running sum over ``ORDER BY`` with few (or no) ``PARTITION BY`` groups runs in
one task per group when written as a plain window. Here it is split in two
phases so no group is ever gathered into one task:

1. range-partition by (group…, order…) into ``n`` slices;
2. per slice and group: local inclusive running sum (window over (slice, group),
   bounded by the slice size) and the slice total;
3. exclusive prefix of slice totals per group (at most ``n`` rows per group);
4. global running sum = slice offset + local running sum.

Steps 2 and 3 must see identical slices. Two executions of a range exchange
sample their bounds independently (and column pruning keeps Spark from
reusing one exchange for both branches), so the slice assignment is
materialised once with a reliable checkpoint in the session's checkpoint
folder: both branches read the same files, lost executors cannot change the
assignment, and the lineage is cut. The offsets table has at most
``n + groups`` rows and is broadcast only under that bound.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PID = "_slice"
BROADCAST_ROW_LIMIT = 2_000_000


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                sum_cols: Sequence[str], num_slices: int | None = None,
                max_groups: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``{prefix}{c}`` = inclusive running sum of ``c`` within each group.

    ``order_cols`` must make the order total (add a unique tie-breaker), as
    with any running sum over rows. ``max_groups`` is an optional proven bound
    on the number of groups; without it the offsets table is counted first.
    """
    spark = df.sparkSession
    n = num_slices or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [_as_col(c) for c in order_cols]
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, *[F.col(g) for g in group_cols], *order) \
        .withColumn(PID, F.spark_partition_id()).checkpoint(eager=True)
    local_w = (Window.partitionBy(PID, *group_cols).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(c).over(local_w).alias(f"_loc_{c}") for c in sum_cols])
    totals = ranged.groupBy(PID, *group_cols).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    off_w = (Window.partitionBy(*group_cols).orderBy(PID)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(PID, *group_cols,
                            *[F.coalesce(F.sum(f"_tot_{c}").over(off_w), F.lit(0))
                              .alias(f"_off_{c}") for c in sum_cols])
    # Broadcast only under a checked bound: a caller-proven group bound, or
    # else the measured size of the (checkpoint-backed, cheap) totals table.
    if max_groups is not None:
        rows_bound = n + max_groups
    else:
        rows_bound = totals.count()
    if rows_bound <= BROADCAST_ROW_LIMIT:
        offsets = F.broadcast(offsets)
    cond = [local[PID] == offsets[PID]] + [local[g].eqNullSafe(offsets[g]) for g in group_cols]
    joined = local.join(offsets, cond, "inner")
    out_cols = [local[c] for c in df.columns]
    return joined.select(*out_cols, *[(local[f"_loc_{c}"] + offsets[f"_off_{c}"]).alias(f"{prefix}{c}")
                                      for c in sum_cols])


def global_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                      name: str = "rn", num_slices: int | None = None,
                      max_groups: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without a one-task group."""
    one = "_one"
    out = running_sum(df.withColumn(one, F.lit(1).cast("long")), group_cols, order_cols,
                      [one], num_slices=num_slices, max_groups=max_groups, prefix="_cum")
    return out.withColumnRenamed(f"_cum{one}", name).drop(one)
