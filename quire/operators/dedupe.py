"""First row per key (distinct-on)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote


def first_per_key(df: DataFrame, keys: Sequence[str], order_col: str | Sequence[str]) -> DataFrame:
    """Keep the row with the smallest ``order_col`` for every key.

    Expressed as ``min(struct(order, row…))`` per key rather than a
    ``row_number`` window: the aggregate is partially evaluated map-side, so a
    key holding a third of all rows is reduced before the shuffle instead of
    being sorted in one task. Null keys form one group (as in pandas).
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    others = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[quote(o).alias(f"o{j}") for j, o in enumerate(order)],
                      *[quote(c).alias(f"c{i}") for i, c in enumerate(others)])
    agg = df.groupBy(*[quote(k) for k in keys]).agg(F.min(packed).alias("_first"))
    return agg.select(*[quote(k) for k in keys],
                      *[F.col("_first")[f"c{i}"].alias(c) for i, c in enumerate(others)],
                      *[F.col("_first")[f"o{j}"].alias(o) for j, o in enumerate(order)])
