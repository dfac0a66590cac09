"""Class weights for imbalanced labels."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import quote


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight = n / (k · n_c), k = number of classes present."""
    c = df.groupBy(quote(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()          # one row per class: a global window is tiny
    total = F.sum("n").over(everything)
    k = F.count(F.lit(1)).over(everything)
    return c.select(label, (total.cast("double") / (k * F.col("n"))).alias("weight"))


def class_weight_ratio(df: DataFrame, label: str, negative=0, positive=1) -> DataFrame:
    """One row: ratio = n_negative / max(n_positive, 1) (positive-class weight)."""
    y = quote(label)
    return df.agg((F.count_if(y == negative).cast("double") /
                   F.greatest(F.count_if(y == positive), F.lit(1))).alias("ratio"))


def with_weight_column(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (the class table is tiny: broadcast)."""
    w = balanced_weights(df, label).withColumnRenamed("weight", name)
    return df.join(F.broadcast(w), label, "left")
