"""Writers for split frames, result tables and JSON summaries.

Outputs are partitioned folders (``method=…/split=…``) written by the
executors; nothing is collected to the driver. Key and label come first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote


def write_split(frames: dict[str, DataFrame], path: str, method: str, key: str, label: str,
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """frames: split name (train, test, train_reduced, …) → frame; one partitioned write each."""
    for split, df in frames.items():
        feats = [c for c in df.columns if c not in (key, label)]
        out = df.select(quote(key), quote(label).alias("label"), *[quote(c) for c in feats])
        (out.write.mode(mode).format(fmt).option("header", "true")
         .save(f"{path.rstrip('/')}/method={method}/split={split}"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_json_record(df: DataFrame, path: str, stringify: list[str] | None = None,
                      mode: str = "overwrite") -> None:
    """One JSON document per row; ``stringify`` columns are written as their string form."""
    cols = [F.to_json(quote(c)).alias(c) if c in (stringify or []) else quote(c) for c in df.columns]
    df.select(*cols).write.mode(mode).json(path)
