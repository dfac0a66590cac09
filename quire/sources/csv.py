"""Keyed CSV scan (one instrument table per file).

Semantics reproduced: a missing file yields no table; every column is read as
text; the key header is renamed; tokens that a pandas reader treats as missing
become null; duplicate headers are de-duplicated as ``name``, ``name.1``, …;
rows keep an explicit file-order column; rows with a null key are dropped
(Spark equality never matches null keys); one row per key survives — the first
in file order.
"""
from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.columns import quote

ORDER_COL = "_row_order"

# The default missing-value tokens of a pandas CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop filesystem of the session."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def pandas_style_names(header: list[str | None]) -> list[str]:
    """Duplicate headers become ``name``, ``name.1``, ``name.2`` (first keeps the name).

    Spark resolves names in any case, so headers that differ in case alone count as duplicates too.
    """
    taken: set[str] = set()
    out = []
    for i, h in enumerate(header):
        name = first = h if h not in (None, "") else f"Unnamed: {i}"
        k = 0
        while name.lower() in taken:
            k += 1
            name = f"{first}.{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_keyed_csv(spark: SparkSession, path: str, key_header: str = "Project key",
                   key: str = "project_key", dedupe: bool = True,
                   multi_line: bool = True) -> DataFrame | None:
    """Scan one CSV table keyed by ``key_header``; ``None`` when the file is absent.

    ``multi_line`` allows quoted newlines but makes the file one split; for
    large exports without embedded newlines pass ``False`` (the file is then
    split across tasks; its first split still starts with the header), or
    convert the export to Parquet once and extract from that DataFrame.
    """
    if not path_exists(spark, path):
        return None
    raw = (spark.read.option("header", "false").option("multiLine", str(multi_line).lower())
           .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    raw = raw.withColumn(ORDER_COL, F.monotonically_increasing_id())
    # a multi-line CSV file is one split, so its first record (the header) has order id 0;
    # a filter finds it without sorting the table
    header_row = raw.where(F.col(ORDER_COL) == 0).first()
    if header_row is None:
        return None
    header = [header_row[c] for c in raw.columns if c != ORDER_COL]
    names = pandas_style_names(header)
    body = raw.where(F.col(ORDER_COL) != header_row[ORDER_COL])
    cols = []
    for src, name in zip([c for c in raw.columns if c != ORDER_COL], names):
        v = F.col(src)
        v = F.when(v.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(v)
        cols.append(v.alias(key if name == key_header else name))
    df = body.select(*cols, F.col(ORDER_COL))
    if key not in df.columns:
        return df
    df = df.where(quote(key).isNotNull())
    if dedupe:
        from quire.operators.dedupe import first_per_key
        df = first_per_key(df, [key], ORDER_COL)
    return df


def _resolved(path: str) -> str:
    """A local path without links; a path of another store as it is."""
    local = re.sub(r"^file:/+", "/", path)
    return os.path.realpath(local) if local.startswith("/") else path


def csv_inventory(spark: SparkSession, roots: list[str], pattern: str = "*.csv") -> DataFrame:
    """One row per distinct CSV file: file name, path, n_rows (records), n_cols (header width).

    Files under several roots are listed (``binaryFile`` metadata, no content)
    and de-duplicated by resolved path. Header widths come from one text scan
    (first line of each file, fields counted outside quotes); record counts
    from one CSV parse grouped by ``input_file_name``. No per-file job.
    """
    schema = "file string, path string, n_rows bigint, n_cols int"
    globs = [root.rstrip("/") + "/" + pattern for root in roots if path_exists(spark, root)]
    if not globs:
        return spark.createDataFrame([], schema)
    listing = spark.read.format("binaryFile").load(globs).select("path")
    # the listing is file metadata (one row per file), not table data
    files = sorted({_resolved(r["path"]) for r in listing.collect()})
    if not files:
        return spark.createDataFrame([], schema)
    norm = F.regexp_replace(F.input_file_name(), "^file:/+", "/")
    lines = spark.read.text(files).select(norm.alias("path"), F.monotonically_increasing_id().alias("_o"),
                                           F.col("value"))
    first = lines.groupBy("path").agg(F.min(F.struct("_o", "value")).alias("_h"))
    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    widths = first.select("path", F.size(F.split(F.col("_h.value"), outside_quotes)).alias("n_cols"))
    counts = (spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
              .csv(files).groupBy(norm.alias("path")).agg(F.count(F.lit(1)).alias("n_rows")))
    return (widths.join(counts, "path", "left")
            .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path",
                    F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                    F.col("n_cols").cast("int").alias("n_cols")))
