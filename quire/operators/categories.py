"""Values of text columns: counts, codes, modes and indicators.

One dictionary table (column, value, n) holds the distinct values of all text columns, counted
with partial sums before the shuffle; codes are the values' ranks. Nothing but a checked number of categories
reaches the driver: methods that make one column of each value (indicators, FAMD, MCA, CATPCA) refuse
more than ``MAX_CATEGORIES``, everything else stays a table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.cumulative import global_row_number

MAX_CATEGORIES = 20_000
UNSEEN = -1


def text_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that are always categorical: text and booleans."""
    return [c for c in cols if df.schema[c].dataType.typeName() in ("string", "char", "varchar", "boolean")]


def _text(c: str) -> Column:
    return quote(c).cast("string")


def text_counts(df: DataFrame, cols: Sequence[str], label: str | None = None, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """(column, value, n[, n_<class>…]) of the non-null values of text columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in cols])
    long = df.select(*[quote(label)] if label else [], F.inline(pairs)).where(F.col("value").isNotNull())
    per_class = [F.count_if(quote(label) == F.lit(k)).alias(f"n_{k}") for k in classes] if label else []
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *per_class)


def value_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code, n): the code is the value's rank in its column, from 0."""
    ranked = global_row_number(text_counts(df, cols), ["column"], ["value"], name="_rank", max_groups=len(cols))
    return ranked.select("column", "value", (F.col("_rank") - 1).alias("code"), "n")


def encode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as codes; a value that the dictionary lacks is ``UNSEEN``, null stays null."""
    out = df
    for i, c in enumerate(cols):
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(own, _text(c) == F.col(f"_v{i}"), "left")
    codes = {c: F.when(quote(c).isNotNull(), F.coalesce(F.col(f"_c{i}"), F.lit(UNSEEN))).alias(c) for i, c in enumerate(cols)}
    return out.select(*[codes.get(c, quote(c)) for c in df.columns])


def text_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each text column, ties to the smallest (one row a column reaches the driver)."""
    counts = text_counts(df, cols)
    modes = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("less"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in modes.collect()}


def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """The sorted (value, count) list of each text column; an error above ``MAX_CATEGORIES`` in all."""
    if not cols:
        return {}
    counts = text_counts(df, cols)
    rows = counts.limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in {list(cols)}: encode() and hellinger_scores() take any number")
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append((r["value"], r["n"]))
    return {c: sorted(v) for c, v in out.items()}


def indicator(column: str, value) -> Column:
    """1.0 where the column has the value, 0.0 elsewhere (null included)."""
    same = _text(column) == F.lit(value) if isinstance(value, str) else quote(column).cast("double") == F.lit(float(value))
    return F.coalesce(same.cast("double"), F.lit(0.0))


def indicator_name(column: str, value) -> str:
    return f"{column}={value}" if isinstance(value, str) else f"{column}={value:g}"
