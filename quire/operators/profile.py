"""Column profiling from one value-frequency table.

``value_frequencies`` unpivots the feature columns once and counts
``(column, value)`` pairs — with the label pivoted into per-class count
columns — in a single shuffle that is partially aggregated map-side. Distinct
counts, missingness, min/max, exact medians, category distributions and
histograms are then derived from that compact table without rescanning the
data. Moments (mean, population sd) come from one wide one-row aggregate.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.functions.numeric import numeric_double
from quire.operators.categories import indicator, indicator_name
from quire.operators.cumulative import running_sum
from quire.operators.selection import medians

NUMERIC_TYPES = ("double", "float", "integer", "long", "short", "byte", "decimal")


def to_long(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (),
            column_name: str = "column", value_name: str = "value") -> DataFrame:
    """Unpivot ``cols`` to (id…, column, value double); NaN folds to null."""
    pairs = F.array(*[F.struct(F.lit(c).alias(column_name),
                               numeric_double(quote(c)).alias(value_name)) for c in cols])
    return df.select(*[quote(i) for i in id_cols], F.inline(pairs))


def value_frequencies(df: DataFrame, cols: Sequence[str], label: str | None = None,
                      classes: Sequence[int] = (0, 1)) -> DataFrame:
    """(column, value, n[, n_<class>…]) including the null value per column."""
    ids = [label] if label else []
    long = to_long(df, cols, ids)
    aggs = [F.count(F.lit(1)).alias("n")]
    if label:
        aggs += [F.count_if(quote(label) == F.lit(k)).alias(f"n_{k}") for k in classes]
    return long.groupBy("column", "value").agg(*aggs)


def column_summary(freq: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct non-null values, min, max."""
    return freq.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, missing_fraction) in one wide pass; NaN counts as missing."""
    one = df.select(*[F.avg(numeric_double(quote(c)).isNull().cast("double")
                            if _is_numeric(df, c) else quote(c).isNull().cast("double"))
                      .alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_fraction"))
                      for i, c in enumerate(cols)])
    return one.select(F.inline(pairs))


def _is_numeric(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in NUMERIC_TYPES


def exact_medians(freq: DataFrame, n_columns: int | None = None,
                  num_slices: int | None = None) -> DataFrame:
    """(column, median) — exact, the mean of the two middle values for even counts.

    Works on the frequency table: a distributed running count over
    (column, value) locates the middle ranks without sorting any column in a
    single task.
    """
    nn = freq.where(F.col("value").isNotNull()).select("column", "value", "n")
    cum = running_sum(nn, ["column"], ["value"], ["n"], num_slices=num_slices,
                      max_groups=n_columns)
    totals = nn.groupBy("column").agg(F.sum("n").alias("total"))
    if n_columns is not None:
        totals = F.broadcast(totals)
    j = cum.join(totals, "column")
    k1 = F.floor((F.col("total") + 1) / 2)
    k2 = F.floor(F.col("total") / 2) + 1
    picked = j.groupBy("column").agg(
        F.min(F.when(F.col("cum_n") >= k1, F.col("value"))).alias("v1"),
        F.min(F.when(F.col("cum_n") >= k2, F.col("value"))).alias("v2"),
    )
    return picked.select("column", ((F.col("v1") + F.col("v2")) / 2).alias("median"))


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd_pop) in one wide aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        v = numeric_double(quote(c))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    one = df.select(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                               F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"))
                      for i, c in enumerate(cols)])
    return one.select(F.inline(pairs))


def column_kinds(df: DataFrame, cols: Sequence[str], threshold: int = 10,
                 freq: DataFrame | None = None) -> DataFrame:
    """(column, n_distinct, kind): 'categorical' for text or ≤ threshold distinct values."""
    numeric = [c for c in cols if _is_numeric(df, c)]
    text = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        f = freq if freq is not None else value_frequencies(df, numeric)
        s = column_summary(f).select(
            "column", "n_distinct",
            F.when(F.col("n_distinct") <= threshold, F.lit("categorical"))
            .otherwise(F.lit("numeric")).alias("kind"))
        parts.append(s)
    if text:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), quote(c).alias("value")) for c in text])
        t = (df.select(F.inline(pairs)).groupBy("column")
             .agg(F.count_distinct("value").alias("n_distinct"))
             .select("column", "n_distinct", F.lit("categorical").alias("kind")))
        parts.append(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_column_types(df: DataFrame, cols: Sequence[str], threshold: int = 10,
                        freq: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """Python lists (numeric, categorical) in input order; p rows reach the driver."""
    kinds = {r["column"]: r["kind"] for r in column_kinds(df, cols, threshold, freq).collect()}
    numeric = [c for c in cols if kinds.get(c) == "numeric"]
    categorical = [c for c in cols if kinds.get(c) == "categorical"]
    return numeric, categorical


def non_empty_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at least one non-null value (one wide count pass)."""
    row = df.select(*[F.count(quote(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] > 0]


def drop_all_null_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    keep = set(non_empty_columns(df, cols))
    return df.drop(*[c for c in cols if c not in keep])


def value_counts(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    """(value, n) with nulls kept, largest first."""
    return (df.groupBy(quote(col).alias(name)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last(name)))


def columns_over_missing(df: DataFrame, cols: Sequence[str], max_fraction: float) -> list[str]:
    """Names whose missing fraction exceeds ``max_fraction`` (p rows to the driver)."""
    return [r["column"] for r in missingness(df, cols).collect()
            if r["missing_fraction"] > max_fraction]


def drop_sparse_columns(df: DataFrame, cols: Sequence[str], max_fraction: float = 0.65) -> DataFrame:
    return df.drop(*columns_over_missing(df, cols, max_fraction))


def table_summary(tables: dict[str, DataFrame], key: str | None = None,
                  high_missing: float = 0.5) -> DataFrame:
    """Per table: rows, columns, cell-missing %, columns with ≥ 50 % missing.

    One wide aggregate per table (row count and per-column missing fraction
    together), finished with array expressions on the single result row.
    """
    parts = []
    for name, df in tables.items():
        cols = [c for c in df.columns if c != key]
        fr = [F.avg((numeric_double(quote(c)) if _is_numeric(df, c) else quote(c))
                    .isNull().cast("double")) for c in cols]
        one = df.select(F.count(F.lit(1)).alias("n_rows"), F.array(*fr).alias("fr"))
        parts.append(one.select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(cols)).alias("n_cols"),
            F.round(F.aggregate("fr", F.lit(0.0), lambda a, x: a + x) / F.lit(len(cols)) * 100, 6)
            .alias("cell_missing_pct"),
            F.size(F.filter("fr", lambda x: x >= high_missing)).cast("bigint").alias("n_high_missing")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_modes(freq: DataFrame) -> DataFrame:
    """(column, mode): the most frequent non-null value; ties → the smallest value."""
    nn = freq.where(F.col("value").isNotNull())
    return nn.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))


def impute_most_frequent(df: DataFrame, cols: Sequence[str], modes: dict) -> DataFrame:
    """Fill nulls with the fitted modes, numbers or text (a projection)."""
    def filled(c, mode):
        return F.coalesce(quote(c).cast("string"), F.lit(mode)) if isinstance(mode, str) else F.coalesce(numeric_double(quote(c)), F.lit(float(mode)))

    repl = {c: filled(c, modes[c]).alias(c) for c in cols if modes.get(c) is not None}
    return df.select(*[repl.get(c, quote(c)) for c in df.columns])


def one_hot(df: DataFrame, fitted: dict, drop_source: bool = True) -> DataFrame:
    """Indicator columns ``<col>=<value>`` for the fitted lists of values, numbers or text; an unseen value has none set."""
    extra = [indicator(c, v).alias(indicator_name(c, v)) for c, vals in fitted.items() for v in vals]
    keep = [quote(c) for c in df.columns if not (drop_source and c in fitted)]
    return df.select(*keep, *extra)


# A column can only hold ≤ threshold distinct values if its HyperLogLog estimate
# is at most this multiple of the threshold: at ≤ 10 values the estimate
# (linear counting on 512 registers) is within a few percent, never near 3×.
# A too-generous estimate only sends a column through the exact path.
CANDIDATE_FACTOR = 3


def column_profile(df: DataFrame, cols: Sequence[str], label: str | None = None,
                   classes: Sequence[int] = (0, 1)) -> dict[str, dict]:
    """One wide aggregate → per column: approx distinct, min, max, non-null count
    (overall and per class). p rows of statistics reach the driver."""
    aggs = []
    for i, c in enumerate(cols):
        v = numeric_double(quote(c))
        aggs += [F.approx_count_distinct(v).alias(f"a{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}"), F.count(v).alias(f"n{i}")]
        if label:
            aggs += [F.count_if(v.isNotNull() & (quote(label) == F.lit(k))).alias(f"n{i}_{k}") for k in classes]
    row = df.select(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        d = {"approx_distinct": row[f"a{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "n": row[f"n{i}"]}
        if label:
            d.update({f"n_{k}": row[f"n{i}_{k}"] for k in classes})
        out[c] = d
    return out


def low_cardinality_candidates(profile: dict[str, dict], threshold: int) -> list[str]:
    bound = max(CANDIDATE_FACTOR * threshold, threshold + 20)
    return [c for c, d in profile.items() if d["n"] > 0 and d["approx_distinct"] <= bound]


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the columns, by refined histograms (see ``selection``)."""
    return medians(df, list(cols))
