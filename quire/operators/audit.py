"""Data-quality audits: feature families, imputation effect, scaling sanity,
variance tables, row-aligned comparison, header collisions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import columns_with_prefix, normalise_header_expr, quote
from quire.functions.numeric import any_not_null


def feature_audit(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """(family, n_features, rows_with_data): one aggregate over all families."""
    aggs, meta = [], []
    for i, (fam, prefixes) in enumerate(families.items()):
        cols = columns_with_prefix(df, *prefixes)
        meta.append((fam, len(cols)))
        aggs.append(F.count_if(any_not_null([quote(c) for c in cols])).alias(f"f{i}") if cols
                    else F.lit(0).cast("bigint").alias(f"f{i}"))
    one = df.select(*aggs)
    arr = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).cast("bigint").alias("n_features"),
                             F.col(f"f{i}").cast("bigint").alias("rows_with_data"))
                    for i, (f, n) in enumerate(meta)])
    return one.select(F.inline(arr))


def imputed_cells(before: DataFrame, after: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(column, n_imputed): cells null before and not null after, rows aligned by key."""
    b = before.select(quote(key), *[quote(c).alias(f"b{i}") for i, c in enumerate(cols)])
    a = after.select(quote(key), *[quote(c).alias(f"a{i}") for i, c in enumerate(cols)])
    j = b.join(a, key)
    one = j.select(*[F.count_if(F.col(f"b{i}").isNull() & F.col(f"a{i}").isNotNull()).alias(f"n{i}")
                     for i in range(len(cols))])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("bigint").alias("n_imputed"))
                    for i, c in enumerate(cols)])
    return one.select(F.inline(arr))


def scaling_sanity(df: DataFrame, cols: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """(column, mean, sd, centred, unit_sd) with population sd."""
    from quire.operators.profile import moments
    m = moments(df, cols)
    return m.select("column", "mean", "sd", (F.abs("mean") < tol).alias("centred"),
                    (F.abs(F.col("sd") - 1) < tol).alias("unit_sd"))


def cumulative_variance(ratios: DataFrame, order_col: str, ratio_col: str,
                        target: float = 0.85) -> DataFrame:
    """Scree table: running sum of ratios in order, and the first k reaching ``target``.

    The table has one row per component (bounded by the feature count).
    """
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = ratios.withColumn("k", F.row_number().over(Window.orderBy(order_col)).cast("bigint")) \
        .withColumn("cumulative", F.sum(ratio_col).over(w))
    chosen = F.min(F.when(F.col("cumulative") >= target, F.col("k"))).over(Window.partitionBy())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return t.withColumn("chosen_k", F.coalesce(chosen, n).cast("bigint"))


def compare_frames(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str],
                   rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """(column, n_rows, n_only_left, n_only_right, n_mismatch) after a full outer join on key.

    Two values agree when both are null or |a − b| ≤ atol + rtol·|b|.
    """
    la = a.select(quote(key), F.lit(True).alias("_l"), *[quote(c).alias(f"a{i}") for i, c in enumerate(cols)])
    rb = b.select(quote(key), F.lit(True).alias("_r"), *[quote(c).alias(f"b{i}") for i, c in enumerate(cols)])
    j = la.join(rb, key, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("_r").isNull()).alias("ol"),
            F.count_if(F.col("_l").isNull()).alias("or")]
    for i in range(len(cols)):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        close = (x.isNull() & y.isNull()) | (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))
        aggs.append(F.count_if(both & ~F.coalesce(close, F.lit(False))).alias(f"m{i}"))
    one = j.select(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("bigint").alias("n_mismatch"))
                    for i, c in enumerate(cols)])
    return one.select(F.col("n").cast("bigint").alias("n_rows"), F.col("ol").cast("bigint").alias("n_only_left"),
                      F.col("or").cast("bigint").alias("n_only_right"), F.inline(arr))


def header_collisions(headers: DataFrame, table_col: str, header_col: str) -> DataFrame:
    """(table, normalised, n): normalised headers that occur more than once in a table."""
    n = normalise_header_expr(quote(header_col))
    return (headers.groupBy(quote(table_col).alias(table_col), n.alias("normalised"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def prefixed_names(headers: DataFrame, table_col: str, header_col: str, order_col: str) -> DataFrame:
    """``<table>__<normalised>`` with ``__dup2``, ``__dup3``… on clashes, in header order."""
    n = normalise_header_expr(quote(header_col))
    base = F.concat_ws("__", quote(table_col), n)
    w = Window.partitionBy(quote(table_col), n).orderBy(quote(order_col))
    rn = F.row_number().over(w)
    return headers.select(quote(table_col).alias(table_col), quote(header_col).alias(header_col),
                          quote(order_col).alias(order_col),
                          F.when(rn == 1, base).otherwise(F.concat(base, F.lit("__dup"), rn.cast("string")))
                          .alias("feature_name"))


def row_documents(df: DataFrame, key: str, cols: Sequence[str], name: str = "document") -> DataFrame:
    """(key, 'c1=v1 c2=v2 …') over the non-null values of each row."""
    parts = [F.when(quote(c).isNotNull(), F.concat(F.lit(f"{c}="), quote(c).cast("string"))) for c in cols]
    return df.select(quote(key), F.concat_ws(" ", *parts).alias(name))
