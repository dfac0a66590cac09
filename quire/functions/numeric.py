"""Numeric Column helpers: lenient parsing, scaling, safe ratios, row sums."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number, optionally signed, with optional exponent; what a
# lenient "to number, errors → missing" parse accepts. Spark's own cast also
# accepts suffixes such as '1d', which must count as missing here.
NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"


def lenient_double(c: Column | None) -> Column:
    """Parse to double; anything unparsable, NaN or absent → null.

    Numeric input is cast directly. String input is trimmed and checked
    against :data:`NUMERIC_PATTERN` before ``try_cast``.
    """
    if c is None:
        return F.lit(None).cast("double")
    s = F.trim(c.cast("string"))
    parsed = F.when(F.lower(s).rlike(NUMERIC_PATTERN), s.try_cast("double"))
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def numeric_double(c: Column) -> Column:
    """Cast a typed numeric column to double, folding NaN to null."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def min_max_scale(c: Column, lo: Column, hi: Column) -> Column:
    """(x − lo)/(hi − lo); a constant column divides by 1."""
    return (c - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))


def z_score(c: Column, mean: Column, sd: Column) -> Column:
    """(x − mean)/sd with population sd; sd 0 or null → divide by 1."""
    return (c - mean) / F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den if den > 0 else 0.0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def row_sum_min_count(cols: Sequence[Column]) -> Column:
    """Row-wise sum of the items; null only when every item is null."""
    if not cols:
        return F.lit(None).cast("double")
    total = None
    for c in cols:
        term = F.coalesce(c, F.lit(0.0))
        total = term if total is None else total + term
    return F.when(F.coalesce(*cols).isNotNull(), total)


def any_not_null(cols: Sequence[Column]) -> Column:
    return F.coalesce(*cols).isNotNull() if cols else F.lit(False)


def nan_to_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def hellinger_from_sums(sq_diff_sum: Column) -> Column:
    """(1/√2)·√Σ(√p − √q)² from the summed squared differences."""
    return F.sqrt(sq_diff_sum) / F.sqrt(F.lit(2.0))
