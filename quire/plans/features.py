"""Declarative feature specifications → one projection per table.

A ``FeatureSpec`` names an output feature, the header fragments that locate its
source column(s) and the coder that turns raw answers into a double. A table's
specs compile to a single ``select`` (Catalyst prunes every other column from
the scan). Specs whose source column is missing either yield an all-null
feature (``required``) or no feature at all (``optional``).
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import coders
from quire.functions.columns import find_column, find_numeric_column, quote
from quire.functions.numeric import lenient_double, row_sum_min_count


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    fragments: tuple = ()
    coder: str = "numeric"
    optional: bool = False
    items: tuple = ()            # for row_sum / either: tuples of fragments
    pattern: str | None = None   # for flag
    fallback: tuple = ()         # for fallback_div: fragments of the total column
    divisor: float = 1.0


def _numeric(df: DataFrame, name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("double")
    if df.schema[name].dataType.typeName() == "string":
        return lenient_double(quote(name))
    d = quote(name).cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


CODERS = {
    "yes_no": coders.yes_no,
    "sex": coders.sex_male,
    "laterality": coders.laterality,
    "three_level": coders.three_level_response,
    "cognitive": coders.cognitive_status,
    "paren_number": coders.number_in_parentheses,
    "first_number": coders.first_number,
}


def compile_spec(df: DataFrame, spec: FeatureSpec) -> Column | None:
    cols = df.columns
    if spec.coder == "numeric":
        src = find_column(cols, *spec.fragments)
        if src is None and spec.optional:
            return None
        return _numeric(df, src).alias(spec.name)
    if spec.coder == "numeric_typed":
        src = find_numeric_column(df, spec.fragments[0])
        return _numeric(df, src).alias(spec.name)
    if spec.coder == "administered":
        src = None
        for frag in coders.ADMINISTERED_FRAGMENTS:
            src = find_column(cols, *frag)
            if src is not None:
                break
        return coders.administered_flag(quote(src) if src else None).alias(spec.name)
    if spec.coder == "flag":
        src = find_column(cols, *spec.fragments)
        if src is None:
            return None if spec.optional else F.lit(None).cast("double").alias(spec.name)
        return F.lower(F.coalesce(quote(src).cast("string"), F.lit(""))).rlike(spec.pattern) \
            .cast("double").alias(spec.name)
    if spec.coder == "row_sum":
        items = [_numeric(df, find_column(cols, *frag)) for frag in spec.items]
        return row_sum_min_count(items).alias(spec.name)
    if spec.coder == "either":
        srcs = [find_column(cols, *frag) for frag in spec.items]
        if all(s is None for s in srcs):
            return None
        flags = [coders.yes_no(quote(s)) if s else None for s in srcs]
        return coders.either_flag(flags[0], flags[1] if len(flags) > 1 else None).alias(spec.name)
    if spec.coder == "fallback_div":
        src = find_column(cols, *spec.fragments)
        if src is not None:
            return _numeric(df, src).alias(spec.name)
        return (_numeric(df, find_column(cols, *spec.fallback)) / F.lit(spec.divisor)).alias(spec.name)
    if spec.coder == "word_count":
        src = find_column(cols, *spec.fragments)
        if src is None:
            return None
        return F.size(F.regexp_extract_all(F.coalesce(quote(src), F.lit("")), F.lit(r"\S+"), 0)) \
            .cast("double").alias(spec.name)
    if spec.coder == "line_count":
        src = find_column(cols, *spec.fragments)
        if src is None:
            return None
        return F.size(F.split(F.coalesce(quote(src), F.lit("")), "\n")).cast("double").alias(spec.name)
    coder = CODERS.get(spec.coder)
    if coder is None:
        raise ValueError(f"unknown coder {spec.coder!r}")
    src = find_column(cols, *spec.fragments)
    if src is None:
        return None if spec.optional else F.lit(None).cast("double").alias(spec.name)
    return coder(quote(src)).alias(spec.name)


def extract(df: DataFrame, specs: Sequence[FeatureSpec], key: str) -> DataFrame:
    """One projection: key + every compiled feature (optional ones only if resolvable)."""
    cols = [c for c in (compile_spec(df, s) for s in specs) if c is not None]
    return df.select(quote(key), *cols)


@dataclass
class Instrument:
    """A keyed source table and the specs extracted from it."""
    name: str
    specs: list = field(default_factory=list)
