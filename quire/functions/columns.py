"""Column resolution by header fragments.

Wide instrument tables carry long, bilingual headers; features are located by
case-insensitive substring match. All of it is schema metadata: plain Python
over ``df.columns``, no Spark job.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(name: str) -> Column:
    """Reference a column whose name may contain dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(columns: Sequence[str] | DataFrame, *fragments: str) -> str | None:
    """First column, in schema order, whose lower-cased name holds ALL fragments."""
    names = columns.columns if isinstance(columns, DataFrame) else list(columns)
    wanted = [f.lower() for f in fragments]
    for name in names:
        low = name.lower()
        if all(w in low for w in wanted):
            return name
    return None


def find_case_sensitive(columns: Sequence[str] | DataFrame, *fragments: str) -> str | None:
    """Like :func:`find_column` but matching case exactly (label column lookup)."""
    names = columns.columns if isinstance(columns, DataFrame) else list(columns)
    for name in names:
        if all(f in name for f in fragments):
            return name
    return None


def find_numeric_column(df: DataFrame, fragment: str) -> str | None:
    """First column containing ``fragment`` whose values are all numeric.

    Schema-typed numeric columns are accepted directly. String columns are
    accepted when no non-null value fails a numeric parse; that check is one
    distributed ``count_if`` (a single aggregate job, no data to the driver).
    """
    from quire.functions.numeric import NUMERIC_PATTERN

    frag = fragment.lower()
    for field in df.schema.fields:
        if frag not in field.name.lower():
            continue
        if field.dataType.typeName() in ("double", "float", "integer", "long", "short",
                                         "byte", "decimal"):
            return field.name
        if field.dataType.typeName() == "string":
            c = F.trim(quote(field.name))
            bad = df.select(F.count_if(c.isNotNull() & (c != "") & ~c.rlike(NUMERIC_PATTERN))
                            .alias("bad")).first()["bad"]
            if bad == 0:
                return field.name
    return None


def present_columns(selected: Iterable[str], columns: Sequence[str] | DataFrame) -> list[str]:
    """Keep the selected names that are still present, in selection order."""
    names = set(columns.columns if isinstance(columns, DataFrame) else columns)
    return [c for c in selected if c in names]


def unique_names(names: Iterable[str]) -> list[str]:
    """Ordered de-duplication: first occurrence wins."""
    seen: set[str] = set()
    out = []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


def columns_with_prefix(columns: Sequence[str] | DataFrame, *prefixes: str) -> list[str]:
    names = columns.columns if isinstance(columns, DataFrame) else list(columns)
    return [c for c in names if any(c.startswith(p) for p in prefixes)]


def normalise_header(name: str) -> str:
    """snake_case a free-text header: lower, non-alphanumerics to '_', trimmed."""
    s = re.sub(r"[^0-9a-z]+", "_", name.lower())
    return s.strip("_")


def normalise_header_expr(c: Column) -> Column:
    """The same normalisation as a Column expression (for header tables)."""
    s = F.regexp_replace(F.lower(c), r"[^0-9a-z]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def leakage_columns(columns: Sequence[str] | DataFrame, words: Sequence[str]) -> list[str]:
    """Headers that hold one of the words (whole words, any case): diagnosis details that would give the label away."""
    names = columns.columns if isinstance(columns, DataFrame) else list(columns)
    wanted = {w.lower() for w in words}
    return [c for c in names if wanted & set(re.findall(r"[0-9a-z]+", c.lower()))]
