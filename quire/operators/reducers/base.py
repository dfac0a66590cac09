"""Shared pieces of the reducers."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.categories import categories, indicator, indicator_name, text_columns
from quire.operators.linalg import project
from quire.operators.profile import value_frequencies


@dataclass
class ProjectionModel:
    """scores = ((inputs − centre) / scale) · weights, named ``prefix_01…``."""
    inputs: list  # list of (kind, payload) describing each input expression
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    names: list[str]
    explained_variance_ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def input_exprs(self, df: DataFrame) -> list[Column]:
        out = []
        for kind, payload in self.inputs:
            if kind == "col":
                out.append(quote(payload).cast("double"))
            elif kind == "dummy":
                out.append(indicator(*payload))
            elif kind == "quant":
                c, mapping = payload
                text = any(isinstance(k, str) for k in mapping)
                m = F.create_map(*[x for k, q in mapping.items() for x in (F.lit(k if text else float(k)), F.lit(float(q)))])
                out.append(F.coalesce(m[quote(c).cast("string" if text else "double")], F.lit(0.0)))
            else:
                raise ValueError(kind)
        return out

    def input_names(self) -> list[str]:
        return [indicator_name(*payload) if kind == "dummy" else payload if kind == "col" else payload[0] for kind, payload in self.inputs]

    def matrix(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The centred and scaled inputs that are projected, one column each."""
        cols = [((F.coalesce(x, F.lit(0.0)) - F.lit(float(c))) / F.lit(float(s))).alias(n) for x, c, s, n in zip(
            self.input_exprs(df), self.centre, self.scale, self.input_names())]
        return df.select(*[quote(k) for k in keep], *cols)

    def outputs(self, df: DataFrame) -> dict[str, Column]:
        """The scores as named expressions over ``df``."""
        return dict(zip(self.names, project(self.input_exprs(df), self.weights, self.names, self.centre, self.scale)))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        cols = project(self.input_exprs(df), self.weights, self.names, self.centre, self.scale)
        return df.select(*[quote(k) for k in keep], *cols)

    @property
    def output_dim(self) -> int:
        return len(self.names)


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_{i + 1:02d}" for i in range(k)]


def kinds_and_categories(df: DataFrame, features: Sequence[str], threshold: int = 10) -> tuple[list[str], dict[str, list[tuple]]]:
    """Numeric columns, and for categorical ones the sorted (value, count) list.

    Text columns are categorical whatever their number of values (see ``categories``). For the others
    a wide profile pass, then exact value frequencies for low-cardinality
    candidates only; these have ≤ ``threshold`` values, so what
    reaches the driver is bounded by threshold × p rows.
    """
    from quire.operators.profile import column_profile, low_cardinality_candidates
    text = text_columns(df, features)
    texts = {c: v for c, v in categories(df, text).items() if v}
    plain = [c for c in features if c not in text]
    cand = low_cardinality_candidates(column_profile(df, plain), threshold) if plain else []
    cat_rows = []
    if cand:   # exact frequencies only for columns that can be categorical
        freq = value_frequencies(df, cand).where(F.col("value").isNotNull())
        nd = freq.groupBy("column").agg(F.count("value").alias("nd"))
        cat_rows = (freq.join(F.broadcast(nd), "column").where(F.col("nd") <= threshold)
                    .select("column", "value", "n").collect())
    cats: dict[str, list[tuple]] = {}
    for r in cat_rows:
        cats.setdefault(r["column"], []).append((r["value"], r["n"]))
    for c in cats:
        cats[c].sort()
    numeric = [c for c in plain if c not in cats]
    cats |= texts
    categorical = {c: cats[c] for c in features if c in cats}
    return numeric, categorical


def choose_k(evr: np.ndarray, variance_target: float, n_components: int | None,
             max_components: int, ceiling: int) -> int:
    from quire.operators.linalg import first_reaching
    if n_components is not None:
        return max(1, min(n_components, max_components, ceiling))
    k = first_reaching(np.cumsum(evr), variance_target)
    return max(1, min(k, max_components, ceiling))
