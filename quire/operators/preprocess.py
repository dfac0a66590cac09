"""Train-only imputation and standardisation.

Fit statistics (exact medians, then mean and population sd of the imputed
train frame) are p-sized and are the only values that reach the driver; the
fitted model is a pure projection — ``coalesce`` and affine arithmetic inside
whole-stage codegen, no shuffle — applied identically to train, test or a
stream.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.functions.numeric import numeric_double, z_score
from quire.operators.profile import column_medians, moments


def train_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact per-column medians of the train frame (p values reach the driver)."""
    return column_medians(train, cols)


def impute_columns(df: DataFrame, fills: dict[str, float]) -> list[Column]:
    return [F.coalesce(numeric_double(quote(c)), F.lit(float(v))).alias(c) for c, v in fills.items()]


@dataclass
class PreprocessorModel:
    features: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    sds: dict[str, float]
    dropped: list[str] = field(default_factory=list)
    reducer: object | None = None

    def imputed(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*[quote(k) for k in keep], *impute_columns(df, self.medians))

    def transform_preprocessed(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Impute with train medians, then z-score with train mean / population sd."""
        cols = []
        for c in self.features:
            v = F.coalesce(numeric_double(quote(c)), F.lit(float(self.medians[c])))
            cols.append(z_score(v, F.lit(float(self.means[c])), F.lit(float(self.sds[c] or 0.0))).alias(c))
        return df.select(*[quote(k) for k in keep], *cols)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        pre = self.transform_preprocessed(df, keep)
        if self.reducer is None:
            return pre
        return self.reducer.transform(pre, keep=keep)

    @property
    def output_dim(self) -> int:
        return self.reducer.output_dim if self.reducer is not None else len(self.features)


class Preprocessor:
    """Median impute + standardise (+ optional reducer), all fitted on train only.

    ``reducer`` is an estimator with ``fit(df, features, label)`` returning a
    model with ``transform(df, keep)`` and ``output_dim``.
    """

    def __init__(self, reducer=None):
        self.reducer = reducer

    def fit(self, train: DataFrame, features: Sequence[str], label: str | None = None,
            key: str | None = None) -> PreprocessorModel:
        features = list(features)
        # every fit pass (profile, medians, moments, reducer) reads the same rows
        keep = [c for c in (key, label) if c and c in train.columns]
        train = train.select(*[quote(c) for c in keep + features]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(train, features, label, key)
        finally:
            train.unpersist()

    def _fit(self, train: DataFrame, features: list[str], label: str | None,
             key: str | None) -> PreprocessorModel:
        med = train_medians(train, features)
        dropped = [c for c in features if med[c] is None]  # all-null in train: no median
        kept = [c for c in features if med[c] is not None]
        fills = {c: med[c] for c in kept}
        imputed = train.select(*impute_columns(train, fills))
        mom = {r["column"]: r for r in moments(imputed, kept).collect()}
        model = PreprocessorModel(kept, fills, {c: mom[c]["mean"] for c in kept},
                                  {c: mom[c]["sd"] for c in kept}, dropped)
        if self.reducer is not None:
            keep = [k for k in (key, label) if k]
            pre = model.transform_preprocessed(train, keep=keep)
            model.reducer = self.reducer.fit(pre, kept, label)
        return model
