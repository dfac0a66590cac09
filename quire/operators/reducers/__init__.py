"""Dimensionality reducers: estimators with ``fit(df, features, label)`` → model.

Models expose ``transform(df, keep)``, ``output_dim``, ``names`` and
``explained_variance_ratio``. Fitting needs one or two distributed passes
(value frequencies for column kinds and categories; one Gram pass); every
iteration after that works on p-sized matrices; transforms are projections.
"""
from quire.operators.reducers.registry import (  # noqa: F401
    REGISTRY, SHORTHANDS, ReducerPlan, build_pipeline, list_reducers, register_reducer,
)
