"""Reducers by name, and plans that combine them.

A plan is a validated list of stages. A fitted stage describes its result as named expressions over its
input (``outputs``), so a plan needs no joins: in a chain each stage is one projection over the one before, and
stages side by side are a single projection over the common input, where the first column of a name wins. A stage that
works by document (``lsa``) has no expressions; it can stand in a chain, not side by side.
"""
from __future__ import annotations

import inspect
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote, unique_names

REGISTRY: dict[str, type] = {}

# Configuration shorthands (method name → ordered steps).
SHORTHANDS: dict[str, list[dict]] = {
    "pca": [{"type": "pca"}],
    "famd": [{"type": "famd"}],
    "catpca": [{"type": "catpca"}],
    "hellinger": [{"type": "hellinger"}],
    "famd_hellinger": [
        {"type": "famd", "n_components": 80},
        {"type": "hellinger", "n_features": 60, "use_svm_refinement": True},
    ],
}
LAYOUTS = {"sequential": "chain", "parallel": "side by side"}


def register_reducer(name: str):
    """Makes a class known to configurations, in place of a built-in one of that name."""
    def put(cls: type) -> type:
        REGISTRY[name] = cls
        return cls
    return put


def _known() -> dict[str, type]:
    from quire.operators.hellinger import HellingerSelector
    from quire.operators.reducers.catpca import CATPCAReducer
    from quire.operators.reducers.famd import FAMDReducer
    from quire.operators.reducers.mca import MCAReducer
    from quire.operators.reducers.pca import PCAReducer
    builtin = {"pca": PCAReducer, "famd": FAMDReducer, "catpca": CATPCAReducer, "hellinger": HellingerSelector, "mca": MCAReducer,
               "lsa": TextStage, "truncate": TruncateStage}
    return {**builtin, **REGISTRY}


def list_reducers() -> list[str]:
    return sorted(_known())


@dataclass(frozen=True)
class StageConfig:
    """One stage: the reducer's name and its options, checked against what the reducer takes."""
    reducer: str
    options: dict

    @classmethod
    def read(cls, spec: dict) -> "StageConfig":
        if "type" not in spec:
            raise ValueError(f"a stage names its reducer under 'type': {spec}")
        reducer, options = spec["type"], {k: v for k, v in spec.items() if k != "type"}
        if reducer not in _known():
            raise ValueError(f"no reducer is called {reducer!r}; there are {', '.join(list_reducers())}")
        taken = inspect.signature(_known()[reducer].__init__).parameters
        extra = [k for k in options if k not in taken]
        if extra and not any(p.kind is p.VAR_KEYWORD for p in taken.values()):
            raise ValueError(f"{reducer} takes no {', '.join(extra)}")
        return cls(reducer, options)

    def estimator(self):
        return _known()[self.reducer](**self.options)


@dataclass(frozen=True)
class PlanConfig:
    """A validated configuration: stages, how they are laid out, and whether numeric columns stay beside them."""
    stages: tuple[StageConfig, ...]
    layout: str = "chain"
    with_numeric: bool = False
    name: str = ""

    @classmethod
    def read(cls, value: "str | dict") -> "PlanConfig":
        if isinstance(value, str):
            if value not in SHORTHANDS:
                raise ValueError(f"{value!r} stands for no plan; shorthands are {', '.join(SHORTHANDS)}")
            return cls(tuple(map(StageConfig.read, SHORTHANDS[value])), name=value)
        mode = value.get("mode", "sequential")
        if mode not in LAYOUTS:
            raise ValueError(f"stages are laid out {' or '.join(LAYOUTS)}, not {mode!r}")
        stages = tuple(map(StageConfig.read, value.get("methods", ())))
        return cls(stages, LAYOUTS[mode], bool(value.get("keep_original_numeric", False)), "_".join(s.reducer for s in stages))


@dataclass
class FittedPlan:
    """Fitted stages; ``models`` are in order."""
    models: list
    layout: str = "chain"
    numeric: list[str] = field(default_factory=list)

    def outputs(self, df: DataFrame) -> dict[str, Column]:
        """The result of stages side by side as named expressions over ``df``."""
        named: dict[str, Column] = {}
        for part in [*[m.outputs(df) for m in self.models], {c: quote(c) for c in self.numeric if c in df.columns}]:
            for name, column in part.items():
                named.setdefault(name, column)
        return named

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.layout == "chain":
            for m in self.models:
                df = m.transform(df, keep=list(keep))
            return df
        return df.select(*[quote(k) for k in keep], *[c.alias(n) for n, c in self.outputs(df).items() if n not in keep])

    @property
    def output_dim(self) -> int:
        dims = [m.output_dim for m in self.models]
        return (dims[-1] if dims else 0) if self.layout == "chain" else sum(dims)

    @property
    def explained_variance_ratio(self) -> list[float]:
        """Ratios of the first stage that has them."""
        return next((list(m.explained_variance_ratio) for m in self.models if hasattr(m, "explained_variance_ratio")), [])


class ReducerPlan:
    """An estimator over the stages of a ``PlanConfig``."""

    def __init__(self, config: PlanConfig):
        self.config = config

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> FittedPlan:
        if self.config.layout == "chain":
            return self._fit_chain(df, list(features), label)
        numeric: list[str] = []
        if self.config.with_numeric:
            from quire.operators.profile import detect_column_types
            numeric = unique_names(detect_column_types(df, list(features))[0])
        return FittedPlan([s.estimator().fit(df, features, label) for s in self.config.stages], self.config.layout, numeric)

    def _fit_chain(self, df: DataFrame, features: list[str], label: str | None) -> FittedPlan:
        fitted = FittedPlan([])
        beside = [c for c in df.columns if c not in features]
        for stage in self.config.stages:
            model = stage.estimator().fit(df, features, label)
            fitted.models.append(model)
            df = model.transform(df, keep=beside)
            features = [c for c in df.columns if c not in beside]
        return fitted


def build_pipeline(config: "str | dict | None") -> ReducerPlan | None:
    """A plan from a shorthand or {"mode", "keep_original_numeric", "methods": [{"type": …}]}; None for no reduction."""
    return None if config is None else ReducerPlan(PlanConfig.read(config))


def output_folder_name(config: "str | dict | None") -> str:
    """Where an experiment's results go: the shorthand or the reducers' names, ``no_dr`` without any."""
    return "no_dr" if config is None else PlanConfig.read(config).name


# ---------------------------------------------------------------- stages on text and vectors

@dataclass
class TruncatedModel:
    features: list[str]

    @property
    def output_dim(self) -> int:
        return len(self.features)

    def outputs(self, df: DataFrame) -> dict[str, Column]:
        values = [F.coalesce(quote(c).cast("double"), F.lit(0.0)) for c in self.features]
        norm = F.sqrt(sum((v * v for v in values), F.lit(0.0)))
        return {c: F.when(norm > 0, v / norm).otherwise(0.0) for c, v in zip(self.features, values)}

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*[quote(k) for k in keep], *[c.alias(n) for n, c in self.outputs(df).items()])


class TruncateStage:
    """The first ``dims`` of the feature columns, scaled to length one (nested embeddings)."""

    def __init__(self, dims: int):
        self.dims = dims

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> TruncatedModel:
        return TruncatedModel(list(features)[: self.dims])


@dataclass
class TextModel:
    model: object
    key: str

    @property
    def output_dim(self) -> int:
        return self.model.output_dim

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = self.model.transform(df, keep=list(keep))
        return out if self.key in keep else out.drop(self.key)


class TextStage:
    """TF-IDF and LSA of one text column; ``key`` identifies the documents and must be among the kept columns."""

    def __init__(self, key: str, text: str, n_components: int = 20, min_df: int = 3, max_features: int | None = None):
        self.key, self.text = key, text
        self.options = {"n_components": n_components, "min_df": min_df, "max_features": max_features}

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None) -> TextModel:
        from quire.operators.reducers.lsa import LSAReducer
        return TextModel(LSAReducer(**self.options).fit(df, self.key, self.text), self.key)
