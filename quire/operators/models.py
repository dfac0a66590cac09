"""Classifier presets on ``pyspark.ml`` for a rare positive class.

Every preset is a factory ``build(params, pos_weight) -> ModelSpec``; ``fit``
takes a DataFrame with feature columns and a 0/1 label and returns a fitted
object whose ``predict`` adds ``prediction`` (0/1) and ``score`` (probability
of class 1). Class balance is expressed through a weight column (balanced
weights n/(2·n_c), or ``pos_weight`` on positives for the boosted presets).

Where Spark has no equal, the preset is re-aimed and says so:
``svm`` — random Fourier features (RBF kernel approximation) + linear SVM with
a logistic calibration of the margin. ``random_forest``, ``balanced_random_forest``,
``lightgbm`` (leaf-wise), ``xgboost`` (level-wise) and ``easy_ensemble`` are the histogram learners
of ``trees.py``, ``mlp`` the perceptron of ``mlp.py``; every parameter of their search spaces acts.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators import mlp, proximal, trees

SEED = 42
#: The deepest tree of the random forest; a larger setting is refused.
MAX_DEPTH = 30
#: Features up to which the logistic model takes Newton steps (a Hessian of p x p numbers a task).
NEWTON_FEATURES = 256
FEATURES_VEC = "_features"
WEIGHT = "_weight"


def add_balanced_weight(df: DataFrame, label: str, pos_weight: float | None = None) -> DataFrame:
    """Weight column: balanced n/(2·n_c), or ``pos_weight`` for positives and 1 otherwise."""
    if pos_weight is not None:
        return df.withColumn(WEIGHT, F.when(quote(label) == 1, F.lit(float(pos_weight))).otherwise(1.0))
    counts = {r[0]: r[1] for r in df.groupBy(quote(label)).count().collect()}  # one row per class
    n = sum(counts.values())
    expr = F.lit(1.0)
    for k, c in counts.items():
        expr = F.when(quote(label) == F.lit(k), F.lit(n / (len(counts) * c))).otherwise(expr)
    return df.withColumn(WEIGHT, expr)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_VEC,
                           handleInvalid="keep").transform(df)


def positive_probability(df: DataFrame, col: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(F.col(col))[1])


@dataclass
class Fitted:
    features: list
    models: list
    label: str
    kind: str = "single"
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        base = assemble(df, self.features)
        if self.kind == "rff":
            base = self.extra["rff"](base)
        if self.kind in ("single", "rff"):
            out = self.models[0].transform(base)
            if self.kind == "rff":
                cal = self.extra["calibration"]
                out = out.withColumn("_margin", vector_to_array("rawPrediction")[1])
                out = cal.transform(assemble(out.drop(FEATURES_VEC, "probability", "rawPrediction", "prediction"),
                                             ["_margin"]))
            out = positive_probability(out)
            return out.select(*[quote(k) for k in keep], F.col("prediction").cast("int").alias("prediction"),
                              "score")
        # averaged ensembles: mean of member probabilities, threshold 0.5
        cur = base
        for i, m in enumerate(self.models):
            cur = m.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}") \
                .transform(cur)
        s = sum(vector_to_array(F.col(f"_p{i}"))[1] for i in range(len(self.models))) / len(self.models)
        return cur.select(*[quote(k) for k in keep], (s >= 0.5).cast("int").alias("prediction"),
                          s.alias("score"))


@dataclass
class ModelSpec:
    name: str
    params: dict
    pos_weight: float | None = None
    key: str | None = None

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> Fitted:
        return FITTERS[self.name](self, train, list(features), label)


def _n_rows(df: DataFrame) -> int:
    return df.count()


def _fit_persisted(estimator, data: DataFrame):
    """Iterative learners pass over their input many times: keep it materialised."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


@dataclass
class Linear:
    """A fitted logistic model; scoring is one expression."""
    features: list
    weights: np.ndarray
    intercept: float

    def score(self) -> Column:
        x = [F.coalesce(F.nanvl(quote(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(float(w)) for c, w in zip(self.features, self.weights)]
        return 1 / (1 + F.exp(-sum(x, F.lit(float(self.intercept)))))

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = df.select(*[quote(k) for k in keep], self.score().alias("score"))
        return out.select(*[quote(k) for k in keep], (F.col("score") > 0.5).cast("int").alias("prediction"), "score")


def _elastic_net(params: dict) -> tuple[float, float, int]:
    return float(params.get("C", 0.1)), float(params.get("l1_ratio", 0.5)), int(params.get("max_iter", 500))


def fit_folds(spec: ModelSpec, folded: DataFrame, features: Sequence[str], label: str, folds: Sequence[int | None], families: Sequence[Sequence[str]] | None = None,
              fold: str = "fold", parallelism: int = 2) -> list[list]:
    """For each family of features (all of them, if none are given) the models that leave out each fold (None: no fold).

    Logistic models share every pass over the rows: as many passes as the slowest of them takes, whatever their number.
    """
    families = [list(f) for f in families or [features]]
    if spec.name == "logistic_regression" and len(features) <= NEWTON_FEATURES:
        c, share, steps = _elastic_net(spec.params)
        at = {f: i for i, f in enumerate(features)}
        settings = [proximal.Setting(c, share, f, tuple(at[x] for x in own) if len(own) < len(features) else None) for own in families for f in folds]
        own = [settings[i].columns or tuple(range(len(features))) for i in range(0, len(settings), len(folds))]
        w = proximal.newton(proximal.prepared(folded, features, label, fold), settings, steps).reshape(len(features) + 1, len(families), len(folds))
        return [[Linear([features[i] for i in cols], w[list(cols), j, k], float(w[-1, j, k])) for k in range(len(folds))] for j, cols in enumerate(own)]

    def one(item):
        own, f = item
        return spec.fit(folded if f is None else folded.where(quote(fold) != f), own, label)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        got = list(pool.map(one, [(own, f) for own in families for f in folds]))
    return [got[i:i + len(folds)] for i in range(0, len(got), len(folds))]


def held_out(models: Sequence, folded: DataFrame, keep: Sequence[str], fold: str = "fold") -> DataFrame:
    """(``keep`` columns, fold, prediction, score): every row scored by the model that left its fold out."""
    if all(isinstance(m, Linear) for m in models):
        out = folded.where(quote(fold).isin(*range(len(models)))).select(*[quote(c) for c in keep], quote(fold), fold_score(models, fold).alias("score"))
        return out.select(*[quote(c) for c in keep], quote(fold), (F.col("score") > 0.5).cast("int").alias("prediction"), "score")
    parts = [m.predict(folded.where(quote(fold) == f), keep=keep).withColumn(fold, F.lit(f)) for f, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def fold_score(models: Sequence[Linear], fold: str = "fold") -> Column:
    """The score of a row under the model that left its fold out."""
    return F.coalesce(*[F.when(quote(fold) == f, m.score()) for f, m in enumerate(models)])


def _fit_logistic(spec, train, features, label):
    c, share, steps = _elastic_net(spec.params)
    if len(features) <= NEWTON_FEATURES:
        w = proximal.newton(proximal.prepared(train, features, label), [proximal.Setting(c, share)], steps)[:, 0]
        return Linear(features, w[:-1], float(w[-1]))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    n = _n_rows(train)
    lr = LogisticRegression(featuresCol=FEATURES_VEC, labelCol=label, weightCol=WEIGHT,
                            elasticNetParam=share, regParam=1.0 / (c * max(n, 1)),
                            standardization=False, maxIter=steps, tol=1e-6)
    model = _fit_persisted(lr, assemble(add_balanced_weight(train, label), features))
    train.unpersist()
    return Linear(features, model.coefficients.toArray(), float(model.intercept))


def _rff_map(features, gamma, n_components, seed):
    """Random Fourier features z(x) = √(2/D)·cos(xW + b), W ~ N(0, 2γ), b ~ U(0, 2π).

    Applied as an Arrow-batched pandas UDF: one numpy matrix product per batch
    (the D × p expression tree in SQL is far slower to plan and evaluate).
    """
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(len(features), n_components))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)

    @F.pandas_udf("array<double>")
    def rff(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, w.shape[0]))
        z = scale * np.cos(np.nan_to_num(m) @ w + b)
        return pd.Series(list(z))

    def apply(df):
        arr = vector_to_array(F.col(FEATURES_VEC))
        return df.withColumn(FEATURES_VEC, array_to_vector(rff(arr)))
    return apply


def _fit_svm(spec, train, features, label):
    p = spec.params
    gamma = p.get("gamma", "scale")
    if gamma in ("scale", "auto"):
        if gamma == "auto":
            g = 1.0 / max(len(features), 1)
        else:
            row = train.select(*[F.var_pop(quote(c)).alias(c) for c in features]).first()
            mean_var = float(np.mean([row[c] or 0.0 for c in features])) if features else 1.0
            g = 1.0 / (max(len(features), 1) * (mean_var if mean_var > 0 else 1.0))
    else:
        g = float(gamma)
    rff = _rff_map(features, g, int(p.get("n_components", 200)), SEED)
    data = rff(assemble(add_balanced_weight(train, label), features)).persist(StorageLevel.MEMORY_AND_DISK)
    n = _n_rows(data)
    svc = LinearSVC(featuresCol=FEATURES_VEC, labelCol=label, weightCol=WEIGHT,
                    regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)), maxIter=100)
    m = svc.fit(data)
    margins = m.transform(data).withColumn("_margin", vector_to_array("rawPrediction")[1])
    cal = LogisticRegression(featuresCol=FEATURES_VEC, labelCol=label, weightCol=WEIGHT, regParam=0.0)
    cal_model = cal.fit(assemble(margins.drop(FEATURES_VEC, "rawPrediction", "prediction"), ["_margin"]))
    data.unpersist()
    return Fitted(features, [m], label, kind="rff", extra={"rff": rff, "calibration": cal_model})


def _picked(params: dict, names: Sequence[str], model: str) -> dict:
    """The parameters of a fit; an unknown name is an error, so none is without effect."""
    unknown = set(params) - set(names)
    if unknown:
        raise ValueError(f"{model} has no parameter {sorted(unknown)}")
    return dict(params)


def _fit_random_forest(spec, train, features, label):
    own = _picked(spec.params, ("n_estimators", "max_depth", "min_samples_leaf", "max_features"), spec.name)
    own["max_depth"] = own.get("max_depth") or MAX_DEPTH
    if own["max_depth"] > MAX_DEPTH:
        raise ValueError(f"max_depth {own['max_depth']} is above {MAX_DEPTH}, the deepest tree of this forest")
    return trees.fit_random_forest(train, features, label, spec.key, seed=SEED, **own)


def _fit_balanced_forest(spec, train, features, label):
    return trees.fit_balanced_forest(train, features, label, spec.key, seed=SEED, **_picked(
        spec.params, ("n_estimators", "max_depth", "min_samples_leaf", "max_features"), spec.name))


def _fit_lightgbm(spec, train, features, label):
    own = {"num_leaves": 31, "min_child_samples": 10, **_picked(spec.params, (
        "n_estimators", "learning_rate", "num_leaves", "min_child_samples", "subsample", "colsample_bytree", "reg_alpha", "reg_lambda"), spec.name)}
    return trees.fit_booster(train, features, label, spec.key, pos_weight=spec.pos_weight or 1.0, seed=SEED, **own)


def _fit_xgboost(spec, train, features, label):
    own = {"max_depth": 5, "min_child_weight": 3, **_picked(spec.params, (
        "n_estimators", "learning_rate", "max_depth", "min_child_weight", "subsample", "colsample_bytree", "reg_alpha", "reg_lambda"), spec.name)}
    return trees.fit_booster(train, features, label, spec.key, pos_weight=spec.pos_weight or 1.0, seed=SEED, **own)


def _fit_mlp(spec, train, features, label):
    return mlp.fit_perceptron(train, features, label, seed=SEED, **_picked(
        spec.params, ("hidden_layer_sizes", "activation", "alpha", "learning_rate_init", "batch_size", "max_iter"), spec.name))


def _fit_easy_ensemble(spec, train, features, label):
    return trees.fit_easy_ensemble(train, features, label, spec.key, seed=SEED, **_picked(spec.params, ("n_estimators", "rounds"), spec.name))


def _fit_extra_trees(spec, train, features, label):
    return trees.fit_extra_trees(train, features, label, seed=SEED, **_picked(
        spec.params, ("n_estimators", "max_depth", "min_samples_leaf", "max_features"), spec.name))


FITTERS = {
    "extra_trees": _fit_extra_trees,
    "logistic_regression": _fit_logistic,
    "svm": _fit_svm,
    "random_forest": _fit_random_forest,
    "balanced_random_forest": _fit_balanced_forest,
    "lightgbm": _fit_lightgbm,
    "xgboost": _fit_xgboost,
    "mlp": _fit_mlp,
    "easy_ensemble": _fit_easy_ensemble,
}

# Search spaces and default trial counts of each model.
SEARCH_SPACES = {
    "logistic_regression": {"C": ("logfloat", 1e-4, 10.0), "l1_ratio": ("float", 0.0, 1.0)},
    "svm": {"C": ("logfloat", 1e-3, 100.0), "gamma": ("choice", ["scale", "auto", 1e-4, 1e-3, 1e-2, 1e-1])},
    "random_forest": {"n_estimators": ("int", 100, 800, 100), "max_depth": ("int", 3, 25, 1),
                      "min_samples_leaf": ("int", 1, 10, 1),
                      "max_features": ("choice", ["sqrt", "log2", 0.3, 0.5])},
    "balanced_random_forest": {"n_estimators": ("int", 100, 800, 100), "max_depth": ("int", 3, 25, 1),
                               "min_samples_leaf": ("int", 1, 8, 1),
                               "max_features": ("choice", ["sqrt", "log2", 0.3, 0.5])},
    "lightgbm": {"n_estimators": ("int", 100, 1000, 50), "learning_rate": ("logfloat", 0.01, 0.3),
                 "num_leaves": ("int", 15, 127, 1), "min_child_samples": ("int", 5, 60, 1),
                 "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0),
                 "reg_alpha": ("logfloat", 1e-8, 10.0), "reg_lambda": ("logfloat", 1e-8, 10.0)},
    "xgboost": {"n_estimators": ("int", 100, 1000, 50), "learning_rate": ("logfloat", 0.01, 0.3),
                "max_depth": ("int", 3, 10, 1), "subsample": ("float", 0.5, 1.0),
                "colsample_bytree": ("float", 0.5, 1.0), "min_child_weight": ("int", 1, 10, 1),
                "reg_alpha": ("logfloat", 1e-8, 10.0), "reg_lambda": ("logfloat", 1e-8, 10.0)},
    "mlp": {"hidden_layer_sizes": ("choice", [(64,), (128,), (64, 32), (128, 64), (256, 128), (128, 64, 32)]),
            "activation": ("choice", ["relu", "tanh"]), "alpha": ("logfloat", 1e-6, 0.1),
            "learning_rate_init": ("logfloat", 1e-4, 0.01), "batch_size": ("choice", [32, 64, 128])},
    "easy_ensemble": {"n_estimators": ("int", 10, 60, 5)},
}
DEFAULT_TRIALS = {"logistic_regression": 60, "svm": 60, "random_forest": 50, "balanced_random_forest": 50,
                  "lightgbm": 80, "xgboost": 80, "mlp": 50, "easy_ensemble": 30}
MODEL_NAMES = list(DEFAULT_TRIALS)


def sample_params(name: str, rng: np.random.Generator) -> dict:
    out = {}
    for k, spec in SEARCH_SPACES[name].items():
        kind = spec[0]
        if kind == "float":
            out[k] = float(rng.uniform(spec[1], spec[2]))
        elif kind == "logfloat":
            out[k] = float(math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2]))))
        elif kind == "int":
            lo, hi, step = spec[1], spec[2], spec[3]
            out[k] = int(lo + step * rng.integers(0, (hi - lo) // step + 1))
        else:
            out[k] = spec[1][int(rng.integers(0, len(spec[1])))]
    return out


def positive_weight(df: DataFrame, label: str) -> float:
    """n_negative / max(n_positive, 1)."""
    r = df.agg(F.count_if(quote(label) == 0).alias("n0"), F.count_if(quote(label) == 1).alias("n1")).first()
    return float(r["n0"]) / max(float(r["n1"]), 1.0)


def build_model(name: str, params: dict | None = None, pos_weight: float | None = None, key: str | None = None) -> ModelSpec:
    """A model with its parameters; ``key`` names the row key that bags are drawn by (else rows are numbered)."""
    if name not in FITTERS:
        raise ValueError(f"unknown model {name!r}; known: {MODEL_NAMES}")
    return ModelSpec(name, dict(params or {}), pos_weight if name in ("lightgbm", "xgboost") else None, key)


def l1_support(df: DataFrame, features: Sequence[str], label: str, c: float = 0.1) -> list[str]:
    """Features with non-zero weight in an L1 logistic regression (median-imputed, balanced)."""
    from quire.operators.preprocess import impute_columns, train_medians
    med = train_medians(df, features)
    data = df.select(quote(label), *impute_columns(df, {k: (v or 0.0) for k, v in med.items()}))
    spec = ModelSpec("logistic_regression", {"C": c, "l1_ratio": 1.0, "max_iter": 1000})
    fitted = _fit_logistic(spec, data, list(features), label)
    return [f for f, w in zip(features, fitted.weights) if abs(w) > 0]
