"""End-to-end experiment: split → fit preprocessing (+ reducer) on train → transform.

``flagship`` is the minimum slice: labelled cohort, exact stratified split,
train-only median imputation and standardisation, then Hellinger ranking of
the preprocessed train features.
"""
from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.hellinger import hellinger_scores
from quire.operators.preprocess import Preprocessor, PreprocessorModel
from quire.operators.split import stratified_split
from quire.plans.cohort import FEATURES, KEY, LABEL, cohort_features

log = logging.getLogger(__name__)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = cohort_features(spark, sf_dir)
    split = stratified_split(cohort, KEY, LABEL, test_size=0.2, seed=42)
    train = split.where(~F.col("is_test"))
    model = Preprocessor().fit(train, FEATURES, LABEL)
    pre = model.transform_preprocessed(train, keep=[KEY, LABEL])
    return hellinger_scores(pre, model.features, LABEL).select(
        "feature", "kind", F.round("h_score", 6).alias("h_score"),
        F.col("h_rank").cast("bigint").alias("h_rank"))


@dataclass
class PreprocessedSplit:
    """Train/test frames before and after reduction, plus fit metadata."""
    train: DataFrame
    test: DataFrame
    train_reduced: DataFrame
    test_reduced: DataFrame
    model: PreprocessorModel
    n_features_before: int
    n_features_after: int
    explained_variance: float


def preprocess_and_reduce(cohort: DataFrame, features: list[str], key: str, label: str,
                          reducer=None, test_size: float = 0.2, seed: int = 42,
                          cache: bool = True) -> PreprocessedSplit:
    split = stratified_split(cohort, key, label, test_size=test_size, seed=seed)
    if cache:
        split = split.cache()
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test")).drop("is_test")
    model = Preprocessor(reducer).fit(train, features, label, key=key)
    keep = [key, label]
    tr_pre = model.transform_preprocessed(train, keep)
    te_pre = model.transform_preprocessed(test, keep)
    tr_red = model.transform(train, keep)
    te_red = model.transform(test, keep)
    ev = 0.0
    if model.reducer is not None and hasattr(model.reducer, "explained_variance_ratio"):
        ev = float(sum(model.reducer.explained_variance_ratio))
    return PreprocessedSplit(tr_pre, te_pre, tr_red, te_red, model, len(model.features),
                             model.output_dim, ev)


# --------------------------------------------------------------------------- models

def score_model(spec, train: DataFrame, test: DataFrame, features, label: str, key: str):
    """Fit on train, predict test → (predictions frame, metric-record frame with ``model``)."""
    from quire.operators.metrics import evaluate
    fitted = spec.fit(train, features, label)
    pred = fitted.predict(test, keep=[key, label])
    rec = evaluate(pred, label, "prediction", "score").withColumn("model", F.lit(spec.name))
    return pred, rec


def cross_validate(spec, train: DataFrame, features, label: str, key: str, k: int = 5,
                   seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Refit per stratified fold; per-metric mean and population sd over folds. All folds are scored and evaluated together."""
    from quire.operators.metrics import METRICS, evaluate, fold_summary
    from quire.operators.models import fit_folds, held_out
    from quire.operators.split import stratified_folds
    folded = stratified_folds(train, key, label, k=k, seed=seed).cache()
    fitted, = fit_folds(spec, folded, features, label, range(k), parallelism=parallelism)
    preds = held_out(fitted, folded, [key, label])
    # A fold without rows counts with metrics of 0. The summary is written before the folds are released.
    folds = train.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    per_fold = folds.join(evaluate(preds, label, "prediction", "score", ["fold"]), "fold", "left").na.fill(0.0, METRICS)
    summary = fold_summary(per_fold, METRICS + ["auc_roc"]).withColumn("model", F.lit(spec.name)).checkpoint()
    folded.unpersist()
    return summary


def tune(name: str, train: DataFrame, features, label: str, key: str, n_trials: int | None = None,
         seed: int = 42, k: int = 5, parallelism: int = 4) -> tuple[dict, float]:
    """Seeded random search maximising mean F1 of the positive class over stratified folds.

    All trials and folds of the elastic-net logistic model are fitted together, sharing every pass over the
    rows (``proximal``). Of the other models a trial whose fit fails is logged and scores 0.
    """
    import numpy as np
    from quire.operators.models import DEFAULT_TRIALS, positive_weight, sample_params
    from quire.operators.split import stratified_folds
    rng = np.random.default_rng(seed)
    folded = stratified_folds(train, key, label, k=k, seed=seed).cache()
    trials = [sample_params(name, rng) for _ in range(n_trials or DEFAULT_TRIALS[name])]
    if name == "logistic_regression":
        scores = _logistic_trials(folded, features, label, trials, k)
    else:
        spw = positive_weight(train, label)
        scores = [_trial(name, params, spw, folded, features, label, key, k, parallelism) for params in trials]
    folded.unpersist()
    at = max(range(len(trials)), key=lambda i: scores[i])
    return trials[at], scores[at]


def _logistic_trials(folded: DataFrame, features, label: str, trials: list[dict], k: int) -> list[float]:
    from quire.operators import proximal
    rows = proximal.prepared(folded, features, label, "fold")
    settings = [proximal.Setting(p["C"], p["l1_ratio"], f) for p in trials for f in range(k)]
    return proximal.mean_f1(rows, proximal.fit(rows, settings), settings)


def _trial(name: str, params: dict, pos_weight: float, folded: DataFrame, features, label: str, key: str, k: int, parallelism: int) -> float:
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce
    from quire.operators.metrics import confusion_counts, metrics_from_counts
    from quire.operators.models import build_model
    spec = build_model(name, params, pos_weight, key)

    def one(f):
        fitted = spec.fit(folded.where(F.col("fold") != f), features, label)
        return fitted.predict(folded.where(F.col("fold") == f), keep=[label]).withColumn("fold", F.lit(f))

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:   # folds fit concurrently
            preds = reduce(DataFrame.unionByName, list(pool.map(one, range(k))))
        m = metrics_from_counts(confusion_counts(preds, label, "prediction", ["fold"]), ["fold"], None)
        return float(m.agg(F.avg("f1_ap")).first()[0] or 0.0)
    except Exception:  # noqa: BLE001 - one failing trial must not end the search
        log.exception("trial of %s with %s failed and scores 0", name, params)
        return 0.0


@dataclass
class ExperimentResult:
    test_results: DataFrame
    cv_results: DataFrame
    summary: DataFrame
    best_params: dict


def run_experiment(cohort: DataFrame, features: list[str], key: str, label: str, dr_config=None,
                   models: list[str] | None = None, n_trials: int | None = None,
                   skip_tuning: bool = True, cv_folds: int = 5, out_dir: str | None = None) -> ExperimentResult:
    """Split → preprocess/reduce → (tune) → CV → test; results as DataFrames.

    With ``out_dir`` the frames go to ``data/method=…/split=…`` and the results to ``<method>/`` in the layout that
    ``sources.results.load_results`` reads.
    """
    from functools import reduce
    from quire.operators.models import MODEL_NAMES, build_model, positive_weight
    from quire.operators.reducers import build_pipeline
    from quire.operators.reducers.registry import output_folder_name
    spark = cohort.sparkSession
    split = preprocess_and_reduce(cohort, features, key, label, build_pipeline(dr_config))
    train = split.train_reduced.cache()
    test = split.test_reduced
    feats = [c for c in train.columns if c not in (key, label)]
    spw = positive_weight(train, label)
    names = models or MODEL_NAMES
    best, test_rows, cv_rows = {}, [], []
    for name in names:
        params = {}
        if not skip_tuning:
            params, _ = tune(name, train, feats, label, key, n_trials)
        best[name] = params
        spec = build_model(name, params, spw, key)
        cv_rows.append(cross_validate(spec, train, feats, label, key, k=cv_folds))
        _, rec = score_model(spec, train, test, feats, label, key)
        test_rows.append(rec)
    test_df = reduce(DataFrame.unionByName, test_rows)
    cv_df = reduce(DataFrame.unionByName, cv_rows)
    counts = split.train.agg(F.count(F.lit(1)).alias("n_train"),
                             F.count_if(F.col(label) == 1).alias("ap_train")).first()
    tcounts = split.test.agg(F.count(F.lit(1)).alias("n_test"),
                             F.count_if(F.col(label) == 1).alias("ap_test")).first()
    summary = spark.createDataFrame([(
        output_folder_name(dr_config), counts["n_train"], tcounts["n_test"], counts["ap_train"],
        tcounts["ap_test"], split.n_features_after, split.n_features_before, cv_folds,
        round(split.explained_variance, 4), skip_tuning, names)],
        "dr_method string, n_train long, n_test long, ap_train long, ap_test long, "
        "n_features_after_dr long, n_features_before_dr long, cv_folds long, "
        "cumulative_variance_explained double, skip_tuning boolean, models array<string>")
    result = ExperimentResult(test_df, cv_df, summary, best)
    if out_dir:
        save_experiment(result, split, out_dir, output_folder_name(dr_config), key, label)
    return result


def save_experiment(result: ExperimentResult, split: PreprocessedSplit, out_dir: str, method: str, key: str, label: str) -> None:
    """Writes frames, test and cross-validation results and the summary of one method."""
    from quire.sources.sinks import write_json_record, write_split, write_table
    frames = {"train": split.train, "test": split.test}
    if split.model.reducer is not None:
        frames |= {"train_reduced": split.train_reduced, "test_reduced": split.test_reduced}
    write_split(frames, f"{out_dir.rstrip('/')}/data", method, key, label)
    base = f"{out_dir.rstrip('/')}/{method}"
    write_table(result.test_results, f"{base}/model_results.csv")
    write_table(result.cv_results, f"{base}/cv_results.csv")
    write_json_record(result.summary, f"{base}/experiment_summary.json")


def sweep(cohort: DataFrame, features: list[str], key: str, label: str, methods: list,
          models: list[str] | None = None, parallelism: int = 3, **kwargs) -> tuple[DataFrame | None, DataFrame | None, list]:
    """Runs the methods side by side in one session; a failing method is reported and does not stop the rest.

    The cohort is held once for all of them. Every method is a job group of its own (so it can be seen and cancelled by name) in a
    scheduler pool of its own (so that none waits behind another's jobs where the session's scheduler is fair).
    Returns (test results, cv results) unioned with a ``method`` column in the order of ``methods``, and
    the list of (method, error) failures.
    """
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce
    from pyspark import StorageLevel, inheritable_thread_target
    from quire.operators.reducers.registry import output_folder_name
    sc = cohort.sparkSession.sparkContext
    shared = cohort.select(key, label, *features).persist(StorageLevel.MEMORY_AND_DISK)

    def one(method):
        name = str(method)
        try:
            name = output_folder_name(method)
            sc.setLocalProperty("spark.scheduler.pool", name)
            sc.setJobGroup(f"sweep-{name}", f"experiment with {name}", interruptOnCancel=True)
            r = run_experiment(shared, features, key, label, method, models, **kwargs)
            tag = F.lit(name)
            # Results are a row for each model: they are computed here, in the method's own pool.
            frames = [df.withColumn("method", tag).persist() for df in (r.test_results, r.cv_results)]
            for df in frames:
                df.count()
            return name, frames, None
        except Exception as e:  # noqa: BLE001 - reported to the caller, the others go on
            log.exception("method %s failed", name)
            return name, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        done = list(pool.map(inheritable_thread_target(cohort.sparkSession)(one), methods))
    shared.unpersist()
    held = [frames for _, frames, _ in done if frames]
    tests, cvs = ([f[i] for f in held] for i in (0, 1))
    return (reduce(DataFrame.unionByName, tests) if tests else None, reduce(DataFrame.unionByName, cvs) if cvs else None,
            [(name, error) for name, _, error in done if error])
