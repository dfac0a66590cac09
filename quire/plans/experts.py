"""Mixture of experts by feature family, and text-aware sparse feature selection.

Mixture of experts: one expert per feature family (columns chosen by name
prefix). Each expert's out-of-fold probabilities on the training part (k
stratified folds) train a class-balanced logistic gate; experts refitted on
the whole training part score the test part, and the gate combines them. Logistic
experts of all families and folds share every pass over the rows and score as expressions
beside the row; the probability frames of others are unioned and pivoted on the key (one
shuffle), never joined pairwise.

Text-aware selection: non-numeric fields become ``column=value`` tokens, which
Spark ML turns into sparse TF-IDF vectors (``CountVectorizer`` with a bounded
vocabulary, ``IDF``); these are assembled with the numeric features, an L1
logistic regression keeps the non-zero coordinates, and a final logistic
regression is fitted on the kept ones.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IDF, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import columns_with_prefix, quote
from quire.operators.models import WEIGHT, Linear, add_balanced_weight, build_model, fit_folds, fold_score, held_out
from quire.operators.split import stratified_folds


def mixture_of_experts(train: DataFrame, test: DataFrame, families: dict[str, Sequence[str]], key: str,
                       label: str, k: int = 5, seed: int = 42, expert: str = "logistic_regression",
                       parallelism: int = 4) -> DataFrame:
    """Test rows (key, label, prediction, score, p_<family>…) scored by the gated experts."""
    fams = {f: columns_with_prefix(train, *p) for f, p in families.items()}
    fams = {f: c for f, c in fams.items() if c}
    if not fams:
        raise ValueError("no feature family has columns")
    folded = stratified_folds(train, key, label, k=k, seed=seed).cache()

    names = list(fams)
    every = list(dict.fromkeys(c for cols in fams.values() for c in cols))
    fitted = dict(zip(names, fit_folds(build_model(expert), folded, every, label, [*range(k), None], list(fams.values()), parallelism=parallelism)))

    pcols = [f"p_{n}" for n in names]

    def scores(fam):
        return [df.select(key, F.lit(fam).alias("family"), "score") for df in (held_out(fitted[fam][:k], folded, [key]), fitted[fam][k].predict(test, keep=[key]))]

    def wide(frames, base):
        long = reduce(DataFrame.unionByName, frames)
        piv = long.groupBy(key).pivot("family", names).agg(F.first("score"))
        piv = piv.select(key, *[F.col(n).alias(f"p_{n}") for n in names])
        return base.select(quote(key), quote(label)).join(piv, key, "left").na.fill(0.5)

    if all(isinstance(m, Linear) for own in fitted.values() for m in own):
        # Linear experts are expressions: a row's scores stand beside it, nothing is joined.
        base = [quote(key), quote(label)]
        gate_train = folded.select(*base, *[fold_score(fitted[n][:k]).alias(p) for n, p in zip(names, pcols)]).na.fill(0.5)
        gate_test = test.select(*base, *[fitted[n][k].score().alias(p) for n, p in zip(names, pcols)]).na.fill(0.5)
    else:
        results = [scores(fam) for fam in names]
        gate_train, gate_test = wide([r[0] for r in results], train), wide([r[1] for r in results], test)
    gate = build_model("logistic_regression", {"C": float("inf")}).fit(gate_train, pcols, label)
    out = gate.predict(gate_test, keep=[key, label, *pcols])
    folded.unpersist()
    return out.select(quote(key), quote(label), "prediction", "score", *pcols)


def value_tokens(df: DataFrame, cols: Sequence[str], name: str = "tokens") -> DataFrame:
    """Array of ``column=value`` tokens of the non-null text fields of each row."""
    toks = [F.when(quote(c).isNotNull(), F.concat(F.lit(f"{c}="), F.lower(quote(c).cast("string"))))
            for c in cols]
    return df.withColumn(name, F.filter(F.array(*toks), lambda t: t.isNotNull()))


def text_aware_selection(train: DataFrame, test: DataFrame, key: str, label: str,
                         numeric: Sequence[str], text_cols: Sequence[str], min_df: int = 3,
                         max_features: int | None = None, c: float = 0.1):
    """Returns (test predictions, selected feature names); all tokens in ``min_df`` rows unless ``max_features`` is given."""
    tr = value_tokens(train, text_cols)
    te = value_tokens(test, text_cols)
    cv = CountVectorizer(inputCol="tokens", outputCol="_tf", minDF=float(min_df),
                         vocabSize=max_features or (1 << 31) - 1).fit(tr)
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(cv.transform(tr))
    asm = VectorAssembler(inputCols=list(numeric) + ["_tfidf"], outputCol="_x", handleInvalid="keep")

    def prep(df):
        return asm.transform(idf.transform(cv.transform(df)))

    names = list(numeric) + [f"text:{t}" for t in cv.vocabulary]
    data = prep(add_balanced_weight(tr, label)).persist()
    n = data.count()
    sel = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=WEIGHT, elasticNetParam=1.0,
                             regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=200).fit(data)
    coef = sel.coefficients.toArray()
    keep = [i for i, w in enumerate(coef) if abs(w) > 0] or list(range(len(names)))
    slicer = VectorSlicer(inputCol="_x", outputCol="_sel", indices=keep)
    final = LogisticRegression(featuresCol="_sel", labelCol=label, weightCol=WEIGHT, maxIter=200) \
        .fit(slicer.transform(data))
    data.unpersist()
    from pyspark.ml.functions import vector_to_array
    out = final.transform(slicer.transform(prep(te)))
    pred = out.select(quote(key), quote(label), F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("score"))
    return pred, [names[i] for i in keep]
