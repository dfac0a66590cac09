"""Registered reducer queries (rows-only: eigen/SVD results have no SQL oracle).

Each fits on the preprocessed train part of the labelled cohort (or on the
given vectors / texts) and returns the transformed rows of the whole input.
Invariants (orthogonality, variance = eigenvalues, Gram path = row path) are
checked in the tests.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.linalg import block_entries, gram_blocks
from quire.operators.preprocess import Preprocessor
from quire.operators.reducers import build_pipeline
from quire.operators.reducers.catpca import CATPCAReducer
from quire.operators.reducers.famd import FAMDReducer
from quire.operators.reducers.lsa import LSAReducer
from quire.operators.reducers.mca import MCAReducer
from quire.operators.reducers.pca import PCAReducer
from quire.plans.cohort import FEATURES, KEY, LABEL
from quire.plans.cohort_queries import split_cohort
from quire.sources.tables import read_table


def _fit_on_train(spark, sf_dir, reducer):
    split = split_cohort(spark, sf_dir)
    train = split.where(~F.col("is_test"))
    model = Preprocessor(reducer).fit(train, FEATURES, LABEL, key=KEY)
    return model.transform(split, keep=[KEY, LABEL, "is_test"])


def q_pca_cohort(spark, sf_dir):
    return _fit_on_train(spark, sf_dir, PCAReducer())


def q_famd_cohort(spark, sf_dir):
    return _fit_on_train(spark, sf_dir, FAMDReducer())


def q_catpca_cohort(spark, sf_dir):
    return _fit_on_train(spark, sf_dir, CATPCAReducer())


def q_mca_cohort(spark, sf_dir):
    return _fit_on_train(spark, sf_dir, MCAReducer())


def q_famd_hellinger_cohort(spark, sf_dir):
    return _fit_on_train(spark, sf_dir, build_pipeline("famd_hellinger"))


def q_parallel_pca_hellinger(spark, sf_dir):
    pipe = build_pipeline({"mode": "parallel", "keep_original_numeric": True,
                           "methods": [{"type": "pca", "n_components": 3},
                                       {"type": "hellinger", "n_features": 4}]})
    return _fit_on_train(spark, sf_dir, pipe)


def q_pca_embeddings(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    dims = [F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(64)]
    wide = e.select("vec_id", "label", *dims)
    model = PCAReducer(variance_target=0.85).fit(wide, [f"e{i:02d}" for i in range(64)])
    return model.transform(wide, keep=["vec_id", "label"])


def q_lsa_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    model = LSAReducer(n_components=10).fit(d, "doc_id", "text")
    return model.transform(d, keep=["doc_id"])


def q_gram_entries(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    dims = [F.col("embedding")[i].cast("double") for i in range(64)]
    # Small blocks, so that the 64 columns make ten of them.
    _, _, blocks = gram_blocks(e, dims, block=16)
    return block_entries(blocks, 64, block=16).select("i", "j", F.round("value", 4).alias("value"))


QUERIES = {
    "gram_entries": q_gram_entries,
    "pca_cohort": q_pca_cohort,
    "famd_cohort": q_famd_cohort,
    "catpca_cohort": q_catpca_cohort,
    "mca_cohort": q_mca_cohort,
    "famd_hellinger_cohort": q_famd_hellinger_cohort,
    "parallel_pca_hellinger": q_parallel_pca_hellinger,
    "pca_embeddings": q_pca_embeddings,
    "lsa_documents": q_lsa_documents,
}

SQL: dict[str, str] = {
    "gram_entries": """
WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding[1:64])::DOUBLE AS v FROM embeddings)
SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 4) AS value FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
}
