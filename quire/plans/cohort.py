"""Labelled cohort assembly on the given parquet tables.

The labelled cohort is ``labels`` (one row per document, ``toxic`` as the
rare binary class); the instrument table is ``documents``, from which a
declarative spec derives numeric and coded features of the whole text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.assemble import assemble
from quire.functions.numeric import row_sum_min_count
from quire.plans.features import FeatureSpec, extract
from quire.sources.tables import read_table

KEY = "doc_id"
LABEL = "y"

DOCUMENT_SPECS = [
    FeatureSpec("n_chars", ("n_chars",), "numeric"),
    FeatureSpec("n_words", ("text",), "word_count"),
    FeatureSpec("n_lines", ("text",), "line_count"),
    FeatureSpec("yes_no_answer", ("text",), "yes_no"),
    FeatureSpec("paren_number", ("text",), "paren_number"),
    FeatureSpec("source_number", ("source",), "first_number"),
    FeatureSpec("lang_en", ("lang",), "flag", pattern="^en$"),
    FeatureSpec("has_digit", ("text",), "flag", pattern="[0-9]"),
    FeatureSpec("either_flag", (), "either", items=(("text",), ("source",))),
]

# number_total: row sum (null only when every item is null) of two extracted numbers.
DERIVED = ["number_total"]
FEATURES = [s.name for s in DOCUMENT_SPECS] + DERIVED


def labelled_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y) for labelled documents; the label filter keeps y ∈ {0, 1}."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias(LABEL)) \
        .where(F.col(LABEL).isin(0, 1))


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = extract(docs, DOCUMENT_SPECS, KEY)
    return out.withColumn("number_total",
                          row_sum_min_count([F.col("paren_number"), F.col("source_number")]))


def cohort_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, features…) — the cohort left-joined with the instrument table."""
    return assemble(labelled_cohort(spark, sf_dir), [document_features(spark, sf_dir)], KEY)
