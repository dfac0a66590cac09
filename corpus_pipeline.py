"""Documents to packed training sequences: each stage works on what its predecessor kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import dedup, packing, pii, quality, simhash
from quire.llm.common import documents
from quire.session import discard, ensure_checkpoint_dir
from quire.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by a mark; every document stays."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("simhash near-dedup", near_stage),
          ("pii", pii_stage), ("best-fit packing", packing_stage)]

#: SQL cannot express SimHash components, token ids or best-fit; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet in the shared folder and read again, and removed once the next one is written."""
    import uuid
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            discard(spark, f"{base}/{k - 1}")
    return docs
