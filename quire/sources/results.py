"""Result-set scan: per-method result folders → unioned DataFrames.

Layout: ``<root>/<method>/model_results.csv``, ``cv_results.csv`` and
``experiment_summary.json``. A method with any of the three missing is
reported and skipped. Rows gain ``method`` and, when a label map is given,
``method_label`` / ``model_label`` (a literal map lookup).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.csv import path_exists

FILES = ("model_results.csv", "cv_results.csv", "experiment_summary.json")


def _label(col: str, mapping: dict | None):
    if not mapping:
        return F.lit(None).cast("string")
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(col)]


def load_results(spark: SparkSession, root: str, methods: list[str],
                 method_labels: dict | None = None, model_labels: dict | None = None
                 ) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None, list[str]]:
    tests, cvs, sums, skipped = [], [], [], []
    for m in methods:
        paths = [f"{root.rstrip('/')}/{m}/{f}" for f in FILES]
        if not all(path_exists(spark, p) for p in paths):
            skipped.append(m)
            continue
        opts = dict(header="true", inferSchema="true")
        t = spark.read.options(**opts).csv(paths[0])
        c = spark.read.options(**opts).csv(paths[1])
        s = spark.read.option("multiLine", "true").json(paths[2])
        for df, bucket in ((t, tests), (c, cvs)):
            bucket.append(df.withColumn("method", F.lit(m))
                          .withColumn("method_label", _label("method", method_labels))
                          .withColumn("model_label", _label("model", model_labels)))
        sums.append(s.withColumn("method", F.lit(m)))

    def union(parts):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return union(tests), union(cvs), union(sums), skipped
