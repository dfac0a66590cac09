"""Registered cohort queries: assembly, coding, dedupe, split, fit statistics, Hellinger.

Each ``q_*`` takes (spark, sf_dir) and returns a DataFrame over the given
tables; ``SQL`` holds the equivalent DuckDB statement (views named after the
tables) used as the correctness oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.coders import NO_PATTERN
from quire.operators.assemble import assemble
from quire.operators.dedupe import first_per_key
from quire.operators.hellinger import hellinger_scores, histogram_bin
from quire.operators.preprocess import Preprocessor, impute_columns, train_medians
from quire.operators.profile import (exact_medians, missingness, moments, to_long,
                                     value_frequencies)
from quire.operators.split import stratified_folds, stratified_split
from quire.plans.cohort import FEATURES, KEY, LABEL, cohort_features
from quire.sources.tables import read_table

SEED = 42
TEST_SIZE = 0.2


# --------------------------------------------------------------------------- Spark side

def split_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(cohort_features(spark, sf_dir), KEY, LABEL, TEST_SIZE, SEED)


def train_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_cohort(spark, sf_dir).where(~F.col("is_test")).drop("is_test")


def q_cohort_features(spark, sf_dir):
    return cohort_features(spark, sf_dir)


def q_first_order_per_customer(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    out = first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.drop("o_orderdate")


def customer_tables(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    cohort = customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    urgent = (orders.where(F.col("o_orderpriority") == "1-URGENT")
              .groupBy(F.col("o_custkey").alias("key"))
              .agg(F.count(F.lit(1)).cast("double").alias("n_urgent"),
                   F.round(F.avg("o_totalprice"), 6).alias("avg_urgent_price")))
    first = first_per_key(orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority",
                                        "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    first = first.select(F.col("o_custkey").alias("key"),
                         F.regexp_extract("o_orderpriority", r"(\d+\.?\d*)", 1).cast("double")
                         .alias("first_priority"),
                         F.col("o_totalprice").alias("first_price"))
    # A second "cohort" of the urgent table: same columns, rows of the high priority orders.
    high = (orders.where(F.col("o_orderpriority") == "2-HIGH")
            .groupBy(F.col("o_custkey").alias("key"))
            .agg(F.count(F.lit(1)).cast("double").alias("n_urgent"),
                 F.round(F.avg("o_totalprice"), 6).alias("avg_urgent_price")))
    return cohort, urgent, first, high


def q_customer_assembly(spark, sf_dir):
    cohort, urgent, first, high = customer_tables(spark, sf_dir)
    return assemble(cohort, [urgent, first, high], "key", on_conflict="first_table")


def q_customer_assembly_coalesce(spark, sf_dir):
    cohort, urgent, first, high = customer_tables(spark, sf_dir)
    return assemble(cohort, [urgent, first, high], "key", on_conflict="coalesce")


def q_split_assignment(spark, sf_dir):
    return split_cohort(spark, sf_dir).select(KEY, LABEL, "is_test")


def q_split_class_counts(spark, sf_dir):
    return (split_cohort(spark, sf_dir)
            .groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("part"), LABEL)
            .agg(F.count(F.lit(1)).alias("n")))


def q_fold_counts(spark, sf_dir):
    folds = stratified_folds(train_part(spark, sf_dir), KEY, LABEL, k=5, seed=SEED)
    return folds.groupBy("fold", LABEL).agg(F.count(F.lit(1)).alias("n"))


def q_fold_assignment(spark, sf_dir):
    folds = stratified_folds(train_part(spark, sf_dir), KEY, LABEL, k=5, seed=SEED)
    return folds.select(KEY, LABEL, "fold")


def q_cohort_missingness(spark, sf_dir):
    m = missingness(cohort_features(spark, sf_dir), FEATURES)
    return m.select("column", F.round("missing_fraction", 6).alias("missing_fraction"))


def q_train_medians(spark, sf_dir):
    med = train_medians(train_part(spark, sf_dir), FEATURES)
    rows = [(c, float(v)) for c, v in med.items() if v is not None]
    return spark.createDataFrame(rows, "column string, median double")


def q_train_medians_full(spark, sf_dir):
    """The same medians from the full value-frequency table (no bracketing)."""
    freq = value_frequencies(train_part(spark, sf_dir), FEATURES)
    return exact_medians(freq, n_columns=len(FEATURES)).where(F.col("median").isNotNull())


def imputed_train(spark, sf_dir):
    train = train_part(spark, sf_dir)
    med = train_medians(train, FEATURES)
    fills = {c: v for c, v in med.items() if v is not None}
    return train.select(KEY, LABEL, *impute_columns(train, fills)), list(fills)


def q_train_moments(spark, sf_dir):
    imp, cols = imputed_train(spark, sf_dir)
    return moments(imp, cols).select("column", "n", F.round("mean", 6).alias("mean"),
                                     F.round("sd", 6).alias("sd"))


def q_preprocessed_train(spark, sf_dir):
    train = train_part(spark, sf_dir)
    model = Preprocessor().fit(train, FEATURES, LABEL)
    pre = model.transform_preprocessed(train, keep=[KEY, LABEL])
    return to_long(pre, model.features, [KEY]).select(KEY, "column", F.round("value", 6).alias("value"))


def q_preprocessed_test(spark, sf_dir):
    split = split_cohort(spark, sf_dir)
    train = split.where(~F.col("is_test"))
    test = split.where(F.col("is_test"))
    model = Preprocessor().fit(train, FEATURES, LABEL)
    pre = model.transform_preprocessed(test, keep=[KEY, LABEL])
    return to_long(pre, model.features, [KEY]).select(KEY, "column", F.round("value", 6).alias("value"))


def q_hellinger_ranking(spark, sf_dir):
    imp, cols = imputed_train(spark, sf_dir)
    h = hellinger_scores(imp, cols, LABEL, n_bins=10, categorical_threshold=10)
    return h.select("feature", "kind", F.round("h_score", 6).alias("h_score"),
                    F.col("h_rank").cast("bigint").alias("h_rank"))


def q_histogram_by_class(spark, sf_dir):
    imp, cols = imputed_train(spark, sf_dir)
    freq = value_frequencies(imp, cols, LABEL).where(F.col("value").isNotNull())
    summ = freq.groupBy("column").agg(F.count("value").alias("nd"), F.min("value").alias("lo"),
                                      F.max("value").alias("hi"))
    j = freq.join(F.broadcast(summ), "column").where(F.col("nd") > 10)
    b = histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), 10).cast("bigint")
    return (j.groupBy("column", b.alias("bin"))
            .agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1")))


def q_category_frequency_by_class(spark, sf_dir):
    imp, cols = imputed_train(spark, sf_dir)
    freq = value_frequencies(imp, cols, LABEL).where(F.col("value").isNotNull())
    nd = freq.groupBy("column").agg(F.count("value").alias("nd"))
    return (freq.join(F.broadcast(nd), "column").where(F.col("nd") <= 10)
            .select("column", "value", "n_0", "n_1"))


QUERIES = {
    "cohort_features": q_cohort_features,
    "first_order_per_customer": q_first_order_per_customer,
    "customer_assembly": q_customer_assembly,
    "customer_assembly_coalesce": q_customer_assembly_coalesce,
    "split_assignment": q_split_assignment,
    "split_class_counts": q_split_class_counts,
    "fold_counts": q_fold_counts,
    "fold_assignment": q_fold_assignment,
    "cohort_missingness": q_cohort_missingness,
    "train_medians": q_train_medians,
    "train_medians_full": q_train_medians_full,
    "train_moments": q_train_moments,
    "preprocessed_train": q_preprocessed_train,
    "preprocessed_test": q_preprocessed_test,
    "hellinger_ranking": q_hellinger_ranking,
    "histogram_by_class": q_histogram_by_class,
    "category_frequency_by_class": q_category_frequency_by_class,
}


# --------------------------------------------------------------------------- DuckDB oracle

def _yn(x: str) -> str:
    s = f"lower(coalesce({x}, ''))"
    return (f"CAST(CASE WHEN regexp_matches({s}, '{NO_PATTERN}') THEN 0 "
            f"WHEN regexp_matches({s}, 'yes|oui') THEN 1 END AS DOUBLE)")


DOCF = rf"""
docb AS (
  SELECT doc_id,
    CAST(n_chars AS DOUBLE) AS n_chars,
    CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS DOUBLE) AS n_words,
    CAST(len(string_split(coalesce(text, ''), chr(10))) AS DOUBLE) AS n_lines,
    {_yn('text')} AS yes_no_answer,
    TRY_CAST(nullif(regexp_extract(coalesce(text, ''), '\((\d+\.?\d*)\)', 1), '') AS DOUBLE) AS paren_number,
    TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '(\d+\.?\d*)', 1), '') AS DOUBLE) AS source_number,
    CAST(regexp_matches(lower(coalesce(lang, '')), '^en$') AS DOUBLE) AS lang_en,
    CAST(regexp_matches(lower(coalesce(text, '')), '[0-9]') AS DOUBLE) AS has_digit,
    {_yn('text')} AS _a,
    {_yn('source')} AS _b
  FROM documents WHERE doc_id IS NOT NULL),
docf AS (
  SELECT * EXCLUDE (_a, _b),
    CASE WHEN _a IS NULL AND _b IS NULL THEN NULL
         ELSE CAST(coalesce(_a = 1, false) OR coalesce(_b = 1, false) AS DOUBLE) END AS either_flag,
    CASE WHEN coalesce(paren_number, source_number) IS NOT NULL
         THEN coalesce(paren_number, 0) + coalesce(source_number, 0) END AS number_total
  FROM docb),
cohort AS (
  SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS y, d.* EXCLUDE (doc_id)
  FROM labels l LEFT JOIN docf d ON l.doc_id = d.doc_id
  WHERE l.toxic IN (0, 1) AND l.doc_id IS NOT NULL)"""

SPLIT = rf"""{DOCF},
counts AS (SELECT y, count(*) AS n FROM cohort GROUP BY y),
tot AS (SELECT sum(n) AS big_n, ceil({TEST_SIZE}::DOUBLE * sum(n)) AS n_test FROM counts),
alloc AS (
  SELECT y, n, CAST(n AS DOUBLE) / big_n * (big_n - n_test) AS cont,
         floor(CAST(n AS DOUBLE) / big_n * (big_n - n_test)) AS fl, big_n - n_test AS n_train
  FROM counts, tot),
need AS (SELECT max(n_train) - sum(fl) AS need FROM alloc),
ranked AS (SELECT alloc.*, row_number() OVER (ORDER BY cont - fl DESC, y) AS r FROM alloc),
quota AS (SELECT y, n - (fl + CASE WHEN r <= (SELECT need FROM need) THEN 1 ELSE 0 END) AS q FROM ranked),
hashed AS (
  SELECT cohort.*, row_number() OVER (
    PARTITION BY y ORDER BY md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR))), doc_id) AS rn
  FROM cohort),
split AS (SELECT hashed.* EXCLUDE (rn), rn <= q AS is_test FROM hashed JOIN quota USING (y)),
train AS (SELECT * EXCLUDE (is_test) FROM split WHERE NOT is_test)"""

FEATURE_LIST = ", ".join(FEATURES)
POSITIONS = ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATURES))

IMPUTED = rf"""{SPLIT},
train_long AS (
  SELECT * FROM (SELECT doc_id, y, {FEATURE_LIST} FROM train)
  UNPIVOT (value FOR "column" IN ({FEATURE_LIST}))),
med AS (SELECT "column", median(value) AS median FROM train_long GROUP BY "column"),
train_long_all AS (
  SELECT * FROM (SELECT doc_id, y, {FEATURE_LIST} FROM train)
  UNPIVOT INCLUDE NULLS (value FOR "column" IN ({FEATURE_LIST}))),
imp AS (
  SELECT t.doc_id, t.y, t."column", coalesce(t.value, m.median) AS value
  FROM train_long_all t JOIN med m USING ("column") WHERE m.median IS NOT NULL)"""

HELLINGER = rf"""{IMPUTED},
summ AS (
  SELECT "column", count(DISTINCT value) AS nd, min(value) AS lo, max(value) AS hi,
         count(*) FILTER (WHERE y = 0) AS s0, count(*) FILTER (WHERE y = 1) AS s1
  FROM imp GROUP BY "column"),
g AS (
  SELECT i."column", i.y, i.value, s.nd, s.lo, s.hi,
    least(floor((i.value - s.lo) / (s.hi - s.lo) * 10::DOUBLE), 9) AS guess
  FROM imp i JOIN summ s USING ("column")),
d AS (
  SELECT *, CASE WHEN value < (CASE WHEN guess >= 10 THEN hi ELSE guess * ((hi - lo) / 10::DOUBLE) + lo END)
                 THEN guess - 1 ELSE guess END AS down
  FROM g),
u AS (
  SELECT *, CASE WHEN down < 9 AND value >= (CASE WHEN down + 1 >= 10 THEN hi
                                                  ELSE (down + 1) * ((hi - lo) / 10::DOUBLE) + lo END)
                 THEN down + 1 ELSE down END AS bin
  FROM d),
binned AS (SELECT "column", y, nd, value, CASE WHEN nd <= 10 THEN value ELSE bin END AS cell FROM u),
cells AS (
  SELECT "column", cell, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1
  FROM binned GROUP BY "column", cell),
per AS (
  SELECT c."column", s.nd, s.s0, s.s1,
    sum(pow(sqrt(c0 / (s.s0 + 1e-12)) - sqrt(c1 / (s.s1 + 1e-12)), 2)) AS ss
  FROM cells c JOIN summ s USING ("column") GROUP BY ALL),
pos AS (SELECT * FROM (VALUES {POSITIONS}) AS p("column", position)),
scored AS (
  SELECT p."column" AS feature, p.position,
    coalesce(CASE WHEN per.nd <= 10 THEN 'categorical' ELSE 'numeric' END, 'numeric') AS kind,
    coalesce(CASE WHEN per.s0 = 0 OR per.s1 = 0 THEN 0.0 ELSE sqrt(per.ss) / sqrt(2.0) END, 0.0) AS h
  FROM pos p LEFT JOIN per ON per."column" = p."column"
  WHERE p."column" IN (SELECT "column" FROM med WHERE median IS NOT NULL))"""

SQL = {
    "cohort_features": f"WITH {DOCF} SELECT * FROM cohort",
    "first_order_per_customer": """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
    "customer_assembly": r"""
WITH urgent AS (
  SELECT o_custkey AS key, CAST(count(*) AS DOUBLE) AS n_urgent, round(avg(o_totalprice), 6) AS avg_urgent_price
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
first AS (
  SELECT o_custkey AS key,
         TRY_CAST(nullif(regexp_extract(o_orderpriority, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS first_priority,
         o_totalprice AS first_price
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c.c_custkey AS key, c.c_mktsegment AS segment, u.n_urgent, u.avg_urgent_price,
       f.first_priority, f.first_price
FROM customer c LEFT JOIN urgent u ON u.key = c.c_custkey LEFT JOIN first f ON f.key = c.c_custkey
WHERE c.c_custkey IS NOT NULL""",
    "customer_assembly_coalesce": r"""
WITH urgent AS (
  SELECT o_custkey AS key, CAST(count(*) AS DOUBLE) AS n_urgent, round(avg(o_totalprice), 6) AS avg_urgent_price
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
high AS (
  SELECT o_custkey AS key, CAST(count(*) AS DOUBLE) AS n_urgent, round(avg(o_totalprice), 6) AS avg_urgent_price
  FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY o_custkey),
first AS (
  SELECT o_custkey AS key,
         TRY_CAST(nullif(regexp_extract(o_orderpriority, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS first_priority,
         o_totalprice AS first_price
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c.c_custkey AS key, c.c_mktsegment AS segment,
       coalesce(u.n_urgent, h.n_urgent) AS n_urgent,
       coalesce(u.avg_urgent_price, h.avg_urgent_price) AS avg_urgent_price,
       f.first_priority, f.first_price
FROM customer c LEFT JOIN urgent u ON u.key = c.c_custkey LEFT JOIN first f ON f.key = c.c_custkey
LEFT JOIN high h ON h.key = c.c_custkey
WHERE c.c_custkey IS NOT NULL""",
    "split_assignment": f"WITH {SPLIT} SELECT doc_id, y, is_test FROM split",
    "split_class_counts": f"""WITH {SPLIT}
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, y, count(*) AS n FROM split GROUP BY ALL""",
    "fold_counts": f"""WITH {SPLIT},
f AS (SELECT y, (row_number() OVER (PARTITION BY y ORDER BY
        md5(concat_ws('|', '{SEED}', 'fold', CAST(doc_id AS VARCHAR))), doc_id) - 1) % 5 AS fold FROM train)
SELECT CAST(fold AS INTEGER) AS fold, y, count(*) AS n FROM f GROUP BY ALL""",
    "fold_assignment": f"""WITH {SPLIT}
SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY
        md5(concat_ws('|', '{SEED}', 'fold', CAST(doc_id AS VARCHAR))), doc_id) - 1) % 5 AS INTEGER) AS fold
FROM train""",
    "cohort_missingness": f"""WITH {DOCF},
l AS (SELECT * FROM (SELECT doc_id, {FEATURE_LIST} FROM cohort)
      UNPIVOT INCLUDE NULLS (value FOR "column" IN ({FEATURE_LIST})))
SELECT "column", round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_fraction
FROM l GROUP BY "column" """,
    "train_medians": f"WITH {IMPUTED} SELECT \"column\", median FROM med WHERE median IS NOT NULL",
    "train_medians_full": f"WITH {IMPUTED} SELECT \"column\", median FROM med WHERE median IS NOT NULL",
    "train_moments": f"""WITH {IMPUTED}
SELECT "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd
FROM imp GROUP BY "column" """,
    "preprocessed_train": f"""WITH {IMPUTED},
mom AS (SELECT "column", avg(value) AS mean, stddev_pop(value) AS sd FROM imp GROUP BY "column")
SELECT i.doc_id, i."column",
  round((i.value - m.mean) / CASE WHEN m.sd IS NULL OR m.sd = 0 THEN 1.0 ELSE m.sd END, 6) AS value
FROM imp i JOIN mom m USING ("column")""",
    "preprocessed_test": f"""WITH {IMPUTED},
mom AS (SELECT "column", avg(value) AS mean, stddev_pop(value) AS sd FROM imp GROUP BY "column"),
test_long AS (
  SELECT * FROM (SELECT doc_id, y, {FEATURE_LIST} FROM split WHERE is_test)
  UNPIVOT INCLUDE NULLS (value FOR "column" IN ({FEATURE_LIST})))
SELECT t.doc_id, t."column",
  round((coalesce(t.value, md.median) - m.mean) / CASE WHEN m.sd IS NULL OR m.sd = 0 THEN 1.0 ELSE m.sd END, 6)
    AS value
FROM test_long t JOIN mom m USING ("column") JOIN med md USING ("column")""",
    "hellinger_ranking": f"""WITH {HELLINGER}
SELECT feature, kind, round(h, 6) AS h_score,
  CAST(row_number() OVER (ORDER BY round(h, 10) DESC, position) AS BIGINT) AS h_rank
FROM scored""",
    "histogram_by_class": f"""WITH {HELLINGER}
SELECT "column", CAST(bin AS BIGINT) AS bin, count(*) FILTER (WHERE y = 0) AS n_0,
       count(*) FILTER (WHERE y = 1) AS n_1
FROM u WHERE nd > 10 GROUP BY ALL""",
    "category_frequency_by_class": f"""WITH {HELLINGER}
SELECT "column", value, count(*) FILTER (WHERE y = 0) AS n_0, count(*) FILTER (WHERE y = 1) AS n_1
FROM binned WHERE nd <= 10 GROUP BY ALL""",
}
