"""Registered profiling, audit and text queries with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.operators import audit
from quire.operators.preprocess import Preprocessor, impute_columns, train_medians
from quire.operators.profile import (column_kinds, column_summary, columns_over_missing,
                                     missingness, table_summary, value_counts, value_frequencies)
from quire.operators.text import term_counts, tfidf, truncate_normalise, vocabulary
from quire.plans.cohort import FEATURES, KEY, LABEL, cohort_features
from quire.plans.cohort_queries import IMPUTED, SPLIT, customer_tables, train_part
from quire.operators.assemble import assemble
from quire.sources.tables import read_table

LINEITEM_COLS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
FAMILIES = {
    "length": ["n_"],
    "coded": ["yes_no", "either"],
    "numbers": ["paren_", "source_", "number_"],
    "flags": ["lang_", "has_"],
    "absent": ["zz_"],
}


def _sparse_lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") <= 2, F.col("l_quantity")).alias("qty_first_lines"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount_nonzero"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax_nonzero"),
        F.col("l_extendedprice").alias("price"))


SPARSE_COLS = ["qty_first_lines", "discount_nonzero", "tax_nonzero", "price"]


def q_value_counts_priority(spark, sf_dir):
    return value_counts(read_table(spark, sf_dir, "orders"), "o_orderpriority")


def q_value_counts_with_nulls(spark, sf_dir):
    return value_counts(cohort_features(spark, sf_dir), "yes_no_answer")


def q_column_kinds_lineitem(spark, sf_dir):
    k = column_kinds(read_table(spark, sf_dir, "lineitem"), LINEITEM_COLS, threshold=10)
    return k.select("column", F.col("n_distinct").cast("bigint").alias("n_distinct"), "kind")


def q_column_summary_lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    s = column_summary(value_frequencies(li, LINEITEM_COLS[:-1]))
    return s.select("column", "n_rows", "n_missing", F.col("n_distinct").cast("bigint").alias("n_distinct"),
                    "min_value", "max_value")


def q_table_summary(spark, sf_dir):
    cohort, urgent, first, high = customer_tables(spark, sf_dir)
    tables = {
        "cohort_features": cohort_features(spark, sf_dir).drop(LABEL),
        "customer_assembly": assemble(cohort, [urgent, first], "key"),
        "sparse_lineitem": _sparse_lineitem(spark, sf_dir).drop("l_orderkey"),
    }
    keys = {"cohort_features": KEY, "customer_assembly": "key", "sparse_lineitem": "l_linenumber"}
    parts = [table_summary({n: df}, key=keys[n]) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table", "n_rows", F.col("n_cols").cast("bigint").alias("n_cols"),
                      "cell_missing_pct", "n_high_missing")


def q_missingness_top(spark, sf_dir):
    m = missingness(_sparse_lineitem(spark, sf_dir), SPARSE_COLS)
    return (m.select("column", F.round("missing_fraction", 6).alias("missing_fraction"))
            .orderBy(F.desc("missing_fraction"), "column").limit(20))


def q_drop_sparse_columns(spark, sf_dir):
    df = _sparse_lineitem(spark, sf_dir)
    dropped = set(columns_over_missing(df, SPARSE_COLS, 0.65))
    kept = [c for c in SPARSE_COLS if c not in dropped]
    return df.select("l_orderkey", "l_linenumber", *kept)


def q_feature_audit(spark, sf_dir):
    return audit.feature_audit(cohort_features(spark, sf_dir), FAMILIES)


def q_imputed_cells(spark, sf_dir):
    train = train_part(spark, sf_dir)
    med = train_medians(train, FEATURES)
    fills = {c: v for c, v in med.items() if v is not None}
    after = train.select(KEY, *impute_columns(train, fills))
    cells = audit.imputed_cells(train, after, KEY, list(fills))
    return cells.where(F.col("n_imputed") > 0).orderBy(F.desc("n_imputed"), "column").limit(25)


def q_scaling_sanity(spark, sf_dir):
    train = train_part(spark, sf_dir)
    model = Preprocessor().fit(train, FEATURES, LABEL)
    pre = model.transform_preprocessed(train)
    s = audit.scaling_sanity(pre, model.features)
    # + 0.0 folds a rounded −0.0 to 0.0
    return s.select("column", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("sd", 6).alias("sd"),
                    "centred", "unit_sd")


def q_scree_embeddings(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    long = e.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    var = long.groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("var"))
    total = F.sum("var").over(Window.partitionBy())
    ratios = var.withColumn("ratio", F.col("var") / total) \
        .withColumn("order", F.struct(-F.round(F.col("ratio"), 12), F.col("dim")))
    t = audit.cumulative_variance(ratios, "order", "ratio", 0.85)
    return t.select(F.col("dim").cast("bigint").alias("dim"), "k", F.round("ratio", 6).alias("ratio"),
                    F.round("cumulative", 6).alias("cumulative"), "chosen_k")


def q_order_price_compare(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    recomputed = li.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("price"),
        F.count(F.lit(1)).cast("double").alias("n"))
    saved = o.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
                     F.lit(None).cast("double").alias("n"))
    return audit.compare_frames(saved, recomputed, "key", ["price", "n"], rtol=1e-2, atol=1.0)


def q_header_collisions(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return audit.header_collisions(p, "p_brand", "p_name").select(
        "p_brand", "normalised", F.col("n").cast("bigint").alias("n"))


def q_prefixed_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return audit.prefixed_names(p, "p_brand", "p_name", "p_partkey")


def q_row_documents(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return audit.row_documents(c, "c_custkey", ["c_mktsegment", "c_nationkey", "c_acctbal"])


def q_term_document_frequency(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    tc = term_counts(d, "doc_id", "text", 2)
    return vocabulary(tc, "doc_id", min_df=3).select(
        "term", "df", "corpus_tf")


def q_tfidf(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    t = tfidf(d, "doc_id", "text", min_df=3)
    return t.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


def q_embedding_truncation(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    t = e.select("vec_id", truncate_normalise(F.col("embedding"), 16).alias("v"))
    return t.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def q_dense_codes(spark, sf_dir):
    freq = value_frequencies(cohort_features(spark, sf_dir), FEATURES).where(F.col("value").isNotNull())
    nd = freq.groupBy("column").agg(F.count("value").alias("nd"))
    cat = freq.join(F.broadcast(nd), "column").where(F.col("nd") <= 10)
    w = Window.partitionBy("column").orderBy("value")
    return cat.select("column", "value", (F.dense_rank().over(w) - 1).cast("bigint").alias("code"))


def q_dummy_proportions(spark, sf_dir):
    freq = value_frequencies(cohort_features(spark, sf_dir), FEATURES).where(F.col("value").isNotNull())
    s = freq.groupBy("column").agg(F.count("value").alias("nd"), F.sum("n").alias("total"))
    j = freq.join(F.broadcast(s), "column").where(F.col("nd") <= 10)
    p = F.least(F.greatest(F.col("n") / F.col("total"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return j.select("column", "value", F.round(p, 6).alias("proportion"))


def q_summary_record(spark, sf_dir):
    from quire.operators.split import stratified_split
    s = stratified_split(cohort_features(spark, sf_dir), KEY, LABEL)
    return s.agg(
        F.lit("none").alias("dr_method"),
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"),
        F.count_if(~F.col("is_test") & (F.col(LABEL) == 1)).alias("ap_train"),
        F.count_if(F.col("is_test") & (F.col(LABEL) == 1)).alias("ap_test"),
        F.lit(len(FEATURES)).cast("bigint").alias("n_features_before_dr"),
        F.lit(len(FEATURES)).cast("bigint").alias("n_features_after_dr"),
        F.lit(5).cast("bigint").alias("cv_folds"),
        F.lit(0.0).alias("cumulative_variance_explained"))


QUERIES = {
    "value_counts_priority": q_value_counts_priority,
    "value_counts_with_nulls": q_value_counts_with_nulls,
    "column_kinds_lineitem": q_column_kinds_lineitem,
    "column_summary_lineitem": q_column_summary_lineitem,
    "table_summary": q_table_summary,
    "missingness_top": q_missingness_top,
    "drop_sparse_columns": q_drop_sparse_columns,
    "feature_audit": q_feature_audit,
    "imputed_cells": q_imputed_cells,
    "scaling_sanity": q_scaling_sanity,
    "scree_embeddings": q_scree_embeddings,
    "order_price_compare": q_order_price_compare,
    "header_collisions": q_header_collisions,
    "prefixed_names": q_prefixed_names,
    "row_documents": q_row_documents,
    "term_document_frequency": q_term_document_frequency,
    "tfidf": q_tfidf,
    "embedding_truncation": q_embedding_truncation,
    "dense_codes": q_dense_codes,
    "dummy_proportions": q_dummy_proportions,
    "summary_record": q_summary_record,
}

_DOCF = SPLIT.split(",\ncounts AS")[0]  # the cohort CTEs only
_FL = ", ".join(FEATURES)
_SPARSE = """sp AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber <= 2 THEN l_quantity END AS qty_first_lines,
         nullif(l_discount, 0.0) AS discount_nonzero, nullif(l_tax, 0.0) AS tax_nonzero,
         l_extendedprice AS price FROM lineitem)"""
_SP_MISS = """spm AS (
  SELECT * FROM (SELECT avg(CASE WHEN qty_first_lines IS NULL THEN 1.0 ELSE 0.0 END) AS qty_first_lines,
                        avg(CASE WHEN discount_nonzero IS NULL THEN 1.0 ELSE 0.0 END) AS discount_nonzero,
                        avg(CASE WHEN tax_nonzero IS NULL THEN 1.0 ELSE 0.0 END) AS tax_nonzero,
                        avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) AS price FROM sp)
  UNPIVOT (missing_fraction FOR "column" IN (qty_first_lines, discount_nonzero, tax_nonzero, price)))"""
_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_TERMS = f"""toks AS (SELECT doc_id, {_TOK} AS t FROM documents),
grams AS (
  SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) >= 2
      THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM toks),
tc AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS corpus_tf FROM tc GROUP BY term HAVING count(*) >= 3)"""


SQL = {
    "value_counts_priority": """
SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority""",
    "value_counts_with_nulls": f"""WITH {_DOCF}
SELECT yes_no_answer AS value, count(*) AS n FROM cohort GROUP BY yes_no_answer""",
    "column_kinds_lineitem": """
WITH l AS (SELECT * FROM (SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_extendedprice,
                                 l_discount, l_tax FROM lineitem)
           UNPIVOT (value FOR "column" IN (l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax)))
SELECT "column", count(DISTINCT value) AS n_distinct,
       CASE WHEN count(DISTINCT value) <= 10 THEN 'categorical' ELSE 'numeric' END AS kind
FROM l GROUP BY "column"
UNION ALL
SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'categorical' FROM lineitem""",
    "column_summary_lineitem": """
WITH l AS (SELECT * FROM (SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_extendedprice,
                                 l_discount, l_tax FROM lineitem)
           UNPIVOT INCLUDE NULLS (value FOR "column" IN (l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax)))
SELECT "column", count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_missing,
       count(DISTINCT value) AS n_distinct, min(value) AS min_value, max(value) AS max_value
FROM l GROUP BY "column" """,
    "table_summary": rf"""WITH {_DOCF}, {_SPARSE},
urgent AS (
  SELECT o_custkey AS key, CAST(count(*) AS DOUBLE) AS n_urgent, round(avg(o_totalprice), 6) AS avg_urgent_price
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
first AS (
  SELECT o_custkey AS key,
         TRY_CAST(nullif(regexp_extract(o_orderpriority, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS first_priority,
         o_totalprice AS first_price
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
ca AS (
  SELECT c.c_mktsegment AS segment, u.n_urgent, u.avg_urgent_price, f.first_priority, f.first_price
  FROM customer c LEFT JOIN urgent u ON u.key = c.c_custkey LEFT JOIN first f ON f.key = c.c_custkey),
cf AS (SELECT * FROM (SELECT {", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in FEATURES)}
                       FROM cohort) UNPIVOT (m FOR c IN ({_FL}))),
cam AS (SELECT * FROM (SELECT avg(CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END) AS segment,
                              avg(CASE WHEN n_urgent IS NULL THEN 1.0 ELSE 0.0 END) AS n_urgent,
                              avg(CASE WHEN avg_urgent_price IS NULL THEN 1.0 ELSE 0.0 END) AS avg_urgent_price,
                              avg(CASE WHEN first_priority IS NULL THEN 1.0 ELSE 0.0 END) AS first_priority,
                              avg(CASE WHEN first_price IS NULL THEN 1.0 ELSE 0.0 END) AS first_price FROM ca)
        UNPIVOT (m FOR c IN (segment, n_urgent, avg_urgent_price, first_priority, first_price))),
spm AS (SELECT * FROM (SELECT avg(CASE WHEN qty_first_lines IS NULL THEN 1.0 ELSE 0.0 END) AS qty_first_lines,
                        avg(CASE WHEN discount_nonzero IS NULL THEN 1.0 ELSE 0.0 END) AS discount_nonzero,
                        avg(CASE WHEN tax_nonzero IS NULL THEN 1.0 ELSE 0.0 END) AS tax_nonzero,
                        avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) AS price FROM sp)
        UNPIVOT (m FOR c IN (qty_first_lines, discount_nonzero, tax_nonzero, price)))
SELECT 'cohort_features' AS "table", (SELECT count(*) FROM cohort) AS n_rows, CAST({len(FEATURES)} AS BIGINT) AS n_cols,
       round(avg(m) * 100, 6) AS cell_missing_pct, count(*) FILTER (WHERE m >= 0.5) AS n_high_missing FROM cf
UNION ALL
SELECT 'customer_assembly', (SELECT count(*) FROM ca), 5, round(avg(m) * 100, 6), count(*) FILTER (WHERE m >= 0.5) FROM cam
UNION ALL
SELECT 'sparse_lineitem', (SELECT count(*) FROM sp), 4, round(avg(m) * 100, 6), count(*) FILTER (WHERE m >= 0.5) FROM spm""",
    "missingness_top": f"""WITH {_SPARSE}, {_SP_MISS}
SELECT "column", round(missing_fraction, 6) AS missing_fraction FROM spm
ORDER BY missing_fraction DESC, "column" LIMIT 20""",
    "drop_sparse_columns": f"""WITH {_SPARSE}
SELECT l_orderkey, l_linenumber, discount_nonzero, tax_nonzero, price FROM sp""",
    "feature_audit": f"""WITH {_DOCF}
SELECT 'length' AS family, CAST(3 AS BIGINT) AS n_features,
       count(*) FILTER (WHERE coalesce(n_chars, n_words, n_lines) IS NOT NULL) AS rows_with_data FROM cohort
UNION ALL SELECT 'coded', 2, count(*) FILTER (WHERE coalesce(yes_no_answer, either_flag) IS NOT NULL) FROM cohort
UNION ALL SELECT 'numbers', 3,
  count(*) FILTER (WHERE coalesce(paren_number, source_number, number_total) IS NOT NULL) FROM cohort
UNION ALL SELECT 'flags', 2, count(*) FILTER (WHERE coalesce(lang_en, has_digit) IS NOT NULL) FROM cohort
UNION ALL SELECT 'absent', 0, 0 FROM cohort LIMIT 5""",
    "imputed_cells": f"""WITH {IMPUTED},
tl AS (SELECT * FROM (SELECT doc_id, y, {_FL} FROM train) UNPIVOT INCLUDE NULLS (value FOR "column" IN ({_FL})))
SELECT tl."column", count(*) FILTER (WHERE tl.value IS NULL AND m.median IS NOT NULL) AS n_imputed
FROM tl JOIN med m USING ("column") WHERE m.median IS NOT NULL
GROUP BY tl."column" HAVING count(*) FILTER (WHERE tl.value IS NULL AND m.median IS NOT NULL) > 0
ORDER BY n_imputed DESC, "column" LIMIT 25""",
    "scaling_sanity": f"""WITH {IMPUTED},
mom AS (SELECT "column", avg(value) AS mean, stddev_pop(value) AS sd FROM imp GROUP BY "column"),
z AS (SELECT i."column", (i.value - m.mean) / CASE WHEN m.sd IS NULL OR m.sd = 0 THEN 1.0 ELSE m.sd END AS v
      FROM imp i JOIN mom m USING ("column")),
s AS (SELECT "column", avg(v) AS mean, stddev_pop(v) AS sd FROM z GROUP BY "column")
SELECT "column", round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, abs(mean) < 1e-6 AS centred,
       abs(sd - 1) < 1e-6 AS unit_sd FROM s""",
    "scree_embeddings": """
WITH l AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
v AS (SELECT dim, var_pop(CAST(x AS DOUBLE)) AS var FROM l GROUP BY dim),
r AS (SELECT dim, var / sum(var) OVER () AS ratio FROM v),
o AS (SELECT dim, ratio, row_number() OVER (ORDER BY -round(ratio, 12), dim) AS k FROM r),
c AS (SELECT *, sum(ratio) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM o)
SELECT CAST(dim AS BIGINT) AS dim, CAST(k AS BIGINT) AS k, round(ratio, 6) AS ratio, round(cumulative, 6) AS cumulative,
       CAST(coalesce(min(k) FILTER (WHERE cumulative >= 0.85) OVER (), count(*) OVER ()) AS BIGINT) AS chosen_k
FROM c""",
    "order_price_compare": """
WITH rec AS (
  SELECT l_orderkey AS key, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS price,
         CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_orderkey),
sav AS (SELECT o_orderkey AS key, o_totalprice AS price, CAST(NULL AS DOUBLE) AS n FROM orders),
j AS (SELECT s.key AS sk, r.key AS rk, s.price AS a0, r.price AS b0, s.n AS a1, r.n AS b1
      FROM sav s FULL OUTER JOIN rec r ON s.key = r.key),
agg AS (
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE rk IS NULL) AS n_only_left,
         count(*) FILTER (WHERE sk IS NULL) AS n_only_right,
         count(*) FILTER (WHERE sk IS NOT NULL AND rk IS NOT NULL AND NOT coalesce(
             (a0 IS NULL AND b0 IS NULL) OR abs(a0 - b0) <= 1.0 + 0.01 * abs(b0), false)) AS m0,
         count(*) FILTER (WHERE sk IS NOT NULL AND rk IS NOT NULL AND NOT coalesce(
             (a1 IS NULL AND b1 IS NULL) OR abs(a1 - b1) <= 1.0 + 0.01 * abs(b1), false)) AS m1
  FROM j)
SELECT n_rows, n_only_left, n_only_right, 'price' AS "column", m0 AS n_mismatch FROM agg
UNION ALL SELECT n_rows, n_only_left, n_only_right, 'n', m1 FROM agg""",
    "header_collisions": """
WITH h AS (SELECT p_brand, regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')
             AS normalised FROM part)
SELECT p_brand, normalised, count(*) AS n FROM h GROUP BY ALL HAVING count(*) > 1""",
    "prefixed_names": """
WITH h AS (SELECT p_brand, p_name, p_partkey,
    concat_ws('__', p_brand, regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g'))
      AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS rn FROM h)
SELECT p_brand, p_name, p_partkey,
       CASE WHEN rn = 1 THEN base ELSE base || '__dup' || CAST(rn AS VARCHAR) END AS feature_name FROM r""",
    "row_documents": """
SELECT c_custkey, concat_ws(' ', 'c_mktsegment=' || c_mktsegment, 'c_nationkey=' || CAST(c_nationkey AS VARCHAR),
                            'c_acctbal=' || CAST(c_acctbal AS VARCHAR)) AS document FROM customer""",
    "term_document_frequency": f"WITH {_TERMS} SELECT term, df, CAST(corpus_tf AS BIGINT) AS corpus_tf FROM vocab",
    "tfidf": f"""WITH {_TERMS},
nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE doc_id IS NOT NULL),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM nd)) / (1.0 + df)) + 1 AS idf FROM vocab),
w AS (SELECT tc.doc_id, tc.term, tc.tf * idf.idf AS raw FROM tc JOIN idf USING (term)),
nr AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, round(w.raw / nr.norm, 6) AS tfidf FROM w JOIN nr USING (doc_id)""",
    "embedding_truncation": """
WITH h AS (SELECT vec_id, embedding[1:16] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM h),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim, norm FROM n)
SELECT vec_id, CAST(dim AS BIGINT) AS dim,
       round(CASE WHEN norm > 0 THEN CAST(x AS DOUBLE) / norm ELSE 0.0 END, 6) AS value FROM u""",
    "dense_codes": f"""WITH {_DOCF},
l AS (SELECT * FROM (SELECT doc_id, {_FL} FROM cohort) UNPIVOT (value FOR "column" IN ({_FL}))),
d AS (SELECT DISTINCT "column", value FROM l),
nd AS (SELECT "column", count(*) AS nd FROM d GROUP BY "column")
SELECT d."column", d.value, CAST(dense_rank() OVER (PARTITION BY d."column" ORDER BY d.value) - 1 AS BIGINT) AS code
FROM d JOIN nd USING ("column") WHERE nd.nd <= 10""",
    "dummy_proportions": f"""WITH {_DOCF},
l AS (SELECT * FROM (SELECT doc_id, {_FL} FROM cohort) UNPIVOT (value FOR "column" IN ({_FL}))),
f AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT "column", count(*) AS nd, sum(n) AS total FROM f GROUP BY "column")
SELECT f."column", f.value, round(least(greatest(CAST(f.n AS DOUBLE) / s.total, 1e-6), 1 - 1e-6), 6) AS proportion
FROM f JOIN s USING ("column") WHERE s.nd <= 10""",
    "summary_record": f"""WITH {SPLIT}
SELECT 'none' AS dr_method, count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test,
       count(*) FILTER (WHERE NOT is_test AND y = 1) AS ap_train, count(*) FILTER (WHERE is_test AND y = 1) AS ap_test,
       CAST({len(FEATURES)} AS BIGINT) AS n_features_before_dr, CAST({len(FEATURES)} AS BIGINT) AS n_features_after_dr,
       CAST(5 AS BIGINT) AS cv_folds, 0.0::DOUBLE AS cumulative_variance_explained FROM split""",
}


def q_mode_imputation(spark, sf_dir):
    from quire.operators.profile import column_modes, impute_most_frequent, one_hot
    from quire.operators.reducers.base import kinds_and_categories
    train = train_part(spark, sf_dir)
    modes = {r["column"]: r["mode"] for r in column_modes(value_frequencies(train, FEATURES)).collect()}
    _, found = kinds_and_categories(train, FEATURES, 10)   # ≤ 10 values per column reach the driver
    cats = {c: [v for v, _ in vals] for c, vals in found.items()}
    filled = impute_most_frequent(train.select(KEY, *FEATURES), [c for c in FEATURES if c in cats], modes)
    coded = one_hot(filled.select(KEY, *cats), cats)
    long = [c for c in coded.columns if c != KEY]
    return coded.unpivot([KEY], long, "indicator", "value").groupBy("indicator").agg(
        F.sum("value").alias("n_ones"))


def q_target_counts(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    j = labels.join(docs, "doc_id")
    return j.groupBy(F.col("toxic").alias("binary_target"), F.col("quality").alias("subtype"),
                     F.col("source").alias("site")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["mode_imputation"] = q_mode_imputation
QUERIES["target_counts"] = q_target_counts

SQL["mode_imputation"] = f"""WITH {SPLIT},
tl AS (SELECT * FROM (SELECT doc_id, {_FL} FROM train) UNPIVOT INCLUDE NULLS (value FOR "column" IN ({_FL}))),
f AS (SELECT "column", value, count(*) AS n FROM tl WHERE value IS NOT NULL GROUP BY ALL),
nd AS (SELECT "column", count(*) AS nd FROM f GROUP BY "column"),
mode AS (SELECT "column", arg_min(value, struct_pack(a := -n, b := value)) AS mode FROM f GROUP BY "column"),
filled AS (SELECT tl.doc_id, tl."column", coalesce(tl.value, mode.mode) AS value
           FROM tl JOIN mode USING ("column") JOIN nd USING ("column") WHERE nd.nd <= 10),
cats AS (SELECT f."column", f.value FROM f JOIN nd USING ("column") WHERE nd.nd <= 10)
SELECT cats."column" || '=' || CASE WHEN cats.value = floor(cats.value) THEN CAST(CAST(cats.value AS BIGINT) AS VARCHAR)
                                    ELSE CAST(cats.value AS VARCHAR) END AS indicator,
       CAST(sum(CASE WHEN filled.value = cats.value THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS n_ones
FROM cats JOIN filled USING ("column") GROUP BY ALL"""
SQL["target_counts"] = """
SELECT l.toxic AS binary_target, l.quality AS subtype, d.source AS site, count(*) AS n
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY ALL"""
