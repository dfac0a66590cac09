"""Text columns as categories: Hellinger scores, FAMD and MCA matrices, indicators, codes and modes, with SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import categories as C
from quire.operators.hellinger import hellinger_scores
from quire.operators.profile import impute_most_frequent, one_hot
from quire.operators.reducers.catpca import CATPCAReducer
from quire.operators.reducers.famd import FAMDReducer
from quire.operators.reducers.mca import MCAReducer
from quire.operators.target_stats import ordered_target_means
from quire.plans.cohort import KEY, LABEL, labelled_cohort
from quire.sources.tables import read_table

TEXTS = ["lang", "source"]


def _labelled(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(KEY, "lang", "source", "n_chars")
    return labelled_cohort(spark, sf_dir).join(docs, KEY)


def _long(df: DataFrame, ids: list[str], name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.round(F.col(f"`{c}`"), 6).alias("value")) for c in df.columns if c not in ids])
    return df.select(*ids, F.inline(pairs))


def q_hellinger_mixed(spark, sf_dir):
    scored = hellinger_scores(_labelled(spark, sf_dir), ["lang", "n_chars", "source"], LABEL)
    return scored.select("feature", "kind", F.round("h_score", 6).alias("h_score"), F.col("h_rank").cast("bigint").alias("h_rank"))


def q_famd_matrix(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where(F.col("n_chars").isNotNull())
    model = FAMDReducer(n_components=2).fit(docs, ["n_chars", *TEXTS])
    return _long(model.matrix(docs, [KEY]), [KEY], "input")


def q_mca_matrix(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    inputs, _, products = MCAReducer().residuals(docs, TEXTS)
    names = [C.indicator_name(*x) for x in inputs]
    rows = [(a, b, round(float(products[i, j]), 6) + 0.0) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "a string, b string, value double")


def q_onehot_text(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    # Fitted on finished orders only: statuses unseen there have no indicator.
    fitted = {c: [v for v, _ in vals] for c, vals in C.categories(orders.where("o_orderstatus = 'F'"), ["o_orderstatus", "o_orderpriority"]).items()}
    return _long(one_hot(orders, fitted), ["o_orderkey"], "indicator")


def q_text_codes(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(KEY, *TEXTS)
    # The codes are learned from the labelled documents; values that only others have are unseen.
    known = C.value_dictionary(docs.join(read_table(spark, sf_dir, "labels").select(KEY).distinct(), KEY, "left_semi"), TEXTS)
    return C.encode(docs, known, TEXTS).select(KEY, *[F.col(c).cast("bigint").alias(c) for c in TEXTS])


def q_text_dictionary(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part")
    return C.value_dictionary(parts, ["p_name", "p_brand", "p_type"]).select("column", "value", F.col("code").cast("bigint").alias("code"), "n")


def q_text_modes(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 50_000, F.col("o_orderpriority")))
    modes = C.text_modes(orders, ["o_orderpriority", "o_orderstatus"])
    return impute_most_frequent(orders, list(modes), modes).groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def q_catpca_one_step(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = CATPCAReducer(n_components=1, max_iter=1).fit(docs, TEXTS)
    rows = [(c, v, round(float(q), 6) + 0.0) for c, vals in model.quantifications.items() for v, q in vals.items()]
    return spark.createDataFrame(rows, "column string, value string, quantification double")


def q_ordered_target_statistics(spark, sf_dir):
    out = ordered_target_means(_labelled(spark, sf_dir), TEXTS, LABEL, KEY)
    return out.select(KEY, *[F.round(f"{c}_target", 6).alias(f"{c}_target") for c in TEXTS])


QUERIES = {
    "catpca_one_step": q_catpca_one_step,
    "ordered_target_statistics": q_ordered_target_statistics,
    "hellinger_mixed": q_hellinger_mixed,
    "famd_matrix": q_famd_matrix,
    "mca_matrix": q_mca_matrix,
    "onehot_text": q_onehot_text,
    "text_codes": q_text_codes,
    "text_dictionary": q_text_dictionary,
    "text_modes": q_text_modes,
}

_INDICATORS = """cells AS (SELECT doc_id, 'lang=' || lang AS input, 'lang' AS "column" FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, 'source=' || source, 'source' FROM documents WHERE source IS NOT NULL)"""

SQL = {
    "catpca_one_step": """
WITH l AS (SELECT lang AS v, row_number() OVER (ORDER BY lang) - 1 AS c FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
s AS (SELECT source AS v, row_number() OVER (ORDER BY source) - 1 AS c FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
x AS (SELECT d.lang, d.source, coalesce(l.c, 0)::DOUBLE AS a, coalesce(s.c, 0)::DOUBLE AS b
  FROM documents d LEFT JOIN l ON l.v = d.lang LEFT JOIN s ON s.v = d.source),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, sign(covar_pop(a, b)) AS r FROM x),
z AS (SELECT lang, source, ((a - ma) / sa + CASE WHEN r < 0 THEN -1 ELSE 1 END * (b - mb) / sb) / sqrt(2.0) AS score FROM x, m)
SELECT 'lang' AS "column", lang AS value, round(avg(score), 6) + 0.0 AS quantification FROM z WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'source', source, round(avg(score), 6) + 0.0 FROM z WHERE source IS NOT NULL GROUP BY source""",
    "ordered_target_statistics": """
WITH c AS (SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS y, d.lang, d.source, md5(concat_ws('|', '42', 'order', CAST(l.doc_id AS VARCHAR))) AS h
  FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IN (0, 1)),
p AS (SELECT avg(y::DOUBLE) AS prior FROM c)
SELECT doc_id,
  round((coalesce(sum(y) OVER lw, 0) + prior) / (count(y) OVER lw + 1), 6) AS lang_target,
  round((coalesce(sum(y) OVER sw, 0) + prior) / (count(y) OVER sw + 1), 6) AS source_target
FROM c, p WINDOW lw AS (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  sw AS (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "hellinger_mixed": """
WITH c AS (SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS y, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS x
  FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IN (0, 1)),
b AS (SELECT min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS nd FROM c),
g AS (SELECT *, least(floor((x - lo) / (hi - lo) * 10::DOUBLE), 9) AS guess FROM c, b WHERE x IS NOT NULL),
d AS (SELECT *, CASE WHEN x < guess * ((hi - lo) / 10::DOUBLE) + lo THEN guess - 1 ELSE guess END AS down FROM g),
u AS (SELECT *, CASE WHEN down < 9 AND x >= (CASE WHEN down + 1 >= 10 THEN hi ELSE (down + 1) * ((hi - lo) / 10::DOUBLE) + lo END)
  THEN down + 1 ELSE down END AS bin FROM d),
cells AS (
  SELECT 'n_chars' AS feature, CAST(CASE WHEN nd <= 10 THEN x ELSE bin END AS VARCHAR) AS cell, y FROM u
  UNION ALL SELECT 'lang', lang, y FROM c WHERE lang IS NOT NULL
  UNION ALL SELECT 'source', source, y FROM c WHERE source IS NOT NULL),
n AS (SELECT feature, cell, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM cells GROUP BY ALL),
s AS (SELECT feature, sum(c0) AS s0, sum(c1) AS s1 FROM n GROUP BY feature),
h AS (SELECT feature, sqrt(sum(pow(sqrt(c0 / (s0 + 1e-12)) - sqrt(c1 / (s1 + 1e-12)), 2))) / sqrt(2.0) AS h FROM n JOIN s USING (feature) GROUP BY feature)
SELECT feature, CASE WHEN feature = 'n_chars' AND (SELECT nd FROM b) > 10 THEN 'numeric' ELSE 'categorical' END AS kind, round(h, 6) AS h_score,
  row_number() OVER (ORDER BY round(h, 10) DESC, feature) AS h_rank FROM h""",
    "famd_matrix": f"""
WITH documents AS (SELECT * FROM documents WHERE n_chars IS NOT NULL), {_INDICATORS},
n AS (SELECT count(*) AS n, avg(n_chars) AS mean, stddev_pop(n_chars) AS sd FROM documents),
p AS (SELECT input, greatest(least(count(*) / n, 1 - 1e-6), 1e-6) AS p FROM cells, n GROUP BY input, n)
SELECT doc_id, 'n_chars' AS input, round((n_chars - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS value FROM documents, n
UNION ALL
SELECT d.doc_id, p.input, round(CASE WHEN c.input IS NULL THEN 0 ELSE 1 / sqrt(p.p) / sqrt(2.0) END, 6)
FROM documents d CROSS JOIN p LEFT JOIN cells c ON c.doc_id = d.doc_id AND c.input = p.input""",
    "mca_matrix": f"""
WITH {_INDICATORS}, n AS (SELECT count(*)::DOUBLE AS n FROM documents),
s AS (SELECT input, count(*)::DOUBLE AS s FROM cells GROUP BY input),
g AS (SELECT a.input AS a, b.input AS b, count(*)::DOUBLE AS g FROM cells a JOIN cells b USING (doc_id) GROUP BY ALL)
SELECT a.input AS a, b.input AS b, round((n * coalesce(g.g, 0) / pow(2 * n, 2) - (a.s / (2 * n)) * (b.s / (2 * n)))
  / sqrt((a.s / (2 * n)) * (b.s / (2 * n))), 6) + 0.0 AS value
FROM s a CROSS JOIN s b CROSS JOIN n LEFT JOIN g ON g.a = a.input AND g.b = b.input""",
    "onehot_text": """
WITH f AS (SELECT DISTINCT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, c || '=' || v AS indicator,
  CAST(coalesce(CASE c WHEN 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END = v, false) AS DOUBLE) AS value
FROM orders CROSS JOIN f WHERE v IS NOT NULL""",
    "text_codes": """
WITH k AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM k WHERE lang IS NOT NULL)),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM k WHERE source IS NOT NULL))
SELECT d.doc_id, CASE WHEN d.lang IS NOT NULL THEN coalesce(l.code, -1) END AS lang, CASE WHEN d.source IS NOT NULL THEN coalesce(s.code, -1) END AS source
FROM documents d LEFT JOIN l ON l.lang = d.lang LEFT JOIN s ON s.source = d.source""",
    "text_dictionary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("p_name", "p_brand", "p_type")),
    "text_modes": """
WITH o AS (SELECT CASE WHEN o_totalprice > 50000 THEN o_orderpriority END AS p, o_orderstatus AS s FROM orders),
m AS (SELECT (SELECT p FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) AS p,
  (SELECT s FROM o WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) AS s)
SELECT coalesce(o.p, m.p) AS o_orderpriority, coalesce(o.s, m.s) AS o_orderstatus, count(*) AS n FROM o, m GROUP BY ALL""",
}
