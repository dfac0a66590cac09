"""Text features: tokens, n-grams, TF-IDF, vector truncation.

TF-IDF follows the usual smooth-idf definition: raw term counts per document,
idf = ln((1 + n) / (1 + df)) + 1, each document vector L2-normalised.
Vocabulary: all terms in at least ``min_df`` documents; a caller may keep only the
``max_features`` most frequent in the corpus (ties by term). It is joined by term
without a hint, so its size is not limited. Tokens are runs of two
or more Unicode letters, digits or '_', lower-cased, over the whole text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.grams import block_tfidf
from quire.operators.joins import spread_join
from quire.session import ensure_checkpoint_dir

#: Characters of the texts of one part, whose terms a task counts.
PART_CHARS = 4_000_000
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def term_counts(df: DataFrame, key: str, text: str, ngram_max: int = 2) -> DataFrame:
    """(key, term, tf): unigrams and bigrams of each document, counted per (document, term).

    Bigrams pair each token with the next one: the token array is zipped with
    itself shifted by one and exploded (generated code, no per-element
    lambdas); each zipped pair yields its unigram and, unless it is the last
    token, its bigram.
    """
    # Documents move to their key once, before their terms are spelt out; counting and norms then need no shuffle of terms.
    # A text's terms take many times its size: the number of parts follows the texts, and parts are not merged again.
    docs = df.where(quote(key).isNotNull()).select(quote(key).alias(key), quote(text).alias("_x"))
    toks = docs.repartition(text_parts(docs, "_x"), key).select(key, tokens(F.col("_x")).alias("_t"))
    if ngram_max >= 2:
        t = F.col("_t")
        zipped = F.arrays_zip(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1)))) \
            .cast("array<struct<cur:string,nxt:string>>")
        pairs = toks.select(key, F.explode(zipped).alias("_z"))
        first, nxt = F.col("_z.cur"), F.col("_z.nxt")
        grams = pairs.select(key, F.explode(F.array(first, F.concat(first, F.lit(" "), nxt))).alias("term")) \
            .where(F.col("term").isNotNull())
    else:
        grams = toks.select(key, F.explode("_t").alias("term"))
    return grams.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def text_parts(df: DataFrame, text: str) -> int:
    """Parts that hold about ``PART_CHARS`` characters each, at least as many as a shuffle makes."""
    chars = df.agg(F.sum(F.length(quote(text)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))


def vocabulary(tc: DataFrame, key: str, min_df: int = 3, max_features: int | None = None) -> DataFrame:
    """(term, df, corpus_tf) kept by document frequency and corpus-frequency rank."""
    v = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf")) \
        .where(F.col("df") >= min_df)
    if max_features is not None:
        v = v.orderBy(F.desc("corpus_tf"), F.asc("term")).limit(max_features)
    return v


def weighted(tc: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, term, tf, idf, raw): counts times idf; terms that a large share of the documents hold are not shuffled."""
    return spread_join(tc, idf, "term", "df").withColumn("raw", F.col("tf") * F.col("idf")).drop("df")


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 3, max_features: int | None = None,
          ngram_max: int = 2) -> DataFrame:
    """(key, term, tfidf) — sparse long form of the L2-normalised TF-IDF matrix.

    The whole vocabulary is weighed by blocks of documents; one cut to ``max_features`` is joined by term.
    """
    if max_features is None:
        return block_tfidf(df, key, text, min_df, ngram_max)
    tc = term_counts(df, key, text, ngram_max)
    n_docs = df.select(quote(key)).where(quote(key).isNotNull()).distinct().count()
    vocab = vocabulary(tc, key, min_df, max_features)
    ensure_checkpoint_dir(df.sparkSession)
    idf = vocab.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")).checkpoint()
    w = weighted(tc, idf)
    # per-document L2 norm as a window over the document's own terms
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("raw") / norm).alias("tfidf"))


def truncate_normalise(v: Column, dims: int) -> Column:
    """First ``dims`` coordinates, L2-normalised (zero vectors stay zero)."""
    head = F.slice(v, 1, dims)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(head, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
