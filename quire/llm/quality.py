"""Quality rules with risk-controlled thresholds (built-in functions only).

Every text gets counts (words, symbols, repeated lines, words in repeated
five-word windows) and from them the rule scores of ``RULES``. For each stratum
(language) and rule a grid of cutoffs is tried on the labelled documents: with
n good documents of the stratum and k of them beyond the cutoff, the cutoff is
certified when the exact binomial tail P(Bin(n, risk) <= k) is at most
``alpha`` / (strata * rules * cutoffs) (Bonferroni) - so with probability
1 - alpha no certified cutoff rejects more than ``risk`` of the good documents.
Of the certified cutoffs the one that rejects most bad labelled documents is
used, if bad ones make up at least ``precision`` of the labelled documents it
rejects; else the rule stays off in that stratum. A document is rejected by the
fixed base rule or by any active cutoff of its stratum.

What reaches the driver is one row per stratum, rule and cutoff, for strata with
enough good labels to certify anything (n >= ln(alpha') / ln(1 - risk)).

Defined results: a null or empty text has no words and fails the base rule; a
null language is a stratum of its own; documents with several label rows count
once per distinct label, equal texts each (the bound takes labelled documents as independent, so
many labelled copies of one text make it optimistic); an empty table gives no rows; rows keep their number.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import read_table

from .common import SPACE_RUN, SPACES, documents, stable, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5
RISK, ALPHA, PRECISION = 0.01, 0.05, 0.9
#: rule -> score; a document lies beyond a cutoff when its score is larger.
RULES = {
    "symbol_share": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "long_words": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "short_words": lambda c: -c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "few_words": lambda c: -c("n_words").cast("double"),
}
#: Fixed cutoff grids of the rules.
GRID = {
    "symbol_share": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_share": [0.02, 0.05, 0.1, 0.15],
    "long_words": [8.0, 10.0, 12.0, 15.0],
    "short_words": [-4.0, -3.5, -3.0, -2.5, -2.0],
    "few_words": [-50.0, -40.0, -30.0, -20.0, -15.0],
}
_P = "_q_"


def _c(name: str) -> Column:
    return F.col(_P + name)


def with_stats(docs: DataFrame) -> DataFrame:
    """Adds the counts under reserved names (``_q_...``), so no column of the input can clash."""
    text = text_or_empty("text")
    blank = lambda c: F.translate(c, SPACES, "")
    df = docs.withColumn(_P + "words", F.filter(F.split(text, SPACE_RUN), lambda w: w != ""))
    df = df.withColumn(_P + "lines", F.filter(F.split(text, "\n"), lambda x: blank(x) != ""))
    words, lines = _c("words"), _c("lines")
    span = F.size(words) - (WINDOW - 1)
    shifted = [F.slice(words, k + 1, F.greatest(span, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    df = df.withColumn(_P + "hash", F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(s)))
    # Only texts with equal windows go on: these become neighbours once (hash, position) is sorted; nothing is exploded.
    placed = F.sort_array(F.transform(_c("hash"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(_P + "order", F.when((span > 1) & (F.size(F.array_distinct(_c("hash"))) < span), placed))
    n = F.size(_c("order"))
    pairs = F.arrays_zip(F.slice(_c("order"), 1, n - 1).alias("a"), F.slice(_c("order"), 2, n - 1).alias("b"))
    same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    df = df.withColumn(_P + "same", F.when(n > 1, same))
    at = F.array_distinct(F.concat(F.transform(_c("same"), lambda p: p["a"]["i"]), F.transform(_c("same"), lambda p: p["b"]["i"])))
    df = df.withColumn(_P + "at", F.when(F.size(_c("same")) > 0, F.sort_array(at)))
    steps = F.zip_with(F.slice(_c("at"), 1, F.size(_c("at")) - 1), F.slice(_c("at"), 2, F.size(_c("at")) - 1),
                       lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(blank(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.size(_c("same")) > 0, covered), F.lit(0).cast("long")),
    }
    df = df.select("*", *[v.alias(_P + k) for k, v in counts.items()])
    failed = (_c("n_words") < 10) | (100 * _c("n_repeat_words") > 20 * _c("n_words"))
    return df.withColumn(_P + "base_failed", failed).drop(*[_P + k for k in ("words", "lines", "hash", "order", "same", "at")])


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from the largest term down in log space."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0  # above the mean the tail is never small enough; no sum needed
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log) * total)


def select_cutoffs(counts: list[dict], strata: int, risk=RISK, alpha=ALPHA, precision=PRECISION) -> dict[tuple, float]:
    """(stratum, rule) -> cutoff, from rows with stratum, rule, cutoff, n_good, good_beyond, bad_beyond."""
    level = alpha / max(1, strata * sum(len(g) for g in GRID.values()))
    best: dict[tuple, tuple] = {}
    for r in counts:
        beyond = r["good_beyond"] + r["bad_beyond"]
        if not r["bad_beyond"] or r["bad_beyond"] < precision * beyond or binomial_tail(r["n_good"], r["good_beyond"], risk) > level:
            continue
        key, value = (r["stratum"], r["rule"]), (r["bad_beyond"], r["cutoff"])
        best[key] = max(best.get(key, value), value)
    return {k: v[1] for k, v in best.items()}


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang and the counts under reserved names) of every row, written once: narrow, without texts."""
    return stable(with_stats(docs.select("doc_id", "text", "lang")).drop("text"))


def cutoffs(stats: DataFrame, labels: DataFrame, risk=RISK, alpha=ALPHA, precision=PRECISION) -> dict[tuple, float]:
    """Certified cutoffs from all labelled documents of ``counted`` rows; no text crosses the join."""
    truth = labels.where("quality is not null").select(F.col("doc_id").alias("_q_id"), F.col("quality").alias("_q_good")).distinct()
    held = stats.withColumnRenamed("lang", "_q_stratum").join(truth, F.col("doc_id") == F.col("_q_id"))
    good = F.col("_q_good") == 1
    flags = [F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("cutoff"), (RULES[r](_c) > t).alias("beyond"))
             for r, grid in GRID.items() for t in grid]
    per = held.where(~_c("base_failed")).select("_q_stratum", good.alias("good"), F.explode(F.array(*flags)).alias("f"))
    table = per.groupBy("_q_stratum", "f.rule", "f.cutoff").agg(
        F.count_if("good").alias("n_good"), F.count_if(F.col("good") & F.col("f.beyond")).alias("good_beyond"),
        F.count_if(~F.col("good") & F.col("f.beyond")).alias("bad_beyond"))
    strata = max(1, stats.select("lang").distinct().count())
    enough = math.log(alpha / (strata * sum(len(g) for g in GRID.values()))) / math.log1p(-risk)
    rows = table.where((F.col("n_good") >= enough) & (F.col("bad_beyond") > 0)).withColumnRenamed("_q_stratum", "stratum").collect()
    return select_cutoffs([r.asDict() for r in rows], strata, risk, alpha, precision)


def verdict(chosen: dict[tuple, float]) -> Column:
    """Whether a document is kept; strata without a certified cutoff use the base rule alone."""
    rejected = _c("base_failed")
    for (stratum, rule), t in sorted(chosen.items(), key=str):
        rejected = rejected | (F.col("lang").eqNullSafe(F.lit(stratum)) & (RULES[rule](_c) > t))
    return ~rejected


def judge(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``."""
    stats = counted(docs)
    chosen = cutoffs(stats, labels, **risk)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return stats.select("doc_id", *[_c(n).alias(n) for n in names], verdict(chosen).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """The documents kept, with their own columns."""
    keep = verdict(cutoffs(counted(docs), labels, **risk))
    # explode() of null drops the row; a plain filter would be moved under the counts and repeat them.
    judged = with_stats(docs).select("*", F.explode(F.when(keep, F.array(F.lit(1)))).alias("_q_kept"))
    return judged.select(*[docs[c] for c in docs.columns])


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
