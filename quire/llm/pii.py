"""Personal data by bootstrapped contextual extraction (built-in functions only).

Base kinds (email, ip, card, phone) are found in every whole text by pattern
and validity check; these spans are always returned and serve as seeds. The
bootstrapping step looks at all identifier-like tokens (holding a digit or @; numbers
written in groups are one token) together with the two words before them. Patterns are
those word pairs, instances are the tokens; their graph is one row per (pattern, instance) with a count.
Rounds alternate: a pattern's confidence is the smoothed share of its occurrences whose
instance is known, weighted by the instances' confidence; a seed's is 1, another instance's the best of
its trusted patterns'. Patterns with ``MIN_CONFIDENCE`` and ``MIN_SEEDS`` distinct known
instances, seeds or revealed by patterns trusted earlier, become trusted and keep the confidence
of that round; rounds end when no pattern is added. Trusted patterns reveal unseen
identifiers wherever they occur, as spans of kind ``context``.

Offsets count code points, ends are exclusive. A match's place is the sum of
the lengths of what split() leaves before it and of the earlier matches; these sums are taken in chunks
of ``CHUNK`` matches and then over the chunks, so a text of a million numbers is no square of work. Arrays that a
later expression reads element by element first pass through explode() of one row, which keeps the
optimizer from computing them anew for each element.
``\\G`` guards let a pattern start only at the start of a run of its characters or where
the last match ended: the same matches, without retrying at each character of
a long run. Possessive groups keep the JVM's matcher from recursing.

Defined results: null text is empty (no spans); a text without spans has the
digest of the empty text; repeated rows get the same answer; an empty table
gives no rows; null ids are kept; other columns are never read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, stable, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
GUARDS = {"email": "@", "ip": PATTERNS["ip"], "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: A number written in groups that single spaces part, or a token that holds a digit or @.
CONTEXT = (r"(?<=^|[\x20\x09-\x0D])(?:[+(]{0,2}[0-9]++(?:-[0-9]++)*+\)?"
           r"(?:\x20\(?[0-9]++(?:-[0-9]++)*+\)?(?=$|[\x20\x09-\x0D]|[.,;:!?](?:$|[\x20\x09-\x0D])))++"
           r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)")
MIN_CONFIDENCE, MIN_SEEDS = 0.8, 5
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
_TEXTS = "array<string>"
#: Elements of an array that are summed one after the other.
CHUNK = 128


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later expressions read them."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_p_made")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_p_made.{k}").alias(k) for k in columns])


def _running(values: str, join) -> Column:
    """Running values of a settled int array under ``join`` (sum or maximum, of numbers >= 0)."""
    def within(part):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(
            acc["out"], F.array(join(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda i: within(F.slice(values, i * CHUNK + 1, CHUNK)))
    before = F.concat(F.array(F.lit(0)), within(F.transform(chunks, lambda c: F.element_at(c, -1))))
    summed = F.flatten(F.zip_with(chunks, F.slice(before, 1, F.size(before) - 1), lambda c, o: F.transform(c, lambda x: join(x, o))))
    return F.when(F.size(values) > 0, summed).otherwise(F.array().cast("array<int>"))


def _add(a: Column, b: Column) -> Column:
    return a + b


def with_matches(df: DataFrame, patterns: dict[str, tuple[str, str]], text: str = "_p_text") -> DataFrame:
    """For each name and its (pattern, guard): ``_g_<name>`` (text before each match), ``_h_<name>`` (matches), ``_e_<name>`` (their ends).

    A text without a guard's match has none.
    """
    t, none = F.col(text), F.array().cast(_TEXTS)
    cuts = {}
    for k, (pattern, guard) in patterns.items():
        cuts[f"_h_{k}"] = F.when(t.rlike(guard), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
        cuts[f"_s_{k}"] = F.when(t.rlike(guard), F.split(t, pattern, -1)).otherwise(none)
    df = _settled(df, **cuts)
    lengths = {f"_l_{k}": F.zip_with(F.slice(f"_s_{k}", 1, F.size(f"_h_{k}")), f"_h_{k}", lambda g, h: F.length(g) + F.length(h)) for k in patterns}
    df = _settled(df, **lengths, **{f"_g_{k}": F.slice(f"_s_{k}", 1, F.size(f"_h_{k}")) for k in patterns})
    df = _settled(df, **{f"_e_{k}": _running(f"_l_{k}", _add) for k in patterns})
    return df.drop(*[f"_{c}_{k}" for k in patterns for c in "sl"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(F.split(F.translate(v, " -", ""), ""))
    one = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    if kind == "card":
        n = F.length(F.translate(v, " -", ""))
        return n.between(16, 19) & F.when(n.between(16, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda span: _valid(kind, span["value"])


def _spans(name: str, kind: int) -> Column:
    """(kind, start, end, value) of all matches."""
    return F.zip_with(f"_h_{name}", f"_e_{name}", lambda h, e: F.struct(
        F.lit(kind).alias("kind"), (e - F.length(h)).alias("start"), e.alias("end"), h.alias("value")))


def with_base(docs: DataFrame, context: bool = False) -> DataFrame:
    """Adds ``_p_text`` and one array of valid spans for each base kind (``_p_email``...); with ``context`` the matches of CONTEXT too."""
    df = docs.withColumn("_p_text", text_or_empty("text"))
    wanted = {k: (PATTERNS[k], GUARDS[k]) for k in KINDS} | ({"context": (CONTEXT, "[0-9@]")} if context else {})
    df = with_matches(df, wanted)
    df = _settled(df, **{f"_p_{k}": F.filter(_spans(k, i), _checker(k)) for i, k in enumerate(KINDS)})
    return df.drop(*[f"_{c}_{k}" for k in KINDS for c in "ghe"])


def with_tokens(based: DataFrame) -> DataFrame:
    """Adds ``_p_tokens``: identifier-like tokens (start, end, value, pattern, known).

    The pattern is the two words before (lower case, one space). Between two tokens may stand
    fewer words; then words of the tokens before count, and with two tokens back two are always there.
    """
    low = lambda name: F.transform(name, ascii_lower)
    gap, hit = low("_g_context"), low("_h_context")
    back = lambda c, k: F.slice(F.concat(F.array_repeat(F.lit(""), k), c), 1, F.size("_h_context"))
    before = F.transform(F.arrays_zip(back(hit, 2).alias("h2"), back(gap, 1).alias("g1"), back(hit, 1).alias("h1"), gap.alias("g")),
                         lambda x: F.concat(x["h2"], F.lit(" "), x["g1"], x["h1"], x["g"]))
    words = F.transform(before, lambda t: F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), F.filter(
        F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")), -2, 2), " "))
    seeds = F.sort_array(F.transform(F.concat(*[F.col(f"_p_{k}") for k in KINDS]), lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"))))
    df = _settled(based, _p_words=words, _p_seeds=seeds, _l_end=F.transform(seeds, lambda b: b["end"]))
    # Of the seeds that start before a token's end the one that reaches farthest overlaps the token, if any does.
    df = _settled(df, _far=_running("_l_end", F.greatest))
    df = _settled(df, _l_at=F.transform(F.arrays_zip("_l_end", "_far"), lambda x, i: F.when(x["_l_end"] == x["_far"], i).otherwise(0)))
    df = _settled(df, _at=_running("_l_at", F.greatest))
    # Token ends and seed starts in one order: the seeds before each token's end are counted on the way.
    event = lambda place, seed: F.struct(place.alias("place"), F.lit(seed).alias("seed"))
    order = F.sort_array(F.concat(F.transform("_e_context", lambda e: event(e, 0)), F.transform("_p_seeds", lambda b: event(b["start"], 1))))
    df = _settled(df, _order=F.when((F.size("_p_seeds") > 0) & (F.size("_e_context") > 0), order).otherwise(F.array().cast("array<struct<place:int,seed:int>>")))
    df = _settled(df, _l_seed=F.transform("_order", lambda x: x["seed"]))
    counted = F.filter(F.arrays_zip(F.col("_l_seed").alias("seed"), _running("_l_seed", _add).alias("n")), lambda x: x["seed"] == 0)
    df = _settled(df, _n=F.transform(counted, lambda x: x["n"]))
    raw = F.arrays_zip(F.col("_h_context").alias("value"), F.col("_e_context").alias("end"), F.col("_p_words").alias("words"), F.col("_n").alias("n"))

    def token(s):
        start = s["end"] - F.length(s["value"])
        far = F.get("_p_seeds", F.get("_at", s["n"] - 1))
        seed = F.when((s["n"] > 0) & (far["end"] > start), far)
        # A seed is one instance with its whole value; only its first token has a pattern.
        return F.struct(start.alias("start"), s["end"].alias("end"), F.coalesce(seed["value"], s["value"]).alias("value"),
                        F.when(~F.startswith(s["words"], F.lit(" ")) & F.coalesce(start <= seed["start"], F.lit(True)), s["words"]).alias("pattern"),
                        seed.isNotNull().alias("known"))

    return df.withColumn("_p_tokens", F.transform(raw, token)).drop(
        "_p_words", "_p_seeds", "_g_context", "_h_context", "_e_context", "_l_end", "_far", "_l_at", "_at", "_order", "_l_seed", "_n")


def patterns(tokens: DataFrame) -> DataFrame:
    """Trusted patterns (pattern), from all (pattern, value, known) rows."""
    graph = stable(tokens.where("pattern is not null").groupBy("pattern", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("known").cast("double")).alias("belief")))
    # An instance seen as a seed anywhere is a seed everywhere.
    seeds = graph.groupBy("value").agg(F.max("belief").alias("seed")).where("seed > 0")
    graph = stable(graph.join(seeds, "value", "left").select("pattern", "value", "n", F.coalesce("seed", F.lit(0.0)).alias("seed")))
    trusted = None
    while True:
        known = graph.withColumn("belief", F.col("seed")) if trusted is None else graph.join(
            graph.join(trusted, "pattern").groupBy("value").agg(F.max("confidence").alias("lift")), "value", "left").select(
            "pattern", "value", "n", F.greatest("seed", F.coalesce("lift", F.lit(0.0))).alias("belief"))
        scored = known.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("belief")) / (F.sum("n") + 1)).alias("confidence"),
            F.count_if(F.col("belief") >= MIN_CONFIDENCE).alias("support")).where(
            (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SEEDS)).select("pattern", "confidence")
        added = stable(scored if trusted is None else scored.join(trusted, "pattern", "left_anti"))
        if added.isEmpty():
            return (added if trusted is None else trusted).select("pattern")
        trusted = added if trusted is None else stable(trusted.unionByName(added))


def scanned(docs: DataFrame) -> DataFrame:
    """(id, key, base spans, identifier-like tokens) of every row, written once and without texts; ``key`` is a hash of the text."""
    df = with_base(docs.select(F.col("doc_id").alias("id"), "text"), context=True).withColumn("key", F.xxhash64("_p_text")).drop("text", "_p_text")
    return stable(with_tokens(df).select("id", "key", *[f"_p_{k}" for k in KINDS], "_p_tokens"))


def context_spans(rows: DataFrame) -> DataFrame:
    """(_p_id, _p_key, _p_context) of unseen identifiers that trusted patterns reveal; few rows."""
    tokens = rows.select("id", "key", F.explode("_p_tokens").alias("t")).select("id", "key", "t.*")
    trusted = patterns(tokens.select("pattern", "value", "known"))
    hits = tokens.where(~F.col("known")).join(trusted, "pattern", "left_semi")
    return stable(hits.groupBy(F.col("id").alias("_p_id"), F.col("key").alias("_p_key")).agg(F.sort_array(F.collect_set(F.struct(
        F.lit(len(KINDS)).alias("kind"), "start", "end", "value"))).alias("_p_context")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "context"]])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _with_context(rows: DataFrame, found: DataFrame, key: Column) -> DataFrame:
    ident = rows["id"] if "id" in rows.columns else rows["doc_id"]
    joined = rows.join(found, ident.eqNullSafe(found["_p_id"]) & (key == found["_p_key"]), "left")
    return joined.withColumn("_p_context", F.coalesce("_p_context", F.array().cast(_SPAN)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans (kind:start:end by kind, then start)."""
    rows = scanned(docs)
    df = _with_context(rows, context_spans(rows), F.col("key"))
    base = F.concat(*[F.col(f"_p_{k}") for k in KINDS])
    return df.select(F.col("id").alias("doc_id"), *[F.size(f"_p_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                     F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                     _listed(F.concat(base, F.col("_p_context"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span (overlapping or adjoining ones merged) replaced by ``[PII]``; a null text stays null.

    Only texts with a digit or @ can hold a span: the others pass straight through, without a join.
    """
    found = context_spans(scanned(docs))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    df = _with_context(with_base(docs.where(may)), found, F.xxhash64("_p_text")).drop("_p_id", "_p_key")
    spans = F.sort_array(F.transform(F.concat(*[F.col(f"_p_{k}") for k in KINDS], F.col("_p_context")), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"))))
    df = _settled(df, _p_all=spans).drop(*[f"_p_{k}" for k in KINDS], "_p_context")
    some = F.size("_p_all") > 0
    df = _settled(df, _p_chars=F.when(some, F.split("_p_text", "")).otherwise(F.array().cast(_TEXTS)), _l_end=F.transform("_p_all", lambda s: s["end"]))
    df = _settled(df, _p_far=_running("_l_end", F.greatest))
    text = lambda start, end: F.array_join(F.slice("_p_chars", start + 1, F.greatest(end - start, F.lit(0))), "")
    before = F.slice(F.concat(F.array(F.lit(0)), "_p_far"), 1, F.size("_p_far"))
    marks = F.transform(F.arrays_zip(F.col("_p_all").alias("s"), before.alias("to")), lambda x, i: F.when(
        (i == 0) | (x["s"]["start"] > x["to"]), F.concat(text(x["to"], x["s"]["start"]), F.lit("[PII]"))).otherwise(F.lit("")))
    last = F.element_at("_p_far", -1)
    clean = F.when(some, F.concat(F.array_join(marks, ""), text(last, F.length("_p_text")))).otherwise(F.col("text"))
    return df.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~may))


def op9_pii(spark, sf_dir) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
