"""Coders and instrument specifications on answer columns derived from the documents.

The study's exports are private, so every document stands for one participant and each question's answer is picked from
a fixed list by the document's id and length. The queries run the real coders and the real
specification of all instruments over these columns; the SQL spells both out again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import coders as C
from quire.functions.columns import leakage_columns
from quire.functions.numeric import NUMERIC_PATTERN, lenient_double, nan_to_zero
from quire.operators.profile import drop_all_null_columns
from quire.plans.clinical import DIAGNOSIS_WORDS, INSTRUMENTS, LEVELS, level_table
from quire.plans.features import FeatureSpec, extract
from quire.sources.tables import read_table

KEY = "doc_id"

# Answers of each kind of question.
ANSWERS: dict[str, list[str | None]] = {
    "yes_no": ["Yes/Oui", "No/Non", "Unknown/Inconnu", "yes, none", "say no.", "nobody", None, ""],
    "administered": ["Completed", "Incomplete", "no", "oui", None],
    "sex": ["Male/Masculin", "Female/Féminin", "female", "other", None],
    "laterality": ["Both sides", "Left", "un côté", "?", None],
    "three_level": ["Yes", "No", "Uncertain", "yes but uncertain", "non applicable", None],
    "cognitive": ["Normal", "MCI", "Dementia", "normal MCI", "démence", None],
    "paren_number": ["(2) Bilateral", "stage 3", "(1.5)", "(x)", None],
    "first_number": ["stage 3.5 of 5", "none", "2", "-4", None],
    "numeric": ["12", " 3.5 ", "abc", "1e2", "", None, "NaN", "1d", "-4", ".5"],
    "label": [*C.TARGET_LABELS, "HC", None],
}


def _pick(kind: str, place: int) -> Column:
    """The answer of a document to question number ``place``."""
    answers = F.array(*[F.lit(a).cast("string") for a in ANSWERS[kind]])
    at = F.pmod(F.col(KEY) * 7 + F.coalesce(F.col("n_chars"), F.lit(0)) + F.lit(place * 13), F.lit(len(ANSWERS[kind])))
    return F.get(answers, at.cast("int"))


def _quoted(a: str | None) -> str:
    return "NULL" if a is None else "'" + a.replace("'", "''") + "'"


def _pick_sql(kind: str, place: int) -> str:
    items = ", ".join(map(_quoted, ANSWERS[kind]))
    return f"([{items}]::VARCHAR[])[1 + (doc_id * 7 + coalesce(n_chars, 0) + {place * 13}) % {len(ANSWERS[kind])}]"


# --------------------------------------------------------------------------- coders

def _documents(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where(F.col(KEY).isNotNull())


CODER_COLUMNS = {
    "yes_no": ("yes_no", C.yes_no), "yes_no_strict": ("yes_no", lambda c: C.yes_no(c, strict=True)),
    "administered": ("administered", C.administered_flag), "sex_male": ("sex", C.sex_male), "laterality": ("laterality", C.laterality),
    "three_level": ("three_level", C.three_level_response), "cognitive": ("cognitive", C.cognitive_status),
    "paren_number": ("paren_number", C.number_in_parentheses), "first_number": ("first_number", C.first_number),
    "label": ("label", lambda c: C.label_map(c).cast("double")), "number": ("numeric", lenient_double),
    "ninth": ("numeric", lambda c: F.round(lenient_double(c) / 9, 6)),
}


def q_coders_all(spark, sf_dir):
    cols = [fn(_pick(kind, i)).alias(name) for i, (name, (kind, fn)) in enumerate(CODER_COLUMNS.items())]
    either = C.either_flag(C.yes_no(_pick("yes_no", 31)), C.yes_no(_pick("yes_no", 34)))
    return _documents(spark, sf_dir).select(KEY, *cols, either.alias("either"))


def _low(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({_low(x)}, '{pattern}')"


def _yes_no_sql(x: str, no: str = C.NO_PATTERN) -> str:
    return f"CAST(CASE WHEN {_match(x, no)} THEN 0 WHEN {_match(x, C.YES_PATTERN)} THEN 1 END AS DOUBLE)"


def _first_sql(x: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(coalesce({x}, ''), '{pattern}', 1), '') AS DOUBLE)"


def _number_sql(x: str) -> str:
    parsed = f"CASE WHEN regexp_matches(lower(trim({x})), '{NUMERIC_PATTERN}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"
    return f"CASE WHEN isnan({parsed}) THEN NULL ELSE {parsed} END"


CODER_SQL = {
    "yes_no": _yes_no_sql, "yes_no_strict": lambda x: _yes_no_sql(x, C.NO_PATTERN_STRICT),
    "administered": lambda x: f"CAST({_match(x, C.ADMINISTERED_PATTERN)} AS DOUBLE)",
    "sex_male": lambda x: f"CAST(CASE WHEN {_match(x, C.MALE_PATTERN)} AND NOT {_match(x, C.FEMALE_PATTERN)} THEN 1 WHEN {_match(x, C.FEMALE_PATTERN)} THEN 0 END AS DOUBLE)",
    "laterality": lambda x: f"CAST(CASE WHEN {_match(x, C.BOTH_SIDES_PATTERN)} THEN 1 WHEN {_match(x, C.ONE_SIDE_PATTERN)} THEN 0 END AS DOUBLE)",
    "three_level": lambda x: f"CAST(CASE WHEN {_match(x, C.UNCERTAIN_PATTERN)} THEN 0.5 WHEN {_match(x, C.NO_PATTERN)} THEN 0 WHEN {_match(x, C.YES_PATTERN)} THEN 1 END AS DOUBLE)",
    "cognitive": lambda x: f"CAST(CASE WHEN {_match(x, C.DEMENTIA_PATTERN)} THEN 2 WHEN {_match(x, C.MCI_PATTERN)} THEN 1 WHEN {_match(x, C.NORMAL_PATTERN)} THEN 0 END AS DOUBLE)",
    "paren_number": lambda x: _first_sql(x, C.PAREN_NUMBER_PATTERN), "first_number": lambda x: _first_sql(x, C.FIRST_NUMBER_PATTERN),
    "label": lambda x: "CAST(CASE " + " ".join(f"WHEN {x} = {_quoted(k)} THEN {v}" for k, v in C.TARGET_LABELS.items()) + " END AS DOUBLE)",
    "number": _number_sql, "ninth": lambda x: f"round({_number_sql(x)} / 9, 6)",
}


def _coders_sql() -> str:
    cols = [f"{CODER_SQL[name](_pick_sql(kind, i))} AS {name}" for i, (name, (kind, _)) in enumerate(CODER_COLUMNS.items())]
    a, b = (_yes_no_sql(_pick_sql("yes_no", p)) for p in (31, 34))
    either = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE CAST(coalesce({a} = 1, false) OR coalesce({b} = 1, false) AS DOUBLE) END AS either"
    return f"SELECT doc_id, {', '.join([*cols, either])} FROM documents WHERE doc_id IS NOT NULL"


# --------------------------------------------------------------------------- instruments

_KIND = {"numeric_typed": "numeric", "row_sum": "numeric", "fallback_div": "numeric", "either": "yes_no"}


def _questions(specs: list[FeatureSpec]) -> list[tuple[str, str]]:
    """(header, kind of answer) of an instrument's columns: each header holds the fragments it is found by."""
    out = []
    for s in specs:
        kind = _KIND.get(s.coder, s.coder)
        if s.coder == "administered":
            out.append((" / ".join(C.ADMINISTERED_FRAGMENTS[0]).title(), kind))
        for part in s.items or ((s.fallback or s.fragments,) if s.coder != "administered" else ()):
            out.append((" - ".join(part).capitalize(), kind))
    return out


def instrument_table(docs: DataFrame, specs: list[FeatureSpec], first: int) -> DataFrame:
    """One instrument's export: the key and a column of answers for each question (typed ones as numbers)."""
    typed = {" - ".join(s.fragments).capitalize() for s in specs if s.coder == "numeric_typed"}
    cols = []
    for i, (header, kind) in enumerate(_questions(specs)):
        answer = _pick(kind, first + i)
        cols.append((lenient_double(answer) if header in typed else answer).alias(header))
    return docs.select(KEY, *cols)


def q_clinical_spec_demo(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    parts, place = [], 0
    for file, specs in INSTRUMENTS:
        coded = extract(instrument_table(docs, specs, place), specs, KEY)
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("value")) for c in coded.columns if c != KEY])
        parts.append(coded.select(F.lit(file).alias("instrument"), KEY, F.inline(pairs)))
        place += len(_questions(specs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _feature_sql(s: FeatureSpec, places: list[str]) -> str:
    one = places[0] if places else ""
    if s.coder in ("numeric", "numeric_typed"):
        return _number_sql(one)
    if s.coder == "fallback_div":
        return f"{_number_sql(one)} / {s.divisor}"
    if s.coder == "row_sum":
        numbers = [_number_sql(p) for p in places]
        return f"CASE WHEN coalesce({', '.join(numbers)}) IS NOT NULL THEN {' + '.join(f'coalesce({n}, 0)' for n in numbers)} END"
    if s.coder == "either":
        a, b = map(_yes_no_sql, places)
        return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE CAST(coalesce({a} = 1, false) OR coalesce({b} = 1, false) AS DOUBLE) END"
    return CODER_SQL[{"sex": "sex_male"}.get(s.coder, s.coder)](one)


def _clinical_sql() -> str:
    parts, place = [], 0
    for file, specs in INSTRUMENTS:
        questions = _questions(specs)

        def answer(fragments):
            # The first header that holds all fragments is the one that counts.
            k = next(i for i, (header, _) in enumerate(questions) if all(f.lower() in header.lower() for f in fragments))
            return _pick_sql(questions[k][1], place + k)

        features = []
        for s in specs:
            wanted = [C.ADMINISTERED_FRAGMENTS[0]] if s.coder == "administered" else list(s.items) or [s.fallback or s.fragments]
            features.append(f"{{'feature': '{s.name}', 'value': round({_feature_sql(s, [answer(w) for w in wanted])}, 6)}}")
        place += len(questions)
        parts.append(f"SELECT '{file}' AS instrument, doc_id, unnest([{', '.join(features)}]) AS f FROM documents WHERE doc_id IS NOT NULL")
    return "SELECT instrument, doc_id, f.feature AS feature, f.value AS value FROM (" + " UNION ALL ".join(parts) + ")"


# --------------------------------------------------------------------------- levels, leakage, cleaning

TOP_LEVEL = 2


def q_features_by_level(spark, sf_dir):
    """What the instruments up to a level offer; the level table has one row for each instrument."""
    levels = F.broadcast(level_table(spark).where(F.col("level") <= TOP_LEVEL))
    return q_clinical_spec_demo(spark, sf_dir).join(levels, "instrument").groupBy("instrument", "level").agg(
        F.count_distinct("feature").alias("n_features"), F.count("value").alias("n_values"))


LEAKY = ["Diagnosis (PSP)", "MSA probable?", "Age", "Best set", "rbd_confirmed", "ET/tremor", "Planet"]


def q_leakage_removed(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    wide = docs.select(KEY, *[_pick("numeric", i).alias(c) for i, c in enumerate(LEAKY)])
    left = wide.drop(*leakage_columns(wide, DIAGNOSIS_WORDS))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in left.columns if c != KEY])
    return left.select(F.inline(pairs)).groupBy("column").agg(F.count("v").alias("n"))


def q_cleaned_features(spark, sf_dir):
    """All-null columns go, missing numbers become 0, and rows whose features are all 0 go."""
    docs = _documents(spark, sf_dir)
    numbers = [lenient_double(_pick("numeric", i)).alias(f"f{i}") for i in range(3)]
    wide = docs.select(KEY, *numbers, F.lit(None).cast("double").alias("empty"))
    kept = drop_all_null_columns(wide, ["f0", "f1", "f2", "empty"])
    features = [c for c in kept.columns if c != KEY]
    filled = kept.select(KEY, *[nan_to_zero(F.col(c)).alias(c) for c in features])
    return filled.where(F.greatest(*[F.abs(c) for c in features]) > 0)


QUERIES = {"coders_all": q_coders_all, "clinical_spec_demo": q_clinical_spec_demo, "features_by_level": q_features_by_level,
           "leakage_removed": q_leakage_removed, "cleaned_features": q_cleaned_features}
_LEVEL_ROWS = ", ".join(f"('{f}', {level})" for level, files in LEVELS.items() for f in files)
_NUMBERS = [f"coalesce({_number_sql(_pick_sql('numeric', i))}, 0)" for i in range(3)]
SQL = {
    "coders_all": _coders_sql(), "clinical_spec_demo": _clinical_sql(),
    "features_by_level": f"""WITH f AS ({_clinical_sql()}), l(instrument, level) AS (VALUES {_LEVEL_ROWS})
SELECT instrument, CAST(level AS INTEGER) AS level, count(DISTINCT feature) AS n_features, count(value) AS n_values
FROM f JOIN l USING (instrument) WHERE level <= {TOP_LEVEL} GROUP BY ALL""",
    "leakage_removed": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({_pick_sql('numeric', LEAKY.index(c))}) AS n FROM documents WHERE doc_id IS NOT NULL" for c in ("Age", "Best set", "Planet")),
    "cleaned_features": f"""SELECT * FROM (SELECT doc_id, {', '.join(f'{x} AS f{i}' for i, x in enumerate(_NUMBERS))} FROM documents WHERE doc_id IS NOT NULL)
WHERE greatest(abs(f0), abs(f1), abs(f2)) > 0""",
}
