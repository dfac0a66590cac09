"""Free-text answer coders as native Column expressions.

Each coder reproduces a bilingual (English/French) answer coding: a value is
lower-cased (null → '') and searched with unanchored regular expressions; when
several patterns match, the documented precedence decides. All coders are
``when`` chains over ``rlike`` — JVM-side and inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer patterns that must equal the coding rules being reproduced.
YES_PATTERN = "yes|oui"
# "no" as a whole word, or "non" anywhere. The word boundary is spelled out with
# Unicode letter/number classes so the JVM and other regex engines agree.
WORD_EDGE_L = r"(^|[^\p{L}\p{N}_])"
WORD_EDGE_R = r"($|[^\p{L}\p{N}_])"
NO_PATTERN = WORD_EDGE_L + "no" + WORD_EDGE_R + "|non"
NO_PATTERN_STRICT = WORD_EDGE_L + "(no|non)" + WORD_EDGE_R
ADMINISTERED_PATTERN = "yes|oui|complet"
ADMINISTERED_FRAGMENTS = [("completed", "rempli"), ("administered",), ("complete",)]
MALE_PATTERN = "male|masculin"
FEMALE_PATTERN = "female|féminin"
BOTH_SIDES_PATTERN = "both|deux"
ONE_SIDE_PATTERN = "left|right|côté"
UNCERTAIN_PATTERN = "uncertain|incertain"
NORMAL_PATTERN = "normal"
MCI_PATTERN = "mci|mild cognitive"
DEMENTIA_PATTERN = "dementia|démence"
PAREN_NUMBER_PATTERN = r"\((\d+\.?\d*)\)"
FIRST_NUMBER_PATTERN = r"(\d+\.?\d*)"
TARGET_LABELS = {
    "PD (Parkinson's Disease)/(Maladie de Parkinson)": 0,
    "AP (Atypical Parkinsonism)/(Parkinsonisme Atypique)": 1,
}


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def yes_no(c: Column, strict: bool = False) -> Column:
    """yes/oui → 1.0, then no/non → 0.0 (a 'no' match wins), else null."""
    s = _text(c)
    no = NO_PATTERN_STRICT if strict else NO_PATTERN
    return (F.when(s.rlike(no), F.lit(0.0))
            .when(s.rlike(YES_PATTERN), F.lit(1.0))
            .otherwise(F.lit(None).cast("double")))


def administered_flag(c: Column | None) -> Column:
    """1.0 if the completion column says yes/oui/complet, else 0.0; no column → 0.0."""
    if c is None:
        return F.lit(0.0)
    return _text(c).rlike(ADMINISTERED_PATTERN).cast("double")


def sex_male(c: Column) -> Column:
    s = _text(c)
    female = s.rlike(FEMALE_PATTERN)
    return (F.when(s.rlike(MALE_PATTERN) & ~female, F.lit(1.0))
            .when(female, F.lit(0.0))
            .otherwise(F.lit(None).cast("double")))


def laterality(c: Column) -> Column:
    s = _text(c)
    return (F.when(s.rlike(BOTH_SIDES_PATTERN), F.lit(1.0))
            .when(s.rlike(ONE_SIDE_PATTERN), F.lit(0.0))
            .otherwise(F.lit(None).cast("double")))


def three_level_response(c: Column) -> Column:
    """yes → 1, no → 0, uncertain → 0.5; the later rule wins when several match."""
    s = _text(c)
    return (F.when(s.rlike(UNCERTAIN_PATTERN), F.lit(0.5))
            .when(s.rlike(NO_PATTERN), F.lit(0.0))
            .when(s.rlike(YES_PATTERN), F.lit(1.0))
            .otherwise(F.lit(None).cast("double")))


def cognitive_status(c: Column) -> Column:
    """normal → 0, MCI → 1, dementia → 2; the later rule wins."""
    s = _text(c)
    return (F.when(s.rlike(DEMENTIA_PATTERN), F.lit(2.0))
            .when(s.rlike(MCI_PATTERN), F.lit(1.0))
            .when(s.rlike(NORMAL_PATTERN), F.lit(0.0))
            .otherwise(F.lit(None).cast("double")))


def _extract_number(c: Column, pattern: str) -> Column:
    raw = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), pattern, 1)
    return F.nullif(raw, F.lit("")).try_cast("double")


def number_in_parentheses(c: Column) -> Column:
    """'(2) Bilateral …' → 2.0; no match → null."""
    return _extract_number(c, PAREN_NUMBER_PATTERN)


def first_number(c: Column) -> Column:
    """First unsigned decimal number in the text, else null."""
    return _extract_number(c, FIRST_NUMBER_PATTERN)


def label_map(c: Column, mapping: dict[str, int] | None = None) -> Column:
    """Exact-string map to an integer label; unmapped values → null."""
    mapping = TARGET_LABELS if mapping is None else mapping
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(None).cast("int")) if expr is not None else F.lit(None).cast("int")


def either_flag(a: Column | None, b: Column | None) -> Column:
    """(a = 1 or b = 1) as 1.0/0.0; null only when both are null. Absent side = 0.0."""
    a = F.lit(0.0) if a is None else a
    b = F.lit(0.0) if b is None else b
    hit = (a.eqNullSafe(F.lit(1.0)) | b.eqNullSafe(F.lit(1.0))).cast("double")
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("double")).otherwise(hit)
