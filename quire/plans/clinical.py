"""Declarative instrument specification for the questionnaire cohort, and its loader.

Each instrument is a keyed CSV (``Project key``) with long bilingual headers;
features are located by header fragments and coded by the named coder. The
loader reads the enrolment table (label = exact group string, others
dropped), scans every present instrument (absent files are skipped), compiles
each spec list into one projection, left-joins new columns onto the cohort in
list order, and drops features that are null for every row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.coders import label_map
from quire.functions.columns import find_case_sensitive, leakage_columns, quote
from quire.operators.assemble import assemble
from quire.operators.profile import non_empty_columns
from quire.plans.features import FeatureSpec as S
from quire.plans.features import extract
from quire.sources.csv import read_keyed_csv

KEY = "project_key"
LABEL = "y"


def _adm(name):
    return S(name, (), "administered")


def _num(name, *frags):
    return S(name, frags, "numeric")


def _yn(name, *frags):
    return S(name, frags, "yes_no", optional=True)


# Instrument files, feature names, header fragments and coders.
DEMOGRAPHIC = [
    _num("age_at_visit", "age at study visit", "automatic"),
    _num("years_education", "years of education"),
    S("sex_male", ("gender",), "sex", optional=True),
    _yn("has_caregiver", "regular caregiver"),
]
CLINICAL = [
    _num("disease_duration_years", "current duration of disease", "years"),
    S("bilateral_onset", ("symptoms present on one side or both",), "laterality", optional=True),
    _yn("bilateral_now", "symptoms affect both sides"),
    _yn("falls_last_3mo", "fallen in the last 3 months"),
    _yn("freezing_of_gait", "freezing of gait", "14."),
    _yn("has_dyskinesia", "currently have dyskinesia"),
    S("hoehn_yahr", ("hoehn", "yahr rating"), "paren_number", optional=True),
    _yn("has_dementia", "does the patient have dementia"),
    _yn("gradual_progression", "motor symptoms progress gradually"),
    _yn("complete_remission", "complete remission"),
]
MEDICATION = [
    S("levodopa_response", ("significant reduction in symptoms", "dopaminergic"), "three_level", optional=True),
    _yn("levodopa_response_maintained", "improvement", "still present"),
    S("total_led_mg", ("total led",), "numeric", optional=True),
]
EPIDEMIOLOGY = [
    _yn("pesticide_exposure", "pesticides"),
    _yn("hyposmia", "sense of smell"),
    _yn("rem_sleep_disorder", "acting out your dreams"),
    _yn("constipation", "constipation", "5."),
    _yn("head_trauma", "blow to the head"),
    _yn("regular_exercise", "exercise on a regular basis"),
    _yn("orthostatic_dizziness", "light-headed or dizzy"),
    _yn("leg_restlessness", "irrepressible urge to move your legs"),
    S("family_hx_pd", (), "either", items=(("biological father", "parkinson"), ("biological mother", "parkinson"))),
]
MOCA = [
    _adm("moca_administered"),
    _num("moca_total", "total score", "extra point"),
    _num("moca_visuospatial", "visuospatial"),
    _num("moca_naming", "naming score"),
    _num("moca_attention", "attention score"),
    _num("moca_language", "language score"),
    _num("moca_abstraction", "abstraction score"),
    _num("moca_delayed_recall", "delayed recall score"),
    _num("moca_orientation", "orientation score"),
]
UPDRS = [
    _adm("updrs_administered"),
    _num("updrs_part1_nonmotor", "non-motor aspects"),
    _num("updrs_part2_motor_adl", "motor aspects"),
    _num("updrs_part3_motor_exam", "motor examination"),
    _num("updrs_part4_complications", "motor complications"),
    S("updrs_axial_score", (), "row_sum", items=(("updrs_3_9",), ("updrs_3_10",), ("updrs_3_11",),
                                                  ("updrs_3_12",), ("updrs_3_13",), ("updrs_3_14",))),
    S("updrs_tremor_score", (), "row_sum", items=(("updrs_3_15_r",), ("updrs_3_15_l",), ("updrs_3_16_r",),
                                                   ("updrs_3_16_l",), ("updrs_3_17_rue",), ("updrs_3_17_lue",),
                                                   ("updrs_3_17_rle",), ("updrs_3_17_lle",),
                                                   ("updrs_3_17_lipjaw",), ("updrs_3_18",))),
    S("updrs_hoehn_yahr", ("hoehn and yahr stage",), "first_number", optional=True),
]
UPDRS_LEGACY = [
    _adm("updrs_legacy_administered"),
    _num("updrs_legacy_total", "updrs total"),
    _num("updrs_tremor_total", "tremor total"),
    _num("updrs_rigidity_total", "rigidity total"),
    _num("updrs_laterality_index", "laterality index"),
]
APATHY = [_adm("apathy_administered"), _num("apathy_score", "apathy scale score")]
BAI = [_adm("bai_administered"), _num("bai_total", "bai total score")]
BDII = [_adm("bdii_administered"), _num("bdii_total", "bdi-ii total score")]
FSS = [_adm("fss_administered"),
       S("fss_score", ("divided by 9",), "fallback_div", fallback=("total of all questions",), divisor=9.0)]
PDQ8 = [_adm("pdq8_administered"), _num("pdq8_summary_index", "pdq-8 summary index")]
PDQ39 = [
    _adm("pdq39_administered"),
    _num("pdq39_summary_index", "pdq-39 summary index"),
    _num("pdq39_mobility", "mobility", "scale score"),
    _num("pdq39_adl", "activities of daily living", "scale score"),
    _num("pdq39_emotional", "emotional well being", "scale score"),
    _num("pdq39_stigma", "stigma", "scale score"),
    _num("pdq39_social_support", "social support", "scale score"),
    _num("pdq39_cognition", "cognition", "scale score"),
    _num("pdq39_communication", "communication", "scale score"),
    _num("pdq39_bodily_discomfort", "bodily discomfort", "scale score"),
]
SCOPA = [
    _adm("scopa_administered"),
    _num("scopa_total", "total score"),
    _num("scopa_gastrointestinal", "gastrointestinal dysfunction"),
    _num("scopa_urinary", "urinary dysfunction"),
    _num("scopa_cardiovascular", "cardiovascular dysfunction"),
    _num("scopa_thermoregulatory", "thermoregulatory dysfunction"),
]
TUG = [_adm("tug_administered"), S("tug_seconds", ("secondes",), "numeric_typed")]
PAS = [_adm("pas_administered"), _num("pas_score", "pas score")]
SCHWAB = [_adm("schwab_england_administered"), _num("schwab_england_score", "score")]
EHI = [_adm("ehi_administered"), _num("ehi_handedness_score", "ehi handedness score")]
MBIC = [
    _adm("mbic_administered"),
    _num("mbic_grand_total", "grand total"),
    _num("mbic_motivation", "motivation"),
    _num("mbic_mood_anxiety", "mood"),
    _num("mbic_impulse", "impulsivity"),
    _num("mbic_social", "societal"),
    _num("mbic_beliefs", "beliefs"),
]
NEUROPSYCH = [
    _adm("neuropsych_administered"),
    _num("neuropsych_global_z", "global cognition z score"),
    _num("neuropsych_memory_z", "memory z score"),
    _num("neuropsych_executive_z", "executive function z score"),
    _num("neuropsych_language_z", "language z score"),
    _num("neuropsych_attention_z", "attention z score"),
    _num("neuropsych_visuospatial_z", "visio-perceptual"),
    S("neuropsych_cognitive_status", ("cognitive status",), "cognitive", optional=True),
]
INSTRUMENTS = [
    ("demographic.csv", DEMOGRAPHIC),
    ("clinical.csv", CLINICAL),
    ("medication.csv", MEDICATION),
    ("epidemiological.csv", EPIDEMIOLOGY),
    ("moca.csv", MOCA),
    ("mds-updrs.csv", UPDRS),
    ("updrs_1.csv", UPDRS_LEGACY),
    ("apathy_scale.csv", APATHY),
    ("bai.csv", BAI),
    ("bdii.csv", BDII),
    ("fatigue_severity_scale.csv", FSS),
    ("pdq_8.csv", PDQ8),
    ("pdq_39.csv", PDQ39),
    ("scopa.csv", SCOPA),
    ("timed_up_go.csv", TUG),
    ("parkinson_severity_scale.csv", PAS),
    ("schwab___england.csv", SCHWAB),
    ("ehi.csv", EHI),
    ("mbic.csv", MBIC),
    ("mbic_capri.csv", MBIC),
    ("neuropsychological.csv", NEUROPSYCH),
    ("neuropsychological_capri.csv", NEUROPSYCH),
]
ENROLMENT = "enrollement.csv"
# Words of diagnosis details, and the (provisional) level at which an instrument can be collected.
DIAGNOSIS_WORDS = ["psp", "msa", "cbs", "dlb", "et", "rbd"]
LEVELS = {
    1: ["demographic.csv", "epidemiological.csv"],
    2: ["apathy_scale.csv", "bai.csv", "bdii.csv", "fatigue_severity_scale.csv", "pdq_8.csv", "pdq_39.csv", "scopa.csv",
        "parkinson_severity_scale.csv", "schwab___england.csv", "ehi.csv", "mbic.csv", "mbic_capri.csv"],
    3: ["moca.csv", "mds-updrs.csv", "updrs_1.csv", "timed_up_go.csv", "medication.csv", "clinical.csv"],
    4: ["neuropsychological.csv", "neuropsychological_capri.csv"],
}


def level_table(spark: SparkSession) -> DataFrame:
    """(instrument, level): one row for each instrument."""
    return spark.createDataFrame([(f, level) for level, files in LEVELS.items() for f in files], "instrument string, level int")


def instruments_up_to(level: int) -> list:
    """The instruments whose level is at most ``level``, in the order of the specification."""
    held = {f for k, files in LEVELS.items() if k <= level for f in files}
    return [(f, specs) for f, specs in INSTRUMENTS if f in held]


def load_cohort(spark: SparkSession, data_dir: str, on_conflict: str = "first_table",
                instruments=None) -> tuple[DataFrame, list[str]]:
    """(cohort DataFrame keyed by ``project_key`` with label ``y``, feature names)."""
    base = data_dir.rstrip("/")
    enrol = read_keyed_csv(spark, f"{base}/{ENROLMENT}")
    if enrol is None:
        raise FileNotFoundError(f"{ENROLMENT} not found in {data_dir}")
    group = find_case_sensitive(enrol, "nrolment", "roup")
    if group is None:
        raise ValueError("no enrolment group column")
    cohort = enrol.select(quote(KEY), label_map(quote(group)).alias(LABEL)).where(F.col(LABEL).isNotNull())
    tables = []
    for fname, specs in instruments or INSTRUMENTS:
        raw = read_keyed_csv(spark, f"{base}/{fname}")
        if raw is None or KEY not in raw.columns:
            continue
        raw = raw.drop(*leakage_columns(raw, DIAGNOSIS_WORDS))
        tables.append(extract(raw, specs, KEY))
    master = assemble(cohort, tables, KEY, on_conflict=on_conflict)
    feats = [c for c in master.columns if c not in (KEY, LABEL)]
    keep = non_empty_columns(master, feats)
    return master.select(KEY, LABEL, *[quote(c) for c in keep]), keep
