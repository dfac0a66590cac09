from pyspark.sql import functions as F

from quire.functions import coders
from quire.functions.numeric import lenient_double, row_sum_min_count


def _apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_yes_no(spark):
    vals = ["Yes/Oui", "No/Non", "Unknown/Inconnu", "yes, none", "Not applicable/Non applicable", None, ""]
    assert _apply(spark, vals, coders.yes_no) == [1.0, 0.0, None, 0.0, 0.0, None, None]


def test_yes_no_word_boundary(spark):
    # "no" only as a whole word; "non" anywhere
    assert _apply(spark, ["nobody", "say no.", "ñno", "anonymous"], coders.yes_no) == [None, 0.0, None, 0.0]
    assert _apply(spark, ["anonymous"], lambda c: coders.yes_no(c, strict=True)) == [None]


def test_administered(spark):
    assert _apply(spark, ["Incomplete", None, "Complete", "oui", "nope"], coders.administered_flag) == \
        [1.0, 0.0, 1.0, 1.0, 0.0]
    df = spark.range(2)
    assert [r[0] for r in df.select(coders.administered_flag(None)).collect()] == [0.0, 0.0]


def test_lenient_numbers(spark):
    vals = ["abc", "1.5", " 2 ", "NaN", "1d", "", "N/A", "-3e2", None]
    assert _apply(spark, vals, lenient_double) == [None, 1.5, 2.0, None, None, None, None, -300.0, None]


def test_other_coders(spark):
    assert _apply(spark, ["Male", "Female/Féminin", "masculin", "x", None], coders.sex_male) == \
        [1.0, 0.0, 1.0, None, None]
    assert _apply(spark, ["Both sides", "Left", "un côté", "?"], coders.laterality) == [1.0, 0.0, 0.0, None]
    assert _apply(spark, ["Yes", "No", "Uncertain", "yes but uncertain", "non applicable"],
                  coders.three_level_response) == [1.0, 0.0, 0.5, 0.5, 0.0]
    assert _apply(spark, ["Normal", "MCI", "Dementia", "normal MCI"], coders.cognitive_status) == \
        [0.0, 1.0, 2.0, 1.0]
    assert _apply(spark, ["(2) Bilateral", "stage 3", "(1.5)", None], coders.number_in_parentheses) == \
        [2.0, None, 1.5, None]
    assert _apply(spark, ["stage 3.5 of 5", "none", None], coders.first_number) == [3.5, None, None]


def test_label_map_and_either(spark):
    k0, k1 = list(coders.TARGET_LABELS)
    assert _apply(spark, [k0, k1, "HC", None], coders.label_map) == [0, 1, None, None]
    df = spark.createDataFrame([(1.0, None), (None, None), (0.0, 0.0), (None, 1.0), (0.0, None)], "a double, b double")
    out = [r[0] for r in df.select(coders.either_flag(F.col("a"), F.col("b"))).collect()]
    assert out == [1.0, None, 0.0, 1.0, 0.0]
    out = [r[0] for r in df.select(coders.either_flag(F.col("a"), None)).collect()]
    assert out == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_row_sum_min_count(spark):
    df = spark.createDataFrame([(None, None), (2.0, None), (1.0, 3.0)], "a double, b double")
    out = [r[0] for r in df.select(row_sum_min_count([F.col("a"), F.col("b")])).collect()]
    assert out == [None, 2.0, 4.0]
