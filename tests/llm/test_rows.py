"""Ids of any value beside nulls, one survivor of repeated rows, and very long texts."""
import time

import pytest
from pyspark.sql import functions as F

from quire.llm import dedup, langid, licenses, maxent, packing, pii, secrets, simhash, toxicity
from quire.llm import sentencepiece_fst as fst
from quire.llm.common import fold_of, spread_join

BIG = 1152921504606846977


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(None, "one two three"), (BIG, "uno dos tres"), (BIG + 2, None), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("run", [
    secrets.scan, simhash.near_duplicates, fst.encode, dedup.exact_dedup, packing.pack, licenses.scan, pii.find_pii, pii.redact,
    lambda d: langid.identify(d, *langid.prototypes(d.withColumn("lang", F.lit("en")))),
    lambda d: maxent.score(d, fold_of("doc_id", 7) == 2),
    lambda d: toxicity.score(d, toxicity.Model(*[__import__("numpy").zeros(0, int)] * 2, 0.0)),
], ids=["secrets", "simhash", "pieces", "exact", "packing", "licenses", "pii", "redact", "language", "lm", "toxicity"])
def test_ids_beside_nulls(mixed, run):
    got = [r["doc_id"] for r in run(mixed).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted([None, None, BIG, BIG + 2], key=str)


def test_text_ids(spark):
    docs = spark.createDataFrame([("x", "one two"), (None, "a"), ("y", None)], "doc_id string, text string")
    for run in (secrets.scan, fst.encode, packing.pack, licenses.scan, simhash.near_duplicates):
        assert {r["doc_id"] for r in run(docs).collect()} == {"x", "y", None}


SAME = "alpha beta gamma delta epsilon zeta eta theta"


@pytest.mark.parametrize("drop", [dedup.drop_copies, simhash.drop_near_copies], ids=["exact", "near"])
def test_one_survivor(spark, drop):
    schema = "doc_id long, text string, kept boolean, rows int"
    rows = [(i, SAME, True, 1) for i in (None, None, 5, 5, 6)]
    left = drop(spark.createDataFrame(rows, schema)).collect()
    assert len(left) == 1 and left[0]["doc_id"] == (6 if drop is dedup.drop_copies else 5) and left[0]["text"] == SAME
    twice = drop(spark.createDataFrame([(5, SAME, None, 1), (5, SAME, None, 1), (7, "other words", None, 2)], schema)).collect()
    assert sorted(r["doc_id"] for r in twice) == [5, 7]
    nulls = drop(spark.createDataFrame([(None, SAME, None, 1), (None, SAME, None, 1)], schema)).collect()
    assert len(nulls) == 1
    assert drop(spark.createDataFrame([], schema)).count() == 0


def test_spread_join_of_hot_keys(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = spread_join(rows, table, "k", "n")
    assert got.count() == 6000 and got.where("k = -1 and n = 2000").count() == 2000


def test_pii_of_very_long_texts(spark):
    numbers = " ".join(f"{i} a+b{i}@x.org," for i in range(100_000))
    docs = spark.createDataFrame([(1, numbers), (2, "x " * 300_000 + "1.2.3.4")], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert got[1]["n_email"] == 100_000 and got[2]["spans"].endswith("ip:600000:600007")
    at = numbers.index("a+b99999@")
    assert f"email:{at}:{at + len('a+b99999@x.org')}" in got[1]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1].startswith("0 [PII], 1 [PII],") and clean[1].endswith("99999 [PII],") and clean[2].endswith("x [PII]")
    assert time.time() - start < 120


def test_letters_are_letters():
    assert langid.letters_of("\u00b2\u00bd 12 \u2167") == ""
    assert langid.letters_of("x\u00b2y Z") == " x y z "


def test_open_bounds_of_secrets(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIE+a/=\nabc\n-----END RSA PRIVATE KEY-----"
    texts = [f"https://user:{'p' * 80}@host/x", f"https://{'u' * 90}:pass@host", f"a {key} b", "-----BEGIN PRIVATE KEY-----\n" * 3000]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == f"url_login:5:{5 + 9 + 80}" and "url_login" in got[1] and got[2] == f"private_key:2:{2 + len(key)}"
    assert got[3].count("private_key") == 3000
