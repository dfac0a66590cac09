"""Parts follow the texts, so a task's counts stay bounded."""
from quire.operators import text


def test_parts_follow_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some words here " * 20) for i in range(100)], "id long, text string")
    few = text.term_counts(df, "id", "text")
    assert text.text_parts(df, "text") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(text, "PART_CHARS", 1000)
    assert text.text_parts(df, "text") == 32
    many = text.term_counts(df, "id", "text")
    assert many.rdd.getNumPartitions() == 32
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert text.text_parts(df.where("id < 0"), "text") >= 1
