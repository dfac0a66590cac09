from pyspark.sql import functions as F

from quire.functions.columns import find_column, find_numeric_column
from quire.operators.assemble import assemble
from quire.sources.csv import pandas_style_names, read_keyed_csv

CSV = '''Project key,Score,Score,14. Q?,Notes,Temps (secondes)1,Temps (secondes)2
A,1,10,yes,"multi
line",abc,3.5
B,2,20,no,plain,x,4
A,3,30,no,later row,y,5
,4,40,yes,null key 1,z,6
,5,50,yes,null key 2,w,7
C,N/A,60,,none,v,
'''


def test_pandas_style_names():
    assert pandas_style_names(["Score", "Score", "Score.1", "x"]) == ["Score", "Score.1", "Score.1.1", "x"]


def test_keyed_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(CSV)
    assert read_keyed_csv(spark, str(tmp_path / "absent.csv")) is None
    df = read_keyed_csv(spark, str(p))
    assert df.columns[:5] == ["project_key", "Score", "Score.1", "14. Q?", "Notes"]
    rows = {r["project_key"]: r for r in df.collect()}
    assert set(rows) == {"A", "B", "C"}                      # null keys dropped, one row per key
    assert rows["A"]["Score"] == "1" and rows["A"]["Notes"] == "multi\nline"   # first in file order
    assert rows["C"]["Score"] is None                         # 'N/A' is missing
    assert find_column(df, "14.", "q?") == "14. Q?"
    assert find_numeric_column(df, "secondes") == "Temps (secondes)2"


def test_assemble_modes(spark):
    cohort = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), (None, 1)], "k string, y int")
    t1 = spark.createDataFrame([("a", 1.0, 5.0)], "k string, x double, z double")
    t2 = spark.createDataFrame([("b", 2.0), ("a", 9.0)], "k string, x double")
    first = {r["k"]: r for r in assemble(cohort, [t1, t2], "k").collect()}
    assert set(first) == {"a", "b", "c"}
    assert first["a"]["x"] == 1.0 and first["b"]["x"] is None   # second table adds no column
    co = {r["k"]: r for r in assemble(cohort, [t1, t2], "k", on_conflict="coalesce").collect()}
    assert co["a"]["x"] == 1.0 and co["b"]["x"] == 2.0 and co["c"]["x"] is None


def test_keyed_csv_splittable(spark, tmp_path):
    p = tmp_path / "big.csv"
    lines = ["Project key,Score"] + [f"k{i % 50},{i}" for i in range(2000)]
    p.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_keyed_csv(spark, str(p), multi_line=False)
        rows = {r["project_key"]: r["Score"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 50 and rows["k0"] == "0" and rows["k49"] == "49"   # first row per key in file order


def test_headers_that_differ_in_case(spark, tmp_path):
    from quire.sources.csv import _resolved, pandas_style_names, read_keyed_csv
    assert pandas_style_names(["a", "A", "a", None, "a.1"]) == ["a", "A.1", "a.2", "Unnamed: 3", "a.1.1"]
    (tmp_path / "t.csv").write_text("Project key,Score,score\np1,1,2\n")
    row = read_keyed_csv(spark, str(tmp_path / "t.csv")).first()
    assert row["Score"] == "1" and row["score.1"] == "2"
    assert _resolved("hdfs://host/data/a.csv") == "hdfs://host/data/a.csv"
