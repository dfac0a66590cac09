import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators.hellinger import HellingerSelector, hellinger_scores
from quire.operators.preprocess import Preprocessor
from quire.operators.profile import (column_kinds, exact_medians, missingness, moments,
                                     value_frequencies)


def ref_hellinger(x: pd.Series, y: pd.Series, n_bins=10, threshold=10):
    """Brute-force reference: class-conditional histograms with numpy."""
    def h(p, q):
        p = p / (p.sum() + 1e-12)
        q = q / (q.sum() + 1e-12)
        return float(np.sqrt(np.sum((np.sqrt(p) - np.sqrt(q)) ** 2)) / np.sqrt(2))
    a, b = x[y == 0].dropna(), x[y == 1].dropna()
    if len(a) == 0 or len(b) == 0:
        return 0.0
    if x.nunique() <= threshold:
        cats = np.union1d(a.unique(), b.unique())
        return h(np.array([(a == c).sum() for c in cats], float), np.array([(b == c).sum() for c in cats], float))
    _, edges = np.histogram(x.dropna(), bins=n_bins)
    return h(np.histogram(a, bins=edges)[0].astype(float), np.histogram(b, bins=edges)[0].astype(float))


def test_hellinger_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = (rng.random(n) < 0.1).astype(int)
    pdf = pd.DataFrame({
        "y": y,
        "cont": rng.normal(size=n) + y,
        "ints": rng.integers(0, 30, n).astype(float),          # many values on inner edges
        "cat": rng.integers(0, 4, n).astype(float),
        "ten": rng.integers(0, 10, n).astype(float),           # exactly 10 distinct → categorical
        "eleven": rng.integers(0, 11, n).astype(float),        # 11 distinct → numeric
    })
    pdf.loc[rng.random(n) < 0.2, "cont"] = np.nan
    cols = ["cont", "ints", "cat", "ten", "eleven"]
    got = {r["feature"]: (r["h_score"], r["kind"]) for r in
           hellinger_scores(spark.createDataFrame(pdf), cols, "y").collect()}
    for c in cols:
        assert abs(got[c][0] - ref_hellinger(pdf[c], pdf["y"])) < 1e-12, c
    assert got["ten"][1] == "categorical" and got["eleven"][1] == "numeric"


def test_hellinger_extremes(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, None), (0, 1.0, 2.0, 1.0), (1, 2.0, 1.0, None),
                                (1, 2.0, 2.0, None)], "y int, disjoint double, same double, empty double")
    got = {r["feature"]: r["h_score"] for r in hellinger_scores(df, ["disjoint", "same", "empty"], "y").collect()}
    assert abs(got["disjoint"] - 1.0) < 1e-6 and abs(got["same"]) < 1e-12 and got["empty"] == 0.0


def test_medians_moments_kinds(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=101), "b": rng.integers(0, 5, 101).astype(float)})
    pdf.loc[:10, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    med = {r["column"]: r["median"] for r in exact_medians(value_frequencies(df, ["a", "b"]), 2, 5).collect()}
    assert abs(med["a"] - pdf["a"].median()) < 1e-12 and med["b"] == pdf["b"].median()
    mom = {r["column"]: r for r in moments(df, ["a"]).collect()}
    assert abs(mom["a"]["sd"] - pdf["a"].std(ddof=0)) < 1e-9
    miss = {r["column"]: r["missing_fraction"] for r in missingness(df, ["a", "b"]).collect()}
    assert abs(miss["a"] - 11 / 101) < 1e-12 and miss["b"] == 0.0
    kinds = {r["column"]: r["kind"] for r in column_kinds(df, ["a", "b"]).collect()}
    assert kinds == {"a": "numeric", "b": "categorical"}


def test_train_only_fit(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": range(200), "y": (rng.random(200) < 0.2).astype(int),
                        "x": rng.normal(size=200), "dead": [None] * 200})
    pdf["x"] = pdf["x"].where(rng.random(200) > 0.1)
    train = spark.createDataFrame(pdf[:150], "k long, y long, x double, dead double")
    m = Preprocessor().fit(train, ["x", "dead"], "y")
    assert m.features == ["x"] and m.dropped == ["dead"]
    assert abs(m.medians["x"] - pdf["x"][:150].median()) < 1e-12
    filled = pdf["x"][:150].fillna(pdf["x"][:150].median())
    assert abs(m.means["x"] - filled.mean()) < 1e-12 and abs(m.sds["x"] - filled.std(ddof=0)) < 1e-9
    out = m.transform_preprocessed(train).toPandas()
    assert abs(out["x"].mean()) < 1e-9 and abs(out["x"].std(ddof=0) - 1) < 1e-9


def test_selector_selects_top(spark):
    rng = np.random.default_rng(6)
    n = 400
    y = (rng.random(n) < 0.2).astype(int)
    pdf = pd.DataFrame({"y": y, "good": y + rng.normal(scale=0.1, size=n), "noise": rng.normal(size=n)})
    model = HellingerSelector(n_features=1, use_svm_refinement=False).fit(spark.createDataFrame(pdf),
                                                                          ["noise", "good"], "y")
    assert model.selected == ["good"]


def test_medians_by_refined_histograms(spark):
    from quire.operators.profile import column_medians
    rng = np.random.default_rng(13)
    n = 5001
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float),
                        "c": np.r_[rng.normal(size=n - 1), np.nan], "d": [np.nan] * n,
                        "e": np.r_[np.zeros(n - 2), [5.0, 6.0]], "wide": np.exp(rng.normal(scale=80, size=n)) * rng.choice([-1, 1], n),
                        "huge": rng.choice([-1.7e308, 1.7e308, 1.0, np.inf], n), "one": np.full(n, 2.5),
                        "near": 1.0 + rng.integers(0, 3, n) * 2.0 ** -52})
    df = spark.createDataFrame(pdf)
    got = column_medians(df, list(pdf.columns))
    for c in pdf.columns:
        exp = pdf[c].median()
        assert (got[c] is None and np.isnan(exp)) or got[c] == exp, c
    assert column_medians(df.limit(0), ["a"]) == {"a": None}
    plan = df.select("a")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_selected_ranks_and_hashes(spark):
    from quire.operators.selection import hash_rank, select_hashes, select_values
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 3000, p=[.95, .05]), "k": np.arange(3000), "v": rng.integers(0, 50, 3000).astype(float)})
    df = spark.createDataFrame(pdf)
    want = sorted(pdf["v"])
    got = select_values(df, {"v": [1, 2, 1500, 3000]}, {"v": (want[0], want[-1])})
    assert got == {("v", k): want[k - 1] for k in (1, 2, 1500, 3000)}
    import hashlib
    h = {k: hashlib.md5(str(k).encode()).hexdigest() for k in pdf["k"]}
    hashed = df.withColumn("h", F.md5(F.col("k").cast("string")))
    cuts = select_hashes(hashed, F.col("h"), "g", {"x": 700, "y": 3, "z": 0})
    for g, k in (("x", 700), ("y", 3)):
        assert cuts[g] == sorted(h[i] for i in pdf.loc[pdf["g"] == g, "k"])[k - 1]
    ranked = hash_rank(hashed, "h", "g", ["k"], "rn").toPandas()
    for g, part in ranked.groupby("g"):
        assert part.sort_values("h")["rn"].tolist() == list(range(1, len(part) + 1))


def test_hellinger_hot_value(spark):
    rng = np.random.default_rng(14)
    n = 3000
    y = (rng.random(n) < 0.05).astype(int)
    hot = np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n))      # one value holds ~70 % of rows
    few = np.where(rng.random(n) < 0.9, 1.0, rng.integers(0, 9, n).astype(float))
    pdf = pd.DataFrame({"y": y, "hot": hot + y * 0.5, "few": few})
    got = {r["feature"]: (r["h_score"], r["kind"]) for r in
           hellinger_scores(spark.createDataFrame(pdf), ["hot", "few"], "y").collect()}
    for c in ["hot", "few"]:
        assert abs(got[c][0] - ref_hellinger(pdf[c], pdf["y"])) < 1e-12
    assert got["few"][1] == "categorical" and got["hot"][1] == "numeric"
