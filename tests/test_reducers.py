import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.operators.linalg import fix_signs
from quire.operators.reducers import build_pipeline
from quire.operators.reducers.catpca import CATPCAReducer
from quire.operators.reducers.famd import FAMDReducer
from quire.operators.reducers.mca import MCAReducer
from quire.operators.reducers.pca import PCAReducer


def _frame(seed=8, n=400):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    return pd.DataFrame({
        "k": np.arange(n),
        "a": base + rng.normal(scale=0.3, size=n),
        "b": 2 * base + rng.normal(scale=0.5, size=n),
        "c": rng.normal(size=n) * 3,
        "d": rng.normal(size=n) + 0.5 * base,
        "o1": np.clip(np.round(base + 2), 0, 4).astype(float),
        "o2": rng.integers(0, 3, n).astype(float),
        "o3": (base > 0).astype(float),
    })


def test_pca_matches_numpy_and_is_orthogonal(spark):
    pdf = _frame()
    cols = ["a", "b", "c", "d"]
    model = PCAReducer(n_components=3).fit(spark.createDataFrame(pdf), cols)
    out = model.transform(spark.createDataFrame(pdf), keep=["k"]).toPandas().sort_values("k")
    x = pdf[cols].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    v = fix_signs(vt.T)[:, :3]
    scores = out[model.names].to_numpy()
    assert np.allclose(scores, z @ v, atol=1e-8)
    cov = np.cov(scores, rowvar=False, ddof=0)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-8)
    assert np.allclose(np.diag(cov), (s ** 2 / len(x))[:3], atol=1e-8)
    assert abs(model.explained_variance_ratio.sum() - (s[:3] ** 2).sum() / (s ** 2).sum()) < 1e-10


def test_famd_matches_numpy(spark):
    pdf = _frame()
    num, cat = ["a", "b", "c", "d"], ["o1", "o2", "o3"]
    model = FAMDReducer(n_components=4).fit(spark.createDataFrame(pdf), num + cat)
    out = model.transform(spark.createDataFrame(pdf), keep=["k"]).toPandas().sort_values("k")
    blocks = [(pdf[num] - pdf[num].mean()) / pdf[num].std(ddof=0)]
    for c in cat:
        d = pd.get_dummies(pdf[c]).astype(float)
        p = d.mean().clip(1e-6, 1 - 1e-6)
        blocks.append(d / np.sqrt(p) / np.sqrt(len(cat)))
    m = np.hstack([b.to_numpy() for b in blocks])
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    v = fix_signs(vt.T)[:, :4]
    assert np.allclose(out[model.names].to_numpy(), m @ v, atol=1e-8)
    evr = np.var(m @ v, axis=0) / np.var(m, axis=0).sum()
    assert np.allclose(model.explained_variance_ratio, evr, atol=1e-10)


def catpca_rows(pdf, num, cat, max_iter=50, tol=1e-4):
    """Row-by-row ALS loop on the data matrix (the Gram path must agree)."""
    values = {c: sorted(pdf[c].unique()) for c in cat}
    codes = {c: pdf[c].map({v: i for i, v in enumerate(values[c])}).to_numpy() for c in cat}
    quants = {c: np.arange(len(values[c]), dtype=float) for c in cat}
    it_done = 0
    for it in range(max_iter):
        it_done = it + 1
        m = np.column_stack([pdf[num].to_numpy()] + [quants[c][codes[c]] for c in cat])
        sd = m.std(0)
        sd[sd == 0] = 1
        z = (m - m.mean(0)) / sd
        w, v = np.linalg.eigh(z.T @ z / len(z))
        v1 = fix_signs(v[:, [int(np.argmax(w))]])[:, 0]
        score = z @ v1
        change = 0.0
        for c in cat:
            new = np.array([score[codes[c] == k].mean() for k in range(len(values[c]))])
            change = max(change, float(np.max(np.abs(new - quants[c]))))
            quants[c] = new
        if change < tol and it > 2:
            break
    return quants, it_done


def test_catpca_gram_equals_row_loop(spark):
    pdf = _frame(seed=9, n=300)
    num, cat = ["a", "c"], ["o1", "o2", "o3"]
    red = CATPCAReducer(n_components=2)
    model = red.fit(spark.createDataFrame(pdf), num + cat)
    ref, iters = catpca_rows(pdf, num, cat)
    assert red.iterations == iters
    for c in cat:
        got = np.array([model.quantifications[c][v] for v in sorted(pdf[c].unique())])
        assert np.max(np.abs(got - ref[c])) < 1e-9


def test_mca_and_pipelines(spark):
    pdf = _frame()
    df = spark.createDataFrame(pdf)
    mca = MCAReducer(n_components=2).fit(df, ["o1", "o2", "o3"])
    out = mca.transform(df).toPandas()
    assert out.shape[1] == 2 and np.allclose(out.mean().to_numpy(), 0, atol=1e-9)
    pipe = build_pipeline({"mode": "parallel", "keep_original_numeric": True,
                           "methods": [{"type": "pca", "n_components": 2}, {"type": "hellinger", "n_features": 2}]})
    df2 = df.withColumn("y", (df["o3"]).cast("int"))
    m = pipe.fit(df2, ["a", "b", "c", "d"], "y")
    cols = m.transform(df2, keep=["k"]).columns
    assert cols[:3] == ["k", "pc_01", "pc_02"] and len(cols) == len(set(cols))
    assert m.explained_variance_ratio == list(m.models[0].explained_variance_ratio) and sum(m.explained_variance_ratio) > 0
    seq = build_pipeline("famd_hellinger").fit(df2, ["a", "b", "c", "d", "o1", "o2"], "y")
    assert seq.output_dim <= 50


def _mixed(n=300):
    pdf = _frame(seed=4, n=n)
    rng = np.random.default_rng(7)
    pdf["t"] = rng.choice(["red", "green", "it's", ""], n)
    pdf.loc[::17, "t"] = None
    pdf["u"] = np.where(pdf["a"] > 0, "yes", "no")
    return pdf


def _blocks(pdf, num, cat):
    blocks = [(pdf[num] - pdf[num].mean()) / pdf[num].std(ddof=0)]
    for c in cat:
        d = pd.get_dummies(pdf[c]).astype(float)
        blocks.append(d / np.sqrt(d.mean().clip(1e-6, 1 - 1e-6)) / np.sqrt(len(cat)))
    return np.hstack([b.to_numpy() for b in blocks])


def test_famd_of_text_equals_numpy(spark):
    pdf = _mixed()
    model = FAMDReducer(n_components=3).fit(spark.createDataFrame(pdf), ["a", "b", "t", "u", "o2"])
    m = _blocks(pdf, ["a", "b"], ["t", "u", "o2"])
    out = model.matrix(spark.createDataFrame(pdf), ["k"]).toPandas().sort_values("k")
    assert list(out.columns[1:4]) == ["a", "b", "t="] and np.allclose(out.iloc[:, 1:].to_numpy(), m, atol=1e-9)
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    got = model.transform(spark.createDataFrame(pdf), keep=["k"]).toPandas().sort_values("k")[model.names].to_numpy()
    assert np.allclose(got, m @ fix_signs(vt.T)[:, :3], atol=1e-8)
    unseen = spark.createDataFrame([(1, 0.0, 0.0, "blue", None, 9.0)], "k long, a double, b double, t string, u string, o2 double")
    assert model.matrix(unseen).first()["t=red"] == 0.0


def test_mca_and_catpca_of_text(spark):
    pdf = _mixed()
    df = spark.createDataFrame(pdf)
    coded = pdf.assign(t=pdf["t"].map({"": 0.0, "green": 1.0, "it's": 2.0, "red": 3.0}), u=(pdf["u"] == "yes").astype(float))
    num = spark.createDataFrame(coded)
    a = MCAReducer(n_components=2).fit(df, ["t", "u", "o2"])
    b = MCAReducer(n_components=2).fit(num, ["t", "u", "o2"])
    assert np.allclose(a.explained_variance_ratio, b.explained_variance_ratio)
    assert np.allclose(a.transform(df, ["k"]).toPandas().sort_values("k"), b.transform(num, ["k"]).toPandas().sort_values("k"), atol=1e-9)
    c, d = (CATPCAReducer(n_components=2).fit(x, ["a", "t", "u"]) for x in (df, num))
    assert np.allclose(list(c.quantifications["t"].values()), list(d.quantifications["t"].values()), atol=1e-9)
    got = c.transform(df, ["k"]).toPandas().sort_values("k")
    assert np.allclose(got, d.transform(num, ["k"]).toPandas().sort_values("k"), atol=1e-8)


def test_categories(spark):
    import pytest
    from quire.operators import categories as C
    from quire.operators.profile import impute_most_frequent, one_hot
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "c")], "k long, t string")
    d = C.value_dictionary(df, ["t"])
    assert [tuple(r) for r in d.orderBy("code").collect()] == [("t", "a", 0, 1), ("t", "b", 1, 2), ("t", "c", 2, 1)]
    new = spark.createDataFrame([(1, "c"), (2, "zz"), (3, None)], "k long, t string")
    assert [r["t"] for r in C.encode(new, d, ["t"]).orderBy("k").collect()] == [2, C.UNSEEN, None]
    assert C.text_modes(df, ["t"]) == {"t": "b"}
    filled = impute_most_frequent(df, ["t"], {"t": "b"})
    assert [r["t"] for r in filled.orderBy("k").collect()] == ["b", "a", "b", "b", "c"]
    hot = one_hot(new, {"t": ["a", "c"]})
    assert hot.columns == ["k", "t=a", "t=c"] and [tuple(r)[1:] for r in hot.orderBy("k").collect()] == [(0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    many = spark.range(30).select(F.col("id").cast("string").alias("t"))
    old, C.MAX_CATEGORIES = C.MAX_CATEGORIES, 10
    try:
        with pytest.raises(ValueError):
            C.categories(many, ["t"])
    finally:
        C.MAX_CATEGORIES = old


def test_plan_configurations(spark):
    import pytest
    from quire.operators.reducers.registry import PlanConfig, output_folder_name
    for bad in ("lda", {"mode": "both", "methods": []}, {"methods": [{"type": "nope"}]}, {"methods": [{"type": "pca", "colour": 1}]}, {"methods": [{"n": 1}]}):
        with pytest.raises(ValueError):
            PlanConfig.read(bad)
    assert output_folder_name(None) == "no_dr" and output_folder_name("famd_hellinger") == "famd_hellinger"
    assert output_folder_name({"methods": [{"type": "truncate", "dims": 2}, {"type": "pca"}]}) == "truncate_pca"
    df = spark.createDataFrame([(1, 3.0, 4.0, 1.0), (2, 0.0, 0.0, 5.0)], "k long, e0 double, e1 double, e2 double")
    out = build_pipeline({"methods": [{"type": "truncate", "dims": 2}]}).fit(df, ["e0", "e1", "e2"]).transform(df, ["k"])
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, 0.6, 0.8), (2, 0.0, 0.0)]


def test_text_plan(spark):
    words = ["sun", "moon", "star", "sky", "cloud", "rain"]
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 8))) for i in range(40)], "doc long, text string")
    plan = build_pipeline({"methods": [{"type": "lsa", "key": "doc", "text": "text", "n_components": 4}, {"type": "pca", "n_components": 2}]})
    model = plan.fit(df, ["text"])
    out = model.transform(df, ["doc"])
    assert out.columns == ["doc", "pc_01", "pc_02"] and out.count() == 40 and model.output_dim == 2
