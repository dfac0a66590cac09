"""Property tests: exact split quotas and exact AUC over random inputs."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quire.operators.metrics import roc_auc
from quire.operators.split import allocate, holdout_quota, stratified_split

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@given(st.dictionaries(st.integers(0, 5), st.integers(1, 500), min_size=1, max_size=4),
       st.floats(0.05, 0.5))
def test_quota_properties(counts, frac):
    q = holdout_quota(counts, frac)
    n = sum(counts.values())
    assert sum(q.values()) == int(np.ceil(frac * n))
    assert all(0 <= q[k] <= counts[k] for k in counts)
    train = allocate(counts, n - sum(q.values()))
    assert all(abs(train[k] - counts[k] * (n - sum(q.values())) / n) < 1 for k in counts)


@SETTINGS
@given(st.integers(20, 300), st.floats(0.02, 0.5), st.integers(0, 10_000))
def test_split_exact(spark, n, rate, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.permutation(n * 3)[:n], "y": (rng.random(n) < rate).astype(int)})
    out = stratified_split(spark.createDataFrame(pdf), "k", "y").toPandas()
    quota = holdout_quota(pdf["y"].value_counts().to_dict(), 0.2)
    got = out[out.is_test].groupby("y").size().to_dict()
    assert {k: got.get(k, 0) for k in quota} == quota and len(out) == n


@SETTINGS
@given(st.integers(5, 200), st.integers(1, 30), st.integers(0, 10_000))
def test_auc_brute_force(spark, n, levels, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    s = rng.integers(0, levels, n).astype(float)
    got = roc_auc(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s", num_slices=3).first()["auc_roc"]
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        assert got is None
    else:
        exp = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert abs(got - exp) < 1e-12
