"""Ranked search, Merkle manifest and toxicity against brute force, on odd tables."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import merkle, ranked, toxicity
from quire.llm.common import documents, fold_of
from quire.sources.tables import read_table

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 1152921504606846977


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "  \n", "The cat. THE cat, the-cat", "É é dog's", "cat", "cat", "dog cat " * 4000, "\x00a\x7fb", "naïve 日本 cat"]
    rows = [(i, t, [None, "", "en", "fr"][i % 4], None if i % 3 else "s", i) for i, t in enumerate(texts)]
    rows += [(BIG, "big cat", "en", "s", None), (None, "cat", "en", None, 1), (None, "cat", "en", None, 1), (5, "cat", "en", "s", 1), (5, "cat", "en", "s", 1)]
    rows += [(1000 + i, f"word{i} Cat", "en", "s", i) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in ("tree", "hash", "pos", "n", "path", "item_id", "score", "rank", "y", "batch", "toxic")])


@pytest.fixture(scope="module")
def small(spark):
    return documents(spark, SF_SMALL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(request, name):
    return request.getfixturevalue(name)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fields(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def climb(nodes):
    """All levels of a tree, from the leaves to its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        s = at // 8 * 8
        out.append((level[s:at], level[at + 1:s + 8]))
        at //= 8
    return out


def brute_merkle(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, fields(r, r["text"]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: climb([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in names}
    top = climb([built[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[g], key=lambda x: x[:3])):
            path = siblings(built[g], i) + siblings(top, k)
            own = "" if r["doc_id"] is None else str(r["doc_id"])
            node = leaf
            if zlib.crc32(own.encode()) % 3 == 0 and r["text"] is not None:
                node = fields(r, r["text"].translate(LOWER))
            for a, b in path:
                node = h(*a, node, *b)
            out.append((r["doc_id"], leaf, built[g][-1][0], root, h(*[x for a, b in path for x in a + b]), node, node == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", ["odd", "small"])
def test_merkle(request, name):
    docs = table(request, name)
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
           for r in merkle.verified_manifest(docs).collect()]
    assert ordered(got) == ordered(brute_merkle([r.asDict() for r in docs.collect()]))


def test_merkle_proofs_of_some(spark, odd):
    manifest = merkle.build(merkle.entries(odd))
    some = spark.createDataFrame([(5,), (1699,), (-1,)], "doc_id long")
    every = {(r["doc_id"], r["hash"], str(r["path"])) for r in merkle.proofs(manifest).collect()}
    few = {(r["doc_id"], r["hash"], str(r["path"])) for r in merkle.proofs(manifest, some).collect()}
    assert few == {x for x in every if x[0] in (5, 1699)}
    assert merkle.root(manifest).count() == 1


def test_merkle_small_and_empty(spark, empty):
    assert merkle.verified_manifest(empty).count() == 0
    one = spark.createDataFrame([(1, "Text", "en", None, 4)], SCHEMA)
    r = merkle.verified_manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, queries, k=10):
    own = [(r["doc_id"], terms(r["text"])) for r in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(set)
    for r in queries:
        asked[r["item_id"]] |= set(terms(r["text"]))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c, n in own:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("segment", [ranked.SEGMENT, 50])
def test_ranked_search_odd(spark, odd, monkeypatch, segment):
    monkeypatch.setattr(ranked, "SEGMENT", segment)
    monkeypatch.setattr(ranked, "READ", 2)
    queries = spark.createDataFrame([(1, "The cat!", 3), (2, None, 3), (3, "", 3), (4, "word5 word6 DOG é", 3), (4, "naïve", 3), (None, "big 日本", 3), (BIG, "cat", 3)],
                                    "item_id long, text string, doc_id int")
    got = [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in ranked.search(odd, queries).collect()]
    assert ordered(got) == ordered(brute_search(odd.collect(), queries.collect()))


def test_ranked_search_blocks(spark, small, empty, monkeypatch):
    queries = read_table(spark, SF_SMALL, "benchmark")
    want = ordered(brute_search(small.collect(), queries.collect()))
    assert ordered([tuple(r) for r in ranked.search(small, queries).collect()]) == want
    monkeypatch.setattr(ranked, "QUERY_TERMS", 100)
    assert len(ranked.query_blocks(ranked.query_terms(queries))) > 1
    assert ordered([tuple(r) for r in ranked.search(small, queries).collect()]) == want
    assert ranked.search(empty, queries).count() == 0
    assert ranked.search(small, queries.limit(0)).count() == 0


def test_lists_settle_scores():
    """Scores and ties of the bounded reading equal a full sum, also where the reading ends early."""
    rng = random.Random(5)
    for _ in range(40):
        docs = rng.choice([1, 9, 200])
        held = [sorted(rng.sample(range(12), rng.randint(0, 6))) for _ in range(docs)]
        tfs = [[rng.randint(1, 4) for _ in t] for t in held]
        n = [max(1, sum(t)) for t in tfs]
        lists = ranked.Lists(n, held, tfs, docs, sum(n), {t: rng.randint(0, 900) for t in range(12)})
        want = np.zeros(docs, dtype=np.int64)
        own = rng.sample(range(14), 5)
        for t in own:
            s, e = lists.range.get(t, (0, 0))
            np.add.at(want, lists.at[s:e], lists.impact[s:e])
        floor = rng.choice([0, int(want.max()) // 2, int(want.max()) + 1])
        at, score = lists.read(own, 10, floor)
        kth = sorted(want)[-10] if docs >= 10 else 0
        must = {i for i in range(docs) if want[i] >= max(1, floor, kth)}
        assert must <= set(at.tolist()) and all(want[a] == s for a, s in zip(at, score))


def toxic_table(spark, n=1500):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words, bad = rng.choices(plain, k=rng.randint(3, 60)), rng.random() < .2
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Foul,", "vile", "nasty."]))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (BIG, ""), (None, "vile foul nasty")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7, 0), (BIG + 1, 1)], "doc_id long, toxic int")
    return docs.select("*", *[F.lit(1).alias(c) for c in ("y", "batch", "places", "score", "toxic")]), labels, {i: y for i, _, y in rows}


def brute_places(text):
    w = [x.strip(toxicity.EDGE) for x in (text or "").encode().lower().split()]
    c = [zlib.crc32(x) for x in w]
    a, b, d, top = toxicity._A, toxicity._B, toxicity._C, 1 << 64
    out = [x * a % top >> 38 for x in c]
    for gap, f in ((1, b), (2, d)):
        out += [((x * a % top ^ y * f % top) * d % top) >> 38 for x, y in zip(c, c[gap:])]
    return set(out)


def test_toxicity_held_out_and_brute_scores(spark):
    docs, labels, truth = toxic_table(spark)
    model = toxicity.train(docs, labels, fold_of("doc_id", 3) != 1)
    assert 0 < len(model.places) < 100
    weights = dict(zip(model.places.tolist(), model.weights.tolist()))
    out = toxicity.score(docs, model, ["text"]).collect()
    assert len(out) == docs.count() and {r["doc_id"] for r in out} >= {None, BIG}
    hits = Counter()
    for r in out:
        margin = model.bias + sum(weights.get(p, 0.0) for p in brute_places(r["text"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
        if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1:
            hits[truth[r["doc_id"]], r["score"] >= toxicity.THRESHOLD] += 1
    assert hits[1, True] >= .95 * (hits[1, True] + hits[1, False])
    assert hits[0, False] >= .99 * (hits[0, True] + hits[0, False])


def test_toxicity_gradient_and_partitions(spark):
    docs, labels, _ = toxic_table(spark, 300)
    a = toxicity.train(docs, labels, F.lit(True))
    b = toxicity.train(docs.repartition(7), labels.repartition(3), F.lit(True))
    assert a.places.tolist() == b.places.tolist() and np.allclose(a.weights, b.weights, atol=1e-6)
    rows = [(1, [0, 2]), (0, [1]), (0, []), (1, [0, 1, 2])]
    w = np.array([.3, -.2, .1, .5])
    want = np.zeros(4)
    for y, ids in rows:
        e = 1 / (1 + math.exp(-(w[3] + sum(w[i] for i in ids)))) - y
        want[[*ids, 3]] += e
    got = toxicity.gradient(spark.createDataFrame(rows, "y int, ids array<int>"), w)
    assert np.allclose(got, want, atol=1e-8)


def test_ftrl_step_by_hand():
    z, n, w = np.array([.5, -9.0]), np.array([4.0, 1.0]), np.array([0.0, 2.0])
    g, l1 = np.array([1.0, -3.0]), np.array([2.0, 2.0])
    want = []
    for i in range(2):
        s = (math.sqrt(n[i] + g[i] ** 2) - math.sqrt(n[i])) / toxicity.ALPHA
        zi, ni = z[i] + g[i] - s * w[i], n[i] + g[i] ** 2
        want.append(0.0 if abs(zi) <= 2 else -(zi - math.copysign(2, zi)) / ((toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2))
    assert toxicity.ftrl_step(z, n, w, g, l1).tolist() == pytest.approx(want)


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, none, F.lit(True)))
    assert {r["score"] for r in got.collect()} == {0.0} and got.count() == odd.count()
    assert toxicity.score(empty, toxicity.train(empty, none, F.lit(True))).count() == 0
