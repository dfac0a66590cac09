"""TF-IDF by blocks: equal to the join by term, with the terms' texts leaving a block once."""
import numpy as np
import pyarrow as pa

from quire.operators import grams, text

WORDS = ["été", "cat", "dog", "日本", "a_1", "x", "Cat", "zz9", "no"]


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS, rng.integers(0, 30)))) for i in range(n)]


def rows_of(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_blocks_weigh_as_the_join_does(spark, monkeypatch):
    # A null text, a null key, two rows of one key and an empty text.
    docs = corpus() + [(70, None), (None, "cat dog cat dog"), (3, "cat cat dog"), (3, "cat cat dog"), (71, "")]
    df = spark.createDataFrame(docs, "id long, text string")
    for chars in (grams.BLOCK_CHARS, 100):
        monkeypatch.setattr(grams, "BLOCK_CHARS", chars)
        for grams_of in (1, 2):
            got = rows_of(text.tfidf(df, "id", "text", 2, None, grams_of))
            want = rows_of(text.tfidf(df, "id", "text", 2, 10**6, grams_of))
            assert len(want) > 100 and set(got) == set(want)
            assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_keys_may_be_texts_and_no_rows(spark):
    df = spark.createDataFrame([(f"k{i}", t) for i, t in corpus()], "id string, text string")
    got, want = (rows_of(text.tfidf(df, "id", "text", 3, m)) for m in (None, 10**6))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert text.tfidf(df.where("id = ''"), "id", "text").collect() == []
    assert text.tfidf(df.limit(2), "id", "text").collect() == []


def test_the_order_of_rows_does_not_number_terms():
    table = pa.table({"key": [1, 2, 1], "h": [5, 6, 4], "t": [["b", "c"], ["a", "b", "b"], ["c", "b"]]})
    a, b = (grams.counted(t, 4, 2) for t in (table, table.take([2, 1, 0])))
    assert a.terms.equals(b.terms) and a.keys.equals(b.keys)
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("slices", "doc", "term", "tf"))
    assert {(a.keys[d].as_py(), a.terms[t].as_py(), int(f)) for d, t, f in zip(a.doc, a.term, a.tf)} == {
        (1, "b", 2), (1, "c", 2), (1, "b c", 1), (1, "c b", 1), (2, "a", 1), (2, "b", 2), (2, "a b", 1), (2, "b b", 1)}


def test_a_term_leaves_its_block_once():
    table = pa.table({"key": list(range(500)), "h": list(range(500)), "t": [["same", "words"]] * 500})
    block = grams.counted(table, 4, 2)
    sent = pa.Table.from_batches(grams._sent(0, block))
    assert sum(map(len, sent["letters"].to_pylist())) == len("same" + "words" + "same words")
    assert np.frombuffer(b"".join(sent["df"].to_pylist()), dtype=np.int32).tolist() == [500] * 3


def test_cells_decompose_as_the_long_table_does(spark, monkeypatch):
    from pyspark.sql import functions as F
    from quire.operators.linalg import randomized_svd_long
    from quire.operators.reducers.lsa import LSAReducer
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choice(words[:8 + i % 3 * 8], rng.integers(4, 30)))) for i in range(80)] + [(90, None), (None, "w1 w2")]
    df = spark.createDataFrame(docs, "id long, text string")
    monkeypatch.setattr(grams, "BLOCK_CHARS", 500)
    monkeypatch.setattr(grams, "SLICE_CHARS", 300)
    # The fit forms no long table: entries stay in their cells.
    with monkeypatch.context() as m:
        m.setattr(text, "term_counts", None)
        m.setattr("quire.operators.reducers.lsa.term_counts", None)
        model = LSAReducer(n_components=3, n_iter=6).fit(df, "id", "text")
        rows = model.transform(df, ["id"])
        got = {r[0]: r[1:] for r in rows.collect()}
    long = text.tfidf(df, "id", "text", 3, 10**6)
    values, factor = randomized_svd_long(long, "id", "term", "tfidf", 3, n_iter=6)
    assert np.allclose(model.singular_values, values, rtol=1e-4)
    mine = {r[0]: r[1:] for r in model.factor.collect()}
    theirs = {r[0]: r[1:] for r in factor.collect()}
    assert set(mine) == set(theirs) and abs(sum(mine[t][0] * theirs[t][0] for t in mine)) > 0.99999
    # Coordinates of the fitted frame are those that any frame gets.
    again = {r[0]: r[1:] for r in model.transform(df.select(F.col("id"), "text"), ["id"]).collect()}
    assert len(got) == 82 and set(got) == set(again)
    assert all(np.allclose(got[k], again[k], atol=1e-9) for k in got)


def test_numbers_are_packed():
    for x in (np.zeros(0, dtype=np.int64), np.array([0]), np.array([1, 255]), np.arange(70_000), np.array([7, 1 << 40])):
        assert grams._unpacked(grams._packed(x)).tolist() == x.tolist()
    assert len(grams._packed(np.arange(100_000) % 7)) < 10_000


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    it, out = files.iterator(), set()
    while it.hasNext():
        out.add(it.next().getName())
    return {f for f in out if f.startswith("shuffle_")}


def test_what_a_pass_moves_does_not_stay_on_disk(spark):
    import time
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice([f"w{j}" for j in range(40)], 20))) for i in range(200)], "id long, text string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, setting = _shuffle_files(spark), spark.conf.get(name, None)
    got = grams.block_svd(df, "id", "text", 3)
    assert spark.conf.get(name, None) == setting
    until = time.time() + 20
    while _shuffle_files(spark) - held and time.time() < until:
        time.sleep(0.5)
    assert not _shuffle_files(spark) - held
    assert got.scores.count() == 200


def test_cells_are_small_and_slices_apart(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(grams, "BLOCK_CHARS", 100_000)
    words = np.array([f"w{i}" for i in range(3000)])
    df = spark.createDataFrame([(i, " ".join(words[(3000 * rng.random(150) ** 3).astype(int)])) for i in range(1500)], "id long, text string").repartition(4)
    docs, n, n_docs, _ = grams._documents(df, "id", "text")
    cells, named = grams._cells(docs, n, 3, n_docs, 3, 2)
    held = cells.where("gaps is not null").collect()
    entries = sum(len(grams._unpacked(r["gaps"])) for r in held)
    assert entries == text.tfidf(df, "id", "text").count() and len(named) == 3
    assert sum(len(r["gaps"]) + len(r["tf"]) for r in held) < 3 * entries
    # A shuffle by slice puts every slice into a partition of its own.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cells.where("totals is not null").repartition(parts, "slice").selectExpr("slice", "spark_partition_id() as p").collect()
    assert len({r["p"] for r in placed}) == 3


def test_a_slice_sums_its_cells_together():
    """As many sums over all terms as the entries need, not one a cell."""
    rng = np.random.default_rng(3)
    cells = [(rng.integers(0, 9, 40), rng.integers(0, 50, 40), rng.random(40), rng.random((2, 9))) for _ in range(20)]
    want = sum(grams._sums(term, y, doc, 50, w) for doc, term, w, y in cells)
    got = list(grams._together(iter(cells), 200))
    assert len(got) == 4 and np.allclose(sum(grams._sums(term, y, doc, 50, w) for doc, term, w, y in got), want, atol=1e-12)
