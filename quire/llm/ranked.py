"""Ranked lexical search by NRA (no random access) over impact-sorted postings.

Terms are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. The score of a
document is a sum of whole-number impacts, one for each query term it holds, so for a query every term has a
list of (document, impact). The lists are read from the largest impact down, all of a query's lists in step.
What a list has yet to give is at most its next impact. A document seen in some lists therefore has
a lower bound (the impacts seen) and an upper bound (plus the next impacts of the lists in
which it was not seen); one never seen has the sum of all next impacts. Reading goes on until every
document whose upper bound reaches the k-th best lower bound has equal bounds: then members,
ties and scores are all settled. Documents with a bound equal to the k-th score are not put aside, so ties
are decided by id. Nothing is looked up outside the order of reading.

On Spark: one pass over the whole texts writes a narrow index (document, length, its query terms with their
numbers); the statistics N, L and df are sums over it; each task then inverts the index in
segments of at most ``SEGMENT`` documents and reads their lists, and the k-th best score that its earlier segments
gave a query bounds the later ones, which mostly end after the first blocks. The best k of each task are ranked by
query. Queries are taken in blocks of at most ``QUERY_TERMS`` terms; only the terms of one block are broadcast.

Defined results: null and empty texts have no terms and no rank, null or empty queries no rows; rows
that repeat a query id are one query with the terms of all; rows that repeat a document id are ranked each; a null document
id comes before others among ties; an empty table gives no rows; other columns are never read.
"""
from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.tables import read_table

from .common import beside, documents, stable

TOP = 10
#: Documents whose lists a task holds at a time; postings read from each list in the first round; terms of a block of queries.
SEGMENT, READ, QUERY_TERMS = 1 << 13, 32, 1 << 17
#: Bytes that part terms become spaces, A-Z become a-z, all others stay.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each query."""
    def make():
        def run(texts):
            found = [(i, t) for i, x in enumerate(texts) for t in set(terms_of(x))]
            return {"_row": [i for i, _ in found], "term": [t for _, t in found]}
        return run

    return beside(queries, make, "term binary", keep=["item_id"]).distinct()


def index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's length and its numbered query terms; documents without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        number = {t: i for i, t in enumerate(shared.value)}

        def run(texts):
            rows, n, held, tfs = [], [], [], []
            for i, x in enumerate(texts):
                found = terms_of(x)
                if found:
                    tf = Counter(filter(number.__contains__, found))
                    rows.append(i)
                    n.append(len(found))
                    held.append([number[t] for t in tf])
                    tfs.append(list(tf.values()))
            return {"_row": rows, "n": n, "terms": held, "tfs": tfs}
        return run

    return beside(docs, make, "n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(lengths: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, in exact integers."""
    return np.array([10 + 90 * n * n_docs // n_terms for n in lengths], dtype=np.int64)


class Lists:
    """Impact-sorted postings of one segment."""

    def __init__(self, n: list[int], terms: list[list[int]], tfs: list[list[int]], n_docs: int, n_terms: int, weights: dict[int, int]):
        self.docs = len(n)
        at = np.repeat(np.arange(self.docs), [len(t) for t in terms])
        term = np.array([x for t in terms for x in t], dtype=np.int64)
        tf = np.array([x for t in tfs for x in t], dtype=np.int64)
        m = length_norms(n, n_docs, n_terms)[at] if self.docs else at
        of = np.array([weights[t] for t in np.unique(term).tolist()], dtype=np.int64)
        impact = of[np.unique(term, return_inverse=True)[1]] * (1_000_000_000 * tf // (1000 * tf + 8 * m)) if len(term) else tf
        order = np.lexsort((at, -impact, term))
        term, self.at, self.impact = term[order], at[order], impact[order]
        names, first = np.unique(term, return_index=True)
        self.range = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)])))

    def read(self, terms: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold all of the best k with a score of ``floor`` or more, ties included."""
        lists = [self.range[t] for t in terms if t in self.range]
        low = np.zeros(self.docs, dtype=np.int64)
        seen = np.zeros((len(lists), self.docs), dtype=bool)
        done, size = 0, READ
        while True:
            ahead = np.zeros(len(lists), dtype=np.int64)
            for i, (s, e) in enumerate(lists):
                part = slice(min(e, s + done), min(e, s + done + size))
                low[self.at[part]] += self.impact[part]
                seen[i, self.at[part]] = True
                ahead[i] = self.impact[part.stop] if part.stop < e else 0
            done, size = done + size, 2 * size
            left = int(ahead.sum())
            high = low + left - ahead @ seen
            kth = int(np.partition(low, -k)[-k]) if self.docs >= k else 0
            open_ = high >= max(1, floor, kth)
            if not left or not (open_ & (high > low)).any():
                return np.flatnonzero(open_), low[open_]


def _best(found: list[tuple[int, tuple, object]], k: int) -> list:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def read_lists(rows: DataFrame, queries: dict, weights: dict[int, int], n_docs: int, n_terms: int, k: int, item_type) -> DataFrame:
    """The best k (item_id, doc_id, score) of every task for each query (item -> numbers of its terms)."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights))
    schema = StructType([item_type, rows.schema["doc_id"]] + StructType.fromDDL("score long").fields)

    def run(batches):
        queries, weights = shared.value
        best: dict = {i: [] for i in queries}

        def finish(held):
            ids = [x for b in held for x in b.column("doc_id").to_pylist()]
            n, terms, tfs = ([x for b in held for x in b.column(c).to_pylist()] for c in ("n", "terms", "tfs"))
            lists = Lists(n, terms, tfs, n_docs, n_terms, weights)
            for item, own in queries.items():
                top = best[item]
                at, score = lists.read(own, k, top[-1][0] if len(top) == k else 0)
                if len(at):
                    new = [(s, (ids[a] is not None, ids[a]) if ids[a] is not None else (False, 0), ids[a]) for a, s in zip(at.tolist(), score.tolist())]
                    best[item] = _best(top + new, k)

        held, size = [], 0
        for b in batches:
            for s in range(0, b.num_rows, SEGMENT):
                part = b.slice(s, SEGMENT)
                if held and size + part.num_rows > SEGMENT:
                    finish(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            finish(held)
        out = [(i, d, s) for i, top in best.items() for s, _, d in top]
        shape = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(shape)], schema=shape)

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def query_blocks(terms: DataFrame) -> list[DataFrame]:
    """The (item_id, term) rows in blocks of whole queries with about ``QUERY_TERMS`` terms each."""
    blocks = max(1, math.ceil(terms.count() / QUERY_TERMS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [terms.where(part == b) for b in range(blocks)]


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best k documents of each query, equal scores by ascending doc_id."""
    found = []
    for block in query_blocks(stable(query_terms(queries))):
        of: dict = {}
        for r in block.collect():  # one block: a bounded number of terms
            of.setdefault(r["item_id"], []).append(bytes(r["term"]))
        terms = sorted({t for own in of.values() for t in own})
        number = {t: i for i, t in enumerate(terms)}
        rows = stable(index(docs, terms))
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        weights = {t: weight(n_docs, c) for t, c in df.items()}
        asked = {i: sorted(number[t] for t in own if number[t] in df) for i, own in of.items()}
        found.append(read_lists(rows, {i: own for i, own in asked.items() if own}, weights, n_docs, n_terms, k, queries.schema["item_id"]))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir) -> DataFrame:
    return search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
p AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nd),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
