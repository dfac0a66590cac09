"""TF-IDF by blocks of documents: a term's text leaves its block once, however many documents of the block hold it.

Documents go to blocks by key. A block numbers its terms and sends each with its count of documents to the term's
slice; a slice adds the counts of all blocks and answers with numbers alone, in the order of the block's terms.
Entries (document, term) are never shuffled: the block counts them anew and weighs them with the answers. Blocks and
slices grow in number with the texts, not in size. Terms are those of ``text.tokens``.

The decomposition keeps one matrix on disk, of packed numbers. What a pass moves is deleted with the pass.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.operators.joins import apart
from quire.session import shuffles_released

#: Characters of the texts of a block and of a slice of the decomposition; entries of a batch of weights.
BLOCK_CHARS, SLICE_CHARS, BATCH = 8_000_000, 400_000_000, 1 << 16
_MESSAGE = "block int, slice int, lengths binary, letters binary, df binary"


@dataclass
class Block:
    """The entries (document, term, tf) of some documents; terms are in order of their slices."""
    keys: pa.Array
    terms: pa.Array
    slices: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def _hashed(tokens: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in tokens.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def counted(rows: pa.Table, slices: int, ngram_max: int) -> Block:
    """Counts the terms of rows (key, hash of the text, tokens); the same rows in any order give the same numbers."""
    rows = rows.sort_by([("key", "ascending"), ("h", "ascending")])
    keys, lists = rows["key"].combine_chunks().dictionary_encode(), rows["t"].combine_chunks()
    tokens = lists.flatten().dictionary_encode()
    words, codes = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
    n, h = len(words), _hashed(tokens.dictionary)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    grams, docs = codes, keys.indices.to_numpy().astype(np.int64)[row]
    if ngram_max >= 2:
        inside = np.flatnonzero(row[1:] == row[:-1])
        grams, docs = np.concatenate([grams, n + codes[inside] * n + codes[inside + 1]]), np.concatenate([docs, docs[inside]])
    held, at = np.unique(grams, return_inverse=True)
    one, two = held[held < n], held[held >= n] - n
    first, second = two // max(n, 1), two % max(n, 1)
    terms = pa.concat_arrays([words.take(pa.array(one)), pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")])
    # The slice of a term follows from its words alone.
    mixed = np.concatenate([h[one], (h[first] << np.uint64(32)) ^ h[second]]) * np.uint64(0x9E3779B97F4A7C15)
    own = ((mixed >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
    order = own.argsort(kind="stable")
    place = np.empty(len(held), dtype=np.int64)
    place[order] = np.arange(len(held))
    entries, tf = np.unique(docs * max(len(held), 1) + place[at], return_counts=True)
    return Block(keys.dictionary, terms.take(pa.array(order)), own[order], *np.divmod(entries, max(len(held), 1)), tf)


def _sent(number: int, b: Block) -> Iterator[pa.RecordBatch]:
    """A message for each slice: the lengths and letters of the block's terms and how many of its documents hold each."""
    df = np.bincount(b.term, minlength=len(b.terms)).astype(np.int32)
    offsets, letters = np.frombuffer(b.terms.buffers()[1], dtype=np.int32)[b.terms.offset:b.terms.offset + len(b.terms) + 1], memoryview(b.terms.buffers()[2])
    own, starts = np.unique(b.slices, return_index=True)
    out = [(number, int(s), np.diff(offsets[i:j + 1]).tobytes(), bytes(letters[offsets[i]:offsets[j]]), df[i:j].tobytes())
           for s, i, j in zip(own, starts, [*starts[1:], len(df)])]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["block", "slice", "lengths", "letters", "df"])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest of them, first bytes first, compressed."""
    x = np.ascontiguousarray(x, dtype=np.min_scalar_type(int(x.max(initial=0))))
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return x.dtype.char.encode() + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    kind, size = np.dtype(raw[:1].decode()), int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _folded(sent: pa.RecordBatch) -> pa.RecordBatch:
    """Messages with their numbers and letters packed."""
    kinds = {"lengths": np.int32, "letters": np.uint8, "df": np.int32}
    more = [pa.array([_packed(np.frombuffer(x, dtype=k)) for x in sent[c].to_pylist()], pa.binary()) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays([sent["block"], sent["slice"], *more], sent.schema.names)


def _strings(lengths: list[bytes], letters: list[bytes]) -> pa.Array:
    """The terms of several messages, one after another."""
    sizes = np.concatenate([_unpacked(x) for x in lengths])
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(b"".join(_unpacked(x).tobytes() for x in letters)))


def _words(row: dict) -> pa.Array:
    """The vocabulary of a slice."""
    return _strings([row["lengths"]], [row["letters"]])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each block of a task."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    for number in sorted(pc.unique(table["block"]).to_pylist()) if table is not None else []:
        yield number, table.filter(pc.equal(table["block"], number))


def _documents(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int, int, int]:
    """(block, key, hash of the text, text), the number of blocks, of different keys and of characters."""
    docs = df.where(quote(key).isNotNull()).select(quote(key).alias("key"), quote(text).alias("x"))
    size = docs.agg(F.sum(F.length("x")).alias("chars"), F.count_distinct("key").alias("n")).first()
    chars = size["chars"] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BLOCK_CHARS))
    return docs.select(F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("block"), "key", F.xxhash64("x").alias("h"), "x"), n, size["n"], chars


def _spelt(rows: DataFrame, *more: str) -> DataFrame:
    from quire.operators.text import tokens
    return rows.select("block", "key", "h", tokens(F.col("x")).alias("t"), *more)


def _answers(docs: DataFrame, n: int, slices: int, min_df: int, ngram_max: int) -> DataFrame:
    """The slices' answers: for the terms of a block, in its order, the documents that hold each (0: fewer than ``min_df``) and its place
    in the slice's vocabulary. The vocabulary itself is the row of block -1."""
    def send(batches):
        for number, rows in _tables(batches):
            block = counted(rows, slices, ngram_max)
            if len(block.terms):
                yield from map(_folded, _sent(number, block))

    def answer(batches):
        held = list(batches)
        every = pa.Table.from_batches(held).sort_by([("slice", "ascending"), ("block", "ascending")]) if held else None
        for own in pc.unique(every["slice"]).to_pylist() if held else ():
            rows = every.filter(pc.equal(every["slice"], own))
            held_by = [_unpacked(x) for x in rows["df"].to_pylist()]
            sizes = list(map(len, held_by))
            terms = _strings(rows["lengths"].to_pylist(), rows["letters"].to_pylist()).dictionary_encode()
            at = terms.indices.to_numpy()
            total = np.bincount(at, np.concatenate(held_by)).astype(np.int64)
            total[total < min_df] = 0
            kept = np.flatnonzero(total)
            place = np.zeros(len(total), dtype=np.int32)
            place[kept] = np.arange(len(kept))
            words = terms.dictionary.take(pa.array(kept)).cast(pa.binary()).to_pylist()
            out = [(-1, own, _packed(total[kept]), b"", _packed(np.array(list(map(len, words)), dtype=np.int64)), _packed(np.frombuffer(b"".join(words), dtype=np.uint8)))]
            for number, j, k in zip(rows["block"].to_pylist(), np.cumsum(sizes), sizes):
                out.append((number, own, _packed(total[at[j - k:j]]), _packed(place[at[j - k:j]]), b"", b""))
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        kinds = {"block": pa.int32(), "slice": pa.int32(), "totals": pa.binary(), "places": pa.binary(), "lengths": pa.binary(), "letters": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds.values())], list(kinds))

    sent = _spelt(docs.repartitionById(n, F.col("block"))).mapInArrow(send, _MESSAGE)
    return sent.repartitionById(slices, F.col("slice")).mapInArrow(answer, "block int, slice int, totals binary, places binary, lengths binary, letters binary")


def _weighed(docs: DataFrame, answers: DataFrame, n: int, slices: int, n_docs: int, ngram_max: int, emit, schema: str) -> DataFrame:
    """What ``emit(block number, block, kept entries, their raw weights, norms of the documents, places of the terms)`` gives for each block."""
    def weigh(batches):
        for number, rows in _tables(batches):
            got = rows.filter(pc.is_valid(rows["totals"])).sort_by("slice")
            total, places = (np.concatenate([np.zeros(0, dtype=np.int64), *map(_unpacked, got[c].to_pylist())]) for c in ("totals", "places"))
            b = counted(rows.filter(pc.is_null(rows["totals"])), slices, ngram_max)
            if len(total) != len(b.terms):
                raise ValueError("the documents changed while they were read")
            kept = np.flatnonzero(total[b.term])
            raw = b.tf[kept] * (np.log((1.0 + n_docs) / (1.0 + total[b.term[kept]])) + 1)
            norms = np.sqrt(np.bincount(b.doc[kept], raw * raw, len(b.keys)))
            yield from emit(number, b, kept, raw, norms, places)

    own = answers.where("block >= 0").select("block", "slice", "totals", "places")
    both = docs.unionByName(own, allowMissingColumns=True).repartitionById(n, F.col("block"))
    return _spelt(both, "slice", "totals", "places").mapInArrow(weigh, schema)


def block_tfidf(df: DataFrame, key: str, text: str, min_df: int = 3, ngram_max: int = 2) -> DataFrame:
    """(key, term, tfidf): every term in at least ``min_df`` documents."""
    docs, n, n_docs, _ = _documents(df, key, text)

    def emit(_, b, kept, raw, norms, places):
        doc, term = b.doc[kept], b.term[kept]
        w = raw / norms[doc]
        for s in range(0, len(w), BATCH):
            yield pa.RecordBatch.from_arrays([b.keys.take(pa.array(doc[s:s + BATCH])), b.terms.take(pa.array(term[s:s + BATCH])),
                                              pa.array(w[s:s + BATCH])], ["key", "term", "tfidf"])

    kind = docs.schema["key"].dataType.simpleString()
    rows = _weighed(docs, _answers(docs, n, n, min_df, ngram_max), n, n, n_docs, ngram_max, emit, f"key {kind}, term string, tfidf double")
    return rows.select(F.col("key").alias(key), "term", "tfidf")


# ---------------------------------------------------------------- truncated SVD

def _normal(terms: pa.Array, dims: int, seed: int) -> np.ndarray:
    """Standard normal numbers of each term, the same for any partitioning."""
    from quire.operators.trees import _mixed
    h = _mixed(_mixed(_hashed(terms) + np.uint64(seed))[:, None] + np.arange(1, 2 * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    u = ((h >> np.uint64(12)) + 0.5) / float(1 << 52)
    return np.sqrt(-2 * np.log(u[:, :dims])) * np.cos(2 * np.pi * u[:, dims:])


def _sums(at: np.ndarray, columns: np.ndarray, rows: np.ndarray, size: int, w: np.ndarray) -> np.ndarray:
    """(columns, size): the sums by ``at`` of w times the ``rows`` of each column."""
    return np.stack([np.bincount(at, w * c[rows], size) for c in columns]) if len(at) else np.zeros((len(columns), size))


def _together(cells: Iterator[tuple], least: int) -> Iterator[tuple]:
    """Entries (document, term, weight) and columns (l, documents) of several cells as those of one, with at least ``least`` entries but for the last."""
    held: list[tuple] = []

    def joined():
        starts = np.cumsum([0, *[y.shape[1] for *_, y in held]])
        return (np.concatenate([doc + i for (doc, *_), i in zip(held, starts)]), *[np.concatenate([c[i] for c in held]) for i in (1, 2)], np.ascontiguousarray(np.concatenate([c[3] for c in held], axis=1)))

    for cell in cells:
        held.append(cell)
        if sum(len(c[0]) for c in held) >= least:
            yield joined()
            held = []
    if held:
        yield joined()


@dataclass
class BlockSVD:
    """Singular values, loadings (term, f0…), the vocabulary (term, df, idf) and the documents' coordinates (key, f0…)."""
    values: np.ndarray
    factor: DataFrame
    idf: DataFrame
    scores: DataFrame


def block_svd(df: DataFrame, key: str, text: str, k: int, min_df: int = 3, ngram_max: int = 2, n_oversample: int = 10, n_iter: int = 4, seed: int = 42) -> BlockSVD:
    """Randomized subspace iteration on the TF-IDF matrix, cut into cells (slice of terms, block of documents).

    A pass gathers the packed cells by slices and sends the (documents x l) factor to every slice; a slice forms its rows of z = A' y and adds A z to each block. The
    (terms x l) factor never leaves its slice, and slices grow in number with the texts only beyond one a core. l x l matrices reach the driver.
    """
    with shuffles_released(df.sparkSession):
        return _block_svd(df, key, text, k, min_df, ngram_max, n_oversample, n_iter, seed)


def _cells(docs: DataFrame, n: int, slices: int, n_docs: int, min_df: int, ngram_max: int) -> tuple[DataFrame, list[int]]:
    """The matrix, written once, and the slices' numbers: the cells (slice, block, gaps, width, tf), each slice's vocabulary (slice, totals,
    lengths, letters) and, under slices below 0, each block's keys and norms.

    A cell's entries are in order of documents and terms: document * width + term is the running sum of its gaps.
    """
    answers = _answers(docs, n, slices, min_df, ngram_max).checkpoint()
    kind = docs.schema["key"].dataType.simpleString()
    named = apart(docs.sparkSession, slices)

    def emit(number, b, kept, raw, norms, places):
        doc, term, tf = b.doc[kept], b.term[kept], b.tf[kept]
        own = b.slices[term]
        order = own.argsort(kind="stable")
        held, starts = np.unique(own[order], return_index=True)
        out = [(-1 - number, number, None, None, None, np.where(norms > 0, norms, 1.0).tobytes(), b.keys.to_pylist())]
        for s, i, j in zip(held.tolist(), starts, [*starts[1:], len(order)]):
            at = order[i:j]
            place = places[term[at]].astype(np.int64)
            width = int(place.max()) + 1
            flat = doc[at] * width + place
            ordered = flat.argsort(kind="stable")
            out.append((named[s], number, _packed(np.diff(flat[ordered], prepend=0)), width, _packed(tf[at][ordered]), None, None))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(b.keys.type)]
        for s in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[s:s + 64]), kinds)], ["slice", "block", "gaps", "width", "tf", "norms", "keys"])

    cells = _weighed(docs, answers, n, slices, n_docs, ngram_max, emit, f"slice int, block int, gaps binary, width long, tf binary, norms binary, keys array<{kind}>")
    words = answers.where("block < 0").select(F.array(*map(F.lit, named))[F.col("slice")].alias("slice"), "totals", "lengths", "letters")
    return cells.unionByName(words, allowMissingColumns=True).checkpoint(), named


def _block_svd(df: DataFrame, key: str, text: str, k: int, min_df: int, ngram_max: int, n_oversample: int, n_iter: int, seed: int) -> BlockSVD:
    from quire.operators.linalg import sym_eig_desc
    from quire.session import ensure_checkpoint_dir
    spark, dims = df.sparkSession, k + n_oversample
    ensure_checkpoint_dir(spark)
    docs, n, n_docs, chars = _documents(df, key, text)
    slices = max(spark.sparkContext.defaultParallelism, -(-chars // SLICE_CHARS))
    kind = docs.schema["key"].dataType.simpleString()
    cells, named = _cells(docs, n, slices, n_docs, min_df, ngram_max)
    own = cells.where("slice >= 0").drop("keys", "norms")
    heads = cells.where("slice < 0").select("block", "norms", "keys").checkpoint()

    def weights(totals):
        return np.log((1.0 + n_docs) / (1.0 + totals)) + 1

    def loaded(rows: pa.Table):
        head = rows.filter(pc.is_valid(rows["totals"])).to_pylist()[0]
        return _words(head), weights(_unpacked(head["totals"])), rows.filter(pc.is_null(rows["totals"])).select(["block", "gaps", "width", "tf"]).to_pylist()

    def entries(cell, idf):
        doc, term = np.divmod(np.cumsum(_unpacked(cell["gaps"]), dtype=np.int64), cell["width"])
        return doc, term, _unpacked(cell["tf"]) * idf[term]

    def product(width, rows, ys):
        """The columns of z = A' y of a slice (standard normal without y). Few cells hold all its terms: their entries are summed together."""
        terms, idf, held = loaded(rows)
        if ys is None:
            return terms, idf, held, np.ascontiguousarray(_normal(terms, width, seed).T)
        y = {b: np.frombuffer(x.as_buffer()).reshape(-1, width).T for b, x in zip(ys["block"].to_pylist(), ys["y"])}
        z = np.zeros((width, len(terms)))
        for doc, term, w, columns in _together(((*entries(c, idf), y[c["block"]]) for c in held), max(1 << 18, len(terms))):
            z += _sums(term, columns, doc, len(terms), w)
        return terms, idf, held, z

    def added(width, rows, ys):
        if not rows.num_rows:   # a slice without terms
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "y"])
        _, idf, held, z = product(width, rows, ys)
        out = [(-1, (z @ z.T).tobytes())]
        for c in held:
            doc, term, w = entries(c, idf)
            out.append((c["block"], _sums(doc, z, term, int(doc[-1]) + 1, w).T.tobytes()))
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.binary()))], ["block", "y"])

    def total(width):
        def run(key: tuple, parts: pa.Table, head: pa.Table) -> pa.Table:
            """The sums of a block, by the norms of its documents."""
            norms = np.frombuffer(head["norms"][0].as_py()) if head.num_rows else np.ones(width)
            out = np.zeros((len(norms), width))
            for x in parts["y"]:
                x = np.frombuffer(x.as_buffer()).reshape(-1, width)
                out[:len(x)] += x
            some = [(key[0].as_py(), (out / norms[:, None]).tobytes(), norms.tobytes())] if parts.num_rows else []
            return pa.table([pa.array([r[i] for r in some], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "y", "norms"])
        return run

    def copied(y, width):
        """To every slice, the rows of y by the norms of their documents."""
        def run(batches):
            for b in batches:
                out = [(np.frombuffer(x).reshape(-1, width) / np.frombuffer(norms)[:, None]).tobytes() for x, norms in zip(b.column("y").to_pylist(), b.column("norms").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], ["block", "y"])
        return y.mapInArrow(run, "block int, y binary").select(F.explode(F.array(*map(F.lit, named))).alias("slice"), "block", "y")

    def applied(y, width):
        """A z by blocks and z'z."""
        if y is None:
            parts = own.groupBy("slice").applyInArrow(lambda rows: added(width, rows, None), "block int, y binary")
        else:
            parts = own.groupBy("slice").cogroup(copied(y, width).groupBy("slice")).applyInArrow(lambda rows, ys: added(width, rows, ys), "block int, y binary")
        both = parts.groupBy("block").cogroup(heads.drop("keys").groupBy("block")).applyInArrow(total(width), "block int, y binary, norms binary").checkpoint()
        g = both.where("block < 0").first()
        return both.where("block >= 0"), np.frombuffer(g["y"]).reshape(width, width) if g else np.zeros((width, width))

    def turned(y, width, m):
        def run(batches):
            for b in batches:
                out = [(np.frombuffer(x).reshape(-1, width) @ m).tobytes() for x in b.column("y").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary()), b.column("norms")], ["block", "y", "norms"])
        return y.mapInArrow(run, "block int, y binary, norms binary")

    def table(batches):
        for b in batches:
            for r in b.to_pylist():
                totals = _unpacked(r["totals"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_words(r).cast(pa.string()), pa.array(totals), pa.array(weights(totals))], ["term", "df", "idf"])

    idf = own.where("totals is not null").select("totals", "lengths", "letters").mapInArrow(table, "term string, df long, idf double")
    y, g = applied(None, dims)
    before = None
    for _ in range(n_iter):
        z, g = applied(y, dims)
        w, u = sym_eig_desc(g)
        keep = w > max(float(w[0]), 0.0) * 1e-14
        m = u[:, keep] / np.sqrt(w[keep])
        if not keep.any():
            return BlockSVD(np.zeros(0), None, idf, None)
        before, width = turned(y, dims, m), int(keep.sum())
        y, dims = turned(z, dims, m), width

    def gram(batches):
        out = np.zeros((dims, dims))
        for b in batches:
            for x in b.column("y").to_pylist():
                x = np.frombuffer(x).reshape(-1, dims)
                out += x.T @ x
        yield pa.RecordBatch.from_pydict({"y": [out.tobytes()]})

    w, u = sym_eig_desc(sum(np.frombuffer(r["y"]).reshape(dims, dims) for r in y.mapInArrow(gram, "y binary").collect()))
    k = min(k, dims)

    def vectors(rows, ys):
        if not rows.num_rows:
            return pa.array([], pa.string()), np.zeros((0, k))
        terms, _, _, z = product(dims, rows, ys)
        return terms.cast(pa.string()), z.T @ u[:, :k]

    def peaks(rows, ys):
        """The entry of largest size of each vector in a slice (of equal ones, that of the last term)."""
        terms, z = vectors(rows, ys)
        out = []
        for j in range(k if len(terms) else 0):
            size = np.abs(z[:, j])
            term, at = max((terms[int(i)].as_py(), int(i)) for i in np.flatnonzero(size == size.max()))
            out.append((j, size[at], term, z[at, j]))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.string(), pa.float64()))], ["j", "size", "term", "value"])

    # the entry of largest size of each vector is positive
    sliced = own.groupBy("slice").cogroup(copied(before, dims).groupBy("slice"))
    largest = {}
    for r in sliced.applyInArrow(peaks, "j int, size double, term string, value double").collect():
        largest[r["j"]] = max(largest.get(r["j"], (-1.0, "", 0.0)), (r["size"], r["term"], r["value"]))
    signs = np.array([-1.0 if largest[j][2] < 0 else 1.0 for j in range(k)])
    m = u[:, :k] * signs

    def loadings(rows, ys):
        terms, z = vectors(rows, ys)
        return pa.table([terms, *[pa.array(z[:, j] * signs[j]) for j in range(k)]], ["term", *[f"f{j}" for j in range(k)]])

    def coordinates(rows: pa.Table, ys: pa.Table) -> pa.Table:
        keys = pc.list_flatten(rows["keys"])
        x = np.frombuffer(ys["y"][0].as_py()).reshape(-1, dims) @ m if ys.num_rows else np.zeros((len(keys), k))
        return pa.table([keys, *[pa.array(x[:, j]) for j in range(k)]], ["key", *[f"f{j}" for j in range(k)]])

    columns = ", ".join(f"f{j} double" for j in range(k))
    # The loadings are as many as the terms: they are formed by a pass when they are asked for, and not written.
    factor = sliced.applyInArrow(loadings, f"term string, {columns}")
    scores = heads.drop("norms").groupBy("block").cogroup(y.drop("norms").groupBy("block")).applyInArrow(coordinates, f"key {kind}, {columns}")
    return BlockSVD(np.sqrt(np.maximum(w[:k], 0.0)), factor, idf, scores)
