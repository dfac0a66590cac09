"""Best-fit packing with large-item matching.

Texts become token ids (tokenizers, plus the end id), longer ones are cut into
capacity-sized pieces. Lengths are integers up to the capacity, so the whole packing
problem is a histogram of at most ``capacity`` counts: pieces above a third
of the capacity (at most two fit a bin, three cannot) are matched greedily,
longest first with the longest partner that still fits; smaller pieces, longest
first, go to the bin with the least sufficient gap, a new bin if none has one.
Bins of equal filling are one run, so each decision places a whole class of
equal pieces and its cost does not depend on the number of documents.

Spark then gives every piece its exact rank among pieces of its length (rank in
its task plus the counts of earlier tasks) and looks up the rank's place in the
plan. Only the histogram reaches the driver; the plan sent back has a bounded
number of entries (lengths times runs touched), not rows per document.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed once each; an empty table gives no rows; other columns
are never read.
"""
from __future__ import annotations

import os
import zlib
from itertools import islice

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, blocks, documents, stable

CAPACITY = 4096
END_ID = 1
#: Characters encoded at a time; words that a worker keeps, and new ones it first holds on trial; longest word remembered.
BLOCK_CHARS, REMEMBERED, TRIAL, LONGEST = 1 << 20, 3 << 17, 1 << 17, 64
#: A digit is always a word piece of its own for the tokenizer; new words encoded in one text.
MARK, TOGETHER = "0", 1024
#: What the last piece of each run of letters, digits or other characters ends with in the tokenizer's vocabulary.
WORD_END = "</w>"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes whole texts word by word, remembering the ids of words.

    The tokenizer's own splitting never joins characters across a space and its
    normaliser treats every character between spaces by itself, so the ids of a text are
    those of its space-separated words in a row (``tests/llm`` compares with whole texts).
    Special tokens hold no space; with ``special_as_text`` their strings are split like any
    other word, without it they become their ids, as the tokenizer does by itself.
    New words are held on trial, ``TRIAL`` at a time: those not met again while the next ones are on trial are forgotten, the others stay
    (``REMEMBERED`` of them at most, the oldest go first). Most words occur once, so few of them take room.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special_as_text
        self.batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
        self.known: dict[str, bytes] = {}
        self.trial: set[str] = set()
        self.leaving: set[str] = set()
        (self.mark_id,) = tok.encode(MARK, add_special_tokens=False).ids
        vocabulary = tok.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _cut(self, words: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        """Remembers each word's ids; ``ends`` are the places after them, followed by ``skip`` ids of a mark."""
        raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + skip])
        self.known.update(zip(words, map(lambda s, e: raw[s:e], (4 * starts).tolist(), (4 * ends).tolist())))

    def _marked(self, words: list[str]) -> None:
        """Many words in one text, parted by a word whose id no other word can yield."""
        parts = [words[s:s + TOGETHER] for s in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.batch([f" {MARK} ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            self._cut(part, ids, np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)

    def _learn(self, new: set[str]) -> None:
        alone = [w for w in new if MARK in w]
        for w, e in zip(alone, self.batch(alone, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        letters, others = [], [""] if "" in new else []
        for w in new.difference(alone, [""]):
            (letters if w.isalpha() else others).append(w)
        parts = [letters[s:s + TOGETHER] for s in range(0, len(letters), TOGETHER)]
        for part, e in zip(parts, self.batch([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            # Each word closes at least once; as many ends as words means that each is one run of letters for the tokenizer too.
            if len(ends) == len(part):
                self._cut(part, ids, ends, 0)
            else:
                others += part
        self._marked(others)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        distinct = set().union(*split)
        new = distinct.difference(self.known)
        self._learn(new)
        of = self.known.__getitem__
        out = [b"".join(map(of, words)) for words in split]
        self._forget(distinct, new)
        return out

    def _forget(self, met: set[str], new: set[str]) -> None:
        self.leaving -= met
        for w in [w for w in new if len(w) > LONGEST]:
            del self.known[w]
            new.discard(w)
        self.trial |= new
        if len(self.trial) > TRIAL:
            for w in self.leaving:
                del self.known[w]
            self.leaving, self.trial = self.trial, set()
        if len(self.known) > REMEMBERED + len(self.leaving) + len(self.trial):
            settled = (w for w in self.known if w not in self.leaving and w not in self.trial)
            for w in list(islice(settled, REMEMBERED // 4)):
                del self.known[w]


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder_of(path: str, special_as_text: bool) -> WordEncoder:
    """One encoder for each Python worker, so that its tasks share the words remembered."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, special_as_text)
    return _ENCODERS[key]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, local_rank); local_rank counts equal lengths within a task."""
    def make():
        encoder, end = encoder_of(path, False), np.array([end_id], dtype="<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), {}

        def run(texts):
            out: dict[str, list] = {c: [] for c in ("_row", "piece", "start", "length", "ids_crc32", "task", "local_rank")}
            add = [x.append for x in out.values()]
            texts = [t or "" for t in texts]
            for at, upto in blocks(texts, BLOCK_CHARS):
                for j, raw in enumerate(encoder.encode(texts[at:upto]), at):
                    raw += end
                    for k, s in enumerate(range(0, len(raw) // 4, capacity)):
                        p = raw[4 * s:4 * (s + capacity)]
                        n = len(p) // 4
                        r = seen[n] = seen.get(n, -1) + 1
                        for f, v in zip(add, (j, k, s, n, zlib.crc32(p), task, r)):
                            f(v)
            return out
        return run

    return beside(docs, make, "piece int, start long, length long, ids_crc32 long, task int, local_rank long")


class Plan:
    """Entries (length, first rank, per bin, first bin, offset) of a packed histogram, and the number of bins."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.bins = 0
        self._used: dict[int, int] = {}
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, bins)
        self.capacity = capacity
        left = {n: c for n, c in histogram.items() if c}
        self._match({n: c for n, c in left.items() if 3 * n > capacity})
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(n, left[n])

    def _put(self, n: int, items: int, per_bin: int, first_bin: int, offset: int) -> None:
        self.entries.append((n, self._used.get(n, 0), per_bin, first_bin, offset))
        self._used[n] = self._used.get(n, 0) + items

    def _open(self, count: int, gap: int) -> int:
        first, self.bins = self.bins, self.bins + count
        if gap:
            self._gaps.setdefault(gap, []).append((first, count))
        return first

    def _match(self, left: dict[int, int]) -> None:
        for n in sorted(left, reverse=True):
            for m in sorted((m for m in left if m <= min(n, self.capacity - n)), reverse=True):
                pairs = left[n] // 2 if m == n else min(left[n], left[m])
                if not pairs:
                    continue
                first = self._open(pairs, self.capacity - n - m)
                if m == n:
                    self._put(n, 2 * pairs, 2, first, 0)
                else:
                    self._put(n, pairs, 1, first, 0)
                    self._put(m, pairs, 1, first, n)
                left[n] -= pairs
                left[m] -= pairs
            if left[n]:
                first = self._open(left[n], self.capacity - n)
                self._put(n, left[n], 1, first, 0)
                left[n] = 0

    def _fit(self, n: int, items: int) -> None:
        for gap in sorted(g for g in self._gaps if g >= n):
            each = gap // n
            runs = self._gaps.pop(gap)
            while runs and items:
                first, count = runs.pop()
                full = min(count, items // each)
                rest = min(items - full * each, each - 1) if full < count else 0
                if full:
                    self._put(n, full * each, each, first, self.capacity - gap)
                    self._keep(gap - each * n, first, full)
                if rest:
                    self._put(n, rest, rest, first + full, self.capacity - gap)
                    self._keep(gap - rest * n, first + full, 1)
                items -= full * each + rest
                self._keep(gap, first + full + bool(rest), count - full - bool(rest))
            for first, count in runs:
                self._keep(gap, first, count)
            if not items:
                return
        if items:
            each = self.capacity // n
            full, rest = divmod(items, each)
            if full:
                self._put(n, full * each, each, self._open(full, self.capacity - each * n), 0)
            if rest:
                self._put(n, rest, rest, self._open(1, self.capacity - rest * n), 0)

    def _keep(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self._gaps.setdefault(gap, []).append((first, count))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stable(cut(docs, path or tokenizer_path(), capacity, end_id))
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).select("task", "length", "before")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(Plan(histogram, capacity).entries) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("local_rank") + F.col("before")).drop("task", "local_rank", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def make():
        plan, shift = shared.value, 1 << 48
        keys = plan[:, 0] * shift + plan[:, 1]

        def place(lengths, ranks):
            n, r = np.array(lengths, dtype=np.int64), np.array(ranks, dtype=np.int64)
            e = plan[np.searchsorted(keys, n * shift + r, side="right") - 1]
            nth = r - e[:, 1]
            return {"sequence_id": e[:, 3] + nth // e[:, 2], "offset": e[:, 4] + nth % e[:, 2] * n}
        return place

    return beside(ranked, make, "sequence_id long, offset long", keep=names, read=["length", "rank"])


def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack(documents(spark, sf_dir))
