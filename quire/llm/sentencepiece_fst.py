"""SentencePiece encoding and decoding with weighted finite-state transducers.

Three transducers are compiled from a model's piece table. The normaliser has one state (a space becomes the
mark U+2581, any other character itself) after an arc that writes one mark. The pieces are a trie in
integer tables: states by (state, character), with the piece and its weight (-score) where one ends;
a character without a piece goes through the chain of its UTF-8 bytes, whose byte pieces are its output.
The last one holds which pieces may be neighbours: a pair of pieces has an arc only if merging its characters by the
model's scores ends with just this pair. It is decided from the pieces' own merge trees, compiled once:
along the right edge of one tree and the left edge of the other, no two parts that exist at
the same time may have a merge that comes first. Composing the three with a word gives a lattice whose states are (position, last piece); the
encoding is its shortest path in the tropical semiring, ties going to the smaller piece. The decoder is
the inverse: ids to bytes by table, then the inverse normaliser.

No piece holds a mark after another character, so words part at the mark (and at line ends, if no piece
holds one) and are encoded one by one; the ids of words are remembered by each Python worker up to a bound. In a long word the
finished part of the path, which all open states share, is written out as reading goes on, so a
text without spaces needs no table of its length.

Defined results: null encodes as no ids, as does the empty text; decoding gives the text back unless
it holds the mark itself (which decodes as a space; ``decoded_equal`` is false there) or lone surrogates; repeated rows get the same
answer; an empty table gives no rows; ids of any type are kept, null ones too; other columns are never read.
"""
from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import beside, blocks, documents

MARK, CUT_MARK = "▁", "\0"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words (in two generations) and pairs of pieces that a worker remembers; longest word remembered; characters between two cuts of a long word.
REMEMBERED, PAIRS, LONGEST, CUT = 1 << 18, 1 << 19, 64, 1 << 12
BLOCK_CHARS = 1 << 20
#: Weight of a byte arc; any piece is lighter.
BYTE_COST = 1e6
LATE = 1 << 60


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """The compiled tables of one model."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, self.bytes = {}, {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[p], scores[p] = i, sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses words")
        self.longest = max(map(len, pieces))
        self._trees(pieces, scores)
        self._trie(pieces, scores)
        # The decoder: the inverse of the pieces composed with that of the normaliser, id -> output bytes.
        self.output = {i: p.replace(MARK, " ").encode("utf-8") for p, i in pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        # The normaliser's arcs, with a cut before each mark and each line end that no piece holds.
        self.cuts = [(" ", CUT_MARK + MARK), *[(c, CUT_MARK + c) for c in "\n" if not any(c in p for p in pieces)]]
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._pairs: list[dict[int, bool]] = [{} for _ in range(sp.get_piece_size())]
        self._n_pairs = 0

    def _trees(self, pieces: dict[str, int], scores: dict[str, float]) -> None:
        """Merge trees: for each piece that merging makes, the edges (part, from, until) of its tree."""
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: rank[s] for p, s in scores.items()}
        made: dict[str, tuple[int, str, str]] = {}  # part -> (when it is made, its halves)
        for p in sorted(pieces, key=len):
            parts = list(p)
            while len(parts) > 1:
                best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
                if best is None:
                    break
                k = best[1]
                last = parts[k], parts[k + 1]
                parts[k:k + 2] = ["".join(last)]
            if len(p) == 1:
                made[p] = (-1, "", "")
            elif len(parts) == 1 and all(x in made or len(x) == 1 for x in last):
                made[p] = (max(self.rank[p], *[made.get(x, (-1,))[0] for x in last]), *last)

        def edge(p: str, side: int) -> list[tuple[str, int, int]]:
            out, until = [], LATE
            while p:
                when, *halves = made.get(p, (-1, "", ""))
                out.append((p, when, until))
                p, until = halves[side], when
            return out

        self.right = {pieces[p]: edge(p, 1) for p in made if p in pieces}
        self.left = {pieces[p]: edge(p, 0) for p in made if p in pieces}

    def _trie(self, pieces: dict[str, int], scores: dict[str, float]) -> None:
        """``step[state][character]`` is the next state, ``ends[state]`` the piece that ends there (or -1), ``cost`` its weight."""
        self.step: list[dict[str, int]] = [{}]
        self.ends = [-1]
        self.cost = {}
        for p, i in pieces.items():
            if i not in self.left:
                continue
            state = 0
            for c in p:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                state = self.step[state][c]
            self.ends[state], self.cost[i] = i, -scores[p]

    def joins(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        known = self._pairs[a].get(b)
        if known is None:
            if self._n_pairs >= PAIRS:
                for row in self._pairs:
                    row.clear()
                self._n_pairs = 0
            known = self._pairs[a][b] = self._may_join(a, b)
            self._n_pairs += 1
        return known

    def _may_join(self, a: int, b: int) -> bool:
        for x, made_x, gone_x in self.right[a]:
            for y, made_y, gone_y in self.left[b]:
                r = self.rank.get(x + y)
                # Of merges with equal scores the left one goes first.
                if r is not None and (t := max(r, made_x, made_y)) < gone_x and t <= gone_y:
                    return False
        return True

    def words(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can reach across."""
        if not text:
            return []
        if "  " in text or MARK in text or CUT_MARK in text or text[0] == " ":
            return WORD.findall(MARK + text.replace(" ", MARK))
        for c, arc in self.cuts:
            text = text.replace(c, arc)
        return (MARK + text).split(CUT_MARK)

    def path(self, word: str) -> list[int]:
        """Ids on the shortest path of the word's lattice."""
        step, ends, cost_of, joins = self.step, self.ends, self.cost, self.joins
        out: list[int] = []
        # Open states by position: (cost, last piece or -1, position and number of the state before).
        states: dict[int, list[tuple[float, int, int, int]]] = {0: [(0.0, -1, -1, -1)]}
        size, written = len(word), 0
        for at in range(size):
            here = states.get(at)
            if here is None:
                continue
            state, e = 0, at
            while e < size:
                state = step[state].get(word[e], -1)
                if state < 0:
                    break
                e += 1
                piece = ends[state]
                if piece >= 0:
                    best = None
                    for k, (cost, last, _, _) in enumerate(here):
                        if (last < 0 or joins(last, piece)) and (best is None or cost < best[0]):
                            best = cost, k
                    if best is not None:
                        states.setdefault(e, []).append((best[0] + cost_of[piece], piece, at, best[1]))
            if word[at] not in step[0]:
                k = min(range(len(here)), key=lambda k: here[k][:2])
                states.setdefault(at + 1, []).append((here[k][0] + BYTE_COST, -1, at, k))
            if at - written >= CUT:
                written = self._shared(word, states, written, at, out)
        k = min(range(len(states[size])), key=lambda k: states[size][k][:2])
        tail: list[list[int]] = []
        self._back(word, states, size, k, written, tail)
        out.extend(chain.from_iterable(reversed(tail)))
        return out

    def _ids(self, word: str, piece: int, before: int, at: int) -> list[int]:
        return [piece] if piece >= 0 else [self.bytes[b] for b in word[before:at].encode("utf-8", "surrogatepass")]

    def _back(self, word: str, states, at: int, k: int, until: int, tail: list) -> None:
        while at > until:
            _, piece, before, b = states[at][k]
            tail.append(self._ids(word, piece, before, at))
            at, k = before, b

    def _shared(self, word: str, states, written: int, at: int, out: list[int]) -> int:
        """Writes out the part of the path that all open states share and drops its states."""
        trails = []
        for p in range(at + 1, min(len(word), at + self.longest) + 1):
            for k in range(len(states.get(p, ()))):
                trail, node = set(), (p, k)
                while node[0] > written:
                    trail.add(node)
                    node = states[node[0]][node[1]][2:]
                trails.append(trail)
        common = set.intersection(*trails) if trails else set()
        if not common:
            return written
        end, k = max(common)
        tail: list[list[int]] = []
        self._back(word, states, end, k, written, tail)
        out.extend(chain.from_iterable(reversed(tail)))
        for p in range(written, end):
            states.pop(p, None)
        states[end] = [(*s[:2], -1, -1) if i == k else (float("inf"), *s[1:]) for i, s in enumerate(states[end])]
        return end

    def _arcs(self, word: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a position, the longest last; a byte arc has piece -1."""
        step, ends, state, out = self.step, self.ends, 0, []
        for e in range(at, len(word)):
            state = step[state].get(word[e])
            if state is None:
                break
            if ends[state] >= 0:
                out.append((e + 1, ends[state]))
        return out if word[at] in step[0] else [(at + 1, -1), *out]

    def short_path(self, word: str) -> list[int]:
        """The path of a word composed lazily, long arcs first.

        Pieces that may follow each other are what merging makes of their characters, and merging makes one thing of each prefix:
        a position is reached in one way, the lattice has one path, and the first one found to the end is the shortest.
        """
        size, last, at, rows = len(word), -1, 0, self._pairs
        found: list[tuple[int, int, int]] = []
        open_ = [self._arcs(word, 0)]
        while at < size:
            arcs = open_[-1]
            while arcs:
                e, piece = arcs.pop()
                if last >= 0 and piece >= 0:
                    ok = rows[last].get(piece)
                    if not (self.joins(last, piece) if ok is None else ok):
                        continue
                found.append((at, last, piece))
                at, last = e, piece
                if e < size:
                    open_.append(self._arcs(word, e))
                break
            else:
                open_.pop()
                at, last, _ = found.pop()
        out = [piece for _, _, piece in found]
        if -1 in out:
            out = [i for before, _, piece in found for i in self._ids(word, piece, before, before + 1)]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; each distinct word of the texts is composed once."""
        split = [self.words(t or "") for t in texts]
        if len(self._young) >= REMEMBERED:
            self._old, self._young = self._young, {}
        new, known, old = set().union(*split).difference(self._young), self._young, self._old
        for w in new:
            got = old.get(w)
            known[w] = got if got is not None else array("I", self.short_path(w) if len(w) <= LONGEST else self.path(w)).tobytes()
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")[1:]


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The tables of a model, compiled once in each Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), ids, decoded_equal (the round trip holds)."""
    path = path or model_path()

    def make():
        fst = compiled(path)

        def run(texts):
            raw = [r for s, e in blocks([t or "" for t in texts], BLOCK_CHARS) for r in fst.encode(texts[s:e])]
            flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
            n = [len(r) // 4 for r in raw]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            equal = [fst.decode(flat[s:e].tolist()) == (t or "") for t, s, e in zip(texts, ends.tolist(), ends[1:].tolist())]
            return {"n_ids": n, "ids_crc32": [zlib.crc32(r) for r in raw], "ids": pa.ListArray.from_arrays(ends, flat), "decoded_equal": equal}
        return run

    return beside(docs, make, "n_ids long, ids_crc32 long, ids array<int>, decoded_equal boolean")


def op3_sentencepiece_fst(spark, sf_dir) -> DataFrame:
    return encode(documents(spark, sf_dir))
