"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
every match must hold: runs of fixed letters give their trigrams (AND),
alternatives give an OR, anything open gives no condition. Each Arrow batch of
documents is one index segment: its lower-cased bytes are coded as trigrams,
those of the rules' vocabulary are kept as postings (trigram -> row numbers),
and the Boolean query intersects and unites postings. Only candidates are
verified by the expression itself, on the whole text. A rule without mandatory
trigrams (``hex``) scans every text. Segments need no shuffle and no memory beyond their batch.

Defined results: null text is empty (no spans); a text without base matches has the digest of
the empty text; repeated rows get the same answer; other columns are never read.
"""
from __future__ import annotations

import hashlib
import re
from re import _constants as K
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame

from .common import beside, blocks, documents

_I = re.ASCII | re.IGNORECASE
#: Kind -> (expression, flags, group whose length is checked, least length). The first three are the base kinds.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", re.ASCII, 0, 20),
    "hex": (r"[0-9a-f]{24,}", re.ASCII, 0, 24),
    "private_key": (r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\x20\x09-\x0D:,.]|-(?!----))*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", re.ASCII, 0, 0),
    "hub_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", re.ASCII, 0, 0),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII, 0, 0),
    "web_token": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII, 0, 0),
    "url_login": (r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]{3,}@", re.ASCII, 0, 0),
}
BASE = ["assign", "access", "hex"]
#: Characters of a segment; an Arrow batch is split at this size.
SEGMENT = 4 << 20
ALL = ("all",)


def _and(parts):
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def trigram_query(pattern: str, flags: int = 0):
    """("tri", t) | ("and", ...) | ("or", ...) | ALL: a condition on lower-cased trigrams that each match meets."""
    def grams(run: str):
        run = run.lower()
        return _and([("tri", run[i:i + 3]) for i in range(len(run) - 2)])

    def walk(seq):
        parts, run = [], ""
        for op, arg in seq:
            if op is K.LITERAL and arg < 128:
                run += chr(arg)
                continue
            if op is K.MAX_REPEAT and arg[0] == arg[1] and len(arg[2]) == 1 and arg[2][0][0] is K.LITERAL and arg[2][0][1] < 128:
                run += chr(arg[2][0][1]) * arg[0]
                continue
            parts.append(grams(run))
            run = ""
            if op is K.SUBPATTERN:
                parts.append(walk(arg[3]))
            elif op is K.BRANCH:
                options = [walk(x) for x in arg[1]]
                parts.append(ALL if ALL in options else ("or", *options))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                parts.append(walk(arg[2]))
        return _and([*parts, grams(run)])

    return walk(parser.parse(pattern, flags))


def vocabulary(query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*[vocabulary(x) for x in query[1:]]) if query != ALL else set()


def _code(t: str) -> int:
    a, b, c = t.encode()
    return a << 16 | b << 8 | c


class Segment:
    """Postings of the rules' trigrams over some texts."""

    def __init__(self, texts: list[str], wanted: np.ndarray):
        # Lower-casing acts on A-Z bytes only, so trigrams keep their place; a zero byte parts the texts.
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        blob = np.frombuffer(b"\0".join(raw).lower() + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        code = blob[:-2].astype(np.int32) << 16 if len(blob) > 2 else np.zeros(0, np.int32)
        if len(code):
            code |= blob[1:-1].astype(np.int32) << 8
            code |= blob[2:]
        at = np.flatnonzero(wanted[code])
        rows, codes = np.searchsorted(ends, at, side="right"), code[at]
        self.rows = np.arange(len(texts))
        self.postings = {int(c): np.unique(rows[codes == c]) for c in np.unique(codes)}

    def find(self, query) -> np.ndarray:
        if query == ALL:
            return self.rows
        if query[0] == "tri":
            return self.postings.get(_code(query[1]), self.rows[:0])
        got = self.find(query[1])
        for q in query[2:]:
            got = (np.intersect1d if query[0] == "and" else np.union1d)(got, self.find(q))
        return got


def spans_of(text: str, expr: re.Pattern, group: int, least: int) -> list[tuple[int, int]]:
    return [m.span() for m in expr.finditer(text) if m.end(group) - m.start(group) >= least]


def scan(docs: DataFrame, rules: dict = RULES, base: list[str] = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans (kind:start:end by start, then rule order)."""
    def make():
        compiled = [(k, re.compile(p, f), g, n, trigram_query(p, f)) for k, (p, f, g, n) in rules.items()]
        wanted = np.zeros(1 << 24, dtype=bool)
        for *_, q in compiled:
            wanted[[_code(t) for t in vocabulary(q)]] = True

        def run(texts):
            texts = [t or "" for t in texts]
            found: list[list] = [[] for _ in texts]
            for at, end in blocks(texts, SEGMENT):
                segment = Segment(texts[at:end], wanted)
                for order, (_, expr, group, least, query) in enumerate(compiled):
                    for r in segment.find(query):
                        found[at + r] += [(s, order, e) for s, e in spans_of(texts[at + r], expr, group, least)]
            names = list(rules)
            listed = [[(names[o], f"{names[o]}:{s}:{e}") for s, o, e in sorted(spans)] for spans in found]
            return {**{f"n_{n}": [sum(k == n for k, _ in x) for x in listed] for n in base},
                    "base_sha256": [hashlib.sha256(",".join(y for k, y in x if k in base).encode()).hexdigest() for x in listed],
                    "spans": [",".join(y for _, y in x) for x in listed]}
        return run

    return beside(docs, make, f"{', '.join(f'n_{k} long' for k in base)}, base_sha256 string, spans string")


def op1_secret_scan(spark, sf_dir) -> DataFrame:
    return scan(documents(spark, sf_dir))
