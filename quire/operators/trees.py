"""Tree ensembles on shared histograms: balanced forest, leaf-wise and level-wise boosting, boosted stumps on balanced bags.

Training rows become one byte a feature: values are cut at quantiles of the training frame (byte 0 holds missing
values), so a node's statistics are histograms over (feature, byte). They are summed in numpy within each task, merged
by (tree, node) after a shuffle of these sums alone, and only the best split of each node reaches
the driver. A round handles the open nodes of all trees of a group at once. A node with at most
``LOCAL_ROWS`` rows (fewer on wide tables) is finished by the task that gets its rows, with the same split rule.

Bags are drawn by the row's key, never by its values: ``draw`` maps two hashes of the key through a random line
modulo a prime for each bag, so equal rows are drawn independently, a bag is the same in
every pass and after a lost executor, and SQL can recompute it. A balanced bag counts a row of class c
Poisson(n_min / n_c) times: the expected rows of each class equal the smaller class.

Boosted trees have few leaves; they live on the driver and are broadcast. The trees of a forest grow with the table: the driver
holds their nodes of more than ``LOCAL_ROWS`` rows only, the subtrees below stay in a table, and rows are scored where
their subtree is.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import quote
from quire.session import ensure_checkpoint_dir

#: Bytes of a feature; rows and cells of a node that one task finishes; histogram cells of a round; trees between two refreshes of the margins.
BINS, LOCAL_ROWS, LOCAL_CELLS, ROUND_CELLS, REFRESH = 256, 1 << 18, 1 << 22, 1 << 24, 20
#: A task that boosts alone takes more rounds before a refresh, as many times more as its rows go into this.
HERE_ROWS = 1 << 20
#: Rows of a message, rows of a node whose splits are found by sorting.
BLOCK_ROWS, SORT_ROWS = 1 << 16, 1 << 9
PRIME = (1 << 31) - 1
_HIST = "tree int, node int, hist binary"


# ---------------------------------------------------------------- rows and bags

def quantile_cuts(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Increasing cut values of each feature (at most BINS - 2), from one pass of quantile sketches."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    row = df.agg(*[F.percentile_approx(F.nanvl(quote(c).cast("double"), F.lit(None)), shares, 10_000).alias(f"c{i}")
                   for i, c in enumerate(features)]).first()
    return [np.unique(np.array([v for v in (row[f"c{i}"] or []) if v is not None], dtype=np.float64)) for i in range(len(features))]


def key_hashes(key: Column) -> list[Column]:
    """Two 28-bit numbers of a key's text (a null key counts as the empty text)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return [F.conv(F.substring(digest, s, 7), 16, 10).cast("long") for s in (1, 8)]


def binned(train: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray], key: str | None) -> DataFrame:
    """(h1, h2, y, bins, margin) of the training rows, written once; ``bins`` has one byte a feature."""
    ensure_checkpoint_dir(train.sparkSession)
    h1, h2 = key_hashes(quote(key) if key else F.monotonically_increasing_id())
    x = F.array(*[quote(c).cast("double") for c in features])

    def run(batches):
        for b in batches:
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            codes = np.zeros(flat.shape, dtype=np.uint8)
            for j, c in enumerate(cuts):
                codes[:, j] = np.where(np.isnan(flat[:, j]), 0, np.searchsorted(c, flat[:, j], side="left") + 1)
            raw = codes.tobytes()
            rows = pa.array([raw[i:i + len(cuts)] for i in range(0, len(raw), len(cuts))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rows, pa.array(np.zeros(b.num_rows))],
                                             ["h1", "h2", "y", "bins", "margin"])

    return train.select(h1.alias("h1"), h2.alias("h2"), (quote(label) == 1).cast("int").alias("y"), x.alias("x")).where("y is not null").mapInArrow(
        run, "h1 long, h2 long, y int, bins binary, margin double").checkpoint()


def lines(bags: int, seed: int) -> list[tuple[int, int, int]]:
    """The random line (a, b, c) of each bag."""
    rng = np.random.default_rng([seed, 7])
    return [tuple(int(v) for v in row) for row in rng.integers(1, PRIME, size=(bags, 3))]


def draw(h1, h2, line: tuple[int, int, int]):
    """A number below PRIME for each row of a bag (numpy or Column arithmetic)."""
    a, b, c = line
    return (h1 * a + h2 * b + c) % PRIME


def poisson_steps(rate: float) -> list[int]:
    """Draws at or above the k-th step count more than k times."""
    out, term, total, k = [], math.exp(-rate), 0.0, 0
    while total + term < 1 - 1e-12 and k < 40:
        total += term
        out.append(int(total * PRIME))
        k += 1
        term *= rate / k
    return out


def class_rates(n0: int, n1: int) -> tuple[float, float]:
    least = min(n0, n1)
    return least / max(n0, 1), least / max(n1, 1)


def bag_counts(h1: np.ndarray, h2: np.ndarray, y: np.ndarray, line, steps) -> np.ndarray:
    """How often a balanced bag holds each row."""
    u = draw(h1, h2, line)
    return np.where(y == 1, np.searchsorted(steps[1], u, side="right"), np.searchsorted(steps[0], u, side="right"))


def bag_count_column(h1: Column, h2: Column, y: Column, line, steps) -> Column:
    u = draw(h1, h2, line)
    count = lambda s: sum([F.when(u >= F.lit(t), 1).otherwise(0) for t in s], F.lit(0))
    return F.when(y == 1, count(steps[1])).otherwise(count(steps[0]))


# ---------------------------------------------------------------- split rules

@dataclass(frozen=True)
class Rule:
    """How a node's sums (two statistics and a row count) value a split and a leaf."""
    newton: bool = False
    l1: float = 0.0
    l2: float = 0.0
    min_rows: float = 1.0
    min_hessian: float = 0.0

    def worth(self, s: np.ndarray) -> np.ndarray:
        a, b, n = s[..., 0], s[..., 1], s[..., 2]
        if self.newton:
            return np.square(np.maximum(np.abs(a) - self.l1, 0.0)) / np.maximum(b + self.l2, 1e-12)
        return (a * a + b * b) / np.maximum(a + b, 1e-12)

    def leaf(self, s: np.ndarray) -> float:
        a, b, n = s
        if self.newton:
            return float(-np.sign(a) * max(abs(a) - self.l1, 0.0) / max(b + self.l2, 1e-12))
        return float(b / (a + b)) if a + b else 0.0


def random_cuts(hist: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """One cut for each feature between its smallest and largest byte in the node, as a mask over all cuts."""
    held = hist[..., 2] > 0
    low, high = held.argmax(axis=1), BINS - 1 - held[:, ::-1].argmax(axis=1)
    share = np.random.default_rng(list(seed)).random(len(hist))
    out = np.zeros((len(hist), BINS - 1), dtype=bool)
    some = high > low
    out[np.flatnonzero(some), (low + share * (high - low)).astype(int)[some]] = True
    return out


def best_split(hist: np.ndarray, rule: Rule, seed: Sequence[int] | None = None):
    """(gain, feature number, last byte on the left, left sums, right sums) of a (features, BINS, 3) histogram, or None.

    With ``seed`` each feature has a single cut, drawn at random.
    """
    left = hist.cumsum(axis=1)
    total = left[0, -1]
    left = left[:, :-1]
    right = total - left
    ok = (left[..., 2] >= rule.min_rows) & (right[..., 2] >= rule.min_rows)
    if rule.newton:
        ok &= (left[..., 1] >= rule.min_hessian) & (right[..., 1] >= rule.min_hessian)
    if seed is not None:
        ok &= random_cuts(hist, seed)
    gain = np.where(ok, rule.worth(left) + rule.worth(right) - rule.worth(total), -np.inf)
    # Equal but for the last digits counts as equal: sums may come in any order.
    best = gain.max()
    if not best > 1e-9:
        return None
    j, t = np.unravel_index(int(np.argmax(gain >= best * (1 - 1e-9))), gain.shape)
    return float(best), int(j), int(t), left[j, t], right[j, t]


def split_rows(bins: np.ndarray, stats: np.ndarray, rule: Rule, seed: Sequence[int] | None = None):
    """What ``best_split`` finds for the rows of a node, without a histogram of all bytes: few rows are sorted, a random cut only compares."""
    if seed is None and len(bins) > SORT_ROWS:
        return best_split(histogram(bins, stats, np.arange(bins.shape[1])), rule)
    total, places = stats.sum(axis=0), np.arange(bins.shape[1])
    if seed is None:
        order = bins.argsort(axis=0, kind="stable")
        held = bins[order, places]
        left = stats[order].cumsum(axis=0)[:-1].transpose(1, 0, 2)
        ok = (held[1:] != held[:-1]).T
        cuts = held[:-1].T
    else:
        low, high = bins.min(axis=0).astype(np.int64), bins.max(axis=0).astype(np.int64)
        cuts = (low + np.random.default_rng(list(seed)).random(len(places)) * (high - low)).astype(np.int64)
        left = ((bins <= cuts).T.astype(np.float64) @ stats)[:, None]
        ok, cuts = (high > low)[:, None], cuts[:, None]
    right = total - left
    ok = ok & (left[..., 2] >= rule.min_rows) & (right[..., 2] >= rule.min_rows)
    if rule.newton:
        ok &= (left[..., 1] >= rule.min_hessian) & (right[..., 1] >= rule.min_hessian)
    gain = np.where(ok, rule.worth(left) + rule.worth(right) - rule.worth(total), -np.inf)
    best = gain.max(initial=-np.inf)
    if not best > 1e-9:
        return None
    j, t = divmod(int((gain >= best * (1 - 1e-9)).argmax()), gain.shape[1])
    return float(best), j, int(cuts[j, t]), left[j, t], right[j, t]


def histogram(bins: np.ndarray, stats: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(columns, BINS, 3) sums of the rows' statistics."""
    place = (bins[:, columns].astype(np.int64) + np.arange(len(columns)) * BINS).ravel()
    out = [np.bincount(place, np.repeat(stats[:, k], len(columns)), len(columns) * BINS) for k in range(3)]
    return np.stack(out, axis=-1).reshape(len(columns), BINS, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_columns(seed: int, tree: int, node, columns: np.ndarray, k: int) -> np.ndarray:
    """The features that a node may split on: those of the k smallest hashes of (seed, tree, node, feature). Many nodes give a row each."""
    if k >= len(columns):
        return columns
    step, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(1, dtype=np.uint64)
    for x in (np.array([seed]), np.array([tree]), np.atleast_1d(node)):
        h = _mixed((h ^ x.astype(np.uint64)) + step)
    order = _mixed((h[:, None] ^ np.asarray(columns, dtype=np.uint64)) + step).argsort(axis=1)
    picked = np.sort(columns[order[:, :k]], axis=1)
    return picked if np.ndim(node) else picked[0]


# ---------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes in order of their making; an inner node sends bytes up to ``cut`` to ``left``."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list = field(default_factory=list)

    def add(self, sums, depth: int) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.depth, depth), (self.sums, np.asarray(sums))):
            x.append(v)
        return len(self.feature) - 1

    def split(self, node: int, gain: float, feature: int, cut: int, left, right) -> tuple[int, int]:
        a, b = self.add(left, self.depth[node] + 1), self.add(right, self.depth[node] + 1)
        self.gain[node], self.feature[node], self.cut[node], self.left[node], self.right[node] = gain, feature, cut, a, b
        return a, b

    def graft(self, node: int, sub: "Tree") -> None:
        """Puts a subtree in the place of a leaf."""
        at = {0: node}
        for i in range(len(sub.feature)):
            if sub.feature[i] >= 0:
                at[sub.left[i]], at[sub.right[i]] = self.split(
                    at[i], sub.gain[i], sub.feature[i], sub.cut[i], sub.sums[sub.left[i]], sub.sums[sub.right[i]])

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            rows = rows[feature[node[rows]] >= 0]
            if not len(rows):
                return node
            here = node[rows]
            node[rows] = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])

    def best_first(self, leaves: int) -> "Tree":
        """The tree that always splitting the leaf of largest gain gives, up to a number of leaves."""
        out = Tree()
        out.add(self.sums[0], 0)
        heap, n = [(-self.gain[0], 0, 0)], 1
        while heap and n < leaves:
            _, old, new = heapq.heappop(heap)
            if self.feature[old] < 0:
                continue
            children = out.split(new, self.gain[old], self.feature[old], self.cut[old], self.sums[self.left[old]], self.sums[self.right[old]])
            for o, c in zip((self.left[old], self.right[old]), children):
                heapq.heappush(heap, (-self.gain[o], o, c))
            n += 1
        return out

    def values(self, rule: Rule, rate: float = 1.0) -> np.ndarray:
        return np.array([rate * rule.leaf(s) for s in self.sums])

    def packed(self) -> bytes:
        """The nodes as columns of numbers."""
        columns = {"feature": np.int32, "cut": np.uint8, "left": np.int32, "right": np.int32, "gain": np.float64, "depth": np.int32, "sums": np.float64}
        return b"".join([np.int64(len(self.feature)).tobytes(), *[np.asarray(getattr(self, c), dtype=k).tobytes() for c, k in columns.items()]])

    @staticmethod
    def unpacked(raw: bytes) -> "Tree":
        n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
        for kind, k in ((np.int32, 1), (np.uint8, 1), (np.int32, 1), (np.int32, 1), (np.float64, 1), (np.int32, 1), (np.float64, 3)):
            out.append(np.frombuffer(raw, kind, n * k, at))
            at += n * k * np.dtype(kind).itemsize
        return Tree(*[x.tolist() for x in out[:-1]], list(out[-1].reshape(n, 3)))


def grow_here(bins: np.ndarray, stats: np.ndarray, rule: Rule, columns: Callable[[int], np.ndarray], depth: float, leaves: float,
              seed: Callable[[int], Sequence[int] | None] = lambda node: None) -> Tree:
    """A tree over rows held in one task; ``seed(node)`` draws random cuts, if any. With a limit of leaves the leaf of largest gain goes first."""
    if leaves == math.inf:
        return _grow_levels(bins, stats, rule, columns, depth, seed)
    tree, held, heap = Tree(), {}, []
    # Nodes that all split on the same columns: the larger child's histogram is what its sibling leaves of their parent's.
    shared = columns(0) if columns(0) is columns(1) and seed(0) is None else None
    narrow = bins if shared is None else np.ascontiguousarray(bins[:, shared])

    def open_(node: int, rows: np.ndarray, hist: np.ndarray | None) -> None:
        # A node of one class, or too few rows for two leaves, has no split.
        pure = not rule.newton and min(tree.sums[node][:2]) <= 0
        if tree.depth[node] < depth and len(rows) > 1 and not pure and tree.sums[node][2] >= 2 * rule.min_rows:
            own = columns(node)
            found = split_rows(bins[rows[:, None], own], stats[rows], rule, seed(node)) if hist is None else best_split(hist, rule)
            if found:
                held[node] = rows, hist
                heapq.heappush(heap, (-found[0], node, (found[0], int(own[found[1]]), *found[2:])))

    def sums(rows: np.ndarray) -> np.ndarray:
        return histogram(narrow[rows], stats[rows], np.arange(len(shared)))

    every = np.arange(len(bins))
    open_(tree.add(stats.sum(axis=0), 0), every, None if shared is None else sums(every))
    n = 1
    while heap and n < leaves:
        _, node, found = heapq.heappop(heap)
        rows, hist = held.pop(node)
        a, b = tree.split(node, *found)
        left = bins[rows, found[1]] <= found[2]
        parts, hists = (rows[left], rows[~left]), [None, None]
        if hist is not None and n + 1 < leaves:
            few = int(len(parts[1]) < len(parts[0]))
            hists[few] = sums(parts[few])
            hists[1 - few] = hist - hists[few]
            hists[1 - few][hists[1 - few][..., 2] == 0] = 0.0
        n += 1
        if n < leaves:
            for child, part, h in zip((a, b), parts, hists):
                open_(child, part, h)
    return tree


def _grow_levels(bins: np.ndarray, stats: np.ndarray, rule: Rule, columns: Callable, depth: float, seed: Callable) -> Tree:
    """A tree without a limit of leaves, all nodes of a level at once (``columns`` takes them all): sums by (feature, node, byte) from counting or, for many nodes, sorting."""
    tree = Tree()
    tree.add(stats.sum(axis=0), 0)
    rows, nodes, sizes, level = np.arange(len(bins)), np.zeros(1, dtype=np.int64), np.array([len(bins)]), 0
    while len(nodes) and level < depth:
        total = np.array([tree.sums[n] for n in nodes])
        # A node of one class, or too few rows for two leaves, has no split.
        live = (sizes > 1) & (total[:, 2] >= 2 * rule.min_rows)
        if not rule.newton:
            live &= total[:, :2].min(axis=1) > 0
        rows, nodes, sizes, total = rows[np.repeat(live, sizes)], nodes[live], sizes[live], total[live]
        k = len(nodes)
        if not k:
            break
        own = columns(nodes)
        own = np.broadcast_to(own, (k, own.shape[-1]))
        wide, at = own.shape[1], np.repeat(np.arange(k), sizes)
        held = stats[rows]
        key = (((np.arange(wide)[:, None] * k + at) << 8) + bins[rows, own[at].T]).ravel()
        if k * BINS <= 2 * len(rows):
            cells = np.stack([np.bincount(key, np.tile(held[:, s], wide), wide * k * BINS) for s in range(3)], axis=-1).reshape(-1, BINS, 3)
            found = np.flatnonzero(cells[..., 2])
            left = cells.cumsum(axis=1).reshape(-1, 3)[found]
        else:
            order = key.argsort(kind="stable")
            found = key[order]
            run = held[order % len(rows)].cumsum(axis=0)
            last = np.flatnonzero(np.append(found[1:] != found[:-1], True))
            # A group has a node's rows once: its sums start after those of the groups before it.
            start = np.arange(wide)[:, None] * len(rows) + (np.cumsum(sizes) - sizes)
            found = found[last]
            left = run[last] - np.vstack([np.zeros(3), run])[start.ravel()][found >> 8]
        group, cut = found >> 8, found & (BINS - 1)
        if (drawn := seed(int(nodes[0]))) is not None:
            first = np.append(True, group[1:] != group[:-1])
            low, high = cut[first], cut[np.append(first[1:], True)]
            share = np.stack([np.random.default_rng(list(seed(int(n)))).random(wide) for n in nodes], axis=1).ravel()
            place = (low + share * (high - low)).astype(np.int64)
            # The last byte held up to the drawn cut has the sums of its left side.
            pick = np.searchsorted(found, (np.arange(wide * k) << 8) + place, side="right") - 1
            pick, place = pick[high > low], place[high > low]
            group, cut, left = group[pick], place, left[pick]
        node = group % k
        right = total[node] - left
        ok = (left[:, 2] >= rule.min_rows) & (right[:, 2] >= rule.min_rows)
        if rule.newton:
            ok &= (left[:, 1] >= rule.min_hessian) & (right[:, 1] >= rule.min_hessian)
        group, node, cut, left, right = group[ok], node[ok], cut[ok], left[ok], right[ok]
        gain = rule.worth(left) + rule.worth(right) - rule.worth(total)[node]
        best = np.full(k, 1e-9)
        np.maximum.at(best, node, gain)
        good = np.flatnonzero((gain > 1e-9) & (gain >= best[node] * (1 - 1e-9)))
        splits, first = np.unique(node[good], return_index=True)
        pick = good[first]
        feature = own[splits, group[pick] // k]
        # Rows of split nodes go to the left or right child, children in order of their parents.
        place = np.full(k, -1)
        place[splits] = np.arange(len(splits))
        stay = place[at] >= 0
        rows, at = rows[stay], place[at[stay]]
        side = bins[rows, feature[at]] > cut[pick][at]
        child = 2 * at + side
        rows = rows[child.argsort(kind="stable")]
        sizes = np.bincount(child, minlength=2 * len(splits))
        sums = np.add.reduceat(stats[rows], np.cumsum(sizes) - sizes, axis=0) if len(rows) else np.zeros((0, 3))
        below = len(tree.feature) + np.arange(2 * len(splits))
        for n, g, f, c, a in zip(nodes[splits].tolist(), best[splits].tolist(), feature.tolist(), cut[pick].tolist(), below[::2].tolist()):
            tree.gain[n], tree.feature[n], tree.cut[n], tree.left[n], tree.right[n] = g, f, c, a, a + 1
        level += 1
        for x, v in ((tree.feature, -1), (tree.cut, 0), (tree.left, -1), (tree.right, -1), (tree.gain, 0.0), (tree.depth, level)):
            x.extend([v] * len(below))
        tree.sums.extend(sums)
        nodes = below
    return tree


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    raw = b"".join(b.column("bins").to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(b.num_rows, width)


@dataclass
class Growth:
    """What a round of growing needs on the workers; ``stats(tree, columns of the batch)`` gives (rows, 3) statistics, zero for rows outside the bag."""
    stats: Callable
    rule: Rule
    columns: dict[int, np.ndarray]
    per_node: int
    width: int
    seed: int
    depth: float = math.inf
    leaves: float = math.inf
    random: bool = False

    def cut_seed(self, tree: int, node: int) -> list[int] | None:
        return [self.seed, tree, node, 3] if self.random else None

    def node_columns(self, tree: int, node) -> np.ndarray:
        return node_columns(self.seed, tree, node, self.columns[tree], self.per_node)


def _sums(rows: DataFrame, g: Growth, trees: list[int]) -> dict[int, np.ndarray]:
    """The statistics of each tree's root."""
    def run(batches):
        total = np.zeros((len(trees), 3))
        for b in batches:
            for k, t in enumerate(trees):
                total[k] += g.stats(t, b).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"tree": pa.array(trees, pa.int32()), **{f"s{k}": total[:, k] for k in range(3)}})

    got = rows.mapInArrow(run, "tree int, s0 double, s1 double, s2 double").groupBy("tree").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)])
    return {r["tree"]: np.array([r["s0"], r["s1"], r["s2"]]) for r in got.collect()}


def _splits(rows: DataFrame, g: Growth, grown: dict[int, Tree], open_: dict[int, list[int]]) -> list:
    """The best split of each open node, from histograms summed over all tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((grown, open_))

    def count(batches):
        grown, open_ = shared.value
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            bins = _matrix(b, g.width)
            for t, nodes in open_.items():
                stats = g.stats(t, b)
                used = np.flatnonzero(stats[:, 2] > 0)
                at = grown[t].route(bins[used])
                for node in nodes:
                    own = used[at == node]
                    if len(own):
                        h = histogram(bins[own], stats[own], g.node_columns(t, node))
                        total[t, node] = total[t, node] + h if (t, node) in total else h
        keys = list(total)
        for s in range(0, len(keys), 64):
            part = keys[s:s + 64]
            yield pa.RecordBatch.from_pydict({"tree": pa.array([k[0] for k in part], pa.int32()), "node": pa.array([k[1] for k in part], pa.int32()),
                                              "hist": [total[k].tobytes() for k in part]})

    def choose(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for t, node, raw in zip(*[b.column(c).to_pylist() for c in ("tree", "node", "hist")]):
                h = np.frombuffer(raw).reshape(-1, BINS, 3)
                total[t, node] = total[t, node] + h if (t, node) in total else h
        out = [(t, node, best_split(h, g.rule, g.cut_seed(t, node))) for (t, node), h in total.items()]
        out = [(t, node, s[0], int(g.node_columns(t, node)[s[1]]), s[2], s[3].tolist(), s[4].tolist()) for t, node, s in out if s]
        if out:
            names = ["tree", "node", "gain", "feature", "cut", "lsums", "rsums"]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out), kinds)], names)

    merged = rows.mapInArrow(count, _HIST).repartition("tree", "node")
    return merged.mapInArrow(choose, "tree int, node int, gain double, feature int, cut int, lsums array<double>, rsums array<double>").collect()


def local_rows(width: int) -> int:
    """Rows of a node that one task finishes."""
    return min(LOCAL_ROWS, LOCAL_CELLS // max(width, 1))


_BLOCK = "tree int, node int, bins binary, stats binary"


def _flushed(blocks: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*blocks), kinds.values())], list(kinds))


def _blocks(found: Iterator[tuple[tuple, int]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Messages in batches of about ``BLOCK_ROWS`` rows."""
    held, rows = [], 0
    for block, n in found:
        held.append(block)
        rows += n
        if rows >= BLOCK_ROWS:
            yield _flushed(held, kinds)
            held, rows = [], 0
    if held:
        yield _flushed(held, kinds)


def _subtrees(rows: DataFrame, g: Growth, grown: dict[int, Tree], small: dict[int, list[int]]) -> DataFrame:
    """(tree, node, grown): the subtrees of nodes with few rows, each grown by the task that its rows are sent to."""
    shared = rows.sparkSession.sparkContext.broadcast((grown, small))
    grown_depth = {(t, n): grown[t].depth[n] for t, nodes in small.items() for n in nodes}

    def messages(batches):
        grown, small = shared.value
        for b in batches:
            bins = _matrix(b, g.width)
            for t, nodes in small.items():
                stats = g.stats(t, b)
                used = np.flatnonzero(stats[:, 2] > 0)
                at = grown[t].route(bins[used])
                for node in nodes if len(used) else ():
                    own = used[at == node]
                    if len(own):
                        yield (t, node, bins[own].tobytes(), stats[own].tobytes()), len(own)

    def send(batches):
        yield from _blocks(messages(batches), {"tree": pa.int32(), "node": pa.int32(), "bins": pa.binary(), "stats": pa.binary()})

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        t, node = key[0].as_py(), key[1].as_py()
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, g.width)
        stats = np.frombuffer(b"".join(group.column("stats").to_pylist())).reshape(-1, 3)
        # Rows come in any order; sorted ones give the same sums in every run.
        order = np.lexsort((*stats.T[::-1], *bins.T[::-1]))
        sub = grow_here(bins[order], stats[order], g.rule, lambda n: g.node_columns(t, (node << 20) + n), g.depth - grown_depth[t, node], g.leaves,
                        lambda n: g.cut_seed(t, (node << 20) + n))
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "grown": pa.array([sub.packed()], pa.binary())})

    # A subtree is a task's work of seconds: as many tasks as there are subtrees, within bounds.
    n = min(len(grown_depth), 8 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(send, _BLOCK).repartition(max(1, n), "tree", "node").groupBy("tree", "node").applyInArrow(grow, "tree int, node int, grown binary")


def _tops(rows: DataFrame, g: Growth, trees: list[int]) -> tuple[dict[int, Tree], dict[int, list[int]]]:
    """The nodes with many rows of some trees, grown together round by round, and the nodes left to ``_subtrees``."""
    grown, open_ = {}, {}
    for t, s in sorted(_sums(rows, g, trees).items()):
        grown[t] = Tree()
        open_[t] = [grown[t].add(s, 0)]
    small: dict[int, list[int]] = {}
    while open_:
        large: dict[int, list[int]] = {}
        for t, nodes in open_.items():
            for node in nodes:
                n = grown[t].sums[node][2]
                if grown[t].depth[node] < g.depth and n >= 2 * g.rule.min_rows and n > 1:
                    (large if n > local_rows(g.width) else small).setdefault(t, []).append(node)
        open_ = {}
        if large:
            for r in sorted(_splits(rows, g, grown, large), key=lambda r: (r["tree"], r["node"])):
                open_.setdefault(r["tree"], []).extend(grown[r["tree"]].split(r["node"], r["gain"], r["feature"], r["cut"], r["lsums"], r["rsums"]))
    return grown, small


def grow(rows: DataFrame, g: Growth, trees: list[int]) -> dict[int, Tree]:
    """Grows some trees of few leaves together."""
    grown, small = _tops(rows, g, trees)
    if small:
        for r in sorted(_subtrees(rows, g, grown, small).collect(), key=lambda r: (r["tree"], r["node"])):
            grown[r["tree"]].graft(r["node"], Tree.unpacked(r["grown"]))
    return grown if g.leaves == math.inf else {t: x.best_first(int(g.leaves)) for t, x in grown.items()}


# ---------------------------------------------------------------- fitted models

@dataclass
class Ensemble:
    """Fitted trees; ``combine`` is mean (of leaf shares), logistic (of summed leaf values) or bags (of boosted stumps)."""
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    values: list[np.ndarray]
    combine: str
    weights: list[list[float]] = field(default_factory=list)
    bags: list[list[int]] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, dtype=np.uint8)
        for j, c in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], side="left") + 1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.codes(x)
        each = [v[t.route(bins)] for t, v in zip(self.trees, self.values)]
        if self.combine == "mean":
            return np.mean(each, axis=0)
        if self.combine == "logistic":
            return 1 / (1 + np.exp(-np.sum(each, axis=0)))
        out = np.zeros(len(x))
        for own, alpha in zip(self.bags, self.weights):
            vote = sum((a * (2 * each[i] - 1) for i, a in zip(own, alpha)), np.zeros(len(x))) / max(sum(alpha), 1e-12)
            out += 1 / (1 + np.exp(-vote))
        return out / len(self.bags)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, prediction (0/1 at a score of 0.5) and score."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                m = np.array([[np.nan if v is None else v for v in row] for row in x], dtype=np.float64).reshape(len(x), -1)
                yield pd.Series(model.value.scores(m) if len(x) else np.zeros(0))

        out = df.select(*[quote(k) for k in keep], score(F.array(*[quote(c).cast("double") for c in self.features])).alias("score"))
        return out.select(*[quote(k) for k in keep], (F.col("score") >= 0.5).cast("int").alias("prediction"), "score")


def _class_counts(rows: DataFrame) -> tuple[int, int]:
    got = rows.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    return got["n0"], got["n1"]


def _columns_of(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy() for c in names]


def _share(setting, width: int) -> int:
    """The number of features that "sqrt", "log2", a share or None stands for."""
    if setting in (None, "all"):
        return width
    k = {"sqrt": math.sqrt(width), "log2": math.log2(max(width, 1))}[setting] if isinstance(setting, str) else float(setting) * width
    return max(1, min(width, int(k)))


@dataclass
class Forest:
    """Fitted trees whose score is the mean of their leaf shares: the nodes of many rows, and a table of the subtrees below (tree, node, grown)."""
    features: list[str]
    cuts: list[np.ndarray]
    tops: dict[int, Tree]
    below: DataFrame | None
    rule: Rule

    @property
    def trees(self) -> list[Tree]:
        """Whole trees, collected (for inspection of small models)."""
        out = {t: Tree.unpacked(x.packed()) for t, x in self.tops.items()}
        for r in self.below.orderBy("tree", "node").collect() if self.below is not None else []:
            out[r["tree"]].graft(r["node"], Tree.unpacked(r["grown"]))
        return [out[t] for t in sorted(out)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return Ensemble(self.features, self.cuts, [], [], "mean").codes(x)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, prediction (0/1 at a score of 0.5) and score. Rows go to the subtrees, their leaves' shares back to the rows."""
        spark, width = df.sparkSession, len(self.features)
        ensure_checkpoint_dir(spark)
        rows = df.select(*[quote(k) for k in keep], F.array(*[quote(c).cast("double") for c in self.features]).alias("_x"),
                         F.monotonically_increasing_id().alias("_id")).checkpoint()
        model = spark.sparkContext.broadcast((self.cuts, self.tops, {t: x.values(self.rule) for t, x in self.tops.items()}))
        coder, rule = Ensemble(self.features, self.cuts, [], [], "mean"), self.rule

        def messages(batches):
            _, tops, values = model.value
            for b in batches:
                ids, bins = b.column("_id").to_numpy(), coder.codes(b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width))
                for t, top in tops.items() if len(ids) else ():
                    at = top.route(bins)
                    for node in np.unique(at):
                        own = at == node
                        yield (t, int(node), float(values[t][node]), ids[own].tobytes(), bins[own].tobytes()), int(own.sum())

        def send(batches):
            yield from _blocks(messages(batches), {"tree": pa.int32(), "node": pa.int32(), "share": pa.float64(), "ids": pa.binary(), "bins": pa.binary()})

        def score(group: pa.Table, below: pa.Table) -> pa.Table:
            ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), dtype=np.int64)
            if below.num_rows and len(ids):
                sub = Tree.unpacked(below.column("grown")[0].as_py())
                bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
                share = sub.values(rule)[sub.route(bins)]
            else:
                share = np.full(len(ids), group.column("share")[0].as_py() if len(ids) else 0.0)
            return pa.table({"_id": ids, "share": share})

        sent = rows.select("_id", "_x").mapInArrow(send, "tree int, node int, share double, ids binary, bins binary")
        below = self.below if self.below is not None else spark.createDataFrame([], "tree int, node int, grown binary")
        shares = sent.groupBy("tree", "node").cogroup(below.groupBy("tree", "node")).applyInArrow(score, "_id long, share double")
        # Sums come in any order; rounding makes them equal.
        total = shares.groupBy("_id").agg(F.round(F.sum("share") / len(self.tops), 12).alias("score")).checkpoint()
        return rows.join(total, "_id").select(*[quote(k) for k in keep], (F.col("score") >= 0.5).cast("int").alias("prediction"), "score")


def _grow_forest(rows: DataFrame, g: Growth, n_estimators: int, features: Sequence[str], cuts: list[np.ndarray]) -> Forest:
    """Grows the trees in groups whose histograms fit a round; each group's subtrees are written once, where they were grown."""
    from functools import reduce
    group = max(1, ROUND_CELLS // (g.per_node * BINS * 3 * 32))
    tops: dict[int, Tree] = {}
    parts: list[DataFrame] = []
    for s in range(0, n_estimators, group):
        grown, small = _tops(rows, g, list(range(s, min(n_estimators, s + group))))
        tops |= grown
        if small:
            parts.append(_subtrees(rows, g, grown, small).checkpoint())
    return Forest(list(features), cuts, tops, reduce(DataFrame.unionByName, parts) if parts else None, g.rule)


def fit_balanced_forest(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, n_estimators: int = 500,
                        max_depth: int | None = None, min_samples_leaf: int = 2, max_features="sqrt", seed: int = 42) -> Forest:
    """A forest whose every tree has its own class-balanced bag."""
    cuts = quantile_cuts(train, features)
    rows = binned(train, features, label, cuts, key)
    steps = [poisson_steps(r) for r in class_rates(*_class_counts(rows))]
    line = lines(n_estimators, seed)

    def stats(tree: int, b: pa.RecordBatch) -> np.ndarray:
        h1, h2, y = _columns_of(b, "h1", "h2", "y")
        n = bag_counts(h1, h2, y, line[tree], steps).astype(np.float64)
        return np.stack([n * (y == 0), n * (y == 1), n], axis=1)

    width = len(features)
    g = Growth(stats, Rule(min_rows=float(min_samples_leaf)), {t: np.arange(width) for t in range(n_estimators)}, _share(max_features, width), width, seed,
               depth=max_depth or math.inf)
    return _grow_forest(rows, g, n_estimators, features, cuts)


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, n_estimators: int = 500,
                      max_depth: int | None = None, min_samples_leaf: int = 3, max_features="sqrt", seed: int = 42) -> Forest:
    """A forest over bootstrap bags (each row Poisson(1) times) with balanced class weights."""
    cuts = quantile_cuts(train, features)
    rows = binned(train, features, label, cuts, key)
    n0, n1 = _class_counts(rows)
    w0, w1 = ((n0 + n1) / (2 * max(n, 1)) for n in (n0, n1))
    steps, line = [poisson_steps(1.0)] * 2, lines(n_estimators, seed)

    def stats(tree: int, b: pa.RecordBatch) -> np.ndarray:
        h1, h2, y = _columns_of(b, "h1", "h2", "y")
        n = bag_counts(h1, h2, y, line[tree], steps).astype(np.float64)
        return np.stack([w0 * n * (y == 0), w1 * n * (y == 1), n], axis=1)

    width = len(features)
    g = Growth(stats, Rule(min_rows=float(min_samples_leaf)), {t: np.arange(width) for t in range(n_estimators)}, _share(max_features, width), width, seed,
               depth=max_depth or math.inf)
    return _grow_forest(rows, g, n_estimators, features, cuts)


def fit_extra_trees(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 500, max_depth: int | None = None,
                    min_samples_leaf: int = 1, max_features="sqrt", seed: int = 42) -> Forest:
    """Trees over all rows with balanced class weights, whose nodes choose among random cuts."""
    cuts = quantile_cuts(train, features)
    rows = binned(train, features, label, cuts, None)
    n0, n1 = _class_counts(rows)
    w0, w1 = ((n0 + n1) / (2 * max(n, 1)) for n in (n0, n1))

    def stats(tree: int, b: pa.RecordBatch) -> np.ndarray:
        y = b.column("y").to_numpy()
        return np.stack([w0 * (y == 0), w1 * (y == 1), np.ones(len(y))], axis=1)

    width = len(features)
    g = Growth(stats, Rule(min_rows=float(min_samples_leaf)), {t: np.arange(width) for t in range(n_estimators)}, _share(max_features, width), width, seed,
               depth=max_depth or math.inf, random=True)
    return _grow_forest(rows, g, n_estimators, features, cuts)


def logistic_stats(margin: np.ndarray, y: np.ndarray, pos_weight: float, used: np.ndarray) -> np.ndarray:
    """Gradient, hessian and count of the weighted logistic loss, zero for rows not drawn."""
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, pos_weight, 1.0) * used
    return np.stack([w * (p - y), w * p * (1 - p), used.astype(np.float64)], axis=1)


def fit_booster(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, n_estimators: int = 400, learning_rate: float = 0.05,
                num_leaves: int | None = None, max_depth: int | None = None, min_child_samples: int = 1, min_child_weight: float = 1e-3,
                subsample: float = 0.8, colsample_bytree: float = 0.8, reg_alpha: float = 0.0, reg_lambda: float = 1.0,
                pos_weight: float = 1.0, seed: int = 42) -> Ensemble:
    """Newton boosting; ``num_leaves`` grows leaf by leaf (largest gain first), ``max_depth`` level by level."""
    cuts = quantile_cuts(train, features)
    rows = binned(train, features, label, cuts, key)
    width, rng = len(features), np.random.default_rng([seed, 11])
    rule = Rule(True, reg_alpha, reg_lambda, float(min_child_samples), float(min_child_weight))
    line, limit = lines(n_estimators, seed), int(subsample * PRIME)
    columns = {t: np.sort(rng.choice(width, _share(colsample_bytree, width), replace=False)) for t in range(n_estimators)}
    trees: list[Tree] = []
    values: list[np.ndarray] = []
    n = rows.count()
    fits_task = n <= local_rows(width)
    together = REFRESH * max(1, HERE_ROWS // max(n, 1)) if fits_task else REFRESH
    while len(trees) < n_estimators:
        fresh, rounds = len(trees), min(together, n_estimators - len(trees))
        at = range(fresh, fresh + rounds)

        def growth(t: int, stats: Callable) -> Growth:
            return Growth(stats, rule, {t: columns[t]}, len(columns[t]), width, seed, max_depth or math.inf, num_leaves or math.inf)

        def stats_of(t: int, h1, h2, y, margin) -> np.ndarray:
            return logistic_stats(margin, y, pos_weight, draw(h1, h2, line[t]) < limit)

        if fits_task:
            trees += _boost_here(rows, list(at), growth, stats_of, rule, learning_rate, width)
            values += [tree.values(rule, learning_rate) for tree in trees[fresh:]]
        for t in [] if fits_task else at:
            recent = rows.sparkSession.sparkContext.broadcast((trees[fresh:], values[fresh:]))

            def stats(tree: int, b: pa.RecordBatch, recent=recent) -> np.ndarray:
                h1, h2, y, margin = _columns_of(b, "h1", "h2", "y", "margin")
                return stats_of(tree, h1, h2, y, _added(margin, _matrix(b, width), *recent.value))

            trees.append(grow(rows, growth(t, stats), [t])[t])
            values.append(trees[-1].values(rule, learning_rate))
        if len(trees) < n_estimators:
            rows = _refreshed(rows, trees[fresh:], values[fresh:], width)
    return Ensemble(list(features), cuts, trees, values, "logistic")


def _boost_here(rows: DataFrame, at: list[int], growth: Callable, stats_of: Callable, rule: Rule, rate: float, width: int) -> list[Tree]:
    """Several rounds in the one task that holds all rows (at most ``local_rows``); each round as ``grow`` would take it."""
    import pickle

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("h1", "h2", "bins", "y")]).combine_chunks()
        h1, h2, y, margin = [group.column(c).to_numpy() for c in ("h1", "h2", "y", "margin")]
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), dtype=np.uint8).reshape(group.num_rows, width)
        out = []
        for t in at:
            stats = stats_of(t, h1, h2, y, margin)
            used = np.flatnonzero(stats[:, 2] > 0)
            g = growth(t, None)
            enough = len(used) > 1 and len(used) >= 2 * rule.min_rows
            tree = grow_here(bins[used], stats[used], rule, lambda n: g.node_columns(t, n), g.depth if enough else 0, g.leaves)
            margin = _added(margin, bins, [tree], [tree.values(rule, rate)])
            out.append(tree)
        return pa.table({"grown": pa.array([pickle.dumps(out)], pa.binary())})

    got = rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "grown binary").collect()
    return pickle.loads(got[0]["grown"]) if got else []


def _added(margin: np.ndarray, bins: np.ndarray, trees: list[Tree], values: list[np.ndarray]) -> np.ndarray:
    margin = margin.copy()
    for tree, value in zip(trees, values):
        margin += value[tree.route(bins)]
    return margin


def _refreshed(rows: DataFrame, trees: list[Tree], values: list[np.ndarray], width: int) -> DataFrame:
    """The rows with the trees' values added to their margins, written once."""
    recent = rows.sparkSession.sparkContext.broadcast((trees, values))

    def run(batches):
        for b in batches:
            margin = _added(b.column("margin").to_numpy(), _matrix(b, width), *recent.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("h1", "h2", "y", "bins")], pa.array(margin)], ["h1", "h2", "y", "bins", "margin"])

    return rows.mapInArrow(run, rows.schema).checkpoint()


def stump(hist: np.ndarray) -> tuple[Tree, float]:
    """The split of least weighted error of a (features, BINS, 2) histogram of class weights, and that error."""
    left = hist.cumsum(axis=1)
    total = left[0, -1]
    right = total - left
    # A side votes for its heavier class; equal errors go to the first feature and byte.
    error = np.minimum(left[..., 0], left[..., 1]) + np.minimum(right[..., 0], right[..., 1])
    j, t = np.unravel_index(int(np.argmax(error <= error.min() * (1 + 1e-9) + 1e-15)), error.shape)
    tree = Tree()
    tree.add([*total, total.sum()], 0)
    tree.split(0, 1.0, int(j), int(t), [*left[j, t], left[j, t].sum()], [*right[j, t], right[j, t].sum()])
    return tree, float(error[j, t] / max(total.sum(), 1e-300))


def fit_easy_ensemble(train: DataFrame, features: Sequence[str], label: str, key: str | None = None, n_estimators: int = 30,
                      rounds: int = 50, seed: int = 42) -> Ensemble:
    """Boosted stumps on balanced bags: all rows of the smaller class and a draw of the larger one; one pass a round for all bags."""
    cuts = quantile_cuts(train, features)
    rows = binned(train, features, label, cuts, key)
    width = len(features)
    limits = [int(r * PRIME) for r in class_rates(*_class_counts(rows))]
    line = lines(n_estimators, seed)
    stumps: list[list[Tree]] = [[] for _ in range(n_estimators)]
    alphas: list[list[float]] = [[] for _ in range(n_estimators)]
    live = list(range(n_estimators))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((stumps, alphas, live))

        def count(batches, shared=shared):
            stumps, alphas, live = shared.value
            total = {k: np.zeros((width, BINS, 2)) for k in live}
            for b in batches:
                bins = _matrix(b, width)
                h1, h2, y = _columns_of(b, "h1", "h2", "y")
                for k in live:
                    used = draw(h1, h2, line[k]) < np.where(y == 1, limits[1], limits[0])
                    own, yes = bins[used], y[used]
                    w = np.ones(len(own))
                    for tree, a in zip(stumps[k], alphas[k]):
                        w *= np.exp(a * ((_vote(tree)[tree.route(own)]) != yes))
                    sums = np.stack([w * (yes == 0), w * (yes == 1), w], axis=1)
                    total[k] += histogram(own, sums, np.arange(width))[..., :2]
            yield pa.RecordBatch.from_pydict({"tree": pa.array(live, pa.int32()), "node": pa.array([0] * len(live), pa.int32()),
                                              "hist": [total[k].tobytes() for k in live]})

        def choose(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for k, raw in zip(b.column("tree").to_pylist(), b.column("hist").to_pylist()):
                    h = np.frombuffer(raw).reshape(width, BINS, 2)
                    total[k] = total[k] + h if k in total else h
            import pickle
            found = {k: stump(h) for k, h in total.items()}
            if found:
                yield pa.RecordBatch.from_pydict({"tree": pa.array(list(found), pa.int32()), "grown": [pickle.dumps(f) for f in found.values()]})

        import pickle
        for r in rows.mapInArrow(count, _HIST).repartition("tree").mapInArrow(choose, "tree int, grown binary").collect():
            tree, error = pickle.loads(r["grown"])
            k = r["tree"]
            if error >= 0.5:  # no better than chance: the bag's boosting ends
                live = [x for x in live if x != k]
                continue
            stumps[k].append(tree)
            alphas[k].append(math.log((1 - error) / max(error, 1e-10)))
            if error <= 0:
                live = [x for x in live if x != k]
        if not live:
            break
    trees = [t for own in stumps for t in own]
    ends = np.cumsum([len(own) for own in stumps]).tolist()
    bags = [list(range(e - len(own), e)) for e, own in zip(ends, stumps)]
    return Ensemble(list(features), cuts, trees, [_vote(t) for t in trees], "bags", alphas, bags)


def _vote(tree: Tree) -> np.ndarray:
    """The class that each node votes for."""
    return np.array([float(s[1] > s[0]) for s in tree.sums])
