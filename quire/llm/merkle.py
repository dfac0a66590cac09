"""Merkle manifest of a dataset with checkpoint-and-recompute proofs.

A leaf is the digest of one row's fields. The leaves of a group (language) in order of their id are the lowest
level of its tree; ``FANOUT`` neighbours have one parent, up to a single node, the group's subroot.
The subroots in order of their group are the leaves of one more tree, whose top is the root.

Only every ``STEP``-th level is persisted: a stored node covers an aligned subtree of FANOUT ** STEP nodes of
the stored level below. To extract proofs, each aligned subtree is gathered from its stored descendants
(at most 512 rows, whatever the input), the levels between are computed again, the
siblings of every node are emitted and the levels are dropped. Proofs go from the top to the
bottom, so each stored level is read once and joined by (tree, subtree) to the proofs above it.

Places in a tree come from one range exchange over (group, id): rows are numbered within
their range, and counts by (range, group) give the offsets. No group is ever sorted in one task; rows
that repeat group, id and leaf are parted by a tie-breaker, so they spread as well.

Defined results: a null field is ``-``; a null group is a tree of its own, before all others; null ids come
first in their tree; rows that repeat an id are leaves of their own, in order of their digest; an
empty table has no rows; a null id counts as the empty text where its decimal text is hashed; other columns are never read.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ascii_lower, documents, fold_of, stable

FANOUT, STEP = 8, 3
SPAN = FANOUT ** STEP
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A proof: for each level from the leaf to the root the digests left and right of the own node, joined.
PATH = "array<struct<left:string,right:string>>"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    texts = [c.cast("string") for c in fields]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def tree_name(group: str) -> Column:
    """Names sort like the groups: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (place in the tree by ``order``, from 0) and ``n`` (nodes of the tree) to rows with ``tree``."""
    dealt = stable(stable(rows).withColumn("_tie", F.monotonically_increasing_id())
                   .repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
                   .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    # Within a range the rows of a tree are neighbours, numbered one by one.
    counts = dealt.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "tree", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                            F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    return stable(dealt.join(offsets, ["_part", "tree"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def _parents(hashes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: sha(F.array_join(F.slice(hashes, i * FANOUT + 1, FANOUT), "")))


def next_stored(level: DataFrame) -> DataFrame:
    """The stored level ``STEP`` levels up: (tree, n, pos, hash); a tree with a single node keeps it."""
    nodes = level.groupBy("tree", "n", F.floor(F.col("pos") / SPAN).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("nodes"))
    up = nodes.select("tree", "pos", F.col("n").alias("m"), F.transform("nodes", lambda x: x["hash"]).alias("h"))
    for _ in range(STEP):
        up = up.select("tree", "pos", F.ceil(F.col("m") / FANOUT).alias("m"), F.when(F.col("m") > 1, _parents(F.col("h"))).otherwise(F.col("h")).alias("h"))
    return up.select("tree", F.col("m").alias("n"), "pos", F.get("h", F.lit(0)).alias("hash"))


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """The persisted levels of all trees, from the leaves up to the level where every tree has one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stable(next_stored(levels[-1].select("tree", "n", "pos", "hash"))))
        most = -(-most // SPAN)
    return levels


@dataclass
class Manifest:
    """Stored levels of the groups' trees (``levels[0]`` has the entries' own columns) and of the tree of subroots."""
    levels: list[DataFrame]
    tops: list[DataFrame] = field(default_factory=list)


def build(entries: DataFrame) -> Manifest:
    """The manifest of rows with ``tree``, ``doc_id``, ``hash`` and any columns to be carried along to the proofs."""
    levels = stored_levels(placed(entries, ["doc_id", "hash"]))
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    return Manifest(levels, stored_levels(placed(subroots, ["name"])))


def root(manifest: Manifest) -> DataFrame:
    """The dataset's digest in one row (none for an empty table)."""
    return manifest.tops[-1].select(F.col("hash").alias("root"))


def _siblings(n: int, hashes: list[str]) -> list[list[dict]]:
    """For each node of an aligned subtree its (left, right) digests up to the subtree's top."""
    out: list[list[dict]] = [[] for _ in hashes]
    owners = [[i] for i in range(len(hashes))]
    for _ in range(STEP):
        if n <= 1:
            break
        up, above = [], []
        for s in range(0, len(hashes), FANOUT):
            run = hashes[s:s + FANOUT]
            for k, own in enumerate(owners[s:s + FANOUT]):
                step = {"left": "".join(run[:k]), "right": "".join(run[k + 1:])}
                for i in own:
                    out[i].append(step)
            up.append(hashlib.sha256("".join(run).encode()).hexdigest())
            above.append([i for own in owners[s:s + FANOUT] for i in own])
        hashes, owners, n = up, above, -(-n // FANOUT)
    return out


def _descend(level: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of a stored level's nodes from the paths of the stored nodes above them."""
    own = [c for c in level.columns if c not in ("n", "pos", "_block")]
    schema = StructType([level.schema[c] for c in own] + [level.schema["pos"]] + StructType.fromDDL(f"top {PATH}, subroot string, root string").fields)

    def extract(nodes: pa.Table, over: pa.Table) -> pa.Table:
        shape = to_arrow_schema(schema)
        if not nodes.num_rows or not over.num_rows:
            return shape.empty_table()
        nodes = nodes.sort_by("pos").combine_chunks()
        upper = over.column("path")[0].as_py()
        found = _siblings(nodes.column("n")[0].as_py(), nodes.column("hash").to_pylist())
        same = {c: pa.array([over.column(c)[0].as_py()] * nodes.num_rows, pa.string()) for c in ("subroot", "root")}
        path = pa.array([p + upper for p in found], shape.field("top").type)
        return pa.table([*[nodes.column(c).cast(shape.field(c).type) for c in [*own, "pos"]], path, same["subroot"], same["root"]], schema=shape)

    blocks = level.withColumn("_block", F.floor(F.col("pos") / SPAN))
    out = blocks.groupBy("tree", "_block").cogroup(above.withColumnRenamed("pos", "_block").groupBy("tree", "_block")).applyInArrow(extract, schema)
    return out.withColumnRenamed("top", "path")


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The entries with ``path``, ``subroot`` and ``root``; only those whose ``doc_id`` is in ``wanted``, if given.

    For a few ids only the aligned subtrees that hold them are gathered again.
    """
    peak = manifest.tops[-1]
    paths = peak.select("tree", "pos", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    for level in reversed(manifest.tops[:-1]):
        paths = _descend(level, paths)
    if len(manifest.tops) == 1:
        paths = peak.select("name", "hash", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    named = paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root")
    chosen = manifest.levels
    if wanted is not None:
        ids = wanted.select("doc_id").distinct()
        held = chosen[0].join(ids, "doc_id", "left_semi").select("tree", F.floor(F.col("pos") / SPAN).alias("_b")).distinct()
        base = chosen[0].withColumn("_b", F.floor(F.col("pos") / SPAN)).join(held, ["tree", "_b"], "left_semi").drop("_b")
        chosen = [base, *chosen[1:]]
    if len(chosen) == 1:
        return chosen[0].join(named.drop("pos"), "tree").drop("pos", "n", "tree")
    paths = named
    for level in reversed(chosen[:-1]):
        paths = _descend(level, paths)
    paths = paths.drop("pos", "tree")
    return paths if wanted is None else paths.join(ids, "doc_id", "left_semi")


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: sha(F.concat(p["left"], h, p["right"])))


def entries(docs: DataFrame, carry: dict[str, Column] | None = None, fields: list[str] = FIELDS, group: str = "lang") -> DataFrame:
    """(doc_id, tree, hash) of all rows, and the ``carry`` columns (kept beside the leaf, not hashed)."""
    return docs.select("doc_id", tree_name(group).alias("tree"), leaf_digest([F.col(c) for c in fields]).alias("hash"),
                       *[v.alias(k) for k, v in (carry or {}).items()])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per document with its digests; a third of the leaves are tampered with (text lower-cased) and folded again."""
    changed = leaf_digest([ascii_lower(F.col("text")) if c == "text" else F.col(c) for c in FIELDS])
    rows = entries(docs, {"_changed": F.when(fold_of("doc_id", 3) == 0, changed)})
    proved = proofs(build(rows))
    out = proved.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"),
                        folded(F.coalesce("_changed", "hash")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir) -> DataFrame:
    return verified_manifest(documents(spark, sf_dir))


_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of an id's decimal text: bit by bit over its bytes (fixed value: the polynomial 3988292384).
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF} AS h, CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_LEAF.replace('text::VARCHAR', _LOWER)} END AS changed
  FROM documents),
leaves AS (SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes(tree, lvl, pos, n, h) AS (
  SELECT tree, 0, pos, n, h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY tree, lvl, pos // 8, n),
subroots AS (SELECT tree, lvl, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 8, n),
every AS (
  SELECT tree, lvl, pos, n, h FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.tree, s.lvl + t.lvl, t.pos, t.n, t.h FROM tops t, subroots s WHERE t.n > 1),
steps AS (
  SELECT l.doc_id, l.tree, l.pos AS leaf_pos, e.lvl,
    coalesce(string_agg(e.h, '' ORDER BY e.pos) FILTER (e.pos < a.at), '') AS lft,
    coalesce(string_agg(e.h, '' ORDER BY e.pos) FILTER (e.pos > a.at), '') AS rgt
  FROM leaves l JOIN subroots s ON s.tree = l.tree
  JOIN (SELECT tree, lvl FROM every GROUP BY ALL) v ON v.tree = l.tree,
  LATERAL (SELECT CASE WHEN v.lvl < s.lvl THEN l.pos // (8 ** v.lvl)::BIGINT ELSE s.pos // (8 ** (v.lvl - s.lvl))::BIGINT END AS at) a
  JOIN every e ON e.tree = l.tree AND e.lvl = v.lvl AND e.pos // 8 = a.at // 8
  GROUP BY l.doc_id, l.tree, l.pos, e.lvl),
fold(tree, leaf_pos, lvl, h) AS (
  SELECT tree, pos, 0, coalesce(changed, h) FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.lvl + 1, sha256(s.lft || f.h || s.rgt) FROM fold f
  JOIN steps s ON s.tree = f.tree AND s.leaf_pos = f.leaf_pos AND s.lvl = f.lvl),
proof AS (SELECT tree, leaf_pos, string_agg(lft || rgt, '' ORDER BY lvl) AS p, max(lvl) + 1 AS top FROM steps GROUP BY ALL)
SELECT l.doc_id, l.h AS leaf, s.subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
LEFT JOIN proof p ON p.tree = l.tree AND p.leaf_pos = l.pos
JOIN fold f ON f.tree = l.tree AND f.leaf_pos = l.pos AND f.lvl = coalesce(p.top, 0)
"""
