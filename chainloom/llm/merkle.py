"""Merkle manifest of a dataset, with checkpoint-and-recompute proofs.

Every row is a leaf; leaves of one tree (rows of one ``tree_col`` value) are ordered by id, and every two consecutive nodes
become their parent until one node, the subroot, remains.  Subroots, ordered by tree, form the top tree, whose last node is
the root of the dataset.

Only every ``step``-th level is written.  Between two written levels lie aligned subtrees of at most 2^step nodes; each is
rebuilt in a task of its own where it is needed, once upwards to find the next written level and once downwards to emit the
siblings of its lowest nodes, and its interior nodes are then discarded.  A proof so costs one pass over the leaves and one
over the (2^step times smaller) written levels above them, and no task ever holds more than one subtree.

Places of leaves come from one range sort: Spark numbers rows inside sorted partitions, and the counts of (partition, tree)
give the carry, so a tree that holds most rows is spread over as many tasks as any other rows.  Digests travel as 32 bytes.

Defined results: null trees come first, then by bytes of UTF-8; null ids come first in a tree; rows with the same id are
ordered by leaf digest, and equal rows are leaves of their own; a null field is ``-``; a lone node without a sibling is
hashed alone on its way up; a tree of one leaf has that leaf as its subroot; an empty table has no leaves, an empty result
and no root; columns other than the named ones are not read, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chainloom.operators.storage import materialise

STEP = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, idx long, m long, hash binary"
_PATH_DDL = "array<struct<hash:string,left:boolean>>"
_STATE = f"tree string, block long, path {_PATH_DDL}, subroot binary, root binary"
_PATH = pa.list_(pa.struct([("hash", pa.string()), ("left", pa.bool_())]))


@dataclass
class Manifest:
    """Written levels of the trees.  ``leaves`` also holds ``item`` and the carried columns."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    step: int

    def root(self) -> DataFrame:
        """One row (root) as lowercase hex; none for an empty table."""
        return self.top[-1].filter("m = 1").select(F.lower(F.hex("hash")).alias("root"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex digest of the fields in order: ``-`` for null, else byte count, colon and value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def climb(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The nodes and the levels above them: ``levels`` of them, or up to a single node for None."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        low = [d.hex() for d in out[-1]]
        out.append([sha256("".join(low[i : i + 2]).encode()).digest() for i in range(0, len(low), 2)])
    return out


def _subtree(rows: pa.Table, step: int) -> tuple[pa.Table, list[list[bytes]]]:
    """The rows of one aligned subtree in order, and its levels; it ends early where the whole tree fits in it."""
    rows = rows.take(pa.array(np.argsort(rows["idx"].to_numpy(), kind="stable")))
    return rows, climb(rows["hash"].to_pylist(), step if rows["m"][0].as_py() > 1 << step else None)


def _numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Add ``idx`` (place inside the tree) and ``m`` (nodes of the tree) by one range sort on tree and ``order``."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), label)
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = counts.select("part", "tree", "first", before.alias("before"), F.sum("n").over(tree).alias("m"))
    numbered = ordered.join(carry, ["part", "tree"])
    return numbered.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _block(step: int) -> Column:
    return F.shiftright("idx", step).alias("block")


def _next_level(nodes: DataFrame, step: int) -> DataFrame:
    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows, levels = _subtree(rows, step)
        m = rows["m"][0].as_py()
        above = 1 if m <= 1 << step else -(-m // (1 << step))
        return pa.table({"tree": [key[0].as_py()], "idx": [key[1].as_py()], "m": [above], "hash": [levels[-1][0]]})

    return nodes.select("tree", "idx", "m", "hash").groupBy("tree", _block(step)).applyInArrow(build, _NODE)


def _levels(nodes: DataFrame, step: int, label: str) -> list[DataFrame]:
    """The written levels above ``nodes``; the last holds single nodes only.  A finished tree is not carried on."""
    out, most = [], nodes.agg(F.max("m")).first()[0]
    while most:
        out.append(materialise(_next_level(nodes, step), f"{label}-{step * (len(out) + 1)}"))
        nodes = out[-1].filter("m > 1")
        most = nodes.agg(F.max("m")).first()[0]
    return out


def manifest(
    docs: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    carry: Mapping[str, Column] | None = None,
    step: int = STEP,
) -> Manifest:
    """Hash, number and write the leaves and every ``step``-th level above them.

    ``carry`` names columns that are computed with the leaves and kept beside them.
    """
    carry = dict(carry or {})
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    digest = F.unhex(leaf_digest([F.col(f"`{c}`") for c in fields]))
    leaves = docs.select(
        tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), digest.alias("hash"),
        F.monotonically_increasing_id().alias("item"), *[c.alias(f"carry_{n}") for n, c in carry.items()],
    )
    leaves = _numbered(materialise(leaves, "merkle-rows"), ("id", "hash", "item"), "merkle-leaves")
    levels = _levels(leaves, step, "merkle-level")
    ends = [level.filter("m = 1").select("tree", "hash") for level in levels]
    subroots = leaves.limit(0).select("tree", "hash")
    for end in ends:
        subroots = subroots.unionByName(end)
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    subroots = _numbered(top, ("name",), "merkle-subroots")
    return Manifest(leaves, levels, subroots, _levels(subroots, step, "merkle-top"), step)


def _paths(rows: pa.Table, step: int, above: list[dict]) -> tuple[pa.Table, list[list[dict]]]:
    """Per row of a subtree, the siblings from its level to the root: inside the subtree, then those above it."""
    rows, levels = _subtree(rows, step)
    out = []
    for i in range(rows.num_rows):
        path = []
        for level in levels[:-1]:
            other = i ^ 1
            path.append({"hash": level[other].hex() if other < len(level) else None, "left": other < i})
            i >>= 1
        out.append(path + above)
    return rows, out


def _descend(nodes: DataFrame, states: DataFrame, step: int, emit: Callable, schema: str | StructType) -> DataFrame:
    """Rebuild every aligned subtree of ``nodes`` beside the state of the node it ends in."""

    def meet(rows: pa.Table, state: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return emit(rows, [], None)
        top = state.to_pylist()[0]
        return emit(*_paths(rows, step, top["path"]), top)

    left = nodes.groupBy("tree", _block(step))
    return left.cogroup(states.groupBy("tree", "block")).applyInArrow(meet, schema)


def _state_rows(rows: pa.Table, paths: list, top: dict | None) -> pa.Table:
    """States of the nodes of a level, for the subtrees they end."""
    return pa.table({"tree": rows["tree"], "block": rows["idx"], "path": pa.array(paths, _PATH), **_ends(top, len(paths))})


def _proof_rows(rows: pa.Table, paths: list, top: dict | None) -> pa.Table:
    """The leaves with their paths; every other column of a leaf stays as it is."""
    kept = {n: rows[n] for n in rows.schema.names if n not in ("tree", "m", "block")}
    return pa.table({**kept, "path": pa.array(paths, _PATH), **_ends(top, len(paths))})


def _named_rows(rows: pa.Table, paths: list, top: dict | None) -> pa.Table:
    """States of the trees below the top tree, each at its last node; their subroot is the leaf of the top tree."""
    state = {"block": pa.array([0] * len(paths), pa.int64()), "path": pa.array(paths, _PATH)}
    return pa.table({"tree": rows["name"], **state, **_ends(top, len(paths)), "subroot": rows["hash"]})


def _ends(top: dict | None, n: int) -> dict[str, pa.Array]:
    return {c: pa.array([top[c] if top else None] * n, pa.binary()) for c in ("subroot", "root")}


def _start(tree: DataFrame, path: Column, subroot: Column, root: Column) -> DataFrame:
    return tree.select("tree", F.lit(0).cast("long").alias("block"), path.alias("path"), subroot.alias("subroot"), root.alias("root"))


def _down(levels: list[DataFrame], start: DataFrame, step: int) -> DataFrame:
    """States of the nodes of the lowest written level; ``start`` holds one per tree, at its last node."""
    states = None
    for i in range(len(levels) - 1, -1, -1):
        ending = levels[i].filter("m = 1").select("tree").join(start, "tree").select(*start.columns)
        if states is not None:
            below = _descend(levels[i].filter("m > 1"), states, step, _state_rows, _STATE)
            ending = ending.unionByName(below)
        states = ending
    return states


def proofs(tree: Manifest) -> DataFrame:
    """Every leaf: id, leaf, idx, subroot, root, path and the carried columns.

    ``path`` goes up from the leaf to the root: ``hash`` is the sibling, null where the node is alone in its run, and
    ``left`` tells whether the sibling stands to the left.
    """
    leaves = tree.leaves.drop("item")
    empty = F.array().cast(_PATH_DDL)
    if tree.top:
        over = _start(tree.top[-1].filter("m = 1"), empty, F.lit(None).cast("binary"), F.col("hash"))
        named = _descend(tree.subroots, _down(tree.top, over, tree.step), tree.step, _named_rows, _STATE)
        states = _down(tree.levels, named, tree.step)
    else:  # an empty table
        states = leaves.sparkSession.createDataFrame([], _STATE)
    kept = [f for f in leaves.schema if f.name not in ("tree", "m")]
    found = StructType([*kept, *StructType.fromDDL(f"path {_PATH_DDL}, subroot binary, root binary")])
    rows = _descend(leaves, states, tree.step, _proof_rows, found)
    carried = [F.col(f.name).alias(f.name.removeprefix("carry_")) for f in kept if f.name.startswith("carry_")]
    digests = [F.lower(F.hex(c)).alias(n) for c, n in (("hash", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return rows.select("id", digests[0], "idx", *digests[1:], "path", *carried)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        other = step["hash"]
        both = F.when(other.isNull(), node).when(step["left"], F.concat(other, node)).otherwise(F.concat(node, other))
        return F.sha2(both, 256)

    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """Digest of the siblings of a path, bottom up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["hash"]), ""), 256)


#: The same rows in plain SQL: nodes level by level, then every leaf's way up.
ORACLE = """
WITH RECURSIVE table_of(crc) AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
), marked AS (
  SELECT row_number() OVER () AS item, d.*, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) + 1 AS INT)]))) % 7 = 0 ELSE FALSE END AS picked
  FROM documents d, table_of
), fields AS (
  SELECT item, doc_id, lang, n_chars, picked,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM marked
), hashed AS (
  SELECT item, doc_id, coalesce('=' || lang, '') AS tree, sha256(head || chars || tail) AS leaf,
    sha256(head || CASE WHEN picked THEN more ELSE chars END || tail) AS shown FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, item) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS m FROM hashed
), nodes(tree, level, idx, m, hash) AS (
  SELECT tree, 0, idx, m, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (any_value(m) + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE m > 1 GROUP BY tree, level, idx // 2
), subroots AS (
  SELECT tree, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS m FROM nodes WHERE m = 1
), tops(level, idx, m, hash) AS (
  SELECT 0, idx, m, hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (any_value(m) + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx))
  FROM tops WHERE m > 1 GROUP BY level, idx // 2
), low(item, tree, level, idx, m, hash, proof) AS (
  SELECT item, tree, 0, idx, m, shown, '' FROM leaves
  UNION ALL
  SELECT w.item, w.tree, w.level + 1, w.idx // 2, (w.m + 1) // 2,
    sha256(CASE WHEN n.idx < w.idx THEN n.hash ELSE '' END || w.hash || CASE WHEN n.idx > w.idx THEN n.hash ELSE '' END),
    w.proof || coalesce(n.hash, '')
  FROM low w LEFT JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.idx = xor(w.idx, 1) WHERE w.m > 1
), high(item, level, idx, m, hash, proof) AS (
  SELECT l.item, 0, s.idx, s.m, l.hash, l.proof FROM low l JOIN subroots s USING (tree) WHERE l.m = 1
  UNION ALL
  SELECT w.item, w.level + 1, w.idx // 2, (w.m + 1) // 2,
    sha256(CASE WHEN n.idx < w.idx THEN n.hash ELSE '' END || w.hash || CASE WHEN n.idx > w.idx THEN n.hash ELSE '' END),
    w.proof || coalesce(n.hash, '')
  FROM high w LEFT JOIN tops n ON n.level = w.level AND n.idx = xor(w.idx, 1) WHERE w.m > 1
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(h.proof) AS proof_sha256, h.hash AS folded_root,
  h.hash = r.hash AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN high h ON h.item = l.item AND h.m = 1 JOIN tops r ON r.m = 1
"""
