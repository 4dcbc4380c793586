"""Exact inner-product search over cover trees, queries against all rows.

Rows and queries are dealt evenly into blocks, and every pair of blocks is one cell of a grid: a stated query set against
all rows, in blocks of bounded size.  Inside a cell both blocks are indexed by a cover tree whose levels halve the covering
radius.  A pair of nodes is pruned when the largest inner product their centres and radii allow is below the worst k-th
score of the query node's group; leaves meet in one matrix product.  A node whose points do not cluster (more children than
a net of that radius should need) stays a leaf, so that data without structure costs a matrix product and not a tree.

Components are whole numbers, so scores are exact: the arithmetic is done in doubles while every sum stays below 2^53 and in
64-bit integers beyond.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an
id; vectors of different length are not compared; a row is not a candidate of a query with its own id; ties go to the
smaller id; repeated query rows count once, repeated candidates each; fewer than ``k`` candidates give fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.vectors import FOUND, best_of, matrix, spread, valid_vectors
from chainloom.operators.storage import materialise

ROW_BLOCK, QUERY_BLOCK = 4096, 4096
LEAF = 64
MOST_CHILDREN = 24


@dataclass
class Node:
    """Points ``at`` lie within ``radius`` of ``center``."""

    at: np.ndarray
    center: np.ndarray
    radius: float
    length: float
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray, at: np.ndarray | None = None, center: np.ndarray | None = None) -> Node:
    at = np.arange(len(points)) if at is None else at
    center = points[at].mean(axis=0) if center is None else center
    away = np.sqrt(((points[at] - center) ** 2).sum(axis=1))
    node = Node(at, center, float(away.max(initial=0.0)), float(np.sqrt((center**2).sum())))
    if len(at) <= LEAF or node.radius == 0:
        return node
    reach, rest, parts = node.radius / 2, at, []
    while len(rest):
        if len(parts) == MOST_CHILDREN:
            return node  # no net of this radius: the points do not cluster
        seed = points[rest[0]]
        near = ((points[rest] - seed) ** 2).sum(axis=1) <= reach * reach
        parts.append((rest[near], seed))
        rest = rest[~near]
    node.children = [cover_tree(points, part, seed) for part, seed in parts]
    return node


class _Search:
    """Best lists of one cell.  ``codes`` order candidates by score, then by place: rows are in order of their ids."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, slack: float = 1e-9):
        self.queries, self.rows, self.own, self.ids, self.k, self.slack = queries, rows, own, ids, k, slack
        self.scale = max(1, len(rows))
        self.codes = np.full((len(queries), k), -np.inf)
        self.worst = np.full(len(queries), -np.inf)

    def bound(self, q: Node, r: Node) -> float:
        between = float((q.center * r.center).sum())
        most = between + q.radius * r.length + r.radius * q.length + q.radius * r.radius
        return most + self.slack * (1 + abs(most))

    def visit(self, q: Node, r: Node) -> None:
        if self.bound(q, r) < self.worst[q.at].min():
            return
        if not q.children and not r.children:
            for s in range(0, len(q.at), 256):
                self.meet(q.at[s : s + 256], r.at)
            return
        pairs = [(a, b) for a in q.children or [q] for b in r.children or [r]]
        for a, b in sorted(pairs, key=lambda p: -self.bound(*p)):
            self.visit(a, b)

    def meet(self, q: np.ndarray, r: np.ndarray) -> None:
        codes = (self.queries[q] @ self.rows[r].T) * self.scale - r
        codes[self.own[q][:, None] == self.ids[r]] = -np.inf
        codes = np.concatenate((self.codes[q], codes), axis=1)
        self.codes[q] = codes = -np.partition(-codes, self.k - 1, axis=1)[:, : self.k]
        self.worst[q] = np.ceil(codes.min(axis=1) / self.scale)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of all entries."""
        at, _ = np.nonzero(np.isfinite(self.codes))
        codes = self.codes[np.isfinite(self.codes)]
        scores = np.ceil(codes / self.scale)
        return at, (scores * self.scale - codes).astype(np.int64), scores.astype(np.int64)


class _WideSearch(_Search):
    """The same for numbers whose codes doubles cannot hold: scores and places are kept apart."""

    def __init__(self, *args):
        super().__init__(*args)
        self.scores = np.full(self.codes.shape, np.iinfo(np.int64).min)
        self.places = np.full(self.codes.shape, -1)

    def meet(self, q: np.ndarray, r: np.ndarray) -> None:
        scores = self.queries[q] @ self.rows[r].T
        places = np.broadcast_to(r, scores.shape)
        places = np.where(self.own[q][:, None] == self.ids[r], -1, places)
        scores, places = np.concatenate((self.scores[q], scores), axis=1), np.concatenate((self.places[q], places), axis=1)
        order = np.lexsort((places, ~scores, places < 0))[:, : self.k]
        self.scores[q], self.places[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
        self.worst[q] = np.where(self.places[q][:, -1] < 0, -np.inf, self.scores[q][:, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, _ = np.nonzero(self.places >= 0)
        return at, self.places[self.places >= 0], self.scores[self.places >= 0]


def search_cell(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the ``k`` best of every query among the rows of a cell, by whole-number vectors."""
    order = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) * max(1, len(rows))
    kind, search = (np.float64, _Search) if most < 2**52 else (np.int64, _WideSearch)
    cell = search(queries.astype(kind), rows.astype(kind), query_ids, row_ids, k)
    cell.visit(cover_tree(queries.astype(np.float64)), cover_tree(rows.astype(np.float64)))
    at, place, scores = cell.found()
    return query_ids[at], row_ids[place], scores


def top_products(
    table: DataFrame, *, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` largest inner products of floor(scale * vector) for every query."""
    valid = valid_vectors(table, id_col, vector_col)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = materialise(valid.select("vec_id", whole.alias("v"), F.size("v").alias("dim")), "tree-rows")
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    row_parts, query_parts = -(-max(1, rows.count()) // ROW_BLOCK), -(-max(1, queries.count()) // QUERY_BLOCK)
    row_cells = rows.withColumn("r", spread(F.col("vec_id"), row_parts)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    query_cells = queries.withColumn("q", spread(F.col("vec_id"), query_parts)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if len(left) and len(right):
            ids = [np.asarray(t["vec_id"]) for t in (left, right)]
            found = search_cell(ids[0], matrix(left["v"], np.int64), ids[1], matrix(right["v"], np.int64), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = query_cells.groupBy("q", "r", "dim").cogroup(row_cells.groupBy("q", "r", "dim")).applyInArrow(cell, FOUND.format(kind="long"))
    return best_of(found, k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
