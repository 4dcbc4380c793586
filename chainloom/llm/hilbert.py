"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are lengthened by one component so that all have the largest norm; the nearest by inner product is then the nearest
by angle.  Each of CURVES orderings projects them onto a few random directions, shifts the projected cube and takes the
Hilbert index as key.  Quantiles of the keys range-partition every curve into windows of equal shares; a query meets the
rows of its own window and of ``reach`` windows on either side, in blocks of bounded size, and the best of all curves are
merged and ranked by the inner product of the original vectors in double precision.

How much of a curve a query has to meet depends on the data.  Vectors without any structure (independent directions in 64
dimensions) have no near neighbours to speak of, and no index reaches a recall of 0.9 on them without meeting most rows; the
defaults are set for that worst case.  For clustered data raise ``windows``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id; vectors of different length are not compared; a row is not a candidate of a query with its own id; ties go to the
smaller id; repeated query rows count once, repeated candidates each once per curve and at most once in a result; fewer than
``k`` candidates give all of them (a small table is one window); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows
from chainloom.llm.vectors import FOUND, best_of, matrix, valid_vectors
from chainloom.operators.storage import materialise

CURVES, WINDOWS, REACH = 10, 20, 1
DIRECTIONS, BITS = 4, 8
LEAST_ROWS = 64  # of a window: smaller tables have fewer windows, the smallest one
BLOCK = 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of whole-number coordinates (points, axes), each below 2 ** bits."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        half, low = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            upper = (axis & half) != 0
            swap = np.where(upper, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    index = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ turn) >> level) & 1)
    return index


def curve_keys(vectors: np.ndarray, longest: float, curves: int, seed: int) -> np.ndarray:
    """Keys (vector, curve) of vectors lengthened to norm ``longest``."""
    extra = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
    full = np.concatenate((vectors, extra[:, None]), axis=1) / longest
    size = full.shape[1]
    out = np.empty((len(full), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, size, c])
        directions = np.linalg.qr(rng.normal(size=(size, min(DIRECTIONS, size))))[0]
        place = 1 / (1 + np.exp(-1.702 * np.sqrt(size) * (full @ directions)))  # even over 0..1 for spread-out directions
        shifted = (place + rng.random(place.shape[1])) / 2
        out[:, c] = hilbert_index(np.minimum((shifted * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return out


def search_cell(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the ``k`` best of every query among the rows of a cell; each id once."""
    row_ids, first = np.unique(row_ids, return_index=True)
    rows, out = rows[first], []
    for s in range(0, len(queries), 256):
        scores = queries[s : s + 256] @ rows.T
        scores[query_ids[s : s + 256, None] == row_ids] = -np.inf
        for i, line in enumerate(scores, start=s):
            kth = np.partition(line, -k)[-k] if len(line) > k else -np.inf
            at = np.flatnonzero(line >= kth - 1e-9 * (1 + abs(kth))) if np.isfinite(kth) else np.flatnonzero(np.isfinite(line))
            exact = (queries[i] * rows[at]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            best = np.lexsort((row_ids[at], -exact))[:k]
            out.append((np.full(len(best), query_ids[i]), row_ids[at[best]], exact[best]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))


def nearest(
    table: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    curves: int = CURVES,
    windows: int = WINDOWS,
    reach: int = REACH,
    seed: int = 17,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest found of every query."""
    valid = valid_vectors(table, id_col, vector_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = valid.withColumn("norm", norm).filter("norm > 0").withColumn("dim", F.size("v"))
    longest, count = rows.agg(F.max("norm"), F.count(F.lit(1))).first()
    longest, windows = longest or 1.0, max(1, min(windows, count // LEAST_ROWS))

    def keyed(cols: dict[str, list]) -> dict[str, list]:
        keys: list = [None] * len(cols["vec_id"])
        for dim in set(cols["dim"]):  # almost always one
            at = [i for i, d in enumerate(cols["dim"]) if d == dim]
            for i, line in zip(at, curve_keys(np.array([cols["v"][i] for i in at]), longest, curves, seed), strict=True):
                keys[i] = line
        return {"vec_id": cols["vec_id"], "v": cols["v"], "dim": cols["dim"], "keys": keys}

    schema = "vec_id long, v array<double>, dim int, keys array<long>"
    rows = materialise(map_rows(rows.select("vec_id", "v", "dim"), keyed, schema), "curve-rows")
    placed = rows.select("vec_id", "v", "dim", F.posexplode("keys").alias("curve", "key"))
    shares = [i / windows for i in range(1, windows)]
    quantiles = F.percentile_approx("key", shares, 2000) if shares else F.lit([]).cast("array<long>")
    cuts = placed.groupBy("dim", "curve").agg(quantiles.alias("cuts"))
    placed = placed.join(F.broadcast(cuts), ["dim", "curve"])  # one row for each curve and vector length
    window = F.size(F.filter("cuts", lambda c: c < F.col("key")))
    placed = materialise(placed.select("vec_id", "v", "dim", "curve", window.alias("window")), "curve-windows")
    sizes = placed.groupBy("dim", "curve", "window").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(materialise(sizes, "curve-sizes"))  # at most ``windows`` rows for each curve and vector length
    row_cells = placed.join(sizes, ["dim", "curve", "window"])
    row_cells = row_cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    queries = placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "curve"])
    near = F.sequence(F.greatest(F.col("window") - reach, F.lit(0)), F.col("window") + reach)
    query_cells = queries.withColumn("window", F.explode(near)).join(sizes, ["dim", "curve", "window"])
    query_cells = query_cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(left) and len(right):
            ids = [np.asarray(t["vec_id"]) for t in (left, right)]
            found = search_cell(ids[0], matrix(left["v"], np.float64), ids[1], matrix(right["v"], np.float64), k)
        return pa.table({n: c.astype(t) for n, c, t in zip(("query_id", "vec_id", "score"), found, (np.int64, np.int64, np.float64), strict=True)})

    key = ["dim", "curve", "window", "block"]
    columns = ["vec_id", "v", *key]
    asked = query_cells.select(columns).toDF(*columns)  # own columns: both sides come from one table
    found = asked.groupBy(*key).cogroup(row_cells.select(columns).groupBy(*key)).applyInArrow(cell, FOUND.format(kind="double"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best_of(once, k)
