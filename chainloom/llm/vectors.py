"""What the two vector searches share: valid vectors, cells of bounded size, and the merge of their best lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score {kind}"


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows with an id and a vector of finite numbers, as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Equally long lists as a matrix."""
    rows = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([])
    return np.asarray(flat).astype(kind, copy=False).reshape(rows, -1)


def spread(column: Column, parts: int) -> Column:
    """An even share of the rows, the same on every run."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best, from lists of at most ``k`` per cell."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
