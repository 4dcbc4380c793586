"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 512


def whole_text(column: str | Column) -> Column:
    """The text, empty where it is null."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_rows(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Iterable]], schema: str, rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows_at_once`` rows, given and returned as lists by column.

    Slices bound what Python holds at a time; Spark partitions the rows and restarts lost tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def bounded_sample(ids: DataFrame, by: Column, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hash: the same rows on every run and for any partitioning."""
    return ids.orderBy(by, *[F.col(f"`{c}`") for c in ids.columns]).limit(limit)


def known_labels(labels: DataFrame, column: str, train: Column) -> DataFrame:
    """(doc_id, label) of every id labelled 0 or 1 for which ``train`` holds; of several labels the largest."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & train)
    return known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label, weight) of a bounded training sample, at most ``per_class`` documents of each label.

    The sample holds the smallest hashes of doc_id among the labelled rows for which ``train`` holds, so it is the same on
    every run.  ``weight`` is how many labelled rows of its class a row stands for.  At most 2 * per_class ids are broadcast.
    """
    known = known_labels(labels, column, train)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    chosen = [
        bounded_sample(known.filter(F.col("label") == v), F.xxhash64("doc_id"), per_class).withColumn(
            "weight", F.lit(sizes.get(v, 0) / max(1, min(per_class, sizes.get(v, 0))))
        )
        for v in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return texts.join(ids, "doc_id").select("doc_id", "text", "label", "weight")


def training_row(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has that remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


FOUND = "doc_id long, found array<struct<kind string, start int, stop int, base boolean>>"


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of (doc_id, found): counts and checksum of the base spans, by ``kinds``, and all spans as text."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of(kind: str):
        return F.filter("found", lambda s: s["base"] & (s["kind"] == kind))

    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
