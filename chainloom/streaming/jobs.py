"""Streaming jobs: each runs the batch operator of the same name on what has arrived.

Batches are written under their own id and overwritten on a replay, so running a batch twice
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from chainloom.functions.text import tokens
from chainloom.operators.codecheck import check_code
from chainloom.operators.condense import apply_to_blocks, build_condense_plan, live_calls, modes_of, open_calls, pair_calls, waiting_blocks
from chainloom.operators.storage import materialise
from chainloom.operators.symbols import build_registry, extract_symbols

STATE_SCHEMA = "uuid string, block_idx int, mode string, original_bytes bigint, condensed_bytes bigint, summary_source string"


def token_meter(messages: DataFrame) -> DataFrame:
    """Running totals per conversation; the state is one small row per conversation."""
    return messages.groupBy("conv").agg(F.count(F.lit(1)).alias("messages"), F.sum(tokens(F.col("text"))).alias("tokens"))


def stream_token_meter(messages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Send the changed totals of each micro-batch to ``sink(totals, batch_id)``."""
    writer = token_meter(messages).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def stream_code_check(
    edits: DataFrame, registry: DataFrame, routes: DataFrame, known_files: DataFrame, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Check every new edit; warnings land in ``out`` by batch."""

    def check(batch: DataFrame, batch_id: int) -> None:
        found = check_code(batch, registry, routes, known_files).withColumn("batch", F.lit(batch_id).cast("bigint"))
        found.drop("batch").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return edits.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(check).start()


BUCKETS = 64


def bucket_of(conv: str = "conv") -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(BUCKETS)).cast("int")


class CondenseStore:
    """Folders of the incremental condensation: arrived blocks, replacements, state, and what later blocks can still change.

    A batch never reads an old block.  What it needs of them is kept by hash bucket of the conversation, one version per batch:
    narrow rows of the calls that can still supersede or be superseded (``calls``), calls whose result may still come
    (``open``) and blocks of recent turns that a mode may take later (``waiting``).  A batch reads the versions before it of
    the buckets it touches and writes new ones, so running it again changes nothing; older versions are removed.

    Blocks of a conversation arrive in order of their position.  A block is condensed once, by the first batch after which a
    mode applies.
    """

    LIVE = ("calls", "open", "waiting")

    def __init__(self, spark: SparkSession, root: str, block_schema, conv_type: str = "bigint"):
        self.spark, self.root = spark, root
        self.block_schema = block_schema
        self.state_schema = StructType.fromDDL(f"conv {conv_type}, {STATE_SCHEMA}")
        empty = spark.createDataFrame([], block_schema)
        self.live_schemas = {"calls": pair_calls(empty).schema, "open": block_schema, "waiting": block_schema}

    def _put(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows = rows.withColumn("bucket", bucket_of()).hint("rebalance", "bucket")  # one file a bucket, more for a large one
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _table(self, name: str, schema: StructType, buckets: list[int] | None) -> DataFrame:
        """All batches of a table, of the given buckets only; one that has not been written yet is empty."""
        full = StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.root}/{name}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], full)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def blocks(self) -> DataFrame:
        return self._table("blocks", self.block_schema, None).drop("batch", "bucket")

    def state(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Latest record of every block, optionally as it was before a batch."""
        rows = self._table("state", self.state_schema, buckets)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        cols = ("mode", "original_bytes", "condensed_bytes", "summary_source")
        return (
            rows.groupBy("conv", "uuid", "block_idx")
            .agg(F.max_by(F.struct(*cols), "batch").alias("s"))
            .select("conv", "uuid", "block_idx", "s.*")
        )

    def replacements(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/replacements")

    def _versions(self, before: int, buckets: list[int]) -> dict[int, int]:
        """The newest version of each bucket that an earlier batch wrote: at most BUCKETS rows."""
        rows = self._table("versions", StructType([]), buckets).filter(F.col("batch") < before)
        return {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def live(self, name: str, versions: dict[int, int]) -> DataFrame:
        rows = self._table(name, self.live_schemas[name], None)
        wanted = [f"{bucket}-{batch}" for bucket, batch in versions.items()]
        return rows.filter(F.concat_ws("-", "bucket", "batch").isin(wanted)).drop("batch", "bucket")

    def _forget(self, versions: dict[int, int]) -> None:
        """Remove what is older than the versions just read."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self.LIVE:
            glob = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch=*/bucket=*")
            fs = glob.getFileSystem(conf)
            for status in fs.globStatus(glob) or []:
                batch, bucket = (int(part.split("=")[1]) for part in status.getPath().toString().split("/")[-2:])
                if batch < versions.get(bucket, 0):
                    fs.delete(status.getPath(), True)

    def process(self, batch: DataFrame, batch_id: int, **options) -> None:
        """Add a batch of blocks and condense the conversations it touches."""
        self._put(batch, "blocks", batch_id)
        arrived = self._table("blocks", self.block_schema, None).filter(F.col("batch") == batch_id).drop("batch", "bucket")
        buckets = [r["b"] for r in arrived.select(bucket_of().alias("b")).distinct().collect()]  # at most BUCKETS numbers
        versions = self._versions(batch_id, buckets)
        old = {name: self.live(name, versions) for name in self.LIVE}
        newest = [F.max("total_turns").alias("newest")] if "total_turns" in arrived.columns else []
        touched = materialise(arrived.groupBy("conv").agg(F.max("pos").alias("last_pos"), *newest), "touched")

        def now(rows: DataFrame) -> DataFrame:
            """Rows of the touched conversations, with their present number of turns."""
            joined = rows.join(touched, "conv")
            if newest:
                joined = joined.withColumn("total_turns", F.greatest("total_turns", "newest").cast(rows.schema["total_turns"].dataType))
            return joined.select(*rows.columns)

        calling = materialise(now(old["open"]).unionByName(now(arrived)), "calling")
        calls = materialise(now(old["calls"]).unionByName(pair_calls(calling)), "calls")
        blocks = materialise(now(old["waiting"]).unionByName(now(arrived)), "waiting")
        known = materialise(self.state(batch_id, buckets), "known")
        replace, _, records = build_condense_plan(modes_of(calls, blocks, **options), known)
        replace.write.mode("overwrite").parquet(f"{self.root}/replacements/b{batch_id}")
        done = self.spark.read.schema(replace.schema).parquet(f"{self.root}/replacements/b{batch_id}")
        self._put(done.select(*records.columns), "state", batch_id)

        condensed = known.select("conv", "uuid", "block_idx").unionByName(done.select("conv", "uuid", "block_idx"))
        left = {
            "calls": live_calls(calls, condensed),
            "open": open_calls(calling, calls, touched.select("conv", "last_pos")),
            "waiting": waiting_blocks(blocks, condensed, options.get("keep_recent")),
        }
        for name, rows in left.items():
            others = old[name].join(touched.select("conv"), "conv", "left_anti")
            self._put(rows.select(*others.columns).unionByName(others), name, batch_id)
        numbers = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        numbers.withColumn("v", F.lit(1)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/versions/batch={batch_id}")
        self._forget(versions)

    def condensed(self) -> DataFrame:
        """All blocks with every replacement so far applied."""
        return apply_to_blocks(self.blocks(), self.replacements())


def stream_condense(blocks: DataFrame, store: CondenseStore, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Condense as blocks arrive; blocks already in the state are not touched again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store.process(batch, batch_id, **options)

    return blocks.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(step).start()


def stream_reindex(commits: DataFrame, lines_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Refresh the registry of every project with a commit.

    ``lines_of(projects)`` gives the current source lines of the projects; only their
    partitions of the registry table are replaced.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        projects = batch.select("project").distinct()
        fresh = build_registry(extract_symbols(lines_of(projects)))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(out)

    return commits.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(refresh).start()
