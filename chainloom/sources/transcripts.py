"""JSONL transcripts in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions import content as ct
from chainloom.functions.text import BLANK
from chainloom.operators.rewrite import latest_version
from chainloom.operators.storage import few_listing_tasks, materialise


def read_lines(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """(conv, line, raw, path, mtime): every non-blank line with its ordinal in the conversation.

    ``conv`` is the file name, or the ``conv=`` folder name when the transcript was written in
    parts.  Of several copies of a conversation one is read: the one in the folder ``project``,
    else the newest.  Files are split as usual; the ordinal is the place inside the split plus the
    rows of the splits before it, so no file has to fit into one task.  Transcripts are many small files: they are opened
    once, and what follows reads the lines from a table.
    """
    at = "_metadata.file_path"
    folder = F.regexp_extract(at, r"/conv=([^/]+)/[^/]*$", 1)
    with few_listing_tasks(spark):
        files = spark.read.option("recursiveFileLookup", "true").text(path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = (
        files.filter(~F.col("value").rlike(rf"^{BLANK}*$"))
        .select(
            F.when(F.length(folder) > 0, folder).otherwise(F.regexp_extract(at, r"([^/]+?)(\.[^./]*)?$", 1)).alias("conv"),
            F.col("value").alias("raw"),
            F.col(at).alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            F.monotonically_increasing_id().alias("seq"),
        )
    )
    lines = materialise(lines.coalesce(tasks), "transcript-lines")  # small files would make a task of every 32
    split = ["conv", "path", "start"]
    # A copy is a file, or a folder of part files; the choice needs one row for each file.
    whole = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*/conv=[^/]+)/[^/]*$", 1), F.lit("")), F.col("path"))
    copies = lines.groupBy("conv", whole.alias("path")).agg(F.max("mtime").alias("mtime"))
    copies = copies.withColumn("project", F.element_at(F.split("path", "/"), -2))
    chosen = latest_version(copies, project).select(F.col("conv").alias("_conv"), F.col("path").alias("_whole"))
    lines = lines.join(chosen, (F.col("conv") == F.col("_conv")) & (whole == F.col("_whole"))).drop("_conv", "_whole")
    before = W.partitionBy("conv").orderBy("path", "start").rowsBetween(W.unboundedPreceding, -1)
    offsets = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("n")).select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = F.row_number().over(W.partitionBy(*split).orderBy("seq"))
    return lines.withColumn("here", here).join(offsets, split).select(
        "conv", (F.col("offset") + F.col("here") - 1).cast("bigint").alias("line"), "raw", "path", "mtime"
    )


def normalise(lines: DataFrame) -> DataFrame:
    """Message columns and the ``blocks`` array out of ``raw``; unreadable lines are flagged, not dropped."""
    parsed = lines.withColumn("e", F.from_json("raw", ct.ENTRY_SCHEMA)).withColumns(
        {"blocks": ct.content_blocks(F.col("raw")), "is_corrupt": F.try_parse_json("raw").isNull()}
    )
    content, blocks, kind, role = F.col("e.message.content"), F.col("blocks"), F.col("e.type"), F.col("e.message.role")
    stamp = F.try_to_timestamp(F.col("e.timestamp"))
    return parsed.select(
        *lines.columns,
        "is_corrupt",
        F.col("e.uuid").alias("uuid"),
        F.col("e.parentUuid").alias("parent_uuid"),
        kind.alias("type"),
        F.when(F.length(role) > 0, role).otherwise(kind).alias("role"),
        stamp.alias("ts"),
        (F.col("e.timestamp").isNotNull() & stamp.isNull()).alias("bad_ts"),
        F.col("e.cwd").alias("cwd"),
        F.col("e.sessionId").alias("session_id"),
        F.col("e.gitBranch").alias("git_branch"),
        F.col("e.version").alias("version"),
        F.col("e.messageId").alias("message_id"),
        F.col("e.logicalParentUuid").alias("logical_parent_uuid"),
        F.coalesce(
            (F.col("e.subtype") == "compact_boundary") | ((kind == "system") & (F.col("e.content") == "Conversation compacted")), F.lit(False)
        ).alias("is_boundary"),
        F.coalesce("e.isCompactSummary", F.lit(False)).alias("is_summary"),
        F.when(blocks.isNotNull(), "array").when(content.isNotNull(), "string").alias("shape"),
        F.col("e.content").alias("top_content"),
        ct.message_text(content, blocks).alias("text"),
        ct.typed_text(content, blocks).alias("typed_text"),
        ct.opens_turn(kind, content, blocks).alias("opens_turn"),
        ct.real_user(kind, role, content, blocks).alias("real_user"),
        ct.plain_chars(content, blocks).alias("plain_chars"),
        F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "tool_use")), F.lit(0)).cast("bigint").alias("n_tool_use"),
        "blocks",
    )


def read_transcripts(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    return normalise(read_lines(spark, path, project))


def read_transcript_keys(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Only the tree columns, one streaming pass per line; snapshot lines without uuid are skipped."""
    lines = read_lines(spark, path, project)
    keys = lines.select(
        "conv", "line", F.json_tuple("raw", "uuid", "parentUuid", "type", "timestamp").alias("uuid", "parent_uuid", "type", "timestamp")
    )
    stamp = F.try_to_timestamp(F.col("timestamp"))
    return keys.filter(F.col("uuid").isNotNull() | ~F.col("type").eqNullSafe("file-history-snapshot")).select(
        "conv", "line", "uuid", "parent_uuid", "type", stamp.alias("ts"), (F.col("timestamp").isNotNull() & stamp.isNull()).alias("bad_ts")
    )


def explode_blocks(messages: DataFrame) -> DataFrame:
    """One row per content block with the position columns of its message."""
    at = [c for c in ("conv", "line", "pos", "turn_id", "total_turns", "uuid", "role") if c in messages.columns]
    return messages.select(*at, F.explode("blocks").alias("b")).select(*at, "b.*")


def write_transcripts(messages: DataFrame, path: str) -> None:
    """``raw`` lines in order, one folder per conversation; a row without its line stops the job.

    Rows are range-partitioned on (conv, line): a very long conversation becomes several
    ordered part files instead of one task.  The number of ranges is given: the time goes with the
    files, and by their bytes a few tasks would get them all.
    """
    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        messages.select("conv", "line", F.coalesce("raw", F.raise_error(F.lit("a message has no line text in raw"))).alias("value"))
        .repartitionByRange(tasks, "conv", "line")
        .sortWithinPartitions("conv", "line")
        .select("value", "conv")
        .write.partitionBy("conv")
        .text(path)
    )
