"""Cutting and re-linking chains.

Every operator takes ``messages`` and ``rows`` (chain rows with conv, pos, line, uuid, type, ts,
text) and returns the rewritten messages with a report of one row per conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions import content as ct
from chainloom.functions.text import tokens
from chainloom.operators.chain import ROOT_TYPES, next_valid_root, walk_chain
from chainloom.operators.rewrite import append_messages, rewrite
from chainloom.operators.scan import attach, scan
from chainloom.operators.storage import materialise
from chainloom.operators.turns import SEGMENT_SIZE, summarize_segments

DEFAULT_MARKER = "## SESSION HANDOFF"
MERGE_WINDOW = 10
SNIPPET_CHARS = 400
SUMMARY_OPENING = "This session is being continued"


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv").agg(F.max("pos").alias("n"))


def _root_type() -> Column:
    return F.col("type").isin(*ROOT_TYPES)


def _with_spans(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Chain rows (narrow) with the per-conversation plan columns; ``n`` bounds the ordinal."""
    return attach(rows.select("conv", "pos", "uuid", tokens(F.col("text")).alias("tok")), plan, ["conv"], "pos", span="n")


def _cut(messages: DataFrame, rows: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-root every conversation at its first valid root at or after ``cut`` (null: leave alone).

    The report counts the rows before the cut and before the root that was found.
    """
    roots = next_valid_root(rows, cuts.filter(F.col("cut").isNotNull())).select(
        "conv", "root_pos", F.col("uuid").alias("root_uuid"), F.col("type").alias("root_type")
    )
    # One narrow row per conversation, used by the report and by the rewrite: written once.
    plan = materialise(cuts.join(roots, "conv", "left"), "cut-plan")
    freed = (
        _with_spans(rows, plan.select("conv", "cut", "n"))
        .groupBy("conv")
        .agg(F.coalesce(F.sum(F.when(F.col("pos") < F.col("cut"), F.col("tok"))), F.lit(0)).alias("tokens_freed"))
    )
    report = plan.join(freed, "conv", "left").select(
        "conv",
        F.col("n").alias("chain_length"),
        F.when(F.col("cut").isNull(), F.col("why")).when(F.col("root_pos").isNull(), F.lit("no_valid_root")).otherwise(F.lit("pruned")).alias("verdict"),
        (F.col("cut") - 1).cast("bigint").alias("orphaned_before"),
        F.col("tokens_freed"),
        F.col("root_pos"),
        F.col("root_type"),
        (F.col("root_pos") - 1).cast("bigint").alias("orphaned_after"),
    )
    new_roots = plan.filter("root_uuid IS NOT NULL").select("conv", F.col("root_uuid").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"))
    return rewrite(messages, replace=new_roots)[0], report


def percent_cut(rows: DataFrame, percent: float) -> DataFrame:
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 0 and 100")
    target = F.greatest(F.floor(F.col("n") * F.lit(percent / 100)), F.lit(1))
    return _lengths(rows).select("conv", "n", (F.least(target, F.col("n") - 1) + 1).cast("bigint").alias("cut"), F.lit(None).cast("string").alias("why"))


def prune_oldest_percent(messages: DataFrame, rows: DataFrame, percent: float) -> tuple[DataFrame, DataFrame]:
    return _cut(messages, rows, percent_cut(rows, percent))


def prune_before_message(messages: DataFrame, rows: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    inside = (F.lit(number) >= 1) & (F.lit(number) <= F.col("n"))
    cuts = _lengths(rows).select("conv", "n", F.when(inside, F.lit(number)).cast("bigint").alias("cut"), F.lit("out_of_range").alias("why"))
    return _cut(messages, rows, cuts)


def prune_after_phrase(messages: DataFrame, rows: DataFrame, phrase: str) -> tuple[DataFrame, DataFrame]:
    if not phrase:
        raise ValueError("phrase is required")
    hit = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(phrase.lower()))
    cuts = rows.groupBy("conv").agg(F.max("pos").alias("n"), F.min(F.when(hit, F.col("pos"))).alias("cut"))
    return _cut(messages, rows, cuts.withColumn("why", F.lit("phrase_not_found")))


def prune_digest(rows: DataFrame, blocks: DataFrame, cuts: DataFrame, size: int = SEGMENT_SIZE) -> DataFrame:
    """Segment digest of what lies before ``cuts(conv, cut, n)``; needs role and real_user."""
    part = attach(rows, cuts.select("conv", "cut", "n"), ["conv"], "pos", span="n").filter(F.col("pos") < F.col("cut"))
    part = part.drop("cut", "n")
    gone = blocks.join(part.select("conv", "pos"), ["conv", "pos"], "left_semi")
    return summarize_segments(part, gone, size)


def bridge_uuid(*parts: Column) -> Column:
    """Repeatable id of a row the engine adds: the first 32 hex digits of a hash, uuid-shaped."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def sandwich_prune(
    messages: DataFrame,
    rows: DataFrame,
    keep_first: int = 5,
    keep_recent: int = 50,
    *,
    bridge: bool = True,
    remove_middle: bool = True,
    bridge_message: str | None = None,
    backup_file: Column | None = None,
    backup_folder: str | None = None,
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, backup, report): keep the ends of each chain and take the middle out.

    ``backup_file`` (of conv) and ``backup_folder`` say where the caller stores the backup; the bridge names both.
    """
    if keep_first < 1 or keep_recent < 1:
        raise ValueError("keep_first and keep_recent must each be at least 1")
    sizes = _lengths(rows)
    long = sizes.filter(F.col("n") > keep_first + keep_recent)
    border = next_valid_root(rows, long.select("conv", (F.col("n") - keep_recent + 1).alias("cut"))).select(
        "conv", F.col("root_pos").alias("recent_pos"), F.col("uuid").alias("recent_uuid")
    )
    early = rows.filter(F.col("pos") == keep_first).select("conv", F.col("uuid").alias("early_uuid"))
    plan = sizes.join(border, "conv", "left").join(early, "conv", "left").withColumn(
        "verdict",
        F.when(F.col("n") <= keep_first + keep_recent, "too_short")
        .when(F.col("recent_pos").isNull(), "no_valid_root")
        .when(F.col("recent_pos") <= keep_first + 1, "nothing_between")
        .otherwise("pruned"),
    )
    plan = materialise(plan, "sandwich-plan")
    go = plan.filter("verdict = 'pruned'")
    inside = attach(
        rows.select("conv", "pos", "line", "uuid", "ts", tokens(F.col("text")).alias("tok")),
        go.select("conv", "recent_pos", "n"), ["conv"], "pos", span="n",
    ).filter((F.col("pos") > keep_first) & (F.col("pos") < F.col("recent_pos")))
    backup = messages.join(inside.select("conv", "line", "pos"), ["conv", "line"])
    middle = inside.groupBy("conv").agg(
        F.count(F.lit(1)).alias("middle_count"),
        F.sum("tok").alias("tokens_freed"),
        F.min_by("ts", "pos").alias("middle_from"),
        F.max_by("ts", "pos").alias("middle_to"),
    )
    new_id = bridge_uuid(F.col("conv").cast("string"), F.col("early_uuid"), F.col("recent_uuid"))
    linked = go.join(middle, "conv").withColumn("bridge_uuid", new_id if bridge else F.lit(None).cast("string"))
    relink = linked.select(
        "conv", F.col("recent_uuid").alias("uuid"), F.coalesce("bridge_uuid", "early_uuid").alias("parent_uuid")
    )
    text = F.lit(bridge_message) if bridge_message else F.concat(
        F.lit("[Pruned segment: "), F.col("middle_count").cast("string"), F.lit(" messages, "),
        F.coalesce(F.col("middle_from").cast("string"), F.lit("?")), F.lit(" → "),
        F.coalesce(F.col("middle_to").cast("string"), F.lit("?")),
        *([F.lit(". Backup file: "), backup_file, F.lit(f". Located at: {backup_folder} (path may have moved).]")] if backup_file is not None else [F.lit(".]")]),
    )
    added = None
    if bridge:
        ends = messages.groupBy("conv").agg(F.max("line").alias("last_line"), F.max("ts").alias("last_ts"))
        copied = [c for c in ("cwd", "session_id", "git_branch", "version") if c in messages.columns]
        early_row = messages.select("conv", F.col("uuid").alias("early_uuid"), *copied)
        kind = messages.schema["ts"].dataType.simpleString()
        span = ct.json_object(
            {
                "firstChainIdx": F.lit(str(keep_first + 1)), "lastChainIdx": (F.col("recent_pos") - 1).cast("string"), "count": F.col("middle_count").cast("string"),
                "firstTimestamp": ct.json_time(F.col("middle_from"), kind), "lastTimestamp": ct.json_time(F.col("middle_to"), kind),
            }
        )
        marks = {"_sandwichPruneBridge": F.lit("true"), "_orphanedRange": span}
        if backup_file is not None:
            marks |= {"_backupFile": ct.quoted(backup_file), "_backupPath": ct.quoted(F.concat(F.lit(f"{backup_folder}/"), backup_file))}
        fields = F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), v)])
        added = linked.join(ends, "conv").join(early_row, ["conv", "early_uuid"]).select(
            "conv",
            (F.col("last_line") + 1).alias("line"),
            F.col("bridge_uuid").alias("uuid"),
            F.col("early_uuid").alias("parent_uuid"),
            F.lit("system").alias("type"),
            (now if now is not None else F.col("last_ts")).alias("ts"),
            text.alias("text"),
            *copied,
            *([fields.alias("fields")] if "raw" in messages.columns else []),
        )
    drop = inside.select("conv", "uuid") if remove_middle else None
    out, _ = rewrite(messages, drop=drop, replace=relink, append=added)
    report = plan.join(middle, "conv", "left").select(
        "conv",
        F.col("n").alias("chain_length"),
        "verdict",
        F.coalesce("middle_count", F.lit(0)).cast("bigint").alias("middle_count"),
        F.coalesce("tokens_freed", F.lit(0)).cast("bigint").alias("tokens_freed"),
        F.when(F.col("verdict") == "pruned", F.col("n") - F.col("middle_count") + (1 if bridge else 0))
        .otherwise(F.col("n"))
        .cast("bigint")
        .alias("new_chain_length"),
    )
    return out, backup, report


def prune_to_handoff(
    messages: DataFrame,
    rows: DataFrame,
    marker: str = DEFAULT_MARKER,
    *,
    merge: bool = True,
    window: int = MERGE_WINDOW,
    extra: int = 0,
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Re-root at the user or system row before the newest hand-off written by the assistant.

    Older marker rows within ``window`` rows of a newer one belong to the same hand-off.
    """
    marker = marker.strip()
    if not marker:
        raise ValueError("marker cannot be empty")
    rule = rf"(^|\n){re.escape(marker)}(\s|\z)"
    text = F.coalesce("text", F.lit(""))
    # The plain substring test first: it is cheap and removes nearly every row.
    marked = rows.filter((F.col("type") == "assistant") & F.contains(text, F.lit(marker)) & text.rlike(rule)).select("conv", "pos")
    gaps = scan(marked, ["conv"], "pos", prevs={"before": F.col("pos")})
    opens = F.col("before").isNull() | (F.col("pos") - F.col("before") > window)
    newest = F.max("pos").alias("newest_pos")
    oldest = (F.max(F.when(opens, F.col("pos"))) if merge else F.max("pos")).alias("oldest_pos")
    group = gaps.groupBy("conv").agg(newest, oldest)
    counted = (
        attach(marked, group, ["conv"], "pos", span="newest_pos")
        .filter(F.col("pos") >= F.col("oldest_pos"))
        .groupBy("conv", "newest_pos", "oldest_pos")
        .agg(F.count(F.lit(1)).alias("markers"))
    )
    rooted = rows.filter(_root_type()).select("conv", "pos", "uuid")
    anchors = (
        attach(rooted, counted.select("conv", "oldest_pos"), ["conv"], "pos")
        .groupBy("conv")
        .agg(F.max(F.when(F.col("pos") <= F.col("oldest_pos"), F.struct("pos", "uuid"))).alias("primary"))
    )
    if extra > 0:
        wider = anchors.filter("primary IS NOT NULL").select("conv", F.greatest(F.col("primary.pos") - extra, F.lit(1)).alias("limit"))
        buffered = (
            attach(rooted, wider, ["conv"], "pos")
            .groupBy("conv")
            .agg(F.max(F.when(F.col("pos") <= F.col("limit"), F.struct("pos", "uuid"))).alias("buffered"))
        )
        anchors = anchors.join(buffered, "conv", "left").withColumn("anchor", F.coalesce("buffered", "primary"))
    else:
        anchors = anchors.withColumn("anchor", F.col("primary"))
    lengths = _lengths(rows)
    plan = materialise(lengths.join(counted, "conv", "left").join(anchors, "conv", "left"), "handoff-plan")
    freed = (
        _with_spans(rows, plan.filter("anchor IS NOT NULL").select("conv", "n", F.col("anchor.pos").alias("anchor_pos")))
        .groupBy("conv")
        .agg(F.coalesce(F.sum(F.when(F.col("pos") < F.col("anchor_pos"), F.col("tok"))), F.lit(0)).alias("tokens_freed"))
    )
    at = F.regexp_instr("text", F.lit(rule))
    begins = at + F.when(F.substr("text", at, F.lit(1)) == "\n", 1).otherwise(0)
    snippets = (
        rows.select("conv", "pos", "text")
        .join(plan.filter("oldest_pos IS NOT NULL").select("conv", F.col("oldest_pos").alias("pos")), ["conv", "pos"])
        .withColumn("rest", F.substr("text", begins))
        .select(
            "conv",
            F.concat(
                F.regexp_replace(F.left("rest", F.lit(SNIPPET_CHARS)), r"\s+\z", ""),
                F.when(F.length("rest") > SNIPPET_CHARS, F.lit("\n…(truncated)")).otherwise(F.lit("")),
            ).alias("snippet"),
        )
    )
    report = (
        plan.join(freed, "conv", "left")
        .join(snippets, "conv", "left")
        .select(
            "conv",
            F.col("n").alias("chain_length"),
            F.when(F.col("newest_pos").isNull(), "no_marker").when(F.col("anchor").isNull(), "no_anchor").otherwise("pruned").alias("verdict"),
            "newest_pos",
            "oldest_pos",
            "markers",
            F.col("anchor.pos").alias("anchor_pos"),
            (F.col("primary.pos") - F.col("anchor.pos")).alias("buffer_applied"),
            (F.col("anchor.pos") - 1).alias("orphaned"),
            (F.col("n") - F.col("anchor.pos") + 1).alias("kept"),
            "tokens_freed",
            "snippet",
        )
    )
    if dry_run:
        return messages, report
    roots = plan.filter("anchor IS NOT NULL").select("conv", F.col("anchor.uuid").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"))
    return rewrite(messages, replace=roots)[0], report


def restore_compaction(messages: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconnect the rows after the last compaction to the chain that was compacted away.

    ``rows`` also needs is_boundary, is_summary and logical_parent_uuid.
    """
    boundary = F.coalesce("is_boundary", F.lit(False))
    summary = F.coalesce("is_summary", F.lit(False)) | (
        (F.col("type") == "user") & F.startswith(F.coalesce("text", F.lit("")), F.lit(SUMMARY_OPENING))
    )
    found = rows.groupBy("conv").agg(
        F.max("pos").alias("n"),
        F.max(F.when(boundary, F.struct("pos", "uuid", "logical_parent_uuid"))).alias("b"),
        F.max(F.when(summary, F.col("pos"))).alias("s"),
    )
    found = found.select(
        "conv", "n", F.col("b.pos").alias("boundary_pos"), F.col("b.uuid").alias("boundary_uuid"),
        F.col("b.logical_parent_uuid").alias("link"), F.col("s").alias("summary_pos"),
        (F.coalesce("s", "b.pos") + 1).alias("next_pos"),
    )
    exists = messages.select("conv", F.col("uuid").alias("link"), F.lit(True).alias("known")).distinct()
    following = rows.select("conv", F.col("pos").alias("next_pos"), F.col("uuid").alias("next_uuid"))
    plan = found.join(exists, ["conv", "link"], "left").join(following, ["conv", "next_pos"], "left").withColumn(
        "verdict",
        F.when(F.col("next_pos").isNull(), "no_compaction")
        .when(F.col("link").isNull(), "no_logical_parent")
        .when(F.col("known").isNull(), "parent_missing")
        .when(F.col("next_uuid").isNull(), "nothing_after")
        .otherwise("restored"),
    )
    plan = materialise(plan, "restore-plan")
    go = plan.filter("verdict = 'restored'")
    old = walk_chain(messages, go.select("conv", F.col("link").alias("uuid")))
    back = (
        messages.join(old.select("conv", "line"), ["conv", "line"])
        .groupBy("conv")
        .agg(F.count(F.lit(1)).alias("restored"), F.sum(tokens(F.col("text"))).alias("restored_tokens"))
    )
    nothing = F.lit(None).cast("string")
    changed = go.select("conv", F.col("next_uuid").alias("uuid"), F.col("link").alias("parent_uuid")).unionByName(
        go.filter(F.col("boundary_uuid") != F.col("next_uuid")).select("conv", F.col("boundary_uuid").alias("uuid"), nothing.alias("parent_uuid"))
    )
    report = plan.join(back, "conv", "left").select(
        "conv", F.col("n").alias("chain_length"), "verdict", "boundary_pos", "summary_pos",
        F.coalesce("restored", F.lit(0)).cast("bigint").alias("restored"),
        F.coalesce("restored_tokens", F.lit(0)).cast("bigint").alias("restored_tokens"),
    )
    return rewrite(messages, replace=changed)[0], report


# What a new root carries when the conversation has no row to copy from.
ROOT_DEFAULTS = {"git_branch": "main", "version": "2.1.50"}


def inject_root(messages: DataFrame, rows: DataFrame, content: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, roots): append a snapshot row and a new root with ``content`` to each conversation.

    cwd, session_id, git_branch and version come from the first user row, else the first row.
    """
    copied = ["cwd", "session_id", "git_branch", "version"]
    order = F.struct(F.when(F.col("type") == "user", 0).otherwise(1), F.col("pos"))
    source = rows.groupBy("conv").agg(F.min_by(F.struct(*copied), order).alias("src"))
    ends = messages.groupBy("conv").agg(F.max("line").alias("last_line"), F.max("ts").alias("last_ts"))
    new_id = bridge_uuid(F.col("conv").cast("string"), F.col("last_line").cast("string"), F.lit(content))
    base = source.join(ends, "conv").select(
        "conv",
        "last_line",
        new_id.alias("root_uuid"),
        (now if now is not None else F.col("last_ts")).alias("ts"),
        F.col("src.cwd").alias("cwd"),
        F.coalesce("src.session_id", F.col("conv").cast("string")).alias("session_id"),
        *[F.coalesce(f"src.{c}", F.lit(v)).alias(c) for c, v in ROOT_DEFAULTS.items()],
    )
    snapshot = base.select(
        "conv", (F.col("last_line") + 1).alias("line"), F.lit(None).cast("string").alias("uuid"),
        F.lit("file-history-snapshot").alias("type"), F.col("root_uuid").alias("message_id"), "ts",
    )
    more = F.create_map(F.lit("todos"), F.lit("[]"), F.lit("permissionMode"), F.lit('"default"'))
    root = base.select(
        "conv", (F.col("last_line") + 2).alias("line"), F.col("root_uuid").alias("uuid"), F.lit("user").alias("type"),
        F.lit(content).alias("text"), "ts", *copied, more.alias("fields"),
    )
    added = snapshot.unionByName(root, allowMissingColumns=True)
    return append_messages(messages, added), base.select("conv", F.col("root_uuid").alias("uuid"))


def prune_orphan_lines(messages: DataFrame, roots: DataFrame) -> DataFrame:
    """Keep each conversation's new root, the snapshot written for it, and its direct children."""
    root = roots.select("conv", F.col("uuid").alias("__root"))
    snapshot = (F.col("message_id") == F.col("__root")) & (F.col("type") == "file-history-snapshot")
    kept = (F.col("uuid") == F.col("__root")) | snapshot | (F.col("parent_uuid") == F.col("__root"))
    return attach(messages, root, ["conv"], "line").filter(F.coalesce(kept, F.lit(False))).drop("__root")
