"""Rewriting transcripts as tables: drop, replace, append, snapshots, restore, run log.

Rows are matched by ``(conv, uuid)``, which is unique on the change side; rows without uuid
(unreadable or snapshot lines) always stay.  Messages that carry their JSON line in ``raw`` get
it rewritten along with the columns, every other field as it was, and added rows get a line of
their own, so that what is written is what the tables say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions import content as ct
from chainloom.operators.scan import attach, scan, take_first

KEEP_SNAPSHOTS = 3


def lookup_lines(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Full rows of the given ``(conv, line)`` pairs."""
    return messages.join(keys.select("conv", "line").distinct(), ["conv", "line"], "left_semi")


def rewrite(
    messages: DataFrame,
    drop: DataFrame | None = None,
    replace: DataFrame | None = None,
    append: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(messages, stats).  Drop beats replace; ids that match nothing are ignored.

    ``replace`` holds conv, uuid and the columns to overwrite, nulls included.
    """
    flagged = messages
    if drop is not None:
        flagged = flagged.join(drop.select("conv", "uuid", F.lit(True).alias("__drop")).distinct(), ["conv", "uuid"], "left")
    else:
        flagged = flagged.withColumn("__drop", F.lit(None).cast("boolean"))
    new: list[str] = []
    if replace is not None:
        new = [c for c in replace.columns if c not in ("conv", "uuid")]
        renamed = replace.select("conv", "uuid", F.lit(True).alias("__new"), *[F.col(c).alias(f"__new_{c}") for c in new])
        flagged = flagged.join(renamed, ["conv", "uuid"], "left")
    else:
        flagged = flagged.withColumn("__new", F.lit(None).cast("boolean"))
    dropped, replaced = F.col("__drop").isNotNull(), F.col("__new").isNotNull()
    stats = flagged.groupBy("conv").agg(
        F.count(F.lit(1)).alias("lines_before"),
        F.count_if(dropped).alias("dropped"),
        F.count_if(replaced & ~dropped).alias("replaced"),
    )
    overwritten = {c: F.when(replaced, F.col(f"__new_{c}")).otherwise(F.col(c) if c in messages.columns else F.lit(None)) for c in new}
    if "raw" in messages.columns and "raw" not in new:
        overwritten["raw"] = F.when(replaced & F.col("raw").isNotNull(), changed_line(new, messages.columns)).otherwise(F.col("raw"))
    out = flagged.filter(~dropped).withColumns(overwritten).drop("__drop", "__new", *[f"__new_{c}" for c in new])
    out = out.select(*messages.columns, *[c for c in new if c not in messages.columns])
    if append is None:
        return out, stats.withColumn("appended", F.lit(0).cast("bigint"))
    added = append.groupBy("conv").agg(F.count(F.lit(1)).alias("appended"))
    stats = stats.join(added, "conv", "left").withColumn("appended", F.coalesce("appended", F.lit(0)).cast("bigint"))
    return append_messages(out, append), stats


def changed_line(new: list[str], old: list[str]) -> Column:
    """The line of a replaced row: its parent, its message if the text changed, and the marks of a distilled row."""
    fields: dict[str, Column] = {}
    if "parent_uuid" in new:
        fields["parentUuid"] = ct.quoted(F.col("__new_parent_uuid"))
    distilled = F.coalesce(F.col("__new_archive_distilled"), F.lit(False)) if "archive_distilled" in new else F.lit(False)
    if "text" in new:
        text = ct.quoted(F.coalesce("__new_text", F.lit("")))
        listed = F.concat(F.lit('[{"type":"text","text":'), text, F.lit("}]"))
        as_list = F.col("__new_shape").eqNullSafe("array") if "shape" in new else F.lit(False)
        body = F.when(as_list, listed).otherwise(text)
        message = F.get_json_object("raw", "$.message")
        kind = F.coalesce(F.get_json_object("raw", "$.message.role"), F.get_json_object("raw", "$.type"), F.lit("user"))
        role = F.when(kind.isin("assistant", "system"), kind).otherwise(F.lit("user"))
        short = ct.json_object({"role": ct.quoted(role), "content": body})  # nothing else of the message remains
        kept = F.when(message.isNull(), short).otherwise(ct.edit_json(message, {"content": body}))
        moved = ~F.col("__new_text").eqNullSafe(F.col("text")) if "text" in old else F.lit(True)
        fields["message"] = F.when(distilled, short).when(moved, kept)
    if "archive_distilled" in new:
        fields["_archiveDistilled"] = F.when(distilled, F.lit("true"))
        at = F.col("__new_archived_at") if "archived_at" in new else F.current_timestamp()
        fields["_archiveDistilledAt"] = F.when(distilled, ct.json_time(at, "timestamp"))
    return ct.edit_json(F.col("raw"), fields) if fields else F.col("raw")


# What every added line carries, in the format's order.
_ADDED = {"isSidechain": "false", "userType": '"external"'}


def new_line(rows: DataFrame) -> Column:
    """The JSON line of an added row, from the columns it has.  ``fields`` holds further JSON texts by name."""
    has = set(rows.columns)

    def text(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), ct.json_quote(F.col(c))) if c in has else F.lit(None).cast("string")

    time = ct.json_time(F.col("ts"), rows.schema["ts"].dataType.simpleString()) if "ts" in has else F.lit("null")
    kind, body = F.coalesce(F.col("type"), F.lit("user")), F.coalesce(text("text"), F.lit('""'))
    message = ct.json_object({"role": ct.quoted(kind), "content": body})
    line = ct.json_object(
        {
            "parentUuid": F.coalesce(text("parent_uuid"), F.lit("null")),
            **{k: F.lit(v) for k, v in _ADDED.items()},
            "cwd": text("cwd"), "sessionId": text("session_id"), "version": text("version"), "gitBranch": text("git_branch"),
            "type": ct.quoted(kind), "message": message, "content": F.when(kind == "system", body),
            "uuid": text("uuid"), "timestamp": time,
        }
    )
    inner = ct.json_object({"messageId": text("message_id"), "trackedFileBackups": F.lit("{}"), "timestamp": time})
    snapshot = ct.json_object(
        {"type": ct.quoted(kind), "messageId": text("message_id"), "snapshot": inner, "isSnapshotUpdate": F.lit("false")}
    )
    line = F.when(kind == "file-history-snapshot", snapshot).otherwise(line)
    if "fields" not in has:
        return line
    more = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(ct.json_quote(e["key"]), F.lit(":"), e["value"])), ",")
    return F.when(F.length(more) > 0, F.concat(F.left(line, F.length(line) - 1), F.lit(","), more, F.lit("}"))).otherwise(line)


def append_messages(messages: DataFrame, rows: DataFrame) -> DataFrame:
    if "raw" in messages.columns and "raw" not in rows.columns:
        rows = rows.withColumn("raw", new_line(rows))
    return messages.unionByName(rows.drop("fields"), allowMissingColumns=True)


def latest_version(files: DataFrame, project: str | None = None) -> DataFrame:
    """One path per conversation: the copy in ``project`` if there is one, else the newest."""
    here = F.col("project") == F.lit(project) if project is not None else F.lit(False)
    best = F.struct(F.coalesce(here, F.lit(False)), F.col("mtime"), F.col("path"))
    return files.groupBy("conv").agg(F.max_by(F.struct("project", "path", "mtime"), best).alias("f")).select("conv", "f.*")


def latest_conversation(files: DataFrame) -> DataFrame:
    """The most recently changed conversation of every project."""
    best = F.struct("mtime", "path")
    return files.groupBy("project").agg(F.max_by(F.struct("conv", "path", "mtime"), best).alias("f")).select("project", "f.*")


def project_key(cwd):
    """Project folder name of a working directory."""
    return F.translate(cwd, "/_", "--")


def resolve_project(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, project): the exact project, else the first one with the same last name part."""
    projects = files.select("project").distinct().withColumn("base", F.element_at(F.split("project", "-"), -1))
    first = projects.groupBy("base").agg(F.min("project").alias("near"))
    exact = projects.select(F.col("project").alias("exact"))
    asked = wanted.withColumn("base", F.element_at(F.split("want", "-"), -1))
    return (
        asked.join(exact, asked["want"] == exact["exact"], "left")
        .join(first, "base", "left")
        .select("want", F.coalesce("exact", "near").alias("project"))
    )


def retain_snapshots(snapshots: DataFrame, n: int = KEEP_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): the newest ``n`` snapshots ``(conv, saved_at, …)`` of each conversation."""
    kept = take_first(snapshots, ["conv"], [F.desc("saved_at")], n)
    return kept, snapshots.join(kept.select("conv", "saved_at"), ["conv", "saved_at"], "left_anti")


def restore_snapshot(
    live: DataFrame, snapshots: DataFrame, now: int, which: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(live, pre_restore): rows replaced by the newest, or the named ``which(conv, saved_at)``, snapshot.

    ``snapshots`` holds the live columns plus ``saved_at``.  Conversations without a snapshot stay.
    """
    picked = which if which is not None else snapshots.groupBy("conv").agg(F.max("saved_at").alias("saved_at"))
    restored = snapshots.join(picked.select("conv", "saved_at"), ["conv", "saved_at"], "left_semi")
    hit = picked.select("conv").distinct().withColumn("__hit", F.lit(True))
    split = attach(live, hit, ["conv"], "line", how="left")
    untouched = split.filter(F.col("__hit").isNull()).drop("__hit")
    before = split.filter(F.col("__hit").isNotNull()).drop("__hit").withColumn("saved_at", F.lit(now).cast("bigint"))
    return untouched.unionByName(restored.drop("saved_at")), before


def condense_log_totals(log: DataFrame) -> DataFrame:
    """Savings per conversation, mode and run with the running total of the conversation."""
    runs = log.groupBy("conv", "saved_at", "mode").agg(F.sum("blocks").alias("blocks"), F.sum("saved").alias("saved"))
    return scan(runs, ["conv"], ["saved_at", "mode"], sums={"saved_so_far": F.col("saved")})
