"""Archive plans: from scored turns to a rewritten transcript.

decisions(conv, turn_id, action, distillation, reason) → plan entries(conv, uuid, pos, action,
distillation, reason) → rewritten messages.  ``turned`` is the chain with turn_id; a broken rule
stops only its own conversation.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chainloom.functions.text import json_quote
from chainloom.operators.chain import ROOT_TYPES
from chainloom.operators.rewrite import rewrite
from chainloom.operators.scan import attach, scan
from chainloom.operators.storage import materialise

KEEP_SCORE, DISTILL_SCORE = 71, 31
KEEP_RECENT = 30
PLAN_TTL_MS = 24 * 60 * 60 * 1000
DIGEST_ROWS = 4096
ACTIONS = ("keep", "drop", "distill")
# Dollars per million cached tokens read and written.
CACHE_READ, CACHE_WRITE = 0.08, 1.00


def score_to_action(decisions: DataFrame, scores: DataFrame, keep: int = KEEP_SCORE, distill: int = DISTILL_SCORE) -> tuple[DataFrame, DataFrame]:
    """(decisions, stats): re-classify the decisions of scored turns by thresholds."""
    known = scores.filter(F.col("value_score").isNotNull()).select("conv", "turn_id", "value_score", "summary")
    joined = decisions.join(known, ["conv", "turn_id"], "left")
    score, old = F.col("value_score"), F.col("action")
    new = F.when(score >= keep, "keep").when(score >= distill, "distill").otherwise("drop")
    changed = score.isNotNull() & ~new.eqNullSafe(old)
    reason = F.coalesce("reason", F.lit(""))
    stub = F.concat(
        F.lit("[turn "), F.col("turn_id").cast("string"), F.lit(": "),
        F.when(F.length(reason) > 0, reason).otherwise(F.lit("no reason captured")), F.lit("]"),
    )
    text = F.when(F.length("distillation") > 0, F.col("distillation")).when(F.length("summary") > 0, F.col("summary")).otherwise(stub)
    marked = F.concat(F.lit("[score="), score.cast("string"), F.lit(", threshold-recomputed; was "), F.coalesce(old, F.lit("")), F.lit("] "), reason)
    out = joined.select(
        "conv",
        "turn_id",
        F.when(changed, new).otherwise(old).alias("action"),
        F.when(changed & (new == "distill"), text).otherwise(F.col("distillation")).alias("distillation"),
        F.when(changed, marked).otherwise(F.col("reason")).alias("reason"),
    )
    stats = joined.groupBy("conv").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(changed).alias("reclassified"), F.count_if(score.isNull()).alias("missing_score")
    )
    return out, stats


def force_keep_recent(decisions: DataFrame, turns: DataFrame, n: int = KEEP_RECENT) -> DataFrame:
    """Keep the last ``n`` turns of every conversation; the reason names the overruled action."""
    if n <= 0:
        return decisions
    totals = turns.groupBy("conv").agg(F.max("turn_id").alias("__total"))
    joined = attach(decisions, totals, ["conv"], "turn_id")
    forced = (F.col("turn_id") > F.col("__total") - n) & ~F.col("action").eqNullSafe("keep")
    note = F.concat(F.lit(f"[force-kept by force_keep_recent_n={n}; was "), F.coalesce("action", F.lit("?")), F.lit("]"))
    return joined.withColumns(
        {"reason": F.when(forced, note).otherwise(F.col("reason")), "action": F.when(forced, "keep").otherwise(F.col("action"))}
    ).drop("__total")


def expand_decisions(decisions: DataFrame, turned: DataFrame, fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): turn decisions as message actions.

    A distilled turn keeps its first row with the text and drops the others.  ``fallback`` is
    the text for a distill decision without one; by default such a turn is skipped.
    """
    spans = turned.groupBy("conv", "turn_id").agg(F.min("pos").alias("first_pos"))
    text = F.when(F.length("distillation") > 0, F.col("distillation")).otherwise(F.lit(fallback))
    judged = decisions.join(spans, ["conv", "turn_id"], "left").withColumn("text", text).withColumn(
        "skip",
        F.when(F.col("first_pos").isNull(), F.lit("turn not in processed set"))
        .when((F.col("action") == "distill") & F.col("text").isNull(), F.lit("distill without distillation"))
        .when(~F.col("action").isin(*ACTIONS) | F.col("action").isNull(), F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null")))),
    )
    skipped = judged.filter("skip IS NOT NULL").select("conv", "turn_id", F.col("skip").alias("reason"))
    acting = judged.filter("skip IS NULL AND action <> 'keep'").select("conv", "turn_id", "first_pos", "action", "text", "reason")
    rows = attach(turned.select("conv", "turn_id", "pos", "uuid"), acting, ["conv", "turn_id"], "pos")
    distilled = F.col("action") == "distill"
    first = distilled & (F.col("pos") == F.col("first_pos"))
    label = F.concat(F.lit("[turn "), F.col("turn_id").cast("string"), F.lit("] "))
    entries = rows.select(
        "conv",
        "uuid",
        "pos",
        F.when(first, "distill").otherwise("drop").alias("action"),
        F.when(first, F.col("text")).alias("distillation"),
        F.when(distilled & ~first, F.concat(label, F.lit("(collapsed into distill on first uuid)")))
        .otherwise(F.concat(label, F.coalesce("reason", F.lit(""))))
        .alias("reason"),
    )
    return entries, skipped


def validate_entries(entries: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): entries must name a chain row, a known action, a text and a reason."""
    known = chain.select("conv", "uuid", F.lit(True).alias("__known"))
    judged = entries.join(known, ["conv", "uuid"], "left").withColumn(
        "code",
        F.when(F.col("__known").isNull(), "unknown_uuid")
        .when(~F.coalesce(F.col("action").isin("drop", "distill"), F.lit(False)), "bad_action")
        .when((F.col("action") == "distill") & ~(F.length(F.coalesce("distillation", F.lit(""))) > 0), "missing_distillation")
        .when(~(F.length(F.coalesce("reason", F.lit(""))) > 0), "missing_reason"),
    )
    return judged.filter("code IS NULL").select(*entries.columns), judged.filter("code IS NOT NULL").select("conv", "uuid", "code")


def reparent(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """(conv, pos, uuid, type, new_parent): kept rows behind a dropped one, linked to the last kept row before."""
    flagged = rows.select("conv", "pos", "uuid", "type").join(
        drops.select("conv", "uuid", F.lit(True).alias("__gone")).distinct(), ["conv", "uuid"], "left"
    )
    gone = F.col("__gone").isNotNull()
    seen = scan(flagged, ["conv"], "pos", prevs={"new_parent": F.when(~gone, F.col("uuid")), "before_gone": gone})
    return seen.filter(~gone & F.coalesce("before_gone", F.lit(False))).select("conv", "pos", "uuid", "type", "new_parent")


def distill_rows(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(conv, uuid, text, shape, archive_distilled): an assistant row becomes a text block, others a string."""
    texts = entries.filter("action = 'distill'").select("conv", "uuid", F.col("distillation").alias("new_text"))
    return messages.join(texts, ["conv", "uuid"]).select(
        "conv",
        "uuid",
        F.col("new_text").alias("text"),
        F.when(F.col("role") == "assistant", "array").otherwise("string").alias("shape"),
        F.lit(True).alias("archive_distilled"),
    )


def plan_guards(links: DataFrame, entries: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(conv, uuid, code) of every rule a plan breaks."""
    roots = links.filter(F.col("new_parent").isNull() & ~F.col("type").isin(*ROOT_TYPES)).select("conv", "uuid", F.lit("bad_root").alias("code"))
    if blocks is None:
        return roots
    tools = blocks.filter(F.col("type").isin("tool_use", "tool_result")).groupBy("conv", "uuid").agg(F.min_by("type", "block_idx").alias("kind"))
    distilled = entries.filter("action = 'distill'").select("conv", "uuid").distinct()
    return roots.unionByName(distilled.join(tools, ["conv", "uuid"]).select("conv", "uuid", F.concat(F.lit("distills_"), "kind").alias("code")))


def _entry_text() -> Column:
    pairs = [("action", "action"), ("distillation", "distillation"), ("reason", "reason"), ("uuid", "uuid")]
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{k}":'), json_quote(F.col(c)))) for k, c in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def canonical_checksum(plans: DataFrame, entries: DataFrame) -> DataFrame:
    """(plan_id, checksum) of the plan as one JSON text with sorted keys: what stored plans carry.

    ``plans`` also has ``path``.  The text is never put together: the entries of a plan come to a task in order and feed its
    hash one by one, so a plan of any length takes the memory of one batch.
    """
    fields = (
        ("jsonlBytes", F.col("bytes").cast("string")),
        ("jsonlMessages", F.col("chain_length").cast("string")),
        *((k, json_quote(F.col(c))) for k, c in (("jsonlPath", "path"), ("lastMessageUuid", "last_uuid"), ("planId", "plan_id"))),
    )
    tail = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in fields])
    ends = plans.select("plan_id", F.lit(True).alias("ends"), F.lit(None).cast("bigint").alias("ord"), tail.alias("text"))
    pieces = entries.filter("plan_id IS NOT NULL").select("plan_id", F.lit(False).alias("ends"), F.col("ord").cast("bigint").alias("ord"), _entry_text().alias("text"))
    rows = pieces.unionByName(ends).repartition("plan_id").sortWithinPartitions("plan_id", "ends", "ord")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, digest, before = None, None, b""
        for batch in batches:
            ids, sums = [], []
            for plan_id, ends, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if digest is None or plan_id != plan:
                    plan, digest, before = plan_id, sha256(b'{"entries":['), b""
                if ends:
                    digest.update(f"],{text}}}".encode())
                    ids.append(plan_id)
                    sums.append(digest.hexdigest())
                    digest = None
                else:
                    digest.update(before + text.encode())
                    before = b","
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("plan_id").type), pa.array(sums, pa.string())], names=["plan_id", "checksum"])

    return rows.mapInArrow(fold, StructType([plans.schema["plan_id"], StructField("checksum", StringType())]))


def plan_checksum(plans: DataFrame, entries: DataFrame) -> DataFrame:
    """(plan_id, checksum) over the core fields in key order.

    Entries (with their ordinal ``ord``) are hashed in blocks and the block digests hashed
    again, so a plan of any length never becomes one string.
    """
    piece = entries.select("plan_id", "ord", F.floor(F.col("ord") / DIGEST_ROWS).alias("block"), _entry_text().alias("one"))

    def digest(order: str, value: str):
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        return F.sha2(F.array_join(F.transform(rows, lambda r: r["v"]), ","), 256)

    blocks = piece.groupBy("plan_id", "block").agg(digest("ord", "one").alias("d"))
    body = blocks.groupBy("plan_id").agg(digest("block", "d").alias("entries_digest"))
    core = F.concat_ws(
        ",",
        F.concat(F.lit('{"entries":"'), F.coalesce("entries_digest", F.lit("")), F.lit('"')),
        *[F.concat(F.lit(f'"{k}":'), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for k, c in (("bytes", "bytes"), ("messages", "chain_length"))],
        *[F.concat(F.lit(f'"{k}":'), F.coalesce(json_quote(F.col(c).cast("string")), F.lit("null"))) for k, c in (("conv", "conv"), ("lastMessageUuid", "last_uuid"), ("planId", "plan_id"))],
    )
    return plans.join(body, "plan_id", "left").select("plan_id", F.sha2(F.concat(core, F.lit("}")), 256).alias("checksum"))


def plan_drift(plans: DataFrame, entries: DataFrame, chain_stats: DataFrame, now_ms: int) -> DataFrame:
    """(plan_id, verdict).  ``plans`` has checksum, given_checksum and created_at besides the core."""
    fresh = plan_checksum(plans, entries).withColumnRenamed("checksum", "recomputed")
    live = chain_stats.select("conv", F.col("last_uuid").alias("live_uuid"), F.col("chain_length").alias("live_length"))
    verdict = (
        F.when(F.lit(now_ms) - F.col("created_at") > PLAN_TTL_MS, "expired")
        .when(F.col("recomputed") != F.col("checksum"), "tampered")
        .when(~F.col("given_checksum").eqNullSafe(F.col("checksum")), "checksum_mismatch")
        .when(F.col("live_uuid").isNull(), "empty_chain")
        .when((F.col("live_uuid") != F.col("last_uuid")) | (F.col("live_length") != F.col("chain_length")), "drifted")
        .otherwise("ok")
    )
    return plans.join(fresh, "plan_id").join(live, "conv", "left").select("plan_id", "conv", verdict.alias("verdict"))


def apply_plan(
    messages: DataFrame, rows: DataFrame, entries: DataFrame, blocks: DataFrame | None = None, *, orphan: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(messages, report): re-link, distil and, unless ``orphan``, remove the dropped rows.

    ``rows`` is the chain with conv, pos, uuid, type.  Conversations with a broken rule stay as
    they are and say so in the report.
    """
    # Entries and links are narrow and read several times below: each is written once.
    entries = materialise(entries, "plan-entries")
    every_link = materialise(reparent(rows, entries.filter("action = 'drop'")), "plan-links")
    broken = plan_guards(every_link, entries, blocks)
    refused = materialise(broken.groupBy("conv").agg(F.min("code").alias("refused")), "plan-refused")
    acting = attach(entries, refused, ["conv"], "pos", how="left").filter("refused IS NULL").drop("refused")
    drops = acting.filter("action = 'drop'").select("conv", "uuid")
    # Links of one conversation do not depend on the entries of another.
    links = (
        attach(every_link, refused, ["conv"], "pos", how="left")
        .filter("refused IS NULL")
        .select("conv", "uuid", "new_parent", F.lit(True).alias("__link"))
    )
    texts = distill_rows(messages, acting)
    changed = (
        texts.join(links, ["conv", "uuid"], "full")
        .join(messages.select("conv", "uuid", "parent_uuid", F.col("text").alias("old_text"), F.col("shape").alias("old_shape")), ["conv", "uuid"])
        .select(
            "conv",
            "uuid",
            F.when(F.col("__link").isNotNull(), F.col("new_parent")).otherwise(F.col("parent_uuid")).alias("parent_uuid"),
            F.when(F.col("archive_distilled"), F.col("text")).otherwise(F.col("old_text")).alias("text"),
            F.when(F.col("archive_distilled"), F.col("shape")).otherwise(F.col("old_shape")).alias("shape"),
            F.coalesce("archive_distilled", F.lit(False)).alias("archive_distilled"),
        )
    )
    out, _ = rewrite(messages, drop=None if orphan else drops, replace=changed)
    counts = acting.groupBy("conv").agg(
        F.count_if(F.col("action") == "drop").alias("dropped"), F.count_if(F.col("action") == "distill").alias("distilled")
    )
    linked = links.groupBy("conv").agg(F.count(F.lit(1)).alias("reparented"))
    every = messages.select("conv").distinct()
    report = every.join(counts, "conv", "left").join(linked, "conv", "left").join(refused, "conv", "left").select(
        "conv",
        F.coalesce("refused", F.lit("applied")).alias("verdict"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("dropped", "distilled", "reparented")],
        (F.coalesce("distilled", F.lit(0)) > 0).alias("requires_resume"),
    )
    return out, report


def plan_report(decisions: DataFrame, entries: DataFrame, messages: DataFrame, chain: DataFrame) -> DataFrame:
    """Action tallies and the expected size reduction; ``messages`` has ``bytes`` per line."""
    turn = F.col("action")
    turns = decisions.groupBy("conv").agg(
        *[F.count_if(turn == a).alias(f"turns_{a}") for a in ACTIONS],
        F.count_if(~F.coalesce(turn.isin(*ACTIONS), F.lit(False))).alias("turns_unknown"),
    )
    sized = entries.select("conv", "uuid", "action").join(messages.select("conv", "uuid", "bytes"), ["conv", "uuid"])
    freed = F.when(F.col("action") == "drop", F.col("bytes")).otherwise(F.floor(F.col("bytes") * 0.9))
    actions = sized.groupBy("conv").agg(
        F.count_if(F.col("action") == "drop").alias("drop_entries"),
        F.count_if(F.col("action") == "distill").alias("distill_entries"),
        F.sum(freed).cast("bigint").alias("bytes_freed"),
    )
    lengths = chain.groupBy("conv").agg(F.count(F.lit(1)).alias("chain_length"))
    files = messages.groupBy("conv").agg(F.sum("bytes").alias("file_bytes"))
    names = [f"turns_{a}" for a in ACTIONS] + ["turns_unknown", "drop_entries", "distill_entries", "bytes_freed"]
    out = lengths.join(files, "conv").join(turns, "conv", "left").join(actions, "conv", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in names})
    return out.select(
        "conv",
        "chain_length",
        *names,
        (F.col("chain_length") - F.col("drop_entries") - F.col("distill_entries")).alias("kept_entries"),
        F.when(F.col("file_bytes") > 0, F.floor(F.col("bytes_freed") / F.col("file_bytes") * 100 + 0.5)).otherwise(0).cast("bigint").alias("reduction_pct"),
    )


def score_breakdown(scores: DataFrame) -> DataFrame:
    """Turns per type and importance, errors left out."""
    fine = scores.filter(F.col("error").isNull()) if "error" in scores.columns else scores
    return fine.groupBy("conv", "type", "importance").agg(F.count(F.lit(1)).alias("turns"))


def merge_scores(prefiltered: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn_scores, failed): both sources in one table, failed turns listed apart as well."""
    every = scored.unionByName(prefiltered, allowMissingColumns=True)
    return every, scored.filter(F.col("error").isNotNull()).select("conv", "turn_id", "error")


def usage_cost(usage: DataFrame, prices: Mapping[str, Sequence[tuple[int, float, float]]]) -> DataFrame:
    """Dollars per row.  ``prices``: model → [(more input tokens than, per million in, per million out)].

    The highest tier whose bound is passed prices the whole call; an unlisted model costs null.
    """
    cost = F.lit(None).cast("double")
    for model, tiers in prices.items():
        for bound, usd_in, usd_out in sorted(tiers):
            hit = (F.col("model") == model) & (F.col("tokens_in") > bound if bound > 0 else F.lit(True))
            cost = F.when(hit, F.col("tokens_in") / 1e6 * usd_in + F.col("tokens_out") / 1e6 * usd_out).otherwise(cost)
    for column, price in (("cache_read", CACHE_READ), ("cache_write", CACHE_WRITE)):
        if column in usage.columns:
            cost = cost + F.coalesce(F.col(column), F.lit(0)) / 1e6 * price
    return usage.withColumn("usd", cost)
