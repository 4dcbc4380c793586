"""Turns, segments, pre-filter, action lists.

Message columns used here: conv, an ordinal (``pos`` on the chain or ``line`` in the file), uuid,
type, role, ts, text, ``opens_turn`` (typed input by block rule) and ``real_user`` (typed input by
text rule).  Block columns: conv, ordinal, block_idx, type, tool, args, text, result_text, is_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import clip, first_line, is_blank, trim_blank
from chainloom.functions.tools import json_arg, tool_call_label
from chainloom.operators.scan import attach, scan, take_first
from chainloom.operators.storage import materialise

SEGMENT_SIZE = 200
# How much a short digest shows; nothing is left out unless they are passed.
SHORT_DIGEST = {"files": 15, "bash": 5, "decisions": 6, "highlights": 3}
PREFILTER_ROWS, PREFILTER_CHARS = 5, 700

# What counts as a quick decision.  ASCII word borders are written out.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
DECISION_RULES = (
    rf"(?i){_B}(let'?s|go with|ship|do it|proceed|build it|implement|fix it|push it){_E}",
    rf"(?i){_B}(yes,?\s|approved{_E}|confirmed{_E}|go ahead{_E})",
    r"(?i)^(do|make|fix|build|add|remove|update|create|implement|ship|push|commit)\s",
)


def segment_turns(chain: DataFrame) -> DataFrame:
    """Add turn_id: a new turn at every typed input; the first row opens turn 1."""
    opens = F.when(F.col("opens_turn") | (F.col("pos") == 1), 1).otherwise(0)
    return scan(chain, ["conv"], "pos", sums={"turn_id": opens.cast("bigint")})


def assign_turn_ids(messages: DataFrame, order: str = "line") -> DataFrame:
    """Add turn_id by the text rule; rows before the first prompt get 0."""
    return scan(messages, ["conv"], order, sums={"turn_id": F.when(F.col("real_user"), 1).otherwise(0).cast("bigint")})


def turn_rollup(turned: DataFrame) -> DataFrame:
    """One row per turn."""
    return turned.groupBy("conv", "turn_id").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.min_by("uuid", "pos").alias("first_uuid"),
        F.max_by("uuid", "pos").alias("last_uuid"),
        F.min_by("ts", "pos").alias("start_ts"),
        F.max_by("ts", "pos").alias("end_ts"),
        F.min_by("opens_turn", "pos").alias("has_real_user_input"),
    )


def prefilter_turns(turned: DataFrame) -> DataFrame:
    """Synthetic score rows for turns nothing can be learned from.

    Needs ``plain_chars`` (characters of string content and string block fields) and
    ``n_tool_use`` per message.
    """
    per_turn = turned.groupBy("conv", "turn_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("plain_chars").alias("chars"), F.sum("n_tool_use").alias("calls")
    )
    single = F.col("n") == 1
    short = (F.col("n") <= PREFILTER_ROWS) & (F.col("calls") == 0) & (F.col("chars") < PREFILTER_CHARS)
    return per_turn.filter(single | short).select(
        "conv",
        "turn_id",
        F.lit("micro").alias("type"),
        F.when(single, F.lit("Pre-filtered: single-entry turn (no agent response)."))
        .otherwise(F.format_string(f"Pre-filtered: ≤{PREFILTER_ROWS}-entry turn, no tool_use, content %d chars.", "chars"))
        .alias("summary"),
        F.when(single, F.lit("pf-micro-single-entry")).otherwise(F.lit("pf-micro-no-tool-use-short")).alias("duplicate_signal"),
        F.lit("discardable").alias("importance"),
        F.when(single, F.lit("single-entry turn (no agent response)"))
        .otherwise(F.format_string(f"≤{PREFILTER_ROWS} entries, no tool_use, %d chars", "chars"))
        .alias("prefilter_reason"),
    )


def decision_like(text: Column) -> Column:
    hit = text.rlike(DECISION_RULES[0]) | text.rlike(DECISION_RULES[1]) | text.rlike(DECISION_RULES[2])
    return F.coalesce(F.length(text).between(5, 500) & hit, F.lit(False))


def _listed(df: DataFrame, value: Column, order: Column, name: str) -> DataFrame:
    """Capped rows of a segment as one ordered array."""
    return df.groupBy("conv", "segment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]).alias(name)
    )


def segment_of(order: str, size: int = SEGMENT_SIZE) -> Column:
    return (F.floor((F.col(order) - 1) / size) + 1).cast("bigint")


def tool_counts(blocks: DataFrame, size: int = SEGMENT_SIZE) -> DataFrame:
    """Calls per segment and tool with the place the tool was first seen."""
    return (
        blocks.filter(F.col("type") == "tool_use")
        .withColumn("segment_id", segment_of("pos", size))
        .groupBy("conv", "segment_id", "tool")
        .agg(F.count(F.lit(1)).alias("calls"), F.min(F.struct("pos", "block_idx")).alias("first_seen"))
    )


def top_tools(counts: DataFrame, n: int | None = None) -> DataFrame:
    """The most used tools of each segment, ties in first-seen order."""
    return take_first(counts, ["conv", "segment_id"], [F.desc("calls"), F.asc("first_seen")], n, rank="rank")


def summarize_segments(
    messages: DataFrame,
    blocks: DataFrame,
    size: int = SEGMENT_SIZE,
    *,
    files: int | None = None,
    bash: int | None = None,
    decisions: int | None = None,
    highlights: int | None = None,
) -> DataFrame:
    """Digest of every ``size`` consecutive messages (``pos`` 1-based) of a conversation.

    Lists hold all their entries, or the first of each that ``files``, ``bash``, ``decisions`` and ``highlights`` allow.
    """
    turned = (
        assign_turn_ids(messages, "pos")
        .withColumn("segment_id", segment_of("pos", size))
        .withColumn("said", trim_blank(F.coalesce("text", F.lit(""))))
    )
    key = ["conv", "segment_id"]
    base = turned.groupBy(*key).agg(
        F.min("pos").alias("msg_from"),
        F.max("pos").alias("msg_to"),
        F.min(F.when(F.col("turn_id") > 0, F.col("turn_id"))).alias("turn_from"),
        F.max(F.when(F.col("turn_id") > 0, F.col("turn_id"))).alias("turn_to"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).alias("ts_from"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).alias("ts_to"),
    )
    at = F.struct("pos", "block_idx")
    calls = blocks.filter(F.col("type") == "tool_use").withColumn("segment_id", segment_of("pos", size))
    touched = (
        calls.withColumn("file", json_arg("file_path"))
        .filter(F.length("file") > 0)
        .groupBy(*key, "file")
        .agg(F.min(at).alias("seen"))
    )
    file_list = _listed(take_first(touched, key, [F.asc("seen")], files), F.col("file"), F.col("seen"), "files_touched")
    n_files = touched.groupBy(*key).agg(F.count(F.lit(1)).alias("files_touched_count"))
    tools = _listed(
        tool_counts(blocks, size),
        F.concat_ws(":", "tool", F.col("calls").cast("string")),
        F.col("first_seen"),
        "tools_used",
    )
    note = json_arg("description")
    commands = calls.filter((F.col("tool") == "Bash") & (F.length(json_arg("command")) > 0)).select(
        *key,
        at.alias("seen"),
        F.concat(
            F.left(first_line(json_arg("command")), F.lit(120)),
            F.when(F.length(note) > 0, F.concat(F.lit(" # "), note)).otherwise(F.lit("")),
        ).alias("line"),
    )
    samples = _listed(take_first(commands, key, [F.asc("seen")], bash), F.col("line"), F.col("seen"), "bash_samples")

    def quotes(rows: DataFrame, chars: int, n: int | None, name: str) -> DataFrame:
        kept = take_first(rows.select(*key, "pos", "turn_id", "said"), key, [F.asc("pos")], n)
        quote = F.concat_ws("|", F.col("turn_id").cast("string"), F.left(first_line(F.col("said")), F.lit(chars)))
        return _listed(kept, quote, F.col("pos"), name)

    decided = quotes(turned.filter((F.col("role") == "user") & decision_like(F.col("said"))), 200, decisions, "user_decisions")
    shown = quotes(
        turned.filter((F.col("role") == "assistant") & (F.length("said") > 80)), 160, highlights, "assistant_highlights"
    )
    out = base
    for part in (file_list, n_files, tools, samples, decided, shown):
        out = out.join(part, key, "left")
    empty = F.array().cast("array<string>")
    lists = ("files_touched", "tools_used", "bash_samples", "user_decisions", "assistant_highlights")
    return out.withColumns(
        {
            **{c: F.coalesce(F.col(c), empty) for c in lists},
            "files_touched_count": F.coalesce("files_touched_count", F.lit(0)).cast("bigint"),
        }
    )


def turn_actions(messages: DataFrame, blocks: DataFrame, order: str = "line") -> tuple[DataFrame, DataFrame]:
    """(actions, turns): the numbered actions of every prompted turn, and one row per turn.

    ``msg_index`` is the ordinal itself.  A result belongs to the last action before it and is
    read only while that action has no result line yet.
    """
    turned = assign_turn_ids(messages, order).filter(F.col("turn_id") > 0)
    turned = scan(turned, ["conv", "turn_id"], order, totals={"msg_from": ("min", F.col(order))})
    turned = materialise(turned, "turned")  # read three times below
    inside = turned.filter(F.col(order) > F.col("msg_from")).select("conv", order, "turn_id", "role")
    kind = F.col("type")
    is_action = (F.col("role") == "assistant") & ((kind == "tool_use") | ((kind == "text") & ~is_blank(F.col("text"))))
    is_result = (F.col("role") == "user") & (kind == "tool_result")
    events = blocks.join(inside, ["conv", order]).filter(is_action | is_result).withColumn("is_action", is_action)
    numbered = scan(
        events, ["conv", "turn_id"], [order, "block_idx"], sums={"action_id": F.when(F.col("is_action"), 1).otherwise(0).cast("bigint")}
    )
    numbered = materialise(numbered, "turn-events")
    said = F.concat(F.left(first_line(F.col("text")), F.lit(200)), F.when(F.length("text") > 200, F.lit("…")).otherwise(F.lit("")))
    actions = numbered.filter("is_action").select(
        "conv",
        "turn_id",
        "action_id",
        F.when(kind == "tool_use", F.lit("tool_use")).otherwise(F.lit("assistant_text")).alias("kind"),
        F.when(kind == "tool_use", F.col("tool")).alias("tool"),
        F.when(kind == "tool_use", tool_call_label(F.col("tool"), F.col("args"))).otherwise(said).alias("summary"),
        F.col(order).alias("msg_index"),
        F.when(kind == "text", F.col("text")).alias("full_text"),
    )
    lines = numbered.filter(~F.col("is_action") & (F.col("action_id") > 0)).select(
        "conv",
        "turn_id",
        "action_id",
        order,
        "block_idx",
        F.left(F.regexp_extract(F.coalesce("result_text", F.lit("")), r"([^\n]*\S[^\n]*)", 1), F.lit(120)).alias("line_text"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"),
    )
    owner = ["conv", "turn_id", "action_id"]
    filled = F.when(F.length("line_text") > 0, F.lit(True))
    answered = (
        scan(lines, owner, [order, "block_idx"], prevs={"earlier": filled})
        .filter(F.col("earlier").isNull())
        .groupBy(*owner)
        .agg(
            F.max(F.when(F.length("line_text") > 0, F.col("line_text"))).alias("result_summary"),
            F.bool_or("is_error").alias("result_error"),
        )
    )
    listed = actions.join(answered, owner, "left").withColumn("result_error", F.coalesce("result_error", F.lit(False)))

    opening = trim_blank(F.coalesce("text", F.lit("")))
    prompt = F.when(F.col("real_user"), clip(opening, 500, "… (truncated; use action_id: 1 for full)")).otherwise(F.lit(""))
    per_turn = turned.groupBy("conv", "turn_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min(order).alias("msg_from"),
        F.max(order).alias("msg_to"),
        F.min_by(prompt, order).alias("user_prompt"),
    )
    last_text = actions.groupBy("conv", "turn_id").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.max_by("full_text", F.when(F.col("full_text").isNotNull(), F.col("action_id"))).alias("last_text"),
        F.max_by("summary", "action_id").alias("last_summary"),
    )
    turns = per_turn.join(last_text, ["conv", "turn_id"], "left").select(
        "conv",
        "turn_id",
        "message_count",
        "msg_from",
        "msg_to",
        "user_prompt",
        F.coalesce("n_actions", F.lit(0)).cast("bigint").alias("n_actions"),
        F.when(F.col("last_text").isNotNull() & (F.col("last_text") != F.col("last_summary")), clip(F.col("last_text"), 800, "…"))
        .otherwise(F.lit(""))
        .alias("final_text"),
    )
    return listed.drop("full_text"), turns


def purpose_sample(rows: DataFrame, ends: int | None = None, longer_than: int = 5) -> DataFrame:
    """Typed texts of a conversation: all of them, or the first and last ``ends`` around '...'."""
    typed = rows.filter(F.col("type") == "user").withColumn("said", trim_blank(F.coalesce("typed_text", F.lit(""))))
    typed = typed.filter(F.length("said") > longer_than).select("conv", "pos", "said")
    one = F.lit(1).cast("bigint")
    ranked = scan(typed, ["conv"], "pos", sums={"rank": one}, totals={"n": ("sum", one)})
    if ends is None:
        return ranked.select("conv", F.col("rank").alias("ord"), F.col("said").alias("text"))
    every = F.col("n") <= 2 * ends
    kept = ranked.filter(every | (F.col("rank") <= ends) | (F.col("rank") > F.col("n") - ends)).select(
        "conv",
        F.when(every | (F.col("rank") <= ends), F.col("rank")).otherwise(F.col("rank") - F.col("n") + 2 * ends + 1).alias("ord"),
        F.col("said").alias("text"),
    )
    gap = (
        ranked.filter((~every) & (F.col("rank") == 1))
        .select("conv", F.lit(ends + 1).cast("bigint").alias("ord"), F.lit("...").alias("text"))
    )
    return kept.unionByName(gap)


def purpose_head(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The typed texts that are not blank, or the first ``n`` of them."""
    typed = rows.filter((F.col("type") == "user") & ~is_blank(F.coalesce("text", F.lit("")))).select("conv", "pos", "text")
    if n is None:
        return scan(typed, ["conv"], "pos", sums={"ord": F.lit(1).cast("bigint")})
    return take_first(typed, ["conv"], [F.asc("pos")], n, rank="ord")


def turn_of_uuid(turned: DataFrame) -> DataFrame:
    """(conv, uuid, turn_id, total_turns) for the condensation and archive operators."""
    per_conv = turned.groupBy("conv").agg(F.max("turn_id").alias("total_turns"), F.max("pos").alias("__n"))
    return attach(turned.select("conv", "uuid", "pos", "turn_id"), per_conv, ["conv"], "pos", span="__n").select(
        "conv", "uuid", "turn_id", "total_turns"
    )
