"""Looking into conversations: ranges, previews, compact skeletons, input budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import first_line, line_count, trim_blank
from chainloom.functions.tools import clip_middle, compact_block, json_arg
from chainloom.operators.scan import interval_join, scan
from chainloom.operators.turns import SEGMENT_SIZE, assign_turn_ids

MAX_REVEAL = 100  # of interactive requests
HEADROOM_TOKENS = 8_000
TOKEN_FACTOR = 1.25

# Fixed values: (result head, result tail, clip length, head share, tail share) per profile.
SKELETON_PROFILES = {"entry": (400, 120, 2500, 0.75, 0.20), "turn": (800, 200, 12_000, 0.78, 0.18)}


def inspect_range(messages: DataFrame, specs: DataFrame, size: int = SEGMENT_SIZE, *, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts) for reveal requests.

    ``specs`` has req, conv and the nullable columns message_from, message_to, segment_id,
    turn_from, turn_to, turn_id; the first one given wins, in that order.  ``idx`` (1-based) of
    ``messages`` numbers the rows.  A request for more than ``most`` rows is refused, not cut; with None
    requests may be of any length.
    """
    by_message = F.col("message_from").isNotNull()
    by_segment = F.col("segment_id").isNotNull()
    t_from, t_to = F.coalesce("turn_from", "turn_id"), F.coalesce("turn_to", "turn_id")
    turned = assign_turn_ids(messages, "idx")
    sizes = turned.groupBy("conv").agg(F.max("idx").alias("n"), F.max("turn_id").alias("turns"))
    spans = turned.groupBy("conv", "turn_id").agg(F.min("idx").alias("t_start"), F.max("idx").alias("t_end"))
    # Turn ids have no gaps, so a range needs only its first and its last turn.
    ends = (
        specs.filter(~by_message & ~by_segment)
        .join(sizes, "conv")
        .select("req", "conv", t_from.alias("t_from"), F.least(t_to, F.col("turns")).alias("t_to"))
    )
    opening = spans.select("conv", F.col("turn_id").alias("t_from"), "t_start")
    closing = spans.select("conv", F.col("turn_id").alias("t_to"), "t_end")
    turn_span = ends.join(opening, ["conv", "t_from"]).join(closing, ["conv", "t_to"]).select("req", "t_start", "t_end")
    wanted = (
        specs.join(turn_span, "req", "left")
        .join(sizes, "conv", "left")
        .withColumns(
            {
                "from": F.when(by_message, F.col("message_from"))
                .when(by_segment, (F.col("segment_id") - 1) * size + 1)
                .otherwise(F.col("t_start")),
                "to": F.least(
                    F.when(by_message, F.col("message_to")).when(by_segment, F.col("segment_id") * size).otherwise(F.col("t_end")),
                    F.col("n"),
                ),
            }
        )
        .withColumn(
            "verdict",
            F.when(by_message & ((F.col("message_from") < 1) | (F.col("message_to") < F.col("message_from"))), "invalid_range")
            .when(~by_message & ~by_segment & t_from.isNull(), "no_selector")
            .when(~by_message & ~by_segment & ((t_from < 1) | (t_to < t_from)), "invalid_range")
            .when(F.col("n").isNull() | F.col("from").isNull(), "not_found")
            .when(F.col("from") > F.col("n"), "out_of_range")
            .when(F.lit(False) if most is None else F.col("to") - F.col("from") + 1 > most, "too_large")
            .otherwise("ok"),
        )
    )
    verdicts = wanted.select("req", "conv", "verdict", F.col("from").cast("bigint").alias("msg_from"), F.col("to").cast("bigint").alias("msg_to"))
    accepted = verdicts.filter("verdict = 'ok'").drop("verdict")
    rows = interval_join(messages, accepted, ["conv"], "idx", "msg_from", "msg_to").drop("msg_from", "msg_to")
    return rows, verdicts


def action_span(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """Message span of ``requests(req, conv, turn_id, action_from, action_to)``; invalid ones are left out."""
    listed = actions.select("conv", "turn_id", "action_id", "msg_index")
    first = listed.withColumnsRenamed({"action_id": "action_from", "msg_index": "message_from"})
    last = listed.withColumnsRenamed({"action_id": "action_to", "msg_index": "message_to"})
    return (
        requests.filter(F.col("action_to") >= F.col("action_from"))
        .join(first, ["conv", "turn_id", "action_from"])
        .join(last, ["conv", "turn_id", "action_to"])
        .select("req", "conv", "message_from", "message_to")
    )


def message_preview(messages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Role, first line (200 characters), how many more lines, and the calls made."""
    said = trim_blank(F.coalesce("text", F.lit("")))
    lines = line_count(said)
    more = F.when(
        (lines > 1) | (F.length(said) > 200), F.concat(F.lit(" … (+"), (lines - 1).cast("string"), F.lit(" more lines)"))
    ).otherwise(F.lit(""))
    head = F.left(first_line(said), F.lit(200))
    out = messages.withColumn("preview", F.when(F.length(head) > 0, F.concat(head, more)).otherwise(F.lit("")))
    if blocks is None:
        return out
    path, cmd, note = json_arg("file_path"), json_arg("command"), json_arg("description")
    line = F.concat(
        F.col("tool"),
        F.when(F.length(path) > 0, F.concat(F.lit(" "), path)).otherwise(F.lit("")),
        F.when(F.length(cmd) > 0, F.concat(F.lit(" `"), F.left(first_line(cmd), F.lit(80)), F.lit("`"))).otherwise(F.lit("")),
        F.when(F.length(note) > 0, F.concat(F.lit(" ("), F.left(note, F.lit(60)), F.lit(")"))).otherwise(F.lit("")),
    )
    calls = (
        blocks.filter(F.col("type") == "tool_use")
        .groupBy("conv", "uuid")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("l")))), lambda s: s["l"]), "\n").alias("calls"))
    )
    return out.join(calls, ["conv", "uuid"], "left").withColumn("calls", F.coalesce("calls", F.lit("")))


def compact_entries(messages: DataFrame, blocks: DataFrame | None, profile: str) -> DataFrame:
    """(conv, uuid, pos, role, ts, skeleton) with the entry wrapper; string content is taken whole."""
    head, tail, limit, head_share, tail_share = SKELETON_PROFILES[profile]
    rows = messages
    body = F.coalesce("text", F.lit(""))
    if blocks is not None:
        one = compact_block(F.struct("type", "text", "thinking", "tool", "args", "result_text", "is_error"), head, tail)
        parts = (
            blocks.withColumn("part", one)
            .filter(F.col("part").isNotNull())
            .groupBy("conv", "uuid")
            .agg(F.array_sort(F.collect_list(F.struct("block_idx", "part"))).alias("parts"))
        )
        rows = messages.join(parts, ["conv", "uuid"], "left")
        joined = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
        body = F.when(F.col("shape") == "array", F.coalesce(joined, F.lit(""))).otherwise(body)
    if profile == "entry":
        body = clip_middle(body, limit, head_share, tail_share)
    stamp = F.left(F.coalesce(F.col("ts").cast("string"), F.lit("")), F.lit(19))
    wrapped = F.concat(
        F.lit('<entry uuid="'), F.coalesce("uuid", F.lit("?")), F.lit('" role="'), F.col("role"), F.lit('" ts="'), stamp, F.lit('">\n'), body, F.lit("\n</entry>")
    )
    return rows.select("conv", "uuid", "pos", *[c for c in ("turn_id",) if c in messages.columns], wrapped.alias("skeleton"))


def turn_skeletons(entries: DataFrame) -> DataFrame:
    """One clipped text per turn.

    Only entries that reach into the kept head or tail are gathered, so a turn of any length
    costs a bounded group: each entry text has its wrapper, never zero characters.
    """
    _, _, limit, head_share, tail_share = SKELETON_PROFILES["turn"]
    head, tail = int(limit * head_share), int(limit * tail_share)
    size = (F.length("skeleton") + 2).cast("bigint")
    placed = scan(entries, ["conv", "turn_id"], "pos", sums={"upto": size}, totals={"whole": ("sum", size)})
    total = F.col("whole") - 2
    start = F.col("upto") - size
    fits = total <= limit
    in_head, in_tail = start < head, F.col("upto") - 2 > total - tail
    picked = placed.withColumn("total", total).filter(fits | in_head | in_tail)
    text = F.col("skeleton")
    sep = F.lit("\n\n")

    def joined(flag: str):
        rows = F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("pos", text.alias("t")))))
        return F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n")

    flagged = picked.withColumns(
        {"h": fits | in_head, "t": in_tail & ~fits, "before": start, "body": text}
    )
    grouped = flagged.groupBy("conv", "turn_id").agg(
        F.max("total").alias("total"), joined("h").alias("head_text"), joined("t").alias("tail_text")
    )
    cut = F.concat(
        F.left("head_text", F.lit(head)),
        F.lit("\n... ["),
        (F.col("total") - head - tail).cast("string"),
        F.lit(" chars elided] ...\n"),
        F.right("tail_text", F.lit(tail)),
    )
    # A separator may be the first thing cut into: pad so that left/right stay exact.
    head_padded = F.when(F.length("head_text") < head, F.concat(F.col("head_text"), sep)).otherwise(F.col("head_text"))
    tail_padded = F.when(F.length("tail_text") < tail, F.concat(sep, F.col("tail_text"))).otherwise(F.col("tail_text"))
    return (
        grouped.withColumns({"head_text": head_padded, "tail_text": tail_padded})
        .withColumn("skeleton", F.when(F.col("total") <= limit, F.col("head_text")).otherwise(cut))
        .select("conv", "turn_id", F.col("total").alias("chars"), F.when(F.col("total") <= limit, F.left("skeleton", F.col("total").cast("int"))).otherwise(F.col("skeleton")).alias("skeleton"))
    )


def input_budget(entries: DataFrame, models: dict[str, int]) -> DataFrame:
    """Does the whole skeleton of a conversation fit the window (tokens) of each named model?"""
    size = entries.groupBy("conv").agg(
        (F.sum(F.octet_length("skeleton")) + 2 * (F.count(F.lit(1)) - 1)).alias("bytes")
    )
    choices = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("window")) for m, w in models.items()])
    return (
        size.withColumn("tokens", F.ceil(F.col("bytes") / 4 * TOKEN_FACTOR).cast("bigint"))
        .withColumn("m", F.explode(choices))
        .select("conv", "m.model", "bytes", "tokens", (F.col("tokens") <= F.col("m.window") - HEADROOM_TOKENS).alias("fits"))
    )
