"""Message content: a string, or an array of blocks, with nested result content.

Everything is column expressions over the JSON text, so key order and number text survive.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainloom.functions.text import is_blank, json_quote

ENTRY_SCHEMA = (
    "uuid STRING, parentUuid STRING, type STRING, subtype STRING, timestamp STRING, sessionId STRING, cwd STRING, "
    "gitBranch STRING, version STRING, isSidechain BOOLEAN, messageId STRING, logicalParentUuid STRING, "
    "isCompactSummary BOOLEAN, content STRING, message STRUCT<role: STRING, content: STRING>"
)
ARRAY_SCHEMA = "message STRUCT<content: ARRAY<STRING>>"
VARIANT_SCHEMA = "message STRUCT<content: ARRAY<VARIANT>>"
BLOCK_SCHEMA = (
    "type STRING, text STRING, thinking STRING, signature STRING, id STRING, name STRING, input STRING, "
    "tool_use_id STRING, content STRING, is_error BOOLEAN"
)


def edit_json(text: Column, fields: Mapping[str, Column]) -> Column:
    """JSON object text with top-level fields set to JSON texts; the other fields keep order and value.

    A field whose new text is null stays as it is.
    """
    shown = F.from_json(text, "map<string,string>")
    typed = F.from_json(text, "map<string,variant>")

    def pair(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        quoted = F.schema_of_variant(typed[key]) == "STRING"
        kept = F.when(value.isNull(), F.lit("null")).when(quoted, json_quote(value)).otherwise(value)
        for name, new in fields.items():
            kept = F.when((key == name) & new.isNotNull(), new).otherwise(kept)
        return F.concat(json_quote(key), F.lit(":"), kept)

    pairs = F.transform(F.map_entries(shown), pair)
    extra = [
        F.when(~F.map_contains_key(shown, F.lit(name)), F.concat(F.lit(f'"{name}":'), new)) for name, new in fields.items()
    ]
    added = F.filter(F.array(*extra), lambda e: e.isNotNull())
    return F.concat(F.lit("{"), F.array_join(F.concat(pairs, added), ","), F.lit("}"))


def quoted(value: Column) -> Column:
    """JSON text of a string column, ``null`` for null."""
    return F.coalesce(json_quote(value), F.lit("null"))


def json_time(value: Column, kind: str) -> Column:
    """JSON text of a timestamp, or of epoch seconds."""
    stamp = value if kind.startswith("timestamp") else F.timestamp_seconds(value)
    return quoted(F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def json_object(fields: Mapping[str, Column]) -> Column:
    """JSON object of JSON texts in order; fields whose text is null are left out."""
    pairs = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def content_elements(raw: Column) -> Column:
    """Array elements of message.content as texts; null when the content is not an array."""
    return F.from_json(raw, ARRAY_SCHEMA)["message"]["content"]


def is_bare(raw: Column) -> Column:
    """Per element: is it a plain string rather than an object?"""
    return F.transform(F.from_json(raw, VARIANT_SCHEMA)["message"]["content"], lambda v: F.schema_of_variant(v) == "STRING")


def parse_block(element: Column, bare: Column, idx: Column) -> Column:
    """One content element as a struct with fixed fields."""
    b = F.from_json(element, BLOCK_SCHEMA)
    subs = F.transform(
        F.from_json(element, "content ARRAY<STRING>")["content"],
        lambda s: F.from_json(s, "type STRING, text STRING, source STRUCT<data: STRING>"),
    )
    listed = subs.isNotNull()
    whole = F.array_join(F.transform(subs, lambda s: F.coalesce(s["text"], F.lit(""))), "\n")
    plain = F.array_join(F.transform(subs, lambda s: F.when(s["type"] == "text", F.coalesce(s["text"], F.lit(""))).otherwise(F.lit(""))), "")
    picture = F.aggregate(
        subs,
        F.lit(0).cast("bigint"),
        lambda n, s: n + F.when(s["type"] == "image", F.coalesce(F.length(s["source"]["data"]), F.lit(0))).otherwise(F.lit(0)),
    )
    is_result = b["type"] == "tool_result"
    no_text = F.lit(None).cast("string")
    return F.struct(
        idx.cast("int").alias("block_idx"),
        F.when(bare, F.lit("bare")).otherwise(b["type"]).alias("type"),
        F.when(bare, element).otherwise(b["text"]).alias("text"),
        F.when(bare, no_text).otherwise(b["thinking"]).alias("thinking"),
        F.when(bare, no_text).otherwise(b["signature"]).alias("signature"),
        F.when(bare, no_text).otherwise(F.coalesce(b["id"], b["tool_use_id"])).alias("tool_id"),
        F.when(bare, no_text).otherwise(b["name"]).alias("tool"),
        F.when(~bare & (b["type"] == "tool_use"), F.coalesce(b["input"], F.lit("{}"))).alias("args"),
        F.when(~bare & is_result, F.when(listed, whole).otherwise(F.coalesce(b["content"], F.lit("")))).alias("result_text"),
        F.when(~bare & is_result, F.when(listed, plain).otherwise(F.coalesce(b["content"], F.lit("")))).alias("result_concat"),
        F.when(~bare & is_result, F.coalesce(picture, F.lit(0)).cast("bigint")).alias("image_chars"),
        F.when(~bare & is_result, F.coalesce(b["is_error"], F.lit(False))).alias("is_error"),
        (~bare & ~listed & b["content"].isNotNull()).alias("content_is_string"),
    )


def content_blocks(raw: Column) -> Column:
    elements, bare = content_elements(raw), is_bare(raw)
    return F.transform(elements, lambda e, i: parse_block(e, F.element_at(bare, i + 1), i))


def block_text(b: Column) -> Column:
    """What one block adds to the message text; unknown kinds add an empty line."""
    return (
        F.when(b["type"].isin("bare", "text"), F.coalesce(b["text"], F.lit("")))
        .when(b["type"] == "thinking", F.coalesce(b["thinking"], F.lit("")))
        .when(b["type"] == "tool_use", b["args"])
        .when(b["type"] == "tool_result", b["result_text"])
        .otherwise(F.lit(""))
    )


def message_text(content: Column, blocks: Column) -> Column:
    joined = F.array_join(F.transform(blocks, block_text), "\n")
    return F.when(blocks.isNotNull(), joined).otherwise(F.coalesce(content, F.lit("")))


def opens_turn(kind: Column, content: Column, blocks: Column) -> Column:
    typed = F.exists(blocks, lambda b: (F.length(b["type"]) > 0) & (b["type"] != "tool_result"))
    return F.coalesce((kind == "user") & F.when(blocks.isNotNull(), typed).otherwise(content.isNotNull()), F.lit(False))


def real_user(kind: Column, role: Column, content: Column, blocks: Column) -> Column:
    typed = F.exists(blocks, lambda b: (b["type"] == "text") & ~is_blank(b["text"]))
    who = F.when(F.length(role) > 0, role).otherwise(kind)
    return F.coalesce((who == "user") & F.when(blocks.isNotNull(), typed).otherwise(~is_blank(content)), F.lit(False))


def plain_chars(content: Column, blocks: Column) -> Column:
    """Characters of string content, or of the string fields of the blocks."""
    per_block = F.aggregate(
        blocks,
        F.lit(0).cast("bigint"),
        lambda n, b: n
        + F.when((b["type"] != "bare") & b["text"].isNotNull(), F.length(b["text"]))
        .when(b["content_is_string"], F.length(b["result_text"]))
        .otherwise(F.lit(0)),
    )
    return F.when(blocks.isNotNull(), per_block).otherwise(F.coalesce(F.length(content), F.lit(0))).cast("bigint")


def typed_text(content: Column, blocks: Column) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(blocks.isNotNull(), F.array_join(texts, "")).otherwise(content)
