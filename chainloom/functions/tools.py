"""Expressions over tool calls: argument lookup, one-line labels, compact block texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainloom.functions.text import first_line

# Tools labelled by the file they change.
FILE_TOOLS = ("Edit", "Write", "mcp__codegen__manualFileEdit", "mcp__codegen__manualFileWrite")


def json_arg(name: str, args: Column | None = None) -> Column:
    """Top-level argument of a call as text; null when absent."""
    return F.get_json_object(F.col("args") if args is None else args, f"$.{name}")


def _or(c: Column, fallback: str) -> Column:
    return F.when(F.length(c) > 0, c).otherwise(F.lit(fallback))


def _set(c: Column) -> Column:
    """Present and not the empty, zero or false value."""
    return c.isNotNull() & ~c.isin("", "0", "false", "null")


def tool_call_label(tool: Column, args: Column) -> Column:
    """One line that says what a call did."""

    def arg(name: str) -> Column:
        return json_arg(name, args)

    path = _or(arg("file_path"), "(no path)")
    span = F.when(
        _set(arg("offset")),
        F.concat(F.lit(" (offset "), arg("offset"), F.lit(", limit "), F.when(_set(arg("limit")), arg("limit")).otherwise(F.lit("?")), F.lit(")")),
    ).otherwise(F.lit(""))
    note = F.when(F.length(arg("description")) > 0, F.concat(F.lit(" # "), arg("description"))).otherwise(F.lit(""))
    command = F.left(first_line(F.coalesce(arg("command"), F.lit(""))), F.lit(100))
    pairs = F.slice(F.map_entries(F.from_json(args, "map<string,string>")), 1, 3)
    shown = F.transform(
        pairs,
        lambda e: F.concat(
            e["key"],
            F.lit("="),
            F.left(F.coalesce(e["value"], F.lit("null")), F.lit(40)),
            F.when(F.length(e["value"]) > 40, F.lit("…")).otherwise(F.lit("")),
        ),
    )
    return (
        F.when(tool.isin(*FILE_TOOLS), path)
        .when(tool == "Read", F.concat(path, span))
        .when(tool == "Bash", F.concat(command, note))
        .when(
            tool == "Grep",
            F.concat(F.lit('pattern="'), F.coalesce(arg("pattern"), F.lit("")), F.lit('" path='), _or(arg("path"), ".")),
        )
        .when(tool == "Glob", F.concat(F.lit('pattern="'), F.coalesce(arg("pattern"), F.lit("")), F.lit('"')))
        .when(
            tool == "Agent",
            F.concat(_or(arg("subagent_type"), "general-purpose"), F.lit(": "), F.left(F.coalesce(arg("description"), F.lit("")), F.lit(60))),
        )
        .otherwise(_or(F.array_join(shown, ", "), "(no args)"))
    )


def compact_block(block: Column, head: int, tail: int) -> Column:
    """Short text of one block: ``block`` is a struct of type, text, thinking, tool, args, result_text, is_error."""

    def arg(name: str) -> Column:
        return json_arg(name, block["args"])

    path = F.when(F.length(arg("file_path")) > 0, F.concat(F.lit(" "), arg("file_path"))).otherwise(F.lit(""))
    command = F.when(
        F.length(arg("command")) > 0, F.concat(F.lit(" `"), F.left(first_line(arg("command")), F.lit(100)), F.lit("`"))
    ).otherwise(F.lit(""))
    result = F.coalesce(block["result_text"], F.lit(""))
    failed = F.when(F.coalesce(block["is_error"], F.lit(False)), F.lit("[ERROR] ")).otherwise(F.lit(""))
    size = F.length(result)
    long_result = F.concat(
        failed, F.lit("[tool_result "), size.cast("string"), F.lit(" chars] "), F.left(result, F.lit(head)), F.lit("\n...elided...\n"), F.right(result, F.lit(tail))
    )
    return (
        F.when(block["type"] == "text", F.coalesce(block["text"], F.lit("")))
        .when(block["type"] == "thinking", F.concat(F.lit("[thinking: "), F.left(F.coalesce(block["thinking"], F.lit("")), F.lit(300)), F.lit("]")))
        .when(block["type"] == "tool_use", F.concat(F.lit("[tool_use "), block["tool"], path, command, F.lit("]")))
        .when(
            block["type"] == "tool_result",
            F.when(size > head + tail + 100, long_result).otherwise(F.concat(failed, F.lit("[tool_result] "), result)),
        )
    )


def clip_middle(text: Column, limit: int, head_share: float, tail_share: float) -> Column:
    """Keep the head and tail of a text longer than ``limit`` and say how much was left out."""
    head, tail = int(limit * head_share), int(limit * tail_share)
    dropped = (F.length(text) - head - tail).cast("string")
    cut = F.concat(F.left(text, F.lit(head)), F.lit("\n... ["), dropped, F.lit(" chars elided] ...\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, cut).otherwise(text)
