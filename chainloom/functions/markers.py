"""Texts that stand in for condensed blocks.

Fixed values: the wording of the markers, since later runs and readers recognise it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainloom.functions.text import json_quote, let, one_decimal_kb, trim_blank, whole_kb
from chainloom.functions.tools import FILE_TOOLS, _set, json_arg

REFETCH_MIN = 600
SECTIONS, SECTION_CHARS = 8, 120


def _path(path: Column) -> Column:
    return F.when(F.length(path) > 0, path).otherwise(F.lit("<unknown path>"))


def _short(uuid: Column) -> Column:
    return F.when(F.length(uuid) > 0, F.left(uuid, F.lit(8))).otherwise(F.lit("?"))


def image_marker(chars: Column, path: Column) -> Column:
    return F.concat(F.lit("[image elided: ~"), whole_kb(chars), F.lit(" KB base64, was Read of "), _path(path), F.lit("]"))


def stale_read_marker(chars: Column, path: Column, superseded_by: Column, reason: str) -> Column:
    return F.concat(
        F.lit("[stale read elided: "), one_decimal_kb(chars), F.lit(" KB, "), _path(path), F.lit(f", {reason}; superseded by uuid "), _short(superseded_by), F.lit("]")
    )


def snapshot_marker(chars: Column, tool: Column, superseded_by: Column) -> Column:
    return F.concat(
        F.lit("[stale MCP snapshot elided: "), one_decimal_kb(chars), F.lit(" KB from "), tool, F.lit("; superseded by uuid "), _short(superseded_by), F.lit("]")
    )


def thinking_marker(chars: Column, from_plan: Column, summary: Column, style: str) -> Column:
    if style == "minimal":
        return F.lit("[thinking elided]")
    label = F.when(from_plan, F.lit("turn outcome: ")).otherwise(F.lit("heuristic last-paragraph kept: "))
    return F.concat(F.lit("[thinking elided ~"), one_decimal_kb(chars), F.lit(" KB; "), label, summary, F.lit("]"))


def _sections(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n"), trim_blank)
    return F.filter(parts, lambda s: F.length(s) > 0)


def _head(section: Column) -> Column:
    return let(
        trim_blank(F.substring_index(section, "\n", 1)),
        lambda h: F.when(F.length(h) > SECTION_CHARS, F.concat(F.left(h, F.lit(SECTION_CHARS)), F.lit("..."))).otherwise(h),
    )


def section_summary(text: Column) -> Column:
    """First line of each of the first eight blank-line-separated sections."""

    def summary(parts: Column) -> Column:
        more = F.size(parts) - SECTIONS
        rest = F.when(more > 0, F.array(F.concat(F.lit("... ["), more.cast("string"), F.lit(" more sections]")))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(F.transform(F.slice(parts, 1, SECTIONS), _head), rest), "\n  ")

    return let(_sections(F.coalesce(text, F.lit(""))), summary)


def last_paragraph(text: Column) -> Column:
    """Last paragraph; else the last two sentences; else the last 500 characters."""

    def tail(whole: Column) -> Column:
        sentences = F.filter(F.split(whole, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
        ending = let(
            sentences,
            lambda s: F.when(F.size(s) >= 2, F.array_join(F.slice(s, -2, 2), " ")).otherwise(F.right(whole, F.lit(500))),
        )
        return let(_sections(whole), lambda p: F.when(F.size(p) >= 2, F.element_at(p, -1)).otherwise(ending))

    return let(trim_blank(F.coalesce(text, F.lit(""))), tail)


def refetch_marker(tool: Column, args: Column, chars: Column, lines: Column, sections: Column, model: Column, turn: Column) -> Column:
    """Size, best summary (model, then turn, then sections) and how to get the content again."""

    def arg(name: str) -> Column:
        return json_arg(name, args)

    has_model, has_turn = F.length(model) > 0, F.length(turn) > 0
    source = (
        F.when(has_model, F.lit("Haiku"))
        .when(has_turn, F.lit("analyze-v2 Pass 1 turn outcome"))
        .otherwise(F.lit("heuristic (first line of each section split by blank lines)"))
    )
    summary = (
        F.when(has_model, model)
        .when(has_turn, turn)
        .otherwise(F.when(F.length(sections) > 0, sections).otherwise(F.lit("(no clear sections — content was a single block)")))
    )
    has_path = F.length(arg("file_path")) > 0
    extra = F.concat(*[F.when(_set(arg(n)), F.concat(F.lit(f", {n}: "), arg(n))).otherwise(F.lit("")) for n in ("offset", "limit")])
    path = json_quote(arg("file_path"))
    again = (
        F.when(
            (tool == "Read") & has_path,
            F.concat(F.lit("Read({file_path: "), path, extra, F.lit("}) — gives current file state, not the historical snapshot")),
        )
        .when(
            (tool == "Bash") & (F.length(arg("command")) > 0),
            F.concat(F.lit("Bash({command: "), json_quote(arg("command")), F.lit("}) — RE-RUN ONLY IF SAFE; some commands have side effects.")),
        )
        .when(
            tool.isin(*FILE_TOOLS) & has_path,
            F.concat(
                F.lit("Read({file_path: "), path,
                F.lit("}) — gives the file's CURRENT state. The original tool_result was a snapshot at edit time; the live file may have changed since."),
            ),
        )
        .when((tool == "Grep") & (F.length(arg("pattern")) > 0), F.lit("Grep with same args (pattern + path filters) for current matches"))
        .when(F.startswith(tool, F.lit("mcp__")), F.concat(tool, F.lit("("), F.coalesce(args, F.lit("{}")), F.lit(") — re-call for current state")))
        .otherwise(F.concat(F.lit("re-call "), tool, F.lit(" with the same args")))
    )
    return F.concat(
        F.lit("["), tool, F.lit(" tool_result elided — ~"), one_decimal_kb(chars), F.lit(" KB, "), lines.cast("string"),
        F.lit(" lines]\n\nSUMMARY ("), source, F.lit("):\n  "), F.replace(summary, F.lit("\n"), F.lit("\n  ")),
        F.lit("\n\nRE-FETCH for full original content:\n  "), again,
        F.lit(
            "\n\nWhy elided: tool_result was older than the most-recent active-state buffer and "
            f"≥{REFETCH_MIN} bytes; condensed to summary+pointer. Original preserved in .condense-backups/."
        ),
    )
