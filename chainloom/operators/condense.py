"""Block condensation: pair calls with results, find superseded content, resolve, record.

Every mode returns candidates with the same columns (``CANDIDATE``); ``build_condense_plan``
decides which of them apply.  Positions are chain positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions import content as ct
from chainloom.functions import markers as mk
from chainloom.functions.text import json_quote, line_count
from chainloom.functions.tools import FILE_TOOLS, _set, json_arg
from chainloom.operators.scan import scan
from chainloom.operators.storage import materialise

LOOK_AHEAD = 4
KEEP_RECENT_TURNS = 30
IDENTICAL_MIN, MEMORY_MIN, STALE_MIN, SNAPSHOT_MIN, THINKING_MIN, IMAGE_MIN = 1024, 256, 500, 500, 400, 1024
ARGS_MIN, ARGS_PREVIEW = 300, 100

MODES = ("identical-reads", "memory-reads", "images", "stale-reads", "mcp-snapshots", "thinking", "refetch-markers", "tool-args")
ENTRY_LEVEL = ("images", "stale-reads", "mcp-snapshots", "refetch-markers")
CANDIDATE = ["conv", "uuid", "block_idx", "mode", "call_pos", "call_idx", "original_bytes", "condensed_bytes", "saved", "new_value", "summary_source"]

# Which paths are memory files, which tools report a state, which results can be read again.
MEMORY_PATHS = (r"/MEMORY\.md$", r"/CLAUDE\.md$", r"/memory/[^/]+\.md$", r"/plans/[^/]+\.md$")
SNAPSHOT_TOOLS = (
    "mcp__orchestrator__get_suggestions",
    "mcp__orchestrator__get_session_info",
    "mcp__orchestrator__get_session_output",
    "mcp__orchestrator__list_sessions",
    "mcp__orchestrator__list_workers",
    "mcp__orchestrator__get_orchestrators",
    "mcp__worker__get_my_tasks",
    "mcp__worker__who_am_i",
    "mcp__worker__list_file_locks",
)
REFETCH_TOOLS = ("Read", "Bash", "Grep", "Glob", "WebFetch", "WebSearch", *FILE_TOOLS, *SNAPSHOT_TOOLS, "mcp__db-proxy__db_query")
IMAGE_PATH = r"(?i)\.(png|jpe?g|gif|webp|bmp|svg|ico|tiff?)$"
LONG_ARGS = {"TaskCreate": ("description",), "mcp__orchestrator__create_session": ("initialTask",), "mcp__orchestrator__assign_task": ("task",)}
EDIT_ARGS = {
    "Edit": ("old_string", "new_string"),
    "Write": ("content",),
    "mcp__codegen__manualFileEdit": ("old_string", "new_string"),
    "mcp__codegen__manualFileWrite": ("content",),
}


def pair_calls(blocks: DataFrame) -> DataFrame:
    """Each call with the first result of its id within the next four chain rows.

    The band join runs on narrow keys: a call looks into the at most two four-row bands its
    window touches, so a band never holds more than a few rows even if one id is everywhere.
    The output is narrow: of the result text only its size, digest, form and section heads.
    """
    calls = blocks.filter((F.col("type") == "tool_use") & F.col("tool_id").isNotNull())
    results = blocks.filter((F.col("type") == "tool_result") & F.col("tool_id").isNotNull())
    band = F.floor(F.col("r_pos") / LOOK_AHEAD)
    first, last = F.floor((F.col("call_pos") + 1) / LOOK_AHEAD), F.floor((F.col("call_pos") + LOOK_AHEAD) / LOOK_AHEAD)
    left = calls.select("conv", "tool_id", F.col("pos").alias("call_pos"), F.col("block_idx").alias("call_idx")).withColumn(
        "band", F.explode(F.sequence(first, last))
    )
    right = results.select("conv", "tool_id", F.col("pos").alias("r_pos"), F.col("block_idx").alias("r_idx"), F.col("uuid").alias("r_uuid")).withColumn("band", band)
    near = (F.col("r_pos") > F.col("call_pos")) & (F.col("r_pos") <= F.col("call_pos") + LOOK_AHEAD)
    pairs = (
        left.join(right, ["conv", "tool_id", "band"])
        .filter(near)
        .groupBy("conv", "call_pos", "call_idx")
        .agg(F.min(F.struct("r_pos", "r_idx", "r_uuid")).alias("r"))
        .select(
            "conv", "call_pos", "call_idx", F.col("r.r_pos").alias("result_pos"), F.col("r.r_idx").alias("result_idx"), F.col("r.r_uuid").alias("result_uuid")
        )
    )
    carried = [c for c in ("turn_id", "total_turns") if c in blocks.columns]
    call_side = calls.select(
        "conv",
        F.col("pos").alias("call_pos"),
        F.col("block_idx").alias("call_idx"),
        F.col("uuid").alias("call_uuid"),
        "tool_id",
        "tool",
        "args",
        json_arg("file_path").alias("path"),
        *carried,
    )
    text = result_body(blocks)
    images = F.coalesce("image_chars", F.lit(0)) if "image_chars" in blocks.columns else F.lit(0)
    result_side = results.select(
        "conv",
        F.col("pos").alias("result_pos"),
        F.col("block_idx").alias("result_idx"),
        F.col("uuid").alias("result_uuid"),
        F.length(text).cast("bigint").alias("chars"),
        images.cast("bigint").alias("image_chars"),
        F.sha2(text, 256).alias("digest"),
        image_form(text).alias("image_form"),
        line_count(text).alias("lines"),
        F.when(F.length(text) >= mk.REFETCH_MIN, mk.section_summary(text)).alias("sections"),
    )
    return pairs.join(call_side, ["conv", "call_pos", "call_idx"]).join(result_side, ["conv", "result_pos", "result_idx", "result_uuid"])


def result_body(blocks: DataFrame) -> Column:
    parts = [c for c in ("result_concat", "result_text") if c in blocks.columns]
    return F.coalesce(*parts, F.lit(""))


def image_form(text: Column, sample_chars: int | None = None) -> Column:
    """'uri' for a data URI, 'raw' for text that is nearly all base64 characters, else null.

    All of the text is looked at, or its first ``sample_chars`` characters.
    """
    sample = text if sample_chars is None else F.left(text, F.lit(sample_chars))
    odd = F.length(F.regexp_replace(sample, "[A-Za-z0-9+/=]+", ""))
    return F.when(
        F.length(text) >= IMAGE_MIN,
        F.when(F.startswith(text, F.lit("data:image/")), "uri").when(odd / F.length(sample) < 0.05, "raw"),
    )


def _candidate(df: DataFrame, mode: str | Column, value: Column, *, condensed: Column | None = None, saved: Column | None = None, source: Column | None = None) -> DataFrame:
    original = F.col("original_bytes")
    return df.withColumn("new_value", value).select(
        "conv",
        F.col("uuid"),
        F.col("block_idx").cast("int").alias("block_idx"),
        (mode if isinstance(mode, Column) else F.lit(mode)).alias("mode"),
        F.col("call_pos").cast("bigint").alias("call_pos"),
        F.col("call_idx").cast("int").alias("call_idx"),
        original.cast("bigint").alias("original_bytes"),
        (condensed if condensed is not None else F.lit(0)).cast("bigint").alias("condensed_bytes"),
        (saved if saved is not None else original).cast("bigint").alias("saved"),
        "new_value",
        (source if source is not None else F.lit(None)).cast("string").alias("summary_source"),
    )


def _result_rows(calls: DataFrame) -> DataFrame:
    return calls.withColumnsRenamed({"result_uuid": "uuid", "result_idx": "block_idx"}).withColumn("original_bytes", F.col("chars"))


def _reads(calls: DataFrame) -> DataFrame:
    return _result_rows(calls.filter((F.col("tool") == "Read") & (F.length("path") > 0)))


def _latest(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add the last row of each key (position, uuid, digest) and whether this row is older.

    Texts are compared by digest, so no body is copied along a key; the scan cuts hot keys.
    """
    last = F.struct("call_pos", "call_idx", F.col("uuid").alias("by"), "digest")
    seen = scan(df, keys, ["call_pos", "call_idx"], totals={out: ("max", last)})
    older = F.struct("call_pos", "call_idx") < F.struct(F.col(f"{out}.call_pos").alias("call_pos"), F.col(f"{out}.call_idx").alias("call_idx"))
    return seen.withColumn(f"{out}_older", older)


def is_memory_path(path: Column, patterns: tuple[str, ...] = MEMORY_PATHS) -> Column:
    return path.rlike("(?i)(" + "|".join(patterns) + ")")


def _read_marker(latest: str, reason: str) -> Column:
    return mk.stale_read_marker(F.col("chars"), F.col("path"), F.col(f"{latest}.by"), reason)


def _identical() -> tuple[Column, Column]:
    same = F.col("same_older") & (F.col("chars") > IDENTICAL_MIN) & (F.col("digest") == F.col("same.digest"))
    return same, _read_marker("same", "byte-identical to a later read")


def _memory(patterns: tuple[str, ...]) -> tuple[Column, Column]:
    old = F.col("same_older") & (F.col("chars") >= MEMORY_MIN) & is_memory_path(F.col("path"), patterns)
    return old, _read_marker("same", "older memory-style read superseded by later read")


def _image() -> tuple[Column, Column]:
    raw = (F.col("image_form") == "raw") & F.col("path").rlike(IMAGE_PATH)
    shown = (F.col("image_chars") > IMAGE_MIN) | F.coalesce((F.col("image_form") == "uri") | raw, F.lit(False))
    return shown, mk.image_marker(F.col("chars") + F.col("image_chars"), F.col("path"))


def _stale() -> tuple[Column, Column]:
    return F.col("args_older") & (F.col("chars") >= STALE_MIN), _read_marker("args_latest", "older read of same path/offset/limit superseded")


def _with_read_args(reads: DataFrame) -> DataFrame:
    keyed = reads.withColumns({f"k_{n}": F.when(_set(json_arg(n)), json_arg(n)).otherwise(F.lit("")) for n in ("offset", "limit")})
    return _latest(keyed, ["conv", "path", "k_offset", "k_limit"], "args_latest").withColumnRenamed("args_latest_older", "args_older")


def condense_identical_reads(calls: DataFrame) -> DataFrame:
    """Earlier reads of a path whose text equals the latest read's."""
    hit, value = _identical()
    return _candidate(_latest(_reads(calls), ["conv", "path"], "same").filter(hit), "identical-reads", value)


def condense_memory_reads(calls: DataFrame, patterns: tuple[str, ...] = MEMORY_PATHS) -> DataFrame:
    """All but the last read of memory-style paths; pass more patterns for other note folders."""
    hit, value = _memory(patterns)
    reads = _reads(calls).filter(is_memory_path(F.col("path"), patterns))
    return _candidate(_latest(reads, ["conv", "path"], "same").filter(hit), "memory-reads", value)


def condense_images(calls: DataFrame) -> DataFrame:
    """Image content of reads."""
    hit, value = _image()
    rows = _reads(calls).filter(hit).withColumn("original_bytes", F.col("chars") + F.col("image_chars"))
    return _candidate(rows, "images", value)


def condense_stale_reads(calls: DataFrame) -> DataFrame:
    """All but the last read of the same path, offset and limit."""
    hit, value = _stale()
    return _candidate(_with_read_args(_reads(calls)).filter(hit), "stale-reads", value, condensed=F.length("new_value"))


def condense_reads(calls: DataFrame, patterns: tuple[str, ...] = MEMORY_PATHS) -> DataFrame:
    """The four read modes in one pass: two scans instead of one per mode."""
    rows = _with_read_args(_latest(_reads(calls), ["conv", "path"], "same"))
    found = {"identical-reads": _identical(), "memory-reads": _memory(patterns), "images": _image(), "stale-reads": _stale()}
    hits = F.array(*[F.when(hit, F.struct(F.lit(m).alias("mode"), value.alias("value"))) for m, (hit, value) in found.items()])
    rows = rows.withColumn("hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    size = F.col("chars") + F.when(F.col("hit.mode") == "images", F.col("image_chars")).otherwise(F.lit(0))
    rows = rows.withColumn("original_bytes", size)
    marker = F.when(F.col("hit.mode") == "stale-reads", F.length("hit.value")).otherwise(F.lit(0))
    return _candidate(rows.withColumn("size_after", marker), F.col("hit.mode"), F.col("hit.value"), condensed=F.col("size_after"))


def condense_snapshots(calls: DataFrame) -> DataFrame:
    """All but the last result of a state-reporting call with the same arguments as written."""
    names = "|".join(SNAPSHOT_TOOLS)
    state = _result_rows(calls.filter(F.col("tool").rlike(f"(?i)^({names})$") & (F.col("chars") >= SNAPSHOT_MIN)))
    old = _latest(state, ["conv", "tool", "args"], "latest").filter("latest_older")
    return _candidate(old, "mcp-snapshots", mk.snapshot_marker(F.col("chars"), F.col("tool"), F.col("latest.by")), condensed=F.length("new_value"))


def _not_recent(keep_recent: int | None) -> Column:
    total = F.coalesce("total_turns", F.lit(0))
    keep = F.lit(keep_recent) if keep_recent is not None else F.least(F.lit(KEEP_RECENT_TURNS), F.greatest(F.lit(1), F.ceil(total / 2)))
    recent = F.col("turn_id").isNotNull() & (total > 0) & (F.col("turn_id") > total - keep)
    return ~recent


def _summaries(scores: DataFrame) -> DataFrame:
    """Usable turn summaries of a plan: ``(conv, turn_id, turn_summary)``."""
    ok = (F.length("summary") > 0) & (F.col("error").isNull() if "error" in scores.columns else F.lit(True))
    return scores.filter(ok).groupBy("conv", "turn_id").agg(F.max_by("summary", "summary").alias("turn_summary"))


def condense_thinking(
    blocks: DataFrame,
    scores: DataFrame | None = None,
    dropped: DataFrame | None = None,
    *,
    style: str = "minimal",
    keep_recent: int | None = None,
) -> DataFrame:
    """Long thinking outside the recent turns and the turns a plan drops; the block becomes text."""
    size = (F.length(F.coalesce("thinking", F.lit(""))) + F.length(F.coalesce("signature", F.lit("")))).cast("bigint")
    rows = blocks.filter((F.col("type") == "thinking") & (size >= THINKING_MIN)).withColumn("original_bytes", size).filter(_not_recent(keep_recent))
    if dropped is not None:
        rows = rows.join(dropped.select("conv", "turn_id").distinct(), ["conv", "turn_id"], "left_anti")
    if scores is not None:
        rows = rows.join(_summaries(scores), ["conv", "turn_id"], "left")
    else:
        rows = rows.withColumn("turn_summary", F.lit(None).cast("string"))
    planned = F.col("turn_summary").isNotNull()
    has_text = F.length(F.coalesce("thinking", F.lit(""))) > 0
    summary = (
        F.when(planned, F.col("turn_summary"))
        .when(has_text, mk.last_paragraph(F.col("thinking")))
        .otherwise(F.lit("(thinking content was encrypted by Anthropic — only the signature remained)"))
    )
    source = F.when(planned, "pass1").when(has_text, "heuristic-last-paragraph").otherwise("signature-only-no-plan")
    rows = rows.withColumns({"call_pos": F.col("pos"), "call_idx": F.col("block_idx")})
    value = mk.thinking_marker(F.col("original_bytes"), planned, summary, style)
    return _candidate(rows, "thinking", value, condensed=F.length("new_value"), source=source)


def refetch_targets(calls: DataFrame, keep_recent: int | None = None, more_tools: tuple[str, ...] = ()) -> DataFrame:
    """Old, long results of tools that can be called again."""
    able = calls.filter(F.col("tool").isin(*REFETCH_TOOLS, *more_tools) & (F.col("chars") >= mk.REFETCH_MIN))
    return _result_rows(able.filter(_not_recent(keep_recent)))


def condense_refetch(
    calls: DataFrame,
    scores: DataFrame | None = None,
    summaries: DataFrame | None = None,
    *,
    keep_recent: int | None = None,
    more_tools: tuple[str, ...] = (),
) -> DataFrame:
    """Size, summary and re-fetch pointer.  ``summaries`` is (conv, uuid, block_idx, summary)."""
    rows = refetch_targets(calls, keep_recent, more_tools)
    if scores is not None and "turn_id" in calls.columns:
        rows = rows.join(_summaries(scores), ["conv", "turn_id"], "left")
    else:
        rows = rows.withColumn("turn_summary", F.lit(None).cast("string"))
    if summaries is not None:
        rows = rows.join(summaries.select("conv", "uuid", "block_idx", F.col("summary").alias("model_summary")), ["conv", "uuid", "block_idx"], "left")
    else:
        rows = rows.withColumn("model_summary", F.lit(None).cast("string"))
    source = F.when(F.length("model_summary") > 0, "haiku").when(F.length("turn_summary") > 0, "pass1").otherwise("heuristic")
    value = mk.refetch_marker(F.col("tool"), F.col("args"), F.col("chars"), F.col("lines"), F.col("sections"), F.col("model_summary"), F.col("turn_summary"))
    size = F.length("new_value")
    return _candidate(rows, "refetch-markers", value, condensed=size, saved=F.col("original_bytes") - size, source=source)


def condense_tool_args(blocks: DataFrame, clean_files: DataFrame | None = None, *, keep_recent: int | None = None) -> DataFrame:
    """Long text arguments cut to a preview.

    File-changing calls take part only for paths in ``clean_files(path)``, whose content can be
    found again in version control.
    """
    rows = blocks.filter(F.col("type") == "tool_use").filter(_not_recent(keep_recent))
    rows = rows.withColumns({"call_pos": F.col("pos"), "call_idx": F.col("block_idx"), "path": json_arg("file_path")})
    wanted = list(LONG_ARGS)
    if clean_files is not None:
        clean = clean_files.select("path", F.lit(True).alias("clean")).distinct()
        rows = rows.join(clean, "path", "left")
        wanted += list(EDIT_ARGS)
    else:
        rows = rows.withColumn("clean", F.lit(None).cast("boolean"))
    tool = F.col("tool")
    rows = rows.filter(tool.isin(*LONG_ARGS) | (tool.isin(*[t for t in wanted if t in EDIT_ARGS]) & F.coalesce("clean", F.lit(False))))
    names = sorted({f for t in (LONG_ARGS, EDIT_ARGS) for fs in t.values() for f in fs})
    typed = F.from_json("args", "map<string,variant>")
    edits, cut_chars = {}, F.lit(0)
    for name in names:
        tools = [t for group in (LONG_ARGS, EDIT_ARGS) for t, fs in group.items() if name in fs]
        value = json_arg(name)
        is_text = F.schema_of_variant(typed[name]) == "STRING"
        long = F.coalesce(tool.isin(*tools) & is_text & (F.length(value) >= ARGS_MIN), F.lit(False))
        hint = F.when(
            tool.isin(*EDIT_ARGS) & (F.length("path") > 0),
            F.concat(F.lit(" See `git log -p "), F.col("path"), F.lit("` for diff history; file was git-clean at condense time.")),
        ).otherwise(F.lit(" Full original in .condense-backups/."))
        short = F.concat(
            F.left(value, F.lit(ARGS_PREVIEW)), F.lit("... ["), (F.length(value) - ARGS_PREVIEW).cast("string"), F.lit(" more chars elided."),
            hint, F.lit(" Tool: "), tool, F.lit(f", field: {name}]"),
        )
        edits[name] = (long, short)
        cut_chars = cut_chars + F.when(long, F.length(value)).otherwise(F.lit(0))
    rows = rows.withColumn("original_bytes", cut_chars).filter(F.col("original_bytes") > 0)
    shown = F.from_json("args", "map<string,string>")

    def pair(e: Column) -> Column:
        kept = F.when(e["value"].isNull(), F.lit("null")).when(F.schema_of_variant(typed[e["key"]]) == "STRING", json_quote(e["value"])).otherwise(e["value"])
        for name, (long, short) in edits.items():
            kept = F.when((e["key"] == name) & long, json_quote(short)).otherwise(kept)
        return F.concat(json_quote(e["key"]), F.lit(":"), kept)

    value = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(shown), pair), ","), F.lit("}"))
    size = F.length("new_value")
    return _candidate(rows, "tool-args", value, condensed=size, saved=F.col("original_bytes") - size)


def build_condense_plan(
    candidates: list[DataFrame], state: DataFrame | None = None, *, upgrade: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replacements, stats, records) out of mode candidates.

    Modes act in the order of ``MODES``.  Blocks already in ``state`` are left out, except that
    with ``upgrade`` a re-fetch block whose summary is not from a model is done again.  Memory
    reads give way in entries owned by identical reads; images, stale reads, snapshots and
    re-fetch markers act once per entry and only in entries no earlier mode touched.
    """
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    if state is not None:
        known = state.select("conv", "uuid", "block_idx", F.lit(True).alias("known"), F.col("summary_source").alias("had"))
        again = F.lit(upgrade) & (F.col("mode") == "refetch-markers") & (F.coalesce("had", F.lit("heuristic")) != "haiku")
        every = every.join(known, ["conv", "uuid", "block_idx"], "left").filter(F.col("known").isNull() | again).drop("known", "had")
    rank = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode"))
    # An entry is one transcript line, so this window is bounded by the size of a line.
    entry = W.partitionBy("conv", "uuid")
    ranked = every.withColumn("rank", rank).withColumns(
        {"first_rank": F.min("rank").over(entry), "nth": F.row_number().over(W.partitionBy("conv", "uuid", "rank").orderBy("call_pos", "call_idx", "block_idx"))}
    )
    single = F.col("mode").isin(*ENTRY_LEVEL)
    wins = (
        F.when(single, (F.col("rank") == F.col("first_rank")) & (F.col("nth") == 1))
        .when(F.col("mode") == "memory-reads", F.col("first_rank") == F.col("rank"))
        .otherwise(F.lit(True))
    )
    replacements = ranked.filter(wins).select(*CANDIDATE)
    stats = replacements.groupBy("conv", "mode").agg(F.count(F.lit(1)).alias("blocks"), F.sum("saved").alias("saved"))
    records = replacements.select("conv", "uuid", "block_idx", "mode", "original_bytes", "condensed_bytes", "summary_source")
    return replacements, stats, records


def apply_to_blocks(blocks: DataFrame, replacements: DataFrame) -> DataFrame:
    """Block table after condensation: results and arguments replaced, thinking turned into text."""
    change = replacements.select("conv", "uuid", "block_idx", F.col("mode").alias("__mode"), F.col("new_value").alias("__new"))
    joined = blocks.join(change, ["conv", "uuid", "block_idx"], "left")
    mode, new = F.col("__mode"), F.col("__new")
    thought, args = mode == "thinking", mode == "tool-args"
    result = mode.isNotNull() & ~thought & ~args
    edits = {
        "type": F.when(thought, F.lit("text")),
        "text": F.when(thought, new),
        "args": F.when(args, new),
        "result_text": F.when(result, new),
        "result_concat": F.when(result, new),
    }
    out = joined.withColumns({c: F.coalesce(e, F.col(c)) for c, e in edits.items() if c in blocks.columns})
    gone = {c: F.when(thought, F.lit(None)).otherwise(F.col(c)) for c in ("thinking", "signature") if c in blocks.columns}
    if "image_chars" in blocks.columns:
        gone["image_chars"] = F.when(result, F.lit(0)).otherwise(F.col("image_chars")).cast("bigint")
    return (out.withColumns(gone) if gone else out).select(*blocks.columns)


def apply_to_raw(messages: DataFrame, replacements: DataFrame) -> DataFrame:
    """(conv, uuid, raw) of the changed lines: edited blocks, all other JSON as it was."""
    per_line = replacements.groupBy("conv", "uuid").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("block_idx"), F.struct("mode", "new_value")))).alias("edits"),
        F.array_join(
            F.transform(F.array_sort(F.collect_set(F.struct(F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode")).alias("r"), "mode"))), lambda s: s["mode"]),
            "+",
        ).alias("source"),
    )
    rows = messages.select("conv", "uuid", "raw").join(per_line, ["conv", "uuid"])
    rows = rows.withColumns(
        {"elements": ct.content_elements(F.col("raw")), "bare": ct.is_bare(F.col("raw")), "msg": F.get_json_object("raw", "$.message")}
    )

    def element(e: Column, i: Column) -> Column:
        edit = F.col("edits")[i.cast("int")]
        text = json_quote(edit["new_value"])
        as_text = F.concat(F.lit('{"type":"text","text":'), text, F.lit("}"))
        kept = F.when(F.element_at("bare", i + 1), json_quote(e)).otherwise(e)
        return (
            F.when(edit.isNull(), kept)
            .when(edit["mode"] == "thinking", as_text)
            .when(edit["mode"] == "tool-args", ct.edit_json(e, {"input": edit["new_value"]}))
            .when(edit["mode"] == "images", ct.edit_json(e, {"content": F.concat(F.lit("["), as_text, F.lit("]"))}))
            .otherwise(ct.edit_json(e, {"content": text}))
        )

    content = F.concat(F.lit("["), F.array_join(F.transform("elements", element), ","), F.lit("]"))
    rows = rows.withColumn("content", content).withColumn("msg", ct.edit_json(F.col("msg"), {"content": F.col("content")}))
    marked = ct.edit_json(F.col("raw"), {"message": F.col("msg"), "_condensed": F.lit("true"), "_condenseSource": json_quote(F.col("source"))})
    return rows.select("conv", "uuid", marked.alias("raw"))


def condense_state_summary(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, by_mode) per conversation."""
    # Blocks of one entry are merged first, so the entry count needs no distinct over a hot key.
    entries = state.groupBy("conv", "uuid").agg(
        F.count(F.lit(1)).alias("b"), F.sum("original_bytes").alias("o"), F.sum("condensed_bytes").alias("c")
    )
    totals = entries.groupBy("conv").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("b").alias("blocks"),
        F.sum("o").alias("original_bytes"),
        F.sum("c").alias("condensed_bytes"),
    )
    by_mode = state.groupBy("conv", F.coalesce("mode", F.lit("unknown")).alias("mode")).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.col("original_bytes") - F.col("condensed_bytes")).alias("saved")
    )
    return totals, by_mode


def fully_condensed(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries whose every block is in the state."""
    known = state.select("conv", "uuid", "block_idx", F.lit(1).alias("hit")).distinct()
    return (
        blocks.select("conv", "uuid", "block_idx")
        .join(known, ["conv", "uuid", "block_idx"], "left")
        .groupBy("conv", "uuid")
        .agg(F.count(F.lit(1)).alias("blocks"), F.count("hit").alias("done"))
        .filter("blocks = done")
        .select("conv", "uuid", "blocks")
    )


def upsert_state(state: DataFrame, records: DataFrame) -> DataFrame:
    """State with the records written over it."""
    keys = ["conv", "uuid", "block_idx"]
    cols = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.struct(*cols).alias("old"))
    new = records.select(*keys, F.struct(*[F.col(c) if c in records.columns else F.lit(None).alias(c) for c in cols]).alias("new"))
    return old.join(new, keys, "full").select(*keys, *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in cols])


def match_plan(plans: DataFrame, chain_stats: DataFrame) -> DataFrame:
    """Newest two-pass plan made for exactly the present chain."""
    fits = plans.filter(F.col("schema_version") == "v2-two-pass").join(
        chain_stats.select("conv", "last_uuid", "chain_length"), ["conv", "last_uuid", "chain_length"]
    )
    return fits.groupBy("conv").agg(F.max_by("plan_id", F.struct("mtime", "plan_id")).alias("plan_id"))


def condense_modes(blocks: DataFrame, scores: DataFrame | None = None, summaries: DataFrame | None = None, **options) -> list[DataFrame]:
    """Candidates of every mode.  The narrow call table is written once and read by each mode."""
    return modes_of(materialise(pair_calls(blocks), "calls"), blocks, scores, summaries, **options)


def modes_of(
    calls: DataFrame, blocks: DataFrame, scores: DataFrame | None = None, summaries: DataFrame | None = None, **options
) -> list[DataFrame]:
    """Candidates of every mode: of thinking and arguments from ``blocks``, of all others from narrow ``calls``."""
    recent = {"keep_recent": options.get("keep_recent")}
    found = [condense_reads(calls, options.get("memory_paths", MEMORY_PATHS)), condense_snapshots(calls)]
    if "thinking" in blocks.columns:
        found.append(condense_thinking(blocks, scores, options.get("dropped"), style=options.get("style", "minimal"), **recent))
    found.append(condense_refetch(calls, scores, summaries, more_tools=options.get("more_tools", ()), **recent))
    found.append(condense_tool_args(blocks, options.get("clean_files"), **recent))
    return found


def live_calls(calls: DataFrame, condensed: DataFrame) -> DataFrame:
    """The calls that later ones can still supersede, or that supersede earlier ones.

    That is what is large enough for a mode and not yet ``condensed(conv, uuid, block_idx)``, and the latest call of every
    key the modes compare by.
    """
    done = condensed.select("conv", F.col("uuid").alias("result_uuid"), F.col("block_idx").alias("result_idx"), F.lit(True).alias("__done")).distinct()
    read = (F.col("tool") == "Read") & (F.length("path") > 0)
    state = F.col("tool").rlike("(?i)^(" + "|".join(SNAPSHOT_TOOLS) + ")$") & (F.col("chars") >= SNAPSHOT_MIN)
    keys = {"__path": F.when(read, F.col("path")), "__tool": F.when(state, F.col("tool")), "__args": F.when(state, F.col("args"))}
    keys |= {f"__{n}": F.when(read & _set(json_arg(n)), json_arg(n)) for n in ("offset", "limit")}
    rows = calls.join(done, ["conv", "result_uuid", "result_idx"], "left")
    rows = rows.withColumns({n: F.coalesce(k, F.lit("")) for n, k in keys.items()} | {"uuid": F.col("result_uuid")})
    rows = _latest(rows, ["conv", "__path"], "__any")
    rows = _latest(rows, ["conv", "__path", "__offset", "__limit"], "__same")
    rows = _latest(rows, ["conv", "__tool", "__args"], "__state")
    large = (F.col("chars") >= min(MEMORY_MIN, STALE_MIN, SNAPSHOT_MIN, mk.REFETCH_MIN)) | (F.col("image_chars") > IMAGE_MIN)
    latest = (F.length("__path") > 0) & ~(F.col("__any_older") & F.col("__same_older")) | (F.length("__tool") > 0) & ~F.col("__state_older")
    return rows.filter(F.col("__done").isNull() & large | latest).select(*calls.columns)


def open_calls(blocks: DataFrame, calls: DataFrame, last: DataFrame) -> DataFrame:
    """Call blocks without a result whose window reaches beyond ``last(conv, last_pos)``."""
    paired = calls.select("conv", F.col("call_pos").alias("pos"), F.col("call_idx").alias("block_idx"))
    unpaired = blocks.filter((F.col("type") == "tool_use") & F.col("tool_id").isNotNull()).join(paired, ["conv", "pos", "block_idx"], "left_anti")
    return unpaired.join(last, "conv").filter(F.col("pos") + LOOK_AHEAD > F.col("last_pos")).select(*blocks.columns)


def waiting_blocks(blocks: DataFrame, condensed: DataFrame, keep_recent: int | None = None) -> DataFrame:
    """Thinking and long-argument blocks whose turn is still recent: a mode may take them once it is not."""
    kept = F.col("type") == "tool_use"
    kept &= F.col("tool").isin(*LONG_ARGS, *EDIT_ARGS) & (F.length("args") >= ARGS_MIN)
    if "thinking" in blocks.columns:
        kept |= F.col("type") == "thinking"
    rows = blocks.filter(kept).filter(~_not_recent(keep_recent))
    return rows.join(condensed.select("conv", "uuid", "block_idx"), ["conv", "uuid", "block_idx"], "left_anti").select(*blocks.columns)


def with_bodies(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Re-fetch targets with the result text, for a summariser."""
    bodies = blocks.filter(F.col("type") == "tool_result").select("conv", "uuid", "block_idx", result_body(blocks).alias("content"))
    return targets.join(bodies, ["conv", "uuid", "block_idx"])
