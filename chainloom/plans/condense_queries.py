"""Queries over message content and block condensation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions import markers as mk
from chainloom.functions.text import json_quote, tokens
from chainloom.operators import condense as cd
from chainloom.operators.storage import materialise
from chainloom.plans.registry import query
from chainloom.plans.views import query as sql
from chainloom.plans.views import view
from chainloom.sources.transcripts import explode_blocks, normalise

# ---- content --------------------------------------------------------------------------------


def raw_lines(spark, sf):
    """JSONL lines of F1 with content in six shapes."""
    m = view(spark, sf, "f1_messages")
    q, kind = json_quote(F.col("text")), (F.col("conv") + F.col("line")) % 6
    uid = json_quote(F.col("uuid"))
    parent = F.coalesce(json_quote(F.col("parent_uuid")), F.lit("null"))
    content = (
        F.when(kind == 0, q)
        .when(kind == 1, F.concat(F.lit('[{"type":"text","text":'), q, F.lit("}]")))
        .when(kind == 2, F.concat(F.lit("["), q, F.lit(',{"type":"mystery","x":1.50},{"type":"text","text":'), q, F.lit("}]")))
        .when(
            kind == 3,
            F.concat(F.lit('[{"type":"thinking","thinking":'), q, F.lit(',"signature":"sig"},{"type":"tool_use","id":"t1","name":"Bash","input":{"z":1.50,"command":"ls"}}]')),
        )
        .when(
            kind == 4,
            F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t1","content":[{"type":"text","text":'), q, F.lit('},{"type":"image","source":{"data":"AAAA"}},{"type":"text","text":"end"}],"is_error":true}]')),
        )
        .otherwise(F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t2","content":'), q, F.lit("}]")))
    )
    raw = F.concat(
        F.lit('{"uuid":'), uid, F.lit(',"parentUuid":'), parent, F.lit(',"type":"'), F.col("type"), F.lit('","timestamp":"2026-01-01T00:00:0'),
        (F.col("line") % 10).cast("string"), F.lit('Z","message":{"role":"'), F.col("type"), F.lit('","content":'), content, F.lit("}}"),
    )
    return m.select("conv", "line", raw.alias("raw"))


_KIND = "(conv+line)%6"
_TEXT = f"""CASE {_KIND} WHEN 2 THEN text||chr(10)||chr(10)||text WHEN 3 THEN text||chr(10)||'{{"z":1.5,"command":"ls"}}' WHEN 4 THEN text||chr(10)||chr(10)||'end' ELSE text END"""


@query("message_text", f"SELECT conv, line, uuid, {_TEXT} AS text FROM f1_messages")
def message_text(spark, sf):
    return normalise(raw_lines(spark, sf)).select("conv", "line", "uuid", "text")


@query(
    "normalise_messages",
    f"""SELECT conv, line, uuid, parent_uuid, type, type AS role, FALSE AS is_corrupt, FALSE AS bad_ts, CASE WHEN {_KIND}=0 THEN 'string' ELSE 'array' END AS shape,
      type='user' AND {_KIND} NOT IN (4,5) AS opens_turn, type='user' AND {_KIND} IN (0,1,2) AS real_user,
      CASE WHEN {_KIND}=3 THEN 0 WHEN {_KIND}=4 THEN 0 ELSE length(text) END AS plain_chars, CASE WHEN {_KIND}=3 THEN 1 ELSE 0 END AS n_tool_use,
      CASE WHEN {_KIND} IN (0,1,2) THEN text ELSE '' END AS typed_text FROM f1_messages""",
)
def normalise_messages(spark, sf):
    return normalise(raw_lines(spark, sf)).select(
        "conv", "line", "uuid", "parent_uuid", "type", "role", "is_corrupt", "bad_ts", "shape", "opens_turn", "real_user", "plain_chars", "n_tool_use", "typed_text"
    )


_BLOCK_ROWS = f"""
SELECT conv, line, 0 AS block_idx, CASE {_KIND} WHEN 1 THEN 'text' WHEN 2 THEN 'bare' WHEN 3 THEN 'thinking' ELSE 'tool_result' END AS type,
  CASE WHEN {_KIND} IN (1,2) THEN text END AS text, CASE WHEN {_KIND}=3 THEN text END AS thinking, CASE WHEN {_KIND}=3 THEN 'sig' END AS signature,
  CASE {_KIND} WHEN 4 THEN 't1' WHEN 5 THEN 't2' END AS tool_id, NULL AS tool, NULL AS args,
  CASE {_KIND} WHEN 4 THEN text||chr(10)||chr(10)||'end' WHEN 5 THEN text END AS result_text, CASE {_KIND} WHEN 4 THEN text||'end' WHEN 5 THEN text END AS result_concat,
  CASE {_KIND} WHEN 4 THEN 4 WHEN 5 THEN 0 END AS image_chars, CASE {_KIND} WHEN 4 THEN TRUE WHEN 5 THEN FALSE END AS is_error FROM f1_messages WHERE {_KIND}>0
UNION ALL SELECT conv, line, 1, CASE {_KIND} WHEN 2 THEN 'mystery' ELSE 'tool_use' END, NULL, NULL, NULL, CASE {_KIND} WHEN 3 THEN 't1' END, CASE {_KIND} WHEN 3 THEN 'Bash' END,
  CASE {_KIND} WHEN 3 THEN '{{"z":1.5,"command":"ls"}}' END, NULL, NULL, NULL, NULL FROM f1_messages WHERE {_KIND} IN (2,3)
UNION ALL SELECT conv, line, 2, 'text', text, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f1_messages WHERE {_KIND}=2
"""


@query("explode_blocks", _BLOCK_ROWS)
def blocks(spark, sf):
    return explode_blocks(normalise(raw_lines(spark, sf))).drop("uuid", "role", "content_is_string")


@query(
    "block_tokens",
    f"""SELECT conv, type, count(*) AS blocks, CAST(sum(ceil(length(CASE type WHEN 'thinking' THEN thinking WHEN 'tool_use' THEN args WHEN 'tool_result' THEN result_text WHEN 'mystery' THEN '' ELSE text END)/4.0)) AS BIGINT) AS tokens
        FROM ({_BLOCK_ROWS}) b GROUP BY conv, type""",
)
def block_tokens(spark, sf):
    from chainloom.functions.content import block_text

    rows = normalise(raw_lines(spark, sf)).select("conv", F.explode("blocks").alias("b")).select("conv", F.col("b.type").alias("type"), block_text(F.col("b")).alias("t"))
    return rows.groupBy("conv", "type").agg(F.count(F.lit(1)).alias("blocks"), F.sum(tokens(F.col("t"))).alias("tokens"))


@query(
    "markers",
    f"""SELECT conv, event_id, '[image elided: ~'||CAST(floor(chars*9/1024.0+0.5) AS BIGINT)||' KB base64, was Read of '||path||']' AS image,
      '[stale read elided: '||{"(CAST(floor(floor(chars/1024.0*10+0.5)/10) AS BIGINT)||'.'||CAST(floor(chars/1024.0*10+0.5) AS BIGINT)%10)"}||' KB, '||path||', older; superseded by uuid '||left(call_uuid||'-0123456789',8)||']' AS stale,
      '[thinking elided ~'||{"(CAST(floor(floor(chars/1024.0*10+0.5)/10) AS BIGINT)||'.'||CAST(floor(chars/1024.0*10+0.5) AS BIGINT)%10)"}||' KB; '||CASE WHEN event_id%2=0 THEN 'turn outcome: ' ELSE 'heuristic last-paragraph kept: ' END||tool||']' AS thinking FROM f3_calls_src""",
)
def markers(spark, sf):
    k = view(spark, sf, "f3_calls_src")
    return k.select(
        "conv",
        "event_id",
        mk.image_marker(F.col("chars") * 9, F.col("path")).alias("image"),
        mk.stale_read_marker(F.col("chars"), F.col("path"), F.concat("call_uuid", F.lit("-0123456789")), "older").alias("stale"),
        mk.thinking_marker(F.col("chars"), F.col("event_id") % 2 == 0, F.col("tool"), "verbose").alias("thinking"),
    )


@query("section_summary", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id%2=0 THEN replace(text, '. ', chr(10)||' '||chr(10)) ELSE text END AS t FROM documents),
 s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x)>0) AS p FROM d)
SELECT doc_id, array_to_string(list_concat(list_transform(p[1:8], lambda x: CASE WHEN length(regexp_replace(split_part(x, chr(10), 1),'^\\s+|\\s+$','','g'))>120 THEN left(regexp_replace(split_part(x, chr(10), 1),'^\\s+|\\s+$','','g'),120)||'...' ELSE regexp_replace(split_part(x, chr(10), 1),'^\\s+|\\s+$','','g') END),
  CASE WHEN len(p)>8 THEN ['... ['||(len(p)-8)||' more sections]'] ELSE [] END), chr(10)||'  ') AS summary FROM s
""")
def section_summary(spark, sf):
    d = sql(spark, sf, "SELECT doc_id, CASE WHEN doc_id%2=0 THEN replace(text, '. ', chr(10)||' '||chr(10)) ELSE text END AS t FROM documents")
    return d.select("doc_id", mk.section_summary(F.col("t")).alias("summary"))


_LAST = r"""CASE WHEN len(p)>=2 THEN p[-1] WHEN len(s)>=2 THEN s[-2]||' '||s[-1] ELSE right(w, 500) END"""
_LAST_CTE = r"""
 w0 AS (SELECT *, regexp_replace({t}, '^\s+|\s+$', '', 'g') AS w FROM {src}),
 w1 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(w, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x)>0) AS p,
   list_filter(string_split(regexp_replace(w, '([.!?])\s+', '\1'||chr(1), 'g'), chr(1)), lambda x: length(x)>0) AS s FROM w0)
"""


@query(
    "last_paragraph",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN replace(text, '. ', '.'||chr(10)||' '||chr(10)) WHEN doc_id%3=1 THEN replace(text, '.', ';') ELSE text END AS t FROM documents), "
    + _LAST_CTE.format(t="t", src="d") + f" SELECT doc_id, {_LAST} AS paragraph FROM w1",
)
def last_paragraph(spark, sf):
    d = sql(spark, sf, "SELECT doc_id, CASE WHEN doc_id%3=0 THEN replace(text, '. ', '.'||chr(10)||' '||chr(10)) WHEN doc_id%3=1 THEN replace(text, '.', ';') ELSE text END AS t FROM documents")
    return d.select("doc_id", mk.last_paragraph(F.col("t")).alias("paragraph"))


# ---- condensation ---------------------------------------------------------------------------

_BLOCKS = "SELECT * FROM f3_sized"


def call_blocks(spark, sf):
    """The block table as it would be stored: derived once, then read by every branch."""
    return materialise(sql(spark, sf, _BLOCKS), "blocks")


def calls(spark, sf):
    return cd.pair_calls(call_blocks(spark, sf))


_K = "k AS (SELECT *, 2*n-1 AS call_pos, 2*n AS result_pos, max(turn_id) OVER (PARTITION BY conv) AS total, tool_id AS tid FROM f3_calls_src QUALIFY event_id%97<>0)"
_KB = "floor({c}/1024.0)||'.'"


def _kb1(c):
    return f"(CAST(floor(floor({c}/1024.0*10+0.5)/10) AS BIGINT)||'.'||CAST(floor({c}/1024.0*10+0.5) AS BIGINT)%10)"


@query("pair_calls", f"WITH {_K} SELECT conv, call_pos, result_pos, call_uuid, result_uuid, tool_id, tool, CASE WHEN tool IN ('Read','Edit') THEN path END AS path, chars FROM k")
def pair_calls(spark, sf):
    return calls(spark, sf).select("conv", "call_pos", "result_pos", "call_uuid", "result_uuid", "tool_id", "tool", "path", "chars")


_LATEST = "row_number() OVER (PARTITION BY conv, {keys} ORDER BY n DESC) AS rn, first_value(result_uuid) OVER (PARTITION BY conv, {keys} ORDER BY n DESC) AS by_uuid, first_value(chars) OVER (PARTITION BY conv, {keys} ORDER BY n DESC) AS last_chars"
_READS = f"r AS (SELECT *, {_LATEST.format(keys='path')} FROM k WHERE tool='Read')"
_STALE_TEXT = "'[stale read elided: '||" + _kb1("chars") + "||' KB, '||path||', {why}; superseded by uuid '||left(by_uuid,8)||']'"
_IDENTICAL = f"SELECT conv, result_uuid AS uuid, 1 AS rank, 'identical-reads' AS mode, chars AS original_bytes, 0 AS condensed_bytes, {_STALE_TEXT.format(why='byte-identical to a later read')} AS new_value FROM r WHERE rn>1 AND chars>1024 AND chars=last_chars"
_MEMORY = f"SELECT conv, result_uuid AS uuid, 2, 'memory-reads', chars, 0, {_STALE_TEXT.format(why='older memory-style read superseded by later read')} FROM r WHERE rn>1 AND chars>=256 AND path='/repo/MEMORY.md'"
_IMAGES = "SELECT conv, result_uuid AS uuid, 3, 'images', chars, 0, '[image elided: ~'||CAST(floor(chars/1024.0+0.5) AS BIGINT)||' KB base64, was Read of '||path||']' FROM r WHERE path LIKE '%.png' AND chars>=1024"
_STALE = f"SELECT conv, result_uuid AS uuid, 4, 'stale-reads', chars, length({_STALE_TEXT.format(why='older read of same path/offset/limit superseded')}), {_STALE_TEXT.format(why='older read of same path/offset/limit superseded')} FROM r WHERE rn>1 AND chars>=500"
_SNAP_TEXT = "'[stale MCP snapshot elided: '||" + _kb1("chars") + "||' KB from '||tool||'; superseded by uuid '||left(by_uuid,8)||']'"
_SNAPSHOT = f"SELECT conv, result_uuid AS uuid, 5, 'mcp-snapshots', chars, length({_SNAP_TEXT}), {_SNAP_TEXT} FROM (SELECT *, {_LATEST.format(keys='args')} FROM k WHERE tool LIKE 'mcp__worker__%' AND chars>=500) s WHERE rn>1"
_AGAIN = """CASE WHEN tool='Read' THEN 'Read({{file_path: "'||path||'"}}) — gives current file state, not the historical snapshot'
 WHEN tool='Edit' THEN 'Read({{file_path: "'||path||'"}}) — gives the file''s CURRENT state. The original tool_result was a snapshot at edit time; the live file may have changed since.'
 WHEN tool LIKE 'mcp%' THEN tool||'('||args||') — re-call for current state' ELSE 're-call '||tool||' with the same args' END"""
_REFETCH_TEXT = (
    "'['||tool||' tool_result elided — ~'||" + _kb1("chars") + "||' KB, 1 lines]'||chr(10)||chr(10)||'SUMMARY ('||{src}||'):'||chr(10)||'  '||{sum}||chr(10)||chr(10)||'RE-FETCH for full original content:'||chr(10)||'  '||"
    + _AGAIN
    + "||chr(10)||chr(10)||'Why elided: tool_result was older than the most-recent active-state buffer and ≥600 bytes; condensed to summary+pointer. Original preserved in .condense-backups/.'"
)
_HEUR = ("'heuristic (first line of each section split by blank lines)'", "repeat('ab',60)||'...'")
_SUMS = (
    "CASE WHEN event_id%7=0 THEN 'Haiku' WHEN v.summary IS NOT NULL THEN 'analyze-v2 Pass 1 turn outcome' ELSE 'heuristic (first line of each section split by blank lines)' END",
    "CASE WHEN event_id%7=0 THEN 'model says '||event_id WHEN v.summary IS NOT NULL THEN v.summary ELSE repeat('ab',60)||'...' END",
)
_OLD = "turn_id <= total - least(30, greatest(1, ceil(total/2.0)))"
_REFETCH = f"SELECT conv, result_uuid AS uuid, 7, 'refetch-markers', chars, length(t), t FROM (SELECT *, {_REFETCH_TEXT.format(src=_HEUR[0], sum=_HEUR[1])} AS t FROM k WHERE chars>=600 AND {_OLD}) f"
_MODE_COLS = ["conv", "uuid", "mode", "original_bytes", "condensed_bytes", "new_value"]


def _mode_query(name, body, build):
    names = "conv, uuid, mode, original_bytes, condensed_bytes, new_value"

    @query(name, f"WITH {_K}, {_READS}, z(conv, uuid, rank, mode, original_bytes, condensed_bytes, new_value) AS ({body}) SELECT {names} FROM z")
    def run(spark, sf):
        return build(calls(spark, sf)).select(*_MODE_COLS)


_mode_query("condense_identical_reads", _IDENTICAL, cd.condense_identical_reads)
_mode_query("condense_memory_reads", _MEMORY, cd.condense_memory_reads)
_mode_query("condense_images", _IMAGES, cd.condense_images)
_mode_query("condense_stale_reads", _STALE, cd.condense_stale_reads)
_mode_query("condense_snapshots", _SNAPSHOT, cd.condense_snapshots)
_mode_query("condense_refetch", _REFETCH, cd.condense_refetch)


@query(
    "condense_refetch_summaries",
    f"""WITH {_K}, v AS (SELECT conv, turn_id, max(summary) AS summary FROM f8_scores GROUP BY 1,2)
      SELECT conv, uuid, length(new_value) AS condensed_bytes, summary_source, new_value FROM (SELECT k.conv, result_uuid AS uuid, {_REFETCH_TEXT.format(src=_SUMS[0], sum=_SUMS[1])} AS new_value,
        CASE WHEN event_id%7=0 THEN 'haiku' WHEN v.summary IS NOT NULL THEN 'pass1' ELSE 'heuristic' END AS summary_source FROM k LEFT JOIN v ON v.conv=k.conv AND v.turn_id=k.turn_id WHERE chars>=600 AND {_OLD.replace('turn_id', 'k.turn_id')}) t""",
)
def condense_refetch_summaries(spark, sf):
    given = view(spark, sf, "f3_calls_src").filter("event_id%7=0").select(
        "conv", F.col("result_uuid").alias("uuid"), F.lit(0).alias("block_idx"), F.concat(F.lit("model says "), F.col("event_id").cast("string")).alias("summary")
    )
    return cd.condense_refetch(calls(spark, sf), view(spark, sf, "f8_scores"), given).select("conv", "uuid", "condensed_bytes", "summary_source", "new_value")


_THINK = """SELECT t.conv, t.line+1 AS pos, t.uuid, 0 AS block_idx, 'thinking' AS type, CASE WHEN (t.conv+t.line)%4=0 THEN '' WHEN t.conv%2=0 THEN replace(t.text, '. ', '.'||chr(10)||' '||chr(10)) ELSE t.text END AS thinking,
  repeat('s', CAST(100*(t.line%7) + 350*((t.conv+t.line)%4) AS INT)) AS signature, t.turn_id, t.total_turns FROM f8_sized t"""


@query(
    "condense_thinking",
    f"""WITH b AS ({_THINK}), s AS (SELECT conv, turn_id, summary FROM f8_scores WHERE value_score>40), x AS (SELECT conv, turn_id FROM f8_decisions WHERE action='drop'),
     {_LAST_CTE.format(t='thinking', src='b')}, y AS (SELECT w1.*, length(thinking)+length(signature) AS size, s2.summary AS ts, {_LAST.replace('s[', 'w1.s[').replace('len(s)', 'len(w1.s)')} AS lp FROM w1 LEFT JOIN s s2 ON s2.conv=w1.conv AND s2.turn_id=w1.turn_id)
     SELECT conv, uuid, size AS original_bytes, CASE WHEN ts IS NOT NULL THEN 'pass1' WHEN length(thinking)>0 THEN 'heuristic-last-paragraph' ELSE 'signature-only-no-plan' END AS summary_source,
      '[thinking elided ~'||{_kb1('size')}||' KB; '||CASE WHEN ts IS NOT NULL THEN 'turn outcome: '||ts WHEN length(thinking)>0 THEN 'heuristic last-paragraph kept: '||lp ELSE 'heuristic last-paragraph kept: (thinking content was encrypted by Anthropic — only the signature remained)' END||']' AS new_value
     FROM y WHERE size>=400 AND turn_id <= total_turns - least(30, greatest(1, ceil(total_turns/2.0))) AND NOT EXISTS (SELECT 1 FROM x WHERE x.conv=y.conv AND x.turn_id=y.turn_id)""",
)
def condense_thinking(spark, sf):
    scores = view(spark, sf, "f8_scores").filter("value_score>40")
    dropped = view(spark, sf, "f8_decisions").filter("action='drop'")
    return cd.condense_thinking(sql(spark, sf, _THINK), scores, dropped, style="verbose").select("conv", "uuid", "original_bytes", "summary_source", "new_value")


def _args_rows(spark, sf):
    m = view(spark, sf, "f8_sized")
    q, k = json_quote(F.col("text")), F.col("conv") % 5
    path = F.concat(F.lit('{"file_path":"/p'), (F.col("conv") % 9).cast("string"), F.lit('"'))
    args = (
        F.when(k == 0, F.concat(F.lit('{"subject":"s","n":1.50,"description":'), q, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"task":'), q, F.lit(',"to":null}')))
        .when(k == 2, F.concat(path, F.lit(',"old_string":'), q, F.lit(',"new_string":"x"}')))
        .when(k == 3, F.concat(path, F.lit(',"content":'), q, F.lit("}")))
        .otherwise(F.concat(F.lit('{"description":'), q, F.lit("}")))
    )
    tool = F.element_at(F.array(*[F.lit(t) for t in ("TaskCreate", "mcp__orchestrator__assign_task", "Edit", "Write", "Grep")]), (k + 1).cast("int"))
    return m.select("conv", (F.col("line") + 1).alias("pos"), "uuid", F.lit(0).alias("block_idx"), F.lit("tool_use").alias("type"), tool.alias("tool"), args.alias("args"), "turn_id", "total_turns")


@query(
    "condense_tool_args",
    """WITH b AS (SELECT *, max(turn_id) OVER (PARTITION BY conv) AS total, length(text) AS n,
        CASE conv%5 WHEN 0 THEN 'TaskCreate' WHEN 1 THEN 'mcp__orchestrator__assign_task' WHEN 2 THEN 'Edit' ELSE 'Write' END AS tool,
        CASE conv%5 WHEN 0 THEN 'description' WHEN 1 THEN 'task' WHEN 2 THEN 'old_string' ELSE 'content' END AS field FROM f8_turns WHERE conv%5<4),
       c AS (SELECT *, to_json(left(text,100)||'... ['||(n-100)||' more chars elided.'||CASE WHEN conv%5>1 THEN ' See `git log -p /p'||conv%9||'` for diff history; file was git-clean at condense time.' ELSE ' Full original in .condense-backups/.' END||' Tool: '||tool||', field: '||field||']')::VARCHAR AS q
         FROM b WHERE n>=300 AND turn_id <= total - least(30, greatest(1, ceil(total/2.0))) AND (conv%5<2 OR conv%9<6)),
       d AS (SELECT *, CASE conv%5 WHEN 0 THEN '{"subject":"s","n":1.5,"description":'||q||'}' WHEN 1 THEN '{"task":'||q||',"to":null}' WHEN 2 THEN '{"file_path":"/p'||conv%9||'","old_string":'||q||',"new_string":"x"}' ELSE '{"file_path":"/p'||conv%9||'","content":'||q||'}' END AS v FROM c)
      SELECT conv, uuid, n AS original_bytes, length(v) AS condensed_bytes, n-length(v) AS saved, v AS new_value FROM d""",
)
def condense_tool_args(spark, sf):
    clean = sql(spark, sf, "SELECT DISTINCT '/p'||CAST(conv%9 AS STRING) AS path FROM f1_messages WHERE conv%9<6")
    return cd.condense_tool_args(_args_rows(spark, sf), clean).select("conv", "uuid", "original_bytes", "condensed_bytes", "saved", "new_value")


_STATE = """SELECT conv, result_uuid AS uuid, 0 AS block_idx, CASE WHEN event_id%3=0 THEN 'stale-reads' ELSE 'refetch-markers' END AS mode, event_id AS done_at,
  chars AS original_bytes, event_id%90 AS condensed_bytes, CASE WHEN event_id%10=0 THEN 'haiku' WHEN event_id%10=5 THEN 'pass1' END AS summary_source FROM f3_calls_src WHERE event_id%5=0"""
_EVERY = " UNION ALL ".join([_IDENTICAL, _MEMORY, _IMAGES, _STALE, _SNAPSHOT, _REFETCH])
_PLAN = f"""{_K}, {_READS}, e(conv, uuid, rank, mode, original_bytes, condensed_bytes, new_value) AS ({_EVERY}), st AS ({_STATE}),
 e2 AS (SELECT e.* FROM e LEFT JOIN st ON st.conv=e.conv AND st.uuid=e.uuid WHERE st.uuid IS NULL OR ({{up}} AND e.mode='refetch-markers' AND coalesce(st.summary_source,'')<>'haiku')),
 win AS (SELECT *, CASE WHEN mode='refetch-markers' THEN original_bytes-condensed_bytes ELSE original_bytes END AS saved FROM (SELECT *, row_number() OVER (PARTITION BY conv, uuid ORDER BY rank) AS rn FROM e2) t WHERE rn=1)"""


def _plan(spark, sf, upgrade=False, blocks=None):
    found = cd.condense_modes(call_blocks(spark, sf) if blocks is None else blocks)
    return cd.build_condense_plan(found, sql(spark, sf, _STATE), upgrade=upgrade)


@query("build_condense_plan", f"WITH {_PLAN.replace('{up}', 'FALSE')} SELECT conv, uuid, 0 AS block_idx, mode, original_bytes, condensed_bytes, saved, new_value FROM win")
def build_condense_plan(spark, sf):
    return _plan(spark, sf)[0].select("conv", "uuid", "block_idx", "mode", "original_bytes", "condensed_bytes", "saved", "new_value")


@query("condense_plan_upgrade", f"WITH {_PLAN.replace('{up}', 'TRUE')} SELECT conv, uuid, 0 AS block_idx, mode, CASE WHEN mode='refetch-markers' THEN 'heuristic' END AS summary_source FROM win")
def condense_plan_upgrade(spark, sf):
    return _plan(spark, sf, True)[0].select("conv", "uuid", "block_idx", "mode", "summary_source")


@query("condense_stats", f"WITH {_PLAN.replace('{up}', 'FALSE')} SELECT conv, mode, count(*) AS blocks, CAST(sum(saved) AS BIGINT) AS saved FROM win GROUP BY conv, mode")
def condense_stats(spark, sf):
    return _plan(spark, sf)[1]


@query(
    "condensed_blocks",
    f"WITH {_PLAN.replace('{up}', 'FALSE')} SELECT b.conv, b.pos, b.uuid, b.type, coalesce(w.new_value, b.result_text) AS result_text FROM f3_blocks b LEFT JOIN win w ON w.conv=b.conv AND w.uuid=b.uuid",
)
def condensed_blocks(spark, sf):
    blocks = call_blocks(spark, sf)
    return cd.apply_to_blocks(blocks, _plan(spark, sf, blocks=blocks)[0]).select("conv", "pos", "uuid", "type", "result_text")


@query(
    "condense_state_summary",
    f"SELECT conv, count(DISTINCT uuid) AS entries, count(*) AS blocks, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(condensed_bytes) AS BIGINT) AS condensed_bytes FROM ({_STATE}) s GROUP BY conv",
)
def condense_state_summary(spark, sf):
    return cd.condense_state_summary(sql(spark, sf, _STATE))[0]


@query("condense_state_by_mode", f"SELECT conv, mode, count(*) AS blocks, CAST(sum(original_bytes-condensed_bytes) AS BIGINT) AS saved FROM ({_STATE}) s GROUP BY conv, mode")
def condense_state_by_mode(spark, sf):
    return cd.condense_state_summary(sql(spark, sf, _STATE))[1]


@query(
    "fully_condensed",
    f"SELECT b.conv, b.uuid, count(*) AS blocks FROM (SELECT conv, uuid, 0 AS block_idx FROM f3_blocks UNION ALL SELECT conv, uuid, 1 FROM f3_blocks WHERE pos%4=0) b LEFT JOIN ({_STATE}) s ON s.conv=b.conv AND s.uuid=b.uuid AND s.block_idx=b.block_idx GROUP BY 1,2 HAVING count(*)=count(s.uuid)",
)
def fully_condensed(spark, sf):
    b = view(spark, sf, "f3_blocks")
    every = b.select("conv", "uuid", "block_idx").unionByName(b.filter("pos%4=0").select("conv", "uuid", F.lit(1).alias("block_idx")))
    return cd.fully_condensed(sql(spark, sf, _STATE), every)


@query(
    "upsert_state",
    f"""WITH {_PLAN.replace('{up}', 'TRUE')} SELECT coalesce(st.conv, w.conv) AS conv, coalesce(st.uuid, w.uuid) AS uuid, 0 AS block_idx, CASE WHEN w.uuid IS NOT NULL THEN w.mode ELSE st.mode END AS mode,
      CASE WHEN w.uuid IS NOT NULL THEN w.condensed_bytes ELSE st.condensed_bytes END AS condensed_bytes, CASE WHEN w.uuid IS NOT NULL THEN CASE WHEN w.mode='refetch-markers' THEN 'heuristic' END ELSE st.summary_source END AS summary_source
      FROM st FULL JOIN win w ON w.conv=st.conv AND w.uuid=st.uuid""",
)
def upsert_state(spark, sf):
    records = _plan(spark, sf, True)[2]
    return cd.upsert_state(sql(spark, sf, _STATE).drop("done_at", "original_bytes"), records)


_PLANS = """SELECT conv, 'plan'||CAST(conv AS STRING)||'-'||CAST(v AS STRING) AS plan_id, CASE WHEN v=1 THEN 'v1' ELSE 'v2-two-pass' END AS schema_version, (v*conv)%7 AS mtime,
  CAST(conv AS STRING)||'-'||CAST(mx - CASE WHEN v=3 THEN 1 ELSE 0 END AS STRING) AS last_uuid, mx + CASE WHEN v=2 AND conv%2=0 THEN 2 ELSE 1 END AS chain_length
  FROM (SELECT conv, mx, {v} AS v FROM (SELECT conv, max(line) AS mx FROM f1_messages GROUP BY conv) m) w"""


@query(
    "match_plan",
    "SELECT conv, plan_id FROM (SELECT p.conv, p.plan_id, row_number() OVER (PARTITION BY p.conv ORDER BY p.mtime DESC, p.plan_id DESC) AS rn FROM ("
    + _PLANS.format(v="unnest([0,1,2,3,4])")
    + ") p JOIN (SELECT conv, max(line) AS mx FROM f1_messages GROUP BY conv) m ON m.conv=p.conv AND p.schema_version='v2-two-pass' AND p.last_uuid=m.conv||'-'||m.mx AND p.chain_length=m.mx+1) t WHERE rn=1",
)
def match_plan(spark, sf):
    stats = view(spark, sf, "f1_messages").groupBy("conv").agg(F.max_by("uuid", "line").alias("last_uuid"), F.count(F.lit(1)).alias("chain_length"))
    return cd.match_plan(sql(spark, sf, _PLANS.format(v="explode(sequence(0,4))")), stats)
