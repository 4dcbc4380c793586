"""Queries over turns, segments and reveals."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions.tools import tool_call_label
from chainloom.operators import chain as ch
from chainloom.operators import reveal as rv
from chainloom.operators import turns as tn
from chainloom.plans.registry import query
from chainloom.plans.views import query as sql
from chainloom.plans.views import view

TYPED = "type = 'user'"


def flagged(df):
    """Text-only transcripts: string content, typed input is every user row."""
    return df.withColumns(
        {
            "role": F.col("type"),
            "opens_turn": F.expr(TYPED),
            "real_user": F.expr(TYPED),
            "shape": F.lit("string"),
            "typed_text": F.col("text"),
            "plain_chars": F.length("text").cast("bigint"),
            "n_tool_use": F.lit(0).cast("bigint"),
        }
    )


def linear(spark, sf, name="f1_messages"):
    """Transcripts that have no branches: the file order is the chain."""
    return flagged(view(spark, sf, name)).withColumn("pos", F.col("line") + 1)


def branched(spark, sf):
    m = flagged(view(spark, sf, "f2_messages"))
    return ch.chain_messages(m, ch.walk_chain(m))


_T1 = "sum(CASE WHEN type='user' OR pos=1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY pos)"


@query("segment_turns", f"SELECT conv, pos, uuid, CAST({_T1} AS BIGINT) AS turn_id FROM f2_chain")
def segment_turns(spark, sf):
    return tn.segment_turns(branched(spark, sf)).select("conv", "pos", "uuid", "turn_id")


@query(
    "assign_turn_ids",
    "SELECT conv, line, uuid, CAST(sum(CASE WHEN type='user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY line) AS BIGINT) AS turn_id FROM f2_messages",
)
def assign_turn_ids(spark, sf):
    return tn.assign_turn_ids(flagged(view(spark, sf, "f2_messages"))).select("conv", "line", "uuid", "turn_id")


@query(
    "turn_rollup",
    f"""SELECT conv, turn_id, count(*) AS n_entries, min_by(uuid,pos) AS first_uuid, max_by(uuid,pos) AS last_uuid,
      min_by(ts,pos) AS start_ts, max_by(ts,pos) AS end_ts, min_by(type,pos)='user' AS has_real_user_input
      FROM (SELECT *, CAST({_T1} AS BIGINT) AS turn_id FROM f2_chain) t GROUP BY conv, turn_id""",
)
def turn_rollup(spark, sf):
    return tn.turn_rollup(tn.segment_turns(branched(spark, sf)))


@query(
    "prefilter_turns",
    """SELECT conv, turn_id, 'micro' AS type, 'discardable' AS importance,
       CASE WHEN n=1 THEN 'Pre-filtered: single-entry turn (no agent response).'
            ELSE 'Pre-filtered: ≤5-entry turn, no tool_use, content '||chars||' chars.' END AS summary,
       CASE WHEN n=1 THEN 'pf-micro-single-entry' ELSE 'pf-micro-no-tool-use-short' END AS duplicate_signal,
       CASE WHEN n=1 THEN 'single-entry turn (no agent response)' ELSE '≤5 entries, no tool_use, '||chars||' chars' END AS prefilter_reason
       FROM (SELECT conv, turn_id, count(*) AS n, sum(length(text)) AS chars FROM f8_turns GROUP BY conv, turn_id) t
       WHERE n=1 OR (n<=5 AND chars<700)""",
)
def prefilter_turns(spark, sf):
    return tn.prefilter_turns(tn.segment_turns(linear(spark, sf)))


_DECIDE = (
    "(length(t) BETWEEN 5 AND 500 AND (regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])(let''?s|go with|ship|do it|proceed|build it|implement|fix it|push it)($|[^A-Za-z0-9_])')"
    " OR regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])(yes,?\\s|(approved|confirmed|go ahead)($|[^A-Za-z0-9_]))')"
    " OR regexp_matches(t, '(?i)^(do|make|fix|build|add|remove|update|create|implement|ship|push|commit)\\s')))"
)


@query(
    "decision_like",
    f"SELECT conv, line, {_DECIDE} AS is_decision FROM (SELECT conv, line, regexp_replace(text,'^\\s+|\\s+$','','g') AS t FROM f1_spoken) s",
)
def decision_like(spark, sf):
    from chainloom.functions.text import trim_blank

    return view(spark, sf, "f1_spoken").select("conv", "line", tn.decision_like(trim_blank(F.col("text"))).alias("is_decision"))


# Calls of the same conversations, on their first four messages.
_SPOKEN_CALLS = "SELECT *, 1 + n % 4 AS msg FROM f3_args"


@query(
    "summarize_segments",
    f"""WITH m AS (SELECT *, line+1 AS pos, CAST(floor(line/3.0)+1 AS BIGINT) AS segment_id, regexp_replace(text,'^\\s+|\\s+$','','g') AS t,
          CAST(sum(CASE WHEN type='user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY line) AS BIGINT) AS turn_id FROM f1_spoken),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv, segment_id ORDER BY pos) AS rn FROM m WHERE type='user' AND {_DECIDE}),
        h AS (SELECT *, row_number() OVER (PARTITION BY conv, segment_id ORDER BY pos) AS rn FROM m WHERE type='assistant' AND length(t)>80),
        c AS (SELECT *, CAST(floor((msg-1)/3.0)+1 AS BIGINT) AS segment_id, (msg, n) AS here FROM ({_SPOKEN_CALLS}) z),
        f AS (SELECT conv, segment_id, path, min(here) AS seen FROM c WHERE args LIKE '%file_path%' GROUP BY 1,2,3),
        g AS (SELECT conv, segment_id, tool, count(*) AS k, min(here) AS seen FROM c GROUP BY 1,2,3)
       SELECT b.*, coalesce(x.u,'') AS user_decisions, coalesce(y.a,'') AS assistant_highlights, coalesce(w.tools,'') AS tools_used,
         coalesce(v.files,'') AS files_touched, coalesce(v.k,0) AS files_touched_count, coalesce(s.lines,'') AS bash_samples FROM
       (SELECT conv, segment_id, min(pos) AS msg_from, max(pos) AS msg_to, min(turn_id) FILTER (turn_id>0) AS turn_from,
          max(turn_id) FILTER (turn_id>0) AS turn_to, min(ts) AS ts_from, max(ts) AS ts_to FROM m GROUP BY conv, segment_id) b
       LEFT JOIN (SELECT conv, segment_id, string_agg(turn_id||'|'||substr(split_part(t, chr(10), 1),1,200), ' ~ ' ORDER BY pos) AS u FROM d GROUP BY 1,2) x USING (conv, segment_id)
       LEFT JOIN (SELECT conv, segment_id, string_agg(turn_id||'|'||substr(split_part(t, chr(10), 1),1,160), ' ~ ' ORDER BY pos) AS a FROM h GROUP BY 1,2) y USING (conv, segment_id)
       LEFT JOIN (SELECT conv, segment_id, string_agg(tool||':'||k, ',' ORDER BY seen) AS tools FROM g GROUP BY 1,2) w USING (conv, segment_id)
       LEFT JOIN (SELECT conv, segment_id, string_agg(path, ',' ORDER BY seen) AS files, count(*) AS k FROM f GROUP BY 1,2) v USING (conv, segment_id)
       LEFT JOIN (SELECT conv, segment_id, string_agg('make t'||k||' # run '||k, ',' ORDER BY here) AS lines FROM c WHERE tool='Bash' GROUP BY 1,2) s USING (conv, segment_id)""",
)
def summarize_segments(spark, sf):
    calls = sql(spark, sf, _SPOKEN_CALLS).withColumns({"type": F.lit("tool_use"), "pos": F.col("msg").cast("bigint"), "block_idx": F.col("n").cast("int")})
    seg = tn.summarize_segments(linear(spark, sf, "f1_spoken"), calls, 3)
    return seg.select(
        "conv", "segment_id", "msg_from", "msg_to", "turn_from", "turn_to", "ts_from", "ts_to", "files_touched_count",
        *[F.array_join(c, " ~ ").alias(c) for c in ("user_decisions", "assistant_highlights")],
        *[F.array_join(c, ",").alias(c) for c in ("tools_used", "files_touched", "bash_samples")],
    )


def _call_rows(spark, sf):
    calls = view(spark, sf, "f3_args").withColumns({"type": F.lit("tool_use"), "block_idx": F.lit(0)})
    rows = view(spark, sf, "f3_args").select(
        "conv", "pos", "uuid", F.col("pos").alias("ts"), F.lit("assistant").alias("role"), F.lit("").alias("text"), F.lit(False).alias("real_user")
    )
    return rows, calls


@query(
    "segment_tools",
    """WITH c AS (SELECT *, CAST(floor((pos-1)/200.0)+1 AS BIGINT) AS segment_id FROM f3_args),
        f AS (SELECT conv, segment_id, path, min(pos) AS seen FROM c WHERE args LIKE '%file_path%' GROUP BY 1,2,3),
        fr AS (SELECT *, row_number() OVER (PARTITION BY conv, segment_id ORDER BY seen) AS rn, count(*) OVER (PARTITION BY conv, segment_id) AS n FROM f),
        b AS (SELECT *, row_number() OVER (PARTITION BY conv, segment_id ORDER BY pos) AS rn FROM c WHERE tool='Bash')
       SELECT s.conv, s.segment_id, s.tools_used, coalesce(p.files_touched,'') AS files_touched, coalesce(p.n,0) AS files_touched_count, coalesce(q.bash_samples,'') AS bash_samples
       FROM (SELECT conv, segment_id, string_agg(tool||':'||n, ',' ORDER BY seen) AS tools_used FROM
              (SELECT conv, segment_id, tool, count(*) AS n, min(pos) AS seen FROM c GROUP BY 1,2,3) t GROUP BY 1,2) s
       LEFT JOIN (SELECT conv, segment_id, string_agg(path, ',' ORDER BY seen) AS files_touched, max(n) AS n FROM fr GROUP BY 1,2) p USING (conv, segment_id)
       LEFT JOIN (SELECT conv, segment_id, string_agg('make t'||k||' # run '||k, ',' ORDER BY pos) AS bash_samples FROM b GROUP BY 1,2) q USING (conv, segment_id)""",
)
def segment_tools(spark, sf):
    seg = tn.summarize_segments(*_call_rows(spark, sf))
    return seg.select(
        "conv", "segment_id", "files_touched_count",
        *[F.array_join(c, ",").alias(c) for c in ("tools_used", "files_touched", "bash_samples")],
    )


@query(
    "top_tools",
    """SELECT conv, segment_id, tool, calls, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv, segment_id ORDER BY calls DESC, seen) AS rank FROM
        (SELECT conv, CAST(floor((pos-1)/200.0)+1 AS BIGINT) AS segment_id, tool, count(*) AS calls, min(pos) AS seen FROM f3_args GROUP BY 1,2,3) t) r""",
)
def top_tools(spark, sf):
    return tn.top_tools(tn.tool_counts(_call_rows(spark, sf)[1])).select("conv", "segment_id", "tool", "calls", "rank")


_LABEL = """CASE k % 9 WHEN 0 THEN path||CASE WHEN k > 0 THEN ' (offset '||k||', limit 50)' ELSE '' END WHEN 1 THEN 'make t'||k||' # run '||k
  WHEN 2 THEN 'pattern="p'||k||'" path=/repo' WHEN 3 THEN 'pattern="*.py"'
  WHEN 4 THEN 'explore: '||substr(repeat('look around ', CAST(k%10 AS INT)),1,60) WHEN 5 THEN path
  WHEN 6 THEN 'a='||k||', b='||substr(repeat('xy', CAST(k%40 AS INT)),1,40)||CASE WHEN 2*(k%40)>40 THEN '…' ELSE '' END||', c=true'
  WHEN 7 THEN '(no path)' ELSE path END"""


@query("tool_call_label", f"SELECT conv, uuid, {_LABEL} AS label FROM f3_args")
def label(spark, sf):
    return view(spark, sf, "f3_args").select("conv", "uuid", tool_call_label(F.col("tool"), F.col("args")).alias("label"))


def _action_input(spark, sf):
    blocks = sql(spark, sf, "SELECT * FROM f10_blocks", staged=("f3_args", "f10_rows"))
    return spark.table("f10_rows").withColumn("real_user", F.col("sub") == 0), blocks


_ACTIONS = f"""
  r AS (SELECT *, CAST(sum(CASE WHEN sub=0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY line) AS BIGINT) AS turn_id FROM f10_rows),
  b AS (SELECT r.turn_id, r.sub, r.k, x.* FROM f10_blocks x JOIN r ON r.conv=x.conv AND r.line=x.line WHERE r.turn_id>0 AND r.sub>0),
  e AS (SELECT *, sum(CASE WHEN sub=1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv, turn_id ORDER BY line, block_idx) AS action_id FROM b),
  l AS (SELECT *, substr(regexp_extract(result_text, '([^\\n]*\\S[^\\n]*)', 1),1,120) AS one FROM e WHERE sub=2 AND action_id>0),
  l2 AS (SELECT *, coalesce(max(CASE WHEN one<>'' THEN 1 ELSE 0 END) OVER (PARTITION BY conv, turn_id, action_id ORDER BY line, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS done FROM l),
  g AS (SELECT conv, turn_id, action_id, max(one) FILTER (one<>'') AS result_summary, bool_or(is_error) AS result_error FROM l2 WHERE done=0 GROUP BY 1,2,3),
  a AS (SELECT e.conv, e.turn_id, CAST(e.action_id AS BIGINT) AS action_id, CASE WHEN e.type='text' THEN 'assistant_text' ELSE 'tool_use' END AS kind, e.tool, e.line AS msg_index, e.text,
     CASE WHEN e.type='text' THEN 'note '||e.k ELSE (SELECT {_LABEL} FROM f3_args f WHERE f.conv=e.conv AND f.uuid=e.uuid) END
       ||CASE WHEN e.type='text' AND length(e.text)>200 THEN '…' ELSE '' END AS summary FROM e WHERE sub=1)"""


@query(
    "turn_actions",
    f"""WITH {_ACTIONS} SELECT a.conv, a.turn_id, a.action_id, a.kind, a.tool, a.summary, a.msg_index, g.result_summary, coalesce(g.result_error,FALSE) AS result_error
        FROM a LEFT JOIN g ON g.conv=a.conv AND g.turn_id=a.turn_id AND g.action_id=a.action_id""",
)
def turn_actions(spark, sf):
    return tn.turn_actions(*_action_input(spark, sf))[0]


@query(
    "turn_overview",
    f"""WITH {_ACTIONS}, t AS (SELECT conv, turn_id, count(*) AS message_count, min(line) AS msg_from, max(line) AS msg_to, max(text) AS p FROM r WHERE turn_id>0 GROUP BY 1,2),
      z AS (SELECT conv, turn_id, count(*) AS n_actions, max_by(text, action_id) FILTER (text IS NOT NULL) AS lt, max_by(summary, action_id) AS ls FROM a GROUP BY 1,2)
      SELECT t.conv, t.turn_id, t.message_count, t.msg_from, t.msg_to, CASE WHEN length(p)>500 THEN substr(p,1,500)||'… (truncated; use action_id: 1 for full)' ELSE p END AS user_prompt,
       coalesce(n_actions,0) AS n_actions, CASE WHEN lt IS NULL OR lt=ls THEN '' ELSE lt END AS final_text FROM t LEFT JOIN z USING (conv, turn_id)""",
)
def turn_overview(spark, sf):
    return tn.turn_actions(*_action_input(spark, sf))[1]


_SPECS = """
SELECT conv, 'a'||CAST(conv AS STRING) AS req, CASE WHEN conv%6=0 THEN conv%4 END AS message_from, CASE WHEN conv%6=0 THEN conv%3+1 END AS message_to,
  CASE WHEN conv%6=1 THEN conv%5+1 END AS segment_id, CASE WHEN conv%6=2 THEN conv%3 END AS turn_from, CASE WHEN conv%6=2 THEN 3 END AS turn_to,
  CASE WHEN conv%6 IN (2,3,4) THEN conv%5 END AS turn_id FROM (SELECT DISTINCT conv FROM f1_messages) d
"""
_VERDICT = f"""
 s AS ({_SPECS}),
 m AS (SELECT *, line+1 AS idx, sum(CASE WHEN type='user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY line) AS turn_id FROM f1_messages),
 q AS (SELECT s.req, s.conv, conv%6 AS kind, coalesce(turn_from, turn_id) AS tf, coalesce(turn_to, turn_id) AS tt, message_from, message_to, segment_id,
   (SELECT max(idx) FROM m WHERE m.conv=s.conv) AS n FROM s),
 w AS (SELECT q.*, CASE kind WHEN 0 THEN message_from WHEN 1 THEN (segment_id-1)*2+1 ELSE (SELECT min(idx) FROM m WHERE m.conv=q.conv AND m.turn_id BETWEEN tf AND tt) END AS a,
   least(n, CASE kind WHEN 0 THEN message_to WHEN 1 THEN segment_id*2 ELSE (SELECT max(idx) FROM m WHERE m.conv=q.conv AND m.turn_id BETWEEN tf AND tt) END) AS b FROM q),
 v AS (SELECT req, conv, CASE WHEN kind=0 AND (message_from<1 OR message_to<message_from) THEN 'invalid_range' WHEN kind=5 THEN 'no_selector'
   WHEN kind IN (2,3,4) AND (tf<1 OR tt<tf) THEN 'invalid_range' WHEN a IS NULL THEN 'not_found' WHEN a>n THEN 'out_of_range' ELSE 'ok' END AS verdict,
   CAST(a AS BIGINT) AS msg_from, CAST(b AS BIGINT) AS msg_to FROM w)
"""


def _reveal(spark, sf):
    m = linear(spark, sf).withColumn("idx", F.col("line") + 1)
    return rv.inspect_range(m, sql(spark, sf, _SPECS), 2, most=rv.MAX_REVEAL)


@query(
    "inspect_range",
    f"WITH {_VERDICT} SELECT v.req, m.conv, m.idx, m.uuid FROM v JOIN m ON m.conv=v.conv AND m.idx BETWEEN v.msg_from AND v.msg_to WHERE verdict='ok'",
)
def inspect_range(spark, sf):
    return _reveal(spark, sf)[0].select("req", "conv", "idx", "uuid")


# Requests of every width, up to whole conversations.
_WIDE = "SELECT 'w'||CAST(conv_id AS STRING)||'-'||CAST(turn AS STRING) AS req, conv_id AS conv, turn + 1 AS message_from, turn + 1 + (conv_id * 7 + turn * turn) % 40 AS message_to FROM conversations"


@query(
    "inspect_any_length",
    f"WITH w AS ({_WIDE}) SELECT w.req, m.conv_id AS conv, m.turn + 1 AS idx FROM w JOIN conversations m ON m.conv_id=w.conv AND m.turn + 1 BETWEEN w.message_from AND w.message_to",
)
def inspect_any_length(spark, sf):
    m = linear(spark, sf).withColumn("idx", F.col("line") + 1)
    none = {c: F.lit(None).cast("bigint") for c in ("segment_id", "turn_from", "turn_to", "turn_id")}
    return rv.inspect_range(m, sql(spark, sf, _WIDE).withColumns(none), most=None)[0].select("req", "conv", "idx")


@query(
    "inspect_verdicts",
    f"WITH {_VERDICT} SELECT req, conv, verdict, CASE WHEN verdict='ok' THEN msg_from END AS msg_from, CASE WHEN verdict='ok' THEN msg_to END AS msg_to FROM v",
)
def inspect_verdicts(spark, sf):
    ok = F.col("verdict") == "ok"
    return _reveal(spark, sf)[1].select("req", "conv", "verdict", *[F.when(ok, F.col(c)).alias(c) for c in ("msg_from", "msg_to")])


_ACTION_REQ = "SELECT DISTINCT conv, 1 + conv % 5 AS turn_id, 'q'||CAST(conv AS STRING) AS req, 1 + conv % 3 AS action_from, 1 + conv % 4 AS action_to FROM f10_rows"


@query(
    "action_span",
    f"""WITH {_ACTIONS}, s AS ({_ACTION_REQ}) SELECT s.req, s.conv, x.msg_index AS message_from, y.msg_index AS message_to FROM s
        JOIN a x ON x.conv=s.conv AND x.turn_id=s.turn_id AND x.action_id=s.action_from
        JOIN a y ON y.conv=s.conv AND y.turn_id=s.turn_id AND y.action_id=s.action_to WHERE s.action_to>=s.action_from""",
)
def action_span(spark, sf):
    return rv.action_span(tn.turn_actions(*_action_input(spark, sf))[0], sql(spark, sf, _ACTION_REQ))


@query(
    "message_preview",
    """SELECT conv, uuid, type AS role, substr(split_part(t,chr(10),1),1,200)||CASE WHEN k>1 OR length(t)>200 THEN ' … (+'||(k-1)||' more lines)' ELSE '' END AS preview
       FROM (SELECT *, len(string_split(t, chr(10))) AS k FROM (SELECT *, regexp_replace(text,'^\\s+|\\s+$','','g') AS t FROM f1_messages) x) y""",
)
def message_preview(spark, sf):
    return rv.message_preview(linear(spark, sf)).select("conv", "uuid", "role", "preview")


@query(
    "call_preview",
    """SELECT conv, uuid, string_agg(tool||CASE WHEN args LIKE '%"file_path"%' THEN ' '||json_extract_string(args,'$.file_path') ELSE '' END
         ||CASE WHEN tool='Bash' THEN ' `'||split_part(json_extract_string(args,'$.command'),chr(10),1)||'`' ELSE '' END
         ||CASE WHEN length(json_extract_string(args,'$.description'))>0 THEN ' ('||substr(json_extract_string(args,'$.description'),1,60)||')' ELSE '' END, chr(10) ORDER BY block_idx) AS calls
       FROM f10_blocks WHERE type='tool_use' GROUP BY 1,2""",
)
def call_preview(spark, sf):
    rows, blocks = _action_input(spark, sf)
    return rv.message_preview(rows, blocks).filter(F.col("calls") != "").select("conv", "uuid", "calls")


_ENTRY = """'<entry uuid="'||uuid||'" role="'||{role}||'" ts="'||{ts}||'">'||chr(10)||{body}||chr(10)||'</entry>'"""


@query(
    "compact_skeleton",
    "SELECT conv, uuid, pos, "
    + _ENTRY.format(
        role="type", ts="ts",
        body="CASE WHEN length(text)>2500 THEN substr(text,1,1875)||chr(10)||'... ['||(length(text)-2375)||' chars elided] ...'||chr(10)||right(text,500) ELSE text END",
    )
    + " AS skeleton FROM (SELECT m.conv, m.uuid, m.line+1 AS pos, m.type, m.ts, CASE WHEN m.conv%3=0 THEN repeat(m.text, 4) ELSE m.text END AS text FROM f1_messages m) t",
)
def compact_skeleton(spark, sf):
    m = linear(spark, sf).withColumn("text", F.expr("CASE WHEN conv%3=0 THEN repeat(text, 4) ELSE text END"))
    return rv.compact_entries(m, None, "entry")


_PARTS = """CASE type WHEN 'text' THEN text
  WHEN 'tool_use' THEN '[tool_use '||tool||CASE WHEN args LIKE '%"file_path"%' THEN ' '||json_extract_string(args,'$.file_path') ELSE '' END||CASE WHEN tool='Bash' THEN ' `'||split_part(json_extract_string(args,'$.command'),chr(10),1)||'`' ELSE '' END||']'
  ELSE CASE WHEN is_error THEN '[ERROR] ' ELSE '' END||CASE WHEN length(result_text)>1100 THEN '[tool_result '||length(result_text)||' chars] '||substr(result_text,1,800)||chr(10)||'...elided...'||chr(10)||right(result_text,200) ELSE '[tool_result] '||result_text END END"""
_BLOCKS10 = "(SELECT conv, line, uuid, block_idx, type, tool, args, text, is_error, CASE WHEN line%4=1 THEN repeat(result_text, 20) ELSE result_text END AS result_text FROM f10_blocks)"
_BODY = f"""SELECT r.conv, r.uuid, r.line, r.role, coalesce(p.body, r.text, '') AS body FROM f10_rows r
  LEFT JOIN (SELECT conv, line, string_agg({_PARTS}, chr(10) ORDER BY block_idx) AS body FROM {_BLOCKS10} b GROUP BY 1,2) p ON p.conv=r.conv AND p.line=r.line"""


def _block_entries(spark, sf):
    rows, blocks = _action_input(spark, sf)
    rows = rows.withColumns({"pos": F.col("line") + 1, "ts": F.col("line"), "shape": F.when(F.col("sub") == 0, "string").otherwise("array"), "opens_turn": F.col("sub") == 0})
    blocks = blocks.withColumns(
        {"result_text": F.expr("CASE WHEN line%4=1 THEN repeat(result_text, 20) ELSE result_text END"), "thinking": F.lit(None).cast("string")}
    ).drop("line")
    return tn.segment_turns(rows), blocks


@query("compact_blocks", "SELECT conv, uuid, line+1 AS pos, " + _ENTRY.format(role="role", ts="line", body="body") + f" AS skeleton FROM ({_BODY}) t")
def compact_blocks(spark, sf):
    rows, blocks = _block_entries(spark, sf)
    return rv.compact_entries(rows, blocks, "turn").drop("turn_id")


@query(
    "turn_skeleton",
    "WITH e AS (SELECT conv, line, " + _ENTRY.format(role="role", ts="line", body="body") + f" AS s FROM ({_BODY}) t), "
    "r AS (SELECT conv, line, CAST(sum(CASE WHEN sub=0 OR line=0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY line) AS BIGINT) AS turn_id FROM f10_rows), "
    "j AS (SELECT r.conv, r.turn_id, string_agg(s, chr(10)||chr(10) ORDER BY e.line) AS x FROM e JOIN r ON r.conv=e.conv AND r.line=e.line GROUP BY 1,2) "
    "SELECT conv, turn_id, length(x) AS chars, CASE WHEN length(x)>12000 THEN substr(x,1,9360)||chr(10)||'... ['||(length(x)-9360-2160)||' chars elided] ...'||chr(10)||right(x,2160) ELSE x END AS skeleton FROM j",
)
def turn_skeleton(spark, sf):
    rows, blocks = _block_entries(spark, sf)
    return rv.turn_skeletons(rv.compact_entries(rows, blocks, "turn"))


_WORDS = "SELECT CAST(doc_id % 7 AS BIGINT) AS conv, doc_id AS pos, 'user' AS type, CASE doc_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN ' ok ' ELSE text END AS text FROM documents"


@query(
    "purpose_sample",
    f"""WITH u AS (SELECT conv, pos, regexp_replace(text,'^\\s+|\\s+$','','g') AS said FROM ({_WORDS}) w),
       r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos) AS rank, count(*) OVER (PARTITION BY conv) AS n FROM u WHERE length(said)>5)
       SELECT conv, rank AS ord, said AS text FROM r""",
)
def purpose_sample(spark, sf):
    return tn.purpose_sample(sql(spark, sf, _WORDS).withColumn("typed_text", F.col("text")))


@query(
    "purpose_head",
    f"SELECT conv, pos, ord, text FROM (SELECT conv, pos, text, row_number() OVER (PARTITION BY conv ORDER BY pos) AS ord FROM ({_WORDS}) w WHERE regexp_matches(text, '\\S')) t",
)
def purpose_head(spark, sf):
    return tn.purpose_head(sql(spark, sf, _WORDS))


@query(
    "input_budget",
    """SELECT s.conv, m.model, s.bytes, CAST(ceil(bytes/4.0*1.25) AS BIGINT) AS tokens, ceil(bytes/4.0*1.25) <= m.w AS fits FROM
       (SELECT conv, sum(strlen('<entry uuid="'||uuid||'" role="'||type||'" ts="'||ts||'">'||chr(10)||text||chr(10)||'</entry>'))::BIGINT + 2*(count(*)-1) AS bytes FROM f1_messages GROUP BY conv) s,
       (VALUES ('tiny', 900-8000+8000), ('small', 192000), ('large', 992000)) m(model, w)""",
)
def input_budget(spark, sf):
    entries = rv.compact_entries(linear(spark, sf), None, "turn")
    return rv.input_budget(entries, {"tiny": 8_900, "small": 200_000, "large": 1_000_000})
