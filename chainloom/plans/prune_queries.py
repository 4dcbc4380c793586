"""Queries over rewrites, snapshots and prunes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import chain as ch
from chainloom.operators import prune as pr
from chainloom.operators import rewrite as rw
from chainloom.plans.registry import query
from chainloom.plans.turn_queries import branched, flagged, linear
from chainloom.plans.views import query as sql
from chainloom.plans.views import view

_FILES = """
SELECT conv, 'proj'||CAST((conv + v) % 3 AS STRING) AS project, 'proj'||CAST((conv + v) % 3 AS STRING)||'/'||CAST(conv AS STRING)||'-'||CAST(v AS STRING) AS path,
  conv*7 % 11 + (v*v) % 7 AS mtime, v
FROM (SELECT conv, explode(sequence(0, 4)) AS v FROM (SELECT DISTINCT conv_id AS conv FROM conversations) c) w
"""
_FILES_D = _FILES.replace("explode(sequence(0, 4))", "unnest([0,1,2,3,4])")


@query(
    "latest_version",
    f"SELECT conv, project, path, mtime FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY (project='proj1') DESC, mtime DESC, path DESC) AS rn FROM ({_FILES_D}) f WHERE conv%2=0 OR project<>'proj1') t WHERE rn=1",
)
def latest_version(spark, sf):
    files = sql(spark, sf, _FILES).filter("conv%2=0 OR project<>'proj1'")
    return rw.latest_version(files, "proj1")


@query(
    "latest_conversation",
    f"SELECT project, conv, path, mtime FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY mtime DESC, path DESC) AS rn FROM ({_FILES_D}) f) t WHERE rn=1",
)
def latest_conversation(spark, sf):
    return rw.latest_conversation(sql(spark, sf, _FILES))


@query("resolve_project", f"""SELECT want, CASE WHEN want IN (SELECT project FROM p) THEN want ELSE (SELECT min(project) FROM p WHERE split_part(project,'-',-1)=split_part(want,'-',-1)) END AS project
 FROM (SELECT DISTINCT CASE WHEN conv%3=0 THEN '-home-old-p'||conv%10 WHEN conv%3=1 THEN '-srv-app-p'||conv%10 ELSE '-x-none'||conv%5 END AS want FROM f1_messages) w,
 (SELECT 1) o""".replace("SELECT want, CASE", "WITH p AS (SELECT DISTINCT '-'||CASE WHEN conv%2=0 THEN 'home' ELSE 'srv' END||'-app-p'||conv%10 AS project FROM f1_messages) SELECT want, CASE"))
def resolve_project(spark, sf):
    files = sql(spark, sf, "SELECT DISTINCT '/'||CASE WHEN conv%2=0 THEN 'home' ELSE 'srv' END||'/app_p'||CAST(conv%10 AS STRING) AS cwd FROM f1_messages")
    files = files.select(rw.project_key(F.col("cwd")).alias("project"))
    wanted = sql(spark, sf, "SELECT DISTINCT CASE WHEN conv%3=0 THEN '-home-old-p'||CAST(conv%10 AS STRING) WHEN conv%3=1 THEN '-srv-app-p'||CAST(conv%10 AS STRING) ELSE '-x-none'||CAST(conv%5 AS STRING) END AS want FROM f1_messages")
    return rw.resolve_project(files, wanted)


@query("lookup_lines", "SELECT conv, line, uuid, text FROM f1_messages WHERE (conv+line)%3=1")
def lookup_lines(spark, sf):
    m = view(spark, sf, "f1_messages")
    keys = m.filter("(conv+line)%3=1").select("conv", "line").unionByName(m.select("conv", (F.col("line") + 1000).alias("line")))
    return rw.lookup_lines(m, keys).select("conv", "line", "uuid", "text")


def _rewrite(spark, sf):
    m = view(spark, sf, "f1_messages")
    drop = m.filter("(conv+line)%4=0").select("conv", "uuid").unionByName(m.select("conv", F.concat("uuid", F.lit("?")).alias("uuid")))
    repl = m.filter("(conv+line)%2=0").select("conv", "uuid", F.lit(None).cast("string").alias("parent_uuid"), F.concat(F.lit("new "), "text").alias("text"))
    ends = m.groupBy("conv").agg(F.max("line").alias("l"))
    add = ends.select("conv", (F.col("l") + 1).alias("line"), F.concat(F.col("conv").cast("string"), F.lit("-new")).alias("uuid"), F.lit("system").alias("type"), F.lit("added").alias("text"))
    return rw.rewrite(m, drop, repl, add)


@query(
    "rewrite",
    """SELECT conv, line, uuid, CASE WHEN (conv+line)%2=0 THEN NULL ELSE parent_uuid END AS parent_uuid, type, CASE WHEN (conv+line)%2=0 THEN 'new '||text ELSE text END AS text
       FROM f1_messages WHERE (conv+line)%4<>0
       UNION ALL SELECT conv, max(line)+1, conv||'-new', NULL, 'system', 'added' FROM f1_messages GROUP BY conv""",
)
def rewrite(spark, sf):
    return _rewrite(spark, sf)[0].drop("ts")


@query(
    "rewrite_stats",
    """SELECT conv, count(*) AS lines_before, count(*) FILTER ((conv+line)%4=0) AS dropped, count(*) FILTER ((conv+line)%4=2) AS replaced, 1 AS appended FROM f1_messages GROUP BY conv""",
)
def rewrite_stats(spark, sf):
    return _rewrite(spark, sf)[1]


@query(
    "append_messages",
    "SELECT conv, line, uuid, type FROM f1_messages UNION ALL SELECT conv, line+10000, uuid||'x', 'user' FROM f1_messages WHERE line=0",
)
def append_messages(spark, sf):
    m = view(spark, sf, "f1_messages")
    rows = m.filter("line=0").select("conv", (F.col("line") + 10000).alias("line"), F.concat("uuid", F.lit("x")).alias("uuid"), F.lit("user").alias("type"))
    return rw.append_messages(m, rows).select("conv", "line", "uuid", "type")


_SNAPS = "SELECT conv, line, uuid, text||' v'||CAST(v AS STRING) AS text, conv*10 + (v*3)%5 AS saved_at FROM (SELECT *, {v} AS v FROM f1_messages) w WHERE conv % 4 <> 3"
_SNAPS_S, _SNAPS_D = _SNAPS.format(v="explode(sequence(0, 4))"), _SNAPS.format(v="unnest([0,1,2,3,4])")


@query(
    "retain_snapshots",
    f"SELECT conv, saved_at, rn <= 3 AS kept FROM (SELECT conv, saved_at, row_number() OVER (PARTITION BY conv ORDER BY saved_at DESC) AS rn FROM (SELECT DISTINCT conv, saved_at FROM ({_SNAPS_D}) s) d) t",
)
def retain_snapshots(spark, sf):
    kept, pruned = rw.retain_snapshots(sql(spark, sf, _SNAPS_S).select("conv", "saved_at").distinct())
    return kept.withColumn("kept", F.lit(True)).unionByName(pruned.withColumn("kept", F.lit(False)))


@query(
    "restore_snapshot",
    f"""SELECT conv, line, uuid, text, 'live' AS part FROM f1_messages WHERE conv%4=3
        UNION ALL SELECT conv, line, uuid, text, 'live' FROM (SELECT *, max(saved_at) OVER (PARTITION BY conv) AS mx FROM ({_SNAPS_D}) s) t WHERE saved_at=mx
        UNION ALL SELECT conv, line, uuid, text, 'before 99' FROM f1_messages WHERE conv%4<>3""",
)
def restore_snapshot(spark, sf):
    live = view(spark, sf, "f1_messages").select("conv", "line", "uuid", "text")
    out, before = rw.restore_snapshot(live, sql(spark, sf, _SNAPS_S), now=99)
    before = before.select("conv", "line", "uuid", "text", F.concat(F.lit("before "), F.col("saved_at").cast("string")).alias("part"))
    return out.withColumn("part", F.lit("live")).unionByName(before)


@query(
    "condense_log",
    """SELECT *, CAST(sum(saved) OVER (PARTITION BY conv ORDER BY saved_at, mode) AS BIGINT) AS saved_so_far FROM
       (SELECT conv, n%50 AS saved_at, tool AS mode, count(*) AS blocks, CAST(sum(chars) AS BIGINT) AS saved FROM f3_calls_src GROUP BY 1,2,3) t""",
)
def condense_log(spark, sf):
    log = view(spark, sf, "f3_calls_src").select("conv", (F.col("n") % 50).alias("saved_at"), F.col("tool").alias("mode"), F.lit(1).alias("blocks"), F.col("chars").alias("saved"))
    return rw.condense_log_totals(log)


# ---- cuts -----------------------------------------------------------------------------------

_CUT = """
 c AS (SELECT *, max(pos) OVER (PARTITION BY conv) AS n FROM f2_chain),
 k AS (SELECT conv, max(n) AS n, {cut} AS cut FROM c GROUP BY conv),
 p AS (SELECT k.conv, k.n, k.cut, (SELECT min(pos) FROM c WHERE c.conv=k.conv AND c.pos>=k.cut AND c.type IN ('user','system')) AS root_pos FROM k)
"""
_REPORT = """SELECT p.conv, p.n AS chain_length, CASE WHEN cut IS NULL THEN '{why}' WHEN root_pos IS NULL THEN 'no_valid_root' ELSE 'pruned' END AS verdict,
  CAST(cut-1 AS BIGINT) AS orphaned_before, CAST((SELECT coalesce(sum(ceil(length(text)/4.0)) FILTER (pos<p.cut),0) FROM c WHERE c.conv=p.conv) AS BIGINT) AS tokens_freed,
  root_pos, (SELECT type FROM c WHERE c.conv=p.conv AND c.pos=p.root_pos) AS root_type, root_pos-1 AS orphaned_after FROM p"""
_OUT = """SELECT m.conv, m.line, m.uuid, CASE WHEN m.uuid IN (SELECT uuid FROM c JOIN p ON p.conv=c.conv AND p.root_pos=c.pos) THEN NULL ELSE m.parent_uuid END AS parent_uuid FROM f2_messages m"""
_PERCENT = _CUT.format(cut="CAST(least(greatest(floor(max(n)*CAST(0.4 AS DOUBLE)),1), max(n)-1)+1 AS BIGINT)")
_NUMBER = _CUT.format(cut="CASE WHEN max(n)>=4 THEN CAST(4 AS BIGINT) END")
_PHRASE = _CUT.format(cut="min(pos) FILTER (contains(lower(text), 'the on'))")


def _pair(spark, sf):
    rows = branched(spark, sf)
    return view(spark, sf, "f2_messages"), rows


def _slim(df):
    return df.select("conv", "line", "uuid", "parent_uuid")


@query("prune_oldest_percent", f"WITH {_PERCENT} {_OUT}")
def prune_oldest_percent(spark, sf):
    return _slim(pr.prune_oldest_percent(*_pair(spark, sf), 40)[0])


@query("prune_oldest_percent_report", f"WITH {_PERCENT} {_REPORT.format(why='')}")
def prune_oldest_percent_report(spark, sf):
    return pr.prune_oldest_percent(*_pair(spark, sf), 40)[1]


@query("prune_before_message", f"WITH {_NUMBER} {_REPORT.format(why='out_of_range')}")
def prune_before_message(spark, sf):
    return pr.prune_before_message(*_pair(spark, sf), 4)[1]


@query("prune_before_message_rows", f"WITH {_NUMBER} {_OUT}")
def prune_before_message_rows(spark, sf):
    return _slim(pr.prune_before_message(*_pair(spark, sf), 4)[0])


@query("prune_after_phrase_rows", f"WITH {_PHRASE} {_OUT}")
def prune_after_phrase_rows(spark, sf):
    return _slim(pr.prune_after_phrase(*_pair(spark, sf), "The ON")[0])


@query("prune_after_phrase", f"WITH {_PHRASE} {_REPORT.format(why='phrase_not_found')}")
def prune_after_phrase(spark, sf):
    return pr.prune_after_phrase(*_pair(spark, sf), "The ON")[1]


@query(
    "prune_digest",
    f"""WITH {_PERCENT}, d AS (SELECT c.*, floor((pos-1)/2.0) AS s, sum(CASE WHEN type='user' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv ORDER BY pos) AS turn_id FROM c JOIN p ON p.conv=c.conv AND c.pos<p.root_pos)
      SELECT conv, CAST(s+1 AS BIGINT) AS segment_id, min(pos) AS msg_from, max(pos) AS msg_to, CAST(min(turn_id) FILTER (turn_id>0) AS BIGINT) AS turn_from, CAST(max(turn_id) FILTER (turn_id>0) AS BIGINT) AS turn_to, min_by(ts,pos) AS ts_from, max_by(ts,pos) AS ts_to FROM d GROUP BY conv, s""",
)
def prune_digest(spark, sf):
    rows = branched(spark, sf)
    cuts = pr.percent_cut(rows, 40)
    roots = ch.next_valid_root(rows, cuts).select("conv", F.col("root_pos").alias("cut"))
    cuts = cuts.drop("cut").join(roots, "conv")
    blocks = rows.select("conv", "pos", F.lit(0).alias("block_idx"), F.lit("text").alias("type"), F.lit("").alias("tool"), F.lit("{}").alias("args"))
    return pr.prune_digest(rows, blocks, cuts, 2).select("conv", "segment_id", "msg_from", "msg_to", "turn_from", "turn_to", "ts_from", "ts_to")


_SANDWICH = """
 c AS (SELECT *, max(pos) OVER (PARTITION BY conv) AS n FROM f2_chain),
 k AS (SELECT conv, max(n) AS n, min(pos) FILTER (pos >= n-2+1 AND type IN ('user','system')) AS recent, max(uuid) FILTER (pos=1) AS early FROM c GROUP BY conv),
 p AS (SELECT *, CASE WHEN n<=3 THEN 'too_short' WHEN recent IS NULL THEN 'no_valid_root' WHEN recent<=2 THEN 'nothing_between' ELSE 'pruned' END AS verdict FROM k),
 mid AS (SELECT c.* FROM c JOIN p ON p.conv=c.conv WHERE verdict='pruned' AND pos>1 AND pos<recent),
 s AS (SELECT conv, count(*) AS k, CAST(sum(ceil(length(text)/4.0)) AS BIGINT) AS tok, min_by(ts,pos) AS a, max_by(ts,pos) AS b FROM mid GROUP BY conv),
 r AS (SELECT p.conv, p.early, c.uuid AS recent_uuid, sha256(p.conv||'|'||p.early||'|'||c.uuid) AS h FROM p JOIN c ON c.conv=p.conv AND c.pos=p.recent WHERE verdict='pruned'),
 g AS (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS bid FROM r)
"""


@query(
    "sandwich_prune",
    f"""WITH {_SANDWICH} SELECT m.conv, m.line, m.uuid, coalesce(g.bid, m.parent_uuid) AS parent_uuid, m.type, m.text FROM f2_messages m LEFT JOIN g ON g.conv=m.conv AND g.recent_uuid=m.uuid
        WHERE m.uuid NOT IN (SELECT uuid FROM mid)
        UNION ALL SELECT g.conv, (SELECT max(line)+1 FROM f2_messages m WHERE m.conv=g.conv), bid, early, 'system', '[Pruned segment: '||s.k||' messages, '||s.a||' → '||s.b||'.]' FROM g JOIN s ON s.conv=g.conv""",
)
def sandwich_prune(spark, sf):
    return pr.sandwich_prune(*_pair(spark, sf), 1, 2)[0].drop("ts")


@query("sandwich_backup", f"WITH {_SANDWICH} SELECT conv, pos, uuid, text FROM mid")
def sandwich_backup(spark, sf):
    return pr.sandwich_prune(*_pair(spark, sf), 1, 2)[1].select("conv", "pos", "uuid", "text")


@query(
    "sandwich_report",
    f"""WITH {_SANDWICH} SELECT p.conv, p.n AS chain_length, verdict, coalesce(s.k,0) AS middle_count, coalesce(s.tok,0) AS tokens_freed, CASE WHEN verdict='pruned' THEN n-s.k+1 ELSE n END AS new_chain_length FROM p LEFT JOIN s ON s.conv=p.conv""",
)
def sandwich_report(spark, sf):
    return pr.sandwich_prune(*_pair(spark, sf), 1, 2)[2]


_MARK = """CASE WHEN type='assistant' AND (conv+line)%5<>0 THEN CASE WHEN line%2=0 THEN '## SESSION HANDOFF'||chr(10) ELSE 'first'||chr(10)||'## SESSION HANDOFF ' END||text
  WHEN type='user' THEN 'see ## SESSION HANDOFF '||text ELSE text END"""
_HAND = f"""
 c0 AS (SELECT conv, pos, uuid, type, {_MARK} AS text FROM f2_chain),
 c AS (SELECT *, max(pos) OVER (PARTITION BY conv) AS n FROM c0),
 mk AS (SELECT *, lag(pos) OVER (PARTITION BY conv ORDER BY pos) AS before FROM c WHERE type='assistant' AND (contains(text, chr(10)||'## SESSION HANDOFF ') OR starts_with(text, '## SESSION HANDOFF'||chr(10)))),
 gr AS (SELECT conv, max(pos) AS newest_pos, max(pos) FILTER (before IS NULL OR pos-before>2) AS oldest_pos FROM mk GROUP BY conv),
 p AS (SELECT k.conv, k.n, gr.newest_pos, gr.oldest_pos, (SELECT count(*) FROM mk WHERE mk.conv=k.conv AND mk.pos>=gr.oldest_pos) AS markers,
   (SELECT max(pos) FROM c WHERE c.conv=k.conv AND c.pos<=gr.oldest_pos AND type IN ('user','system')) AS prim FROM (SELECT conv, max(n) AS n FROM c GROUP BY conv) k LEFT JOIN gr ON gr.conv=k.conv),
 q AS (SELECT p.*, coalesce((SELECT max(pos) FROM c WHERE c.conv=p.conv AND p.prim IS NOT NULL AND c.pos<=greatest(p.prim-{{x}},1) AND type IN ('user','system')), prim) AS anc FROM p)
"""


def _handoff(spark, sf, **kw):
    m, rows = _pair(spark, sf)
    mark = F.expr(_MARK)
    return pr.prune_to_handoff(m.withColumn("text", mark), rows.withColumn("text", mark), window=2, **kw)


@query(
    "prune_to_handoff",
    f"""WITH {_HAND.format(x=0)} SELECT m.conv, m.line, m.uuid, CASE WHEN m.uuid IN (SELECT c.uuid FROM c JOIN q ON q.conv=c.conv AND q.anc=c.pos) THEN NULL ELSE m.parent_uuid END AS parent_uuid FROM f2_messages m""",
)
def prune_to_handoff(spark, sf):
    return _slim(_handoff(spark, sf)[0])


@query(
    "handoff_report",
    f"""WITH {_HAND.format(x=1)}, t AS (SELECT q.conv, substr(c.text, instr(c.text, '## SESSION HANDOFF')) AS rest FROM q JOIN c ON c.conv=q.conv AND c.pos=q.oldest_pos)
     SELECT q.conv, n AS chain_length, CASE WHEN newest_pos IS NULL THEN 'no_marker' WHEN anc IS NULL THEN 'no_anchor' ELSE 'pruned' END AS verdict, newest_pos, oldest_pos,
      CASE WHEN newest_pos IS NOT NULL THEN markers END AS markers, anc AS anchor_pos, prim-anc AS buffer_applied, anc-1 AS orphaned, n-anc+1 AS kept,
      CASE WHEN prim IS NOT NULL THEN CAST((SELECT coalesce(sum(ceil(length(text)/4.0)) FILTER (pos<q.anc),0) FROM c WHERE c.conv=q.conv) AS BIGINT) END AS tokens_freed,
      rtrim(substr(rest,1,400), ' '||chr(10))||CASE WHEN length(rest)>400 THEN chr(10)||'…(truncated)' ELSE '' END AS snippet FROM q LEFT JOIN t ON t.conv=q.conv""",
)
def handoff_report(spark, sf):
    return _handoff(spark, sf, extra=1, dry_run=True)[1]


# ---- compaction ------------------------------------------------------------------------------

_COMPACT = """
SELECT conv, line, uuid, CASE WHEN conv%3=0 AND mx>=3 AND line=2 THEN NULL ELSE parent_uuid END AS parent_uuid,
  CASE WHEN conv%3=0 AND mx>=3 AND line=2 THEN 'system' WHEN conv%3=0 AND mx>=3 AND line=3 THEN 'user' ELSE type END AS type, ts,
  CASE WHEN conv%3=0 AND mx>=3 AND line=3 THEN 'This session is being continued from before' ELSE text END AS text,
  conv%3=0 AND mx>=3 AND line=2 AS is_boundary, FALSE AS is_summary,
  CASE WHEN conv%3=0 AND mx>=3 AND line=2 AND conv%5<>4 THEN CASE WHEN conv%7=0 THEN 'gone' ELSE CAST(conv AS STRING)||'-1' END END AS logical_parent_uuid, mx
FROM (SELECT *, max(line) OVER (PARTITION BY conv) AS mx FROM f1_messages) m
"""
_RESTORE = f"""
 m AS ({_COMPACT}),
 p AS (SELECT DISTINCT conv, mx, CASE WHEN NOT (conv%3=0 AND mx>=3) THEN 'no_compaction' WHEN conv%5=4 THEN 'no_logical_parent' WHEN conv%7=0 THEN 'parent_missing' WHEN mx<4 THEN 'nothing_after' ELSE 'restored' END AS verdict FROM m)
"""


def _restore(spark, sf):
    m = sql(spark, sf, _COMPACT).drop("mx")
    return pr.restore_compaction(m, ch.chain_messages(m, ch.walk_chain(m)))


@query(
    "restore_compaction",
    f"WITH {_RESTORE} SELECT m.conv, m.line, m.uuid, CASE WHEN p.verdict='restored' AND m.line=4 THEN m.conv||'-1' ELSE m.parent_uuid END AS parent_uuid FROM m JOIN p ON p.conv=m.conv",
)
def restore_compaction(spark, sf):
    return _slim(_restore(spark, sf)[0])


@query(
    "restore_compaction_report",
    f"""WITH {_RESTORE} SELECT conv, CASE WHEN verdict='no_compaction' THEN mx+1 ELSE mx-1 END AS chain_length, verdict, CASE WHEN verdict<>'no_compaction' THEN 1 END AS boundary_pos, CASE WHEN verdict<>'no_compaction' THEN 2 END AS summary_pos,
      CASE WHEN verdict='restored' THEN 2 ELSE 0 END AS restored, CASE WHEN verdict='restored' THEN (SELECT CAST(sum(ceil(length(text)/4.0)) AS BIGINT) FROM m WHERE m.conv=p.conv AND line<2) ELSE 0 END AS restored_tokens FROM p""",
)
def restore_compaction_report(spark, sf):
    return _restore(spark, sf)[1]


_META = """SELECT conv, line, uuid, parent_uuid, type, ts, text, '/w/'||CAST(conv AS STRING)||'/'||CAST(line AS STRING) AS cwd, CASE WHEN conv%3<>0 THEN 's'||CAST(line AS STRING) END AS session_id,
  CASE WHEN conv%2=0 THEN 'dev' END AS git_branch, CAST(NULL AS STRING) AS version, CAST(NULL AS STRING) AS message_id FROM f2_messages"""
_ROOT = """f AS (SELECT conv, min(pos) AS fp, coalesce(min(pos) FILTER (type='user'), min(pos)) AS up FROM f2_chain GROUP BY conv),
 e AS (SELECT conv, max(line) AS l, max(ts) AS t FROM f2_messages GROUP BY conv),
 b AS (SELECT e.conv, e.l, e.t, sha256(e.conv||'|'||e.l||'|'||'carry on') AS h, (SELECT line FROM f2_chain c WHERE c.conv=f.conv AND c.pos=f.up) AS sl FROM e JOIN f ON f.conv=e.conv),
 n AS (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS id FROM b)"""
_NEW = """SELECT conv, l+1 AS line, NULL AS uuid, 'file-history-snapshot' AS type, NULL AS text, NULL AS cwd, NULL AS session_id, NULL AS git_branch, NULL AS version, id AS message_id FROM n
  UNION ALL SELECT conv, l+2, id, 'user', 'carry on', '/w/'||conv||'/'||sl, CASE WHEN conv%3<>0 THEN 's'||sl ELSE ''||conv END, CASE WHEN conv%2=0 THEN 'dev' ELSE 'main' END, '2.1.50', NULL FROM n"""


def _inject(spark, sf):
    m = sql(spark, sf, _META)
    return pr.inject_root(m, ch.chain_messages(m, ch.walk_chain(m)), "carry on")


_COLS = ["conv", "line", "uuid", "type", "text", "cwd", "session_id", "git_branch", "version", "message_id"]


@query(
    "inject_root",
    f"WITH {_ROOT} SELECT conv, line, uuid, type, text, '/w/'||conv||'/'||line AS cwd, CASE WHEN conv%3<>0 THEN 's'||line END AS session_id, CASE WHEN conv%2=0 THEN 'dev' END AS git_branch, NULL AS version, NULL AS message_id FROM f2_messages UNION ALL {_NEW}",
)
def inject_root(spark, sf):
    return _inject(spark, sf)[0].select(*_COLS)


@query("prune_orphan_lines", f"WITH {_ROOT} SELECT conv, line, uuid, type, message_id FROM ({_NEW}) x UNION ALL SELECT n.conv, n.l+3, 'child', 'assistant', NULL FROM n")
def prune_orphan_lines(spark, sf):
    m, roots = _inject(spark, sf)
    child = m.groupBy("conv").agg(F.max("line").alias("l")).join(roots, "conv").select(
        "conv", (F.col("l") + 1).alias("line"), F.lit("child").alias("uuid"), F.col("uuid").alias("parent_uuid"), F.lit("assistant").alias("type")
    )
    return pr.prune_orphan_lines(m.unionByName(child, allowMissingColumns=True), roots).select("conv", "line", "uuid", "type", "message_id")
