"""Queries over archive plans and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import archive as ar
from chainloom.operators import chain as ch
from chainloom.operators import turns as tn
from chainloom.plans.registry import query
from chainloom.plans.turn_queries import flagged
from chainloom.plans.views import query as sql
from chainloom.plans.views import view


def turned(spark, sf):
    """Turns of F1; the chain of an unbranched transcript is its file order."""
    return flagged(view(spark, sf, "f8_turns")).withColumn("pos", F.col("line") + 1)


_D = "d AS (SELECT * FROM f8_decisions)"
_A1 = """a1 AS (SELECT d.conv, d.turn_id, CASE WHEN s.value_score IS NULL THEN d.action WHEN s.value_score>=71 THEN 'keep' WHEN s.value_score>=31 THEN 'distill' ELSE 'drop' END AS na, d.action AS oa, d.distillation AS od, d.reason, s.value_score, s.summary
  FROM f8_decisions d LEFT JOIN f8_scores s ON s.conv=d.conv AND s.turn_id=d.turn_id),
 a2 AS (SELECT conv, turn_id, na AS action, CASE WHEN na<>oa AND na='distill' THEN coalesce(od, summary) ELSE od END AS distillation,
   CASE WHEN na<>oa THEN '[score='||value_score||', threshold-recomputed; was '||oa||'] '||reason ELSE reason END AS reason FROM a1)"""


@query("score_to_action", f"WITH {_A1} SELECT * FROM a2")
def score_to_action(spark, sf):
    return ar.score_to_action(view(spark, sf, "f8_decisions"), view(spark, sf, "f8_scores"))[0]


@query("score_to_action_stats", f"WITH {_A1} SELECT conv, count(*) AS decisions, count(*) FILTER (na<>oa) AS reclassified, count(*) FILTER (value_score IS NULL) AS missing_score FROM a1 GROUP BY conv")
def score_to_action_stats(spark, sf):
    return ar.score_to_action(view(spark, sf, "f8_decisions"), view(spark, sf, "f8_scores"))[1]


@query(
    "force_keep_recent",
    """SELECT d.conv, d.turn_id, CASE WHEN d.turn_id>t.n-2 THEN 'keep' ELSE action END AS action, distillation,
       CASE WHEN d.turn_id>t.n-2 AND action<>'keep' THEN '[force-kept by force_keep_recent_n=2; was '||action||']' ELSE reason END AS reason
       FROM f8_decisions d JOIN (SELECT conv, max(turn_id) AS n FROM f8_turns GROUP BY conv) t ON t.conv=d.conv""",
)
def force_keep_recent(spark, sf):
    return ar.force_keep_recent(view(spark, sf, "f8_decisions"), view(spark, sf, "f8_turns"), 2)


_MIXED = """SELECT conv, turn_id, CASE WHEN (conv+turn_id)%13=0 THEN 'fold' ELSE action END AS action, distillation, reason FROM f8_decisions
 UNION ALL SELECT conv, 1000 + conv%3, 'drop', CAST(NULL AS STRING), 'late' FROM f8_decisions WHERE turn_id=1"""
_ENTRIES = f"""mx AS ({_MIXED}), fp AS (SELECT conv, turn_id, min(line) AS fl FROM f8_turns GROUP BY 1,2),
 en AS (SELECT t.conv, t.uuid, t.line+1 AS pos, CASE WHEN action='distill' AND line=fl THEN 'distill' ELSE 'drop' END AS action, CASE WHEN action='distill' AND line=fl THEN distillation END AS distillation,
   '[turn '||t.turn_id||'] '||CASE WHEN action='distill' AND line<>fl THEN '(collapsed into distill on first uuid)' ELSE reason END AS reason
   FROM f8_turns t JOIN mx ON mx.conv=t.conv AND mx.turn_id=t.turn_id JOIN fp ON fp.conv=t.conv AND fp.turn_id=t.turn_id WHERE action='drop' OR (action='distill' AND distillation IS NOT NULL))"""


def entries(spark, sf):
    return ar.expand_decisions(sql(spark, sf, _MIXED), turned(spark, sf))


@query("expand_decisions", f"WITH {_ENTRIES} SELECT * FROM en")
def expand_decisions(spark, sf):
    return entries(spark, sf)[0]


@query(
    "skipped_decisions",
    f"""WITH {_ENTRIES} SELECT mx.conv, mx.turn_id, CASE WHEN fl IS NULL THEN 'turn not in processed set' WHEN action='distill' THEN 'distill without distillation' ELSE 'unknown action: '||action END AS reason
        FROM mx LEFT JOIN fp ON fp.conv=mx.conv AND fp.turn_id=mx.turn_id WHERE fl IS NULL OR (action='distill' AND distillation IS NULL) OR action='fold'""",
)
def skipped_decisions(spark, sf):
    return entries(spark, sf)[1]


_RAW_ENTRIES = """SELECT conv, CASE WHEN line%5=4 THEN uuid||'?' ELSE uuid END AS uuid, CASE WHEN (conv+line)%7=0 THEN 'keep' WHEN line%2=0 THEN 'distill' ELSE 'drop' END AS action,
 CASE WHEN conv%3=0 THEN '' ELSE 'short' END AS distillation, CASE WHEN conv%4=1 THEN NULL ELSE 'why' END AS reason FROM f1_messages"""
_CODE = "CASE WHEN uuid LIKE '%?' THEN 'unknown_uuid' WHEN action='keep' THEN 'bad_action' WHEN action='distill' AND distillation='' THEN 'missing_distillation' WHEN reason IS NULL THEN 'missing_reason' END"


@query("validate_entries", f"SELECT * FROM ({_RAW_ENTRIES}) e WHERE {_CODE} IS NULL")
def validate_entries(spark, sf):
    return ar.validate_entries(sql(spark, sf, _RAW_ENTRIES), view(spark, sf, "f1_messages"))[0]


@query("rejected_entries", f"SELECT conv, uuid, {_CODE} AS code FROM ({_RAW_ENTRIES}) e WHERE {_CODE} IS NOT NULL")
def rejected_entries(spark, sf):
    return ar.validate_entries(sql(spark, sf, _RAW_ENTRIES), view(spark, sf, "f1_messages"))[1]


_DROP = "(conv*5 + line*3) % 4 < 2"
_LINKS = f"""g AS (SELECT conv, pos, uuid, type, {_DROP} AS gone FROM f2_chain),
 l AS (SELECT *, lag(gone) OVER (PARTITION BY conv ORDER BY pos) AS pg, last_value(CASE WHEN NOT gone THEN uuid END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS np FROM g)"""


@query("reparent", f"WITH {_LINKS.replace('conv, pos, uuid, type, (', 'conv, pos, uuid, type, (')} SELECT conv, pos, uuid, type, np AS new_parent FROM l WHERE NOT gone AND pg")
def reparent(spark, sf):
    m = flagged(view(spark, sf, "f2_messages"))
    rows = ch.chain_messages(m, ch.walk_chain(m))
    return ar.reparent(rows, rows.filter(_DROP))


@query("distill_rows", f"WITH {_ENTRIES} SELECT m.conv, m.uuid, en.distillation AS text, CASE WHEN m.type='assistant' THEN 'array' ELSE 'string' END AS shape, TRUE AS archive_distilled FROM en JOIN f1_messages m ON m.conv=en.conv AND m.uuid=en.uuid WHERE en.action='distill'")
def distill_rows(spark, sf):
    return ar.distill_rows(flagged(view(spark, sf, "f1_messages")), entries(spark, sf)[0])


_TOOLS = "SELECT conv, uuid, line+1 AS pos, 0 AS block_idx, CASE WHEN line%2=0 THEN 'tool_use' ELSE 'tool_result' END AS type FROM f1_messages WHERE (conv+line)%6=0"
_APPLY = f"""{_ENTRIES},
 g AS (SELECT m.*, en.action AS act, en.distillation AS nt FROM f1_messages m LEFT JOIN en ON en.conv=m.conv AND en.uuid=m.uuid),
 l AS (SELECT *, coalesce(lag(act) OVER (PARTITION BY conv ORDER BY line),'')='drop' AS pg, last_value(CASE WHEN coalesce(act,'')<>'drop' THEN uuid END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS np FROM g),
 v AS (SELECT conv, uuid, 'bad_root' AS code FROM l WHERE coalesce(act,'')<>'drop' AND pg AND np IS NULL AND type NOT IN ('user','system')
   UNION ALL SELECT en.conv, en.uuid, 'distills_'||t.type FROM en JOIN ({_TOOLS}) t ON t.conv=en.conv AND t.uuid=en.uuid WHERE en.action='distill'),
 w AS (SELECT conv, min(code) AS code FROM v GROUP BY conv)"""


@query("plan_guards", f"WITH {_APPLY} SELECT * FROM v")
def plan_guards(spark, sf):
    e = entries(spark, sf)[0]
    links = ar.reparent(turned(spark, sf), e.filter("action='drop'"))
    return ar.plan_guards(links, e, sql(spark, sf, _TOOLS))


def _apply(spark, sf, orphan):
    return ar.apply_plan(flagged(view(spark, sf, "f1_messages")), turned(spark, sf), entries(spark, sf)[0], sql(spark, sf, _TOOLS), orphan=orphan)


_APPLIED = """SELECT l.conv, l.line, l.uuid, CASE WHEN w.code IS NULL AND pg AND coalesce(act,'')<>'drop' THEN np ELSE l.parent_uuid END AS parent_uuid, CASE WHEN w.code IS NULL AND act='distill' THEN nt ELSE text END AS text
  FROM l LEFT JOIN w ON w.conv=l.conv"""


@query("apply_plan", f"WITH {_APPLY} {_APPLIED}")
def apply_plan(spark, sf):
    return _apply(spark, sf, True)[0].select("conv", "line", "uuid", "parent_uuid", "text")


@query("apply_plan_remove", f"WITH {_APPLY} {_APPLIED} WHERE w.code IS NOT NULL OR coalesce(act,'')<>'drop'")
def apply_plan_remove(spark, sf):
    return _apply(spark, sf, False)[0].select("conv", "line", "uuid", "parent_uuid", "text")


@query(
    "apply_plan_report",
    f"""WITH {_APPLY} SELECT l.conv, coalesce(max(w.code),'applied') AS verdict, count(*) FILTER (w.code IS NULL AND act='drop') AS dropped, count(*) FILTER (w.code IS NULL AND act='distill') AS distilled,
      count(*) FILTER (w.code IS NULL AND pg AND coalesce(act,'')<>'drop') AS reparented, count(*) FILTER (w.code IS NULL AND act='distill')>0 AS requires_resume FROM l LEFT JOIN w ON w.conv=l.conv GROUP BY l.conv""",
)
def apply_plan_report(spark, sf):
    return _apply(spark, sf, True)[1]


_PLANS = """SELECT conv, 'p'||CAST(conv AS STRING) AS plan_id, sum(length(text)) AS bytes, count(*) AS chain_length, CAST(conv AS STRING)||'-'||CAST(max(line) AS STRING) AS last_uuid FROM f1_messages GROUP BY conv"""
_SUM = f"""{_ENTRIES}, pl AS ({_PLANS}),
 eb AS (SELECT conv, floor(pos/4096.0) AS b, sha256(string_agg('{{"action":'||to_json(action)||coalesce(',"distillation":'||to_json(distillation),'')||',"reason":'||to_json(reason)||',"uuid":'||to_json(uuid)||'}}', ',' ORDER BY pos)) AS d FROM en GROUP BY 1,2),
 ed AS (SELECT conv, sha256(string_agg(d, ',' ORDER BY b)) AS d FROM eb GROUP BY 1),
 ck AS (SELECT pl.*, sha256('{{"entries":"'||coalesce(ed.d,'')||'","bytes":'||bytes||',"messages":'||chain_length||',"conv":'||to_json(pl.conv::VARCHAR)||',"lastMessageUuid":'||to_json(last_uuid)||',"planId":'||to_json(plan_id)||'}}') AS checksum FROM pl LEFT JOIN ed ON ed.conv=pl.conv)"""


def _checked(spark, sf):
    plans = sql(spark, sf, _PLANS)
    e = entries(spark, sf)[0].withColumnRenamed("pos", "ord").withColumn("plan_id", F.concat(F.lit("p"), F.col("conv").cast("string")))
    return plans, e


@query("plan_checksum", f"WITH {_SUM} SELECT plan_id, checksum FROM ck")
def plan_checksum(spark, sf):
    return ar.plan_checksum(*_checked(spark, sf))


@query(
    "canonical_checksum",
    f"""WITH {_ENTRIES}, pl AS ({_PLANS}), eb AS (SELECT conv, string_agg('{{"action":'||to_json(action)||coalesce(',"distillation":'||to_json(distillation),'')||',"reason":'||to_json(reason)||',"uuid":'||to_json(uuid)||'}}', ',' ORDER BY pos) AS d FROM en GROUP BY 1)
      SELECT plan_id, sha256('{{"entries":['||coalesce(d,'')||'],"jsonlBytes":'||bytes||',"jsonlMessages":'||chain_length||',"jsonlPath":"/t/'||pl.conv||'.jsonl","lastMessageUuid":'||to_json(last_uuid)||',"planId":'||to_json(plan_id)||'}}') AS checksum FROM pl LEFT JOIN eb ON eb.conv=pl.conv""",
)
def canonical_checksum(spark, sf):
    plans, e = _checked(spark, sf)
    return ar.canonical_checksum(plans.withColumn("path", F.concat(F.lit("/t/"), F.col("conv").cast("string"), F.lit(".jsonl"))), e)


@query(
    "plan_drift",
    f"WITH {_SUM} SELECT plan_id, conv, CASE conv%6 WHEN 0 THEN 'expired' WHEN 1 THEN 'tampered' WHEN 2 THEN 'checksum_mismatch' WHEN 3 THEN 'drifted' WHEN 4 THEN 'empty_chain' ELSE 'ok' END AS verdict FROM ck",
)
def plan_drift(spark, sf):
    plans, e = _checked(spark, sf)
    k = F.col("conv") % 6
    sums = ar.plan_checksum(plans, e)
    plans = plans.join(sums, "plan_id").withColumns(
        {
            "checksum": F.when(k == 1, "00").otherwise(F.col("checksum")),
            "given_checksum": F.when(k == 2, "11").when(k == 1, "00").otherwise(F.col("checksum")),
            "created_at": F.when(k == 0, 0).otherwise(10_000).cast("bigint"),
        }
    )
    live = plans.filter(k != 4).select("conv", "last_uuid", (F.col("chain_length") + F.when(k == 3, 1).otherwise(0)).alias("chain_length"))
    return ar.plan_drift(plans, e, live, 24 * 3600 * 1000 + 5_000)


@query(
    "plan_report",
    f"""WITH {_ENTRIES}, tu AS (SELECT conv, count(*) FILTER (action='keep') AS k, count(*) FILTER (action='drop') AS d, count(*) FILTER (action='distill') AS s, count(*) FILTER (action='fold') AS u FROM mx GROUP BY conv),
      ac AS (SELECT en.conv, count(*) FILTER (en.action='drop') AS d, count(*) FILTER (en.action='distill') AS s, CAST(sum(CASE WHEN en.action='drop' THEN length(text) ELSE floor(length(text)*CAST(0.9 AS DOUBLE)) END) AS BIGINT) AS f FROM en JOIN f1_messages m ON m.uuid=en.uuid GROUP BY en.conv),
      al AS (SELECT conv, count(*) AS n, sum(length(text)) AS b FROM f1_messages GROUP BY conv)
      SELECT al.conv, n AS chain_length, coalesce(tu.k,0) AS turns_keep, coalesce(tu.d,0) AS turns_drop, coalesce(tu.s,0) AS turns_distill, coalesce(tu.u,0) AS turns_unknown, coalesce(ac.d,0) AS drop_entries, coalesce(ac.s,0) AS distill_entries,
       coalesce(f,0) AS bytes_freed, n-coalesce(ac.d,0)-coalesce(ac.s,0) AS kept_entries, CAST(floor(coalesce(f,0)/b*100+0.5) AS BIGINT) AS reduction_pct FROM al LEFT JOIN tu ON tu.conv=al.conv LEFT JOIN ac ON ac.conv=al.conv""",
)
def plan_report(spark, sf):
    m = view(spark, sf, "f1_messages").withColumn("bytes", F.length("text"))
    return ar.plan_report(sql(spark, sf, _MIXED), entries(spark, sf)[0], m, m)


_SCORED = "SELECT conv, turn_id, CASE WHEN value_score%3=0 THEN 'planning' ELSE 'code_edit' END AS type, summary, CASE WHEN value_score>60 THEN 'load_bearing' ELSE 'supporting' END AS importance, value_score, CASE WHEN value_score%17=0 THEN 'failed' END AS error FROM f8_scores"
_SHORT = "(SELECT conv, turn_id FROM f8_turns GROUP BY 1,2 HAVING count(*)=1)"


def _merged(spark, sf):
    pre = tn.prefilter_turns(turned(spark, sf)).filter("duplicate_signal = 'pf-micro-single-entry'")
    scored = sql(spark, sf, _SCORED).join(pre.select("conv", "turn_id"), ["conv", "turn_id"], "left_anti")
    return ar.merge_scores(pre, scored)


@query("score_breakdown", f"""SELECT conv, type, importance, count(*) AS turns FROM (SELECT conv, type, importance FROM ({_SCORED}) s WHERE error IS NULL AND (conv, turn_id) NOT IN {_SHORT}
  UNION ALL SELECT conv, 'micro', 'discardable' FROM {_SHORT} p) t GROUP BY 1,2,3""")
def score_breakdown(spark, sf):
    return ar.score_breakdown(_merged(spark, sf)[0])


@query("merge_scores", f"SELECT conv, turn_id, type, summary, value_score, error FROM ({_SCORED}) s WHERE (conv, turn_id) NOT IN {_SHORT} UNION ALL SELECT conv, turn_id, 'micro', 'Pre-filtered: single-entry turn (no agent response).', NULL, NULL FROM {_SHORT} p")
def merge_scores(spark, sf):
    return _merged(spark, sf)[0].select("conv", "turn_id", "type", "summary", "value_score", "error")


@query("failed_turns", f"SELECT conv, turn_id, error FROM ({_SCORED}) s WHERE error IS NOT NULL AND (conv, turn_id) NOT IN {_SHORT}")
def failed_turns(spark, sf):
    return _merged(spark, sf)[1]


@query(
    "usage_cost",
    """SELECT conv, model, round(CASE model WHEN 'small' THEN tokens_in/1e6*0.8+tokens_out/1e6*4.0 WHEN 'large' THEN CASE WHEN tokens_in>200000 THEN tokens_in/1e6*6.0+tokens_out/1e6*22.5 ELSE tokens_in/1e6*3.0+tokens_out/1e6*15.0 END END
       + tokens_out/1e6*0.08 + tokens_in/1e6*1.0, 9) AS usd FROM f9_usage""",
)
def usage_cost(spark, sf):
    usage = view(spark, sf, "f9_usage").withColumns({"cache_read": F.col("tokens_out"), "cache_write": F.col("tokens_in")})
    prices = {"small": [(0, 0.80, 4.00)], "large": [(0, 3.00, 15.00), (200_000, 6.00, 22.50)]}
    return ar.usage_cost(usage, prices).select("conv", "model", F.round("usd", 9).alias("usd"))
