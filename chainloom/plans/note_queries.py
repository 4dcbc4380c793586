"""Queries over notes, keywords and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import notes as nt
from chainloom.plans.registry import query
from chainloom.plans.views import query as sql
from chainloom.plans.views import view

_ONE = "replace(content, chr(10), ' ')"
_DOCS = f"""SELECT tier, 'n'||CAST(note_id AS STRING) AS ref, '# title'||chr(10)||'- early'||chr(10)||'## '||note_type||chr(10)||'- '||{_ONE}||chr(10)||'plain'||chr(10)||'- second (2026-01-0'||CAST(note_id%9+1 AS STRING)||')'
  ||chr(10)||'## Other'||chr(10)||'- third'||CASE WHEN note_id%3=0 THEN chr(10)||'## '||note_type||chr(10)||'- again' ELSE '' END AS content, note_id, note_type FROM f7_notes"""


@query(
    "parse_notes",
    f"""WITH d AS ({_DOCS}), n AS (SELECT note_id, {_ONE} AS one FROM f7_notes)
     SELECT tier, ref, note_type AS header, 2 AS header_ord, 1 AS seq, 'again' AS entry, CAST(NULL AS DATE) AS date FROM d WHERE note_id%3=0
     UNION ALL SELECT tier, ref, note_type, 2, 1, one, NULL FROM d JOIN n ON n.note_id=d.note_id WHERE d.note_id%3<>0
     UNION ALL SELECT tier, ref, note_type, 2, 2, 'second (2026-01-0'||note_id%9+1||')', make_date(2026,1,CAST(note_id%9+1 AS INT)) FROM d WHERE note_id%3<>0
     UNION ALL SELECT tier, ref, 'Other', 6, 1, 'third', NULL FROM d""",
)
def parse_notes(spark, sf):
    return nt.parse_notes(sql(spark, sf, _DOCS))


_HEADER = "CASE note_type WHEN 'caution' THEN 'Cautions' WHEN 'edge_case' THEN CASE WHEN tier='section' THEN 'Edge cases' ELSE 'Edge Cases' END WHEN 'decision' THEN 'Decisions' WHEN 'lesson' THEN 'Lessons' WHEN 'pattern' THEN 'Patterns' ELSE 'Plans' END"
_NOTES = f"""SELECT tier, ref, header, header_ord, seq, entry, CAST(NULL AS DATE) AS date FROM (SELECT tier, ref, {_HEADER} AS header, CASE note_type WHEN 'lesson' THEN 3 WHEN 'pattern' THEN 10 WHEN 'caution' THEN 20 WHEN 'edge_case' THEN 30 WHEN 'decision' THEN 40 ELSE 50 END AS header_ord,
  CAST(row_number() OVER (PARTITION BY tier, ref, note_type ORDER BY note_id) AS BIGINT) AS seq, 'old '||CAST(note_id AS STRING) AS entry FROM f7_notes WHERE note_id%2=0) x"""
_NEW = "SELECT tier, ref, CASE WHEN note_id%11=0 THEN 'rumour' ELSE note_type END AS note_type, CASE WHEN note_id%13=0 THEN '  ' ELSE 'new '||CAST(note_id AS STRING) END AS text, note_id AS ord FROM f7_notes WHERE note_id%2=1"


_ADDED = f"""WITH o AS ({_NOTES}), v AS (SELECT *, {_HEADER} AS header FROM ({_NEW}) n WHERE note_type<>'rumour' AND text<>'  '),
     c AS (SELECT tier, ref, header, count(*) AS added, min(ord) AS fo FROM v GROUP BY 1,2,3), k AS (SELECT tier, ref, header, min(header_ord) AS ho FROM o GROUP BY 1,2,3), e AS (SELECT tier, ref, max(ho) AS lo FROM k GROUP BY 1,2),
     h AS (SELECT * FROM k UNION ALL SELECT c.tier, c.ref, c.header, coalesce(e.lo,-1)+row_number() OVER (PARTITION BY c.tier, c.ref ORDER BY fo, c.header) FROM c LEFT JOIN e ON e.tier=c.tier AND e.ref=c.ref WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.tier=c.tier AND k.ref=c.ref AND k.header=c.header))
     SELECT o.tier, o.ref, o.header, o.header_ord, o.seq+coalesce(c.added,0) AS seq, o.entry, o.date FROM o LEFT JOIN c ON c.tier=o.tier AND c.ref=o.ref AND c.header=o.header
     UNION ALL SELECT v.tier, v.ref, v.header, h.ho, row_number() OVER (PARTITION BY v.tier, v.ref, v.header ORDER BY v.ord DESC), CASE WHEN v.tier='section' THEN '**'||text||'**' ELSE text END||' (2026-05-01)', DATE '2026-05-01' FROM v JOIN h ON h.tier=v.tier AND h.ref=v.ref AND h.header=v.header"""


@query("add_notes", _ADDED)
def add_notes(spark, sf):
    return nt.add_notes(sql(spark, sf, _NOTES), sql(spark, sf, _NEW), "2026-05-01")[0]


@query("rendered_notes", f"SELECT tier, ref, header, seq, entry, date FROM ({_ADDED}) x")
def rendered_notes(spark, sf):
    added = nt.add_notes(sql(spark, sf, _NOTES), sql(spark, sf, _NEW), "2026-05-01")[0]
    return nt.parse_notes(nt.render_notes(added)).select("tier", "ref", "header", "seq", "entry", "date")


@query("rejected_notes", f"SELECT * FROM ({_NEW}) n WHERE note_type='rumour' OR text='  '")
def rejected_notes(spark, sf):
    return nt.add_notes(sql(spark, sf, _NOTES), sql(spark, sf, _NEW), "2026-05-01")[1]


@query(
    "global_notes",
    """SELECT tier, ref, arg_max(content, note_id) AS content FROM (SELECT note_id, CASE WHEN note_type='pattern' THEN 'global/patterns' ELSE 'global/lessons' END AS tier, lower(regexp_replace(CASE WHEN note_id%2=0 THEN 'Kw '||note_id%40 ELSE substr(content,1,30) END, '[^a-zA-Z0-9-]', '-', 'g')) AS ref,
      '# '||split_part(content,'.',1)||chr(10)||chr(10)||'*Type*: '||note_type||' | *Date*: 2026-05-01'||chr(10)||chr(10)||content||chr(10) AS content FROM f7_notes) t GROUP BY 1,2""",
)
def global_notes(spark, sf):
    new = view(spark, sf, "f7_notes").select(
        "note_type", F.col("content").alias("text"), F.col("note_id").alias("ord"),
        F.when(F.col("note_id") % 2 == 0, F.array(F.concat(F.lit("Kw "), (F.col("note_id") % 40).cast("string")))).otherwise(F.array().cast("array<string>")).alias("keywords"),
    )
    return nt.global_notes(new, "2026-05-01")


_ASK = """SELECT note_id AS id, CASE WHEN note_id%17=0 THEN 'plan' ELSE tier END AS tier, CASE WHEN note_id%19=0 THEN 'nowhere' ELSE ref END AS ref, CASE note_id%4 WHEN 0 THEN 'OLD '||CAST(note_id%90 AS STRING) WHEN 1 THEN '' WHEN 2 THEN 'no such' ELSE 'old' END AS search,
  CASE WHEN note_id%7=0 THEN ' ' ELSE ' seen '||CAST(note_id AS STRING)||' ' END AS comment FROM f7_notes"""
_PLACED = f"""o AS ({_NOTES}), a AS (SELECT * FROM ({_ASK}) q WHERE comment<>' '),
 h AS (SELECT a.id, o.header, o.seq, row_number() OVER (PARTITION BY a.id ORDER BY o.header_ord, o.seq) AS rn FROM a JOIN o ON o.tier=a.tier AND o.ref=a.ref AND search<>'' AND contains(lower(o.entry), lower(a.search))),
 p AS (SELECT a.id, a.tier, a.ref, h.header, h.seq, '  > _2026-05-01_: '||trim(comment) AS annotation FROM a JOIN h ON h.id=a.id AND rn=1
  UNION ALL SELECT a.id, a.tier, a.ref, NULL, NULL, '  > _2026-05-01_: '||trim(comment) FROM a WHERE search='' AND EXISTS (SELECT 1 FROM o WHERE o.tier=a.tier AND o.ref=a.ref))"""


@query("annotate_notes", f"WITH {_PLACED} SELECT * FROM p")
def annotate_notes(spark, sf):
    return nt.annotate_notes(sql(spark, sf, _NOTES), sql(spark, sf, _ASK), "2026-05-01")[0]


@query("unmatched_annotations", f"WITH {_PLACED} SELECT id FROM a WHERE id NOT IN (SELECT id FROM p)")
def unmatched_annotations(spark, sf):
    return nt.annotate_notes(sql(spark, sf, _NOTES), sql(spark, sf, _ASK), "2026-05-01")[1]


_INDEX = "SELECT CASE WHEN note_id%2=0 THEN upper(keyword) ELSE keyword END AS keyword, ref, note_id AS ord FROM f7_notes"


@query("keyword_index", f"SELECT lower(keyword) AS keyword, ref, min(ord) AS ord FROM ({_INDEX}) i GROUP BY 1,2")
def keyword_index(spark, sf):
    every = sql(spark, sf, _INDEX)
    return nt.keyword_index(every.filter("ord%4<2"), every.filter("ord%4>=2"))


_WORDS = ["The", "que", "sch", "EN", "zzqq", "tion the", "es"]
_KW = "(VALUES ('the'),('que'),('sch'),('en'),('zzqq'),('tion the'),('es')) w(kw)"


@query(
    "search_notes",
    f"""SELECT kw AS keyword, tier AS source, CAST(note_id AS VARCHAR) AS ref, CASE WHEN s>0 THEN '...' ELSE '' END||regexp_replace(substr(content, s+1, e-s),'^\\s+|\\s+$','','g')||CASE WHEN e<length(content) THEN '...' ELSE '' END AS snippet
      FROM (SELECT *, greatest(0, i-51) AS s, least(length(content), i-1+length(kw)+100) AS e FROM (SELECT *, instr(lower(content), kw) AS i FROM f7_notes, {_KW}) t WHERE i>0) u
      UNION ALL SELECT DISTINCT lower(keyword), 'index', ref, NULL FROM f7_notes WHERE lower(keyword) IN (SELECT kw FROM {_KW})""",
)
def search_notes(spark, sf):
    docs = view(spark, sf, "f7_notes").withColumn("ref", F.col("note_id").cast("string"))
    index = nt.keyword_index(sql(spark, sf, _INDEX).filter("ord < 0"), sql(spark, sf, _INDEX))
    return nt.search_notes(docs, index, _WORDS)


_LISTED = "SELECT tier, 'n'||CAST(note_id AS STRING)||'.md' AS ref, content, date_add(DATE '2026-01-01', CAST(note_id%28 AS INT)) AS modified, note_id FROM f7_notes"
_STATUS = "SELECT 'n'||CAST(note_id AS STRING) AS name, CASE WHEN note_id%3=0 THEN 'done' ELSE 'active' END AS status FROM f7_notes WHERE note_id%8<>1"


@query(
    "list_notes",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ref) AS rn, count(*) OVER (PARTITION BY tier) AS total, strlen(content) AS b FROM ({_LISTED.replace("date_add(DATE '2026-01-01', CAST(note_id%28 AS INT))", "DATE '2026-01-01' + CAST(note_id%28 AS INT)")}) x)
      SELECT l.tier, replace(l.ref,'.md','') AS name, CASE WHEN tier='section' THEN CAST(floor(floor(b/1024.0*10+0.5)/10) AS BIGINT)||'.'||CAST(floor(b/1024.0*10+0.5) AS BIGINT)%10 END AS size_kb,
       CASE WHEN tier IN ('section','sidecar') THEN modified END AS modified, CASE WHEN tier='plan' THEN coalesce(s.status,'unknown') END AS status, total FROM l LEFT JOIN ({_STATUS}) s ON s.name=replace(l.ref,'.md','')""",
)
def list_notes(spark, sf):
    return nt.list_notes(sql(spark, sf, _LISTED), sql(spark, sf, _STATUS))


def _overview(spark, sf):
    f7 = view(spark, sf, "f7_notes").withColumn("name", F.concat(F.lit("n"), F.col("note_id").cast("string")))
    files = f7.filter("note_id%3<>0").select(F.col("ref").alias("section"), F.col("name").alias("file"))
    links = f7.filter("tier='plan'").select(F.col("ref").alias("section"), F.col("name").alias("plan"))
    plans = f7.filter("tier='plan'").select("name", F.expr("CASE WHEN note_id%8=1 THEN 'done' END").alias("status"), F.array("ref", "keyword").alias("sections"))
    return nt.notes_overview(f7.withColumn("ref", F.col("name")), files, links, plans, sql(spark, sf, _INDEX))


@query("overview_sections", "SELECT ref AS section, count(*) FILTER (note_id%3<>0) AS files, count(*) FILTER (tier='plan') AS plans FROM f7_notes WHERE note_id%3<>0 OR tier='plan' GROUP BY ref")
def overview_sections(spark, sf):
    return _overview(spark, sf)["sections"]


@query("overview_plans", "SELECT 'n'||note_id AS name, CASE WHEN note_id%8=1 THEN 'done' ELSE 'unknown' END AS status, ref||', '||keyword AS sections FROM f7_notes WHERE tier='plan'")
def overview_plans(spark, sf):
    return _overview(spark, sf)["plans"]


@query("overview_sidecars", "SELECT 'n'||note_id AS ref FROM f7_notes WHERE tier='sidecar'")
def overview_sidecars(spark, sf):
    return _overview(spark, sf)["sidecars"]


@query("overview_keywords", f"SELECT DISTINCT keyword FROM ({_INDEX}) i")
def overview_keywords(spark, sf):
    return _overview(spark, sf)["keywords"]


_OLD_PLANS = "SELECT DISTINCT 'plan-'||ref AS name, 'paused' AS status, array('base') AS sections, array('f.md') AS files FROM f7_notes WHERE note_id%2=0"
_CHANGES = """SELECT CASE WHEN note_id%3=0 THEN 'Plan '||ref ELSE 'plan_'||keyword||CAST(note_id%4 AS STRING) END AS name, CASE WHEN note_id%5=0 THEN 'done' WHEN note_id%5=1 THEN '' END AS status,
  CASE WHEN note_id%4=0 THEN array(note_type, tier) END AS sections, CASE WHEN note_id%7=0 THEN array('g'||CAST(note_id AS STRING)) END AS files, note_id AS ord FROM f7_notes"""
_UPSERT = """o AS (SELECT DISTINCT 'plan-'||ref AS name, 'paused' AS status, 'base' AS sections, 'f.md' AS files FROM f7_notes WHERE note_id%2=0),
 ch AS (SELECT lower(regexp_replace(CASE WHEN note_id%3=0 THEN 'Plan '||ref ELSE 'plan_'||keyword||note_id%4 END,'[^a-zA-Z0-9-]','-','g')) AS name, CASE WHEN note_id%5=0 THEN 'done' END AS status, CASE WHEN note_id%4=0 THEN note_type||','||tier END AS sections,
   CASE WHEN note_id%7=0 THEN 'g'||note_id END AS files, note_id, note_type, tier FROM f7_notes),
 l AS (SELECT name, arg_max(status, note_id) FILTER (status IS NOT NULL) AS status, arg_max(sections, note_id) FILTER (sections IS NOT NULL) AS sections, arg_max(files, note_id) FILTER (files IS NOT NULL) AS files FROM ch GROUP BY name)"""


@query("upsert_plan", f"WITH {_UPSERT} SELECT coalesce(l.name,o.name) AS name, coalesce(l.status,o.status,'active') AS status, coalesce(l.sections,o.sections,'') AS sections, coalesce(l.files,o.files,'') AS files FROM l FULL JOIN o ON o.name=l.name")
def upsert_plan(spark, sf):
    out = nt.upsert_plan(sql(spark, sf, _OLD_PLANS), sql(spark, sf, _CHANGES))[0]
    return out.select("name", "status", F.array_join("sections", ",").alias("sections"), F.array_join("files", ",").alias("files"))


@query("section_plans", f"WITH {_UPSERT} SELECT section, plan, min(ord) AS ord FROM (SELECT 'base' AS section, name AS plan, -1 AS ord FROM o UNION ALL SELECT note_type, name, note_id FROM ch WHERE sections IS NOT NULL UNION ALL SELECT tier, name, note_id FROM ch WHERE sections IS NOT NULL) x GROUP BY 1,2")
def section_plans(spark, sf):
    return nt.upsert_plan(sql(spark, sf, _OLD_PLANS), sql(spark, sf, _CHANGES))[1]


@query(
    "backup_name",
    """SELECT note_id, strftime(TIMESTAMP '2026-03-04 05:06:07' + INTERVAL 1 SECOND * note_id, '%Y-%m-%d-%H-%M-%S')||'__n'||note_id||CASE WHEN note_id%2=0 AND length(s)>0 THEN '__'||s ELSE '' END||'.md' AS backup FROM
      (SELECT note_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(split_part(content,chr(10),1)),'[^a-z0-9\\s-]','','g'),'\\s+','-','g'),'-{2,}','-','g'),50),'^-|-$','','g') AS s FROM f7_notes) t""",
)
def backup_name(spark, sf):
    f7 = sql(spark, sf, "SELECT note_id, timestampadd(SECOND, note_id, TIMESTAMP '2026-03-04 05:06:07') AS at, CASE WHEN note_id%2=0 THEN 'intro'||chr(10)||'#  '||content ELSE content END AS content FROM f7_notes")
    return f7.select("note_id", nt.backup_name(F.col("at"), F.concat(F.lit("n"), F.col("note_id").cast("string")), F.col("content")).alias("backup"))


@query("get_notes", "SELECT tier, ref, note_id, content FROM f7_notes WHERE (tier='plan' AND ref='src1') OR (tier='section' AND ref='src0')")
def get_notes(spark, sf):
    docs = view(spark, sf, "f7_notes").select("tier", "ref", "note_id", "content")
    keys = docs.filter("(tier='plan' AND ref='src1') OR (tier='section' AND ref='src0')").select("tier", "ref")
    return nt.get_notes(docs, keys)
