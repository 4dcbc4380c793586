"""Named views over the driver's tables; the same SQL text runs in Spark and in the oracle engine."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators.scan import attach, scan
from chainloom.operators.storage import materialise

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "f1_messages": """
SELECT conv_id AS conv, turn AS line,
  CAST(conv_id AS STRING)||'-'||CAST(turn AS STRING) AS uuid,
  CASE WHEN turn > 0 THEN CAST(conv_id AS STRING)||'-'||CAST(turn-1 AS STRING) END AS parent_uuid,
  role AS type, conv_id*3600 + turn*60 AS ts, text
FROM conversations
""",
    "f2_sized": "SELECT *, max(line) OVER (PARTITION BY conv) AS mx FROM f1_messages",
    "f3_numbered": "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM events",
    "f3_sized": "SELECT *, max(turn_id) OVER (PARTITION BY conv) AS total_turns FROM f3_blocks",
    "f3_lines": "SELECT *, CAST(row_number() OVER (PARTITION BY conv ORDER BY pos, type DESC, uuid) - 1 AS BIGINT) AS line FROM f3_blocks",
    "f3_linked": "SELECT *, lag(uuid) OVER (PARTITION BY conv ORDER BY line) AS before FROM f3_lines",
    "f8_sized": "SELECT *, max(turn_id) OVER (PARTITION BY conv) AS total_turns FROM f8_turns",
    "part_lines": "SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS line FROM part",
    "f2_messages": """
SELECT conv, line, uuid,
  CASE WHEN line = 0 THEN NULL
       WHEN conv % 4 IN (1,3) AND line = mx AND line >= 2 THEN CAST(conv AS STRING)||'-'||CAST(line-2 AS STRING)
       WHEN conv % 4 = 2 AND line = 2 THEN NULL
       ELSE parent_uuid END AS parent_uuid,
  type, CASE WHEN conv % 4 = 3 AND line = mx AND line >= 2 THEN ts - 60 ELSE ts END AS ts, text
FROM f2_sized
""",
    "f3_calls_src": """
SELECT conv, n, event_id, tool, k, turn_id, path, chars,
  'tu_'||CAST(event_id AS STRING) AS tool_id, 'c'||CAST(event_id AS STRING) AS call_uuid, 'r'||CAST(event_id AS STRING) AS result_uuid,
  CASE WHEN tool IN ('Read','Edit') THEN '{"file_path":"'||path||'"}' ELSE '{"k":'||CAST(k AS STRING)||'}' END AS args,
  repeat('ab', CAST(chars/2 AS INT)) AS result_text
FROM (SELECT user_id AS conv, n, event_id, k, CAST(floor((n-1)/10.0) AS BIGINT)+1 AS turn_id,
        CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'Bash'
             WHEN 'signup' THEN 'mcp__worker__get_my_tasks' ELSE 'Edit' END AS tool,
        CASE WHEN k % 10 = 0 THEN '/repo/MEMORY.md' WHEN k % 10 = 1 THEN '/repo/img'||CAST(k AS STRING)||'.png'
             ELSE '/repo/src/f'||CAST(k % 15 AS STRING)||'.py' END AS path,
        180 + 540 * (CAST(floor(value) AS BIGINT) % 3) AS chars
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM f3_numbered) e) x
""",
    "f3_blocks": """
SELECT conv, 2*n-1 AS pos, call_uuid AS uuid, 0 AS block_idx, 'tool_use' AS type, tool_id, tool, args, path, turn_id, CAST(NULL AS STRING) AS result_text FROM f3_calls_src
UNION ALL
SELECT conv, 2*n + CASE WHEN event_id % 97 = 0 THEN 10 ELSE 0 END AS pos, result_uuid, 0, 'tool_result', tool_id, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), turn_id, result_text FROM f3_calls_src
""",
    "f4_code_lines": """
SELECT '/src/'||lower(replace(p_brand,'#','_'))||'.py' AS path, p_partkey AS ord, line,
  CASE p_partkey % 5
    WHEN 0 THEN 'def '||replace(p_name,' ','_')||'_'||CAST(p_size AS STRING)||'(x):'
    WHEN 1 THEN 'class '||replace(p_name,' ','')||CAST(p_size AS STRING)||'(Base):'
    WHEN 2 THEN '    def '||replace(p_name,' ','_')||'(self):'
    WHEN 3 THEN upper(replace(p_name,' ','_'))||' = '||CAST(p_size AS STRING)
    ELSE '    _x = 1' END AS text
FROM part_lines
""",
    "f5_queried": """
SELECT DISTINCT CASE p_partkey % 3
    WHEN 0 THEN replace(p_name,' ','_')||'_'||CAST(p_size AS STRING)
    WHEN 1 THEN replace(p_name,' ','_')||'x'
    ELSE 'zzqq_'||CAST(p_partkey % 50 AS STRING) END AS name
FROM part
""",
    "f7_notes": """
SELECT doc_id AS note_id,
  CASE doc_id % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'plan' WHEN 2 THEN 'pattern' ELSE 'sidecar' END AS tier,
  CASE doc_id % 6 WHEN 0 THEN 'lesson' WHEN 1 THEN 'pattern' WHEN 2 THEN 'caution' WHEN 3 THEN 'edge_case' WHEN 4 THEN 'decision' ELSE 'plan' END AS note_type,
  source AS ref, lang AS keyword, text AS content FROM documents
""",
    "f8_turns": """
SELECT conv, line, uuid, parent_uuid, type, ts, text,
  CAST(sum(CASE WHEN type='user' OR line=0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY line) AS BIGINT) AS turn_id FROM f1_messages
""",
    "f8_scores": """
SELECT DISTINCT conv, turn_id, (conv*37 + turn_id*11) % 101 AS value_score, 'summary '||CAST(conv AS STRING)||'/'||CAST(turn_id AS STRING) AS summary FROM f8_turns WHERE (conv + turn_id) % 9 <> 0
""",
    "f8_decisions": """
SELECT DISTINCT conv, turn_id, CASE (conv + turn_id*3) % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' ELSE 'distill' END AS action,
  CASE WHEN (conv + turn_id*3) % 4 = 2 THEN 'distilled '||CAST(turn_id AS STRING) END AS distillation, 'r' AS reason
FROM f8_turns WHERE (conv*7 + turn_id) % 5 <> 0
""",
    "f3_messages": """
SELECT conv, line, uuid, CASE WHEN conv % 5 = 1 AND line = 24 THEN NULL ELSE before END AS parent_uuid,
  CASE WHEN type = 'tool_result' THEN 'tool_result' WHEN pos % (4 + 2*(conv % 30)) = 1 THEN 'user' ELSE 'assistant' END AS type,
  line*10 AS ts, coalesce(result_text, args) AS text
FROM f3_linked
""",
    "f3_args": """
SELECT conv, n, event_id, k, turn_id, 2*n-1 AS pos, call_uuid AS uuid,
  CASE k % 9 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Grep' WHEN 3 THEN 'Glob' WHEN 4 THEN 'Agent'
    WHEN 5 THEN 'Edit' WHEN 6 THEN 'TaskList' WHEN 7 THEN 'Write' ELSE 'Read' END AS tool,
  CASE k % 9 WHEN 0 THEN '{"file_path":"'||path||'","offset":'||CAST(k AS STRING)||',"limit":50}'
    WHEN 1 THEN '{"command":"make t'||CAST(k AS STRING)||chr(92)||'nsecond line","description":"run '||CAST(k AS STRING)||'"}'
    WHEN 2 THEN '{"pattern":"p'||CAST(k AS STRING)||'","path":"/repo"}'
    WHEN 3 THEN '{"pattern":"*.py"}'
    WHEN 4 THEN '{"subagent_type":"explore","description":"'||repeat('look around ', CAST(k % 10 AS INT))||'"}'
    WHEN 5 THEN '{"file_path":"'||path||'","old_string":"a","new_string":"b"}'
    WHEN 6 THEN '{"a":'||CAST(k AS STRING)||',"b":"'||repeat('xy', CAST(k % 40 AS INT))||'","c":true,"d":"z"}'
    WHEN 7 THEN '{}' ELSE '{"file_path":"'||path||'"}' END AS args,
  path
FROM f3_calls_src
""",
    "f10_parts": """
SELECT conv, event_id, n, k, 0 AS sub FROM f3_args WHERE (n + conv) % 10 = 3
UNION ALL SELECT conv, event_id, n, k, 1 FROM f3_args UNION ALL SELECT conv, event_id, n, k, 2 FROM f3_args
""",
    "f10_lines": "SELECT *, CAST(row_number() OVER (PARTITION BY conv ORDER BY n, sub) - 1 AS BIGINT) AS line FROM f10_parts",
    "f10_rows": """
SELECT conv, event_id, n, k, sub, line,
  CASE sub WHEN 0 THEN 'p' WHEN 1 THEN 'c' ELSE 'r' END||CAST(event_id AS STRING) AS uuid,
  CASE sub WHEN 1 THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN sub = 0 THEN 'prompt '||repeat('please ', CAST(k AS INT))||'end' END AS text
FROM f10_lines
""",
    "f10_blocks": """
SELECT r.conv, r.line, r.uuid, 0 AS block_idx, 'text' AS type, CAST(NULL AS STRING) AS tool, CAST(NULL AS STRING) AS args,
  'note '||CAST(r.k AS STRING)||chr(10)||repeat('more ', CAST(r.k AS INT)) AS text, CAST(NULL AS STRING) AS result_text, FALSE AS is_error
FROM f10_rows r WHERE r.sub = 1 AND r.k % 3 = 0
UNION ALL
SELECT r.conv, r.line, r.uuid, 1, 'tool_use', a.tool, a.args, CAST(NULL AS STRING), CAST(NULL AS STRING), FALSE
FROM f10_rows r JOIN f3_args a ON a.conv = r.conv AND a.n = r.n WHERE r.sub = 1 AND r.k % 3 <> 1
UNION ALL
SELECT r.conv, r.line, r.uuid, 0, 'tool_result', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CASE WHEN r.k % 5 = 0 THEN '  '||chr(10) WHEN r.k % 4 = 0 THEN chr(10)||' out '||CAST(r.k AS STRING)||chr(10)||'rest' ELSE repeat('ok ', CAST(r.k AS INT)) END, r.k % 7 = 0
FROM f10_rows r WHERE r.sub = 2
UNION ALL
SELECT r.conv, r.line, r.uuid, 1, 'tool_result', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 'second '||CAST(r.event_id AS STRING), r.k % 2 = 0
FROM f10_rows r WHERE r.sub = 2 AND r.k % 6 < 2
""",
    "f6_names": """
SELECT p_partkey AS ord, replace(p_name,' ','_')||'_'||CAST(p_partkey % 400 AS STRING) AS nm, upper(replace(p_name,' ','_')) AS upnm, p_size,
  '/src/'||lower(replace(p_brand,'#','_')) AS stem, line
FROM part_lines
""",
    "f6_js_lines": """
SELECT 'app' AS project, stem||CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '.js' END AS path, CASE WHEN p_size % 2 = 0 THEN 'typescript' ELSE 'javascript' END AS lang, ord, line,
  CASE ord % 20
    WHEN 0 THEN 'export async function '||nm||'(a, b) {'
    WHEN 1 THEN 'const '||nm||' = async (a) => {'
    WHEN 2 THEN '  var '||nm||' = function(a) {'
    WHEN 3 THEN 'export default class '||nm||' extends Base {'
    WHEN 4 THEN 'export interface '||nm||' {'
    WHEN 5 THEN 'type '||nm||' = string;'
    WHEN 6 THEN 'let '||nm||' = 3;'
    WHEN 7 THEN '  async '||nm||'(a) {'
    WHEN 8 THEN '  constructor(a) {'
    WHEN 9 THEN '  if (a) {'
    WHEN 10 THEN 'export { '||nm||', other_'||nm||' as b };'
    WHEN 11 THEN 'export default '||nm||';'
    WHEN 12 THEN 'module.exports.'||nm||' = 1;'
    WHEN 13 THEN 'module.exports = { '||nm||', x_'||nm||': 2 };'
    WHEN 14 THEN 'router.get("/items/'||nm||'", h);'
    WHEN 15 THEN 'app.post("/'||upnm||'", h);'
    WHEN 16 THEN 'app.use("/api/'||nm||'", h);'
    WHEN 17 THEN 'exports.'||nm||' = router.get("/never", h);'
    WHEN 18 THEN 'export const '||nm||' = 5;'
    ELSE '// nothing here' END AS text, nm, upnm
FROM f6_names
""",
    "f6_go_lines": """
SELECT 'app' AS project, stem||'.go' AS path, 'go' AS lang, ord, line, nm,
  CASE ord % 6 WHEN 0 THEN 'func '||nm||'(a int) {' WHEN 1 THEN 'func (r *Repo) '||nm||'() error {' WHEN 2 THEN 'type '||nm||' struct {'
    WHEN 3 THEN 'var '||nm||' = 3' WHEN 4 THEN 'type '||nm||' interface {' ELSE '  func '||nm||'(' END AS text
FROM f6_names
""",
    "f6_rust_lines": """
SELECT 'app' AS project, stem||'.rs' AS path, 'rust' AS lang, ord, line, nm,
  CASE ord % 7 WHEN 0 THEN 'pub async fn '||nm||'(a: u8) {' WHEN 1 THEN 'fn '||nm||'() {' WHEN 2 THEN 'pub struct '||nm||' {'
    WHEN 3 THEN 'enum '||nm||' {' WHEN 4 THEN 'trait '||nm||' {' WHEN 5 THEN 'pub static '||nm||': u8 = 1;' ELSE 'impl '||nm||' {' END AS text
FROM f6_names
""",
    "f6_files": """
SELECT 'p'||CAST(ord % 7 AS STRING) AS project, 'src/m'||CAST(ord AS STRING)||'.js' AS path, ord,
  'import { used'||CAST(ord % 50 AS STRING)||' as z, helperB } from '||chr(39)||'./m'||CAST(ord + 7 AS STRING)||chr(39)||';'||chr(10)
  ||'import Widget'||CAST(ord % 9 AS STRING)||' from "../lib/gone'||CAST(ord % 4 AS STRING)||'";'||chr(10)
  ||'const { pick'||CAST(ord % 5 AS STRING)||': q } = require("./m'||CAST(ord AS STRING)||'");'||chr(10)
  ||'/* skipCall(1) '||chr(10)||' more */ // lineCall(2)'||chr(10)
  ||'function localFn(paramFn, b) { localFn(1); paramFn(2); obj.method(3); }'||chr(10)
  ||'callMe'||CAST(ord % 30 AS STRING)||'("inString(4)", b); if (x) { new Thing(5); } ab(6); some_snake(7);'||chr(10)
  ||'fetch("/api/items/'||CAST(ord AS STRING)||'"); fetch("/api/deep"); fetch("/api/opaque/x'||CAST(ord AS STRING)||'"); fetch("/api/none/'||CAST(ord AS STRING)||'/");' AS content
FROM f6_names
""",
    "f1_spoken": """
SELECT conv, line, uuid, parent_uuid, type, ts,
  CASE WHEN type <> 'user' THEN text
       WHEN (conv + line*3) % 4 = 0 THEN 'Fix it: '||text
       WHEN (conv + line*3) % 4 = 1 THEN 'so yes, '||text
       WHEN (conv + line*3) % 4 = 2 THEN 'remove '||text
       ELSE text END AS text
FROM f1_messages
""",
    "f9_usage": """
SELECT conv, CASE conv % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model,
  CAST(sum(CASE WHEN type='assistant' THEN 0 ELSE ceil(length(text)/4.0) END) * 1000 AS BIGINT) AS tokens_in,
  CAST(sum(CASE WHEN type='assistant' THEN ceil(length(text)/4.0) ELSE 0 END) AS BIGINT) AS tokens_out FROM f1_messages GROUP BY conv
""",
}

_MONTH = 30 * 24 * 3600


def _greatest(rows: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """``rows`` with the greatest ``column`` of their conversation."""
    return attach(rows, rows.groupBy("conv").agg(F.max(column).alias(name)), ["conv"], order)


def _numbered(rows: DataFrame, key: str, order: str | list[str], name: str, first: int = 0, **options) -> DataFrame:
    out = scan(rows, [key], order, sums={name: F.lit(1).cast("bigint")}, **options)
    return out.withColumn(name, F.col(name) - 1 + first)


# The views above that look at a whole key, for Spark: no key has to fit into one task.  ``of`` gives a table or view.
SPREAD: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {
    "f2_sized": lambda of: _greatest(of("f1_messages"), "line", "line", "mx"),
    "f3_numbered": lambda of: _numbered(
        of("events").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp"))), "user_id", ["second", "ts", "event_id"], "n", 1, chunk=_MONTH
    ).drop("second"),
    "f3_sized": lambda of: _greatest(of("f3_blocks"), "turn_id", "pos", "total_turns"),
    "f3_lines": lambda of: _numbered(of("f3_blocks").withColumn("late", F.col("type") != "tool_use"), "conv", ["pos", "late", "uuid"], "line").drop("late"),
    "f3_linked": lambda of: scan(of("f3_lines"), ["conv"], "line", prevs={"before": F.col("uuid")}),
    "f8_turns": lambda of: scan(
        of("f1_messages"), ["conv"], "line", sums={"turn_id": F.when((F.col("type") == "user") | (F.col("line") == 0), 1).otherwise(0).cast("bigint")}
    ),
    "f8_sized": lambda of: _greatest(of("f8_turns"), "turn_id", "line", "total_turns"),
    "f10_lines": lambda of: _numbered(of("f10_parts"), "conv", ["n", "sub"], "line"),
    "part_lines": lambda of: _numbered(of("part"), "p_brand", "p_partkey", "line", 1),
}

# Recursive views for the oracle engine only: Spark walks the chain with chainloom.operators.chain.
ORACLE_VIEWS: dict[str, str] = {
    "f2_leaf": """
SELECT conv, uuid FROM (
  SELECT m.conv, m.uuid, row_number() OVER (PARTITION BY m.conv ORDER BY m.ts DESC, m.line) AS rn
  FROM f2_messages m
  WHERE NOT EXISTS (SELECT 1 FROM f2_messages c WHERE c.conv = m.conv AND c.parent_uuid = m.uuid)) t
WHERE rn = 1
""",
    "f2_up": """
SELECT l.conv, l.uuid, CAST(0 AS BIGINT) AS depth FROM f2_leaf l
UNION ALL
SELECT u.conv, m.parent_uuid, u.depth + 1 FROM f2_up u JOIN f2_messages m ON m.conv = u.conv AND m.uuid = u.uuid
WHERE m.parent_uuid IS NOT NULL
""",
    "f2_chain": """
SELECT m.conv, m.line, m.uuid, m.parent_uuid, m.type, m.ts, m.text,
  CAST(max(u.depth) OVER (PARTITION BY m.conv) - u.depth + 1 AS BIGINT) AS pos
FROM f2_up u JOIN f2_messages m ON m.conv = u.conv AND m.uuid = u.uuid
""",
}


def _needs(sql: str, staged: tuple[str, ...] = ()) -> list[str]:
    """Views a text refers to, dependencies first."""
    every = {**VIEWS, **ORACLE_VIEWS}
    order: list[str] = []
    seen: set[str] = set(staged)

    def visit(text: str) -> None:
        for name, body in every.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(body)
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str, staged: tuple[str, ...] = ()) -> str:
    """Prefix a query with the views it uses; a leading WITH of the query is merged.

    ``staged`` names views that exist as tables already.
    """
    every = {**VIEWS, **ORACLE_VIEWS}
    needed = _needs(sql, staged)
    parts = [f"{n} AS ({every[n].strip()})" for n in needed]
    body = sql.strip()
    lead = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if not parts:
        return body
    recursive = "f2_up" in needed or bool(lead and lead.group(1))
    head = "WITH RECURSIVE " if recursive else "WITH "
    if lead:
        return head + ", ".join(parts) + ", " + body[lead.end():]
    return head + ", ".join(parts) + " " + body


# Tables of short rows that the views turn into much text: a few splits of the file would do all the work on it.
DEALT = ("part",)


def load_tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t in DEALT:
                rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
            rows.createOrReplaceTempView(t)


def query(spark: SparkSession, sf_dir: str, sql: str, staged: tuple[str, ...] = ()) -> DataFrame:
    """Run SQL text over the driver's tables and the named views.

    ``staged`` views are written once and read back, so a text that uses one several times
    does not compute it several times.
    """
    for i, name in enumerate(staged):
        materialise(_over(spark, sf_dir, VIEWS[name], staged[:i]), name).createOrReplaceTempView(name)
    return _over(spark, sf_dir, sql, staged)


def _over(spark: SparkSession, sf_dir: str, sql: str, staged: tuple[str, ...]) -> DataFrame:
    built = tuple(n for n in _needs(sql, staged) if n in SPREAD)
    for i, name in enumerate(built):
        before = (*staged, *built[:i])
        SPREAD[name](lambda n, before=before: _over(spark, sf_dir, f"SELECT * FROM {n}", before)).createOrReplaceTempView(name)
    text = with_views(sql, (*staged, *built))
    load_tables(spark, sf_dir, text)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, f"SELECT * FROM {name}")
