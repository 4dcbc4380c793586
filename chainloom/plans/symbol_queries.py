"""Queries over source lines, the symbol registry and code checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import codecheck as cc
from chainloom.operators import symbols as sy
from chainloom.plans.registry import query
from chainloom.plans.views import query as sql
from chainloom.plans.views import view
from chainloom.sources import projects as pj

_SYM = ["project", "category", "name", "path", "line", "ord"]


def python_lines(spark, sf):
    return view(spark, sf, "f4_code_lines").withColumns({"project": F.lit("app"), "lang": F.lit("python")})


_PY = """SELECT 'app' AS project, CASE p_partkey%5 WHEN 1 THEN 'classes' WHEN 3 THEN 'variables' ELSE 'functions' END AS category,
  CASE p_partkey%5 WHEN 0 THEN replace(p_name,' ','_')||'_'||p_size WHEN 1 THEN replace(p_name,' ','')||p_size WHEN 2 THEN replace(p_name,' ','_') ELSE upper(replace(p_name,' ','_')) END AS name,
  '/src/'||lower(replace(p_brand,'#','_'))||'.py' AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line, p_partkey AS ord FROM part"""
_PY = f"SELECT * FROM ({_PY}) y WHERE ord%5<4"


@query("extract_python", _PY)
def extract_python(spark, sf):
    return sy.extract_python(python_lines(spark, sf)).select(*_SYM)


@query("extract_go", "SELECT project, CASE ord%6 WHEN 0 THEN 'functions' WHEN 1 THEN 'functions' WHEN 3 THEN 'variables' ELSE 'classes' END AS category, nm AS name, path, line, ord FROM f6_go_lines WHERE ord%6<5")
def extract_go(spark, sf):
    return sy.extract_go(view(spark, sf, "f6_go_lines")).select(*_SYM)


@query("extract_rust", "SELECT project, CASE WHEN ord%7<2 THEN 'functions' WHEN ord%7=5 THEN 'variables' ELSE 'classes' END AS category, nm AS name, path, line, ord FROM f6_rust_lines WHERE ord%7<6")
def extract_rust(spark, sf):
    return sy.extract_rust(view(spark, sf, "f6_rust_lines")).select(*_SYM)


_JS = """
SELECT project, CASE WHEN ord%20 IN (0,1,2,7) THEN 'functions' WHEN ord%20 IN (3,4,5) THEN 'classes' ELSE 'variables' END AS category, nm AS name, path, line, ord FROM f6_js_lines
 WHERE ord%20 IN (0,1,2,3,6,7,18) OR (ord%20 IN (4,5) AND lang='typescript')
UNION ALL SELECT project, 'exports', nm, path, line, ord FROM f6_js_lines WHERE ord%20 IN (0,3,4,10,11,12,13,17,18)
UNION ALL SELECT project, 'exports', CASE ord%20 WHEN 10 THEN 'other_' ELSE 'x_' END||nm, path, line, ord FROM f6_js_lines WHERE ord%20 IN (10,13)
"""


@query("extract_js", _JS)
def extract_js(spark, sf):
    return sy.extract_js(view(spark, sf, "f6_js_lines")).select(*_SYM)


# One script per part: every form that spans lines, with its declarations by line.
_SPAN_LINES = (
    "export {", "  one_NM,", "  two_NM as other", "};", "const wide_NM = async (", "  a,", "  { b }", ") => {", "  let in_NM = 1, arrow_NM = x => x,",
    "    last_NM = `no ${[1].map((q) => `const never_NM = ${q}`)}", "const never_NM = 2`", "}", "var bare_NM, half_NM = a / b", "/* class Gone_NM {",
    "} */ class Kept_NM {", "  async load_NM(", "    by", "  ) {", "  }", "}", "export default Kept_NM",
)
_SPAN_NAMES = (
    (2, "exports", "one"), (3, "exports", "two"), (5, "functions", "wide"), (9, "variables", "in"), (9, "functions", "arrow"), (10, "variables", "last"),
    (13, "variables", "bare"), (13, "variables", "half"), (15, "classes", "Kept"), (16, "functions", "load"), (21, "exports", "Kept"),
)
_SPAN_FILES = f"""SELECT 'app' AS project, '/js/'||CAST(p_partkey AS STRING)||'.js' AS path, 'javascript' AS lang, p_partkey AS file_ord,
  replace('{"|".join(_SPAN_LINES)}', 'NM', CAST(p_partkey AS STRING)) AS content FROM part"""


@query(
    "extract_js_spans",
    " UNION ALL ".join(
        f"SELECT 'app' AS project, '{category}' AS category, '{name}_'||p_partkey AS name, '/js/'||p_partkey||'.js' AS path, CAST({line} AS BIGINT) AS line FROM part"
        for line, category, name in _SPAN_NAMES
    ),
)
def extract_js_spans(spark, sf):
    files = sql(spark, sf, _SPAN_FILES).withColumn("content", F.replace("content", F.lit("|"), F.lit("\n")))
    return sy.extract_js(sy.explode_lines(files)).select("project", "category", "name", "path", "line")


_ROUTES = """SELECT project, CASE ord%20 WHEN 14 THEN 'GET' WHEN 15 THEN 'POST' ELSE 'MOUNT' END AS method, CASE ord%20 WHEN 14 THEN '/items/'||nm WHEN 15 THEN '/'||upnm ELSE '/api/'||nm END AS path, path AS file, line, ord FROM f6_js_lines WHERE ord%20 IN (14,15,16)"""
_FIRST_ROUTES = f"SELECT project, method, path, arg_min(file, ord) AS file, arg_min(line, ord) AS line, min(ord) AS ord FROM ({_ROUTES}) r GROUP BY 1,2,3"


@query("extract_routes", _FIRST_ROUTES)
def extract_routes(spark, sf):
    return sy.extract_routes(view(spark, sf, "f6_js_lines"))


_HTML = "SELECT 'web' AS project, CAST(page_id AS STRING)||'.html' AS path, page_id AS file_ord, replace(html, '<style>', repeat(chr(10), CAST(page_id%3 AS INT))||'<script src=\"/js/a'||CAST(page_id%5 AS STRING)||'.js\"></script><script src=\"https://cdn/x.js\"></script><style>') AS content FROM pages"


@query(
    "extract_pages",
    f"SELECT project, path, path AS name, CASE WHEN t='' THEN path ELSE t END AS title, '/js/a'||file_ord%5||'.js' AS scripts FROM (SELECT *, regexp_replace(regexp_extract(content, '(?i)<title[^>]*>([^<]+)</title>', 1), '^\\s+|\\s+$', '', 'g') AS t FROM ({_HTML}) h) x",
)
def extract_pages(spark, sf):
    return sy.extract_html(sql(spark, sf, _HTML))[0].select("project", "path", "name", "title", F.array_join("scripts", ",").alias("scripts"))


@query(
    "inline_script_lines",
    f"""SELECT project, path, 1 + length(before) - length(replace(before, chr(10), '')) + i - 1 AS line, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts)+1)) AS i FROM
      (SELECT project, path, split_part(content, '<script>', 1) AS before, string_split(split_part(split_part(content, '<script>', 2), '</script>', 1), chr(10)) AS parts FROM ({_HTML}) h WHERE contains(content, '<script>')) x) y""",
)
def inline_script_lines(spark, sf):
    return sy.extract_html(sql(spark, sf, _HTML))[1].select("project", "path", "line", "text")


_REG = f"SELECT project, category, name, arg_min(path, ord) AS file, arg_min(line, ord) AS line, count(*) AS usages, min(ord) AS ord FROM ({_PY}) p GROUP BY 1,2,3"


def registry(spark, sf):
    return sy.build_registry(sy.extract_python(python_lines(spark, sf)))


@query("build_registry", _REG)
def build_registry(spark, sf):
    return registry(spark, sf)


_FULL = f"""SELECT project, category, name, file, line, usages FROM (SELECT project, category, name, arg_min(path, ord) AS file, arg_min(line, ord) AS line, count(*) AS usages FROM ({_JS}) j GROUP BY 1,2,3) z
 UNION ALL SELECT project, 'apiRoutes', method||' '||path, file, line, NULL FROM ({_FIRST_ROUTES}) r"""


@query("full_registry", _FULL)
def full_registry(spark, sf):
    lines = view(spark, sf, "f6_js_lines")
    full = sy.full_registry(sy.build_registry(sy.extract_symbols(lines)), sy.extract_routes(lines))
    return full.drop("ord")


_RANKED = f"SELECT *, CASE category WHEN 'functions' THEN 1 WHEN 'classes' THEN 2 WHEN 'variables' THEN 3 ELSE 4 END AS rank FROM ({_REG}) g"
_NAMED = f"SELECT name, arg_min(category, rank) AS category, arg_min(file, rank) AS file, arg_min(line, rank) AS line, arg_min(usages, rank) AS usages, min(CAST(rank AS BIGINT)*1000000000+ord) AS place FROM ({_RANKED}) k GROUP BY name"
_ASKED = "SELECT 'app' AS project, name FROM f5_queried"


@query("check_symbols", f"SELECT q.project, q.name, n.name IS NOT NULL AS known, n.category, n.file, n.line, n.usages FROM ({_ASKED}) q LEFT JOIN ({_NAMED}) n ON n.name=q.name")
def check_symbols(spark, sf):
    return sy.check_symbols(sql(spark, sf, _ASKED), registry(spark, sf))


_FUZZY = f"""WITH n AS ({_NAMED}), q AS (SELECT project, name, greatest(2, CAST(floor(length(name)*0.3) AS INT)) AS k FROM ({_ASKED}) a WHERE name NOT IN (SELECT name FROM n)),
 m AS (SELECT q.project, q.name, n.name AS suggestion, levenshtein(lower(q.name), lower(n.name)) AS distance, n.category, n.file, n.line, n.usages, n.place FROM q JOIN n ON levenshtein(lower(q.name), lower(n.name))<=q.k),
 b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, place) AS rn FROM m)"""


@query("fuzzy_symbols", f"{_FUZZY} SELECT project, name, suggestion, CAST(distance AS BIGINT) AS distance, category, file, line, CASE WHEN usages>5 THEN 'well-established' WHEN usages=1 THEN 'rarely used' END AS note FROM b WHERE rn=1")
def fuzzy_symbols(spark, sf):
    return sy.fuzzy_symbols(sql(spark, sf, _ASKED), registry(spark, sf))[0]


@query("unknown_symbols", f"{_FUZZY} SELECT project, name FROM q WHERE name NOT IN (SELECT name FROM b)")
def unknown_symbols(spark, sf):
    return sy.fuzzy_symbols(sql(spark, sf, _ASKED), registry(spark, sf))[1]


# ---- overview -------------------------------------------------------------------------------

_FILES = "SELECT 'app' AS project, path, 'python' AS lang, max(line) AS lines FROM f4_code_lines GROUP BY path UNION ALL SELECT 'app', 'tools/t'||CAST(p_size AS STRING)||'.js', 'javascript', count(*) FROM part GROUP BY p_size UNION ALL SELECT 'app', 'root'||CAST(p_size % 3 AS STRING)||'.ts', 'typescript', count(*) FROM part GROUP BY p_size % 3"
_OV_ROUTES = """SELECT 'app' AS project, CASE ord%3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, '/r/'||CAST(ord AS STRING) AS path, 'routes/'||CASE WHEN ord%2=0 THEN 'big-' ELSE '' END||substr(nm, 1, 3)||CAST(p_size%20 AS STRING)||'.js' AS file, line, ord FROM f6_names WHERE p_size < 40
 UNION ALL SELECT 'app', 'MOUNT', '/api/v'||CAST(p_size%2 AS STRING)||'/big-'||substr(nm,1,2)||'/'||substr(nm, 3, 1)||CAST(p_size%20 AS STRING), 'app.js', line, ord FROM f6_names WHERE p_size >= 20"""


def _overview(spark, sf):
    return sy.project_overview(sql(spark, sf, _FILES), registry(spark, sf), sql(spark, sf, _OV_ROUTES))


@query("overview_dirs", f"SELECT project, CASE WHEN contains(path,'/') THEN regexp_replace(path,'/[^/]*$','') ELSE '.' END AS dir, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM ({_FILES}) f GROUP BY 1,2")
def overview_dirs(spark, sf):
    return _overview(spark, sf)["dirs"]


@query("overview_languages", f"SELECT project, lang, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM ({_FILES}) f GROUP BY 1,2")
def overview_languages(spark, sf):
    return _overview(spark, sf)["languages"]


@query(
    "overview_totals",
    f"SELECT f.*, g.*, (SELECT count(*) FROM ({_OV_ROUTES}) r WHERE method<>'MOUNT') AS routes FROM (SELECT project, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM ({_FILES}) f GROUP BY 1) f, (SELECT count(*) FILTER (category='functions') AS functions, count(*) FILTER (category='classes') AS classes, count(*) FILTER (category='variables') AS variables, 0 AS exports FROM ({_REG}) r) g",
)
def overview_totals(spark, sf):
    return _overview(spark, sf)["totals"]


@query(
    "overview_routes",
    f"""WITH r AS ({_OV_ROUTES}), f AS (SELECT project, file, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods, count(*) AS routes, regexp_replace(regexp_replace(regexp_extract(file,'[^/]*$'),'\\.js$',''),'[-_]','','g') AS base FROM r WHERE method<>'MOUNT' GROUP BY 1,2)
      SELECT project, file, methods, routes, coalesce((SELECT arg_min(r.path, r.ord) FROM r WHERE r.method='MOUNT' AND contains(regexp_replace(r.path,'[/-]','','g'), f.base)),'') AS mount FROM f""",
)
def overview_routes(spark, sf):
    return _overview(spark, sf)["route_files"]


_LISTING = """SELECT 'p'||CAST(ord%3 AS STRING) AS project, CASE ord%12 WHEN 0 THEN 'src/'||nm||'.js' WHEN 1 THEN 'src/node_modules/'||nm||'.js' WHEN 2 THEN '.hidden/'||nm||'.py' WHEN 3 THEN 'old backup/'||nm||'.py'
   WHEN 4 THEN 'myBackups/'||nm||'.py' WHEN 5 THEN 'a/b/c/d/e/f/g/h/i/'||nm||'.go' WHEN 6 THEN 'a/b/c/d/e/f/g/h/'||nm||'.go' WHEN 7 THEN 'web/'||nm||'.html' WHEN 8 THEN 'web/big_'||nm||'.rs' WHEN 9 THEN 'gen/'||nm||'.ts' WHEN 10 THEN nm||'.txt' ELSE nm||'.mjs' END AS path,
  CASE ord%12 WHEN 7 THEN 4000000 WHEN 8 THEN 600000 ELSE 100 + ord END AS size, ord%12 AS kind, nm FROM f6_names"""


@query(
    "select_files",
    f"""SELECT project, path, CASE WHEN kind IN (5,6) THEN 'go' WHEN kind=7 THEN 'html' WHEN kind=8 THEN 'rust' WHEN kind=9 THEN 'typescript' ELSE 'javascript' END AS lang, size
      FROM ({_LISTING}) l WHERE kind IN (0,5,6,7,8,11) OR (kind=9 AND project<>'p1')""",
)
def select_files(spark, sf):
    ignores = sql(spark, sf, "SELECT DISTINCT 'p'||CAST(ord%3 AS STRING) AS project, CASE WHEN ord%3=1 THEN '# x'||chr(10)||'*.log'||chr(10)||' gen/ ' ELSE '' END AS content FROM f6_names")
    return pj.select_files(sql(spark, sf, _LISTING), pj.ignored_dirs(ignores)).select("project", "path", "lang", "size")


# ---- code checks ----------------------------------------------------------------------------


def code_files(spark, sf):
    return view(spark, sf, "f6_files").withColumn("scan_text", F.col("content"))


_REFS = """
SELECT project, path, ord, 'used'||ord%50 AS name FROM f6_files UNION ALL SELECT project, path, ord, 'helperB' FROM f6_files UNION ALL SELECT project, path, ord, 'Widget'||ord%9 FROM f6_files
UNION ALL SELECT project, path, ord, 'pick'||ord%5 FROM f6_files UNION ALL SELECT project, path, ord, 'localFn' FROM f6_files UNION ALL SELECT project, path, ord, 'paramFn' FROM f6_files
UNION ALL SELECT project, path, ord, 'callMe'||ord%30 FROM f6_files UNION ALL SELECT project, path, ord, 'some_snake' FROM f6_files
"""


@query("extract_references", f"SELECT project, path, name FROM ({_REFS}) r")
def extract_references(spark, sf):
    return cc.extract_references(code_files(spark, sf))


_KNOWN = "SELECT DISTINCT 'p'||CAST(ord % 7 AS STRING) AS project, CASE WHEN ord % 3 = 0 THEN 'used' ELSE 'callMe' END||CAST(ord % 21 AS STRING) AS name FROM f6_names WHERE ord % 7 < 5"


@query(
    "unknown_references",
    f"SELECT project, path, name FROM ({_REFS}) r WHERE name NOT IN ('localFn','paramFn','some_snake') AND project IN (SELECT project FROM ({_KNOWN}) k) AND (project, name) NOT IN (SELECT (project, name) FROM ({_KNOWN}) k)",
)
def unknown_references(spark, sf):
    return cc.unknown_references(code_files(spark, sf), sql(spark, sf, _KNOWN))


@query(
    "bad_import_paths",
    """SELECT project, path, target FROM (SELECT project, path, './m'||ord+7 AS target, ord+7 AS want FROM f6_files UNION ALL SELECT project, path, '../lib/gone'||ord%4, -1 FROM f6_files WHERE ord%4<>2) t
       WHERE NOT EXISTS (SELECT 1 FROM f6_files f WHERE f.project=t.project AND f.ord=t.want)""",
)
def bad_import_paths(spark, sf):
    files = code_files(spark, sf)
    known = files.select("project", "path").unionByName(sql(spark, sf, "SELECT DISTINCT project, 'lib/gone2/index.ts' AS path FROM f6_files"))
    return cc.bad_import_paths(files, known)


_API = """SELECT DISTINCT project, 'GET' AS method, '/api/items/'||CASE WHEN ord%2=0 THEN ':id' ELSE 'x' END AS path FROM f6_files WHERE project<>'p6' AND (ord%2=1 OR project<>'p5')
 UNION ALL SELECT DISTINCT project, 'GET', '/api/deep/er' FROM f6_files WHERE project<>'p6' UNION ALL SELECT DISTINCT project, 'GET', '/api/none/y' FROM f6_files WHERE project<>'p6'
 UNION ALL SELECT DISTINCT project, 'MOUNT', '/api/opaque' FROM f6_files WHERE project<>'p6' UNION ALL SELECT DISTINCT project, 'MOUNT', '/api/none' FROM f6_files WHERE project<>'p6'"""


@query(
    "bad_routes",
    "SELECT project, path, '/api/none/'||ord||'/' AS route FROM f6_files WHERE project<>'p6'"
    " UNION ALL SELECT project, path, '/api/items/'||ord FROM f6_files WHERE project='p5'",
)
def bad_routes(spark, sf):
    return cc.bad_routes(code_files(spark, sf), sql(spark, sf, _API))


@query(
    "check_code",
    f"""SELECT project, path, 'route' AS kind, '/api/none/'||ord||'/' AS subject FROM f6_files WHERE project<>'p6'
        UNION ALL SELECT project, path, 'route', '/api/items/'||ord FROM f6_files WHERE project='p5'
        UNION ALL SELECT project, path, 'symbol', name FROM ({_REFS}) r WHERE name NOT IN ('localFn','paramFn','some_snake') AND project IN (SELECT project FROM ({_KNOWN}) k) AND (project, name) NOT IN (SELECT (project, name) FROM ({_KNOWN}) k)
        UNION ALL SELECT project, path, 'import', '../lib/gone'||ord%4 FROM f6_files
        UNION ALL SELECT project, path, 'import', './m'||ord+7 FROM f6_files t WHERE NOT EXISTS (SELECT 1 FROM f6_files f WHERE f.project=t.project AND f.ord=t.ord+7)""",
)
def check_code(spark, sf):
    files = code_files(spark, sf)
    return cc.check_code(files, sql(spark, sf, _KNOWN), sql(spark, sf, _API), files)


# One project per source file, for jobs that work project by project.
def project_lines(spark, sf):
    return view(spark, sf, "f4_code_lines").withColumns({"project": F.regexp_replace("path", "^.*/", ""), "lang": F.lit("python")})


FULL_REINDEX = f"""SELECT regexp_replace(path,'^.*/','') AS project, category, name, arg_min(path, ord) AS file, arg_min(line, ord) AS line,
 count(*) + CASE WHEN min(path) IN (SELECT path FROM f4_code_lines WHERE ord%3=0 AND path < '/src/brand_3') THEN 0 ELSE 100 END AS usages FROM ({_PY}) p GROUP BY 1,2,3"""
