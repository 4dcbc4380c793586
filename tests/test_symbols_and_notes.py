import random
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainloom.operators import codecheck as cc
from chainloom.operators import notes as nt
from chainloom.operators import symbols as sy
from chainloom.plans.job_queries import _write_files
from chainloom.sources import projects
from chainloom.sources.notes import scan_notes
from chainloom.sources.projects import INTERACTIVE, scan_project

LINE = "project string, path string, lang string, line bigint, ord bigint, text string"


def lines(spark, lang, *texts):
    return spark.createDataFrame([("p", f"f.{lang}", lang, i + 1, i, t) for i, t in enumerate(texts)], LINE)


def found(df):
    return {(r["category"], r["name"]) for r in df.collect()}


def test_js_rules(spark):
    got = found(
        sy.extract_js(
            lines(
                spark, "typescript",
                "export default async function main(a) {", "const go = x => x;", "let n = 1;", "  constructor(a) {", "  async load(a) {", "  for (x) {",
                "export abstract class Shape {", "export type Id = string;", "interface Box<T> {", "export { a, b as c };", "export default Thing;", "module.exports = { q, r: 1, 's': 2 };", "exports.one = 1;",
            )
        )
    )
    assert got == {
        ("functions", "main"), ("exports", "main"), ("functions", "go"), ("variables", "n"), ("functions", "load"), ("classes", "Shape"), ("exports", "Shape"),
        ("classes", "Id"), ("exports", "Id"), ("classes", "Box"), ("exports", "a"), ("exports", "b"), ("exports", "Thing"), ("exports", "q"), ("exports", "r"), ("exports", "one"),
    }


def test_python_go_rust_rules(spark):
    assert found(sy.extract_python(lines(spark, "python", "async def a(x):", "class B:", "    def c(self):", "    def _d(self):", "MAX_N: int = 3", "low = 1", "  E = 2"))) == {("functions", "a"), ("classes", "B"), ("functions", "c"), ("variables", "MAX_N")}
    assert found(sy.extract_go(lines(spark, "go", "func (r *Repo) Get(x int) {", "type T interface {", "var v = 1", "type U = int"))) == {("functions", "Get"), ("classes", "T"), ("variables", "v")}
    assert found(sy.extract_rust(lines(spark, "rust", "pub async fn f() {", "pub enum E {", "static S: u8 = 1;", "impl X {"))) == {("functions", "f"), ("classes", "E"), ("variables", "S")}


def test_registry_keeps_first_place_and_odd_names(spark):
    reg = sy.build_registry(sy.extract_python(lines(spark, "python", "def toString(x):", "def b(x):", "def toString(y):")))
    assert rows(reg, "name", "line", "usages") == [("b", 2, 1), ("toString", 1, 2)]


def test_html_lines_are_true_lines(spark):
    html = '<html>\n<script src="/a.js"></script><script src="http://x/b.js"></script>\n<title> T </title>\n<script\ntype="m">\nfunction one() {\n</script>\n<script>function two() {</script>'
    pages, code = sy.extract_html(spark.createDataFrame([("p", "web/i.html", 1, html)], "project string, path string, file_ord bigint, content string"))
    assert pages.select("name", "title", "scripts").first() == ("i.html", "T", ["/a.js"])
    assert rows(sy.extract_js(code), "name", "line") == [("one", 6), ("two", 8)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_equals_brute_force_without_cross_join(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abC") for _ in range(rnd.choice([1, 2, 3, 4, 6, 9, 12, 17, 23])))
    names = [word() for _ in range(150)]
    reg = sy.build_registry(spark.createDataFrame([("p", rnd.choice(["functions", "classes"]), n, "f", 1, i) for i, n in enumerate(names)], "project string, category string, name string, path string, line bigint, ord bigint"))
    listed = sorted(((sy.CATEGORIES.index(r["category"]), r["ord"], r["name"]) for r in reg.collect()))
    asked = sorted({word() for _ in range(80)})
    expected = []
    for q in asked:
        if any(q == n for _, _, n in listed):
            continue
        k = max(2, int(len(q) * 0.3))
        near = [(edit_distance(q.lower(), n.lower()), c, o, n) for c, o, n in listed if abs(len(n) - len(q)) <= k]
        best = min((x for x in near if x[0] <= k), default=None)
        expected.append((q, best and best[3], best and best[0]))
    hits, missing = sy.fuzzy_symbols(spark.createDataFrame([("p", a) for a in asked], "project string, name string"), reg)
    got = [(r["name"], r["suggestion"], r["distance"]) for r in hits.collect()] + [(r["name"], None, None) for r in missing.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_references_and_unknowns(spark):
    code = "import { a as b, toolOne } from './x';\nimport React from 'react';\nimport Local from \"./l\";\n// gone(1)\nfunction own(arg) { own(arg()); obj.skip(1); }\nconst s = `mid(${x}) \\` tail(`; realCall('str(2)', \"q\\\"in(3)\");\nnew Other(1); if (x) ab(2);\nconst { r1: z } = require('../y');"
    files = spark.createDataFrame([("p", "src/a.js", code, code)], "project string, path string, content string, scan_text string")
    assert {r["name"] for r in cc.extract_references(files).collect()} == {"a", "toolOne", "Local", "own", "arg", "realCall", "r1"}
    reg = spark.createDataFrame([("p", "toolOne")], "project string, name string")
    assert rows(cc.unknown_references(files, reg), "name") == [("Local",), ("realCall",)]
    other = spark.createDataFrame([("q", "toolOne")], "project string, name string")
    assert cc.unknown_references(files, other).count() == 0


def test_import_paths_and_routes(spark):
    code = "import a from './b';\nexport * from '../up';\nconst c = require('./dir');\nimport d from './b.css';\nimport e from './none';\nfetch('/api/users/12'); fetch(\"/api/users\"); fetch(`/api/box/any`); fetch('/api/usersX');"
    files = spark.createDataFrame([("p", "src/a.js", code, code)], "project string, path string, content string, scan_text string")
    known = spark.createDataFrame([("p", x) for x in ("src/a.js", "src/b.ts", "up/index.js", "src/dir/x.md")], "project string, path string")
    assert rows(cc.bad_import_paths(files, known), "target") == [("./b.css",), ("./none",)]
    routes = spark.createDataFrame([("p", "GET", "/api/users/:id"), ("p", "MOUNT", "/api/box"), ("p", "MOUNT", "/api/users")], "project string, method string, path string")
    assert rows(cc.bad_routes(files, routes), "route") == [("/api/usersX",)]


def test_project_scan(spark, tmp_path):
    root = tmp_path / "projects"
    for name, text in {
        "one/src/a.py": "def a():\n  pass\n", "one/src/B.js": "x", "one/node_modules/z.js": "x", "one/.git/h.py": "x", "one/old copy/c.py": "x", "one/gen/d.py": "x",
        "one/pkg/__init__.py": "VERSION = 1\n", "one/.gitignore": "# c\ngen/\n*.log\n", "one/big.py": "x" * 600_000, "one/read.md": "x", "two/gen/e.go": "package e\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert ("one", "big.py") in rows(scan_project(spark, str(root)), "project", "path")  # no limit is the default
    got = scan_project(spark, str(root), **INTERACTIVE)
    assert rows(got, "project", "path", "lang", "lines") == [("one", "pkg/__init__.py", "python", 2), ("one", "src/B.js", "javascript", 1), ("one", "src/a.py", "python", 3), ("two", "gen/e.go", "go", 2)]
    reg = sy.build_registry(sy.extract_symbols(sy.explode_lines(got)))
    assert rows(reg, "project", "name", "line") == [("one", "VERSION", 1), ("one", "a", 1)]


def test_written_files_are_read_by_scheme_on_a_cluster(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(projects, "BATCH_CHARS", 3)
    names = [f"one/a{i}.py" for i in range(5)] + ["two/b.py"]
    files = spark.createDataFrame([(n, "é" * len(n)) for n in names], "path string, content string")
    for root in (f"file:{tmp_path}/x", f"file://{tmp_path}/y"):
        kept = _write_files(files, root)
        assert kept == root
        cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"))
        projects._files(cluster, kept)  # other machines can open it
        with pytest.raises(ValueError):
            projects._files(cluster, str(tmp_path))
        got = rows(scan_project(spark, kept), "project", "path", "content")
        assert got == [(*n.split("/"), "é" * len(n)) for n in names]
        assert rows(scan_notes(spark, {"t": (f"{kept}/one", "*.py")}), "ref") == [(f"a{i}.py",) for i in range(5)]


def test_notes_files_and_repeated_headers(spark, tmp_path):
    for name, text in {"sections/a.md": "- lost\n## X\n- one\n## Y\n- two (2026-01-02)\n## X\n- three\n- four", "sections/.hid/b.md": "## Z\n- no", "src/m.py.note": "## L\n- five"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    docs = scan_notes(spark, {"section": (str(tmp_path / "sections"), "*.md"), "sidecar": (str(tmp_path / "src"), "*.note")})
    notes = nt.parse_notes(docs)
    assert rows(notes, "tier", "ref", "header", "seq", "entry") == [
        ("section", "a.md", "X", 1, "three"), ("section", "a.md", "X", 2, "four"), ("section", "a.md", "Y", 1, "two (2026-01-02)"), ("sidecar", "m.py.note", "L", 1, "five"),
    ]
    assert rows(notes.filter("date IS NOT NULL").select(F.col("date").cast("string"))) == [("2026-01-02",)]
    new = spark.createDataFrame([("section", "a.md", "lesson", "n1", 1), ("section", "a.md", "lesson", "n2", 2), ("sidecar", "m.py.note", "edge_case", "n3", 3)], "tier string, ref string, note_type string, text string, ord bigint")
    out, _ = nt.add_notes(notes, new, "2026-05-01")
    assert rows(out.filter("header IN ('Lessons', 'Edge Cases')"), "header", "seq", "entry") == [("Edge Cases", 1, "n3 (2026-05-01)"), ("Lessons", 1, "**n2** (2026-05-01)"), ("Lessons", 2, "**n1** (2026-05-01)")]


def test_search_snippet_borders(spark):
    docs = spark.createDataFrame([("section", "a", "x" * 60 + "KEY" + "y" * 120), ("plan", "b", "key at start")], "tier string, ref string, content string")
    index = spark.createDataFrame([("key", "r", 1)], "keyword string, ref string, ord bigint")
    got = rows(nt.search_notes(docs, index, ["Key", "absent"]), "source", "ref", "snippet")
    assert got == [("index", "r", None), ("plan", "b", "key at start"), ("section", "a", "..." + "x" * 50 + "KEY" + "y" * 100 + "...")]


def test_many_notes_are_read_by_few_tasks_byte_for_byte(spark, tmp_path):
    texts = {f"n{i}.md": f"note {i}\r\nsecond é\n" for i in range(200)} | {"bom.md": "\ufeffx"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    docs = scan_notes(spark, {"t": (str(tmp_path), "*.md")})
    assert {r.ref: r.content for r in docs.collect()} == texts
    assert docs.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
