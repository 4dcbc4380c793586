import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import script
from chainloom.operators import symbols as sy


def js(spark, text, lang="javascript", path="a.js"):
    rows = [("p", path, lang, i + 1, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "project string, path string, lang string, line long, ord long, text string")


def found(df):
    return sorted((r.line, r.category, r.name) for r in df.collect())


SPANNING = """\
export {
  one,
  two as deux,
  // three,
  four
};
const wide = async (
  a,
  { b, c = "x)" },
) => {
  let inner = 1,
    other = `text ${[1, 2].map((q) => `const no = ${q}`).join(",")}
const never = 2`, last = 3
}
const x = 1, y = () => 2,
  z = function () { return 1 }
var bare, half = a / b, third = /[/{`]+/g.test("{")
/* function gone() {
} class Gone {} */
export async function* walk(
  node
) {
  for (const item of node) { visit(item) }
  for (let i = 0, n = 5; i < n; i++) {}
}
class Tree extends Base {
  #size = 0
  static async grow(
    by
  ) {
  }
  get height() { return 1 }
  constructor(a) { super(a) }
  "quoted"() {}
}
const made = { plain() {}, also: function named() {} }, call = plain(function hidden() {})
export const shared = {
  key: 1
}, second = (a) => a
export default Tree
module.exports = { q, r: 1 }
exports.lone = 1
"""

EXPECTED = [
    (2, "exports", "one"), (3, "exports", "two"), (5, "exports", "four"), (7, "functions", "wide"), (11, "variables", "inner"), (12, "variables", "other"),
    (13, "variables", "last"), (15, "functions", "y"), (15, "variables", "x"), (16, "functions", "z"), (17, "variables", "bare"), (17, "variables", "half"),
    (17, "variables", "third"), (20, "exports", "walk"), (20, "functions", "walk"), (24, "variables", "i"), (24, "variables", "n"), (26, "classes", "Tree"),
    (28, "functions", "grow"), (32, "functions", "height"), (36, "functions", "plain"), (36, "variables", "call"), (36, "variables", "made"),
    (37, "exports", "shared"), (37, "variables", "shared"), (39, "exports", "second"), (39, "functions", "second"), (40, "exports", "Tree"),
    (41, "exports", "q"), (41, "exports", "r"), (42, "exports", "lone"),
]


def test_statements_over_lines(spark):
    assert found(sy.extract_js(js(spark, SPANNING))) == sorted(EXPECTED)


TYPED = """\
export interface Shape<T> {
  area(): number
}
type Pair =
  | [number, number]
export const enum Color { Red }
const table: Map<string, number> = new Map(), fn: (a: string) => void = (a) => {}
let later: string
export abstract class Solid {
  protected volume(
    scale: number
  ): number { return 1 }
}
declare class Other {}
export type { Pair, Shape as Form }
"""


def test_types(spark):
    assert found(sy.extract_js(js(spark, TYPED, "typescript"))) == sorted([
        (1, "classes", "Shape"), (1, "exports", "Shape"), (4, "classes", "Pair"), (6, "classes", "Color"), (6, "exports", "Color"), (7, "variables", "table"),
        (7, "functions", "fn"), (9, "classes", "Solid"), (9, "exports", "Solid"), (10, "functions", "volume"), (14, "classes", "Other"), (15, "exports", "Pair"),
        (15, "exports", "Shape"),
    ])


def test_names_of_one_line_statements_stay(spark):
    text = "a = 1\nb = 2, c = 3\nconst d = e\nfoo()\nfunction f() {}\nif (g) { var h = 1 }\nreturn function i() {}\nlet j\nlabel: for (;;) {}\nx.get(a)\n{ }"
    assert found(sy.extract_js(js(spark, text))) == [(3, "variables", "d"), (5, "functions", "f"), (6, "variables", "h")]


def random_script(rng):
    """Lines that open and close strings, templates, comments and brackets anywhere."""
    parts = ["const a = 1", "`", "${", "}", "{", "(", ")", "/*", "*/", "//", "'it", "\"s\\", "let b = c, d", "function f(", "/x/", "=>", "export {", ",", "e", "\n", "\n", "\n", ";"]
    return "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(5, 40)))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_effects_compose_to_the_state_read_in_order(size):
    """The fold of chunk effects, with chunks read again where it asks for it, against reading all lines."""
    rng = random.Random(3)
    for text in [SPANNING, TYPED] + [random_script(rng) for _ in range(400)]:
        lines = text.split("\n")
        reader, states = script.Reader([]), []
        for i, line in enumerate(lines):
            if i % size == 0:
                states.append((script._pack(reader.stack), reader.operand))
            reader.line(i + 1, line)
        for k, (entry, operand) in enumerate(states[:-1]):
            part = [(k * size + i + 1, line) for i, line in enumerate(lines[k * size : (k + 1) * size])]
            again, (stack, after) = script.behind(script._unpack(entry), operand, script.effects_of(part))
            if not again:
                assert (script._pack(stack), after) == states[k + 1]


@pytest.mark.parametrize("chunk", [4])
def test_chunk_borders_change_nothing(spark, monkeypatch, chunk):
    rng = random.Random(9)
    texts = [SPANNING, TYPED] + [random_script(rng) for _ in range(12)]
    rows = [("p", f"{k}.ts", "typescript", i + 1, i, line) for k, text in enumerate(texts) for i, line in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "project string, path string, lang string, line long, ord long, text string")

    def run():
        return sorted(map(tuple, script.tokens(lines).collect())), sorted(map(tuple, sy.extract_js(lines).collect()))

    whole = run()
    monkeypatch.setattr(script, "CHUNK_LINES", chunk)
    monkeypatch.setattr(script, "SCAN_LINES", chunk)
    assert run() == whole


def test_what_stays_open_is_not_carried_by_every_line(spark, monkeypatch):
    monkeypatch.setattr(script, "CHUNK_LINES", 4)
    text = "\n".join(["function f(a) {"] * 60 + ["}", "let x = 1", "} } }", "let y = 2"])
    lines = js(spark, text).withColumn("unit", F.lit(0).cast("long")).withColumn("chunk", F.floor(F.col("line") / 4).cast("long"))
    entries = script.borders(lines).select("entry").collect()
    assert len(entries) == 17 and max(len(e.entry.split()) for e in entries) <= 5  # not 60
    got = {r.token: r.scope // script.PLACE for r in script.tokens(js(spark, text)).collect() if r.token in "xy"}
    assert got == {"x": 59, "y": 56}


def test_scripts_of_a_page_are_apart(spark):
    html = "<script>const a = `open\n</script>\n<script>const b = 1</script>"
    _, code = sy.extract_html(spark.createDataFrame([("p", "i.html", 1, html)], "project string, path string, file_ord bigint, content string"))
    assert ("variables", "b") in {(c, n) for _, c, n in found(sy.extract_js(code))}


def test_awkward_lines(spark):
    assert found(sy.extract_js(js(spark, ""))) == [] and found(sy.extract_js(js(spark, "x").limit(0))) == []
    long = js(spark, "const a = [" + "1, " * 50_000 + "], b = 2\nconst c = 1")
    assert found(sy.extract_js(long)) == [(1, "variables", "a"), (1, "variables", "b"), (2, "variables", "c")]
    with_null = js(spark, "x").selectExpr("project", "path", "lang", "line", "ord", "cast(null as string) as text")
    assert found(sy.extract_js(with_null)) == []


def test_long_and_short_files_in_one_table(spark, monkeypatch):
    lines = js(spark, SPANNING, path="short.js").unionByName(js(spark, "\n" * 40 + SPANNING, path="long.js"))
    want = sorted((line, category, name) for line, category, name in found(sy.extract_js(js(spark, SPANNING))))
    monkeypatch.setattr(script, "SCAN_LINES", 40)  # the short file has fewer lines, the long one lies in two chunks
    got = [(r.path, r.line, r.category, r.name) for r in sy.extract_js(lines).collect()]
    assert sorted(r[1:] for r in got if r[0] == "short.js") == want
    assert sorted((line - 40, c, n) for p, line, c, n in got if p == "long.js") == want


def test_tokens_of_short_files_are_not_written_with_their_neighbours(spark, monkeypatch):
    written, write = [], script.materialise
    monkeypatch.setattr(script, "materialise", lambda df, label: written.append((label, len(df.columns))) or write(df, label))
    assert found(sy.extract_js(js(spark, SPANNING)))
    assert max(columns for _, columns in written) <= 12  # before: 47, six neighbours to each side
