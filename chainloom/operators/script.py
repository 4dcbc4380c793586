"""JavaScript and TypeScript symbols over any number of lines.

A lexer turns lines into tokens with the bracket that encloses each; what a token declares then follows from the tokens
beside it in the same bracket, so statements, parameter lists and export lists may span lines, and what lies in nested
brackets, strings, templates, comments and regular expressions is never mistaken for them.

Files are read in chunks of ``CHUNK_LINES`` lines, each in a task of its own.  What a chunk does to the state before it is read
for a start in plain code, in a template and in a comment: what it closes and what it leaves open.  These effects compose, so
the state at every border follows by an ordered fold of three small rows per chunk.  Only a chunk that closes the bracket of a
substitution it has not seen open is read again, from its true state, until no border changes.  Tokens beside each other come from ordered scans over the
tokens of a bracket (``scan.neighbours``), cut into chunks as well, so no file, and no bracket, lies in one task.

Results: a name a parser would find as declaration.  Patterns (``const {a} = b``) name nothing; a name declared inside the
value of another counts once; the ``module.exports`` forms go by lines, as everywhere.  Unbalanced code is read as far as it
goes: a closing bracket closes the innermost open one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chainloom.operators.scan import neighbours, scan
from chainloom.operators.storage import materialise

CHUNK_LINES, SCAN_LINES = 4096, 65536
BACK, AHEAD = 6, 6  # the longest patterns: case label before an async function, async arrow behind =
PLACE = 1 << 24  # a token's ordinal is its line times this, plus its column

_TOKEN = re.compile(
    r"(?P<blank>\s+|//.*)|(?P<comment>/\*)|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<cut>\"(?:[^\"\\]|\\.)*\\$|'(?:[^'\\]|\\.)*\\$)"
    r"|(?P<tick>`)|(?P<word>#?[^\W\d][\w$]*|#?\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<open>[(\[{])|(?P<close>[)\]}])"
    r"|(?P<mark>=>|\.\.\.|[=!]==?|[<>]=|\?\.|\*\*=?|&&=?|\|\|=?|\?\?=?|[-+%&|^*]=|\+\+|--|.)"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\\$|\$(?!\{))*")
_STRING_REST = {q: re.compile(rf"(?:[^{q}\\]|\\.)*") for q in "\"'"}

# Words after which an expression begins, words that go on an expression, and words that never name a method.
BEFORE_VALUE = tuple("return typeof case in of delete void throw new else do instanceof yield await default export extends const let var as".split())
GO_ON = tuple("in of instanceof as satisfies extends implements from".split())
NOT_METHODS = tuple("if for while switch catch with function return constructor super typeof await new import do else throw".split())
MODIFIERS = tuple("static async get set public private protected readonly override abstract accessor".split())


class Open(NamedTuple):
    """What encloses a token: a bracket, ``$`` for a substitution, ``` ` ``` for a template, ``*`` for a comment, or a quote."""

    sign: str
    at: int


class Reader:
    """Reads lines from a known state, or from an unknown one of which only the innermost sign, ``start``, is supposed.

    From an unknown state ``stack`` holds ``start`` as long as it is open, and what the lines open themselves.
    """

    def __init__(self, stack: list[Open] | None = None, operand: bool = False, start: str = ""):
        self.known = stack is not None
        self.stack = list(stack or []) if self.known else [Open(s, -1) for s in start]
        self.operand = operand if self.known else None  # whether the last token ends a value; None if no token was read
        self.closed = 0  # brackets of the unknown state that the lines close
        self.asks = None  # whether the first token depends on what stood before it

    def line(self, number: int, text: str) -> list[tuple[int, int, str, str, str]]:
        """(ordinal, ordinal and sign of the enclosing bracket, kind, text) of the tokens.

        Kind is w for words, v for values and p for marks.
        """
        out, i, stack = [], 0, self.stack
        while i < len(text):
            sign = stack[-1].sign if stack else ""
            if sign == "*":
                i = text.find("*/", i) + 2
                if i == 1:
                    return out
                stack.pop()
            elif sign == "`":
                self.asks = bool(self.asks)
                i = _TEMPLATE.match(text, i).end()
                if text.startswith("${", i):
                    stack.append(Open("$", number * PLACE + i))
                    self.operand = False
                    i += 2
                elif i < len(text):
                    stack.pop()
                    self.operand = True
                    i += 1
            elif sign and sign in "\"'":
                i = _STRING_REST[sign].match(text, i).end() + 1
                if not text.endswith("\\") or i < len(text):
                    stack.pop()
                    self.operand, self.asks = True, bool(self.asks)
            else:
                i = self._code(number, text, i, out)
        if stack and stack[-1].sign in ("'", '"') and not text.endswith("\\"):
            stack.pop()
        return out

    def _code(self, number: int, text: str, i: int, out: list) -> int:
        found = _TOKEN.match(text, i)
        kind, token, at = found.lastgroup, found.group(), number * PLACE + min(i, PLACE - 1)
        if kind == "blank":
            return found.end()
        if kind == "comment":
            self.stack.append(Open("*", at))
            return found.end()
        if token == "/":
            if self.asks is None and not self.known:
                self.asks = True
            literal = None if self.operand or text[i - 1 : i] == "<" else _REGEX.match(text, i)
            if literal:
                self._emit(out, at, "v", "/", True)
                return literal.end()
        if self.asks is None:
            self.asks = False
        if kind == "word":
            self._emit(out, at, "w", token, token not in BEFORE_VALUE)
        elif kind in ("string", "number"):
            self._emit(out, at, "v", "'" if kind == "string" else "0", True)
        elif kind in ("cut", "tick", "open"):
            self._emit(out, at, "p" if kind == "open" else "v", token[0], False)
            self.stack.append(Open(token[0], at))
        elif kind == "close":
            self._close(token)
            if not (self.stack and self.stack[-1].sign == "`"):
                self._emit(out, at, "p", token, token != "}")
        else:
            self._emit(out, at, "p", token, False)
        return found.end()

    def _emit(self, out: list, at: int, kind: str, token: str, operand: bool) -> None:
        around = self.stack[-1] if self.stack else Open("", 0)
        out.append((at, around.at, around.sign, kind, token))
        self.operand = operand

    def _close(self, token: str) -> None:
        if not self.stack:
            self.closed += not self.known
        elif self.stack[-1].sign != "$" or token == "}":
            self.stack.pop()


def _pack(stack: list[Open]) -> str:
    return " ".join(f"{o.sign}{o.at}" for o in stack)


def _unpack(text: str) -> list[Open]:
    return [Open(part[0], int(part[1:])) for part in text.split()]


_FILE = ["project", "path", "unit"]
_KEYS = "project string, path string, unit long, chunk long"
_EFFECT = f"{_KEYS}, start string, known boolean, closed long, opened string, operand boolean, asks boolean"
_ENTRY = f"{_KEYS}, entry string, before boolean, again boolean"
_STARTS = ("", "`", "*")
_TOKEN_COLUMNS = (("place", "long"), ("scope", "long"), ("within", "string"), ("kind", "string"), ("token", "string"))
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


class Effect(NamedTuple):
    """What lines do to the state before them: brackets closed below ``start``, and what is open at the end."""

    start: str
    known: bool
    closed: int
    opened: str
    operand: bool | None
    asks: bool


def effect(lines: list[tuple[int, str | None]], reader: Reader, start: str = "") -> Effect:
    for number, text in lines:
        reader.line(number, text or "")
    return Effect(start, reader.known, reader.closed, _pack(reader.stack), reader.operand, bool(reader.asks))


def effects_of(lines: list[tuple[int, str | None]]) -> list[Effect]:
    return [effect(lines, Reader(start=s), s) for s in _STARTS]


def behind(stack: list[Open], operand: bool, effects: list[Effect]) -> tuple[bool, tuple[list[Open], bool]]:
    """The state behind lines with these effects, and whether they have to be read again from the state before them."""
    inner = stack[-1].sign if stack else ""
    found = {e.start: e for e in effects}
    e = found.get(inner, found[""])
    opened, after = _unpack(e.opened), operand if pd.isna(e.operand) else bool(e.operand)
    if e.known:
        return False, (opened, after)
    below = stack[:-1] if e.start else stack
    if opened and opened[0].at < 0:  # the supposed start is still open
        below, opened = stack, opened[1:]
    closed = below[max(0, len(below) - e.closed) :]
    again = inner in ("'", '"') or any(o.sign == "$" for o in closed) or e.asks and operand
    return again, (below[: len(below) - len(closed)] + opened, after)


def _lines_of(rows: pa.Table) -> list[tuple[int, str | None]]:
    return sorted(zip(rows["line"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda r: r[0])


def _effect_rows(rows: pa.Table, effects: list[Effect]) -> pa.Table:
    key = rows.slice(0, 1).select([*_FILE, "chunk"]).to_pylist()[0]
    return pa.Table.from_pylist([key | e._asdict() for e in effects], schema=_EFFECT_ROWS)


def _effects(lines: DataFrame) -> DataFrame:
    """The effect of every chunk for each start."""

    def read(rows: pa.Table) -> pa.Table:
        return _effect_rows(rows, effects_of(_lines_of(rows)))

    return lines.groupBy(*_FILE, "chunk").applyInArrow(read, _EFFECT)


def _true_effects(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """The state behind every chunk whose entry is given."""

    def read(rows: pa.Table, entry: pa.Table) -> pa.Table:
        if not (entry.num_rows and rows.num_rows):
            return _EFFECT_ROWS.empty_table()
        reader = Reader(_unpack(entry["entry"][0].as_py()), entry["before"][0].as_py())
        return _effect_rows(rows, [effect(_lines_of(rows), reader)])

    keys = [*_FILE, "chunk"]
    return lines.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(read, _EFFECT)


_EFFECT_ROWS = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in _EFFECT.split(", "))])


def _entries(effects: DataFrame) -> DataFrame:
    """The state at the start of each chunk of a file, up to the first chunk that has to be read again from it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, state = [], ([], False)
        key = rows.iloc[0][_FILE].tolist()
        for chunk, found in rows.groupby("chunk", sort=True):
            effects = [Effect(*e) for e in found[list(Effect._fields)].itertuples(index=False)]
            again, after = behind(*state, effects)
            # what the chunk neither closes nor lies in is not passed on: code that never closes a bracket gets deeper with every line
            deep = None if again or effects[0].known else max(e.closed for e in effects) + 2
            out.append((*key, chunk, _pack(state[0][-deep:] if deep else state[0]), state[1], again))
            if again:
                break
            state = after
        return pd.DataFrame(out, columns=[*_FILE, "chunk", "entry", "before", "again"])

    return effects.groupBy(*_FILE).applyInPandas(fold, _ENTRY)


def borders(lines: DataFrame) -> DataFrame:
    """(file, chunk, entry, before): the state at the start of every chunk of the files of more than one chunk.

    Of the open brackets ``entry`` holds those that the chunk may meet."""
    long = lines.groupBy(*_FILE).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("low < high")
    lines = lines.join(long.select(*_FILE), _FILE, "left_semi")
    effects = materialise(_effects(lines), "js-effects")
    while True:
        entries = materialise(_entries(effects), "js-entries")
        again = entries.filter("again")
        if again.isEmpty():
            return entries.drop("again")
        right = materialise(_true_effects(lines, again), "js-again")
        keys = [*_FILE, "chunk"]
        effects = materialise(effects.join(right.select(*keys), keys, "left_anti").unionByName(right), "js-effects")


def tokens(lines: DataFrame) -> DataFrame:
    """project, path, unit, lang, line, ord, place, scope, within, kind and token of every token of ``lines``.

    ``scope`` is the ``place`` of the bracket around the token and ``within`` its sign, 0 and empty for none.  ``unit`` tells apart several scripts of a path;
    without that column a path is one script.
    """
    unit = F.col("unit") if "unit" in lines.columns else F.lit(0)
    lines = lines.withColumns({"unit": unit.cast("long"), "line": F.col("line").cast("long")})
    lines = lines.select(*_FILE, "lang", "line", "ord", "text", F.floor(F.col("line") / CHUNK_LINES).cast("long").alias("chunk"))
    lines = materialise(lines, "js-lines")
    kept = [f for f in lines.schema if f.name not in ("text", "chunk")]
    schema = StructType([*kept, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in _TOKEN_COLUMNS))])
    keys = [*_FILE, "chunk"]
    # the state comes as one row ahead of its chunk, not on each line: it is as long as the brackets are deep
    heads = borders(lines).withColumn("head", F.lit(True))
    lines = lines.withColumn("head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    lines = lines.repartition(*keys).sortWithinPartitions(*keys, F.desc("head"), "line")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = Reader([]), None
        for batch in batches:
            found, at = [], []
            columns = [batch.column(n).to_pylist() for n in (*keys, "line", "text", "head", "entry", "before")]
            for i, (*key, number, text, head, entry, before) in enumerate(zip(*columns, strict=True)):
                if head or key != last:
                    reader, last = Reader(_unpack(entry or ""), before or False), key
                if head:
                    continue
                for token in reader.line(number, text or ""):
                    at.append(i)
                    found.append(token)
            places = pa.array(at, pa.int64())
            out = [batch.column(f.name).take(places) for f in kept]
            out += [pa.array([t[k] for t in found], _ARROW[t_]) for k, (_, t_) in enumerate(_TOKEN_COLUMNS)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return lines.mapInArrow(read, schema)


def _get(side: str, i: int, part: str = "t") -> Column:
    """Text, kind or line of the ``i``-th token before or after a row of ``_wide``."""
    return F.col(f"{side}{i}{part}")


def _wide(rows: DataFrame) -> DataFrame:
    """The neighbours of every token as plain columns."""
    flat = {f"{side}{i}{p}": F.get(F.col(side), F.lit(i))[p] for side, n in (("back", BACK), ("ahead", AHEAD)) for i in range(n) for p in "ktl"}
    return rows.withColumns(flat).drop("back", "ahead")


def _in(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _is(c: Column, value: str) -> Column:
    return F.coalesce(c == value, F.lit(False))


def _ends_value(side: str, i: int) -> Column:
    t, k = _get(side, i), _get(side, i, "k")
    return F.coalesce((k == "v") | (k == "w") & ~t.isin(*BEFORE_VALUE) | t.isin(")", "]", "}"), F.lit(False))


def _starts(lead: Column, i: int, *also: str) -> Column:
    """Whether the token on line ``lead`` behind ``back[i]`` begins a statement."""
    t = _get("back", i)
    new_line = F.coalesce(_get("back", i, "l") < lead, F.lit(False)) & _ends_value("back", i)
    label = _is(t, ":") & (_is(_get("back", i + 1), "default") | _is(_get("back", i + 2), "case"))
    first = t.isNull() & F.col("within").isin("", "{")
    return first | F.coalesce(t.isin(";", "}", ")", "else", "do", *also), F.lit(False)) | new_line | label


def _exported(i: int) -> Column:
    """Whether ``export`` or ``export default`` stands at ``back[i]``."""
    return _is(_get("back", i), "export") | _is(_get("back", i), "default") & _is(_get("back", i + 1), "export")


def declarations(found: DataFrame) -> DataFrame:
    """(project, path, line, ord, category, name) of what the tokens declare and export."""
    found = materialise(found, "js-lexed")
    long = materialise(found.filter(F.col("line") >= SCAN_LINES).select(*_FILE).distinct(), "js-long")
    if long.isEmpty():
        return _declared(found, whole=True)
    short = _declared(found.join(long, _FILE, "left_anti"), whole=True)
    return short.unionByName(_declared(found.join(long, _FILE, "left_semi"), whole=False))


def _declared(found: DataFrame, *, whole: bool) -> DataFrame:
    """``declarations`` of files that all (``whole``) or not all have fewer than SCAN_LINES lines."""
    scope = [*_FILE, "scope"]
    ways = {"chunk": PLACE * SCAN_LINES, "whole": whole}
    value = F.struct(F.col("kind").alias("k"), F.col("token").alias("t"), F.col("line").alias("l"))
    rows = _wide(neighbours(found, scope, "place", value, back=BACK, ahead=AHEAD, **ways))
    t, line, word = F.col("token"), F.col("line"), F.col("kind") == "w"
    b = [_get("back", i) for i in range(BACK)]
    a = [_get("ahead", i) for i in range(AHEAD)]
    a_word = [_get("ahead", i, "k") == "w" for i in range(AHEAD)]
    typed = F.col("lang") == "typescript"

    # const, let and var, and the names their statement declares
    goes_on = word & t.isin(*GO_ON)
    new_line = F.coalesce(_get("back", 0, "l") < line, F.lit(False)) & _ends_value("back", 0)
    border = b[0].isNull() | (t == ";") | new_line & ((word & ~goes_on) | (F.col("kind") == "v") | (t == "{"))
    keyword = word & t.isin("const", "let", "var") & (_starts(line, 0, "export", "declare") | b[0].isNull())
    exported = F.when(_is(b[0], "export"), "x").otherwise("")
    anchor = F.when(keyword, F.concat(t, F.lit(" "), exported)).when(border, "")
    value_is_function = (
        _is(a[0], "function") | _is(a[0], "async") & _is(a[1], "function")
        | _is(a[0], "(") & _is(a[1], ")") & _in(a[2], "=>", ":") | _is(a[0], "async") & _is(a[1], "(") & _is(a[2], ")") & _in(a[3], "=>", ":")
        | a_word[0] & _is(a[1], "=>") | _is(a[0], "async") & a_word[1] & _is(a[2], "=>")
    )
    is_list = (t == "{") & (_is(b[0], "export") & _starts(_get("back", 0, "l"), 1) | _is(b[0], "type") & _is(b[1], "export"))
    item = word & (b[0].isNull() | _is(b[0], ",") | _is(b[0], "type") & (b[1].isNull() | _is(b[1], ","))) & ~(_is(t, "type") & a_word[0] & ~_is(a[0], "as"))
    leads = b[0].isNull() | _in(b[0], ";", ",", "}", "*", *MODIFIERS) | new_line
    named = _in(b[0], "const", "let", "var", ",", "function", "*", "class", "interface", "enum", "type", "default") | leads & _is(a[0], "(") & _is(a[1], ")")
    plain = word & ~t.isin(*BEFORE_VALUE, "function", "class", "enum", "async", "await")
    beside = a[0].isNull() | a[0].isin("=", ",", ";", ":", "!") | (_get("ahead", 0, "l") > line) & ~_in(a[0], *GO_ON)
    names = plain & (_in(b[0], "const", "let", "var") | _is(b[0], ",")) & beside
    equals = F.when(t == "=", F.struct("place", F.coalesce(value_is_function, F.lit(False)).alias("f")))

    # functions, classes, types and methods
    star = F.when(_is(b[0], "*"), 1).otherwise(0)
    function, function_x = F.lit(False), F.lit(False)
    for k in (0, 1):
        is_function = (star == k) & _is(b[k], "function")
        asynchronous = _is(b[k + 1], "async")
        for n, gate in ((k + 1, ~asynchronous), (k + 2, asynchronous)):
            if n < 4:
                function |= is_function & gate & _starts(line, n, "export", "default")
                function_x |= is_function & gate & _exported(n)
    function = word & function & _in(a[0], "(", "<")
    is_class = word & _is(b[0], "class")
    class_name = is_class & _starts(line, 1, "export", "default", "declare", "abstract")
    class_x = is_class & (_exported(1) | _in(b[1], "abstract", "declare") & _exported(2))
    follows = (
        _is(b[0], "interface") & _in(a[0], "{", "<", "extends") | _is(b[0], "enum") & _is(a[0], "{") | _is(b[0], "type") & _in(a[0], "=", "<")
    )
    is_type = word & follows & (_starts(line, 1, "export", "default", "declare") | _is(b[1], "const"))
    type_name = typed & is_type
    type_x = is_type & (_exported(1) | _in(b[1], "declare", "const") & _exported(2))
    method = word & ~t.isin(*NOT_METHODS) & leads & _is(a[0], "(") & _is(a[1], ")") & (_is(a[2], "{") | typed & _is(a[2], ":") & _typed_body())
    default_x = (
        word & _is(b[0], "default") & _is(b[1], "export") & ~t.isin("async", "function", "class", "abstract", "interface", *BEFORE_VALUE)
        & (a[0].isNull() | _is(a[0], ";") | (_get("ahead", 0, "l") > line) & ((_get("ahead", 0, "k") != "p") | _in(a[0], "{")))
    )

    def name(category: str, when: Column) -> Column:
        return F.when(when, F.lit(category))

    other = F.coalesce(name("functions", function), name("classes", class_name), name("classes", type_name), name("functions", method))
    other_x = word & function_x & _in(a[0], "(", "<") | class_x | type_x | default_x

    # what the scans need of the neighbours, as narrow columns
    flags = {"lists": is_list, "item": item, "could": names, "border": border, "other_x": other_x, "valued": _in(a[0], "=", ":", "!")}
    flags = [F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]
    kept = rows.filter(keyword | border | (t == "=") | F.coalesce(is_list, F.lit(False)) | F.coalesce(item, F.lit(False)) | word & named)
    rows = kept.select(*scope, "line", "ord", "place", "token", anchor.alias("lead"), equals.alias("equals"), other.alias("other"), *flags)
    rows = rows if whole else materialise(rows, "js-tokens")
    rows = scan(rows, scope, "place", lasts={"anchor": F.col("lead")}, **ways)
    rows = rows.withColumn("declares", F.coalesce(F.col("could") & (F.length("anchor") > 0), F.lit(False)))
    stop = F.when(F.col("declares") | F.col("border"), F.col("place"))
    rows = scan(rows, scope, "place", nexts={"eq": F.col("equals")}, afters={"stop": stop}, **ways)
    has_value = F.coalesce(F.col("valued") & (F.col("eq.place") < F.coalesce("stop", F.lit((1 << 63) - 1))), F.lit(False))
    kind = F.split("anchor", " ")
    variable = F.when(
        F.col("declares") & (has_value | (kind[0] == "var")), F.when(has_value & F.col("eq.f"), "functions").otherwise("variables")
    )
    x = F.coalesce(F.col("declares") & (kind[1] == "x"), F.lit(False)) | F.col("other_x")
    rows = rows.select(*_FILE, "line", "ord", "scope", "place", "token", F.coalesce(variable, "other").alias("own"), x.alias("x"), "lists", "item")
    rows = materialise(rows.filter("own IS NOT NULL OR x OR lists OR item"), "js-names")
    lists = rows.filter("lists").select(*_FILE, F.col("place").alias("scope"))
    listed = rows.filter("item").join(lists, [*_FILE, "scope"], "left_semi").withColumn("category", F.lit("exports"))
    single = rows.filter("own IS NOT NULL").withColumn("category", F.col("own")).unionByName(rows.filter("x").withColumn("category", F.lit("exports")))
    return single.unionByName(listed).select("project", "path", "line", "ord", "category", F.col("token").alias("name"))


def _typed_body() -> Column:
    """Whether a ``{`` follows the return type behind ``) :``; a type in braces counts too."""
    return _is(_get("ahead", 3), "{") | _is(_get("ahead", 4), "{") | _is(_get("ahead", 5), "{")
