"""Symbol extraction by line rules, the registry, and name checks against it.

Lines have project, path, lang, line, ord (scan order of the project) and text.
Symbols have project, category, name, path, line, ord.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators import script
from chainloom.operators.storage import materialise
from chainloom.functions.text import line_count, trim_blank

# Registry categories in their order of precedence.
CATEGORIES = ("functions", "classes", "variables", "exports", "apiRoutes", "htmlPages")

# What declares a name in each language; the first rule that matches a line wins.
PYTHON_RULES = (
    ("functions", r"^(?:async\s+)?def\s+(\w+)\s*\("),
    ("classes", r"^class\s+(\w+)[\s(:]"),
    ("functions", r"^\s+(?:async\s+)?def\s+([^\W_]\w*)\s*\("),
    ("variables", r"^([^a-z\W]+)\s*(?::\s*\w+\s*)?="),
)
GO_RULES = (
    ("functions", r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("),
    ("classes", r"^type\s+(\w+)\s+(?:struct|interface)\s*\{"),
    ("variables", r"^(?:const|var)\s+(\w+)\s"),
)
RUST_RULES = (
    ("functions", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("classes", r"^(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("variables", r"^(?:pub\s+)?(?:const|static)\s+(\w+)"),
)
EXPORT_MEMBER = r"^(?:module\.)?exports\.(\w+)\s*="
EXPORT_BULK = r"^module\.exports\s*=\s*\{([^}]+)\}"
BULK_NAME = r"^(\w+)(?:[:\s].*)?$"
# The patterns of routes, titles and scripts.
ROUTE = r"(?:router|app)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
MOUNT = r"app\.use\s*\(\s*['\"`](/api[^'\"`]*)['\"`]"

TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
SCRIPT_SRC = r"(?i)<script[^>]+src\s*=\s*[\"']([^\"']+)[\"'][^>]*>"
INLINE_SCRIPT = r"(?is)<script(?![^>]*\bsrc\b)[^>]*>(.*?)</script>"
SCRIPT_OPEN = r"(?is)^(<script[^>]*>)"

_AT = ["project", "path", "line", "ord"]


def _symbol(category: Column | str, name: Column) -> Column:
    return F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), name.alias("name"))


def _first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of the first rule that finds a name; null when none does."""
    found = [F.regexp_extract(text, pattern, 1) for _, pattern in rules]
    return F.coalesce(*[F.when(F.length(name) > 0, _symbol(category, name)) for (category, _), name in zip(rules, found)])


def _explode(lines: DataFrame, symbols: Column) -> DataFrame:
    listed = lines.select(*_AT, F.explode(F.filter(symbols, lambda s: s.isNotNull())).alias("s"))
    return listed.select("project", "s.category", "s.name", "path", "line", "ord")


def extract_python(lines: DataFrame) -> DataFrame:
    return _explode(lines, F.array(_first_rule(F.col("text"), PYTHON_RULES)))


def extract_go(lines: DataFrame) -> DataFrame:
    return _explode(lines, F.array(_first_rule(F.col("text"), GO_RULES)))


def extract_rust(lines: DataFrame) -> DataFrame:
    return _explode(lines, F.array(_first_rule(F.col("text"), RUST_RULES)))


def extract_js(lines: DataFrame) -> DataFrame:
    """Declarations and exports of JavaScript and TypeScript, over any number of lines; ``module.exports`` by lines.

    A ``unit`` column tells apart several scripts of one path.
    """
    text = F.col("text")
    member = F.regexp_extract(text, EXPORT_MEMBER, 1)
    parts = F.split(F.regexp_extract(text, EXPORT_BULK, 1), ",")
    bulk = F.filter(F.transform(parts, lambda p: F.regexp_extract(trim_blank(p), BULK_NAME, 1)), lambda n: F.length(n) > 0)
    listed = F.transform(F.when(F.length(member) > 0, F.array(member)).otherwise(bulk), lambda n: _symbol("exports", n))
    declared = script.declarations(script.tokens(lines))
    return declared.select("project", "category", "name", "path", "line", "ord").unionByName(_explode(lines, listed))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """All languages in one pass over the lines."""
    lang = F.col("lang")
    parts = [
        extract_js(lines.filter(lang.isin("javascript", "typescript"))),
        extract_python(lines.filter(lang == "python")),
        extract_go(lines.filter(lang == "go")),
        extract_rust(lines.filter(lang == "rust")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explode_lines(files: DataFrame) -> DataFrame:
    """Lines of ``files(project, path, lang, file_ord, content)``; ``ord`` keeps file, then line order."""
    rows = files.select("project", "path", "lang", "file_ord", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return rows.select("project", "path", "lang", (F.col("i") + 1).cast("bigint").alias("line"), F.struct("file_ord", F.col("i").cast("bigint").alias("i")).alias("ord"), "text")


def extract_html(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, lines): title and local scripts of each page, and its inline script lines at their true line."""
    title = trim_blank(F.regexp_extract("content", TITLE, 1))
    name = F.element_at(F.split("path", "/"), -1)
    sources = F.filter(
        F.regexp_extract_all("content", F.lit(SCRIPT_SRC), F.lit(1)), lambda s: ~F.startswith(s, F.lit("http")) & ~F.startswith(s, F.lit("//"))
    )
    pages = files.select(
        "project", "path", name.alias("name"), F.when(F.length(title) > 0, title).otherwise(name).alias("title"), sources.alias("scripts"), "file_ord"
    )
    whole = F.regexp_extract_all("content", F.lit(INLINE_SCRIPT), F.lit(0))
    bodies = F.regexp_extract_all("content", F.lit(INLINE_SCRIPT), F.lit(1))
    around = F.split("content", INLINE_SCRIPT)
    rows = files.select("project", "path", "file_ord", whole.alias("whole"), bodies.alias("bodies"), around.alias("around"))
    breaks = lambda c: line_count(c) - 1
    start = F.transform(
        "whole",
        lambda w, i: F.aggregate(F.slice("around", F.lit(1), i + 1), F.lit(1).cast("bigint"), lambda n, a: n + breaks(a))
        + F.aggregate(F.slice("whole", F.lit(1), i), F.lit(0).cast("bigint"), lambda n, a: n + breaks(a))
        + breaks(F.regexp_extract(w, SCRIPT_OPEN, 1)),
    )
    scripts = rows.select("project", "path", "file_ord", F.explode(F.arrays_zip(start.alias("at"), F.col("bodies").alias("body"))).alias("s"))
    lines = (
        scripts.filter(F.length(trim_blank(F.col("s.body"))) > 0)
        .select("project", "path", "file_ord", F.col("s.at").alias("at"), F.posexplode(F.split("s.body", "\n")).alias("i", "text"))
        .withColumn("line", (F.col("at") + F.col("i")).cast("bigint"))
        .select("project", "path", F.col("at").alias("unit"), F.lit("javascript").alias("lang"), "line", F.struct("file_ord", (F.col("line") - 1).alias("i")).alias("ord"), "text")
    )
    return pages, lines


def extract_routes(lines: DataFrame) -> DataFrame:
    """(project, method, path, file, line, ord): routes and API mounts; the first place of a key wins."""
    text = F.col("text")
    method, route, mount = F.upper(F.regexp_extract(text, ROUTE, 1)), F.regexp_extract(text, ROUTE, 2), F.regexp_extract(text, MOUNT, 1)
    found = F.when(F.length(route) > 0, F.struct(method.alias("method"), route.alias("path"))).when(
        F.length(mount) > 0, F.struct(F.lit("MOUNT").alias("method"), mount.alias("path"))
    )
    hits = lines.filter(~text.rlike(EXPORT_MEMBER)).withColumn("r", found).filter("r IS NOT NULL")
    return (
        hits.groupBy("project", "r.method", "r.path")
        .agg(F.min_by(F.struct("path", "line", "ord"), "ord").alias("f"))
        .select("project", "method", "path", F.col("f.path").alias("file"), F.col("f.line").alias("line"), F.col("f.ord").alias("ord"))
    )


def build_registry(symbols: DataFrame) -> DataFrame:
    """First place and number of uses of every name per category."""
    return (
        symbols.groupBy("project", "category", "name")
        .agg(F.min_by(F.struct("path", "line", "ord"), "ord").alias("f"), F.count(F.lit(1)).alias("usages"))
        .select("project", "category", "name", F.col("f.path").alias("file"), F.col("f.line").alias("line"), "usages", F.col("f.ord").alias("ord"))
    )


def full_registry(registry: DataFrame, routes: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Registry with routes ('METHOD path') and pages (file name, last one wins) as two more categories."""
    out = registry
    if routes is not None:
        out = out.unionByName(
            routes.select("project", F.lit("apiRoutes").alias("category"), F.concat_ws(" ", "method", "path").alias("name"), "file", "line", "ord"), allowMissingColumns=True
        )
    if pages is not None:
        last = pages.groupBy("project", "name").agg(F.max_by("path", "file_ord").alias("file"), F.min("file_ord").alias("file_ord"))
        out = out.unionByName(
            last.select("project", F.lit("htmlPages").alias("category"), "name", "file", F.struct("file_ord", F.lit(0).cast("bigint").alias("i")).alias("ord")),
            allowMissingColumns=True,
        )
    return out


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))


def _by_name(registry: DataFrame) -> DataFrame:
    """One row per name: its first category, with the registry order of the name."""
    return registry.groupBy("project", "name").agg(
        F.min_by(F.struct("category", "file", "line", "usages"), F.struct(_rank(), F.col("ord"))).alias("hit"),
        F.min(F.struct(_rank().alias("rank"), F.col("ord").alias("ord"))).alias("place"),
    )


def check_symbols(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(project, name, known, category, file, line, usages) for ``names(project, name)``."""
    asked = names.select("project", "name").distinct()
    return asked.join(_by_name(registry), ["project", "name"], "left").select(
        "project", "name", F.col("hit").isNotNull().alias("known"), "hit.category", "hit.file", "hit.line", "hit.usages"
    )


def _tolerance(n: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(n * 0.3)).cast("int")


def _probe_keys(queries: DataFrame) -> DataFrame:
    """Cut each name into k+1 pieces; a name within k edits holds one of them, shifted a little.

    One row per (registry name length, piece place, piece): with a length difference d the
    piece that is found whole first has at most (k-d)/2 inserts or (k+d)/2 deletes before it.
    """
    n, k = F.length("lowered"), F.col("k")
    size = F.floor(n / (k + 1))
    short = (k + 1) - (n - size * (k + 1))
    start = F.expr("i * size + greatest(0, i - short)")
    length = F.expr("size + CASE WHEN i >= short THEN 1 ELSE 0 END")
    rows = (
        queries.withColumns({"size": size.cast("int"), "short": short.cast("int")})
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumns({"at": start, "piece_len": length})
        .withColumn("d", F.explode(F.sequence(-F.col("k"), F.col("k"))))
        .filter(n + F.col("d") > 0)
        .withColumn(
            "shift",
            F.explode(F.sequence((-F.floor((F.col("k") - F.col("d")) / 2)).cast("int"), F.floor((F.col("k") + F.col("d")) / 2).cast("int"))),
        )
    )
    place = F.when(F.col("piece_len") == 0, F.lit(0)).otherwise(F.col("at") + F.col("shift"))
    keyed = rows.select(
        "project", "lowered", "k", (n + F.col("d")).alias("len"), place.cast("int").alias("place"),
        F.substr("lowered", F.col("at") + 1, F.col("piece_len")).alias("piece"),
    )
    return keyed.filter("place >= 0").distinct()


def _index_keys(names: DataFrame, shortest: Column, longest: Column) -> DataFrame:
    """Every piece of ``shortest`` to ``longest`` characters of a registry name; short names also the empty piece.

    A probe piece has floor(n / (k + 1)) characters or one more.
    """
    n = F.length("lowered")
    sized = names.withColumn("len", n).withColumn("size", F.explode(F.sequence(shortest, F.least(n, longest).cast("int"))))
    sized = sized.filter((F.col("size") > 0) | (F.col("len") <= 4))
    last = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("len") - F.col("size"))
    placed = sized.withColumn("place", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("project", F.col("lowered").alias("near"), "order", "len", "place", F.substr("lowered", F.col("place") + 1, F.col("size")).alias("piece"))


def fuzzy_symbols(names: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, unknown): the nearest registry name of every name that is not known.

    Allowed distance max(2, 30 % of the length), letters compared in lower case; ties go to the
    earliest registry name.  Candidates share a piece of the name at nearly the same place: half of
    the name for one edit, and shorter pieces only for names without a candidate at one edit.
    """
    listed = _by_name(registry)
    asked = names.select("project", "name").distinct().join(listed.select("project", "name"), ["project", "name"], "left_anti")
    queries = asked.withColumn("lowered", F.lower("name"))
    probes = queries.select("project", "lowered").distinct().withColumn("k", _tolerance(F.length("lowered")))
    targets = listed.groupBy("project", F.lower("name").alias("lowered")).agg(F.min(F.struct("place", "name", "hit")).alias("best"))
    names = targets.select("project", "lowered", F.col("best.place").alias("order"))

    def nearest(wanted: DataFrame, index: DataFrame) -> DataFrame:
        pairs = _probe_keys(wanted).join(index, ["project", "len", "place", "piece"]).select("project", "lowered", "k", "near", "order").distinct()
        close = pairs.withColumn("distance", F.levenshtein("lowered", "near")).filter(F.col("distance") <= F.col("k"))
        return close.groupBy("project", "lowered").agg(F.min(F.struct("distance", "order", "near")).alias("m"))

    # One edit leaves a half of the name whole: most names are found by such long pieces and leave.
    n = F.length("lowered")
    halves = _index_keys(names, F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int"), F.ceil((n + 1) / 2))
    near = materialise(nearest(probes.withColumn("k", F.lit(1)), halves), "one-edit")
    rest = probes.join(near, ["project", "lowered"], "left_anti")
    found = (
        near.unionByName(nearest(rest, _index_keys(names, F.lit(0), F.lit(4))))
        .select("project", F.col("lowered").alias("asked"), F.col("m.near").alias("lowered"), F.col("m.distance").cast("bigint").alias("distance"))
        .join(targets, ["project", "lowered"])
        .select("project", F.col("asked").alias("lowered"), "distance", F.col("best.name").alias("suggestion"), F.col("best.hit").alias("hit"))
    )
    matched = queries.join(found, ["project", "lowered"], "left")
    usages = F.col("hit.usages")
    suggestions = matched.filter("suggestion IS NOT NULL").select(
        "project",
        "name",
        "suggestion",
        "distance",
        "hit.category",
        "hit.file",
        "hit.line",
        F.when(usages > 5, "well-established").when(usages == 1, "rarely used").alias("note"),
    )
    return suggestions, matched.filter("suggestion IS NULL").select("project", "name")


def project_overview(files: DataFrame, registry: DataFrame, routes: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of an overview: totals, dirs, languages, route_files."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    dirs = files.groupBy("project", F.when(F.length(folder) > 0, folder).otherwise(F.lit(".")).alias("dir")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")
    )
    languages = files.groupBy("project", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    totals = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    kinds = registry.groupBy("project").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES[:4]])
    ends = routes.groupBy("project").agg(F.count_if(F.col("method") != "MOUNT").alias("routes"))
    totals = totals.join(kinds, "project", "left").join(ends, "project", "left")
    shown = list(CATEGORIES[:4]) + ["routes"]
    if pages is not None:
        totals = totals.join(pages.select("project", "name").distinct().groupBy("project").agg(F.count(F.lit(1)).alias("pages")), "project", "left")
        shown.append("pages")
    totals = totals.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in shown})
    base = F.regexp_replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.js$", ""), "[-_]", "")
    per_file = (
        routes.filter("method <> 'MOUNT'")
        .groupBy("project", "file")
        .agg(F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods"), F.count(F.lit(1)).alias("routes"))
        .withColumn("base", base)
    )
    # A mount is matched by any part of its path: its parts are listed, so this is an equi-join.  Equal paths are listed once, and
    # only parts as long as a name and equal to one go on, so no task sorts or groups all of them.
    word = F.regexp_replace("path", "[/-]", "")
    words = routes.filter("method = 'MOUNT'").groupBy("project", word.alias("word")).agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"))
    bases = per_file.select("project", "base").distinct()
    sizes = bases.groupBy("project").agg(F.collect_set(F.length("base")).alias("sizes"))  # a number for each length of a file name
    last = F.when(F.col("n") == 0, 1).otherwise(F.length("word") - F.col("n") + 1)
    parts = (
        words.join(sizes, "project")
        .withColumn("n", F.explode("sizes"))
        .filter(F.col("n") <= F.length("word"))
        .withColumn("a", F.explode(F.sequence(F.lit(1), last)))
        .select("project", F.substr("word", F.col("a"), F.col("n")).alias("base"), "path", "ord")
        .join(bases, ["project", "base"], "left_semi")
        .groupBy("project", "base")
        .agg(F.min_by("path", "ord").alias("mount"))
    )
    route_files = per_file.join(parts, ["project", "base"], "left").select("project", "file", "methods", "routes", F.coalesce("mount", F.lit("")).alias("mount"))
    return {"totals": totals, "dirs": dirs, "languages": languages, "route_files": route_files}
