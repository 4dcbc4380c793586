"""Project notes: markdown documents, their entries, the keyword index, plans.

docs(tier, ref, content, modified) — one row per note file.
notes(tier, ref, header, header_ord, seq, entry, date) — one row per entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import is_blank, let, one_decimal_kb, trim_blank
from chainloom.operators.scan import attach, scan, take_first
from chainloom.operators.storage import materialise

# Note types and the header each is filed under in a file's notes.
HEADERS = {
    "caution": "Cautions", "edge_case": "Edge Cases", "decision": "Decisions", "lesson": "Lessons", "pattern": "Patterns", "plan": "Plans",
}
SNIPPET_BEFORE, SNIPPET_AFTER = 50, 100
GRAM = 4
DOC = ["tier", "ref"]


def parse_notes(docs: DataFrame) -> DataFrame:
    """Entries under '## ' headers; a header that comes again starts its list anew."""
    lines = docs.select(*DOC, F.posexplode(F.split("content", "\n")).alias("i", "text"))
    header = F.regexp_extract("text", r"^## (.+)$", 1)
    marked = scan(
        lines.withColumn("i", F.col("i").cast("bigint")), DOC, "i", lasts={"h": F.when(F.length(header) > 0, F.struct(F.col("i").alias("at"), header.alias("name")))}
    )
    # Only headers and entries are read on, and twice: written once.
    used = F.col("h").isNotNull() & ((F.col("h.at") == F.col("i")) | F.startswith("text", F.lit("- ")))
    marked = materialise(marked.filter(used), "note-lines")
    blocks = marked.filter(F.col("h.at") == F.col("i")).select(*DOC, F.col("h.name").alias("header"), F.col("i").alias("at"))
    kept = blocks.groupBy(*DOC, "header").agg(F.max("at").alias("at"), F.min("at").alias("header_ord"))
    entries = marked.filter(F.col("h").isNotNull() & F.startswith("text", F.lit("- "))).select(
        *DOC, F.col("h.at").alias("at"), "i", F.substr("text", F.lit(3)).alias("entry")
    )
    rows = attach(entries, kept, [*DOC, "at"], "i")
    numbered = scan(rows, [*DOC, "at"], "i", sums={"seq": F.lit(1).cast("bigint")})
    return numbered.select(*DOC, "header", "header_ord", "seq", "entry", entry_date(F.col("entry")).alias("date"))


def entry_date(entry: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(entry, r"\((\d{4}-\d{2}-\d{2})\)$", 1), F.lit("")))


def filed_under(kind: Column, tier: Column) -> Column:
    """Header of a new entry: a file's notes use the table, sections the type's own words in plural."""
    table = F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv])
    words = F.concat(F.upper(F.left(kind, F.lit(1))), F.regexp_replace(F.substr(kind, F.lit(2)), "^([^_]*)_", "$1 "), F.lit("s"))
    return F.when(tier == "section", words).otherwise(F.try_element_at(table, kind))


def add_notes(notes: DataFrame, new: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """(notes, rejected).  ``new`` has tier, ref, note_type, text and the ordinal ``ord``.

    A new entry goes first under its header, a new header last in its document.
    """
    valid = F.coalesce(F.col("note_type").isin(*HEADERS), F.lit(False)) & ~is_blank(F.coalesce("text", F.lit("")))
    rejected = new.filter(~valid).select(*DOC, "note_type", "text", "ord")
    stamped = F.when(F.col("tier") == "section", F.concat(F.lit("**"), "text", F.lit("**"))).otherwise(F.col("text"))
    fresh = new.filter(valid).select(
        *DOC, filed_under(F.col("note_type"), F.col("tier")).alias("header"), "ord", F.concat(stamped, F.lit(f" ({date})")).alias("entry")
    )
    place = [*DOC, "header"]
    one = F.lit(1).cast("bigint")
    ranked = scan(fresh, place, "ord", sums={"rank": one}, totals={"added": ("sum", one)})
    counts = fresh.groupBy(*place).agg(F.count(F.lit(1)).alias("added"), F.min("ord").alias("first_ord"))
    known = notes.groupBy(*place).agg(F.min("header_ord").alias("header_ord"))
    ends = known.groupBy(*DOC).agg(F.max("header_ord").alias("last_ord"))
    opened = counts.join(known, place, "left").filter("header_ord IS NULL").join(ends, DOC, "left")
    opened = scan(opened, DOC, ["first_ord", "header"], sums={"nth": one})
    headers = known.unionByName(opened.select(*place, (F.coalesce("last_ord", F.lit(-1)) + F.col("nth")).cast("bigint").alias("header_ord")))
    top = attach(ranked, headers, place, "ord").select(
        *place, "header_ord", (F.col("added") - F.col("rank") + 1).alias("seq"), "entry", F.to_date(F.lit(date)).alias("date")
    )
    shifted = attach(notes, counts.select(*place, "added"), place, "seq", how="left").withColumn(
        "seq", F.col("seq") + F.coalesce("added", F.lit(0))
    )
    return shifted.select(*place, "header_ord", "seq", "entry", "date").unionByName(top), rejected


def global_notes(new: DataFrame, date: str) -> DataFrame:
    """Documents of notes that belong to no project: named by the first keyword or the text's start."""
    name = F.lower(F.regexp_replace(F.coalesce(F.try_element_at("keywords", F.lit(1)), F.left("text", F.lit(30))), "(?i)[^a-z0-9-]", "-"))
    content = F.concat(
        F.lit("# "), F.substring_index("text", ".", 1), F.lit("\n\n*Type*: "), "note_type", F.lit(f" | *Date*: {date}\n\n"), "text", F.lit("\n")
    )
    docs = new.filter(F.col("note_type").isin(*HEADERS)).select(
        F.when(F.col("note_type") == "pattern", "global/patterns").otherwise("global/lessons").alias("tier"), name.alias("ref"), content.alias("content"), "ord"
    )
    return docs.groupBy(*DOC).agg(F.max_by("content", "ord").alias("content"))


def _first_entries(notes: DataFrame, needles: DataFrame) -> DataFrame:
    """(tier, ref, needle, at): the first entry of the document that contains each search text.

    Texts of GRAM letters and more are looked up by their last GRAM letters, so an entry meets only the texts that end in
    letters it has; there are few shorter texts, and each is compared with the entries of its document.
    """
    lowered = notes.select(*DOC, "header", "header_ord", "seq", F.lower("entry").alias("low"))
    places = F.sequence(F.lit(1), F.greatest(F.length("low") - GRAM + 1, F.lit(1)))
    grams = lowered.withColumn("gram", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("low", i, F.lit(GRAM))))))
    long = needles.filter(F.length("needle") >= GRAM).withColumn("gram", F.right("needle", F.lit(GRAM)))
    found = grams.join(long, [*DOC, "gram"]).drop("gram")
    short = attach(lowered, needles.filter(F.length("needle") < GRAM), DOC, "seq")
    found = found.unionByName(short).filter(F.contains("low", F.col("needle")))
    return found.groupBy(*DOC, "needle").agg(F.min(F.struct("header_ord", "seq", "header")).alias("at"))


def render_notes(notes: DataFrame, titles: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """(tier, ref, content): the documents as markdown that ``parse_notes`` reads again.

    ``titles(tier, ref, title)`` names the documents; ``annotations`` are rows of ``annotate_notes``: each comment follows
    its entry, those without a place end the document.
    """
    line = notes.select(*DOC, "header", "header_ord", "seq", F.lit(0).alias("turn"), F.concat(F.lit("- "), "entry").alias("text"))
    if annotations is not None:
        at = notes.select(*DOC, "header", "seq", "header_ord")
        under = annotations.join(at, [*DOC, "header", "seq"]).select(*DOC, "header", "header_ord", "seq", F.col("id").alias("turn"), F.col("annotation").alias("text"))
        line = line.unionByName(under.withColumn("turn", F.col("turn") + 1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "turn", "text"))), lambda r: r["text"]), "\n")
    parts = line.groupBy(*DOC, "header", "header_ord").agg(body.alias("body"))
    parts = parts.withColumn("part", F.concat(F.lit("\n## "), "header", F.lit("\n"), "body", F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct("header_ord", "header", "part")))
    docs = parts.groupBy(*DOC).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("parts"))
    if titles is not None:
        docs = docs.join(titles.select(*DOC, "title"), DOC, "left")
    name = F.coalesce(F.col("title"), F.col("ref")) if titles is not None else F.col("ref")
    content = F.concat(F.lit("# "), name, F.lit("\n"), "parts")
    if annotations is not None:
        loose = annotations.filter("header IS NULL").groupBy(*DOC).agg(F.array_sort(F.collect_list("annotation")).alias("loose"))
        docs = docs.join(loose, DOC, "left")
        content = F.concat(content, F.coalesce(F.concat(F.array_join("loose", "\n"), F.lit("\n")), F.lit("")))
    return docs.select(*DOC, content.alias("content"))


def annotate_notes(notes: DataFrame, annotations: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """(placed, unmatched) for ``annotations(id, tier, ref, search, comment)``.

    A comment follows the first entry that contains the search text, whatever its case; without
    a search text it goes to the end of the document (header and seq stay null).
    """
    comment = F.concat(F.lit(f"  > _{date}_: "), trim_blank(F.col("comment")))
    asked = annotations.filter(~is_blank(F.coalesce("comment", F.lit("")))).withColumn("annotation", comment)
    searching = asked.filter(F.length("search") > 0)
    searching = searching.withColumn("needle", F.lower("search"))
    hits = _first_entries(notes, searching.select(*DOC, "needle").distinct())
    joined = searching.join(hits, [*DOC, "needle"], "left")
    placed = joined.filter("at IS NOT NULL").select("id", *DOC, F.col("at.header").alias("header"), F.col("at.seq").alias("seq"), "annotation")
    known = notes.select(*DOC).distinct()
    tail = asked.filter(F.coalesce(F.length("search"), F.lit(0)) == 0)
    at_end = tail.join(known, DOC, "left_semi").select(
        "id", *DOC, F.lit(None).cast("string").alias("header"), F.lit(None).cast("bigint").alias("seq"), "annotation"
    )
    missed = joined.filter("at IS NULL").select("id").unionByName(tail.join(known, DOC, "left_anti").select("id"))
    return placed.unionByName(at_end), missed


def keyword_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """(keyword, ref, ord): lower-cased keywords with their refs once, at the earliest ordinal."""
    every = index.select("keyword", "ref", "ord").unionByName(new.select("keyword", "ref", "ord"))
    return every.groupBy(F.lower("keyword").alias("keyword"), "ref").agg(F.min("ord").alias("ord"))


def snippet(content: Column, lowered: Column, keyword: Column) -> Column:
    """The hit with 50 characters before and 100 behind it, dots where text was left out."""
    at = F.instr(lowered, keyword) - 1
    start = F.greatest(F.lit(0), at - SNIPPET_BEFORE)
    end = F.least(F.length(content), at + F.length(keyword) + SNIPPET_AFTER)
    return F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        trim_blank(F.substr(content, start + 1, end - start)),
        F.when(end < F.length(content), F.lit("...")).otherwise(F.lit("")),
    )


def search_notes(docs: DataFrame, index: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(keyword, source, ref, snippet) of every index and text hit of the given words.

    One pass over the documents whatever the number of words; each text is lower-cased once.
    """
    words = sorted({k.lower() for k in keywords if k})
    given = F.array(*[F.lit(w) for w in words])
    hits = let(
        F.lower("content"),
        lambda low: F.transform(
            F.filter(given, lambda w: F.contains(low, w)), lambda w: F.struct(w.alias("keyword"), snippet(F.col("content"), low, w).alias("snippet"))
        ),
    )
    found = docs.select(F.col("tier").alias("source"), "ref", F.explode(hits).alias("h")).select("h.keyword", "source", "ref", "h.snippet")
    listed = index.filter(F.col("keyword").isin(*words)).select("keyword", F.lit("index").alias("source"), "ref", F.lit(None).cast("string").alias("snippet"))
    return found.unionByName(listed)


def list_notes(docs: DataFrame, plans: DataFrame, only: str | None = None, sidecars: int | None = None) -> DataFrame:
    """(tier, name, size_kb, modified, status, total): listing per tier; of the sidecars the first ``sidecars``, if given."""
    rows = docs if only is None else docs.filter(F.startswith("tier", F.lit(only)))
    sized = rows.select("tier", "ref", F.octet_length("content").alias("bytes"), "modified")
    first = take_first(sized.filter("tier = 'sidecar'"), ["tier"], [F.asc("ref")], sidecars)
    shown = sized.filter("tier <> 'sidecar'").unionByName(first)
    totals = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("total"))
    name = F.regexp_replace("ref", r"\.md$", "")
    # There are only a handful of tiers, so their totals are a tiny table.
    out = shown.join(totals, "tier").withColumn("name", name).join(plans.select(F.col("name").alias("__plan"), F.col("status").alias("__status")), F.col("name") == F.col("__plan"), "left")
    return out.select(
        "tier",
        "name",
        F.when(F.col("tier") == "section", one_decimal_kb(F.col("bytes"))).alias("size_kb"),
        F.when(F.col("tier").isin("section", "sidecar"), F.col("modified")).alias("modified"),
        F.when(F.col("tier") == "plan", F.coalesce("__status", F.lit("unknown"))).alias("status"),
        "total",
    )


def notes_overview(docs: DataFrame, section_files: DataFrame, section_plans: DataFrame, plans: DataFrame, index: DataFrame, sidecars: int | None = None) -> dict[str, DataFrame]:
    """Tables of an overview: sections, plans, keywords, sidecars."""
    files = section_files.distinct().groupBy("section").agg(F.count(F.lit(1)).alias("files"))
    linked = section_plans.select("section", "plan").distinct().groupBy("section").agg(F.count(F.lit(1)).alias("plans"))
    sections = files.join(linked, "section", "full").select(
        "section", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files", "plans")]
    )
    return {
        "sections": sections,
        "plans": plans.select("name", F.coalesce("status", F.lit("unknown")).alias("status"), F.array_join("sections", ", ").alias("sections")),
        "keywords": index.select("keyword").distinct(),
        "sidecars": take_first(docs.filter("tier = 'sidecar'").select("tier", "ref"), ["tier"], [F.asc("ref")], sidecars).select("ref"),
    }


def plan_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?i)[^a-z0-9-]", "-"))


def upsert_plan(plans: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, section_plans).  Fields a change leaves out are inherited; the status starts as active.

    ``changes`` has name, status, sections, files and the ordinal ``ord``.
    """
    cols = ("status", "sections", "files")
    given = {
        "status": F.when(F.length("status") > 0, F.col("status")),
        "sections": F.col("sections"),
        "files": F.col("files"),
    }
    last = changes.withColumn("name", plan_name(F.col("name"))).groupBy("name").agg(
        *[F.max_by(given[c], F.when(given[c].isNotNull(), F.col("ord"))).alias(f"new_{c}") for c in cols]
    )
    joined = plans.join(last, "name", "full")
    none = F.array().cast("array<string>")
    out = joined.select(
        "name",
        F.coalesce("new_status", "status", F.lit("active")).alias("status"),
        F.coalesce("new_sections", "sections", none).alias("sections"),
        F.coalesce("new_files", "files", none).alias("files"),
    )
    named = changes.select(F.explode("sections").alias("section"), plan_name(F.col("name")).alias("plan"), "ord")
    before = plans.select(F.explode("sections").alias("section"), F.col("name").alias("plan"), F.lit(-1).cast("bigint").alias("ord"))
    links = before.unionByName(named).groupBy("section", "plan").agg(F.min("ord").alias("ord"))
    return out, links


def backup_name(at: Column, name: Column, content: Column) -> Column:
    """Time, plan and a short form of the first heading, parted by double underscores."""
    title = F.lower(trim_blank(F.regexp_extract(content, r"(?m)^#\s+(.+)", 1)))
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"[^a-z0-9\s-]", ""), r"\s+", "-"), "-{2,}", "-")
    short = F.regexp_replace(F.left(words, F.lit(50)), "^-|-$", "")
    stamp = F.date_format(at, "yyyy-MM-dd-HH-mm-ss")
    return F.concat(stamp, F.lit("__"), name, F.when(F.length(short) > 0, F.concat(F.lit("__"), short)).otherwise(F.lit("")), F.lit(".md"))


def get_notes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents named by ``keys(tier, ref)``."""
    return docs.join(keys.select(*DOC).distinct(), DOC, "left_semi")
