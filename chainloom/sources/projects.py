"""Source trees in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.text import line_count, trim_blank
from chainloom.operators.scan import take_first
from chainloom.operators.storage import materialise

# Folders that hold no source, and the languages by file ending.  Hidden names
# are skipped by a rule of their own.
SKIP_DIRS = (
    "node_modules", "dist", "build", "coverage", "__pycache__", "venv", "vendor", "target", "archive", "backups",
    "backup", "logs", "tmp", "uploads", "media", "data", "migrations", "content", "Website", "public", "static", "assets",
)
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "html": "html",
}
BATCH_CHARS = 4 << 20  # text a task reads before it passes its files on
# The limits of an interactive scan; nothing is left out unless they are passed.
INTERACTIVE = {"max_files": 2000, "max_bytes": 500 * 1024, "max_html_bytes": 5 * 1024 * 1024, "max_depth": 8}


def ignored_dirs(gitignores: DataFrame) -> DataFrame:
    """(project, dir): plain folder names out of ``gitignores(project, content)``."""
    lines = gitignores.select("project", F.explode(F.split("content", "\n")).alias("l")).select("project", trim_blank(F.col("l")).alias("l"))
    return lines.filter(F.col("l").rlike(r"^[a-zA-Z0-9_-]+/?$")).select("project", F.regexp_replace("l", "/$", "").alias("dir")).distinct()


def _hidden(name: Column) -> Column:
    return F.startswith(name, F.lit(".")) & (name != ".env.example")


def select_files(
    listing: DataFrame,
    ignored: DataFrame | None = None,
    max_files: int | None = None,
    *,
    max_bytes: int | None = None,
    max_html_bytes: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Source files of ``listing(project, path, size, modified, …)`` with lang and file_ord.

    Files are in the order of a walk that goes through each folder by name.  Without limits all
    are kept; ``over_limits`` lists what given limits leave out.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    lang_of = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    skipped = F.exists(parts, lambda p: _hidden(p) | p.isin(*SKIP_DIRS))
    copies = F.exists(folders, lambda p: F.contains(p, F.lit(" ")) | F.contains(F.lower(p), F.lit("backup")))
    lang = F.try_element_at(lang_of, F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    rows = listing.withColumns({"lang": lang, "__parts": parts}).filter(~skipped & ~copies & F.col("lang").isNotNull())
    if max_depth is not None:
        rows = rows.filter(F.size("__parts") - 1 <= max_depth)
    for limit, html in ((max_bytes, False), (max_html_bytes, True)):
        if limit is not None:
            rows = rows.filter(((F.col("lang") == "html") != html) | (F.col("size") <= limit))
    if ignored is not None:
        named = rows.select("project", "path", F.explode("__parts").alias("dir"))
        out = named.join(ignored, ["project", "dir"], "left_semi").select("project", "path").distinct()
        rows = rows.join(out, ["project", "path"], "left_anti")
    # Order by the path itself with the separator below every other character.
    rows = rows.withColumn("file_ord", F.concat_ws("\x01", F.transform("__parts", F.lower)))
    rows = rows.withColumn("file_ord", F.concat_ws("\x02", "file_ord", "path")).drop("__parts")
    return take_first(rows, ["project"], [F.asc("file_ord")], max_files)


def over_limits(listing: DataFrame, ignored: DataFrame | None = None, **limits: int) -> DataFrame:
    """The source files that ``limits`` make ``select_files`` leave out."""
    return select_files(listing, ignored).join(select_files(listing, ignored, **limits).select("project", "path"), ["project", "path"], "left_anti")


def _has_scheme(root: str) -> bool:
    """Hadoop writes local folders as ``file:/a``, others as ``scheme://host/a``."""
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", root))


def _files(spark: SparkSession, root: str) -> None:
    """Tasks on other machines cannot open a path without a scheme."""
    if not _has_scheme(root) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("give the folder with its scheme: tasks on other machines have to open it")


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if _has_scheme(root) else (pafs.LocalFileSystem(), root)


_LISTED = "path string, is_dir boolean, size bigint, modified bigint, uri string"


def list_projects(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, size, modified, uri) of the files below every folder of ``root``.

    The file reader of Spark passes over names that begin with '.' or '_', and packages are full
    of those, so the folders are listed in tasks: one level after the other, each folder by itself.
    Folders that hold no source are not entered.
    """
    _files(spark, root)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = _open(root)
        for batch in batches:
            for folder in batch["folder"]:
                found = files.get_file_info(pafs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/")))
                yield pd.DataFrame(
                    [
                        (f"{folder}/{e.base_name}".lstrip("/"), e.type == pafs.FileType.Directory, e.size or 0, int(e.mtime.timestamp()) if e.mtime else 0, e.path)
                        for e in found
                    ],
                    columns=["path", "is_dir", "size", "modified", "uri"],
                )

    folders, levels = spark.createDataFrame([("",)], "folder string"), []
    while True:
        level = materialise(folders.repartition("folder").mapInPandas(children, _LISTED), "folders")
        levels.append(level.filter("NOT is_dir"))
        name = F.substring_index("path", "/", -1)
        inner = F.contains("path", F.lit("/"))  # projects may have any name
        folders = level.filter(F.col("is_dir") & ~(inner & (_hidden(name) | name.isin(*SKIP_DIRS)))).select(F.col("path").alias("folder"))
        if folders.isEmpty():
            break
    listing = levels[0]
    for level in levels[1:]:
        listing = listing.unionByName(level)
    cut = F.instr("path", "/")
    return listing.filter(cut > 0).select(
        F.substring_index("path", "/", 1).alias("project"), F.substr("path", cut + 1).alias("path"), "size", F.to_date(F.timestamp_seconds("modified")).alias("modified"), "uri"
    )


def read_files(listing: DataFrame, root: str, column: str = "content") -> DataFrame:
    """Add the text of each listed file; files are read in tasks, spread by path, ``BATCH_CHARS`` and a file in memory at a time."""
    spark = listing.sparkSession
    _files(spark, root)
    schema = f"{', '.join(f'{n} {t}' for n, t in listing.dtypes)}, {column} string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _open(root)
        for batch in batches:
            texts, chars, first = [], 0, 0
            for i, uri in enumerate(batch["uri"], 1):
                with files.open_input_stream(uri) as f:
                    texts.append(f.read().decode("utf-8", errors="replace"))
                chars += len(texts[-1])
                if chars >= BATCH_CHARS or i == len(batch):
                    yield batch.iloc[first:i].assign(**{column: texts})
                    texts, chars, first = [], 0, i

    # a number of partitions of their own: the listing is small, what it names is not
    return listing.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project", "path").mapInPandas(read, schema)


def scan_project(spark: SparkSession, root: str, **limits: int) -> DataFrame:
    """(project, path, lang, lines, size, modified, content, file_ord) of every project folder below ``root``."""
    listing = materialise(list_projects(spark, root), "listing")
    ignores = read_files(listing.filter("path = '.gitignore'"), root)
    kept = read_files(select_files(listing, ignored_dirs(ignores), **limits), root)
    return kept.drop("uri").withColumn("lines", line_count(F.col("content")))
