"""Note documents in."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_notes(spark: SparkSession, places: Mapping[str, tuple[str, str]]) -> DataFrame:
    """docs(tier, ref, content, modified) of ``places``: tier → (folder, file name pattern).

    Hidden folders and node_modules are passed over; ``ref`` is the path below the folder.  Notes are many small files: their
    bytes are read as they are, which opens a file several times faster than the text reader, by tasks of many files each.
    """
    out, tasks = None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for tier, (folder, pattern) in places.items():
        base = F.lit(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:/+", "/", folder).rstrip("/") + "/")  # the scheme may be written file:/ or file:///
        path = F.col("_metadata.file_path")
        rows = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
            .select(
                F.lit(tier).alias("tier"),
                F.substr(path, F.instr(path, base) + F.length(base)).alias("ref"),
                F.col("content").cast("string").alias("content"),
                F.to_date("_metadata.file_modification_time").alias("modified"),
            )
            .filter(~F.col("ref").rlike(r"(^|/)(\.[^/]*|node_modules)/"))
            .coalesce(tasks)
        )
        out = rows if out is None else out.unionByName(rows)
    return out
