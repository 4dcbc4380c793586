"""Materialised intermediate tables in the checkpoint folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a fresh local folder only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="chainloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives executor loss, keeps column pruning."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Files that are read inside are listed by LISTING_TASKS tasks of many folders, not by a task for each folder up to 10,000."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(LISTING_TASKS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside when the block ends: results have to be written or collected by then."""
    start = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_written) > start:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(conf).delete(path, True)
