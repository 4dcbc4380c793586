"""Time the headline queries.  Prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3, the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainloom.operators.chain import walk_chain
from chainloom.operators.storage import scope
from chainloom.plans import catalog
from chainloom.plans.views import view

HEADLINE = (
    "context_status",
    "walk_chain",
    "segment_turns",
    "summarize_segments",
    "segment_tools",
    "pair_calls",
    "build_condense_plan",
    "apply_plan",
    "build_registry",
    "fuzzy_symbols",
    "unknown_references",
    "parse_notes",
    "search_notes",
)
COPIES = 1000


def walk_many(spark: SparkSession, sf: str):
    """The chain walk over every branched conversation a thousand times."""
    m = view(spark, sf, "f2_messages").drop("text")
    many = m.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    many = many.withColumn("conv", F.col("conv") * COPIES + F.col("copy")).drop("copy").repartition("conv")
    return walk_chain(many)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(fn) -> tuple[float, int]:
        with scope(spark):
            start = time.perf_counter()
            n = fn(spark, sf).agg(F.count(F.lit(1))).first()[0] if fn is walk_many else _consume(fn(spark, sf))
            return time.perf_counter() - start, n

    def _consume(df) -> int:
        df.write.format("noop").mode("overwrite").save()
        return 0

    took: dict[str, float] = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        once(fn)
        took[name] = round(statistics.median(once(fn)[0] for _ in range(runs)), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    seconds, rows = once(walk_many)
    took["walk_chain_x1000"] = round(seconds, 3)
    out = {
        "metric": "headline_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "walk_chain_rows_per_sec": round(rows / seconds),
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
