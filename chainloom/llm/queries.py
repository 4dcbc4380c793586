"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import covertree, hilbert, merkle, mixing, omh, packing, periods, pii, quality, secretscan, squares, toxicity, wrapper
from chainloom.llm.common import span_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op5_best_fit_packing")
def op5(spark, sf):
    return packing.pack(_table(spark, sf, "documents"))


@_query("op7_source_mixing", mixing.ORACLE)
def op7(spark, sf):
    mixed = mixing.mix(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query("op8_order_minhash")
def op8(spark, sf):
    return omh.near_classes(_table(spark, sf, "documents")).select("doc_id", "class_id")


@_query("op1_pairwise_quality")
def op1(spark, sf):
    docs = _table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf, "labels")))


@_query("op9_fair_toxicity")
def op9(spark, sf):
    docs = _table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf, "labels")))


@_query("op2_secret_scan")
def op2(spark, sf):
    return span_digest(secretscan.scan(_table(spark, sf, "documents")), secretscan.BASE_KINDS)


@_query("op4_personal_data")
def op4(spark, sf):
    docs = _table(spark, sf, "documents")
    return span_digest(pii.scan(docs, pii.fit(docs)), pii.KINDS)


@_query("op3_cover_tree_topk", covertree.ORACLE)
def op3(spark, sf):
    return covertree.top_products(_table(spark, sf, "embeddings"))


@_query("op6_hilbert_neighbours")
def op6(spark, sf):
    return hilbert.nearest(_table(spark, sf, "embeddings"))


@_query("op10_wrapper_text")
def op10(spark, sf):
    return wrapper.main_text(_table(spark, sf, "pages"))


@_query("op11_merkle_manifest", merkle.ORACLE)
def op11(spark, sf):
    docs = _table(spark, sf, "documents")
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1)
    changed = merkle.leaf_digest([F.coalesce(more, F.col(c)) if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    rows = merkle.proofs(merkle.manifest(docs, carry={"shown": F.when(more.isNotNull(), changed)}))
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("shown", "leaf"), F.col("path")))
    proof = merkle.path_digest(F.col("path")).alias("proof_sha256")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", verified)


@_query("op12_sum_of_squares")
def op12(spark, sf):
    return squares.pack(_table(spark, sf, "documents"))


@_query("op13_periodic_runs")
def op13(spark, sf):
    found = periods.periodic_runs(periods.with_repeated_tails(_table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    best = found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return best
