"""The pipeline's stages by plain means on a small corpus, and the registered queries against their oracles."""

import os

import pytest
from pyspark.sql import functions as F
from support import awkward, documents

import corpus_pipeline
from chainloom.llm import omh, queries, secretscan
from chainloom.operators.storage import materialise

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows = awkward() + [(100 + i, f"plain text number {i} with its own words {i * 31} {i * 57} {i * 91} and an end", f"s{i % 4}") for i in range(60)]
    rows += [(300, rows[10][1] + " !", "s1"), (301, 'token = "abcdefgh12345678" is in here with other words 301', "s2")]
    docs = documents(spark, rows)
    sf = str(tmp_path)
    marks = [(100 + i, 1, 0) for i in range(60)] + [(1, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = materialise(stage["toxicity"](spark, docs, sf), "t")
    assert clean.columns == docs.columns and clean.count() == len(rows)  # no toxic label: nothing is rejected
    kept = materialise(stage["near_dedup"](spark, clean, sf), "t")
    assert kept.columns == docs.columns
    classes = {r.class_id for r in omh.near_classes(docs).collect()}
    assert kept.count() == len(classes)
    hidden = materialise(stage["secrets"](spark, kept, sf), "t")
    assert hidden.columns == docs.columns and hidden.count() == kept.count()
    assert [secretscan.PLACEHOLDER in r.text for r in hidden.filter("doc_id = 301").collect()] == [True]
    mixed = materialise(stage["mixing"](spark, hidden, sf), "t")
    assert mixed.columns == docs.columns
    assert mixed.exceptAll(hidden.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("n")).count() == 0
    packed = stage["packing"](spark, mixed, sf)
    assert packed.filter("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_stage_order_and_empty_input(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    documents(spark, awkward()).limit(0).write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
def test_every_query_runs_over_its_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_pairwise_quality", "op2_secret_scan", "op8_order_minhash", "op9_fair_toxicity"):
        assert queries.QUERIES[name](spark, SF).count() == docs
    assert queries.QUERIES["op10_wrapper_text"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
