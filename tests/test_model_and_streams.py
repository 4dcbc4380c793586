import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainloom.operators import model as md
from chainloom.plans.catalog import QUERIES
from chainloom.streaming import CondenseStore, stream_token_meter, token_meter
from test_condense import call, result, table


def test_retry_waits_double_and_give_up():
    waits, calls = [], []

    def busy(x):
        calls.append(x)
        raise md.RateLimited("busy")

    answer, error = md.call_with_retry(busy, (1,), 4, 1.0, 3.0, waits.append)
    assert answer is None and "busy" in error and len(calls) == 4 and waits == [1.0, 2.0, 3.0, 3.0]
    assert md.call_with_retry(lambda: 1 / 0, (), 4, 1.0, 3.0, waits.append)[1] == "division by zero"
    tries = iter([md.RateLimited("x"), 7])

    def second(_):
        step = next(tries)
        if isinstance(step, Exception):
            raise step
        return step

    assert md.call_with_retry(second, (0,), 4, 1.0, 3.0, lambda _: None) == (7, None)


@pytest.mark.parametrize("bad", [{"type": "x"}, {"importance": "high"}, {"value_score": 101}, {"value_score": True}, {"summary": None}])
def test_scores_are_checked(bad):
    good = {"type": "micro", "importance": "supporting", "value_score": 50, "summary": "s"}
    assert md.check_score(good) is None and md.check_score({**good, **bad}) is not None


def test_summaries_fall_back(spark):
    t = spark.createDataFrame([(1, "u1", 0, "Read", "{}", "first\nx\n\nsecond"), (1, "u2", 0, "Bash", "{}", "abc")], "conv bigint, uuid string, block_idx int, tool string, args string, content string")

    def fn(tool, args, content):
        if tool == "Read":
            raise md.RateLimited("busy")
        return {"summary": "ok", "usage": {"input_tokens": 3}}

    got = md.summarize_blocks(t, fn, concurrency=2, wait=0.0)
    assert rows(got, "uuid", "summary", "fallback", "input_tokens") == [("u1", "first\n  second", True, 0), ("u2", "ok", False, 3)]
    assert md.usage_totals(got).select("calls", "input_tokens").first() == (2, 3)


BLOCKS = "conv bigint, uuid string, block_idx int, tool string, args string, content string"


def test_a_lost_task_makes_no_call_twice(spark, tmp_path):
    """Tasks fail after half their calls; the next attempts, and the next job, find what was answered."""
    import os

    journal, log = str(tmp_path / "journal"), str(tmp_path / "calls")
    os.makedirs(log)
    targets = spark.createDataFrame([(1, f"u{i}", 0, "Read", "{}", f"text {i % 40}") for i in range(50)], BLOCKS)
    stop_at = 20

    def fn(tool, args, content):
        made = len(os.listdir(log))
        if stop_at is not None and made >= stop_at:
            os._exit(1)  # the Python worker dies with its task
        open(f"{log}/{made}-{content.replace(' ', '')}", "w").close()
        return {"summary": content.upper(), "usage": {"input_tokens": 2}}

    with pytest.raises(Exception):
        md.summarize_blocks(targets, fn, concurrency=1, journal=journal)
    first = os.listdir(log)
    assert len(first) == 20
    stop_at = None
    got = md.summarize_blocks(targets, fn, concurrency=1, journal=journal)
    assert rows(got, "uuid", "summary", "fallback") == sorted([(f"u{i}", f"TEXT {i % 40}", False) for i in range(50)], key=repr)
    texts = [name.split("-")[1] for name in os.listdir(log)]
    assert len(texts) == len(set(texts)) == 40
    assert not [f for _, _, files in os.walk(f"{journal}/calls") for f in files]

    def never(tool, args, content):
        raise AssertionError("asked again")

    again = md.summarize_blocks(targets, never, journal=journal)
    assert rows(again, "uuid", "summary", "error") == rows(got, "uuid", "summary", "error")
    other = md.summarize_blocks(targets.limit(1), lambda *_: {"summary": "new"}, journal=journal, asked="another model")
    assert other.first().summary == "new"


def test_scores_from_the_journal_are_checked_alike(spark, tmp_path):
    given = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "conv bigint, turn_id bigint, skeleton string")
    good = {"type": "micro", "importance": "supporting", "value_score": 50, "summary": "s", "key_artifacts": [{"kind": "file", "path": "p"}]}
    fn = lambda turn, text: {**good, "value_score": 500} if turn == 2 else good
    plain = rows(md.score_turns(given, fn), "conv", "turn_id", "summary", "error")
    for _ in range(2):
        assert rows(md.score_turns(given, fn, journal=str(tmp_path / "j")), "conv", "turn_id", "summary", "error") == plain
    assert plain == [(1, 1, "s", None), (1, 2, None, "bad value_score: 500"), (2, 1, "s", None)]


def test_token_meter_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(i % 3, "x" * i) for i in range(50)], "conv bigint, text string")
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b{i}")
    stream_token_meter(stream, sink, str(tmp_path / "state")).awaitTermination()
    last = spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("conv").agg(F.max("messages").alias("messages"), F.max("tokens").alias("tokens"))
    assert rows(last, "conv", "messages", "tokens") == rows(token_meter(df), "conv", "messages", "tokens")


def test_token_meter_query_reads_a_table_of_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, "user", "x" * i) for i in range(20)], "conv_id bigint, turn bigint, role string, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("*.parquet"))
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "conversations.parquet").write_bytes(part.read_bytes())
    want = rows(token_meter(df.withColumnRenamed("conv_id", "conv")), "conv", "messages", "tokens")
    for sf in ("many", "single"):
        assert rows(QUERIES["stream_token_meter"](spark, f"{tmp_path}/{sf}"), "conv", "messages", "tokens") == want


def test_token_meter_query_reads_whatever_the_batch_reader_reads(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, "user", "x" * i) for i in range(20)], "conv_id bigint, turn bigint, role string, text string")
    df.withColumn("part", F.col("turn") % 2).write.partitionBy("part").parquet(f"{tmp_path}/folders/conversations.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    want = rows(token_meter(df.withColumnRenamed("conv_id", "conv")), "conv", "messages", "tokens")
    for sf, expected in (("folders", want), ("none", [])):
        assert rows(QUERIES["stream_token_meter"](spark, f"{tmp_path}/{sf}"), "conv", "messages", "tokens") == expected


def test_condensing_by_batches_is_repeatable(spark, tmp_path):
    def part(a, b):
        return table(spark, *[x for i in range(a, b) for x in (call(2 * i + 1, f"t{i}", "Read", {"file_path": "/p/MEMORY.md"}), result(2 * i + 2, f"t{i}", f"v{i}" * 300))])

    store = CondenseStore(spark, str(tmp_path / "store"), part(0, 1).schema)
    store.process(part(0, 3), 0)
    first = rows(store.replacements(), "uuid", "mode")
    assert first == [("m2", "memory-reads"), ("m4", "memory-reads")]
    store.process(part(3, 5), 1)
    after = rows(store.replacements(), "uuid", "mode")
    assert after == first + [("m6", "memory-reads"), ("m8", "memory-reads")]
    store.process(part(3, 5), 1)
    assert rows(store.replacements(), "uuid", "mode") == after
    assert store.condensed().filter("result_text LIKE '[stale read elided%'").count() == 4


def test_a_batch_reads_no_old_block(spark, tmp_path):
    """The blocks that arrived before are gone when the next batch comes; calls and results may lie in different batches."""
    import shutil

    from test_condense import thought

    path = {"file_path": "/p/a.py"}
    rows_by_batch = [
        [call(1, "a", "Read", path, turn=2, total=2), result(2, "a", "x" * 2000, turn=2, total=2), call(3, "b", "Read", path, turn=2, total=2), thought(4, "idea " * 100, turn=2, total=2)],
        [result(5, "b", "x" * 2000, turn=2, total=2), call(6, "c", "Read", {"file_path": "/p/b.py"}, turn=2, total=2), result(7, "c", "short", turn=2, total=2)],
        [call(8, "d", "Read", path, turn=9, total=9), result(9, "d", "y" * 2000, turn=9, total=9)],
    ]
    store = CondenseStore(spark, str(tmp_path / "store"), table(spark, *rows_by_batch[0]).schema)
    found = []
    for n, blocks in enumerate(rows_by_batch):
        store.process(table(spark, *blocks), n)
        shutil.rmtree(tmp_path / "store" / "blocks")
        found.append({(r.uuid, r.mode) for r in store.replacements().collect()})
    assert found[0] == set() and found[1] == {("m2", "identical-reads")}
    assert found[2] == found[1] | {("m4", "thinking"), ("m5", "stale-reads")}
    versions = store._versions(3, list(range(64)))
    live = store.live("calls", versions)
    assert rows(live, "result_uuid") == [("m7",), ("m9",)]  # the latest of each path; what is condensed is gone
    assert store.live("open", versions).count() == 0 and store.live("waiting", versions).count() == 0
