import json

from conftest import rows
from pyspark.sql import functions as F

from chainloom.functions.content import edit_json
from chainloom.operators import chain as ch
from chainloom.operators import rewrite as rw
from chainloom.plans import views
from chainloom.sources import transcripts as tr


def entry(uid, parent, kind="user", content="hi", **more):
    return json.dumps({"uuid": uid, "parentUuid": parent, "type": kind, "timestamp": "2026-01-01T00:00:00Z", "message": {"role": kind, "content": content}, **more})


def write(tmp_path, **files):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, lines in files.items():
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_lines_blanks_and_bad_rows(spark, tmp_path):
    path = write(
        tmp_path,
        a=['{"type":"file-history-snapshot","messageId":"x"}', "", entry("u1", None), "not json", "   ", entry("u2", "u1", "assistant")],
        b=[entry("v1", None, timestamp2="x")],
    )
    m = tr.read_transcripts(spark, path).cache()
    assert rows(m.filter("conv = 'a'"), "line", "uuid", "is_corrupt") == [(0, None, False), (1, "u1", False), (2, None, True), (3, "u2", False)]
    assert rows(tr.read_transcript_keys(spark, path), "conv", "uuid") == [("a", "u1"), ("a", "u2"), ("a", None), ("b", "v1")]
    assert rows(ch.walk_chain(m), "conv", "pos", "uuid") == [("a", 1, "u1"), ("a", 2, "u2"), ("b", 1, "v1")]


def test_ordinals_across_file_splits(spark, tmp_path):
    path = write(tmp_path, big=[entry(f"u{i}", f"u{i - 1}" if i else None, content="x" * (i % 50)) for i in range(400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        df = tr.read_lines(spark, path)
        got = rows(df.select("line", F.get_json_object("raw", "$.uuid").alias("uuid")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == [(i, f"u{i}") for i in range(400)]


def test_content_shapes(spark, tmp_path):
    blocks = [
        "bare",
        {"type": "text", "text": "t"},
        {"type": "mystery"},
        {"type": "thinking", "thinking": "th", "signature": "s"},
        {"type": "tool_use", "id": "1", "name": "Read", "input": {"b": 1, "a": 2}},
        {"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "r1"}, {"type": "image", "source": {"data": "abcd"}}, {"type": "text", "text": "r2"}]},
        {"type": "tool_result", "tool_use_id": "2", "content": "plain", "is_error": True},
        '{"type":"text","text":"still a string"}',
    ]
    path = write(tmp_path, a=[entry("u1", None, content=blocks), entry("u2", "u1", content=[{"type": "tool_result", "tool_use_id": "9", "content": "x"}]), entry("u3", "u2", content="")])
    m = tr.read_transcripts(spark, path).cache()
    text = m.filter("uuid = 'u1'").select("text").first()[0]
    assert text == "\n".join(["bare", "t", "", "th", '{"b":1,"a":2}', "r1\n\nr2", "plain", '{"type":"text","text":"still a string"}'])
    assert rows(m, "uuid", "opens_turn", "real_user", "plain_chars") == [("u1", True, True, 1 + 5), ("u2", False, False, 1), ("u3", True, False, 0)]
    got = rows(tr.explode_blocks(m).filter("uuid = 'u1'"), "block_idx", "type", "result_concat", "image_chars")
    assert got[5] == (5, "tool_result", "r1r2", 4) and got[7][1] == "bare" and got[0][1] == "bare"


def test_bad_and_missing_times(spark, tmp_path):
    lines = [json.dumps({"uuid": u, "parentUuid": None, "type": "user", "timestamp": t, "message": {"role": "user", "content": "x"}}) for u, t in (("a", "soon"), ("b", "2026-01-01T00:00:00Z"))]
    m = tr.read_transcripts(spark, write(tmp_path, a=lines))
    assert rows(m, "uuid", "bad_ts") == [("a", True), ("b", False)]
    assert rows(ch.active_leaf(m), "uuid") == [("a",)]


def test_edit_json_keeps_the_rest(spark):
    raw = '{"z":1,"uuid":"u\\"1","n":null,"parentUuid":"p","deep":{"b":[1,"x"],"a":true},"num":"12"}'
    df = spark.createDataFrame([(raw,)], "raw string")
    out = df.select(edit_json(F.col("raw"), {"parentUuid": F.lit("null"), "extra": F.lit("true")}).alias("r")).first()[0]
    want = json.loads(raw)
    want["parentUuid"] = None
    want["extra"] = True
    assert json.loads(out) == want
    assert list(json.loads(out)) == [*json.loads(raw), "extra"]


def test_write_and_read_back(spark, tmp_path):
    path = write(tmp_path, a=[entry(f"a{i}", None) for i in range(30)] + ["broken"], b=[entry("b0", None)])
    first = tr.read_lines(spark, path)
    out = str(tmp_path / "out")
    tr.write_transcripts(first, out)
    again = tr.read_lines(spark, out)
    assert rows(again, "conv", "line", "raw") == rows(first, "conv", "line", "raw")


def test_drop_beats_replace_and_bad_rows_stay(spark):
    m = spark.createDataFrame([("a", 0, "u1", "x"), ("a", 1, None, "bad"), ("a", 2, "u2", "y"), ("a", 3, "u3", "z")], "conv string, line bigint, uuid string, text string")
    both = spark.createDataFrame([("a", "u1", "new"), ("a", "u2", "new"), ("a", "zz", "new")], "conv string, uuid string, text string")
    out, stats = rw.rewrite(m, drop=both.filter("uuid <> 'u2'"), replace=both)
    assert rows(out, "line", "text") == [(1, "bad"), (2, "new"), (3, "z")]
    assert rows(stats, "lines_before", "dropped", "replaced") == [(4, 1, 1)]


def test_transcripts_are_opened_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text('{"uuid":"1"}\n\n{"uuid":"2"}\n')
    lines = tr.read_lines(spark, str(tmp_path))
    assert rows(lines, "conv", "line", "raw") == [(c, i, f'{{"uuid":"{i + 1}"}}') for c in "ab" for i in (0, 1)]
    assert all("transcript-lines" in f for f in lines.inputFiles())


def test_a_small_table_is_dealt_out_before_views_make_text_of_it(spark, tmp_path):
    spark.range(50).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    views.load_tables(spark, str(tmp_path), "SELECT * FROM part")
    part = spark.table("part")
    assert part.rdd.getNumPartitions() == 2 and part.count() == 50


def test_folders_are_written_by_given_ranges_and_listed_by_few_tasks(spark, tmp_path):
    path, sc = str(tmp_path / "many"), spark.sparkContext
    want = [(f"c{i:03}", i % 2, f'{{"uuid":"{i}"}}') for i in range(160)]
    tr.write_transcripts(spark.createDataFrame(want, "conv string, line long, raw string"), path)
    parts = {f.name.split("-")[1] for f in (tmp_path / "many").glob("conv=*/part-*")}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not one task for all, as their bytes would have it
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc.setJobGroup("listing", "")
    try:
        lines = tr.read_lines(spark, path)
        status = sc.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= 64  # not one for each folder
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert sorted((r.conv, r.raw) for r in lines.collect()) == sorted((c, raw) for c, _, raw in want)
