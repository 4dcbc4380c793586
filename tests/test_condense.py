import json

from conftest import rows
from pyspark.sql import functions as F

from chainloom.operators import condense as cd
from chainloom.sources import transcripts as tr

BLOCK = (
    "conv bigint, pos bigint, uuid string, block_idx int, type string, text string, thinking string, signature string, tool_id string, tool string, "
    "args string, result_text string, result_concat string, image_chars bigint, is_error boolean, turn_id bigint, total_turns bigint"
)


def call(pos, tid, tool, args, idx=0, turn=1, total=1):
    return (1, pos, f"m{pos}", idx, "tool_use", None, None, None, tid, tool, json.dumps(args, separators=(",", ":")), None, None, None, None, turn, total)


def result(pos, tid, text, idx=0, images=0, turn=1, total=1):
    return (1, pos, f"m{pos}", idx, "tool_result", None, None, None, tid, None, None, text, text, images, False, turn, total)


def thought(pos, thinking, signature="", turn=1, total=1, idx=0):
    return (1, pos, f"m{pos}", idx, "thinking", None, thinking, signature, None, None, None, None, None, None, None, turn, total)


def table(spark, *blocks):
    return spark.createDataFrame(list(blocks), BLOCK)


def test_result_must_follow_within_four_rows(spark):
    b = table(spark, call(1, "a", "Read", {"file_path": "x"}), result(5, "a", "ok"), call(10, "b", "Read", {"file_path": "x"}), result(15, "b", "late"), call(20, "c", "Grep", {}), result(21, "c", "one"), result(22, "c", "two"))
    assert rows(cd.pair_calls(b), "tool_id", "result_pos") == [("a", 5), ("c", 21)]


def test_one_tool_id_everywhere_stays_small(spark):
    blocks = [x for i in range(0, 400, 2) for x in (call(i, "same", "Read", {"file_path": "x"}), result(i + 1, "same", "r"))]
    assert rows(cd.pair_calls(table(spark, *blocks)), "call_pos", "result_pos") == sorted([(i, i + 1) for i in range(0, 400, 2)], key=repr)


def reads(spark, *texts, path="/p/a.py", images=0):
    blocks = [x for i, t in enumerate(texts) for x in (call(2 * i + 1, f"t{i}", "Read", {"file_path": path}), result(2 * i + 2, f"t{i}", t, images=images))]
    return cd.pair_calls(table(spark, *blocks))


def test_identical_reads_keep_the_latest(spark):
    same, short = "a" * 1025, "a" * 1024
    assert rows(cd.condense_identical_reads(reads(spark, same, same)), "uuid") == [("m2",)]
    assert rows(cd.condense_identical_reads(reads(spark, short, short)), "uuid") == []
    assert rows(cd.condense_identical_reads(reads(spark, same, "b" * 2000, same)), "uuid") == [("m2",)]


def test_image_forms(spark):
    data_uri = "data:image/png;base64," + "B" * 5000
    assert cd.condense_images(reads(spark, data_uri, path="/tmp/x.txt")).count() == 1
    assert cd.condense_images(reads(spark, "QUJD" * 400, path="/tmp/x.png")).count() == 1
    assert cd.condense_images(reads(spark, "QUJD" * 400, path="/tmp/x.py")).count() == 0
    assert cd.condense_images(reads(spark, "not, base: 64! " * 100, path="/tmp/x.png")).count() == 0
    assert cd.condense_images(reads(spark, "QUJD" * 100, path="/tmp/x.png")).count() == 0
    shown = cd.condense_images(reads(spark, "", images=5000, path="/tmp/shot.jpg")).select("saved", "new_value").first()
    assert shown == (5000, "[image elided: ~5 KB base64, was Read of /tmp/shot.jpg]")


def test_stale_reads_need_the_same_window(spark):
    blocks = [call(1, "a", "Read", {"file_path": "x", "offset": 5}), result(2, "a", "z" * 500), call(3, "b", "Read", {"file_path": "x"}), result(4, "b", "z" * 500), call(5, "c", "Read", {"file_path": "x", "offset": 0}), result(6, "c", "y" * 9)]
    assert rows(cd.condense_stale_reads(cd.pair_calls(table(spark, *blocks))), "uuid") == [("m4",)]


def test_snapshot_key_is_the_argument_text(spark):
    tool = "mcp__worker__who_am_i"
    blocks = [call(1, "a", tool, {"a": 1, "b": 2}), result(2, "a", "z" * 500), call(3, "b", tool, {"b": 2, "a": 1}), result(4, "b", "z" * 500), call(5, "c", tool, {"a": 1, "b": 2}), result(6, "c", "z" * 500)]
    assert rows(cd.condense_snapshots(cd.pair_calls(table(spark, *blocks))), "uuid") == [("m2",)]


def test_thinking_styles_and_recent_turns(spark):
    b = table(spark, thought(1, "A" * 2000, turn=1, total=100), thought(2, "B" * 2000, turn=90, total=100), thought(3, "", "s" * 400, turn=2, total=100), thought(4, "C" * 399, turn=1, total=100), thought(5, "D" * 900, turn=3, total=100))
    scores = spark.createDataFrame([(1, 1, "Decided to refactor auth", None), (1, 2, "x", "failed")], "conv bigint, turn_id bigint, summary string, error string")
    dropped = spark.createDataFrame([(1, 3)], "conv bigint, turn_id bigint")
    got = rows(cd.condense_thinking(b, scores, dropped, style="verbose"), "uuid", "new_value")
    assert got[0] == ("m1", "[thinking elided ~2.0 KB; turn outcome: Decided to refactor auth]")
    assert got[1][0] == "m3" and "encrypted" in got[1][1] and len(got) == 2
    assert rows(cd.condense_thinking(b, scores, dropped), "new_value")[0] == ("[thinking elided]",)


def test_tool_args_keep_the_short_fields(spark):
    long = "d" * 400
    b = table(spark, call(1, "a", "TaskCreate", {"subject": "s", "description": long}, turn=1, total=10), call(2, "b", "TaskCreate", {"description": "short"}, turn=1, total=10), call(3, "c", "Edit", {"file_path": "/f", "old_string": long}, turn=1, total=10), call(4, "d", "TaskCreate", {"description": long}, turn=10, total=10))
    got = rows(cd.condense_tool_args(b), "uuid", "new_value", "saved")
    new = json.loads(got[0][1])
    assert [g[0] for g in got] == ["m1"] and new["subject"] == "s" and new["description"].startswith("d" * 100 + "... [300 more chars elided.")
    assert got[0][2] == 400 - len(got[0][1])
    clean = spark.createDataFrame([("/f",)], "path string")
    assert rows(cd.condense_tool_args(b, clean), "uuid") == [("m1",), ("m3",)]


def plan(spark, blocks, state=None, **kw):
    calls = cd.pair_calls(blocks)
    found = [cd.condense_reads(calls), cd.condense_snapshots(calls), cd.condense_thinking(blocks), cd.condense_refetch(calls), cd.condense_tool_args(blocks)]
    return cd.build_condense_plan(found, state, **kw)


def test_merged_read_modes_equal_the_single_ones(spark):
    texts = ["a" * 2000, "b" * 600, "QUJD" * 400, "a" * 2000]
    calls = reads(spark, *texts, path="/p/MEMORY.md")
    singles = cd.condense_identical_reads(calls)
    for f in (cd.condense_memory_reads, cd.condense_images, cd.condense_stale_reads):
        singles = singles.unionByName(f(calls))
    assert rows(cd.condense_reads(calls)) == rows(singles)


def test_two_blocks_of_one_entry_are_both_replaced(spark):
    old = "o" * 2000
    blocks = table(
        spark,
        call(1, "a", "Read", {"file_path": "/x"}, 0), call(1, "b", "Read", {"file_path": "/y"}, 1),
        result(2, "a", old, 0), result(2, "b", old, 1),
        call(3, "c", "Read", {"file_path": "/x"}, 0), call(3, "d", "Read", {"file_path": "/y"}, 1),
        result(4, "c", old, 0), result(4, "d", old, 1),
    )
    replace, stats, _ = plan(spark, blocks)
    assert rows(replace.filter("mode = 'identical-reads'"), "uuid", "block_idx") == [("m2", 0), ("m2", 1)]
    after = cd.apply_to_blocks(blocks, replace)
    assert after.filter("uuid = 'm2' AND result_text LIKE '[stale read elided%'").count() == 2


def test_condensing_again_changes_nothing(spark):
    blocks = table(spark, *[x for i in range(6) for x in (call(2 * i + 1, f"t{i}", "Read", {"file_path": "/p/MEMORY.md"}, turn=i + 1, total=6), result(2 * i + 2, f"t{i}", f"v{i}" * 500, turn=i + 1, total=6))])
    replace, _, records = plan(spark, blocks)
    assert replace.count() == 5
    state = records.withColumn("at", F.lit(1))
    assert plan(spark, blocks, state)[0].count() == 0
    # Markers are shorter than every bound, so even without the state they do not match again.
    assert plan(spark, cd.apply_to_blocks(blocks, replace))[0].count() == 0


def test_refetch_upgrade_only_without_a_model_summary(spark):
    blocks = table(spark, *[x for i in range(4) for x in (call(2 * i + 1, f"t{i}", "Grep", {"pattern": str(i)}, turn=i + 1, total=8), result(2 * i + 2, f"t{i}", "z" * 700, turn=i + 1, total=8))])
    records = plan(spark, blocks)[2]
    state = records.withColumn("summary_source", F.when(F.col("uuid") == "m2", "haiku").otherwise(F.col("summary_source")))
    assert plan(spark, blocks, state)[0].count() == 0
    assert rows(plan(spark, blocks, state, upgrade=True)[0], "uuid") == [("m4",), ("m6",), ("m8",)]


def test_raw_line_edit(spark):
    blocks = [
        {"type": "thinking", "thinking": "T" * 500, "signature": "s"},
        "bare",
        {"type": "tool_result", "tool_use_id": "a", "content": "x" * 700, "keep": {"b": 1, "a": 2}},
        {"type": "tool_use", "id": "q", "name": "TaskCreate", "input": {"subject": "s", "description": "d"}},
    ]
    raw = json.dumps({"uuid": "m1", "odd": [1, {"z": 1}], "message": {"role": "user", "content": blocks, "model": "m"}})
    msgs = spark.createDataFrame([(1, "m1", raw), (1, "m2", raw)], "conv bigint, uuid string, raw string")
    change = spark.createDataFrame(
        [(1, "m1", 0, "thinking", "[thinking elided]"), (1, "m1", 2, "images", "[img]"), (1, "m1", 3, "tool-args", '{"subject":"s","description":"e"}')],
        "conv bigint, uuid string, block_idx int, mode string, new_value string",
    )
    got = json.loads(cd.apply_to_raw(msgs, change).filter("uuid = 'm1'").first()["raw"])
    content = got["message"]["content"]
    assert content[0] == {"type": "text", "text": "[thinking elided]"} and content[1] == "bare"
    assert content[2] == {"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": "[img]"}], "keep": {"b": 1, "a": 2}}
    assert content[3]["input"] == {"subject": "s", "description": "e"}
    assert got["odd"] == [1, {"z": 1}] and got["message"]["model"] == "m" and got["_condensed"] is True
    assert got["_condenseSource"] == "images+thinking+tool-args"
    assert cd.apply_to_raw(msgs, change).count() == 1


def test_raw_reads_back_as_condensed(spark, tmp_path):
    line = json.dumps({"uuid": "m1", "parentUuid": None, "type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": "x" * 700}]}})
    msgs = spark.createDataFrame([("1", "m1", line)], "conv string, uuid string, raw string")
    change = spark.createDataFrame([("1", "m1", 0, "stale-reads", 'say "hi"')], "conv string, uuid string, block_idx int, mode string, new_value string")
    new = cd.apply_to_raw(msgs, change).withColumn("line", F.lit(0).cast("bigint"))
    assert rows(tr.explode_blocks(tr.normalise(new.select("conv", "line", "raw"))), "result_text") == [('say "hi"',)]


def test_condensed_blocks_derives_the_blocks_once(spark, tmp_path, monkeypatch):
    from chainloom.plans import condense_queries as cq

    made, given = [], table(spark, call(1, "t1", "Read", {"file_path": "/p/a.py"}), result(2, "t1", "x" * 700))
    monkeypatch.setattr(cq, "call_blocks", lambda spark, sf: made.append(sf) or given)
    monkeypatch.setattr(cq, "sql", lambda spark, sf, text: spark.createDataFrame([], "conv bigint, uuid string, block_idx int, summary_source string"))
    assert cq.condensed_blocks(spark, str(tmp_path)).count() == 2 and len(made) == 1
