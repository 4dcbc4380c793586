import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainloom.operators import chain as ch
from chainloom.operators import prune as pr
from chainloom.operators import turns as tn
from chainloom.operators.storage import materialise

TURN = "conv bigint, pos bigint, uuid string, type string, ts bigint, opens_turn boolean"
MSG = "conv bigint, line bigint, uuid string, parent_uuid string, type string, ts bigint, text string"


def linear(spark, types, texts=None):
    data = [(1, i, f"u{i}", f"u{i - 1}" if i else None, t, i, (texts or {}).get(i, f"text {i}")) for i, t in enumerate(types)]
    return spark.createDataFrame(data, MSG)


def chain_rows(m):
    return ch.chain_messages(m, ch.walk_chain(m))


def test_turns_group_tool_results_with_their_prompt(spark):
    data = [(1, 1, "u1", "user", 0, True), (1, 2, "a1", "assistant", 1, False), (1, 3, "r1", "user", 2, False), (1, 4, "a2", "assistant", 3, False), (1, 5, "u2", "user", 4, True), (1, 6, "a3", "assistant", 5, False)]
    turns = tn.turn_rollup(tn.segment_turns(spark.createDataFrame(data, TURN)))
    assert rows(turns, "turn_id", "n_entries", "first_uuid", "last_uuid", "has_real_user_input") == [(1, 4, "u1", "a2", True), (2, 2, "u2", "a3", True)]


def test_first_row_opens_turn_one_and_empty_chain_gives_none(spark):
    df = spark.createDataFrame([(1, 1, "a1", "assistant", 0, False), (1, 2, "u1", "user", 1, True)], TURN)
    assert rows(tn.turn_rollup(tn.segment_turns(df)), "turn_id", "has_real_user_input") == [(1, False), (2, True)]
    assert tn.segment_turns(df.filter("conv = 0")).count() == 0


def prefilter(spark, chars, calls):
    data = [(1, 1, c, n) for c, n in zip(chars, calls)]
    return tn.prefilter_turns(spark.createDataFrame(data, "conv bigint, turn_id bigint, plain_chars bigint, n_tool_use bigint"))


@pytest.mark.parametrize(
    "chars, calls, signal",
    [
        ([5000], [0], "pf-micro-single-entry"),
        ([100, 599], [0, 0], "pf-micro-no-tool-use-short"),
        ([100, 600], [0, 0], None),
        ([1, 1], [0, 1], None),
        ([1] * 5, [0] * 5, "pf-micro-no-tool-use-short"),
        ([1] * 6, [0] * 6, None),
    ],
)
def test_prefilter_borders(spark, chars, calls, signal):
    got = rows(prefilter(spark, chars, calls), "duplicate_signal")
    assert got == ([(signal,)] if signal else [])


def test_sandwich_relinks_and_rewalks(spark):
    m = linear(spark, ["user", "assistant"] * 10)
    rows_in = chain_rows(m)
    out, backup, report = pr.sandwich_prune(m, rows_in, 2, 5)
    assert rows(backup.orderBy("pos"), "uuid") == sorted([(f"u{i}",) for i in range(2, 16)], key=repr)
    assert report.select("verdict", "middle_count", "new_chain_length").first() == ("pruned", 14, 7)
    walked = ch.walk_chain(out).orderBy("pos").select("uuid").collect()
    bridge = out.filter("type = 'system'").first()
    assert [r[0] for r in walked] == ["u0", "u1", bridge["uuid"], "u16", "u17", "u18", "u19"]
    out = materialise(out, "pruned")
    again, _, second = pr.sandwich_prune(out, chain_rows(out), 2, 5)
    assert second.first()["verdict"] == "too_short" and rows(again) == rows(out)


def test_sandwich_without_bridge_or_removal(spark):
    m = linear(spark, ["user", "assistant"] * 6)
    out, _, report = pr.sandwich_prune(m, chain_rows(m), 1, 4, bridge=False, remove_middle=False)
    assert out.count() == 12 and report.first()["new_chain_length"] == 5
    assert ch.walk_chain(out).count() == 5
    none = linear(spark, ["user"] + ["assistant"] * 9)
    assert pr.sandwich_prune(none, chain_rows(none), 1, 3)[2].first()["verdict"] == "no_valid_root"
    with pytest.raises(ValueError):
        pr.sandwich_prune(m, chain_rows(m), 0, 3)


def test_percent_cut_clamps_and_refuses_without_root(spark):
    m = linear(spark, ["user", "assistant", "user"])
    out, report = pr.prune_oldest_percent(m, chain_rows(m), 1)
    assert report.select("orphaned_before", "root_pos", "orphaned_after").first() == (1, 3, 2)
    assert ch.walk_chain(out).count() == 1
    stuck = linear(spark, ["user", "assistant", "assistant"])
    out, report = pr.prune_oldest_percent(stuck, chain_rows(stuck), 50)
    assert report.first()["verdict"] == "no_valid_root" and rows(out) == rows(stuck)


def test_handoff_cluster_reaches_back_over_close_markers(spark):
    mark = "## SESSION HANDOFF\nrest"
    m = linear(spark, ["user", "assistant"] * 15, {3: mark, 21: mark, 27: mark, 28: mark})
    out, report = pr.prune_to_handoff(m, chain_rows(m))
    got = report.select("newest_pos", "oldest_pos", "markers", "anchor_pos", "snippet").first()
    assert tuple(got) == (28, 22, 2, 21, mark)
    assert ch.walk_chain(out).count() == 10
    single = pr.prune_to_handoff(m, chain_rows(m), merge=False)[1].first()
    assert single["oldest_pos"] == 28 and single["markers"] == 1


def test_actions_take_the_first_result_line(spark):
    msgs = spark.createDataFrame(
        [(1, 0, "p", "user", True, "do it"), (1, 1, "a", "assistant", False, ""), (1, 2, "r", "user", False, ""), (1, 3, "b", "assistant", False, "")],
        "conv bigint, line bigint, uuid string, role string, real_user boolean, text string",
    )
    blocks = spark.createDataFrame(
        [
            (1, 1, 0, "tool_use", "Bash", '{"command":"ls\\nx","description":"list"}', None, None, False),
            (1, 1, 1, "text", None, None, "thinking aloud", None, False),
            (1, 2, 0, "tool_result", None, None, None, " \n", True),
            (1, 2, 1, "tool_result", None, None, None, "\nfound", False),
            (1, 2, 2, "tool_result", None, None, None, "later", True),
            (1, 3, 0, "text", None, None, "x" * 900, None, False),
        ],
        "conv bigint, line bigint, block_idx int, type string, tool string, args string, text string, result_text string, is_error boolean",
    )
    actions, turns = tn.turn_actions(msgs, blocks)
    assert rows(actions, "action_id", "summary", "result_summary", "result_error") == [
        (1, "ls # list", None, False), (2, "thinking aloud", "found", True), (3, "x" * 200 + "…", None, False),
    ]
    assert turns.select("user_prompt", "n_actions", "final_text").first() == ("do it", 3, "x" * 800 + "…")


def test_restore_needs_a_following_row(spark):
    m = linear(spark, ["user", "assistant", "system", "user"], {3: "This session is being continued from x"}).withColumns(
        {
            "parent_uuid": F.expr("CASE WHEN line = 2 THEN NULL ELSE parent_uuid END"),
            "is_boundary": F.expr("line = 2"),
            "is_summary": F.lit(False),
            "logical_parent_uuid": F.expr("CASE WHEN line = 2 THEN 'u1' END"),
        }
    )
    assert pr.restore_compaction(m, chain_rows(m))[1].first()["verdict"] == "nothing_after"
    more = m.unionByName(m.filter("line = 3").withColumns({"line": F.lit(4).cast("bigint"), "uuid": F.lit("u4"), "parent_uuid": F.lit("u3"), "ts": F.lit(4).cast("bigint"), "text": F.lit("go on")}))
    out, report = pr.restore_compaction(more, chain_rows(more))
    assert report.select("verdict", "restored").first() == ("restored", 2)
    assert [r[0] for r in ch.walk_chain(out).orderBy("pos").select("uuid").collect()] == ["u0", "u1", "u4"]
