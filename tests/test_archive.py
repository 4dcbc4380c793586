from conftest import rows
from pyspark.sql import functions as F

from chainloom.operators import archive as ar
from chainloom.operators import chain as ch
from chainloom.operators.storage import materialise

ROWS = "conv bigint, line bigint, pos bigint, uuid string, parent_uuid string, type string, role string, ts bigint, text string, shape string"
ENTRY = "conv bigint, uuid string, pos bigint, action string, distillation string, reason string"


def chain(spark, types, conv=1):
    data = [(conv, i, i + 1, f"{conv}u{i}", f"{conv}u{i - 1}" if i else None, t, t, i, f"text {i}", "string") for i, t in enumerate(types)]
    return spark.createDataFrame(data, ROWS)


def entries(spark, *plan, conv=1):
    return spark.createDataFrame([(conv, f"{conv}u{i}", i + 1, a, d, "r") for i, a, d in plan], ENTRY)


def test_cascade_reparent_and_chain_length(spark):
    m = chain(spark, ["user", "assistant", "user", "assistant", "user"])
    e = entries(spark, (1, "drop", None), (2, "drop", None), (3, "drop", None))
    assert rows(ar.reparent(m, e), "uuid", "new_parent") == [("1u4", "1u0")]
    out, report = ar.apply_plan(m, m, e)
    assert out.count() == 5 and ch.walk_chain(out).count() == 2
    gone, _ = ar.apply_plan(m, m, e, orphan=False)
    assert rows(gone, "uuid", "parent_uuid") == [("1u0", None), ("1u4", "1u0")]
    assert report.select("verdict", "dropped", "distilled", "reparented", "requires_resume").first() == ("applied", 3, 0, 1, False)


def test_a_broken_rule_stops_only_its_conversation(spark):
    m = chain(spark, ["user", "assistant", "user"]).unionByName(chain(spark, ["user", "user", "assistant"], 2))
    e = entries(spark, (0, "drop", None)).unionByName(entries(spark, (0, "drop", None), (2, "distill", "short"), conv=2))
    out, report = ar.apply_plan(m, m, e)
    assert rows(report, "conv", "verdict") == [(1, "bad_root"), (2, "applied")]
    assert rows(out.filter("conv = 1"), "uuid", "parent_uuid") == rows(m.filter("conv = 1"), "uuid", "parent_uuid")
    assert rows(out.filter("conv = 2"), "uuid", "parent_uuid", "text", "shape") == [("2u0", None, "text 0", "string"), ("2u1", None, "text 1", "string"), ("2u2", "2u1", "short", "array")]
    blocks = spark.createDataFrame([(2, "2u2", 0, "tool_use")], "conv bigint, uuid string, block_idx int, type string")
    assert rows(ar.apply_plan(m, m, e, blocks)[1], "conv", "verdict") == [(1, "bad_root"), (2, "distills_tool_use")]


def test_applied_plan_can_be_applied_again(spark):
    m = chain(spark, ["user", "assistant", "user", "assistant"])
    e = entries(spark, (1, "drop", None), (2, "distill", "d"))
    out = materialise(ar.apply_plan(m, m, e, orphan=False)[0], "applied")
    again = ch.chain_messages(out, ch.walk_chain(out))
    assert rows(ar.apply_plan(out, again, e.filter("action = 'distill'"), orphan=False)[0], "uuid", "parent_uuid", "text") == rows(out, "uuid", "parent_uuid", "text")


def test_force_keep_names_the_old_action(spark):
    d = spark.createDataFrame([(1, t, a, None, "r") for t, a in ((1, "drop"), (2, "distill"), (3, "keep"), (4, "drop"))], "conv bigint, turn_id bigint, action string, distillation string, reason string")
    turns = spark.createDataFrame([(1, t) for t in range(1, 5)], "conv bigint, turn_id bigint")
    got = rows(ar.force_keep_recent(d, turns, 3), "turn_id", "action", "reason")
    assert got == [(1, "drop", "r"), (2, "keep", "[force-kept by force_keep_recent_n=3; was distill]"), (3, "keep", "r"), (4, "keep", "[force-kept by force_keep_recent_n=3; was drop]")]
    assert rows(ar.force_keep_recent(d, turns, 0)) == rows(d)


def test_checksum_sees_every_change(spark):
    plans = spark.createDataFrame([("p", 1, 10, 2, "u")], "plan_id string, conv bigint, bytes bigint, chain_length bigint, last_uuid string")
    e = spark.createDataFrame([("p", i, f"u{i}", "drop", None, "r") for i in range(9000)], "plan_id string, ord bigint, uuid string, action string, distillation string, reason string")
    base = ar.plan_checksum(plans, e).first()["checksum"]
    assert ar.plan_checksum(plans, e.repartition(7)).first()["checksum"] == base
    assert ar.plan_checksum(plans, e.withColumn("reason", F.expr("CASE WHEN ord = 8000 THEN 'x' ELSE reason END"))).first()["checksum"] != base
    assert ar.plan_checksum(plans.withColumn("bytes", F.lit(11).cast("bigint")), e).first()["checksum"] != base


def test_price_tiers(spark):
    usage = spark.createDataFrame([("big", 200_000, 0), ("big", 200_001, 1_000_000), ("none", 5, 5)], "model string, tokens_in bigint, tokens_out bigint")
    got = rows(ar.usage_cost(usage, {"big": [(0, 3.0, 15.0), (200_000, 6.0, 22.5)]}), "usd")
    assert [round(g[0], 6) if g[0] is not None else None for g in got] == [0.6, 23.700006, None]


def test_canonical_checksum_over_many_batches(spark):
    """A plan spread over many Arrow batches hashes to the digest of its whole text."""
    import json
    from hashlib import sha256

    listed = [(p, i, "keep" if i % 3 else "distill", None if i % 3 else f'sho"rt {i}', "r", f"u{p}-{i}") for p, n in (("a", 57), ("b", 1), ("d", 4)) for i in range(n)]
    e = spark.createDataFrame(listed, "plan_id string, ord bigint, action string, distillation string, reason string, uuid string").repartition(5)
    plans = spark.createDataFrame([(p, 10, 3, "/t/x", "u1") for p in "abc"], "plan_id string, bytes bigint, chain_length bigint, path string, last_uuid string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = dict(rows(ar.canonical_checksum(plans, e), "plan_id", "checksum"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in "abc":
        entries_ = [{k: v for k, v in (("action", a), ("distillation", d), ("reason", r), ("uuid", u)) if v is not None} for q, _, a, d, r, u in listed if q == p]
        plan = {"entries": entries_, "jsonlBytes": 10, "jsonlMessages": 3, "jsonlPath": "/t/x", "lastMessageUuid": "u1", "planId": p}
        assert got[p] == sha256(json.dumps(plan, separators=(",", ":")).encode()).hexdigest()
    assert set(got) == set("abc")
