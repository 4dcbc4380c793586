import pytest
import random

from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.scan import attach, neighbours, scan, take_first


def data(spark, seed=7, n=400):
    rnd = random.Random(seed)
    out, used = [], {}
    for _ in range(n):
        k = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(30)}"
        used[k] = used.get(k, 0) + rnd.choice([1, 1, 1, 9])
        out.append((k, used[k], rnd.randrange(10), rnd.choice([None, f"v{rnd.randrange(5)}"])))
    rnd.shuffle(out)
    return spark.createDataFrame(out, "k string, o bigint, x bigint, v string")


def test_scan_equals_plain_windows(spark):
    df = data(spark)
    w = W.partitionBy("k").orderBy("o")
    whole = W.partitionBy("k")
    expected = df.withColumns(
        {
            "s": F.sum("x").over(w),
            "l": F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "p": F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)),
            "n": F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)),
            "a": F.first("v", True).over(w.rowsBetween(1, W.unboundedFollowing)),
            "t": F.max("x").over(whole),
        }
    )
    for chunk in (1, 3, 17, None):
        got = scan(
            df, ["k"], "o", sums={"s": F.col("x")}, lasts={"l": F.col("v")}, prevs={"p": F.col("v")},
            nexts={"n": F.col("v")}, afters={"a": F.col("v")}, totals={"t": ("max", F.col("x"))}, chunk=chunk,
        )
        assert rows(got, *expected.columns) == rows(expected)


def test_hot_key_is_spread_over_chunks(spark):
    df = spark.range(1000).select(F.concat(F.lit("hot"), F.col("id") % 1).alias("k"), F.col("id").alias("o"), F.lit(1).alias("x"))
    plan = scan(df, ["k"], "o", sums={"s": F.col("x")}, chunk=50)._jdf.queryExecution().toString()
    assert "hashpartitioning(k#" in plan and ", __chunk#" in plan.split("hashpartitioning(k#")[1][:40]
    assert rows(scan(df, ["k"], "o", sums={"s": F.col("x")}, chunk=50).filter("o = 999"), "s") == [(1000,)]


def test_attach_joins_every_row_once(spark):
    df = data(spark)
    small = spark.createDataFrame([("hot", "H"), ("k1", "A"), ("none", "N")], "k string, tag string")
    expected = rows(df.join(small, "k"), "k", "o", "tag")
    assert rows(attach(df, small, ["k"], "o", chunk=5), "k", "o", "tag") == expected
    top = df.groupBy("k").agg(F.max("o").alias("top")).join(small, "k")
    assert rows(attach(df, top, ["k"], "o", span="top", chunk=5), "k", "o", "tag") == expected
    left = attach(df, small, ["k"], "o", how="left", chunk=5)
    assert left.count() == df.count() and left.filter("tag = 'H'").count() == df.filter("k = 'hot'").count()


def test_take_first_limits_before_the_shuffle(spark):
    df = data(spark)
    kept = take_first(df, ["k"], [F.desc("o")], 2)
    assert kept.groupBy("k").count().filter("count > 2").count() == 0
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("chunk", [8, 64])
def test_interval_join_equals_brute_force_and_stays_small(spark, chunk):
    from chainloom.operators.scan import interval_candidates, interval_join

    rng = random.Random(6)
    rows_ = [(k, i) for k, n in ((1, 300), (2, 40), (3, 5)) for i in range(n)]
    spans = [(q, rng.choice([1, 1, 2, 3, 4]), low, low + rng.choice([-1, 0, 1, 2, 5, 17, 64, 250])) for q in range(120) for low in [rng.randrange(300)]]
    df = spark.createDataFrame(rows_, "k bigint, at bigint")
    wanted = spark.createDataFrame(spans, "q bigint, k bigint, low bigint, high bigint")
    got = sorted((r.q, r.k, r["at"]) for r in interval_join(df, wanted, ["k"], "at", "low", "high", chunk=chunk).collect())
    assert got == sorted((q, k, i) for q, key, low, high in spans for k, i in rows_ if k == key and low <= i <= high)
    whole = sum(max(0, high - low + 1) for _, _, low, high in spans)
    assert interval_candidates(df, wanted, ["k"], "at", "low", "high", chunk=chunk).count() <= 4 * whole


@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_neighbours_reach_over_chunks(spark, chunk):
    from chainloom.operators.scan import neighbours

    rng = random.Random(2)
    places = {k: sorted(rng.sample(range(200), n)) for k, n in (("a", 60), ("b", 7), ("c", 1))}
    df = spark.createDataFrame([(k, p) for k, ps in places.items() for p in ps], "k string, at bigint")
    for r in neighbours(df, ["k"], "at", F.col("at"), back=3, ahead=2, chunk=chunk).collect():
        ps = places[r.k]
        i = ps.index(r["at"])
        assert r.back == ps[max(0, i - 3) : i][::-1] and r.ahead == ps[i + 1 : i + 3]


def test_keys_of_one_chunk_need_one_shuffle_and_no_join(spark):
    rng = random.Random(12)
    made = [(k, at * 3, rng.choice([None, 1, 2, 5])) for k in "abc" for at in range(40)] + [(None, 1, 1)]
    df = spark.createDataFrame(made, "k string, at long, v long")
    v = F.col("v")

    def both(whole):
        out = neighbours(df, ["k"], "at", F.coalesce(v, F.lit(0)), back=2, ahead=3, chunk=1000, whole=whole)
        lists = {n: F.array_compact(n) for n in ("back", "ahead")}
        out = scan(out.withColumns(lists), ["k"], "at", sums={"s": v}, lasts={"l": v}, prevs={"p": v}, totals={"t": ("max", v)}, chunk=1000, whole=whole)
        return scan(out, ["k"], "at", nexts={"n": v}, afters={"a": v}, chunk=1000, whole=whole)

    assert rows(both(True)) == rows(both(False)) and both(True).count() == 120
    plan = both(True)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    assert both(True)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
