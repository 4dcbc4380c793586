import random

from conftest import rows
from pyspark.sql import functions as F

from chainloom.operators import chain as ch

SCHEMA = "conv bigint, line bigint, uuid string, parent_uuid string, type string, ts bigint, bad_ts boolean"


def sequential_leaf(entries):
    used = {e[3] for e in entries if e[3]}
    ends = [e for e in entries if e[2] and e[2] not in used]
    if not ends:
        return None
    best = ends[0]
    if best[6]:
        return best[2]
    for e in ends[1:]:
        if not e[6] and (e[5] or 0) > (best[5] or 0):
            best = e
    return best[2]


def sequential_walk(entries, start=None):
    by = {e[2]: e for e in entries if e[2]}
    at, seen, path = by.get(start or sequential_leaf(entries)), set(), []
    while at and at[2] not in seen:
        seen.add(at[2])
        path.append(at)
        at = by.get(at[3]) if at[3] else None
    path.reverse()
    return [(e[0], i + 1, e[2], e[1]) for i, e in enumerate(path)]


def forest(seed, convs=40, cyclic=False):
    rnd = random.Random(seed)
    out = []
    for c in range(convs):
        n = rnd.randrange(1, 40)
        entries = []
        for i in range(n):
            kind = rnd.random()
            parent = None
            if i and kind < 0.75:
                parent = f"{c}-{i - 1}"
            elif i and kind < 0.93:
                parent = f"{c}-{rnd.randrange(i)}"
            elif kind < 0.96:
                parent = "missing"
            if cyclic and rnd.random() < 0.08:
                parent = f"{c}-{rnd.randrange(n)}"
            uid = f"{c}-{rnd.randrange(i)}" if i and rnd.random() < 0.03 else f"{c}-{i}"
            ts = rnd.choice([None, rnd.randrange(20), i, i])
            entries.append((c, i, uid if rnd.random() > 0.02 else None, parent, rnd.choice(["user", "assistant"]), ts, ts is None and rnd.random() < 0.1))
        out.append(entries)
    return out


def check(spark, trees, chunk):
    df = spark.createDataFrame([e for t in trees for e in t], SCHEMA)
    leaf = [(t[0][0], sequential_leaf(t)) for t in trees if sequential_leaf(t)]
    assert rows(ch.active_leaf(df), "conv", "uuid") == sorted(leaf, key=repr)
    expected = [r for t in trees for r in sequential_walk(t)]
    assert rows(ch.walk_chain(df, chunk=chunk), "conv", "pos", "uuid", "line") == sorted(expected, key=repr)


def test_random_trees_equal_a_sequential_walk(spark):
    check(spark, forest(1), 4)
    check(spark, forest(2), None)


def test_cycles_and_chunk_borders(spark):
    check(spark, forest(3, cyclic=True), 3)
    loop = [[(0, 0, "a", "c", "user", 1, False), (0, 1, "b", "a", "user", 2, False), (0, 2, "c", "b", "user", 3, False)]]
    assert ch.walk_chain(spark.createDataFrame(loop[0], SCHEMA)).count() == 0
    tail = loop[0] + [(0, 3, "d", "b", "user", 9, False)]
    check(spark, [tail], 2)


def test_walk_from_a_given_row(spark):
    trees = forest(5)
    df = spark.createDataFrame([e for t in trees for e in t], SCHEMA)
    starts = [(t[0][0], t[len(t) // 2][2]) for t in trees if t[len(t) // 2][2]]
    got = ch.walk_chain(df, spark.createDataFrame(starts, "conv bigint, uuid string"), chunk=4)
    expected = [r for t, (c, s) in zip([t for t in trees if t[len(t) // 2][2]], starts) for r in sequential_walk(t, s)]
    assert rows(got, "conv", "pos", "uuid", "line") == sorted(expected, key=repr)


def test_deep_interleaved_chains(spark):
    """Two chains woven line by line: every row breaks a run, so the doubling does all the work."""
    n = 600
    entries = [(1, i, f"m{i}", f"m{i - 2}" if i > 1 else None, "user", i, False) for i in range(n)]
    got = rows(ch.walk_chain(spark.createDataFrame(entries, SCHEMA)), "pos", "line")
    assert got == sorted([(i + 1, 2 * i + 1) for i in range(n // 2)], key=repr)


def test_star_parent_and_orphans(spark):
    entries = [(1, 0, "root", None, "user", 0, False)] + [(1, i, f"c{i}", "root", "assistant", i, False) for i in range(1, 300)]
    df = spark.createDataFrame(entries, SCHEMA)
    chain = ch.walk_chain(df, chunk=16)
    assert rows(chain, "pos", "uuid") == [(1, "root"), (2, "c299")]
    assert ch.orphans(df, chain).count() == 298


def test_next_valid_root_walks_forward(spark):
    rows_in = [(1, p, f"u{p}", t) for p, t in enumerate(["user", "assistant", "assistant", "system", "assistant"], 1)]
    chain = spark.createDataFrame(rows_in, "conv bigint, pos bigint, uuid string, type string")
    cuts = spark.createDataFrame([(1, 2)], "conv bigint, cut bigint")
    assert rows(ch.next_valid_root(chain, cuts)) == [(1, 4, "u4", "system")]
    late = spark.createDataFrame([(1, 5)], "conv bigint, cut bigint")
    assert ch.next_valid_root(chain, late).filter(F.col("root_pos").isNotNull()).count() == 0
