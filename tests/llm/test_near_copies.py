import random

import numpy as np
from support import awkward, documents

from chainloom.llm import omh


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_table():
    rng, pairs = random.Random(4), []
    for _ in range(120):
        a = [rng.randrange(2, 60) for _ in range(rng.randrange(0, 90))]
        b = list(a)
        for _ in range(rng.randrange(0, 20)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(2, 60)] * rng.randrange(2)
        pairs.append((a, b))
    arrays = [(np.array(a, np.uint64) * np.uint64(2), np.array(b, np.uint64) * np.uint64(2)) for a, b in pairs]
    for (a, b), got in zip(pairs, omh.similarities(arrays), strict=True):
        longest, d = max(len(a), len(b)), edits(a, b)
        want = 1 - d / longest if longest and d <= int(longest * 0.2 + 1e-9) else 0.0
        assert abs(got - want) < 1e-9


def test_sketch_keeps_text_order():
    rng = random.Random(1)
    words = [rng.randrange(1, 10**12) for _ in range(200)]
    forward = omh.sketch(np.array(words, np.uint64))[0]
    swapped = omh.sketch(np.array(words[100:] + words[:100], np.uint64))[0]
    assert (forward == omh.sketch(np.array(words, np.uint64))[0]).all()
    assert (forward != swapped).sum() > omh.SKETCHES // 2  # the same k-mers, for the most part, in another order


def test_a_repeated_kmer_changes_no_other_kmer():
    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(2**40 + 2)
    repeated = np.concatenate((words, words[:7]))
    plain, more = omh.labelled_kmers(words), omh.labelled_kmers(repeated)
    assert set(plain.tolist()) <= set(more.tolist()) and len(set(more.tolist())) == len(more)


def corpus(seed=2, copies=40):
    rng, rows, group = random.Random(seed), [], {}
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(70)]

    def add(words, g):
        group[len(rows)] = g
        rows.append((len(rows), " ".join(words), "s"))

    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        add(base, g)
        for _ in range(copies if g == 0 else 2):  # one large group of near copies, all different
            near = list(base)
            for _ in range(max(1, len(near) // 100)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            add(near, g)
        add(base, g)
    for g in range(100, 160):  # texts that share a passage and nothing else
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 200))]
        add(own[:40] + passage + own[40:], g)
    return rows, group


def test_classes_are_the_planted_groups(spark):
    rows, group = corpus()
    got = {r.doc_id: r.class_id for r in omh.near_classes(documents(spark, rows)).collect()}
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    assert got == {i: first[g] for i, g in group.items()}
    kept = omh.keep_one(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_a_large_bucket_of_two_groups_is_resolved(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 2)
    rows, group = corpus(seed=9, copies=10)
    got = {r.doc_id: r.class_id for r in omh.near_classes(documents(spark, rows)).collect()}
    for i in got:
        for j in got:
            assert (got[i] == got[j]) == (group[i] == group[j])


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    rows = omh.near_classes(docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r.class_id for r in rows}
    assert by[2] == by[3] == 2 and by[4] == 4 and by[7] == 7 and by[None] is None
    kept = omh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "7", "8", "None"]
    assert omh.near_classes(docs.limit(0)).count() == 0 and omh.keep_one(docs.limit(0)).count() == 0


def test_copies_that_meet_only_among_texts_quoting_their_passage(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 2)
    monkeypatch.setattr(omh, "CELL", 16)
    rng = random.Random(11)

    def fresh(n):
        return [f"v{rng.randrange(10**9)}" for _ in range(n)]

    passage, texts = fresh(80), []
    for _ in range(6):
        texts.append(" ".join(passage + fresh(18)))  # 80 of 98 words in common
    for n in range(120):
        own = fresh(40 + n)
        texts.append(" ".join(own[:20] + passage + own[20:]))
    got = {r.doc_id: r.class_id for r in omh.near_classes(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(6)] == [0] * 6 and all(got[i] == i for i in range(6, len(texts)))


def test_spread_edits_are_linked(spark):
    rng = random.Random(12)
    rows, pairs = [], 12
    for _ in range(pairs):
        words = [f"v{rng.randrange(10**9)}" for _ in range(300)]
        near = list(words)
        for at in rng.sample(range(300), 36):  # an edit similarity of 0.88
            near[at] = f"v{rng.randrange(10**9)}"
        rows += [(len(rows), " ".join(words), "s"), (len(rows) + 1, " ".join(near), "s")]
    got = {r.doc_id: r.class_id for r in omh.near_classes(documents(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in got}


def test_common_words_are_counted_with_repeats():
    rng = random.Random(15)
    for _ in range(100):
        a, b = ([rng.randrange(1, 30) * 2 for _ in range(rng.randrange(40))] for _ in range(2))
        want = sum(min(a.count(w), b.count(w)) for w in set(a))
        assert omh._common(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_groups_whose_members_differ_from_each_other(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 4)
    monkeypatch.setattr(omh, "CELL", 16)
    rng, texts = random.Random(16), []
    for _ in range(2):
        base = [f"v{rng.randrange(10**9)}" for _ in range(120)]
        for _ in range(30):
            near = list(base)
            for at in rng.sample(range(120), 9 + rng.randrange(12)):
                near[at] = f"v{rng.randrange(10**9)}"
            texts.append(near)
    words = [np.array([int(w[1:]) * 2 + 2 for w in t], np.uint64) for t in texts]
    keys = [set(omh.sketch(omh.word_hashes(" ".join(t)))[0].tolist()) for t in texts]
    want = list(range(len(texts)))  # classes by every pair that shares a key
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and omh.similarities([(words[i], words[j])])[0] >= omh.SIMILARITY:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in omh.near_classes(documents(spark, rows)).collect()}
    assert got == dict(enumerate(want))


def test_word_bits_drop_no_similar_pair():
    rng, drawn = random.Random(13), random.Random(14)
    for _ in range(200):
        a = [rng.randrange(2, 400) for _ in range(rng.randrange(20, 200))]
        b = list(a)
        del b[: drawn.randrange(6)]
        for _ in range(len(a) // 5):
            b[drawn.randrange(len(b))] = drawn.randrange(2, 400)
        longest = np.array([max(len(a), len(b))])
        x, y = omh._folded([omh.word_bits(np.array(t, np.uint64) * np.uint64(2**40 + 2)) for t in (a, b)])
        if 1 - edits(a, b) / longest[0] >= omh.SIMILARITY:
            assert omh._apart_by_bits(x, y) <= omh._most_apart(np.int64(len(a)), np.int64(len(b)))


def test_a_text_too_short_for_a_band_leaves_it(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 2)
    lengths = [100, 101, 115, 127, 128, 129, 130]
    nodes = spark.createDataFrame([(i, n, [7]) for i, n in enumerate(lengths)], "node long, words int, keys array<long>")
    hits = omh._hits(nodes.selectExpr("node", "words", "explode(keys) AS key"))
    labels = spark.createDataFrame([], "node long, label long")
    banded = omh._banded_buckets(hits, labels, 100).collect()
    got = {(r.node, r.band) for r in banded}
    met = {(a.node, b.node) for a in banded for b in banded if a.band == b.band}
    for i, x in enumerate(lengths):
        for j, y in enumerate(lengths):
            assert min(x, y) < max(x, y) * omh.SIMILARITY or (i, j) in met  # every pair that can be similar still meets
    low = {b: min(lengths[r.node] for r in banded if r.band == b and r.own == b) for _, b in got}
    assert all(lengths[n] >= low[b] * omh.SIMILARITY for n, b in got)


def test_buckets_of_a_passage_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 4)
    rng, texts, passages = random.Random(21), 90, 2
    kept = {n: sorted(k + 100 * (n % passages) for k in range(20) if rng.random() < 0.8) for n in range(texts)}  # keys of its passage
    kept[0] = sorted({*kept[0], 101})  # one text quotes both
    words = {n: 100 + n // 4 for n in kept}
    # all bits alike: each pair of one length step that shares a key has to come out, and no other
    nodes = spark.createDataFrame([(n, words[n], kept[n], bytes(64)) for n in kept], "node long, words int, keys array<long>, bits binary")
    hits = omh._hits(nodes.selectExpr("node", "words", "explode(keys) AS key"))
    labels = spark.createDataFrame([], "node long, label long")
    banded = omh._banded_buckets(hits, labels, 1000)
    assert banded.count() <= 2 * 2 * texts  # once in its passage's group, seldom in another, for two bands; not in each of some 16 buckets
    want = {(a, b) for a in kept for b in kept if a < b and set(kept[a]) & set(kept[b]) and min(words[a], words[b]) >= max(words[a], words[b]) * 0.8}
    for cell in (1000, 16):
        monkeypatch.setattr(omh, "CELL", cell)
        got = [(r.a, r.b) for r in omh._large_pairs(hits, nodes, labels).collect()]
        assert set(got) == want
    near = [omh._nearest_pairs(hits, nodes, labels, turn).collect() for turn in range(omh.TURN_KEYS)]
    assert all(near) and {(r.a, r.b) for rows in near for r in rows} <= want


def test_buckets_that_share_few_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 4)
    # a bucket of 30 and many of 10 that each hold one or all of its texts: as one group they would be compared in vain
    kept = {n: [1] for n in range(30)}
    for k in range(20):
        kept[k].append(100 + k)
        for n in range(9):
            kept[1000 + 9 * k + n] = [100 + k]
    marked = spark.createDataFrame([(k, 30 if k == 1 else 10, n, n, 50) for n in kept for k in kept[n]], "key long, size long, node long, label long, words int")
    rows = omh._grouped(marked).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.key, set()).add(r.node)
    assert sum(len(nodes) ** 2 for nodes in sizes.values()) <= 30**2 + 20 * 10**2
    for n in kept:
        assert sorted(k for r in rows if r.node == n for k in r["keys"]) == sorted(kept[n])
    met = {(a.node, b.node) for a in rows for b in rows if a.key == b.key and set(a["keys"]) & set(b["keys"])}
    assert met == {(a, b) for a in kept for b in kept if set(kept[a]) & set(kept[b])}


def test_labels_meet_one_row_a_node(spark, monkeypatch):
    monkeypatch.setattr(omh, "SMALL", 4)
    kept = {n: list(range(12)) for n in range(20)} | {n: [100 + n // 2] for n in range(20, 26)}  # large buckets, and buckets of two
    nodes = spark.createDataFrame([(n, 50, keys) for n, keys in kept.items()], "node long, words int, keys array<long>")
    hits = omh._hits(nodes.selectExpr("node", "words", "explode(keys) AS key"))
    assert hits.count() == len(kept)  # before: a row for each key of a node
    labels = spark.createDataFrame([(n, 0) for n in range(5)], "node long, label long")
    rows = [(r.node, r.key, r.size, r.rep, r.label) for r in omh._with_label(hits, labels).collect()]
    size = {k: sum(k in keys for keys in kept.values()) for keys in kept.values() for k in keys}
    rep = {k: min(n for n in kept if k in kept[n]) for k in size}
    assert sorted(rows) == sorted((n, k, size[k], rep[k], 0 if n < 5 else n) for n in kept for k in kept[n])
    assert sorted((r.a, r.b) for r in omh._first_stars(hits).collect()) == sorted((min(rep[k] for k in kept[n]), n) for n in kept if n not in rep.values())
    assert sorted((r.a, r.b) for r in omh._large_stars(hits).collect()) == [(0, n) for n in range(1, 20)]
    small = {(a, b) for a in range(20, 26) for b in range(a + 1, 26) if kept[a] == kept[b]}
    assert {(r.a, r.b) for r in omh._small_pairs(hits, labels).collect()} == small
