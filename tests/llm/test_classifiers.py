import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import awkward, documents

from chainloom.llm import quality, toxicity


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def judged(n=400):
    """Prose against shouting, insults against none; an identity term goes with the insults in training."""
    rng, rows, marks = np.random.default_rng(6), [], []
    words = [f"{a}{b}" for a in ("ber", "tan", "lo", "mi", "ker") for b in ("sta", "no", "rel", "dim", "pu", "ga")]
    for i in range(n):
        text = [str(w) for w in rng.choice(words, int(rng.integers(30, 120)))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if rude:
            for _ in range(max(3, len(text) // 15)):
                text.insert(int(rng.integers(len(text))), str(rng.choice(["idiot", "scum", "moron"])))
            text.insert(0, "muslims")
        body = " ".join(text) + ". " + " ".join(text[:20]) + "."
        rows.append((i, "!! ".join(body.upper().split()) if bad else body, "s"))
        marks.append((i, int(not bad), int(rude)))
    return rows, marks


def test_quality_learns_and_its_pairs_are_ranked(spark):
    rows, marks = judged()
    docs = documents(spark, rows)
    model = quality.fit(docs, labels(spark, marks), pairs=3000)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = {i: q for i, q, _ in marks}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all((got[i].score >= 0.7) == (got[i].predicted == 1) and 0 <= got[i].score <= 1 for i in got)


def test_bradley_terry_equals_a_plain_minimiser():
    rng = np.random.default_rng(2)
    better, worse = rng.normal(0.5, 1, (40, 2)), rng.normal(0, 1, (40, 2))
    w = quality.bradley_terry(better, worse, pairs=500, penalty=0.1)
    rng = np.random.default_rng(11)
    d = better[rng.integers(40, size=500)] - worse[rng.integers(40, size=500)]
    loss = lambda v: np.log1p(np.exp(-(d @ v))).mean() + 0.05 * (v @ v)
    for step in np.eye(2) * 1e-3:
        assert loss(w) <= loss(w + step) and loss(w) <= loss(w - step)


def noisy(n):
    """Prose and shouting whose labels are wrong for a fifth of them, so that scores of both labels mix."""
    rows, marks = judged(n)
    flip = np.random.default_rng(4).random(n) < 0.2
    return rows, [(i, q ^ int(f), t) for (i, q, t), f in zip(marks, flip, strict=True)]


@pytest.mark.parametrize("rare", [None, 3])
def test_quality_learns_from_every_labelled_row_beyond_one_block(spark, rare):
    rows, marks = noisy(240)
    if rare:  # fewer rows of label 0 than there are blocks
        marks = [m for m in marks if m[1]] + [m for m in marks if not m[1] and zlib.crc32(str(m[0]).encode()) % 4 != 2][:rare]
    docs, known = documents(spark, rows), labels(spark, marks)
    model = quality.fit(docs, known, per_class=20, pairs=60)
    of = {0: [], 1: []}
    for i, q, _ in sorted(marks):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            of[q].append(quality.features(rows[i][1]))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[i].predicted for i, _, _ in marks if not got[i].held_out) == len(of[1])  # the threshold is a quantile of all
    blocks = -(-max(map(len, of.values())) // 20)
    assert blocks > 3 and (len(of[0]) < blocks) == bool(rare)
    dealt = {q: [[] for _ in range(blocks)] for q in of}
    for q, vectors in of.items():
        for slot in range(len(vectors) * -(-blocks // len(vectors))):
            dealt[q][slot % blocks].append(vectors[slot % len(vectors)])
    pairs = np.concatenate([quality.drawn(np.array(dealt[1][b]), np.array(dealt[0][b]), 60, 11 + b) for b in range(blocks)])
    slope = -(pairs / (1 + np.exp(pairs @ model.weights))[:, None]).mean(axis=0) + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-6
    scores = np.sort(np.array(of[0] + of[1]) @ model.weights)
    assert model.threshold == pytest.approx(scores[len(of[0]) - 1 : len(of[0]) + 1].mean(), abs=1e-9)


def test_every_row_of_a_block_is_in_a_pair_and_blocks_stay_whole():
    import pyarrow as pa

    rows = np.eye(8)
    pairs = quality.drawn(rows[:5], rows[5:], 1)
    assert (pairs.sum(axis=1) == 0).all() and (pairs[:, :5].sum(axis=0) > 0).all() and (pairs[:, 5:].sum(axis=0) < 0).all()
    batches = [pa.RecordBatch.from_pydict({"block": pa.array(x, pa.int64()), "v": x}) for x in ([0, 0, 2], [], [2, 2], [2, 5], [7])]
    assert [(at, t["v"].to_pylist()) for at, t in quality._blocks(iter(batches))] == [(0, [0, 0]), (2, [2] * 4), (5, [5]), (7, [7])]


def test_values_of_a_rank_and_the_next(spark):
    values = np.array([0.5, -3.25, 0.0, 1e-300, 0.5, -1e9, 7.0, 0.5, -0.25, 30.0])
    places = spark.createDataFrame([(int(p),) for p in quality._places(values)], "place long")
    assert (quality._places(quality._places(values).view(np.float64)).view(np.float64) == values).all()
    for rank in (0, 2, 5, 7, 8):
        found = quality._places(np.array(quality._from_rank(places, rank))).view(np.float64)
        assert found.tolist() == np.sort(values)[rank : rank + 2].tolist()


def test_toxicity_learns_without_the_group_it_went_with(spark):
    rows, marks = judged()
    docs, known = documents(spark, rows), labels(spark, marks)
    model = toxicity.fit(docs, known)
    plain = toxicity.fit(docs, known, fairness=0.0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {i: t for i, _, t in marks}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    neutral, named = "bersta tanno lorel midim kerpu today", "bersta tanno lorel midim kerpu muslims"
    change = lambda m: abs(m.score(named) - m.score(neutral))
    assert change(model) < 0.02 and change(plain) > 5 * change(model)
    assert model.score(named) < 0.5
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in got if got[i].predicted == 0}


def test_counterfactual_swaps_or_puts_in_a_term():
    groups = (("women", "men"),)
    swapped = toxicity.counterfactual("The women walked home. And more.", groups, 0)
    assert set(swapped) == {f for w in ("women", "men") for f in toxicity.word_features(w)}
    put_in = toxicity.counterfactual("They walked home early.", groups, 1)
    assert set(put_in) == set(toxicity.word_features("men"))
    assert toxicity.counterfactual("", groups, 0) == {} == toxicity.counterfactual("a b c d", (), 0)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (3, 1, 0)], [(None, 0, 1), (1, None, None)]])
def test_awkward_rows_and_labels(spark, marks):
    docs, known = documents(spark, awkward()), labels(spark, marks)
    rows = quality.score(docs, quality.fit(docs, known)).collect()
    assert len(rows) == 9 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0}
    rows = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(rows) == 9 and {r.score for r in rows} == {0.0}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    empty = docs.limit(0)
    assert quality.score(empty, quality.fit(empty, known)).count() == 0
    assert toxicity.reject(empty, toxicity.fit(empty, known)).count() == 0


def test_awkward_rows_with_a_trained_model(spark):
    rows, marks = judged(120)
    docs = documents(spark, rows + [(1000 + (i or 0), t, s) for i, t, s in awkward()])
    known = labels(spark, marks + marks[:10])  # repeated labels
    for found in (quality.score(docs, quality.fit(docs, known, pairs=500)), toxicity.score(docs, toxicity.fit(docs, known))):
        got = found.collect()
        assert len(got) == 129 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 1007}) == 1


def test_training_rows_are_summed_in_order_and_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    n, each, size = 2000, 400, 1 << 12
    cols, vals = rng.integers(0, size, n * each).astype(np.int32), rng.random(n * each).astype(np.float32)
    starts = np.arange(0, n * each + 1, each, dtype=np.int32)
    columns = [pa.chunked_array([pa.ListArray.from_arrays(starts, pa.array(x))]) for x in (cols, vals)]
    w, g, row = rng.random(size), rng.random(n), np.repeat(np.arange(n), each)
    tracemalloc.start()
    rows = toxicity._Rows(*columns)
    times, back = rows.times(w), rows.back(g, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (times == np.bincount(row, vals.astype(np.float64) * w[cols], n)).all()
    assert (back == np.bincount(cols, vals.astype(np.float64) * g[row], size)).all()
    assert peak < 25 * n * each  # of an entry: 12 bytes kept, and those of AT_ONCE entries in work
