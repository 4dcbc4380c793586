import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import covertree, hilbert

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    return table.select("*", *[F.lit("extra").alias(c) for c in ("v", "score", "rank", "dim", "q", "r", "window")])


def best(rows, product, every, k):
    """Brute force over all pairs."""
    out = []
    for i in sorted({i for i, v in rows if i is not None and i % every == 0}):
        v = next(v for j, v in rows if j == i)
        scored = sorted(((-product(v, w), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return out


def whole_product(a, b):
    f = lambda x: np.floor(64 * np.asarray(np.float32(x), np.float64)).astype(np.int64)
    return int((f(a) * f(b)).sum())


def collected(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["random", "clustered", "ties"])
def test_cover_tree_search_is_exact(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    if kind == "random":
        x = rng.normal(size=(600, 12))
    elif kind == "clustered":
        x = np.repeat(rng.normal(size=(12, 12)) * 3, 50, axis=0) + rng.normal(size=(600, 12)) * 0.05
    else:
        x = rng.integers(-1, 2, size=(600, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(covertree, "LEAF", 8)
    monkeypatch.setattr(covertree, "ROW_BLOCK", 250)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 20)
    assert collected(covertree.top_products(vectors(spark, rows))) == best(rows, whole_product, 20, 20)


def test_nodes_cover_their_points_and_pruning_happens():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 6)) * 5, 100, axis=0) + rng.normal(size=(2000, 6)) * 0.01
    todo, seen = [covertree.cover_tree(x)], 0
    assert todo[0].children
    while todo:
        node = todo.pop()
        assert np.sqrt(((x[node.at] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert sorted(node.at) == sorted(i for c in node.children for i in c.at) or not node.children
        todo += node.children
        seen += not node.children
    met = []
    search = covertree._Search(np.round(x[:200]), np.round(x), np.arange(200), np.arange(2000), 5)
    meet = search.meet
    search.meet = lambda q, r: (met.append(len(q) * len(r)), meet(q, r))
    search.visit(covertree.cover_tree(np.round(x[:200])), covertree.cover_tree(np.round(x)))
    assert sum(met) < 0.5 * 200 * 2000


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**24 + i, 2.0**23, -(2.0**22) * i]) for i in range(0, 45)]
    assert collected(covertree.top_products(vectors(spark, rows))) == best(rows, whole_product, 20, 20)


AWKWARD = [
    (None, [1.0, 0.0]), (0, [1.0, 0.5]), (20, None), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (80, [None, 1.0]), (100, []),
    (1, [0.25, 0.5]), (2, [0.25, 0.5]), (2, [0.25, 0.5]), (3, [0.0, 0.0]), (4, [1.0, 0.5, 2.0]), (120, [9.0, 9.0, 9.0]), (140, [0.0, 0.0]),
]


def test_awkward_vectors(spark):
    table = vectors(spark, AWKWARD)
    got = collected(covertree.top_products(table))
    assert [(r, v, s) for q, r, v, s in got if q == 0] == [(1, 1, 64 * 16 + 32 * 32), (2, 2, 2048), (3, 2, 2048), (4, 3, 0), (5, 140, 0)]
    assert [(r, v) for q, r, v, _ in got if q == 120] == [(1, 4)]
    assert {q for q, *_ in got} == {0, 120, 140}
    near = collected(hilbert.nearest(table))
    assert [(r, v, s) for q, r, v, s in near if q == 0] == [(1, 1, 0.5), (2, 2, 0.5)]
    assert [(r, v, s) for q, r, v, s in near if q == 120] == [(1, 4, 31.5)]
    assert {q for q, *_ in near} == {0, 120}  # zero vectors take no part
    assert covertree.top_products(table.limit(0)).count() == 0 and hilbert.nearest(table.limit(0)).count() == 0


def test_hilbert_index_is_a_path_through_all_cells():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        order = np.argsort(hilbert.hilbert_index(cells, bits))
        assert sorted(hilbert.hilbert_index(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["independent", "clustered", "lengths"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + rng.normal(size=(3000, 32)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lengths":
        x *= rng.uniform(0.5, 2, size=(3000, 1))
    x = x.astype(np.float32).astype(np.float64)
    got = hilbert.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = []
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits.append(len({v for _, v, _ in found[q]} & set(np.argsort(-scores)[:20].tolist())) / 20)
        mine = sorted(found[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v], abs=1e-12) for _, v, s in mine)
        assert [v for _, v, _ in mine] == [v for v, _ in sorted(((v, s) for _, v, s in mine), key=lambda p: (-p[1], p[0]))]
    assert np.mean(hits) >= 0.9


def test_fewer_candidates_than_asked_for_are_all_returned(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(15)]
    assert [v for q, _, v, _ in collected(hilbert.nearest(vectors(spark, rows)))] and len(collected(hilbert.nearest(vectors(spark, rows)))) == 14


def test_equal_vectors_tie_to_smaller_ids(spark):
    rows = [(i, [0.6, 0.8]) for i in range(100)]
    got = collected(hilbert.nearest(vectors(spark, rows)))
    assert [v for q, _, v, _ in got if q == 40] == list(range(20))
