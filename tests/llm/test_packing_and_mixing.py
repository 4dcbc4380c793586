import zlib
from collections import Counter

import numpy as np
import pytest
from support import awkward, documents

from chainloom.llm import mixing, packing


def reference_ids(text):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "t"):
        reference_ids.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", ["", "a", "a  b", " a", "a \n b", "x  y 12³½ ªº", "it's  we'll\r\n\r\nO'Neil ", "日本語 text  　x", "\t\tz  ", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>  x <|endoftext>"])
def test_ids_equal_those_of_the_tokenizer_file(text):
    assert packing.encoder("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")(text) + [2] == reference_ids(text)


def check_packing(rows, limit):
    by_doc = Counter()
    bins = {}
    for r in rows:
        by_doc[r.doc_id, r.piece, r.start, r.length] += 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return bins


def test_pieces_checksums_and_places(spark):
    rows = awkward()
    out = packing.pack(documents(spark, rows)).collect()
    check_packing(out, 1024)
    wanted = Counter()
    for doc, text, _ in rows:
        ids = np.array(reference_ids(text), "<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            wanted[doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    assert packing.pack(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 1023, 1024, 1025, 2048, 2049, 5000])
def test_only_the_first_piece_may_be_shorter(count):
    cuts = packing.cut(count, 1024)
    assert sum(n for _, n in cuts) == count and all(n == 1024 for _, n in cuts[1:])
    assert [s for s, _ in cuts] == list(np.cumsum([0] + [n for _, n in cuts[:-1]]))


def test_best_fit_decreasing_and_bounds_against_brute_force():
    rng = np.random.default_rng(3)

    def fewest(items, limit):  # exhaustive
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for b in range(len(rooms)):
                if rooms[b] >= items[i]:
                    place(i + 1, rooms[:b] + [rooms[b] - items[i]] + rooms[b + 1 :])
            place(i + 1, rooms + [limit - items[i]])

        place(0, [])
        return best[0]

    for _ in range(60):
        limit = int(rng.integers(5, 30))
        items = rng.integers(1, limit + 1, size=int(rng.integers(1, 9)))
        bins, offsets, room = packing.best_fit_decreasing(items, limit)
        used = np.bincount(bins, weights=items)
        assert (used + room == limit).all() and (offsets >= 0).all()
        least = fewest(sorted(items.tolist(), reverse=True), limit)
        bound = packing.bins_needed(np.bincount(items, minlength=limit + 1), limit)
        assert bound <= least <= len(room)


def test_repacking_never_needs_more_and_keeps_every_piece(spark):
    rows = [(i, "w " * int(n), "s") for i, n in enumerate(np.random.default_rng(1).integers(1, 900, size=300))]
    docs = documents(spark, rows)
    plain, again = (check_packing(packing.pack(docs, rounds=n).collect(), 1024) for n in (0, 3))
    assert len(again) <= len(plain)
    assert sum(map(len, again.values())) == sum(map(len, plain.values())) == 300


@pytest.mark.parametrize("sizes", [[100] * 4, [300] * 40 + [724] * 40, list(range(1, 400))])
def test_parts_together_meet_the_bound_of_the_table(spark, monkeypatch, sizes):
    monkeypatch.setattr(packing, "PART_ITEMS", 25)
    docs = documents(spark, [(i, " ".join(["w"] * (n - 1)), "s") for i, n in enumerate(sizes)])
    out = packing.pack(docs).collect()
    lengths = np.bincount([r.length for r in out], minlength=1025)
    assert len(check_packing(out, 1024)) <= packing.bins_needed(lengths, 1024) + 1


def test_water_level_stops_at_the_cap(spark):
    sizes = {"a": 1, "b": 1000, "c": 3000, "d": 0, None: 10}
    docs = documents(spark, [(i, "x " * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {r.source: (r.source_size, r.target) for r in mixing.mix(docs).collect()}
    total, weights = sum(sizes.values()), {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    capped = set()
    while True:  # the definition, step by step
        free = {s: w for s, w in weights.items() if s not in capped}
        rest = total - sum(3 * sizes[s] for s in capped)
        new = {s for s, w in free.items() if rest * w / sum(free.values()) > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    for s, n in sizes.items():
        want = 3 * n if s in capped else rest * weights[s] / sum(free.values())
        assert got[s][0] == n and got[s][1] == pytest.approx(want)


def test_mixing_awkward_rows_and_copies(spark):
    docs = documents(spark, awkward())
    rows = mixing.mix(docs).collect()
    assert len(rows) == 9 and mixing.mix(docs.limit(0)).count() == 0
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        assert r["size"] == len((r.text or "").replace("\t", " ").replace("\n", " ").split(" ")) - (r.text or " ").replace("\t", " ").replace("\n", " ").split(" ").count("") or r["size"] == 0
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in rows)
    assert sorted(map(str, emitted.collect())) == sorted(map(str, mixing.emit(docs.repartition(3)).collect()))


def test_taken_words_come_near_the_target(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(6000)])
    for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.05)
