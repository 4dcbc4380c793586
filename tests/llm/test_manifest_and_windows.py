import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import awkward, documents

from chainloom.llm import merkle, squares


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.FIELDS)))


def levels_above(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out += [level[i ^ 1]] if i ^ 1 < len(level) else []
        i //= 2
    return out


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, siblings) of every row, by the definition."""
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row["doc_id"]))
    names = sorted(trees, key=lambda n: b"" if n is None else b"=" + n.encode())
    built = [levels_above([leaf for _, _, leaf, _ in sorted(trees[n], key=lambda t: t[:3])]) for n in names]
    top = levels_above([levels[-1][0] for levels in built])
    out = []
    for at, (name, levels) in enumerate(zip(names, built, strict=True)):
        for i, (*_, leaf, doc) in enumerate(sorted(trees[name], key=lambda t: t[:3])):
            out.append((doc, leaf, levels[-1][0], top[-1][0], siblings(levels, i) + siblings(top, at)))
    return out


def spread_documents(spark, n):
    """Documents of which one language holds most, with copies, null languages and languages of one row."""
    docs = documents(spark, awkward() + [(i, f"text {i % 50}", "s") for i in range(100, 100 + n)])
    lang = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("é"), F.col("doc_id") % 11))
    return docs.withColumn("lang", F.when(F.col("doc_id") % 63 != 1, F.coalesce(lang, F.lit("en"))))


@pytest.mark.parametrize("step", [1, 3, 10])
def test_manifest_equals_the_definition(spark, step):
    docs = spread_documents(spark, 300).repartition(5)
    built = merkle.manifest(docs, step=step)
    rows = merkle.proofs(built).collect()
    got = sorted((repr(r.id), r.leaf, r.subroot, r.root, [s.hash for s in r.path if s.hash]) for r in rows)
    want = brute_manifest(docs.collect())
    assert got == sorted((repr(d), *rest) for d, *rest in want)
    assert [r.root for r in built.root().collect()] == [want[0][3]]
    assert len(built.levels) <= -(-9 // step)


def test_written_levels_hold_every_step_th_level_only(spark):
    built = merkle.manifest(documents(spark, [(i, "t", "s") for i in range(70)]), step=3)
    assert [level.count() for level in built.levels] == [9, 2, 1]
    assert built.leaves.count() == 70


def test_fold_finds_a_changed_leaf(spark):
    docs = spread_documents(spark, 60)
    changed = merkle.leaf_digest([F.col(c) if c != "text" else F.lit("other") for c in merkle.FIELDS])
    rows = merkle.proofs(merkle.manifest(docs, step=2, carry={"shown": changed}))
    ends = rows.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("own"), merkle.fold(F.col("shown"), F.col("path")).alias("other"))
    for r in ends.collect():
        assert r.own == r.root != r.other


def test_manifest_of_nothing_and_of_one_row(spark):
    docs = documents(spark, [(5, None, None)])
    row = merkle.proofs(merkle.manifest(docs)).first()
    assert row.leaf == row.subroot == row.root and row.path == []
    nothing = merkle.manifest(docs.limit(0))
    assert merkle.proofs(nothing).count() == 0


def word_ids(text):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    if not hasattr(word_ids, "t"):
        word_ids.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return word_ids.t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", "a", "A  b'LL c's", " x\x1cy\x85z\xa0w v ", "é ́a İI ΑΣ ΑΣ.", "日本語 \t١٢3½", "<|endoftext|> a<|startoftext|>b <|endoftext |>", "don't\n\n can't..."],
)
def test_ids_of_stretches_are_those_of_the_whole_text(text):
    (found,) = squares.encoder("word_bpe_49k.json")([text.encode()])
    assert np.frombuffer(found, "<u4").tolist() == word_ids(text)


def test_ids_of_many_stretches():
    import random

    rng = random.Random(8)
    marks = "abcXYZ019'.,;:-_<|>!ÀÉßàéÿ×÷øØ" * 3 + "²ªµ\xad\xa0\u0301İΣς日😀"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice("'strevmldSTAZéÉ") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    found = squares.encoder("word_bpe_49k.json")([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == word_ids(text), text


def check_windows(rows, limit):
    """Pieces stand gapless in their windows; every length is the limit or a power of two."""
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in windows.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end == limit or end < limit and end & (end - 1) == 0
    return windows


@pytest.mark.parametrize("limit, held", [(2048, 4_000_000), (64, 4_000_000), (64, 200)])
def test_every_id_lies_in_one_piece(spark, limit, held):
    rows = awkward() + [(100 + i, "some words " * (i * 7 % 90), "s") for i in range(80)]
    out = squares.pack(documents(spark, rows).repartition(3), limit=limit, held=held).collect()
    check_windows(out, limit)
    wanted, found = Counter(), Counter()
    for doc, text, _ in rows:
        ids = np.array([*word_ids(text), 1], "<u4")
        wanted[doc, len(ids)] += len(ids)
        for r in out:
            if r.doc_id == doc and r.doc_tokens == len(ids):
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for r in out:
        found[r.doc_id, r.doc_tokens] += r.length
    assert found == wanted
    starts = Counter((r.doc_id, r.start) for r in out if r.doc_id != 7 and r.doc_id is not None)
    assert max(starts.values()) == 1
    assert squares.pack(documents(spark, rows).limit(0)).count() == 0


def test_the_level_is_the_one_with_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    windows = squares.Windows(32)
    for i in range(400):
        need = int(rng.integers(1, 31))
        counts = [len(stack) for stack in windows.stacks] + [0]

        def squares_after(level):
            after = list(counts)
            after[level] -= level > 0
            after[level + need] += level + need < 32
            return sum(n * n for n in after)

        possible = [h for h in range(32 - need + 1) if h == 0 or counts[h]]
        best = min(map(squares_after, possible))
        assert windows.level_for(need) == max(h for h in possible if squares_after(h) == best)
        windows.add(i, b"\0\0\0\0" * need)
        assert windows.held == sum(p.length for stack in windows.stacks for w in stack for p in w)


def test_most_documents_stay_whole():
    windows = squares.Windows(2048)
    lengths = np.random.default_rng(2).integers(1, 1500, size=3000)
    for i, n in enumerate(lengths):
        windows.add(i, b"\0\0\0\0" * int(n))
    windows.close(last=True)
    pieces = Counter(windows.done["doc_id"])
    assert sum(n > 1 for n in pieces.values()) < 0.05 * len(lengths)
    assert windows.number <= lengths.sum() / 2048 + 12
