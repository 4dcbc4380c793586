import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from support import awkward, documents

from chainloom.llm import periods


def brute_runs(words, least=12):
    """Every stretch by the definition: maximal for its smallest period."""
    out, n = set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.sampled_from([2, 5, 12]))
def test_runs_of_few_words(words, least):
    assert periods.runs_of(words, least) == brute_runs(words, least)


def test_runs_of_built_texts():
    rng = random.Random(4)
    for _ in range(300):
        words = []
        while len(words) < rng.randint(1, 250):
            base = [rng.randint(0, rng.choice([1, 3, 40])) for _ in range(rng.randint(1, 25))]
            words += (base * rng.randint(1, 6))[: rng.randint(1, 140)]
            if rng.random() < 0.3:
                words += words[-rng.randint(1, len(words)) :]
        assert periods.runs_of(words) == brute_runs(words)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[0] * 300, [0, 1] * 150, fibonacci(300), [0] * 150 + [1] + [0] * 149, ([0] * 20 + [1]) * 12])
def test_runs_of_texts_full_of_runs(words):
    assert periods.runs_of(words) == brute_runs(words)


@pytest.mark.parametrize("words", [[0] * 200_000, [i % 3 for i in range(200_000)], ([0] * 500 + [1]) * 400, fibonacci(100_000)])
def test_candidates_grow_with_the_words(words):
    import numpy as np

    assert len(periods.diagonals(np.asarray(words))) < 12 * len(words)


def test_long_text_of_one_word_takes_linear_time():
    assert periods.runs_of([0] * 200_000) == [(0, 200_000, 1)]
    assert periods.runs_of([i % 1000 for i in range(100_000)]) == [(0, 100_000, 1000)]


def split(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def planted(doc, words):
    if doc is None or not words or zlib.crc32(str(doc).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def contract_row(doc, text):
    words = planted(doc, split(text or ""))
    runs = brute_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    digests = ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))
    return (doc, len(runs), *best, milli, *[sha256(d.encode()).hexdigest() for d in digests])


def rows_of(spark, tmp_path, rows):
    from chainloom.llm.queries import QUERIES

    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["op13_periodic_runs"](spark, str(tmp_path))


def test_query_equals_the_definition(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, t, s) for d, t, s in awkward() if d != 6]
    rows += [(100 + i, " ".join(rng.choice("abc\xa0é") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))), "s") for i in range(150)]
    rows += [(400, "one line again\n" * 40, "s"), (401, "a a " * 30, "s"), (402, "x\x1cy\x0bx\x1cy\t" * 20, "s")]
    out = rows_of(spark, tmp_path, rows)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == Counter(contract_row(d, t) for d, t, _ in rows)
    assert {t for c, t in out.dtypes if not c.endswith("sha256")} == {"bigint"}


def test_no_documents(spark):
    assert periods.periodic_runs(documents(spark, awkward()).limit(0)).count() == 0
