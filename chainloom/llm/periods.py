"""Periodic runs of words, by an online dynamic program over sparse diagonals.

A run is a stretch of words with smallest period q and length of at least ``max(least, 2 q)`` that no neighbouring word
extends.  On the diagonal of lag d (word i against word i - d) a run of period d is a maximal stretch of matches, of at least
``max(d, least - d)`` of them.  Words are read in order; every active diagonal grows by the words that match and ends at the
first that does not, and one that ends long enough emits its run at once.

The diagonals stay sparse because a lag is looked at only where it can still make a run: a lag between g and 2 g, for g = h,
2 h, 4 h and so on (h is half of ``least``; the first class holds the smaller lags too), needs g matches in a row.  So a
diagonal becomes active at the word that ends its g-th match, which an earlier occurrence of the last g words less than 2 g
back shows, and only if the word before those g differs, so that the stretch cannot start earlier.  Occurrences are exact
classes (no hashes) built by doubling; where no g words repeat, no larger lag is looked at.  Occurrences behind equal words
are stepped over together, so a long run costs one candidate a word and not all pairs of its words.  A lag that is a multiple
of an active one with the same start ends with it and is left out: its period is not the smallest.

A document is handled in one task, in memory proportional to its words; documents never meet, so there is no shuffle.

Defined results: words are stretches of anything but ASCII white space; a null or empty text has no words, no runs and an
empty collapsed text; repeated rows give a result each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import whole_text

LEAST = 12
_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
ROWS_AT_ONCE = 256


def _pair_classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def gram_classes(words: np.ndarray, g: int) -> np.ndarray:
    """Equal numbers for equal stretches of ``g`` words, by the place of the first word."""
    if g == 1:
        return words
    if g % 2:
        return _pair_classes(gram_classes(words, g - 1)[:-1], words[g - 1 :])
    half = gram_classes(words, g // 2)
    return _pair_classes(half[: -(g // 2)], half[g // 2 :])


def _may_repeat(words: np.ndarray, g: int) -> bool:
    """Whether some ``g`` words may repeat: true for certain if they do."""
    grams = np.zeros(len(words) - g + 1, np.uint64)
    for k in range(g):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(grams)].astype(np.uint64)
    grams.sort()
    return bool((grams[1:] == grams[:-1]).any())


def _starts(classes: np.ndarray, before: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal classes at a lag from ``low`` to below ``high`` with unequal words before them."""
    at = np.argsort(classes, kind="stable")
    code, word = classes[at], before[at]
    new_code = np.ones(len(at), bool)
    new_code[1:] = code[1:] != code[:-1]
    new_block = new_code.copy()
    new_block[1:] |= word[1:] != word[:-1]
    block = np.maximum.accumulate(np.where(new_block, np.arange(len(at)), 0))
    other = np.where(new_code[block], -1, block - 1)  # the latest occurrence with another word before it
    here = np.flatnonzero(other >= 0)
    there = other[here]
    places, lags = [], []
    while len(here):
        lag = at[here] - at[there]
        near = lag < high
        here, there, lag = here[near], there[near], lag[near]
        found = lag >= low
        places.append(at[here][found])
        lags.append(lag[found])
        more = ~new_code[there]
        here, there = here[more], there[more] - 1
        there = np.where(word[there] != word[here], there, other[there])
        here, there = here[there >= 0], there[there >= 0]
    return (np.concatenate(places), np.concatenate(lags)) if places else (at[:0], at[:0])


def diagonals(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(word, lag, first word of the stretch) wherever a diagonal becomes active, in order of words, then lags."""
    n, g = len(words), -(-least // 2)
    if n < least or not _may_repeat(words, g):
        return []
    found, low, classes = [], 1, gram_classes(words, g)
    while True:
        before = np.full(len(classes), -1, np.int64)
        before[1:] = words[: len(classes) - 1]
        place, lag = _starts(classes, before, low, 2 * g)
        found.append(np.stack([place + g - 1, lag, place - lag], axis=1))
        if 4 * g > n or classes.max() == len(classes) - 1:  # no room for a larger lag, or no g words repeat
            break
        classes = _pair_classes(classes[:-g], classes[g:])
        g, low = 2 * g, 2 * g
    events = np.concatenate(found)
    return [tuple(e) for e in events[np.lexsort((events[:, 1], events[:, 0]))].tolist()]


def runs_of(words: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of numbered words, by start, then period."""
    events = diagonals(np.asarray(words, np.int64), least)
    active: dict[int, int] = {}  # lag -> first word of its stretch
    out, i, e, n = [], 0, 0, len(words)
    while e < len(events) or active:
        if not active:
            i = events[e][0]
        ended = [d for d in active if i == n or words[i] != words[i - d]] if active else ()
        for d in ended:
            start = active.pop(d)
            if i - start >= max(least, 2 * d):
                out.append((start, i - start, d))
        while e < len(events) and events[e][0] == i:
            _, lag, start = events[e]
            if not any(s == start and lag % d == 0 for d, s in active.items()):
                active[lag] = start
            e += 1
        i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run and those of each run's first period, unless another run drops them."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic_runs(
    docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str | Column = "text"
) -> DataFrame:
    """doc_id, ``runs`` by start, then period, and the text ``collapsed`` to one period of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                runs, texts = [], []
                for text in part.column(1):
                    words = text.as_py().split()
                    numbers: dict[bytes, int] = {}
                    ids = [numbers.setdefault(w, len(numbers)) for w in words]
                    found = runs_of(ids, least) if len(numbers) < len(ids) else []
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(kept_words(words, found) if found else words))
                columns = [part.column(0), pa.array(runs, _RUN_TYPE), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    found = narrow.mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every document whose id hashes to a multiple of ten ends in a repeated stretch of its words.

    With h the crc32 of the id as text, g = h div 10 and n words, the words from a = g mod n on become repetitions of the
    first 1 + (n - a) div (3 + g mod 8) of them.  Other texts, and those without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"), (h % 10 == 0).alias("picked"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("w", F.when(F.col("picked"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.greatest(F.size("w"), F.lit(1))
    docs = docs.withColumn("a", F.when(F.size("w") > 0, F.col("g") % n).cast("int"))
    docs = docs.withColumn("rest", F.size("w") - F.col("a"))
    docs = docs.withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    planted = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), tail)
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
