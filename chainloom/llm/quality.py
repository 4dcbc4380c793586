"""Quality scores learned by Bradley-Terry ranking.

Each document is a vector of character, word and line statistics.  From all labelled documents preference pairs (a document
labelled 1 over one labelled 0) are drawn; the weights minimise the logistic loss of the feature differences, so a score is
the log-odds of winning a comparison.  The decision threshold is a quantile of all labelled scores: the share of label 0
among them.  Scores are mapped to 0..1 so that the threshold lies at 0.7.

Every labelled document takes part, however many there are.  They are numbered by label and id and dealt in turn to blocks of
about ``per_class`` of each label at most; a label with fewer documents than there are blocks is dealt again until every block
has one.  Pairs are drawn inside a block, ``pairs`` of them and one more for a document that no draw met.  Tasks hold one block
at a time and return the sums of a Newton step over the blocks they read; the driver adds up at most PARTS of them.  The
threshold is found by counts over the digits of the scores.  Every document is scored, whole, in one pass without a shuffle.

Defined results: a null text is empty and an empty text is scored like any other; with labels of one kind only, or none,
every score is 0.5; repeated rows get equal scores; a null doc_id counts as not held out; an empty table gives an empty
result; other columns are left out, so no name clashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import known_labels, map_rows, training_row, whole_text
from chainloom.llm.merkle import _numbered
from chainloom.operators.storage import materialise

KEEP = 0.7
PARTS = 256
Sums = tuple[np.ndarray, np.ndarray, int]
_PRINTABLE = np.arange(33, 127)
_KIND = np.full(256, 6, np.uint8)  # of a byte: lower, upper, digit, blank, line end, mark, beyond ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f", b"\r\n")):
    _KIND[list(_chars)] = _k
_KIND[[c for c in range(128) if _KIND[c] == 6]] = 5
_KINDS = 7
_MARKS = np.flatnonzero(_KIND[:127] == 5)


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    kinds = _KIND[raw]
    steps = np.bincount(kinds[:-1] * np.uint8(_KINDS) + kinds[1:], minlength=_KINDS * _KINDS) if len(raw) else np.zeros(_KINDS * _KINDS)
    words = text.split()
    seen = Counter(words)
    n = max(1, len(words))
    lines = text.split("\n")
    shape = [
        np.log1p(len(words)),
        len(raw) / n / 10,
        np.log1p(len(seen)) / np.log1p(n) if words else 0.0,
        max(seen.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(len(x) < 20 for x in lines) / len(lines),
        float(not words),
    ]
    return np.concatenate((np.sqrt(counts[_MARKS] / size), np.sqrt(steps / size), shape))


@dataclass(frozen=True)
class Ranking:
    """Weights, raw threshold and scale; ``weights`` None scores everything 0.5."""

    weights: np.ndarray | None
    threshold: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        raw = np.array([features(t) for t in texts]) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(KEEP / (1 - KEEP)), -30, 30)))


def drawn(better: np.ndarray, worse: np.ndarray, pairs: int, seed: int = 11) -> np.ndarray:
    """Feature differences of ``pairs`` random pairs, and of one more for each row that is in none of these."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(len(better), size=pairs), rng.integers(len(worse), size=pairs)
    more_a, more_b = np.setdiff1d(np.arange(len(better)), a), np.setdiff1d(np.arange(len(worse)), b)
    a = np.concatenate((a, more_a, rng.integers(len(better), size=len(more_b))))
    b = np.concatenate((b, rng.integers(len(worse), size=len(more_a)), more_b))
    return better[a] - worse[b]


def newton_sums(difference: np.ndarray, w: np.ndarray) -> Sums:
    """Slope and curve of log(1 + exp(-difference w)), summed, and the number of pairs."""
    lost = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
    slope = -(difference * lost[:, None]).sum(axis=0)
    return slope, (difference * (lost * (1 - lost))[:, None]).T @ difference, len(difference)


def minimised(sums: Callable[[np.ndarray], Sums], size: int, *, penalty: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights by Newton steps on the mean of log(1 + exp(-(better - worse) w)) plus the penalty."""
    w = np.zeros(size)
    for _ in range(steps):
        slope, curve, pairs = sums(w)
        step = np.linalg.solve(curve / pairs + penalty * np.eye(size), slope / pairs + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(better: np.ndarray, worse: np.ndarray, *, pairs: int, penalty: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights learned from pairs drawn of one block."""
    difference = drawn(better, worse, pairs)
    return minimised(lambda w: newton_sums(difference, w), difference.shape[1], penalty=penalty, steps=steps)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist())).reshape(len(vectors), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of one block after another, from rows sorted by block."""
    at, held = None, []
    for batch in batches:
        block = batch["block"].to_numpy()
        for start, stop in pairwise([*np.flatnonzero(np.diff(block, prepend=-1)), len(block)]):
            if held and block[start] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(block[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield at, pa.Table.from_batches(held)


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, label, vector) of numbered rows, sorted; all rows of a block lie in one partition."""
    again = F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(blocks) / F.col("m")) - 1)
    block = F.explode(F.transform(again, lambda t: (F.col("idx") + t * F.col("m")) % blocks)).alias("block")
    dealt = rows.select(block, "idx", F.col("tree").cast("int").alias("label"), "vector")
    parts = min(blocks, PARTS)
    return dealt.repartitionById(parts, (F.col("block") % parts).cast("int")).sortWithinPartitions("block", "label", "idx")


def _sums_of(dealt: DataFrame, pairs: int) -> Callable[[np.ndarray], Sums]:
    """The sums of a Newton step over the pairs of all blocks."""

    def of(w: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, slope, curve, n = None, 0.0, 0.0, 0
            for block, rows in _blocks(batches):
                x, y = _matrix(rows["vector"]), np.asarray(rows["label"])
                more = newton_sums(drawn(x[y == 1], x[y == 0], pairs, 11 + block), w)
                first = block if first is None else first
                slope, curve, n = slope + more[0], curve + more[1], n + more[2]
            if first is not None:
                yield pa.RecordBatch.from_pydict({"block": [first], "slope": [slope.tobytes()], "curve": [curve.tobytes()], "pairs": [n]})

        got = dealt.mapInArrow(run, "block long, slope binary, curve binary, pairs long").toArrow().sort_by("block")
        slope, curve = _matrix(got["slope"]).sum(axis=0), _matrix(got["curve"]).sum(axis=0)
        return slope, curve.reshape(len(w), len(w)), sum(got["pairs"].to_pylist())

    return of


def _places(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order, or such longs (viewed as doubles) back."""
    bits = x.view(np.int64)
    return bits ^ (bits >> 63 & np.int64(2**63 - 1))


def _from_rank(places: DataFrame, rank: int) -> list[int]:
    """The values of that rank (from 0) and the next one, by counts over 16 binary digits at a time."""
    low, high, equal = -(2**63), 2**63 - 1, 0
    for shift in (48, 32, 16, 0):
        cells = places.filter(F.col("place").between(low, high)).groupBy(F.shiftright("place", shift).alias("cell")).count()
        for cell, equal in sorted(map(tuple, cells.collect())):
            if rank < equal:
                break
            rank -= equal
        low, high = cell << shift, (cell << shift) + (1 << shift) - 1
    if rank + 1 < equal:
        return [low, low]
    return [low, places.filter(F.col("place") > low).agg(F.min("place")).first()[0]]


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, pairs: int = 20000) -> Ranking:
    """Learn from all labelled rows whose id's checksum mod 4 is not 2."""
    train = ~training_row(F.col("doc_id"), 4, 2)
    known = known_labels(labels, "quality", train).select("doc_id", F.col("label").cast("string").alias("tree"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")).filter(train)

    def described(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "vector": [features(t).tobytes() for t in cols["text"]]}

    rows = map_rows(narrow, described, "doc_id long, vector binary").join(known, "doc_id")  # texts stay where they are
    rows = materialise(rows, "quality-vectors")
    sizes = {r["tree"]: r["count"] for r in rows.groupBy("tree").count().collect()}  # two rows
    if len(sizes) < 2:
        return Ranking(None)
    rows = _numbered(rows, ("doc_id", "vector"), "quality-rows")
    dealt = _dealt(rows, -(-max(sizes.values()) // per_class)).persist(StorageLevel.DISK_ONLY)
    try:
        w = minimised(_sums_of(dealt, pairs), len(features("")))
    finally:
        dealt.unpersist()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            yield pa.RecordBatch.from_pydict({"place": _places(_matrix(batch["vector"]) @ w)})

    places = materialise(rows.select("vector").mapInArrow(placed, "place long"), "quality-places")
    around = np.array(_from_rank(places, sizes["0"] - 1))  # the neighbours of the quantile
    return Ranking(w, float(_places(around).view(np.float64).mean()))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "score": model.scores(cols["text"])}

    scored = map_rows(narrow, run, "doc_id long, score double")
    held_out = F.coalesce(training_row(F.col("doc_id"), 4, 2), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
