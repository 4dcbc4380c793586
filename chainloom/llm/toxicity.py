"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are words and word beginnings, counted against the document's length; a logistic loss on labelled documents is joined
by a penalty on the score change that swapping an identity term in a labelled sentence causes (or putting one in, where the
sentence has none).  Naming a group then moves no score, whatever the group's name occurs with in the training rows.

The sample is bounded by ``per_class`` documents of each label, and the weights by 2 ** HASH_BITS; class shares of the
labelled rows correct the intercept.  A fifth of the sample is kept out of training to calibrate scale and intercept.
Every document is scored, whole, in one pass without a shuffle.

Defined results: a null text is empty; a text without words gets the score of the intercept; with labels of one kind only,
or none, every score is 0 (label 1 is never seen) and nothing is rejected; repeated rows get equal scores; a null doc_id
counts as not held out; an empty table gives an empty result; other columns do not matter, and ``reject`` keeps them all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import labelled_sample, map_rows, training_row, whole_text

HASH_BITS = 18
TOXIC = 0.5
AT_ONCE = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
_BEGINNINGS = (4, 5, 6, 7)
#: Terms of one line may replace each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def word_features(word: str) -> list[int]:
    """Hash buckets of a lower-case word and of its beginnings."""
    mask = (1 << HASH_BITS) - 1
    parts = [word, *(word[:k] + "*" for k in _BEGINNINGS if len(word) > k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & mask for p in parts]


def size_of(count: int) -> float:
    """What counts are divided by: less than the number of words, and never small, so that short texts are not all noise."""
    return (count + 30) ** 0.85


def shares(words: list[str]) -> dict[int, float]:
    found: Counter[int] = Counter()
    for word, count in Counter(words).items():
        for f in word_features(word):
            found[f] += count
    n = size_of(len(words))
    return {f: c / n for f, c in found.items()}


def counterfactual(text: str, groups: tuple[tuple[str, ...], ...], pick: int) -> dict[int, float]:
    """Feature change of a sentence of ``text`` when an identity term is swapped, or put in if there is none."""
    sentences = [w for w in (WORD.findall(s.lower()) for s in SENTENCE.findall(text)) if len(w) >= 3]
    if not sentences or not groups:
        return {}
    of = {term: group for group in groups for term in group}
    words = next((s for s in sentences if any(w in of for w in s)), None)
    if words:
        at = next(i for i, w in enumerate(words) if w in of)
        others = [t for t in of[words[at]] if t != words[at]]
        changed = words[:at] + [others[pick % len(others)]] + words[at + 1 :] if others else words[:at] + words[at + 1 :]
    else:
        words = sentences[pick % len(sentences)]
        group = groups[pick % len(groups)]
        changed = [*words, group[pick // len(groups) % len(group)]]
    before, after = shares(words), shares(changed)
    terms = {f for w in set(words) ^ set(changed) for f in word_features(w)}
    return {f: after.get(f, 0.0) - before.get(f, 0.0) for f in terms}


class _WordWeights(dict):
    """Summed weights of a word's features, looked up once; forgets all when it gets large, so memory is bounded."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = float(self.weights[word_features(word)].sum())
        return value

    def __reduce__(self):
        return _WordWeights, (self.weights,)


@dataclass(frozen=True)
class Classifier:
    """``words`` gives the weight of a word; None if there was nothing to learn from."""

    words: _WordWeights | None
    intercept: float = 0.0

    def score(self, text: str) -> float:
        if self.words is None:
            return 0.0
        words = WORD.findall(text.lower())
        raw = self.intercept + sum(map(self.words.__getitem__, words)) / size_of(len(words))
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, raw)))))


class _Rows:
    """Sparse rows, flattened, of two list columns of equal shape; sums run in the order of the entries, AT_ONCE at a time."""

    def __init__(self, ids: pa.ChunkedArray, values: pa.ChunkedArray):
        self.n = len(ids)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.asarray(pc.list_value_length(ids)))
        self.col = np.asarray(pc.list_flatten(ids))
        self.val = np.asarray(pc.list_flatten(values))

    def _summed(self, to: np.ndarray, w: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i in range(0, len(to), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            np.add.at(out, to[some], self.val[some].astype(np.float64) * w[of[some]])
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._summed(self.row, w, self.col, self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return self._summed(self.col, g, self.row, size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: _Rows, y: np.ndarray, changes: _Rows, *, fairness: float, penalty: float, steps: int = 120) -> tuple[np.ndarray, float]:
    """Adam on logistic loss + penalty * |w|^2 / 2 + fairness * mean squared score change."""
    size = 1 << HASH_BITS
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        off = _sigmoid(rows.times(w) + b) - y
        slope = rows.back(off, size) / rows.n + penalty * w
        if changes.n:
            slope += fairness * 2 * changes.back(changes.times(w), size) / changes.n
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w -= 2.0 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        b -= 0.2 * off.mean()
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of ``z`` by weighted logistic regression; a scale that is not positive is replaced by 1."""
    x, p = np.stack((z, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        s = _sigmoid(x @ p)
        slope = x.T @ (weight * (s - y)) / weight.sum() + np.array([1e-4, 1e-4]) * p
        curve = (x * (weight * s * (1 - s))[:, None]).T @ x / weight.sum() + 1e-4 * np.eye(2)
        p = p - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    per_class: int = 3000,
    fairness: float = 10.0,
    penalty: float = 1e-6,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> Classifier:
    """Learn from the labelled rows whose id's checksum mod 5 is not 0."""
    sample = labelled_sample(docs, labels, "toxic", ~training_row(F.col("doc_id"), 5, 0), per_class)

    def described(cols: dict[str, list]) -> dict[str, list]:
        out = {n: cols[n] for n in ("doc_id", "label", "weight")} | {n: [] for n in ("ids", "vals", "c_ids", "c_vals")}
        for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
            own = shares(WORD.findall(text.lower()))
            change = counterfactual(text, groups, zlib.crc32(str(doc).encode()))
            out["ids"].append(list(own))
            out["vals"].append(list(own.values()))
            out["c_ids"].append(list(change))
            out["c_vals"].append(list(change.values()))
        return out

    schema = "doc_id long, label int, weight double, ids array<int>, vals array<float>, c_ids array<int>, c_vals array<float>"
    got = map_rows(sample, described, schema).toArrow().sort_by("doc_id")
    y = np.asarray(got["label"]).astype(np.float64)
    if len(set(y.tolist())) < 2:
        return Classifier(None)
    weight = np.asarray(got["weight"])
    aside = np.array([zlib.crc32(b"aside%d" % d) % 5 == 0 for d in got["doc_id"].to_pylist()])

    def part(where: np.ndarray, ids: str, vals: str) -> _Rows:
        some = got.filter(pa.array(where))
        return _Rows(some[ids], some[vals])

    if len(set(y[~aside].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside[:] = False
    changes = part(np.asarray(pc.list_value_length(got["c_ids"])) > 0, "c_ids", "c_vals")
    w, b = train(part(~aside, "ids", "vals"), y[~aside], changes, fairness=fairness, penalty=penalty)
    check = aside if aside.any() else ~aside
    scale, shift = calibrate(part(check, "ids", "vals").times(w) + b, y[check], weight[check])
    return Classifier(_WordWeights((scale * w).astype(np.float32)), scale * b + shift)


def _scored(docs: DataFrame, model: Classifier) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "score": [model.score(t) for t in cols["text"]]}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return map_rows(narrow, run, "doc_id long, score double")


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.coalesce(training_row(F.col("doc_id"), 5, 0), F.lit(False))
    return _scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` that are not toxic, every column as it was."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return texts.map(model.score)

    return docs.filter(toxicity(whole_text("text")) < TOXIC)
