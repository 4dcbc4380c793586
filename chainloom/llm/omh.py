"""Near-duplicate classes by order MinHash and banded alignment.

A text is the sequence of its lower-cased words.  Its five-word k-mers carry their occurrence number, so that repeats
count; each of SKETCHES sketches keeps the ORDER k-mers with the smallest hashes *in text order*, which makes a shared
sketch evidence for a small edit distance, not only for common words.  Texts sharing a sketch are candidates; a banded
alignment of their words decides: they are linked if 1 - edits / longer length is at least 0.8.  Classes are the
connected components of the links.

With ORDER = 3 and SKETCHES = 24 a pair whose k-mers overlap by 0.8 (Jaccard) is missed with probability 4e-8, by 0.6 with
0.3 %.  Edits spread over the text leave fewer k-mers whole, so the smallest k-mers of the first SINGLES sketches are keys of
their own: they are shared with a probability equal to the overlap, not to its third power.

Every pair that shares a sketch and is in different classes is decided: by its lengths, by its words or by alignment.  A text
keeps one bit a bin of occurrence-labelled words, whether the bin holds an odd number, in four to eight bins a word.  A replaced
word turns at most two of them, an added or lost one at most one, and a pair needs as many of the latter as its lengths differ: a
pair with more bits apart than twice the edits allowed less that difference cannot be similar; no similar pair is dropped.
Bins are a power of two, so the bits of a longer text fold to those of a shorter one.

Skew.  Equal texts are one node from the start (aggregated map-side).  Every node is first aligned with one other, the
first node of its buckets, then with the first node of each large bucket, then in TURNS turns with the nearest node of another
class, by these bits, that it meets in a cell of a large bucket: one pair a node and turn.  Most groups of copies are one class
after that, also where few of their members are similar to each other, and only pairs of different classes are looked at
again: all pairs in every bucket.  Buckets of more than SMALL nodes that hold mostly the same nodes, as those of one passage do,
form a group, in which a node is one row and not one a bucket; pairs that share no key are passed over there.  Groups are split
by length and dealt into cells of about CELL nodes; pairs of cells are compared in one task each and only pairs that the bits
leave open become rows.  The comparisons still grow with the square of the texts that share a passage and a length.

Defined results: a null text is empty; texts without any word are copies only of equal texts; texts of fewer than five
words have one k-mer, all their words; repeated rows fall in one class; a class is named by its smallest doc_id; null
doc_ids keep their row and count as larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, unused, whole_text
from chainloom.operators.storage import materialise

K = 5
ORDER = 3
SKETCHES = 24
SIMILARITY = 0.8
SINGLES = 12
LEAST_BINS, MOST_BINS = 512, 1 << 14
SMALL = 24
CELL = 2048
TURNS, TURN_KEYS = 2, 4  # each turn takes one of so many parts of the keys
BROADCAST_ROWS = 200_000  # of 32 bytes
PAIRS_AT_ONCE = 512
WORD = re.compile(r"\w+")
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, size=(2, SKETCHES), dtype=np.uint64)
_XOR, _ODD = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it gets large, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers, each with how often it occurred before."""
    k = min(k, len(words))
    kmers = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        kmers = kmers * _STEP + words[i : len(words) - k + 1 + i]
    kmers = _mixed(kmers)
    ordered = np.sort(kmers)
    if not (ordered[1:] == ordered[:-1]).any():
        return kmers
    order = np.argsort(kmers, kind="stable")
    kmers[order] = _labelled(ordered)
    return kmers


def _labelled(ordered: np.ndarray) -> np.ndarray:
    """Sorted hashes, each with how often it occurred before."""
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.arange(len(ordered))
    earlier = place - np.maximum.accumulate(np.where(first, place, 0))
    again = ~first  # a first occurrence keeps its hash, so that texts with and without repeats have it in common
    ordered[again] = _mixed(ordered[again] + earlier[again].astype(np.uint64) * _STEP)
    return ordered


def _smallest(v: np.ndarray, take: int) -> np.ndarray:
    """Columns of the ``take`` smallest values of every row."""
    left, rows, out = v.copy(), np.arange(len(v)), np.empty((len(v), take), np.int64)
    for j in range(take):
        out[:, j] = left.argmin(axis=1)
        left[rows, out[:, j]] = np.uint64((1 << 64) - 1)
    return out


def sketch(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketches, then of the smallest k-mers of the first SINGLES of them; and the bits of the words."""
    kmers = labelled_kmers(words)
    take = min(ORDER, len(kmers))
    keys, low = np.zeros(SKETCHES, np.uint64), np.zeros(SKETCHES, np.uint64)
    step = max(1, 2_000_000 // len(kmers))
    for s in range(0, SKETCHES, step):
        v = (kmers ^ _XOR[s : s + step, None]) * _ODD[s : s + step, None]
        at = _smallest(v, take)
        low[s : s + step] = np.take_along_axis(v, at, 1).min(axis=1)
        at.sort(axis=1)
        chosen = kmers[at]
        for j in range(take):
            keys[s : s + step] = keys[s : s + step] * _STEP + chosen[:, j]
    keys = np.r_[keys, low[:SINGLES]]
    return _mixed(keys + np.arange(1, len(keys) + 1, dtype=np.uint64) * _STEP), word_bits(words)


def word_bits(words: np.ndarray) -> bytes:
    """A bit for every bin of words, each with how often it occurred before: whether the bin's number is odd."""
    bins = min(max(LEAST_BINS, 1 << (4 * len(words)).bit_length()), MOST_BINS)
    labelled = _labelled(np.sort(_mixed(words))) if len(words) else words
    number = np.bincount((_mixed(labelled) & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((number & 1).astype(np.uint8)).tobytes()


def _folded(rows: Sequence[bytes]) -> np.ndarray:
    """The bits of all rows, in as many bins as the row of the fewest has."""
    width = min(map(len, rows)) // 8
    out = np.empty((len(rows), width), np.uint64)
    for i, row in enumerate(rows):
        bits = np.frombuffer(row, np.uint64)
        while len(bits) > width:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        out[i] = bits
    return out


def _apart_by_bits(bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits ^ others).sum(axis=-1, dtype=np.int64)


def _allowed(longest: np.ndarray) -> np.ndarray:
    """Edits that leave texts of so many words similar."""
    return (longest * (1 - SIMILARITY) + 1e-9).astype(np.int64)


def _most_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which similar texts of so many words may differ."""
    return 2 * _allowed(np.maximum(a, b)) - np.abs(a - b)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of both, repeats counted."""
    both = np.concatenate((a & ~np.uint64(1), b | np.uint64(1)))  # the last bit tells the side
    both.sort()
    word = both >> np.uint64(1)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(both) else np.zeros(0, np.int64)
    of_b = np.add.reduceat((both & np.uint64(1)).astype(np.int64), starts) if len(both) else starts
    return int(np.minimum(of_b, np.diff(np.r_[starts, len(both)]) - of_b).sum())


def _banded(pairs: Sequence[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of word sequences; exact where the result is at most ``band``.  All pairs advance row by row."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, width, far = int(n.max()), 2 * band + 1, 1 << 29
    a = np.zeros((len(pairs), rows), np.uint64)
    b = np.zeros((len(pairs), rows + width), np.uint64)  # b[j] of a pair at column j + band; outside: no word
    for p, (x, y) in enumerate(pairs):
        a[p, : len(x)] = x | np.uint64(1)
        y = y[: rows + band]
        b[p, band : band + len(y)] = y | np.uint64(1)
    k = np.arange(width, dtype=np.int32)
    d = np.broadcast_to(np.where(k >= band, k - band, far).astype(np.int32), (len(pairs), width)).copy()
    out = np.where(np.abs(m - n) <= band, far, band + 1)
    ends: dict[int, list[int]] = {}
    for p, length in enumerate(n.tolist()):
        if abs(int(m[p]) - length) <= band:
            ends.setdefault(length, []).append(p)
    for i in range(rows + 1):
        if i:
            step = d + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
            np.minimum(step[:, :-1], d[:, 1:] + 1, out=step[:, :-1])
            d = np.minimum.accumulate(step - k, axis=1) + k
        for p in ends.get(i, ()):
            out[p] = d[p, m[p] - i + band]
    return out


def similarities(pairs: Sequence[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> list[float]:
    """1 - edits / longer length of every pair, 0 where that is below ``least``."""
    found, todo = [0.0] * len(pairs), []
    for p, (a, b) in enumerate(pairs):
        longest, short = max(len(a), len(b)), min(len(a), len(b))
        allowed = int(longest * (1 - least) + 1e-9)
        if longest - short > allowed or not longest:
            continue
        same = np.flatnonzero(a[:short] != b[:short])
        if not len(same):
            found[p] = short / longest
            continue
        head = int(same[0])
        tail = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
        cut = int(tail[0]) if len(tail) else short - head
        x, y = a[head : len(a) - cut], b[head : len(b) - cut]
        if max(len(x), len(y)) - _common(x, y) <= allowed:
            todo.append((p, x, y, longest, allowed))
    band = 16
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        later, start = [], 0
        while start < len(todo):
            end = start + 1
            while end < len(todo) and (len(todo[end][1]) <= 2 * len(todo[start][1]) + 64) and (end - start) * (
                len(todo[end][1]) + 2 * band
            ) < 400_000:
                end += 1
            part = todo[start:end]
            for item, edits in zip(part, _banded([(x[1], x[2]) for x in part], band).tolist(), strict=True):
                p, _, _, longest, allowed = item
                if edits <= min(band, allowed):
                    found[p] = 1 - edits / longest
                elif band < allowed:
                    later.append(item)
            start = end
        todo, band = later, band * 4
    return found


_ROWS = "doc_id long, digest binary, words int, keys array<long>, bits binary"


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": cols["doc_id"], "digest": cols["digest"], "words": [], "keys": [], "bits": []}
        for text in cols["text"]:
            words = word_hashes(text)
            keys, bits = sketch(words) if len(words) else (np.zeros(0, np.uint64), word_bits(words))
            out["words"].append(len(words))
            out["keys"].append(keys.view(np.int64))
            out["bits"].append(bits)
        return out

    return map_rows(_with_digest(docs, id_col, text_col), run, _ROWS)


def _with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def _few(df: DataFrame) -> DataFrame:
    """``df``, written; sent to every task if it has at most BROADCAST_ROWS rows."""
    df = materialise(df, "omh-wanted")
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose alignment is similar enough."""

    def side(c: str) -> DataFrame:
        names = ("node", c), ("words", f"words_{c}"), ("bits", f"bits_{c}")
        return nodes.select(*[F.col(x).alias(y) for x, y in names])

    def possible(cols: dict[str, list]) -> dict[str, list]:
        most = _most_apart(np.array(cols["words_a"]), np.array(cols["words_b"]))
        apart = (_apart_by_bits(*_folded(pair)) for pair in zip(cols["bits_a"], cols["bits_b"], strict=True))
        left = [i for i, n in enumerate(apart) if n <= most[i]]
        return {c: [cols[c][i] for i in left] for c in ("a", "b")}

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("words_a", "words_b") >= F.greatest("words_a", "words_b") * SIMILARITY)
    both = map_rows(both, possible, "a long, b long", PAIRS_AT_ONCE)
    both = materialise(both, "omh-candidates")
    wanted = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    wanted = wanted.join(nodes.select("node", F.col("digest").alias("of"), F.col("doc_id").alias("want")), "node")
    source = _with_digest(docs, id_col, text_col)
    texts = source.join(_few(wanted), (F.col("of") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("want")))
    texts = materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "omh-texts")
    full = both.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    full = full.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def align(cols: dict[str, list]) -> dict[str, list]:
        words = {text: word_hashes(text) for c in ("text_a", "text_b") for text in set(cols[c])}
        pairs = [(words[x], words[y]) for x, y in zip(cols["text_a"], cols["text_b"], strict=True)]
        return {"a": cols["a"], "b": cols["b"], "similarity": similarities(pairs)}

    aligned = map_rows(full.select("a", "b", "text_a", "text_b"), align, "a long, b long, similarity double", PAIRS_AT_ONCE)
    return aligned.filter(F.col("similarity") >= SIMILARITY).select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that no chain of links joins yet."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).drop("label_a", "label_b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of every node that has a link."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "omh-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
        seen = seen.groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = step.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = materialise(step, "omh-labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.filter("label != new").isEmpty():
            return labels


def _hits(postings: DataFrame) -> DataFrame:
    """(node, words, buckets): key, size and rep, the smallest node, of a node's buckets of two nodes or more; a row for each node in one."""
    buckets = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("rep")).filter("size > 1")
    met = F.collect_list(F.struct("key", "size", "rep")).alias("buckets")  # at most one for each of the node's keys
    return materialise(postings.join(buckets, "key").groupBy("node").agg(F.first("words").alias("words"), met), "omh-hits")


def _first_stars(hits: DataFrame) -> DataFrame:
    """One pair (a, b) a node b: with the first node of its buckets."""
    return hits.select(F.array_min("buckets.rep").alias("a"), F.col("node").alias("b")).filter("a <> b")


def _large_stars(hits: DataFrame) -> DataFrame:
    """The pairs (a, b) of each node b with the first nodes of its large buckets."""
    large = F.filter("buckets", lambda k: (k["size"] > SMALL) & (k["rep"] != F.col("node")))
    return hits.select(F.explode(F.array_distinct(large["rep"])).alias("a"), F.col("node").alias("b"))


def _with_label(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, words, label, key, size, rep) of every hit.  The label is joined to a node's one row, before that becomes a row a bucket."""
    marked = hits.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return marked.select("node", "words", "label", F.explode("buckets").alias("bucket")).select("node", "words", "label", "bucket.*")


def _small_pairs(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes in buckets of at most SMALL nodes."""
    marked = _with_label(hits, labels).filter(F.col("size") <= SMALL)
    left = marked.select(F.col("key").alias("key_a"), F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = marked.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("label").alias("label_b"))
    return left.join(right, F.expr("key_a = key_b AND a < b AND label_a <> label_b")).select("a", "b")


def _grouped(marked: DataFrame) -> DataFrame:
    """(key, node, label, words, keys) of (key, size, node, label, words): ``key`` names a group of buckets, ``keys`` are the node's in it.

    Texts that quote a passage meet in most buckets of its k-mers.  A bucket joins the group of the bucket that is the largest one for
    most of its nodes, so that a node is there once and not in every bucket; what pairs are met is left to ``keys``.  A group that
    would compare more pairs than its buckets by themselves is left as these.
    """
    largest = F.max(F.struct("size", "key"))["key"].alias("largest")
    buckets = F.collect_list(F.struct("key", "size")).alias("buckets")  # at most one for each of the node's keys
    of_node = marked.groupBy("node").agg(F.first("label").alias("label"), F.first("words").alias("words"), largest, buckets)
    of_node = materialise(of_node, "omh-bands")
    postings = of_node.select("node", "label", "words", "largest", F.explode("buckets").alias("bucket")).select("*", "bucket.*").drop("bucket")
    most = postings.groupBy("key", "largest").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "largest"))["largest"].alias("group"))
    met = postings.join(most, "key").groupBy("group", "node").agg(
        F.first("label").alias("label"), F.first("words").alias("words"), F.collect_list("key").alias("keys"), F.sum("size").alias("met")
    )
    met = materialise(met, "omh-groups")
    wide = met.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("met").alias("pairs")).filter("n * n > pairs").select("group", F.lit(True).alias("wide"))
    alone = F.transform("keys", lambda k: F.struct(F.xxhash64(k).alias("key"), F.array(k).alias("keys")))  # not the name of a group
    parts = F.when(F.col("wide"), alone).otherwise(F.array(F.struct(F.col("group").alias("key"), "keys")))
    return met.join(wide, "group", "left").select("node", "label", "words", F.explode(parts).alias("part")).select("part.key", "node", "label", "words", "part.keys")


def _banded_buckets(hits: DataFrame, labels: DataFrame, cell: int, turn: int | None = None) -> DataFrame:
    """(key, node, label, words, keys, own, band, cells) of the nodes in groups of buckets of several classes, by bands of length.

    With ``turn`` only that turn's part of the buckets is taken.
    """
    marked = _with_label(hits, labels).filter(F.col("size") > SMALL).drop("rep")
    if turn is not None:
        marked = marked.filter(F.pmod("key", F.lit(TURN_KEYS)) == turn)
    mixed = marked.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one != two").select("key")
    marked = _grouped(marked.join(mixed, "key"))
    # Lengths of similar texts are at most one step apart: they meet in the upper one's band, and as equals in their own.
    band = F.floor(F.log("words") / math.log(1 / SIMILARITY + 1e-6)).cast("int")
    marked = marked.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    cells = marked.groupBy("key", "band").agg(
        F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"), F.max("own").alias("top"), F.min(F.when(F.col("own") == F.col("band"), F.col("words"))).alias("least"),
        F.min("label").alias("one"), F.max("label").alias("two"),
    )
    met = marked.join(cells.filter("top = band AND one != two").select("key", "band", "cells", "least"), ["key", "band"])
    # a text of the band below that is too short for the band's shortest is too short for all of it
    return met.filter(F.col("words") >= F.col("least") * SIMILARITY).drop("least")


def _nearest_pairs(hits: DataFrame, nodes: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) a node at most: with the nearest node of another class in its cells of this turn's large buckets."""
    dealt = _banded_buckets(hits, labels, CELL // 4, turn)
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("cells")).cast("int"))
    dealt = dealt.select("key", "band", "cell", "node", "label", "words", "keys").join(nodes.select("node", "bits"), "node")

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["words", "node"])
        words, bits, labels, node = part["words"].to_numpy(), _folded(part["bits"]), part["label"].to_numpy(), part["node"].to_numpy()
        keys = list(map(frozenset, part["keys"]))
        starts, ends = np.searchsorted(words, words * SIMILARITY), np.searchsorted(words * SIMILARITY, words, side="right")
        out: dict[str, list] = {"a": [], "b": [], "apart": []}
        for x in range(len(words)):
            y = np.arange(starts[x], ends[x])
            y = y[labels[y] != labels[x]]
            apart = _apart_by_bits(bits[y], bits[x])
            fits = np.flatnonzero(apart <= _most_apart(words[y], words[x]))
            for z in fits[np.argsort(apart[fits], kind="stable")].tolist():
                if not keys[x].isdisjoint(keys[y[z]]):
                    out["a"].append(node[x])
                    out["b"].append(node[y[z]])
                    out["apart"].append(apart[z])
                    break
        return pd.DataFrame(out, dtype="int64")

    near = dealt.groupBy("key", "band", "cell").applyInPandas(nearest, "a long, b long, apart long")
    near = near.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_pairs(hits: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes in larger buckets whose lengths and words allow them to be similar."""
    dealt = _banded_buckets(hits, labels, CELL).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("key", "band", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "own", "node", "label", "words", "keys")
    dealt = dealt.join(nodes.select("node", "bits"), "node")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("words", kind="stable")
        words, own, cell = (part[c].to_numpy() for c in ("words", "own", "cell"))
        bits = _folded(part["bits"])
        labels, across = part["label"].factorize()[0], part["i"].iloc[0] != part["j"].iloc[0]
        band, node, keys = int(part["band"].iloc[0]), part["node"].tolist(), list(map(frozenset, part["keys"]))
        ends = np.searchsorted(words * SIMILARITY, words, side="right")
        out: dict[str, list] = {"a": [], "b": []}
        for x in range(len(words)):
            y = np.arange(x + 1, ends[x])
            fits = (labels[y] != labels[x]) & ((own[y] == band) | (own[x] == band))
            y = y[fits & (cell[y] != cell[x])] if across else y[fits]
            y = y[_apart_by_bits(bits[y], bits[x]) <= _most_apart(words[y], words[x])]
            for z in y.tolist():
                if not keys[x].isdisjoint(keys[z]):
                    out["a"].append(min(node[x], node[z]))
                    out["b"].append(max(node[x], node[z]))
        return pd.DataFrame(out, dtype="int64")

    return dealt.groupBy("key", "band", "i", "j").applyInPandas(compare, "a long, b long")


def _joined(labels: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``labels`` after links between their classes: only the classes are walked again."""
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    for c in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
        links = links.withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    between = materialise(links.select("a", "b", "label_a", "label_b"), "omh-between")
    edges = between.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).filter("a != b").distinct()
    last = components(materialise(edges, "omh-classes")).select(F.col("node").alias("label"), F.col("label").alias("last"))
    known = between.select(F.col("a").alias("node"), F.col("label_a").alias("label")).union(between.select("b", "label_b"))
    known = known.union(labels.select("node", "label")).distinct()
    return known.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, label, class_id) of every row: the digest of its text, the number of its class and the class's name."""
    rows = materialise(_sketched(docs, id_col, text_col), "omh-rows")
    nodes = rows.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("words").alias("words"), F.first("keys").alias("keys"), F.first("bits").alias("bits")
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "omh-nodes")
    hits = _hits(nodes.select("node", "words", F.explode("keys").alias("key")))
    first = materialise(_first_stars(hits), "omh-stars")
    labels = components(materialise(_verified(first, nodes, docs, id_col, text_col), "omh-first"))
    large = _apart(_large_stars(hits), labels).join(first, ["a", "b"], "left_anti")
    large = materialise(large, "omh-large")
    labels = _joined(labels, [materialise(_verified(large, nodes, docs, id_col, text_col), "omh-second")])
    labels, tried = materialise(labels, "omh-labels"), first.union(large)
    for turn in range(TURNS):
        near = materialise(_nearest_pairs(hits, nodes, labels, turn).join(tried, ["a", "b"], "left_anti"), "omh-near")
        if near.isEmpty():
            break
        tried = tried.union(near)
        links = materialise(_verified(near, nodes, docs, id_col, text_col), "omh-linked")
        labels = materialise(_joined(labels, [links]), "omh-labels")
    pairs = _small_pairs(hits, labels).union(_large_pairs(hits, nodes, labels)).distinct()
    pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "omh-pairs")
    labels = _joined(labels, [materialise(_verified(pairs, nodes, docs, id_col, text_col), "omh-more")])

    named = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named, "omh-named")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = named.join(smallest, "label").select("digest", "label", "class_id")
    return rows.select("doc_id", "digest").join(classes, "digest").select("doc_id", F.col("digest").alias("node"), "label", "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, one row of each class: the one of its smallest doc_id."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col)
    best = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = F.min(F.struct("node")).alias("_best")
    first = best.groupBy("label").agg(chosen).select("label", F.col("_best.node").alias("_node"))
    best = best.join(first, (best["label"] == first["label"]) & (best["node"] == first["_node"]))
    node, of_class, copies, digest = (unused(n, docs) for n in ("_node", "_class", "_rows", "_digest"))
    best = best.groupBy(F.col("_node").alias(node), F.col("class_id").alias(of_class)).agg(F.count(F.lit(1)).alias(copies))
    marked = docs.withColumn(digest, F.unhex(F.md5(whole_text(text_col))))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(of_class)) & (F.col(digest) == F.col(node))
    kept = marked.join(best, same).drop(of_class, node)
    once = kept.filter(F.col(copies) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = kept.filter(F.col(copies) > 1).dropDuplicates([id_col, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(repeated)
