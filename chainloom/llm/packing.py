"""Best-fit packing with bound-certified repacking.

Documents become token pieces once; from then on only (id, length, checksum) rows travel.  Pieces are dealt evenly into
parts by hash of a row number that was written with them, and every part is packed best-fit decreasing in its own task.
Dual feasible functions bound the number of sequences from below, for each part and, by the histogram of all lengths, for
the whole table.  While the table is above its bound, documents are exchanged: a part above its own bound gives all but its
full sequences, and a part that meets it gives its emptiest one (each part rounds its bound up, so the parts together can be
above that of the table).  What they give is dealt anew under another hash, to fewer parts, and packed again.  A round counts
only if it needs fewer sequences than before.  Rounding costs less than a sequence a part, and each round has about a
thousandth of the parts of the one before.

A part holds about PART_ITEMS pieces, whatever the size of the corpus.  Only histograms of piece lengths (at most ``limit``
rows) come to the driver.

Defined results: a null or empty text is one piece that holds the end token alone; repeated rows are separate pieces; an
empty table gives an empty result; other columns of the input are left out, so no name clashes.
"""

from __future__ import annotations

import array
import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, whole_text
from chainloom.operators.storage import materialise

PART_ITEMS = 2000
LEAST_PARTS = 4
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", item long, part long, bin long, offset long, loose boolean"


@lru_cache(maxsize=4)
def encoder(ranks: str, tokenizer: str | None = None):
    """``text -> list of ids`` of a byte-level vocabulary given as a rank file.

    The library's own tokenizer file and the rank file hold the same vocabulary and give the same ids (tested).  The
    look-ahead of the splitting pattern matters only behind runs of white space, so texts without such runs take a pattern
    that the regex engine runs without backtracking.  The tokenizer file lists added tokens, whose strings it recognises in
    any text; texts are split there first.
    """
    import re

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    simple = r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
    single = tiktoken.Encoding("single", pat_str=simple, mergeable_ranks=merges, special_tokens={})
    run = re.compile(r"\s\s")
    added = _added_tokens(public_tokenizers.path(tokenizer)) if tokenizer else {}
    border = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(text: str) -> list[int]:
        return (whole if run.search(text) else single).encode_ordinary(text)

    def encode(text: str) -> list[int]:
        parts = border.split(text) if border else [text]
        if len(parts) == 1:
            return plain(text)
        return [i for p in parts if p for i in ([added[p]] if p in added else plain(p))]

    return encode


def _added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def cut(count: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``count`` tokens; only the first may be shorter than ``limit``."""
    if count <= limit:
        return [(0, count)]
    first = count % limit
    starts = ([0] if first else []) + list(range(first, count, limit))
    return [(s, first if s == 0 and first else limit) for s in starts]


def pieces(docs: DataFrame, *, limit: int, end_id: int, ranks: str, tokenizer: str | None, id_col: str, text_col: str) -> DataFrame:
    """One row per piece.  ``item`` numbers the rows as they are written, so that equal rows can be dealt apart."""

    def tokenise(cols: dict[str, list]) -> dict[str, list]:
        encode, out = encoder(ranks, tokenizer), {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = array.array("I", encode(text))
            ids.append(end_id)
            raw = np.asarray(ids, dtype="<u4")
            for k, (start, length) in enumerate(cut(len(raw), limit)):
                out["doc_id"].append(doc)
                out["piece"].append(k)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(raw[start : start + length].tobytes()))
        return out

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_rows(narrow, tokenise, _PIECES).withColumn("item", F.monotonically_increasing_id())


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the room left in every bin.  Ties go to the earlier item and the newer bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rooms, room = 0, []  # bit r of open_rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = open_rooms >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(room), limit
            room.append(limit)
        bins[i], offsets[i] = b, limit - r
        room[b] = r - need
        by_room[r - need].append(b)
        open_rooms |= 1 << (r - need)
    return bins, offsets, np.array(room, np.int64)


def bins_needed(counts: np.ndarray, limit: int) -> int:
    """Lower bound on the bins for ``counts[x]`` items of length x, x from 0 to ``limit``, by dual feasible functions."""
    x = np.arange(limit + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    total, most = x * counts, 0
    for k in range(limit // 2 + 1):  # lengths above limit - k fill a bin, lengths below k vanish
        filled = int(counts[limit - k + 1 :].sum()) * limit + int(total[k : limit - k + 1].sum())
        most = max(most, -(-filled // limit))
    for k in range(1, 21):  # lengths rounded down to multiples of limit / k, at k + 1 steps
        scaled = np.where((k + 1) * x % limit == 0, k * x, (k + 1) * x // limit * limit)
        most = max(most, -(-int((scaled * counts).sum()) // (k * limit)))
    return most


def _pack_parts(items: DataFrame, limit: int, seed: int, parts: int) -> DataFrame:
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", kind="stable")
        lengths = part["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, limit)
        gap = len(room) - bins_needed(np.bincount(lengths, minlength=limit + 1), limit)
        loose = room > 0 if gap > 0 else (room > 0) & (np.arange(len(room)) == room.argmax())
        return part.assign(bin=bins, offset=offsets, loose=loose[bins])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, _PLACED)


def _bins(placed: DataFrame) -> int:
    return placed.agg(F.sum((F.col("offset") == 0).cast("long"))).first()[0] or 0


def pack(
    docs: DataFrame,
    *,
    limit: int = 1024,
    end_id: int = 2,
    ranks: str = "byte_bpe_50k.tiktoken",
    tokenizer: str | None = "byte_bpe_50k.json",
    rounds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut_up = materialise(
        pieces(docs, limit=limit, end_id=end_id, ranks=ranks, tokenizer=tokenizer, id_col=id_col, text_col=text_col), "pack-pieces"
    )
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    alone = cut_up.filter(F.col("length") >= limit).withColumn("offset", F.lit(0).cast("long"))
    done = [alone.withColumn("sequence_id", F.col("item") * 8).select(*columns)]  # of pieces: multiples of 8

    def number(placed: DataFrame, turn: int) -> DataFrame:  # of bins: the turn in the last three bits
        return placed.withColumn("sequence_id", ((F.col("part") * (1 << 24) + F.col("bin")) * 8 + turn)).select(*columns)

    def lengths(items: DataFrame) -> np.ndarray:
        found = np.zeros(limit + 1, np.int64)
        for length, n in items.groupBy("length").count().collect():  # at most ``limit`` rows
            found[length] = n
        return found

    rest = cut_up.filter(F.col("length") < limit)
    histogram = lengths(rest)
    bound = bins_needed(histogram, limit)
    placed = materialise(_pack_parts(rest, limit, 0, max(LEAST_PARTS, -(-int(histogram.sum()) // PART_ITEMS))), "pack-round-0")
    settled, turn = 0, 1
    for seed in range(1, rounds + 1):
        if settled + _bins(placed) <= bound:
            break
        loose = placed.filter("loose")
        histogram, before = lengths(loose), _bins(loose)
        if before <= bins_needed(histogram, limit):
            break
        items = loose.select("doc_id", "piece", "start", "length", "ids_crc32", "item")
        again = materialise(_pack_parts(items, limit, seed, max(1, -(-int(histogram.sum()) // PART_ITEMS))), f"pack-round-{seed}")
        if _bins(again) >= before:
            continue
        settled += _bins(placed) - before
        done.append(number(placed.filter("NOT loose"), turn))
        placed, turn = again, turn + 1
    done.append(number(placed, turn))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
