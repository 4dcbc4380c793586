"""Online packing by sums of squares, for documents that may be cut.

Each task reads its documents once, in order.  A document longer than a window first fills whole windows; what is left goes
into the fill level for which the sum of squared counts of partially filled windows grows least (level 0 is a new window,
ties go to the fullest level).  The level array ``counts`` is all the choice looks at; beside it every level has a stack of
its open windows.  A window is emitted when it is full.

When the input of a task ends, or its open windows hold more than ``held`` tokens, they are closed: from the emptiest on,
their tokens are cut to fill the gaps of the fullest.  One window less than full stays; at the end of the input it is cut
into windows whose lengths are the powers of two that add up to it, which need no padding.  So no token is padded, most
documents stay whole, and a task adds at most log2(limit) short windows.

Memory of a task: a few megabytes of text, ``held`` token ids, a bounded cache of encoded words.  There is no shuffle; a
lost task repeats itself alone, because the numbers of its windows hold its partition and meet no other task's.

Text is encoded by stretches between ASCII white space: the tokenizer drops white space and no token spans it, so the ids
are those of the whole text (tested), and encoded stretches can be cached.

Defined results: a null or empty text is one piece that holds the end token alone; repeated rows are packed each; an id may
be null; an empty table gives an empty result; other columns are not read, so no name clashes.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import whole_text

HELD_TOKENS = 4_000_000
CACHE_BYTES, TEXT_BYTES = 192 << 20, 4 << 20
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS)


#: Stretches of these characters are normal forms already, and their words and marks are what ``WORDS`` finds.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b != ord(" ")}


class Encoder:
    """Lists of UTF-8 texts to lists of ids, as unsigned 32-bit little-endian bytes, of a tokenizer file with word ends.

    Unknown words of plain stretches are encoded many at a time by the model of the file alone; the token that ends a word
    shows where the next begins.  Every other stretch goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters = byte_letters()
        self.stretches: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.used = 0

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing below makes cycles, and the collector would walk all words again and again
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        if self.used > CACHE_BYTES:  # keep what these texts hold more than once
            seen: set[bytes] = set()
            often = {w for words in split for w in words if w in seen or seen.add(w)}
            self.stretches = {w: self.stretches[w] for w in often if w in self.stretches}
            self.known = {p: self.known[p] for p in {w.decode("utf-8", "replace").lower() for w in often} if p in self.known}
            self.used = 200 * (len(self.stretches) + len(self.known))
        self._learn({w for words in split for w in words}.difference(self.stretches))
        return [b"".join(map(self.stretches.__getitem__, words)) for words in split]

    def _learn(self, new: set[bytes]) -> None:
        plain, other = [], []
        for w in new:
            s = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(s) and "<|" not in s:
                plain.append((w, WORDS.findall(s.lower())))
            else:
                other.append((w, s))
        unknown = {p for _, parts in plain for p in parts}.difference(self.known)
        self._learn_words([p for p in unknown if p.isascii()])
        self._learn_words([p for p in unknown if not p.isascii()])
        known, stretches = self.known, self.stretches
        for w, parts in plain:
            stretches[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        for w, s in other:
            stretches[w] = np.asarray(self.whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        self.used += sum(150 + 4 * len(w) for w in new)

    def _learn_words(self, new: list[str]) -> None:
        for first in range(0, len(new), 512):
            part = new[first : first + 512]
            joined = " ".join(part)
            if not joined.isascii():
                joined = joined.encode().decode("latin-1").translate(self.letters)
            ids = np.asarray(self.words.encode(joined, add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[i:j] for i, j in zip([0, *stops], stops)], strict=True))
        self.used += sum(150 + 4 * len(p) for p in new)


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(tokenizer))


class Piece(NamedTuple):
    doc: int | None
    start: int
    ids: bytes
    of: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The first ``at`` ids and the rest."""
        return self._replace(ids=self.ids[: 4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at :])


class Windows:
    """The open windows of a task by fill level, and the pieces of finished ones in ``done``."""

    def __init__(self, limit: int, first_number: int = 0):
        self.limit, self.number, self.held = limit, first_number, 0
        self.stacks: list[list[list[Piece]]] = [[] for _ in range(limit)]
        self.counts = np.zeros(limit + 1, np.int64)
        self.leave = np.full(limit + 1, 1 << 40, np.int64)  # growth of the sum of squares when a window leaves the level
        self.leave[0] = 0
        self.enter = np.ones(limit + 1, np.int64)  # and when one enters it
        self.enter[limit] = 0
        self.done: dict[str, list] = {c: [] for c in _COLUMNS}

    def add(self, doc: int | None, ids: bytes) -> None:
        rest = Piece(doc, 0, ids, len(ids) // 4)
        while rest.length >= self.limit:
            whole, rest = rest.cut(self.limit)
            self._emit([whole])
        if rest.length:
            level = self.level_for(rest.length)
            self.held += rest.length
            self._put(level + rest.length, [*self._take(level), rest] if level else [rest])

    def level_for(self, need: int) -> int:
        """The level whose window should take ``need`` more tokens; 0 for a new window."""
        growth = self.leave[: self.limit - need + 1] + self.enter[need:]
        return len(growth) - 1 - int(growth[::-1].argmin())

    def _count(self, level: int, by: int) -> None:
        n = self.counts[level] = self.counts[level] + by
        self.leave[level] = 1 - 2 * n if n else 1 << 40
        self.enter[level] = 1 + 2 * n

    def _take(self, level: int) -> list[Piece]:
        self._count(level, -1)
        return self.stacks[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        if level == self.limit:
            self.held -= level
            self._emit(window)
        else:
            self._count(level, 1)
            self.stacks[level].append(window)

    def _emit(self, window: list[Piece]) -> None:
        offset = 0
        for p in window:
            row = (p.doc, p.start, p.length, zlib.crc32(p.ids), p.of, self.number, offset)
            for column, value in zip(self.done.values(), row, strict=True):
                column.append(value)
            offset += p.length
        self.number += 1

    def close(self, last: bool) -> None:
        """Fill the fullest open windows with tokens of the emptiest; at the ``last`` time also cut up what remains."""
        windows = [w for stack in reversed(self.stacks) for w in stack]  # fullest first
        for level, stack in enumerate(self.stacks):
            if stack:
                self._count(level, -len(stack))
                stack.clear()
        self.held = 0
        while len(windows) > 1:
            full, donor = windows[0], windows[-1]
            gap = self.limit - sum(p.length for p in full)
            moved, kept = _from_end(donor, gap)
            windows[0] = full + moved
            if kept:
                windows[-1] = kept
            else:
                windows.pop()
            if sum(p.length for p in windows[0]) == self.limit:
                self._emit(windows.pop(0))
        for rest in windows:
            level = sum(p.length for p in rest)
            if level == self.limit:
                self._emit(rest)
            elif last:
                while rest:
                    part, rest = _from_end(rest, level & -level)
                    level &= level - 1
                    self._emit(part)
            else:
                self.held = level
                self._put(level, rest)

    def drain(self) -> dict[str, list]:
        done, self.done = self.done, {c: [] for c in _COLUMNS}
        return done


def _from_end(window: list[Piece], count: int) -> tuple[list[Piece], list[Piece]]:
    """The last ``count`` tokens of a window, or all it has, and what remains."""
    kept, moved = list(window), []
    while kept and count:
        piece = kept.pop()
        if piece.length > count:
            head, piece = piece.cut(piece.length - count)
            kept.append(head)
        moved.insert(0, piece)
        count -= piece.length
    return moved, kept


def pack(
    docs: DataFrame,
    *,
    limit: int = 2048,
    end_id: int = 1,
    tokenizer: str = "word_bpe_49k.json",
    held: int = HELD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        windows = Windows(limit, TaskContext.get().partitionId() << 40)

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in windows.drain().items()})

        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            for i, j in _slices(texts):
                for doc, tokens in zip(ids[i:j], encode(texts[i:j]), strict=True):
                    windows.add(doc, tokens + end)
                    if windows.held > held:
                        windows.close(last=False)
                yield finished()
        windows.close(last=True)
        yield finished()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, _SCHEMA)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``TEXT_BYTES`` together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TEXT_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
