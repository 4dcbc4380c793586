"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

The rules (e-mail, IP, card, phone) give the base spans.  They also label the training text: windows around digits and @ of
a bounded sample of documents, in which some spans are rewritten the way people write them when the rules do not match (a
bracketed "at", phone numbers without country code, other separators) and look-alikes (dates, versions, amounts) are put
in as negatives.  The network is trained in numpy.

At scan time every stretch of text near a digit, an @ or a bracketed "at" / "dot" / "." is cut into overlapping windows; no
span of the four kinds lies outside such stretches, so nothing else is decoded.  The windows' emissions are averaged, with
more weight to the middle of a window, and one Viterbi pass over the whole stretch reconciles them.  A span found this way
is added if it does not overlap a base span and the kind's own check (digit counts, Luhn, octets) holds.

The sample is bounded by ``documents`` and four windows of each; every document is scanned whole, in one pass without a
shuffle, in slices of bounded size.

Defined results: a null or empty text has no span; with no text to learn from only the base spans are reported; repeated
rows get equal results; an empty table gives an empty result; other columns are left out, so no name clashes.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import FOUND, bounded_sample, map_rows, whole_text

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE, MARGIN = 64, 32, 24
GATE = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot|\.)\s?[)\]}]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CHARS = 130

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small_octets(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fail the kind's check are dropped, not tried again."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += (("ip", *m.span()) for m in _IP.finditer(text) if small_octets(m[0].split(".")))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        found += (("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15)
    return found


def passes(kind: str, text: str) -> bool:
    """The check of a span that the network found."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", text)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+/-]", text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and small_octets(parts) and not re.search(r"[A-Za-z]", text)
    local, sign, domain = re.sub(r"\s*[(\[{]\s?at\s?[)\]}]\s*|\s*@\s*", "@", text).partition("@")
    domain = re.sub(r"\s*[(\[{]\s?(?:dot|\.)\s?[)\]}]\s*", ".", domain)
    return bool(sign) and bool(_LOCAL.match(local)) and bool(re.fullmatch(_DOMAIN.pattern, domain))


def encode(text: str) -> np.ndarray:
    """Character ids: ASCII as it is, one id for other letters, one for the rest."""
    return np.fromiter((ord(c) if c < "\x80" else 128 if c.isalpha() else 129 for c in text), np.int64, len(text))


def tags_of(spans: Iterable[Span], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[max(a, 0) : max(b, 0)] = k + 1
        if 0 <= a < size:
            out[a] = k
    return out


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, p: dict[str, np.ndarray], side: str) -> tuple[np.ndarray, list]:
    """Hidden states for character ids x (batch, time); what the backward pass needs."""
    table, wh = p["emb"] @ p["wx" + side] + p["b" + side], p["wh" + side]
    size = wh.shape[0]
    h = c = np.zeros((len(x), size), np.float32)
    states, kept = np.empty((x.shape[1], len(x), size), np.float32), []
    for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
        z = table[x[:, t]] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        before, old = h, c
        c = f * old + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[t] = h
        kept.append((t, i, f, o, g, before, old, squashed))
    return states, kept


def _lstm_back(x: np.ndarray, p: dict, side: str, kept: list, dstates: np.ndarray, grad: dict) -> None:
    wh = p["wh" + side]
    size = wh.shape[0]
    dh = dc = np.zeros((len(x), size), np.float32)
    dtable, dwh = np.zeros((_CHARS, 4 * size), np.float32), np.zeros_like(wh)
    for t, i, f, o, g, before, old, squashed in reversed(kept):
        dh = dh + dstates[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate((dc * g * i * (1 - i), dc * old * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)), axis=1)
        np.add.at(dtable, x[:, t], dz)
        dwh += before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    grad["wh" + side] = dwh
    grad["wx" + side] = p["emb"].T @ dtable
    grad["b" + side] = dtable.sum(axis=0)
    grad["emb"] = grad.get("emb", 0) + dtable @ p["wx" + side].T


def emissions(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Tag scores (batch, time, tag)."""
    both = np.concatenate((_lstm(x, p, "f")[0], _lstm(x, p, "r")[0]), axis=2)
    return (both @ p["wo"] + p["bo"]).transpose(1, 0, 2)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def crf_gradient(e: np.ndarray, y: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags y under emissions e (time, batch, tag) and transitions, with gradients."""
    times, n, _ = e.shape
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0]
    for t in range(1, times):
        ahead[t] = e[t] + _log_sum(ahead[t - 1][:, :, None] + step, 1)
    for t in range(times - 2, -1, -1):
        behind[t] = _log_sum(step + (e[t + 1] + behind[t + 1])[:, None, :], 2)
    whole = _log_sum(ahead[-1], 1)
    de = np.exp(ahead + behind - whole[None, :, None])
    dstep = np.zeros_like(step)
    for t in range(1, times):
        pair = ahead[t - 1][:, :, None] + step + (e[t] + behind[t])[:, None, :] - whole[:, None, None]
        dstep += np.exp(pair).sum(axis=0)
    rows = np.arange(n)
    gold = sum(e[t, rows, y[:, t]] for t in range(times)) + sum(step[y[:, t - 1], y[:, t]] for t in range(1, times))
    for t in range(times):
        de[t, rows, y[:, t]] -= 1
        if t:
            np.add.at(dstep, (y[:, t - 1], y[:, t]), -1)
    return float((whole - gold).mean()), (de / n).astype(np.float32), (dstep / n).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 20, width: int = 12, updates: int = 700, batch: int = 48, rate: float = 0.02) -> dict:
    rng = np.random.default_rng(5)
    p = {"emb": rng.normal(0, 0.3, (_CHARS, width)), "wo": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bo": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS))}
    for side in "fr":
        p["wx" + side] = rng.normal(0, 0.3, (width, 4 * hidden))
        p["wh" + side] = rng.normal(0, 0.2, (hidden, 4 * hidden))
        p["b" + side] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, turn = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    while turn < updates:
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            at = order[s : s + batch]
            xb, yb = x[at], y[at]
            sf, kf = _lstm(xb, p, "f")
            sr, kr = _lstm(xb, p, "r")
            both = np.concatenate((sf, sr), axis=2)
            _, de, dstep = crf_gradient(both @ p["wo"] + p["bo"], yb, p["step"])
            grad = {"step": dstep, "wo": np.einsum("tnh,tnk->hk", both, de), "bo": de.sum(axis=(0, 1))}
            dboth = de @ p["wo"].T
            _lstm_back(xb, p, "f", kf, dboth[:, :, :hidden], grad)
            _lstm_back(xb, p, "r", kr, dboth[:, :, hidden:], grad)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            turn += 1
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                now = rate * max(0.0, 1 - turn / (updates + 1))
                p[k] = (p[k] - now * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
    return p


def viterbi(e: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of one stretch, emissions (time, tag).  An inside tag only follows its own kind."""
    best, back = e[0].astype(np.float64), np.empty(e.shape, np.int8)
    best[2::2] -= 1e9
    for t in range(1, len(e)):
        reach = best[:, None] + step
        back[t] = reach.argmax(axis=0)
        best = reach.max(axis=0) + e[t]
    out = np.empty(len(e), np.int64)
    out[-1] = best.argmax()
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def legal_steps(step: np.ndarray) -> np.ndarray:
    out = step.astype(np.float64).copy()
    for k in range(2, TAGS, 2):
        allowed = np.isin(np.arange(TAGS), (k - 1, k))
        out[~allowed, k] -= 1e9
    return out


# Training text

_LOOK_ALIKES = (
    "2024-03-1{0}", "v{0}.{1}.{2}", "{0}{1},{2}00.50", "1{0}:3{1}", "{0}{1}%", "No. {0}{1}{2}{3}{0}", "{0}.{1}", "chapter {0}.{1}.{2}",
    "{0}{1}/{2}{3}/20{0}{1}", "ISBN 978-{0}-{1}{2}-{3}{0}{1}{2}{3}{0}-{1}", "id {0}{1}{2}{3}{0}{1}{2}", "user@home", "@{0}{1}abc", "{0}x{1}",
)


def rewritten(kind: str, span: str, rng: random.Random) -> str:
    """Another way to write the same thing."""
    if kind == "email":
        dot = rng.choice((".", "(dot)", " [dot] ", "[.]"))
        return rng.choice((" @ ", "(at)", " [at] ", " (at) ")).join((lambda a, _, b: (a, b.replace(".", dot)))(*span.partition("@")))
    digits = "".join(_DIGIT.findall(span))
    if kind == "ip":
        return span.replace(".", rng.choice(("[.]", "(.)", " . ")))
    if kind == "card":
        return rng.choice((".", "/", " - ")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(last[:3], last[3:6], last[6:])


def training_windows(text: str, seed: int, most: int = 4) -> list[tuple[str, list[int]]]:
    """Windows of a document with their tags; stretches whose digits merely look like a card are left out."""
    rng, spans, out = random.Random(seed), sorted(base_spans(text), key=lambda s: s[1]), []
    anchors = [m.start() for m in GATE.finditer(text)]
    rng.shuffle(anchors)
    used: list[int] = []
    for at in anchors:
        if len(out) >= most or any(abs(at - u) < WINDOW for u in used):
            continue
        used.append(at)
        own = [s for s in spans if s[1] - 8 <= at < s[2] + 8][:1]
        lo, hi = max(0, (own[0][1] if own else at) - rng.randrange(8, 30)), min(len(text), (own[0][2] if own else at) + 40)
        piece = text[lo:hi]
        marks = [(k, a - lo, b - lo) for k, a, b in spans if a < hi and b > lo]
        if any(luhn(d) is False for m in _CARD.finditer(piece) if 13 <= len(d := "".join(_DIGIT.findall(m[0]))) <= 19):
            continue
        if own and rng.random() < 0.5:
            kind, a, b = own[0][0], own[0][1] - lo, own[0][2] - lo
            new = rewritten(kind, piece[a:b], rng)
            piece, marks = piece[:a] + new + piece[b:], [(kind, a, a + len(new))]
            if any(s is not own[0] and s[1] < hi and s[2] > lo for s in spans):
                continue
        elif not own or rng.random() < 0.3:
            alike = rng.choice(_LOOK_ALIKES).format(*(rng.randrange(1, 10) for _ in range(4)))
            piece = f"{piece} {alike} "
        piece = piece[:WINDOW]
        out.append((piece, tags_of(marks, len(piece)).tolist()))
    return out


@dataclass(frozen=True)
class Tagger:
    """Trained parameters; None if there was no text to learn from."""

    params: dict[str, np.ndarray] | None

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """All spans of every text, base spans first."""
        base = [base_spans(t) for t in texts]
        if self.params is None:
            return base
        stretches = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches_of(t)]
        steps = legal_steps(self.params["step"])
        for start in range(0, len(stretches), 256):
            part = stretches[start : start + 256]
            for (i, a, b), scores in zip(part, self._scores([texts[i][a:b] for i, a, b in part]), strict=True):
                taken = [s[1:] for s in base[i] if s[1] < b and s[2] > a]
                for kind, x, y in spans_of(viterbi(scores, steps)):
                    x, y = trimmed(texts[i], x + a, y + a)
                    if x < y and passes(kind, texts[i][x:y]) and all(y <= p or x >= q for p, q in taken):
                        base[i].append((kind, x, y))
        return base

    def _scores(self, pieces: list[str]) -> list[np.ndarray]:
        """Emissions of whole stretches, averaged over overlapping windows."""
        at = [(k, s) for k, t in enumerate(pieces) for s in range(0, max(1, len(t) - STRIDE), STRIDE)]
        out = [np.zeros((len(t), TAGS)) for t in pieces]
        total = [np.zeros((len(t), 1)) for t in pieces]
        middle = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
        ids = [encode(t) for t in pieces]
        for first in range(0, len(at), 512):
            part = at[first : first + 512]
            x = np.full((len(part), WINDOW), 32, np.int64)
            for row, (k, s) in enumerate(part):
                chars = ids[k][s : s + WINDOW]
                x[row, : len(chars)] = chars
            for (k, s), e in zip(part, emissions(x, self.params), strict=True):
                size = min(WINDOW, len(ids[k]) - s)
                out[k][s : s + size] += e[:size] * middle[:size]
                total[k][s : s + size] += middle[:size]
        return [o / t for o, t in zip(out, total, strict=True)]


def stretches_of(text: str) -> list[tuple[int, int]]:
    """Merged neighbourhoods of everything that can be part of a span."""
    out: list[list[int]] = []
    for m in GATE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_of(tags: np.ndarray) -> list[Span]:
    out, start, kind = [], None, 0
    for i, tag in enumerate([*tags.tolist(), 0]):
        if start is not None and (tag % 2 == 1 or tag == 0 or (tag - 1) // 2 != kind):
            out.append((KINDS[kind], start, i))
            start = None
        if tag % 2 == 1:
            start, kind = i, (tag - 1) // 2
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \n\t,;:":
        a += 1
    while b > a and text[b - 1] in " \n\t,;:.-/":
        b -= 1
    return a, b


def fit(docs: DataFrame, *, documents: int = 1500, id_col: str = "doc_id", text_col: str = "text", **options) -> Tagger:
    """Train on windows of the ``documents`` with the smallest id hashes among those with a digit or an @."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ids = bounded_sample(narrow.filter(F.col("text").rlike("[0-9@]")).select("doc_id").distinct(), F.xxhash64("doc_id"), documents)

    def windows(cols: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "piece": [], "tags": []}
        for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
            for piece, tags in training_windows(text, zlib.crc32(str(doc).encode())):
                out["doc_id"].append(doc)
                out["piece"].append(piece)
                out["tags"].append(tags)
        return out

    got = map_rows(narrow.join(F.broadcast(ids), "doc_id"), windows, "doc_id long, piece string, tags array<int>").toArrow()
    rows = sorted(set(zip(got["piece"].to_pylist(), map(tuple, got["tags"].to_pylist()), strict=True)))
    if not rows:
        return Tagger(None)
    x, y = np.full((len(rows), WINDOW), 32, np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for i, (piece, tags) in enumerate(rows):
        x[i, : len(piece)], y[i, : len(tags)] = encode(piece), tags
    return Tagger(train(x, y, **options))


def scan(docs: DataFrame, model: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, stop, base), of every document; base is false where the network alone found it."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = []
        for text, spans in zip(cols["text"], model.spans(cols["text"]), strict=True):
            rules = set(base_spans(text))
            spans = sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
            found.append([{"kind": k, "start": a, "stop": b, "base": (k, a, b) in rules} for k, a, b in spans])
        return {"doc_id": cols["doc_id"], "found": found}

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_rows(narrow, run, FOUND)
