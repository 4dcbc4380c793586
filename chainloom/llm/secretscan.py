"""Secret scan with structural confirmation.

Three base patterns (assignments, access ids, long hex) are reported as they match.  Further candidates, runs of base64 or
hex and dotted tokens, are reported only if they decode and the decoded bytes have the structure of a secret: DER with
nested lengths that add up and the fields of a private key, the length-prefixed fields of an OpenSSH private key, a signed
token whose header names its algorithm, or text that holds one of these (or a base pattern) again, up to MAX_DEPTH levels.
Text means bytes in any encoding that extends ASCII, with line ends and other characters; UTF-16 is not looked into.

Offsets are code points, ends exclusive.  The scan is one pass over whole texts without a shuffle.

Defined results: a null or empty text has no span; overlapping spans of different kinds are all reported, and masked as
one; repeated rows get equal results; an empty table gives an empty result; ``mask`` keeps every other column and leaves
texts without a span, null texts included, as they are.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import FOUND, map_rows, whole_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "token", "key", "encoded")
PLACEHOLDER = "[secret]"
MAX_DEPTH = 3
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s:,.-]*?)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")  # a header starts with {
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that are too short are dropped, not tried again."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += (("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8)
    if "AKIA" in text:
        found += (("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16)
    found += (("hex", *m.span()) for m in HEX.finditer(text))
    return found


def decode64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1 or ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill ``raw`` exactly; None if the lengths do not add up."""
    items, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw) or raw[at] & 0x1F == 0x1F:
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(raw):
                return None
            size, at = int.from_bytes(raw[at : at + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > len(raw):
            return None
        items.append((tag, raw[at : at + size]))
        at += size
    return items


def is_private_der(raw: bytes) -> bool:
    """A sequence with the fields of an RSA, DSA or EC private key, or of the wrapped and encrypted forms."""
    outer = der_items(raw)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = der_items(outer[0][1]) or []
    tags = [t for t, _ in fields]
    if tags and set(tags) == {2} and len(tags) in (6, 9):  # version and numbers
        return len(fields[0][1]) == 1 and all(content for _, content in fields)
    if tags[:3] == [2, 0x30, 4] or tags[:2] == [0x30, 4]:  # version, algorithm, key; or algorithm and encrypted key
        algorithm = der_items(fields[tags.index(0x30)][1]) or []
        return bool(algorithm) and algorithm[0][0] == 6
    if tags[:2] == [2, 4] and fields[0][1] == b"\x01":  # elliptic curve
        return len(fields[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return False


def is_openssh(raw: bytes) -> bool:
    """Magic, three length-prefixed names, a count, then public and private parts that fill the rest."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at, parts = len(magic), 0
    while at < len(raw):
        if parts == 3:
            at, parts = at + 4, parts + 1
            continue
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
        parts += 1
    return at == len(raw) and parts >= 6


def is_signed_token(token: str) -> bool:
    header, payload, _ = token.split(".")
    try:
        parsed = json.loads(decode64(header) or b"")
        json.loads(decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def _holds_secret(raw: bytes, depth: int) -> str | None:
    if is_private_der(raw) or is_openssh(raw):
        return "key"
    if depth < MAX_DEPTH and len(raw) >= 16:
        text = raw.decode("latin-1")  # all patterns are ASCII, so other letters, line ends and control bytes do not matter
        if any(k != "hex" for k, _, _ in base_spans(text)) or next(confirmed_spans(text, depth + 1), None):
            return "encoded"
    return None


def confirmed_spans(text: str, depth: int = 0) -> Iterator[Span]:
    """Candidates whose decoded form has the structure of a secret."""
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            body = "".join(x for x in m[2].split() if ":" not in x and "," not in x)
            raw = decode64(body)
            if raw and ("ENCRYPTED" in m[2] or is_private_der(raw) or is_openssh(raw)):
                yield ("pem", *m.span())
    for m in TOKEN.finditer(text):
        if is_signed_token(m[0]):
            yield ("token", *m.span())
    for m in RUN.finditer(text):
        raw = decode64(m[0])
        if raw and (kind := _holds_secret(raw, depth)):
            yield (kind, *m.span())
    for m in ANY_HEX.finditer(text):
        if kind := _holds_secret(bytes.fromhex(m[0]), depth):
            yield (kind, *m.span())


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, stop, base), of every document."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = []
        for text in cols["text"]:
            spans = ordered([*base_spans(text), *confirmed_spans(text)])
            found.append([{"kind": k, "start": a, "stop": b, "base": k in BASE_KINDS} for k, a, b in spans])
        return {"doc_id": cols["doc_id"], "found": found}

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_rows(narrow, run, FOUND)


def masked(text: str) -> str:
    spans = ordered([*base_spans(text), *confirmed_spans(text)])
    out, end = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= end:
            out += [text[end:a], PLACEHOLDER]
        end = max(end, b)
    return "".join((*out, text[end:]))


def mask(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by the placeholder; a column n_chars, if there is one, follows the text."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn(text_col, hide(F.col(f"`{text_col}`").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(kind))
    return out
