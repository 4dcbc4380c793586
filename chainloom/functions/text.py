"""Text expressions shared by the operators; all run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank in the transcript format, for patterns and for trimming.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BLANK_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def trim_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(trim_blank(c)), F.lit(0)) == 0


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def line_count(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def tokens(c: Column) -> Column:
    """Four characters make one token, rounded up per text; no text is 0."""
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("bigint")


def clip(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def one_decimal_kb(n: Column) -> Column:
    """Bytes as kilobytes with one decimal, exact halves rounded up."""
    tenths = F.floor(n / 1024 * 10 + 0.5).cast("bigint")
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")
    )


def whole_kb(n: Column) -> Column:
    return F.floor(n / 1024 + 0.5).cast("bigint").cast("string")


def json_quote(c: Column) -> Column:
    """The JSON string literal of a text: the one element of a JSON array, brackets removed."""
    arr = F.to_json(F.array(c))
    return F.substr(arr, F.lit(2), F.length(arr) - 2)
