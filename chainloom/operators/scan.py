"""Ordered scans that never put one key into one task.

A plain window over ``PARTITION BY conv`` sorts a whole conversation in one task.  Here every
scan is cut into chunks of ``CHUNK`` consecutive ordinals: a window inside ``(keys, chunk)``
gives the local answer, one partial-aggregated row per chunk gives the carry-in, and a window
over those chunk rows (CHUNK times fewer) gives the offset that is joined back on
``(keys, chunk)``.  Keys must be non-null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 16
_C = "__chunk"


def chunk_of(ordinal: str, chunk: int | None = None) -> Column:
    return F.floor(F.col(ordinal) / F.lit(chunk or CHUNK)).cast("bigint")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    afters: Mapping[str, Column] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    chunk: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """Add ordered per-key results to ``df``.

    sums    inclusive running sum          lasts   last non-null at or before the row
    prevs   last non-null before the row   nexts   first non-null at or after the row
    afters  first non-null after the row   totals  (function, value) over the whole key;
                                                   function is sum, min or max
    ``order`` starts with the integral ordinal; further columns break ties.  ``whole`` tells that no key has rows in two
    chunks: the windows are then over the keys alone, which follow each other without a shuffle or a sort, and nothing is joined.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    if whole:
        return _scan_whole(df, keys, order, sums or {}, lasts or {}, prevs or {}, nexts or {}, afters or {}, totals or {})
    at = F.struct(*order)
    todo: list[tuple[str, str, Column, str]] = []
    for kind, specs in (("sum", sums), ("last", lasts), ("prev", prevs), ("next", nexts), ("after", afters)):
        todo += [(kind, out, value, f"__v_{out}") for out, value in (specs or {}).items()]
    for out, (fn, value) in (totals or {}).items():
        todo.append((f"total_{fn}", out, value, f"__v_{out}"))

    big = df.withColumns({_C: chunk_of(order[0], chunk), **{v: value for _, _, value, v in todo}})
    local = W.partitionBy(*keys, _C).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    onward = local.rowsBetween(W.currentRow, W.unboundedFollowing)
    beyond = local.rowsBetween(1, W.unboundedFollowing)

    over_chunks = W.partitionBy(*keys).orderBy(_C)
    chunks_before = over_chunks.rowsBetween(W.unboundedPreceding, -1)
    chunks_after = over_chunks.rowsBetween(1, W.unboundedFollowing)
    everywhere = W.partitionBy(*keys)

    chunk_aggs, carries, locals_ = [], {}, {}
    for kind, out, _, v in todo:
        c, a = F.col(v), f"__a_{out}"
        if kind == "sum":
            chunk_aggs.append(F.sum(c).alias(a))
            carries[f"__k_{out}"] = F.sum(a).over(chunks_before)
            locals_[out] = F.sum(c).over(upto)
        elif kind in ("last", "prev"):
            chunk_aggs.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(a))
            carries[f"__k_{out}"] = F.last(a, ignorenulls=True).over(chunks_before)
            locals_[out] = F.last(c, ignorenulls=True).over(upto if kind == "last" else before)
        elif kind in ("next", "after"):
            chunk_aggs.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(a))
            carries[f"__k_{out}"] = F.first(a, ignorenulls=True).over(chunks_after)
            locals_[out] = F.first(c, ignorenulls=True).over(onward if kind == "next" else beyond)
        else:
            fn = getattr(F, kind.removeprefix("total_"))
            chunk_aggs.append(fn(c).alias(a))
            carries[f"__k_{out}"] = fn(a).over(everywhere)

    carry = big.groupBy(*keys, _C).agg(*chunk_aggs).select(
        *keys, _C, *[expr.alias(name) for name, expr in carries.items()]
    )
    joined = (big.withColumns(locals_) if locals_ else big).join(carry, [*keys, _C])
    final = {}
    for kind, out, _, _ in todo:
        k = F.col(f"__k_{out}")
        if kind == "sum":
            final[out] = F.coalesce(F.col(out), F.lit(0)) + F.coalesce(k, F.lit(0))
        elif kind.startswith("total_"):
            final[out] = k
        else:
            final[out] = F.coalesce(F.col(out), k)
    done = joined.withColumns(final)
    return done.drop(_C, *[v for *_, v in todo], *carries)


def _scan_whole(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: Mapping[str, Column],
    lasts: Mapping[str, Column],
    prevs: Mapping[str, Column],
    nexts: Mapping[str, Column],
    afters: Mapping[str, Column],
    totals: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """``scan`` of keys of one chunk.  What lies ahead is looked up from the end backwards: a frame that begins at its row is read anew for each."""
    of = W.partitionBy(*keys)
    upto, before = (of.orderBy(*order).rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))
    onward, beyond = (of.orderBy(F.col("__at").desc()).rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))
    added = {out: F.coalesce(F.sum(v).over(upto), F.lit(0)) for out, v in sums.items()}
    added |= {out: F.last(v, ignorenulls=True).over(upto) for out, v in lasts.items()}
    added |= {out: F.last(v, ignorenulls=True).over(before) for out, v in prevs.items()}
    added |= {out: getattr(F, fn)(v).over(of) for out, (fn, v) in totals.items()}
    ahead = {f"__v_{out}": v for out, v in {**nexts, **afters}.items()}
    done = df.dropna(subset=keys)
    if ahead:
        done = done.withColumns(added | ahead | {"__at": F.row_number().over(of.orderBy(*order))})
        found = {out: F.last(f"__v_{out}", ignorenulls=True).over(onward) for out in nexts}
        found |= {out: F.last(f"__v_{out}", ignorenulls=True).over(beyond) for out in afters}
        return done.withColumns(found).drop("__at", *ahead)
    return done.withColumns(added)


def attach(
    df: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    how: str = "inner",
    span: str | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """Join one row per key onto many rows per key without sending a hot key to one task.

    The small side is repeated once per chunk of the key.  ``span`` names a column of the small
    side holding the largest ordinal; without it the chunks present are read from ``df``.
    """
    keys = list(keys)
    big = df.withColumn(_C, chunk_of(order, chunk))
    if span:
        last = F.floor(F.col(span) / F.lit(chunk or CHUNK)).cast("bigint")
        spread = small.withColumn(_C, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    else:
        spread = big.select(*keys, _C).distinct().join(small, keys)
    return big.join(spread, [*keys, _C], how).drop(_C)


def take_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, rank: str = "__rn") -> DataFrame:
    """First ``n`` rows per key, all for None; Spark trims each map partition to ``n`` before the shuffle."""
    if n is None and rank == "__rn":
        return df
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked if n is None else ranked.filter(F.col(rank) <= n)
    return kept.drop(rank) if rank == "__rn" else kept


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, *, back: int, ahead: int, chunk: int | None = None, whole: bool = False
) -> DataFrame:
    """Add ``back`` and ``ahead``: the values of up to that many rows before and after each row, nearest first.

    Windows stay inside ``(keys, chunk)``; every chunk passes its first and last values on to the chunks around it.
    ``order`` is a unique integral ordinal and ``value`` is never null.  With ``whole`` (see ``scan``) the lists are filled up with null.
    """
    keys = list(keys)
    if whole:
        at, v = W.partitionBy(*keys).orderBy(order), "__v"
        beside = {f"__b{i}": F.lag(v, i).over(at) for i in range(1, back + 1)} | {f"__a{i}": F.lead(v, i).over(at) for i in range(1, ahead + 1)}
        found = df.dropna(subset=keys).withColumn(v, value).withColumns(beside)
        lists = {"back": F.array(*[f"__b{i}" for i in range(1, back + 1)]), "ahead": F.array(*[f"__a{i}" for i in range(1, ahead + 1)])}
        return found.withColumns(lists).drop(v, *beside)
    big = df.withColumns({_C: chunk_of(order, chunk), "__v": F.struct(F.col(order).alias("at"), value.alias("v"))})
    local = W.partitionBy(*keys, _C).orderBy(order)
    over_chunks = W.partitionBy(*keys).orderBy(_C)

    def edge(descending: bool, n: int, name: str) -> DataFrame:
        first = take_first(big, [*keys, _C], [F.col(order).desc() if descending else F.col(order).asc()], n)
        return first.groupBy(*keys, _C).agg(F.sort_array(F.collect_list("__v"), asc=not descending).alias(name))

    edges = edge(False, ahead, "__heads").join(edge(True, back, "__tails"), [*keys, _C])
    # every chunk that is there holds a row, so the nearest ``ahead`` chunks hold enough
    heads = F.flatten(F.collect_list("__heads").over(over_chunks.rowsBetween(1, ahead)))
    tails = F.flatten(F.reverse(F.collect_list("__tails").over(over_chunks.rowsBetween(-back, -1))))
    carry = edges.select(*keys, _C, heads.alias("__heads"), tails.alias("__tails"))
    after = F.array_compact(F.array(*[F.lead("__v", i).over(local) for i in range(1, ahead + 1)]))
    before = F.array_compact(F.array(*[F.lag("__v", i).over(local) for i in range(1, back + 1)]))
    joined = big.withColumns({"__after": after, "__before": before}).join(carry, [*keys, _C])

    def nearest(own: str, others: str, n: int) -> Column:
        return F.transform(F.slice(F.concat(own, others), 1, n), lambda x: x["v"])

    found = joined.withColumns({"back": nearest("__before", "__tails", back), "ahead": nearest("__after", "__heads", ahead)})
    return found.drop(_C, "__v", "__after", "__before", "__heads", "__tails")


def interval_candidates(
    df: DataFrame, spans: DataFrame, keys: Sequence[str], order: str, low: str, high: str, *, chunk: int | None = None
) -> DataFrame:
    """Every row beside every span of its key that may hold its ordinal: at most four times those that do.

    A span of width w is met in cells as wide as the next power of two, of which it touches at most two, so it fills at least
    a quarter of them; a span wider than a chunk is met in chunks.  A row is copied once for each width class that its key has
    spans of, and no cell is larger than a chunk, so neither wide spans nor hot keys gather in one task.
    """
    keys = list(keys)
    widest = (chunk or CHUNK).bit_length() - 1
    width = F.col(high) - F.col(low) + 1
    bits = F.when(width > 1, F.length(F.bin(width - 1))).otherwise(0)
    pieces = spans.filter(F.col(high) >= F.col(low)).withColumn("__class", F.least(bits, F.lit(widest)).cast("int"))

    def cell(c: str) -> Column:
        return F.call_function("shiftright", F.col(c).cast("bigint"), F.col("__class"))

    pieces = pieces.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    classes = pieces.groupBy(*keys).agg(F.collect_set("__class").alias("__classes"))  # a number for each power of two
    copies = attach(df, classes, keys, order, chunk=chunk).withColumn("__class", F.explode("__classes")).drop("__classes")
    return copies.withColumn("__cell", cell(order)).join(pieces, [*keys, "__class", "__cell"]).drop("__class", "__cell")


def interval_join(
    df: DataFrame, spans: DataFrame, keys: Sequence[str], order: str, low: str, high: str, *, chunk: int | None = None
) -> DataFrame:
    """Every row beside every span ``[low, high]`` of its key that holds its ordinal."""
    met = interval_candidates(df, spans, keys, order, low, high, chunk=chunk)
    return met.filter(F.col(order).between(F.col(low), F.col(high)))
