"""Message trees: leaves, the active leaf, the active chain, orphans, valid roots.

``messages`` has conv, line, uuid, parent_uuid, type, ts and, optionally, bad_ts (a timestamp
was written but cannot be read).  ``line`` is the ordinal of the row inside its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.scan import attach, chunk_of
from chainloom.operators.storage import materialise

ROOT_TYPES = ("user", "system")


def _when(df: DataFrame) -> Column:
    return F.coalesce(F.col("ts").cast("double"), F.lit(0.0))


def _bad(df: DataFrame) -> Column:
    return F.coalesce(F.col("bad_ts"), F.lit(False)) if "bad_ts" in df.columns else F.lit(False)


def _parents(messages: DataFrame) -> DataFrame:
    """(conv, uuid) of every referenced parent with its child count, combined before the shuffle."""
    return (
        messages.filter(F.col("parent_uuid").isNotNull())
        .groupBy("conv", F.col("parent_uuid").alias("uuid"))
        .agg(F.count(F.lit(1)).alias("n_kids"))
    )


def leaves(messages: DataFrame) -> DataFrame:
    """Messages that are nobody's parent."""
    return messages.filter(F.col("uuid").isNotNull()).join(_parents(messages).drop("n_kids"), ["conv", "uuid"], "left_anti")


def _pick_leaf(candidates: DataFrame, *carry: str) -> DataFrame:
    """One leaf per conversation out of rows with ``best`` and ``first`` ordering structs.

    A first leaf whose time cannot be read is never beaten; otherwise the latest readable
    time wins and the earlier line breaks ties.
    """
    row = F.struct(*carry)
    return (
        candidates.groupBy("conv")
        .agg(
            F.max_by(row, "best").alias("latest"),
            F.min_by(F.struct(F.col("first.bad").alias("bad"), row.alias("row")), F.col("first.line")).alias("head"),
        )
        .withColumn("pick", F.when(F.col("head.bad"), F.col("head.row")).otherwise(F.col("latest")))
        .select("conv", *[F.col(f"pick.{c}").alias(c) for c in carry])
    )


def _order_keys(df: DataFrame) -> tuple[Column, Column]:
    """Ordering structs of leaf rows that carry the time ``t`` and the flag ``bad``."""
    best = F.when(~F.col("bad"), F.struct(F.col("t").alias("t"), (-F.col("line")).alias("l")))
    first = F.struct(F.col("line").alias("line"), F.col("bad").alias("bad"))
    return best, first


def active_leaf(messages: DataFrame) -> DataFrame:
    """(conv, uuid) of the leaf each conversation resumes from."""
    ends = leaves(messages)
    ends = ends.select("conv", "uuid", "line", _when(ends).alias("t"), _bad(ends).alias("bad"))
    best, first = _order_keys(ends)
    return _pick_leaf(ends.select("conv", "uuid", best.alias("best"), first.alias("first")), "uuid")


def walk_chain(messages: DataFrame, starts: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """(conv, pos, uuid, line) from the root (pos 1) to the active leaf, or to ``starts(conv, uuid)``.

    Rows whose parent is the row before them are contracted into runs, cut at chunk borders and
    behind every row with other children, so a run is always entered at its last row.  The
    runs on the path are then found by doubling the ancestor distance, in log2(runs on the
    path) rounds over the contracted table.  A missing parent or a revisit ends the walk.
    """
    known = messages.filter(F.col("uuid").isNotNull()).select(
        "conv", "uuid", "line", "parent_uuid", _when(messages).alias("t"), _bad(messages).alias("bad")
    )
    # One hash aggregation gives the last line of every id and how often it is a parent.
    none, no = F.lit(None).cast("bigint"), F.lit(False)
    refs = known.select("conv", "uuid", F.col("line").alias("last_line"), F.lit(0).cast("bigint").alias("n_kids"), no.alias("is_start")).unionByName(
        messages.filter(F.col("parent_uuid").isNotNull()).select(
            "conv", F.col("parent_uuid").alias("uuid"), none.alias("last_line"), F.lit(1).cast("bigint").alias("n_kids"), no.alias("is_start")
        )
    )
    if starts is not None:
        # A given start counts as called from elsewhere, so that its run ends with it.
        refs = refs.unionByName(
            starts.select("conv", "uuid").distinct().select("conv", "uuid", none.alias("last_line"), F.lit(2).cast("bigint").alias("n_kids"), F.lit(True).alias("is_start"))
        )
    refs = refs.groupBy("conv", "uuid").agg(
        F.max("last_line").alias("last_line"), F.sum("n_kids").alias("n_kids"), F.max("is_start").alias("is_start")
    )
    # Of several rows with one id the last is the one that is walked; the others only count as leaves.
    w = W.partitionBy("conv", "chunk", "last").orderBy("line")
    numbered = (
        known.join(refs, ["conv", "uuid"])
        .withColumns({"last": F.col("line") == F.col("last_line"), "chunk": chunk_of("line", chunk)})
        .withColumns({"prev_uuid": F.lag("uuid").over(w), "prev_kids": F.lag("n_kids").over(w), "rn": F.row_number().over(w)})
        .withColumn(
            "head",
            F.col("prev_uuid").isNull() | ~F.col("parent_uuid").eqNullSafe(F.col("prev_uuid")) | (F.col("prev_kids") > 1),
        )
        .withColumns(
            {
                "run": F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(w),
                "off": F.col("rn") - F.last(F.when(F.col("head"), F.col("rn")), ignorenulls=True).over(w),
                "tail": F.coalesce(F.lead("head").over(w), F.lit(True)),
            }
        )
    )
    rows = materialise(
        numbered.select(
            "conv", "uuid", "line", "run", "off", "head", "tail", "last", "n_kids", "is_start", "t", "bad",
            F.when(F.col("head"), F.col("parent_uuid")).alias("up"),
        ),
        "chain-rows",
    )

    tails = rows.filter(F.col("last") & F.col("tail")).withColumn("n", F.col("off").cast("bigint") + 1)
    if starts is None:
        free = rows.filter(F.col("n_kids") == 0)
        best, first = _order_keys(free)
        picked = materialise(
            _pick_leaf(free.withColumns({"best": best, "first": first}), "uuid", "run", "off", "last"), "chain-leaf"
        )
        other = picked.filter(~F.col("last")).select("conv", "uuid").join(tails.select("conv", "uuid", "run", "off"), ["conv", "uuid"])
        ends = picked.filter("last").select("conv", "run", "off").unionByName(other.select("conv", "run", "off"))
        reach = ends.select("conv", "run", F.col("off").cast("bigint").alias("far"))
    else:
        reach = materialise(tails.filter("is_start").select("conv", "run", F.col("off").cast("bigint").alias("far")), "chain-reach")

    # Childless runs other than the start cannot be ancestors; dropping them first also
    # removes the hot side of a parent with very many leaf children.
    inner = tails.filter(F.col("n_kids") > 0)
    heads = rows.filter(F.col("last") & F.col("head") & F.col("up").isNotNull()).select("conv", "run", F.col("up").alias("uuid"))
    able = heads.join(inner.select("conv", "run").unionByName(reach.select("conv", "run")), ["conv", "run"], "left_semi")
    jump = materialise(
        able.join(inner.select("conv", "uuid", F.col("run").alias("to"), F.col("n").alias("step")), ["conv", "uuid"]).select(
            "conv", "run", "to", "step"
        ),
        "chain-jump",
    )
    # ``jump`` leads 1, 2, 4, … runs up.  It runs dry above the roots; on a cycle it never does,
    # so the rounds also end once they cover more runs than there are.
    links, reached = jump.count(), 1
    while links and jump.take(1):
        further = reach.join(jump, ["conv", "run"]).select("conv", F.col("to").alias("run"), (F.col("far") + F.col("step")).alias("far"))
        reach = reach.unionByName(further).groupBy("conv", "run").agg(F.min("far").alias("far"))
        reached *= 2
        if reached > links + 1:
            break
        reach = materialise(reach, "chain-reach")
        nxt = jump.select("conv", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("step").alias("step2"))
        jump = materialise(
            jump.join(nxt, ["conv", "to"]).select("conv", "run", F.col("to2").alias("to"), (F.col("step") + F.col("step2")).alias("step")),
            "chain-jump",
        )
    totals = reach.groupBy("conv").agg(F.max("far").alias("deepest"))
    placed = attach(reach, totals, ["conv"], "run", chunk=chunk)
    return rows.filter("last").join(placed, ["conv", "run"]).select(
        "conv",
        (F.col("deepest") + 1 - F.col("far") + F.col("off")).cast("bigint").alias("pos"),
        "uuid",
        "line",
    )


def chain_messages(messages: DataFrame, chain: DataFrame) -> DataFrame:
    """Chain rows with their message columns."""
    return messages.drop("pos").join(chain.select("conv", "line", "pos"), ["conv", "line"])


def orphans(messages: DataFrame, chain: DataFrame) -> DataFrame:
    """Lines of the file that are not on the chain, rows without uuid included."""
    return messages.join(chain.select("conv", "line"), ["conv", "line"], "left_anti")


def next_valid_root(chain: DataFrame, cuts: DataFrame) -> DataFrame:
    """(conv, root_pos, uuid, type): first user or system row at or after ``cuts(conv, cut)``."""
    rooted = chain.filter(F.col("type").isin(*ROOT_TYPES)).select("conv", "pos", "uuid", "type")
    return (
        attach(rooted, cuts.select("conv", "cut"), ["conv"], "pos")
        .filter(F.col("pos") >= F.col("cut"))
        .groupBy("conv")
        .agg(F.min(F.struct("pos", "uuid", "type")).alias("r"))
        .select("conv", F.col("r.pos").alias("root_pos"), F.col("r.uuid").alias("uuid"), F.col("r.type").alias("type"))
    )
