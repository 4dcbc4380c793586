"""Queries over message trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import chain as ch
from chainloom.operators import status as st
from chainloom.plans.registry import query
from chainloom.plans.views import query as sql
from chainloom.plans.views import view


@query(
    "leaves",
    "SELECT conv, uuid, line FROM f2_messages m WHERE NOT EXISTS "
    "(SELECT 1 FROM f2_messages c WHERE c.conv = m.conv AND c.parent_uuid = m.uuid)",
)
def leaves(spark, sf):
    return ch.leaves(view(spark, sf, "f2_messages")).select("conv", "uuid", "line")


@query("active_leaf", "SELECT conv, uuid FROM f2_leaf")
def active_leaf(spark, sf):
    return ch.active_leaf(view(spark, sf, "f2_messages"))


@query("walk_chain", "SELECT conv, pos, uuid, line FROM f2_chain")
def walk_chain(spark, sf):
    return ch.walk_chain(view(spark, sf, "f2_messages"))


@query("orphans", "SELECT conv, line, uuid FROM f2_messages m WHERE uuid NOT IN (SELECT uuid FROM f2_chain)")
def orphans(spark, sf):
    m = view(spark, sf, "f2_messages")
    return ch.orphans(m, ch.walk_chain(m)).select("conv", "line", "uuid")


@query(
    "next_valid_root",
    """SELECT conv, min(pos) AS root_pos, min_by(uuid, pos) AS uuid, min_by(type, pos) AS type
       FROM (SELECT *, max(pos) OVER (PARTITION BY conv) AS n FROM f2_chain) c
       WHERE type IN ('user','system') AND pos >= floor(n/2.0) + 1 GROUP BY conv""",
)
def next_valid_root(spark, sf):
    m = view(spark, sf, "f2_messages")
    rows = ch.chain_messages(m, ch.walk_chain(m))
    cuts = rows.groupBy("conv").agg((F.floor(F.max("pos") / 2) + 1).cast("bigint").alias("cut"))
    return ch.next_valid_root(rows, cuts)


@query(
    "estimate_tokens",
    "SELECT conv, type, count(*) AS messages, CAST(sum(ceil(length(text)/4.0)) AS BIGINT) AS tokens FROM f1_messages GROUP BY conv, type",
)
def estimate_tokens(spark, sf):
    return st.estimate_tokens(view(spark, sf, "f1_messages"))


_STATUS = """
SELECT t.conv, t.total_lines, c.*EXCLUDE(conv), t.total_lines - c.chain_length AS orphans,
  CAST(least(100, floor(c.tokens/200000.0*100 + 0.5)) AS BIGINT) AS usage_pct
FROM (SELECT conv, count(*) AS total_lines FROM {m} GROUP BY conv) t JOIN
 (SELECT conv, count(*) AS chain_length,
   count(*) FILTER (type='user') AS user_messages, count(*) FILTER (type='assistant') AS assistant_messages,
   count(*) FILTER (type='tool_result') AS tool_messages,
   count(*) FILTER (type NOT IN ('user','assistant','tool_result')) AS other_messages,
   CAST(sum(ceil(length(text)/4.0)) AS BIGINT) AS tokens,
   CAST(coalesce(sum(CASE WHEN type='assistant' AND (conv+line)%3=0 THEN ceil(length(text)/4.0) END),0) AS BIGINT) AS thinking_tokens
  FROM {c} GROUP BY conv) c ON c.conv = t.conv
"""
_F3_CHAIN = "(SELECT * FROM f3_messages WHERE NOT (conv % 5 = 1 AND line < 24 AND mx >= 24))"
_F3_LINES = "(SELECT *, max(line) OVER (PARTITION BY conv) AS mx FROM f3_messages)"


def _thinking(m):
    return m.filter((F.col("type") == "assistant") & ((F.col("conv") + F.col("line")) % 3 == 0)).select(
        "conv", "uuid", F.ceil(F.length("text") / 4).alias("thinking_tokens")
    )


@query("context_status", _STATUS.format(m="f2_messages", c="f2_chain"))
def context_status(spark, sf):
    m = view(spark, sf, "f2_messages")
    return st.context_status(m, ch.walk_chain(m), _thinking(m))


@query(
    "bloat_flags",
    "SELECT conv, concat_ws(',', CASE WHEN orphans > 10 THEN 'orphans' END, "
    "CASE WHEN thinking_tokens > tokens*0.3 THEN 'thinking' END, "
    "CASE WHEN user_messages > 0 AND tool_messages/user_messages > 10 THEN 'tool_ratio' END) AS flags FROM ("
    + _STATUS.format(m="f3_messages", c=_F3_CHAIN.replace("f3_messages", _F3_LINES)) + ") s",
)
def bloat_flags(spark, sf):
    m = view(spark, sf, "f3_messages")
    flagged = st.bloat_flags(st.context_status(m, ch.walk_chain(m), _thinking(m)))
    return flagged.select("conv", F.array_join("flags", ",").alias("flags"))
