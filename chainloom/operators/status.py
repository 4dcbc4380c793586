"""Per-conversation size and shape figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import tokens
from chainloom.operators.chain import chain_messages

CONTEXT_WINDOW = 200_000
MAX_ORPHANS, MAX_THINKING_SHARE, MAX_TOOL_RATIO = 10, 0.3, 10


def estimate_tokens(messages: DataFrame) -> DataFrame:
    """Token sums per conversation and role; each message is rounded up on its own."""
    return messages.groupBy("conv", "type").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(tokens(F.col("text"))).alias("tokens")
    )


def context_status(messages: DataFrame, chain: DataFrame, thinking: DataFrame | None = None) -> DataFrame:
    """One row per conversation.  ``thinking(conv, uuid, thinking_tokens)`` is optional."""
    on_chain = chain_messages(messages, chain)
    if thinking is not None:
        on_chain = on_chain.join(thinking, ["conv", "uuid"], "left")
    else:
        on_chain = on_chain.withColumn("thinking_tokens", F.lit(0))
    is_tool = F.col("type").isin("tool_use", "tool_result")
    per_chain = on_chain.groupBy("conv").agg(
        F.count(F.lit(1)).alias("chain_length"),
        F.count_if(F.col("type") == "user").alias("user_messages"),
        F.count_if(F.col("type") == "assistant").alias("assistant_messages"),
        F.count_if(is_tool).alias("tool_messages"),
        F.count_if(~F.col("type").isin("user", "assistant") & ~is_tool).alias("other_messages"),
        F.sum(tokens(F.col("text"))).alias("tokens"),
        F.coalesce(F.sum("thinking_tokens"), F.lit(0)).cast("bigint").alias("thinking_tokens"),
    )
    lines = messages.groupBy("conv").agg(F.count(F.lit(1)).alias("total_lines"))
    return lines.join(per_chain, "conv").withColumns(
        {
            "orphans": F.col("total_lines") - F.col("chain_length"),
            "usage_pct": F.least(F.lit(100), F.floor(F.col("tokens") / CONTEXT_WINDOW * 100 + 0.5)).cast("bigint"),
        }
    )


def bloat_flags(status: DataFrame) -> DataFrame:
    """Array of the bloat signs each conversation shows."""
    raised = F.array(
        F.when(F.col("orphans") > MAX_ORPHANS, F.lit("orphans")),
        F.when(F.col("thinking_tokens") > F.col("tokens") * MAX_THINKING_SHARE, F.lit("thinking")),
        F.when(
            (F.col("user_messages") > 0) & (F.col("tool_messages") / F.col("user_messages") > MAX_TOOL_RATIO),
            F.lit("tool_ratio"),
        ),
    )
    return status.withColumn("flags", F.filter(raised, lambda f: f.isNotNull()))
