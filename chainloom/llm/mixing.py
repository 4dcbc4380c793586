"""Mixing sources to target weights.

Tokens are summed per source, targets are filled like water under a cap, and every document is emitted floor(rate) times
plus one copy drawn with probability equal to the fraction.  The draw is a hash of the document id and a seed, so a rerun
or a retried task takes the same copies.

Everything that grows is aggregated before it is shuffled: one row per source and task.  The sources themselves are
ranked by range partitions with an offset per partition, so not even they pass through one task.

Defined results: a null or empty text has size 0; a null source is a source of its own, ranked last; sources whose
documents hold no word get target 0 and their documents no copy; an empty table gives an empty result; repeated rows are
separate documents that share one draw; a column of the input with the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import unused, whole_text
from chainloom.operators.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "copies", "taken")
_DRAW_HEX = 13


def ranked_sources(totals: DataFrame, source: str) -> DataFrame:
    """``position`` of every source by code point, from 0, null last."""
    spark = totals.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = totals.repartitionByRange(parts, F.col(source).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "mix-sources")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    later = counts.select(F.explode(F.sequence(F.col("_part") + 1, F.lit(parts))).alias("_part"), "_n")
    before = later.groupBy("_part").agg(F.sum("_n").alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(source).asc_nulls_last()))
    out = dealt.withColumn("_inside", inside).join(before, "_part", "left")
    return out.withColumn("position", F.col("_inside") - 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_inside", "_before")


def water_level(weighted: DataFrame, cap: int) -> float:
    """Words per unit of weight once every source above ``cap`` times its size has given its excess to the others."""
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        above = F.col("source_size") * cap < F.col("weight") * F.lit(level)
        held, free = weighted.agg(
            F.sum(F.when(above, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        new = (total - held) / free if free else level
        if new <= level or total == 0:
            return max(level, 0.0)
        level = new


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size)."""
    base = docs.drop(*RESULT)
    sized = base.withColumn("size", F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long"))
    totals = materialise(
        sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size")), "mix-totals"
    )
    position = ranked_sources(totals, "_source")
    given = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighted = materialise(position.withColumn("weight", given.cast("long")), "mix-weights")
    level = F.lit(water_level(weighted, cap))
    target = F.least(F.col("source_size") * cap, F.col("weight") * level).cast("double")
    own = unused("_source", sized)
    targets = weighted.select(F.col("_source").alias(own), "source_size", target.alias("target"))

    out = sized.join(targets, F.col(source_col).eqNullSafe(F.col(own))).drop(own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, _DRAW_HEX), 16, 10).cast("long") / F.lit(float(16**_DRAW_HEX))
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def emit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The columns of ``docs``, every row as often as the mix takes it."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{text_col}`").alias("_text"),
        F.col(f"`{source_col}`").alias("_from"),
    )
    mixed = mix(packed, id_col="_id", text_col="_text", source_col="_from", **options).filter("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source
), weighted AS (
  SELECT source, s, 1 + (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 AS w FROM totals
), filling AS (
  SELECT source, s, w,
    coalesce(sum(3 * s) OVER before, 0) AS held, coalesce(sum(w) OVER before, 0) AS gone, sum(s) OVER () AS t, sum(w) OVER () AS allw
  FROM weighted WINDOW before AS (ORDER BY s / CAST(w AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (t - held)::DOUBLE / (allw - gone) AS l, 3 * s < w * ((t - held)::DOUBLE / (allw - gone)) AS above FROM filling
), level AS (
  SELECT max(l) AS l FROM levels
), targets AS (
  SELECT source, s AS source_size, CAST(least(3 * s, w * (SELECT l FROM level)) AS DOUBLE) AS target FROM weighted
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, {_DRAW_HEX}) AS BIGINT) / {float(16**_DRAW_HEX)} AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
