"""Small tables with every awkward row the operators promise to handle."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "size", "target", "copies", "score", "label", "node", "class_id", "found", "length", "piece", "item", "part", "key", "a", "b", "words",
    "_source", "_rows", "_digest", "_node", "_class", "_row",
)


def documents(spark, rows):
    """Documents from (doc_id, text, source) with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    table = spark.createDataFrame(full, DOCUMENTS)
    return table.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


def awkward():
    long_text = " ".join(f"word{i % 4999} x{i}" for i in range(20_000))
    return [
        (1, "one two three four five six seven eight nine ten", "s1"),
        (2, None, "s1"),
        (3, "", "s2"),
        (4, " \n\t ", None),
        (None, "a text without an id, but with words in it", "s2"),
        (6, long_text, "s3"),
        (7, "short", "s4"),
        (7, "short", "s4"),
        (8, "é\U0001f600 日本語 ünïcode   text", "s\U0001f600"),
    ]
