"""Awkward rows that every operator must take."""

from pyspark.sql import functions as F

LONG = "Word after word " * 30_000
TEXTS = [None, "", " \t\n ", "one", "One two", "Ünïcode straße 北京 😀 text", "a@b.co call +1 (555) 010-9999 now 10.1.2.3", LONG, "same text here and there", "same text here and there"]


def documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names operators use inside."""
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "src", 5), (9, TEXTS[9], "en", "src", 24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = ("id", "fp", "rep", "node", "chunk", "bucket", "part", "host", "size", "kept", "w", "item", "a", "b", "n")
    return df.withColumns({c: F.lit("x") for c in extra}), len(rows)


def none(spark):
    return documents(spark)[0].where("false")
