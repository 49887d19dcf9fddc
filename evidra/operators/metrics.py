"""Retrieval metrics over a table ``query, item, rank`` of results and one ``query, item`` of relevant items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(retrieved: DataFrame) -> DataFrame:
    """The first place of each item, ranked anew from 1."""
    first = retrieved.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "item")))


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, k: int = 6) -> DataFrame:
    """Precision and recall at k (precision over what was returned) and reciprocal rank, for each query with
    relevant items; 0 where nothing was found."""
    rel = relevant.select("query", "item").distinct()
    hit = retrieved.join(rel.withColumn("hit", F.lit(1)), ["query", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return hit_metrics(hit, rel.groupBy("query").agg(F.count("*").alias("size")), k)


def hit_metrics(hit: DataFrame, size: DataFrame, k: int = 6) -> DataFrame:
    """The same out of results ``query, rank, hit`` (1 if relevant, else 0) and how many items are relevant, ``query, size``."""
    got = hit.groupBy("query").agg(
        F.avg(F.when(F.col("rank") <= k, F.col("hit"))).alias("precision"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias("found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    return size.join(got, "query", "left").select(
        "query",
        F.coalesce("precision", F.lit(0.0)).alias("precision"),
        (F.coalesce("found", F.lit(0)) / F.col("size")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard overlap of two result tables for each query; 1 if both are empty."""
    x = a.groupBy("query").agg(F.collect_set("item").alias("x"))
    y = b.groupBy("query").agg(F.collect_set("item").alias("y"))
    both = x.join(y, "query", "full")
    none = F.array().cast(x.schema["x"].dataType)
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    return both.select("query", F.when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).alias("jaccard"))


def averages(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in metrics.columns if c != "query"))
