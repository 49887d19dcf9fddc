"""Distributed connected components: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut, drop


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _pairs(*pairs: tuple[str, str]):
    """The rows ``(a, b)`` that each row gives; a union would read the table once for each pair."""
    return F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs))).alias("e")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.select(_pairs(("a", "b"), ("b", "a"))).select("e.*")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return edges.join(least, "b").select(_pairs(("m", "a"), ("m", "b"))).select("e.*").where("a < b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    The edges stay a table throughout: rounds are joins and grouped minima, which combine on the map
    side; a node with very many edges is one side of an inner join, which adaptive execution splits.
    Nulls and loops are ignored; an empty table gives an empty result.
    """
    edges = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
        .distinct()
    )
    seen = _mark(edges)
    while seen[0]:
        was, edges = edges, cut(_small_star(_large_star(edges)))
        drop(was)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)


def merged(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """``label`` (``node, component``; a node that it lacks is its own) after each component has taken the smallest number next to it by
    ``pairs`` (``x, y``), and then that one's. What gets one label is connected; what is connected may keep two, so that
    this takes the same few joins however long the chains are."""
    ends = pairs.select("x", "y")
    for end in ("x", "y"):
        ends = ends.join(label, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("component", end)).drop("node", "component")
    step = ends.where("x <> y").select(_pairs(("x", "y"), ("y", "x"))).select("e.*").groupBy("a").agg(F.min("b").alias("b")).where("b < a")
    step = cut(step)
    far = step.join(step.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.col("b") == F.col("_a"), "left").select("a", F.coalesce("_b", "b").alias("b"))
    known = label.join(far, F.col("component") == F.col("a"), "left").select("node", F.coalesce("b", "component").alias("component"))
    found = cut(known.union(far.join(label, F.col("a") == F.col("node"), "left_anti").select("a", "b")))
    drop(step)
    return found
