"""Upserts as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def latest_known(rows: DataFrame, keys: list[str], order: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key; each column has its last value that isn't null. Rows that were dealt out by columns which follow from
    the key, ``dealt``, are not dealt out again."""
    cols = [c for c in rows.columns if c not in (*dealt, *keys, order)]
    return rows.groupBy(*keys, *dealt).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols))


def latest(rows: DataFrame, keys: list[str], order: str, strict: bool = False, dealt: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key. With ``strict`` a key of two rows is an error that names it, raised in the same pass. ``dealt`` as above."""
    place = F.row_number().over(Window.partitionBy(*keys, *dealt).orderBy(F.desc(order)))
    out = rows.withColumn("_place", place)
    if strict:
        named = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
        out = out.withColumn("_place", F.when(F.col("_place") > 1, F.raise_error(F.concat(F.lit("more than one row of "), named)).cast("int")).otherwise(F.col("_place")))
    return out.where("_place = 1").drop("_place")


def upsert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with another batch put in: a bill is replaced, with all its properties; of other nodes the last known value of each
    counts; an edge counts once, and stays."""
    both = nodes.withColumn("_batch", F.lit(0)).unionByName(new_nodes.withColumn("_batch", F.lit(1)))
    is_bill = F.col("label") == "Bill"
    bills = latest(both.where(is_bill), ["label", "key"], "_batch").drop("_batch")
    return bills.unionByName(latest_known(both.where(~is_bill), ["label", "key"], "_batch")), edges.unionByName(new_edges).distinct()
