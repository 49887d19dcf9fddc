"""The given tables read as bills, links and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.vocabulary import BILL_TYPES, OUTCOMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bills of none to three subjects: the name is the title, type and brand are subjects; congress and outcome follow
    from the size."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("bill_id"),
        F.col("p_partkey").alias("ordinal"),
        F.col("p_name").alias("title"),
        F.slice(F.array(F.lower("p_type"), F.lower("p_brand"), F.lit("extra")), F.lit(1), (F.col("p_partkey") % 4).cast("int")).alias("subjects"),
        (113 + F.col("p_size") % 6).cast("string").alias("congress"),
        F.get(F.lit(list(BILL_TYPES)), (F.col("p_partkey") % 8).cast("int")).alias("bill_type"),
        F.col("p_partkey").cast("string").alias("bill_number"),
        F.get(F.lit(list(OUTCOMES)), F.col("p_size") % 8).alias("outcome"),
    )


def links(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Orders as legislators and customers as committees of the parts in them; each link once. Dealt by a column, links need no other shuffle
    for what is joined or grouped by it next."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("B"), F.col("l_partkey").cast("string")).alias("bill_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    a = line.select(F.lit("legislator").alias("kind"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("entity"), "bill_id")
    b = line.join(orders, "l_orderkey").select(F.lit("committee"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")), "bill_id")
    both = a.union(b)
    return (both.repartition(by) if by else both).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


BILLS_SQL = (
    "bills AS (SELECT 'B' || p_partkey AS bill_id, p_partkey AS ordinal, p_name AS title, list_slice([lower(p_type), lower(p_brand), 'extra'], 1, p_partkey % 4) AS subjects, (113 + p_size % 6)::VARCHAR AS congress, "
    f"({list(BILL_TYPES)})[1 + p_partkey % 8] AS bill_type, p_partkey::VARCHAR AS bill_number, ({list(OUTCOMES)})[1 + p_size % 8] AS outcome FROM part)"
)
LINKS_SQL = (
    "links AS (SELECT 'legislator' AS kind, 'O' || l_orderkey AS entity, 'B' || l_partkey AS bill_id FROM lineitem "
    "UNION SELECT 'committee', 'C' || o_custkey, 'B' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
