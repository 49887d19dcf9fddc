"""Scan of files of XML bills: any number of documents a file, on any number of lines, files split and read in parallel.

The end tag of a document is what parts records, so a large file is read by many tasks. What a record holds before its last start tag
is a document without an end, and kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.records import parse_xml, parsed

TAG = "billStatus"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, xml, whole``: the documents under ``path``, and the beginnings of those that have no end."""
    rows = spark.read.option("lineSep", f"</{TAG}>").text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", rf"(?=<{TAG}[\s>])").alias("p"))
    some = rows.select("file", F.filter("p", lambda x: x.startswith(f"<{TAG}")).alias("p")).select("file", F.size("p").alias("n"), F.posexplode("p").alias("at", "xml"))
    whole = F.col("at") == F.col("n") - 1
    return some.select("file", F.when(whole, F.concat("xml", F.lit(f"</{TAG}>"))).otherwise(F.col("xml")).alias("xml"), whole.alias("whole"))


def scan_xml(spark: SparkSession, path: str, as_of: str, max_summary: int = 0) -> DataFrame:
    """Bill records of all documents under ``path``, with their ``file``; other columns as ``parse_xml`` has them. Documents that don't
    parse, or have no bill, are left out here and told by ``broken_xml``."""
    return parse_xml(documents(spark, path).where("whole").select("file", "xml"), "xml", as_of, max_summary).drop("xml")


def broken_xml(spark: SparkSession, path: str, shown: int = 200) -> DataFrame:
    """``file, sample``: a row for each document that has no end, doesn't parse, or has no bill, with its first characters. Files without any
    document, and what stands between documents, are no documents."""
    d = documents(spark, path)
    return d.where(~F.col("whole") | ~parsed("xml")).select("file", F.substring("xml", 1, shown).alias("sample"))
