"""Scans and sinks of bill records: JSON corpora, BILLSTATUS-like XML in both of its layouts, golden sets, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.records import bill_id, has_ended, outcome_of
from evidra.functions.text import strip, strip_html

_PERSON = "struct<bioguide_id:string,full_name:string,party:string,state:string>"
BILL = (
    f"congress string, bill_type string, bill_number string, title string, introduced_date string, sponsor {_PERSON}, cosponsors array<{_PERSON}>, "
    "committees array<struct<name:string,chamber:string>>, subjects array<string>, summary string, "
    "actions array<struct<date:string,text:string,type:string>>, latest_action struct<date:string,text:string>, outcome string"
)
GOLDEN = "query string, relevant array<string>, note string"

_P = "struct<bioguideId:string,fullName:string,party:string,state:string>"
_NAME = "struct<item:array<struct<name:string>>>"
_COMMITTEE = "array<struct<name:string,chamber:string>>"
#: What is read of a bill element: the later layout and the earlier one.
XML = (
    "struct<congress:string,type:string,billType:string,number:string,billNumber:string,title:string,introducedDate:string,"
    f"sponsors:struct<item:array<{_P}>>,cosponsors:struct<item:array<{_P}>>,"
    f"committees:struct<item:{_COMMITTEE},billCommittees:struct<item:{_COMMITTEE}>>,"
    f"policyArea:struct<name:string>,subjects:struct<legislativeSubjects:{_NAME},billSubjects:struct<policyArea:struct<name:string>,legislativeSubjects:{_NAME}>>,"
    "summaries:struct<summary:array<struct<cdata:struct<text:string>,text:string>>,billSummaries:struct<item:array<struct<text:string>>>>,"
    "actions:struct<item:array<struct<actionDate:string,text:string,type:string>>>,latestAction:struct<actionDate:string,text:string>>"
)


def keyed(df: DataFrame) -> DataFrame:
    """With ``bill_id``; rows without one are left out."""
    return df.withColumn("bill_id", bill_id(F.col("congress"), F.col("bill_type"), F.col("bill_number"))).where("bill_id is not null")


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """The first corpus that exists, tagged with its place among ``paths``; none gives no rows. A file is a JSON array, a
    folder holds what ``write_corpus`` wrote."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k, p in enumerate(paths):
        at = hadoop(p)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(at):
            return keyed(spark.read.schema(BILL).option("multiLine", not store.getFileStatus(at).isDirectory()).json(p)).withColumn("corpus_source", F.lit("ingested" if k == 0 and len(paths) > 1 else "seed"))
    return keyed(spark.createDataFrame([], BILL)).withColumn("corpus_source", F.lit("none"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def _root(xml: str) -> Column:
    return F.from_xml(F.col(xml), f"bill {XML}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})


def parsed(document: Column | str) -> Column:
    """Whether a document (its text's name, or what it parsed to) is well-formed and has a bill."""
    x = _root(document) if isinstance(document, str) else document
    return x.isNotNull() & x["_broken"].isNull() & x["bill"].isNotNull()


def parse_xml(df: DataFrame, xml: str, as_of: str, max_summary: int = 0) -> DataFrame:
    """Bill records of XML documents; those that don't parse, or have no bill, are dropped.

    Of two places for a field the later layout's goes first. ``as_of`` (a date) decides whether a congress
    has ended; ``max_summary`` cuts summaries, 0 leaves them.
    """
    # columns beside the document stay; as the items of a generator documents are parsed once, a filter on them would parse them again
    b = df.withColumn("_x", F.explode(F.array(_root(xml)))).where(parsed(F.col("_x"))).withColumn("_b", F.col("_x.bill"))
    return bills_of(b, df.columns, as_of, max_summary)


def bills_of(b: DataFrame, kept: list[str], as_of: str, max_summary: int = 0) -> DataFrame:
    """Bill records of parsed documents ``_b``, beside the columns ``kept``."""

    def text(*paths: str) -> Column:
        return F.coalesce(*(strip(F.nullif(F.col(f"_b.{p}"), F.lit(""))) for p in paths))

    def items(*paths: str) -> Column:
        out = F.col(f"_b.{paths[-1]}")
        for p in reversed(paths[:-1]):
            out = F.when(F.size(F.col(f"_b.{p}")) > 0, F.col(f"_b.{p}")).otherwise(out)
        return out

    person = lambda x: F.struct(*(x[a].alias(n) for a, n in (("bioguideId", "bioguide_id"), ("fullName", "full_name"), ("party", "party"), ("state", "state"))))
    empty = lambda kind: F.array().cast(kind)
    people = F.coalesce(F.transform("_b.cosponsors.item", person), empty(f"array<{_PERSON}>"))
    tags = items("subjects.legislativeSubjects.item", "subjects.billSubjects.legislativeSubjects.item")
    tags = F.transform(F.coalesce(tags, empty("array<struct<name:string>>")), lambda x: x["name"])
    area = text("policyArea.name", "subjects.billSubjects.policyArea.name")
    new = F.transform("_b.summaries.summary", lambda x: F.coalesce(F.nullif(x["cdata"]["text"], F.lit("")), x["text"]))
    old = F.transform("_b.summaries.billSummaries.item", lambda x: x["text"])
    last = F.when(F.size(new) > 0, F.element_at(new, -1)).when(F.size(old) > 0, F.element_at(old, -1))
    summary = strip_html(last)
    acts = F.coalesce(F.col("_b.actions.item"), empty("array<struct<actionDate:string,text:string,type:string>>"))
    said = F.array_join(F.transform(acts, lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return b.select(
        *kept,
        text("congress").alias("congress"),
        text("type", "billType").alias("bill_type"),
        text("number", "billNumber").alias("bill_number"),
        text("title").alias("title"),
        text("introducedDate").alias("introduced_date"),
        F.when(F.size("_b.sponsors.item") > 0, person(F.get("_b.sponsors.item", F.lit(0)))).alias("sponsor"),
        people.alias("cosponsors"),
        F.coalesce(items("committees.item", "committees.billCommittees.item"), empty(_COMMITTEE)).alias("committees"),
        F.array_distinct(F.array_compact(F.concat(F.array(area), tags))).alias("subjects"),
        (F.substring(summary, 1, max_summary) if max_summary else summary).alias("summary"),
        F.transform(acts, lambda x: F.struct(x["actionDate"].alias("date"), x["text"].alias("text"), x["type"].alias("type"))).alias("actions"),
        F.when(F.col("_b.latestAction").isNotNull(), F.struct(F.col("_b.latestAction.actionDate").alias("date"), F.col("_b.latestAction.text").alias("text"))).alias("latest_action"),
        outcome_of(said, has_ended(text("congress"), F.lit(as_of).cast("date"))).alias("outcome"),
    )


def list_packages(listing: DataFrame, prefix: str, since: str, limit: int | None = None) -> DataFrame:
    """Packages of a listing ``package_id, last_modified`` with a prefix, changed since a date, at most ``limit``: the first by id,
    so that a limit has one meaning in a table without an order (a top-k, not an early exit)."""
    out = listing.where(F.col("package_id").startswith(prefix) & (F.col("last_modified") >= since))
    return out.orderBy("package_id").limit(limit) if limit else out


def write_corpus(df: DataFrame, path: str) -> None:
    """Overwrite a corpus: a folder of JSON objects, one a line, written by all tasks."""
    df.write.mode("overwrite").json(path)
