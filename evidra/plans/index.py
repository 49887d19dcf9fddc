"""The built index: enriched bills, their links by bill and by hub, and their passages, as tables in one folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.records import subjects
from evidra.operators import linkfile, postings
from evidra.operators.graph import decompose, edges_of, links_of, occurrences, seed_match
from evidra.operators.lineage import cut, remove
from evidra.operators.linkfile import LinkFile
from evidra.plans.engines import StoredPassages, body, passages, question_words
from evidra.plans.params import GraphParams, VectorParams
from evidra.sources.snapshots import Rule, Store

TABLES = ("bills", "nodes", "links", "passages")


def enrich(bills: DataFrame) -> DataFrame:
    """Bills with the policy areas of their title and summary behind their own subjects."""
    said = F.concat_ws(" ", "title", "summary")
    return bills.withColumn("subjects", subjects(said, F.col("subjects")))


@dataclass
class Index:
    """Tables of an index that was built at ``path``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def count(self, name: str) -> int:
        return self.table(name).count() if self.has(name) else 0

    def has(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def reset(self) -> None:
        """Drop all tables."""
        for name in (*TABLES, "postings", "linkfile"):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def rename(self, name: str, to: str) -> None:
        at, end = (self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in (name, to))
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(at, end):
            raise RuntimeError(f"{name} of {self.path} could not be renamed to {to}")

    def stored_passages(self, p: VectorParams = VectorParams()) -> StoredPassages:
        """The passages with their posting lists."""
        return StoredPassages(self.table("passages"), postings.PostingFile(self.spark, f"{self.path}/postings", "string", p.embedder_dim))

    def related(self, question: str, p: GraphParams = GraphParams()) -> DataFrame:
        """The bills that share people and committees with a question's seeds; of the links only those of the seeds and of their hubs are read."""
        words, bills = question_words(self.spark, question), self.table("bills")
        return LinkFile(self.spark, f"{self.path}/linkfile").related(bills, seed_match(bills, words, max(3, p.top_k // 2)), words, p)

    def close(self) -> None:
        """Release what the session caches."""
        self.spark.catalog.clearCache()


def build_index(bills: DataFrame, path: str, p: VectorParams = VectorParams(), rebuild: bool = False) -> int:
    """Build the index of nested bills (``bill_id`` and the columns of a corpus) and return how many there are.

    It is built anew if asked for; else a folder that has bills and passages is left as it is. Enrichment is first: seeds and
    passages both read subjects and summaries. No bills build nothing.
    """
    index = Index(bills.sparkSession, path)
    if not rebuild and index.count("bills") and index.count("passages"):
        return index.count("bills")
    new = f"new-{uuid.uuid4().hex}"
    enrich(bills).write.parquet(f"{path}/{new}")  # bills are worked out once: whether there are any is read from this
    if index.table(new).isEmpty():
        remove(index.spark, f"{path}/{new}")
        return 0
    index.reset()
    index.rename(new, "bills")
    rich = index.table("bills")
    nodes, edges = decompose(rich)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    links_of(edges).write.mode("overwrite").parquet(f"{path}/links")
    linkfile.build(index.table("links"), f"{path}/linkfile")
    texts = rich.select("bill_id", "title", "outcome", body(F.col("title"), F.col("summary")).alias("text"))
    passages(texts, "bill_id", "text", p).write.mode("overwrite").parquet(f"{path}/passages")
    postings.build(index.table("passages"), f"{path}/postings", "bill_id", dim=p.embedder_dim)
    return index.count("bills")


#: Tables of an index that batches of bills are merged into, and how. Passages and their vectors follow their bill.
RULES = {
    "bills": Rule("replace", ("bill_id",), order="ordinal"),
    "people": Rule("known", ("key",), order="order"),
    "committees": Rule("known", ("key",), order="order"),
    "edges": Rule("set", ("rel_type", "src_key", "dst_key"), by=("dst_key",)),
    "passages": Rule("group", ("chunk_index",), by=("bill_id",)),
}


def store_of(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, RULES)


def upsert_index(store: Store, bills: DataFrame, number: int | None = None, source: str = "bills", p: VectorParams = VectorParams()) -> bool:
    """Merge a batch of nested bills into a stored index: bills are replaced, with their passages and the passages' vectors; people and
    committees keep what is known of them; edges are a set and stay. False for a batch that was merged before.

    All tables change in one version; only the parts that hold the batch's keys are written anew. The store tells what counts of those
    that share a key, so people, committees and edges go to it as they occur.
    """
    if store.passed(source, number):  # before anything of the batch is worked out
        return False
    rich = cut(enrich(bills))
    found = occurrences(rich)
    kind = lambda label, *properties: found.where(F.col("label") == label).select("key", "name", *properties, "order")
    texts = rich.select("bill_id", body(F.col("title"), F.col("summary")).alias("text"))
    rows = postings.vectors(passages(texts, "bill_id", "text", p), ["bill_id", "chunk_index", "chunk"], "chunk", p.embedder_dim)
    # a bill that has no passages any more is named, so that the stored ones go
    rows = rows.unionByName(rich.select("bill_id"), allowMissingColumns=True)
    flat = rich.select("bill_id", "ordinal", "title", "summary", "outcome", "subjects", *(c for c in ("congress", "bill_type", "bill_number") if c in rich.columns))
    people, committees = kind("Legislator", "party", "state"), kind("Committee", "chamber")
    return store.merge({"bills": flat, "people": people, "committees": committees, "edges": edges_of(found), "passages": rows}, source, number)
