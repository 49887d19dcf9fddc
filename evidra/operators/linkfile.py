"""Links laid out once by bill and once by hub, so that a question reads those of its seeds and of their hubs only.

Both tables are in folders by a hash of their key and in order of it, cut by ranges, so a hub of very many bills lies in several files.
``hubs`` has each hub's degree. Few keys are pushed into the scan as a list. Many are joined; links of a hub above ``LARGE`` are then dealt into
parts by their bill, and the hub is sent to each part, so no task holds more of it than its share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.lineage import cut
from evidra.plans.params import GraphParams

SLICES = 32
#: Keys that are pushed into a scan as a list, at most.
FEW = 2_000
#: Links of a hub that stay in one part.
LARGE = 100_000


def _slice(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SLICES)).cast("int")


def build(links: DataFrame, path: str) -> LinkFile:
    """Store distinct links ``kind, entity, bill_id`` under ``path``."""
    links = links.select("kind", "entity", "bill_id")
    for name, by, order in (("by_bill", ["bill_id"], ["bill_id", "kind", "entity"]), ("by_hub", ["kind", "entity"], ["kind", "entity", "bill_id"])):
        rows = links.withColumn("slice", _slice(*by)).repartitionByRange("slice", *order).sortWithinPartitions("slice", *order)
        rows.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/{name}")
    found = LinkFile(links.sparkSession, path)
    found.links("by_hub").groupBy("kind", "entity").agg(F.count("*").alias("degree")).write.mode("overwrite").parquet(f"{path}/hubs")
    return found


@dataclass
class LinkFile:
    """Links stored at ``path``."""

    spark: SparkSession
    path: str
    large: int = LARGE

    def links(self, name: str) -> DataFrame:
        return self.spark.read.schema("kind string, entity string, bill_id string, slice int").parquet(f"{self.path}/{name}")

    def hubs(self) -> DataFrame:
        return self.spark.read.schema("kind string, entity string, degree bigint").parquet(f"{self.path}/hubs")

    def of_bills(self, bills: DataFrame) -> DataFrame:
        """The links of bills ``bill_id``."""
        few = bills.select("bill_id").distinct().limit(FEW + 1).withColumn("slice", _slice("bill_id")).collect()
        rows = self.links("by_bill")
        if len(few) > FEW:
            return rows.join(bills.select("bill_id").distinct(), "bill_id", "left_semi").drop("slice")
        return rows.where(F.col("slice").isin(sorted({r["slice"] for r in few})) & F.col("bill_id").isin(sorted(r["bill_id"] for r in few))).drop("slice")

    def dealt(self, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and hubs with the part of the hub that they are in: 0 but for large hubs."""
        large = self.hubs().where(F.col("degree") > self.large).select("kind", "entity", F.ceil(F.col("degree") / self.large).cast("int").alias("parts"))
        large = F.broadcast(cut(large))  # each stands for ``large`` links
        key = ["kind", "entity"]
        rows = self.links("by_hub").drop("slice").join(large, key, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("bill_id"), F.col("parts"))).cast("int"))
        sent = hubs.select(*key).distinct().join(large, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        return rows.drop("parts"), sent.drop("parts")

    def of_hubs(self, hubs: DataFrame) -> DataFrame:
        """The links of hubs ``kind, entity``."""
        few = hubs.select("kind", "entity").distinct().limit(FEW + 1).withColumn("slice", _slice("kind", "entity")).collect()
        if len(few) > FEW:
            rows, sent = self.dealt(hubs)
            return rows.join(sent, ["kind", "entity", "part"], "left_semi").drop("part")
        rows = self.links("by_hub").where(F.col("slice").isin(sorted({r["slice"] for r in few})) & F.col("entity").isin(sorted({r["entity"] for r in few}))).drop("slice")
        return rows.join(F.broadcast(hubs.select("kind", "entity").distinct()), ["kind", "entity"], "left_semi")  # FEW rows

    def related(self, bills: DataFrame, seeds: DataFrame, query_words: list[str], p: GraphParams = GraphParams()) -> DataFrame:
        """What ``top_related`` finds of ``score_candidates``, one hop or more: bills are counted and scored first, and what they share is
        gathered for the ``top_k`` only."""
        at = reached = cut(seeds.select("bill_id"))
        layers, shown = None, None
        for hop in range(1, p.hops + 1):
            hubs = cut(self.of_bills(at).select("kind", "entity").distinct())
            near = self.of_hubs(hubs).join(reached, "bill_id", "left_anti")
            count = lambda kind: F.count_if(F.col("kind") == kind)
            layer = cut(near.groupBy("bill_id").agg(F.lit(hop).alias("hop"), count("legislator").alias("n_leg"), count("committee").alias("n_com")))
            layers = layer if layers is None else layers.unionByName(layer)
            hubs = hubs.withColumn("hop", F.lit(hop))
            shown = hubs if shown is None else shown.unionByName(hubs)
            if layer.isEmpty():
                break
            at = layer.select("bill_id")
            reached = reached.unionByName(at)
        b = bills.select("bill_id", "ordinal", "title", "outcome", F.transform(F.coalesce("subjects", F.array().cast("array<string>")), F.lower).alias("told"))
        subject = F.array_sort(F.array_intersect(F.lit(query_words).cast("array<string>"), F.coalesce("told", F.array().cast("array<string>"))))
        score = F.pow(F.lit(0.5), F.col("hop") - 1) * (p.legislator_weight * F.col("n_leg") + p.committee_weight * F.col("n_com")) + p.subject_weight * F.size("subject_overlap")
        top = layers.join(b, "bill_id", "left").withColumn("subject_overlap", subject).withColumn("score", score)
        top = cut(top.orderBy(F.desc("score"), "bill_id").limit(p.top_k).drop("told", "n_leg", "n_com"))
        shared = self.of_bills(top).join(F.broadcast(top.select("bill_id", "hop")), "bill_id").join(shown, ["kind", "entity", "hop"], "left_semi")
        entity = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("entity"))))
        lists = shared.groupBy("bill_id").agg(entity("legislator").alias("legislators"), entity("committee").alias("committees"))
        out = top.join(lists, "bill_id").select("bill_id", "ordinal", "title", "outcome", "hop", "legislators", "committees", "subject_overlap", "score")
        return out.orderBy(F.desc("score"), "bill_id")
