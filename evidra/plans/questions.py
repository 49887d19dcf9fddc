"""Many questions in one plan: both engines' retrieval as joins of a table of questions with the graph and with stored passages.

``questions`` is ``question`` (its key) and ``text``. Nothing is looped over or collected by question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import keywords
from evidra.operators.lineage import cut
from evidra.operators.postings import PostingFile
from evidra.plans.params import GraphParams, VectorParams


def _top(rows: DataFrame, k: int, *by) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(*by))).where(F.col("rank") <= k)


def with_words(questions: DataFrame) -> DataFrame:
    return questions.select("question", keywords(F.col("text")).alias("words"))


def _profile():
    """What a bill is found by: its subjects and the keywords of its title."""
    return F.array_distinct(F.array_union(F.transform("subjects", F.lower), keywords(F.col("title"))))


def lead_of(bills: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``question, words`` of the leading questions, and ``question, lead`` of all: questions with the same words that any bill has are
    answered alike by the graph, so one of them is asked for all."""
    known = bills.select(F.explode(_profile()).alias("word")).distinct()
    asked = with_words(questions).select("question", F.explode("words").alias("word")).join(known, "word", "left_semi")
    asked = cut(asked.groupBy("question").agg(F.array_sort(F.collect_set("word")).alias("words")))
    leads = asked.groupBy("words").agg(F.min("question").alias("lead"))
    return leads.select(F.col("lead").alias("question"), "words"), asked.join(leads, "words").select("question", "lead")


def seeds_of(bills: DataFrame, words: DataFrame, limit: int = 3) -> DataFrame:
    """``question, bill_id, ordinal, overlap``: as ``seed_match`` finds them, for each question.

    Bills with the same words tie, and the first ``limit`` of them by ordinal are all that can be chosen, so words are joined with these only.
    """
    b = bills.select(F.array_sort(_profile()).alias("profile"), "bill_id", "ordinal").where(F.size("profile") > 0)
    first = b.withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy("ordinal"))).where(F.col("n") <= limit).drop("n")
    first = cut(first)
    told = first.select("profile").distinct().withColumn("word", F.explode("profile"))
    asked = words.select("question", F.explode("words").alias("word"))
    hits = asked.join(told, "word").groupBy("question", "profile").agg(F.count("*").cast("int").alias("overlap"))
    return _top(hits.join(first, "profile"), limit, F.desc("overlap"), "ordinal").select("question", "bill_id", "ordinal", "overlap")


def related_of(links: DataFrame, bills: DataFrame, words: DataFrame, seeds: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """``question, item, hop, n_leg, n_com, n_sub, score, rank``: the ``top_k`` related bills of each question, scored as
    ``score_candidates`` does.

    Shared people and committees are counted, not gathered, so a hub of very many bills costs a row for each pair of question and
    bill and no list.
    """
    at, reached, layers = seeds.select("question", "bill_id"), seeds.select("question", "bill_id"), None
    for hop in range(1, p.hops + 1):
        hubs = at.join(links, "bill_id").select("question", "kind", "entity").distinct()
        near = hubs.join(links, ["kind", "entity"]).groupBy("question", "bill_id").agg(
            F.lit(hop).alias("hop"), F.count_if(F.col("kind") == "legislator").alias("n_leg"), F.count_if(F.col("kind") == "committee").alias("n_com")
        )
        layer = near.join(reached, ["question", "bill_id"], "left_anti")
        layer = cut(layer) if p.hops > 1 else layer
        layers = layer if layers is None else layers.union(layer)
        if hop < p.hops:
            at = layer.select("question", "bill_id")
            reached = reached.union(at)
    subjects = F.transform(F.coalesce("subjects", F.array().cast("array<string>")), F.lower)
    rows = layers.join(bills.select("bill_id", "subjects"), "bill_id", "left").join(words, "question")
    rows = rows.withColumn("n_sub", F.size(F.array_intersect("words", subjects)).cast("bigint"))
    score = F.pow(F.lit(0.5), F.col("hop") - 1) * (p.legislator_weight * F.col("n_leg") + p.committee_weight * F.col("n_com")) + p.subject_weight * F.col("n_sub")
    rows = rows.select("question", F.col("bill_id").alias("item"), "hop", "n_leg", "n_com", "n_sub", score.alias("score"))
    return _top(rows, p.top_k, F.desc("score"), "item")


def ask(questions: DataFrame, links: DataFrame, bills: DataFrame, stored: PostingFile, graph: GraphParams = GraphParams(), vector: VectorParams = VectorParams()) -> DataFrame:
    """``engine, question, item, score, rank``: both engines' results for each question; a bill's passages count each.

    Blank questions, and those without keywords, have no related bills; each has its passages. No questions give no rows.
    """
    words, leads = lead_of(bills, questions)
    words = cut(words)
    seeds = cut(seeds_of(bills, words, max(3, graph.top_k // 2)))
    related = related_of(links, bills, words, seeds, graph).withColumnRenamed("question", "lead")
    related = leads.join(related, "lead").select(F.lit("graph").alias("engine"), "question", "item", "score", "rank")
    found = stored.search(questions, vector.top_k).where(F.col("similarity") >= vector.similarity_threshold)
    found = found.select(F.lit("vector").alias("engine"), "question", F.col("key").alias("item"), F.col("similarity").alias("score"), "rank")
    return related.unionByName(found)
