"""Both engines, the index and the measures over the seed corpus; goldens worked out by hand from the rules."""

import math

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidra.functions.vectors import build_embedder, similarity
from evidra.operators import graph as G
from evidra.operators.graph import decompose, links_of
from evidra.plans import engines as N
from evidra.plans.evaluation import evaluate
from evidra.plans.index import Index, build_index, enrich
from evidra.plans.params import GraphParams, VectorParams
from evidra.sources.seed import BILLS, QUESTIONS, golden, seed_bills


@pytest.fixture(scope="module")
def corpus(spark):
    b = enrich(seed_bills(spark)).cache()
    return b, links_of(decompose(b)[1]).cache()


SEEDS = ["118-HR-410", "117-HR-980 118-HR-700 118-HR-22", "118-HR-512", "117-HR-330", "118-HR-22 118-S-150 117-HR-980", "117-HR-1205"]
SCORES = [[5, 5, 5, 4, 3, 3], [7, 6, 5, 5, 4, 4], [5, 4, 2, 2, 2, 2], [5, 4, 4, 2, 2, 2], [4, 4, 4, 3, 2, 2], [5, 5, 5, 4, 4, 4]]
P_R = [(0.5, 0.75), (1 / 6, 1 / 3), (1 / 3, 2 / 3), (1 / 3, 2 / 3), (0, 0), (1 / 6, 1 / 3)]


@pytest.mark.parametrize("k", range(6))
def test_golden_questions(spark, corpus, k):
    b, links = corpus
    words = N.question_words(spark, QUESTIONS[k][0])
    seeds = G.seed_match(b, words)
    assert [r["bill_id"] for r in seeds.orderBy(F.desc("overlap"), "ordinal").collect()] == SEEDS[k].split()
    top = G.top_related(G.score_candidates(links, b, seeds, words)).collect()
    assert [r["score"] for r in top] == SCORES[k]


def test_two_hops_decay(spark, corpus):
    b, links = corpus
    words = N.question_words(spark, QUESTIONS[2][0])
    got = {r["bill_id"]: r["score"] for r in G.score_candidates(links, b, G.seed_match(b, words), words, hops=2).collect()}
    assert got["117-HR-888"] == 5 and got["118-S-222"] == 3.5 and got["118-HR-22"] == 1.5 and got["118-S-150"] == 1 and len(got) == 15


def test_projection_of_the_seed(spark, corpus):
    b, links = corpus
    for least, n in ((1, 78), (2, 34), (3, 10), (4, 0)):
        nodes, edges = G.bill_graph(links, b, min_shared=least)
        assert nodes.count() == 16 and edges.count() == n
    nodes, edges = G.bill_graph(links, b)
    assert {r["rel"]: r["count"] for r in edges.groupBy("rel").count().collect()} == {"sponsor": 55, "both": 15, "committee": 8}
    rows = nodes.collect()
    top = {r["bill_id"]: r["degree"] for r in rows}
    assert top["117-HR-1205"] == 23 and top["118-S-150"] == 8 and rows[0]["total_bills"] == 16
    one = next(r for r in rows if r["bill_id"] == "118-HR-410")
    assert (one["label"], one["type_name"], one["title"]) == ("H.R. 410 (118th)", "House Bill", "Prescription Drug Affordability Act") and "healthcare" in one["subjects"]


def test_graph_engine(spark, corpus):
    b, links = corpus
    trace, result = N.execute(N.graph_engine(links, b, "immigration visa reform"))
    assert [e["step"] for e in trace if e["phase"] == "done"] == list(N.GRAPH_STEPS) and [e["phase"] for e in trace] == ["start", "done"] * 7
    assert {r["bill_id"] for r in result["tables"]["seed_match"].collect()} == {"117-HR-330", "118-HR-150", "118-S-222"}
    assert result["answer"]["n"] == 6 and result["answer"]["verdict"] in ("likely", "unlikely")
    whole = N.graph_retrieve(links, b, "immigration visa reform", GraphParams(top_k=12))
    assert whole.related.count() > 6 and whole.edges.count() > 0
    _, nothing = N.execute(N.graph_engine(links, b, "zebra crossings"))
    assert nothing["answer"]["n"] == 0 and nothing["answer"]["verdict"] == "unlikely" and nothing["answer"]["rate"] is None
    with pytest.raises(ValueError):
        next(iter(N.execute(N.graph_engine(links, b, "  "))))


def test_vector_engine(spark, corpus):
    b, _ = corpus
    texts = b.select("bill_id", "outcome", N.body(F.col("title"), F.col("summary")).alias("text"))
    trace, result = N.execute(N.vector_engine(texts, "bill_id", "text", "prescription drug", VectorParams(top_k=5, similarity_threshold=0.2)))
    assert [e["step"] for e in trace if e["phase"] == "done"] == list(N.VECTOR_STEPS)
    found, report = result["tables"]["embed_search"].collect(), result["tables"]["report"].first()
    assert found[0]["bill_id"] == "118-HR-410" and len(found) == 5
    assert (report["embedder"], report["vector_dim"], report["chunk_count"] + report["dropped_below_threshold"]) == ("hashing-tf-512", 512, 5) and report["index_mode"].startswith("passages cut")
    assert report["dropped_below_threshold"] == sum(r["similarity"] < 0.2 for r in found) > 0


def test_similarity_is_the_cosine(spark):
    e = build_embedder(dim=64)
    texts = ["", "tax tax drug", "Tax", "nothing alike here", None, "drug " * 500 + "tax"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    q = e.query("tax and drug policy")
    for r in similarity(df, "t", "tax and drug policy", 64).collect():
        v = e.query(r["t"] or "")
        assert math.isclose(r["similarity"], sum(a * b for a, b in zip(q, v)), abs_tol=1e-12)
    with pytest.raises(ValueError):
        build_embedder("other")


def test_index(spark, tmp_path):
    b = seed_bills(spark)
    index = Index(spark, f"{tmp_path}/i")
    assert build_index(b.where("false"), index.path) == 0 and index.count("bills") == 0
    assert build_index(b, index.path) == 16 and index.count("passages") >= 16 and index.count("links") == index.table("links").distinct().count()
    assert build_index(b.limit(3), index.path) == 16  # what is there stays
    assert build_index(b.limit(3), index.path, rebuild=True) == 3
    stored = index.table("passages")
    found = N.vector_retrieve(stored, "bill_id", "chunk", "prescription drug", VectorParams(), stored=stored)
    assert found.count() <= 6
    index.close()
    index.reset()
    assert index.count("bills") == 0


def test_evaluation(spark, corpus):
    b, links = corpus
    texts = b.select("bill_id", "title", "outcome", N.body(F.col("title"), F.col("summary")).alias("text"))
    measures, both, means = evaluate(golden(spark), links, b, N.passages(texts, "bill_id", "text"))
    got = {r["query"]: (r["precision"], r["recall"]) for r in measures.where("engine = 'graph'").collect()}
    for (q, _), (p, r) in zip(QUESTIONS, P_R):
        assert math.isclose(got[q][0], p, abs_tol=1e-9) and math.isclose(got[q][1], r, abs_tol=1e-9)
    assert both.count() == 6 and all(0 <= r["jaccard"] <= 1 for r in both.collect())
    mean = means.where("engine = 'graph'").first()
    assert math.isclose(mean["precision"], sum(p for p, _ in P_R) / 6, abs_tol=1e-9)


def test_lookup_and_rechunk(spark, corpus):
    b, _ = corpus
    assert N.lookup(b, "bill_id", "118-HR-22").first()["title"] == "Small Business Tax Relief Act"
    with pytest.raises(LookupError):
        N.lookup(b, "bill_id", "1-HR-1")
    one = N.rechunk(b, "118-HR-22", 0, 0).collect()
    assert [r["chunk"] for r in one] == ["Small Business Tax Relief Act. A measure on small business tax relief."] and one[0]["chunk_id"] == "118-HR-22#0"
    assert N.rechunk(b, "118-HR-22", 10, 0, "fixed").count() == 7
    empty = spark.createDataFrame([("x", None, None, None), ("y", "T", "", None), ("z", None, "S", None)], "bill_id string, title string, summary string, outcome string")
    assert [r[0] for r in empty.select(N.body(F.col("title"), F.col("summary"))).collect()] == ["", "T", "S"]


def test_params():
    assert GraphParams.from_dict({"hops": 2, "top_k": None, "other": 1}) == GraphParams(hops=2)
    assert VectorParams.from_dict(None) == VectorParams() and not VectorParams(top_k=9, similarity_threshold=0.5).is_custom and VectorParams(chunk_size=100).is_custom
    assert N.settings()["graph"]["top_k"] == 6 and len(BILLS) == 16


def test_an_index_works_its_bills_out_once(spark, corpus, tmp_path):
    """Whether there are bills is read from what was written; no bills leave a stored index as it is, and properties that no part has are not compared."""
    b, _ = corpus
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(x.num_rows)
            yield x

    path = f"{tmp_path}/once"
    assert build_index(b.mapInArrow(counted, b.schema), path) == 16 and read.value == 16
    assert build_index(b.where("false"), path, rebuild=True) == 0 and Index(spark, path).count("bills") == 16
    assert not [p for p in Path(path).iterdir() if p.name.startswith("new-")]
    bare = spark.createDataFrame([("B1", "t", ("P1", "Ann"), [("P2", None)], [("C1",)])], "bill_id string, title string, sponsor struct<bioguide_id:string,full_name:string>, cosponsors array<struct<bioguide_id:string,full_name:string>>, committees array<struct<name:string>>")
    nodes, _ = G.decompose(bare)
    assert {(r["label"], r["key"], r["name"], r["party"]) for r in nodes.collect()} == {("Legislator", "P1", "Ann", None), ("Legislator", "P2", None, None), ("Committee", "C1", "C1", None), ("Bill", "B1", "t", None)}
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") <= 2  # the name of people and committees, and a bill's own properties
