"""What must not grow with the square of a table, or beyond a task's memory."""

from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from evidra.functions import text as X
from evidra.functions.text import hash_vector
from evidra.functions.vectors import STEP, dense, embed, similarity, top_chunks
from evidra.operators import graph as G
from evidra.operators import postings
from evidra.operators.metrics import retrieval_metrics
from evidra.plans.evaluation import class_measures
from evidra.sources.records import parse_xml


def test_copies_of_a_passage_are_one_entry_of_a_task(spark, tmp_path):
    """3,000 passages of six texts, in two tasks: entries are texts, and a search still finds the first copies in order."""
    texts = ["large ring", "small ring", "large bolt", "old plate", "", "ring ring bolt"]
    p = spark.range(0, 3000, 1, 2).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 3000).cast("string")).alias("k"), (F.col("id") % 3).cast("int").alias("chunk_index"), F.get(F.lit(texts), (F.col("id") % 6).cast("int")).alias("chunk"))
    file = postings.build(p, f"{tmp_path}/p", "k", block=4)
    assert file.members().select("block", "at").distinct().count() <= 12
    assert file.members().select("key", "chunk_index").distinct().count() == 3000
    assert file.lists().where("slice >= 0").select(F.max(F.size("at"))).first()[0] <= 4
    asked = ["ring", "large ring", "plate bolt", "nothing", ""]
    got = file.search(spark.createDataFrame(list(enumerate(asked)), "question int, text string"), 9).collect()
    for i, q in enumerate(asked):
        want = top_chunks(similarity(p, "chunk", q), 9, ["k", "chunk_index"]).orderBy(F.desc("similarity"), "k", "chunk_index").collect()
        assert [(r["key"], r["chunk_index"], r["similarity"]) for r in sorted(got, key=lambda r: r["rank"]) if r["question"] == i] == [(w["k"], w["chunk_index"], w["similarity"]) for w in want]


def test_measures_by_class_are_those_of_all_relevant_pairs(spark):
    """A class of very many items is counted, not joined: 1,000 queries with 20,000 relevant items each are no 20 million rows."""
    queries = spark.range(1000).select(F.col("id").alias("query"), F.lit(1).alias("a"), F.when(F.col("id") % 5 > 0, "x").alias("b"))
    items = spark.range(20_003).select(F.col("id").alias("item"), F.when(F.col("id") > 2, 1).otherwise(2).alias("a"), F.when(F.col("id") % 7 > 0, "x").alias("b"))
    found = queries.select("query", F.explode(F.sequence(F.lit(1), (1 + F.col("query") % 4).cast("int"))).alias("rank")).withColumn("item", (F.col("query") + 5 * F.col("rank")) % 40)
    found = found.select(F.when(F.col("query") % 3 > 0, "graph").otherwise("vector").alias("engine"), "query", "item", "rank")
    got = class_measures(found, queries, items, ["a", "b"])
    few = found.where("query < 30"), queries.where("query < 30").join(items.where("item < 40"), ["a", "b"]).select("query", "item")
    for e in ("graph", "vector"):
        mine = {r["query"]: r for r in got.where((F.col("engine") == e) & (F.col("query") < 30)).collect()}
        want = {r["query"]: r for r in retrieval_metrics(few[0].where(F.col("engine") == e).drop("engine"), few[1]).collect()}
        assert mine.keys() == want.keys() and len(mine) == 24
        assert all(mine[q]["precision"] == want[q]["precision"] and mine[q]["reciprocal_rank"] == want[q]["reciprocal_rank"] for q in want)
        # recall is over the whole class, of which 17,143 items are there
        assert all(round(mine[q]["recall"] * 17_143) == round(want[q]["recall"] * 32) for q in want)


def test_similarity_counts_tokens_in_batches(spark):
    rows = [(1, "a b a"), (2, "ring " * 1500 + "bolt"), (3, ""), (4, None), (5, "İ ring"), (1, "b c"), (None, "x y"), (None, "x")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = [r["similarity"] for r in similarity(df, "t", "ring b").collect()]
    plan = similarity(df, "t", "ring b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    q = hash_vector("ring b", 512)
    assert all(abs(g - sum(w * q.get(b, 0.0) for b, w in hash_vector(t or "", 512).items())) < 1e-12 for g, (_, t) in zip(got, rows))


def test_a_document_is_parsed_once(spark):
    docs = spark.range(3).select(F.col("id").alias("source"), F.concat(F.lit("<billStatus><bill><congress>115</congress><title>T</title></bill>"), F.when(F.col("id") < 2, "</billStatus>").otherwise("<")).alias("xml"))
    found = parse_xml(docs, "xml", "2025-06-30")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs(") == 1
    assert [(r["source"], r["title"]) for r in found.orderBy("source").collect()] == [(0, "T"), (1, "T")]


def test_tokens_are_counted_before_anything_is_shuffled(spark):
    """A text, not each of its tokens, goes through the shuffle; rows of a key are one vector, within a task's step, across steps and across tasks."""
    n = 2 * STEP + 500
    rows = [(1, "a b a"), (None, "x y"), (3, ""), (4, None), (1, "b c"), (None, "x"), (5, "İ ring"), *((6, "a" if i % 2 else "b b") for i in range(n)), *((i, f"a w{i}") for i in range(7, n))]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    got = {}
    for r in embed(df, ["k"], "t").collect():
        got.setdefault(r["k"], {})[r["bucket"]] = r["w"]
    texts = {}
    for k, t in rows:
        texts[k] = f"{texts.get(k, '')} {t or ''}"
    want = {k: hash_vector(t, 512) for k, t in texts.items()}
    want = {k: v for k, v in want.items() if v}
    assert got.keys() == want.keys()
    assert all(got[k].keys() == want[k].keys() and all(abs(got[k][b] - w) < 1e-12 for b, w in want[k].items()) for k in want)
    whole = {r["k"]: r["vector"] for r in dense(df, ["k"], "t").collect()}
    assert whole.keys() == want.keys() and all(len(v) == 512 and all(abs(x - want[k].get(b, 0.0)) < 1e-12 for b, x in enumerate(v)) for k, v in whole.items())
    assert embed(df.where("k = 3"), ["k"], "t").count() == 0
    plan = embed(df, ["k"], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Aggregate" not in plan


def test_pairs_of_bills_by_lists(spark, monkeypatch):
    """Hubs at the cap and beyond it, bills out of scope, a bill of many links that is dealt into parts; a list, not each pair, is shuffled."""
    monkeypatch.setattr(G, "MANY", 30)
    hubs = {("legislator", f"L{i}"): {"B0", *(f"B{(i * k) % 97}" for k in range(1, 2 + i % 9))} for i in range(150)}
    hubs |= {("committee", f"C{i}"): {f"B{(7 * i + k) % 97}" for k in range(i)} for i in range(50)} | {("other", "X"): {"B0", "B1"}, ("committee", None): {"B2", "B3"}}
    rows = [(kind, e, b) for (kind, e), bs in hubs.items() for b in bs]
    links, scope = spark.createDataFrame(rows, "kind string, entity string, bill_id string"), spark.createDataFrame([(f"B{i}",) for i in range(90)], "bill_id string")
    kept = {h: sorted(b for b in bs if int(b[1:]) < 90) for h, bs in hubs.items() if h[1]}
    kept = {h: bs for h, bs in kept.items() if 2 <= len(bs) <= 40}
    want = {k: Counter((a, b) for h, bs in kept.items() if h[0] == k for a, b in combinations(bs, 2)) for k in ("legislator", "committee")}
    both = want["legislator"] + want["committee"] + Counter([("B0", "B1")])
    got = G.bill_pairs(links, scope)
    assert sorted((r["a"], r["b"], r["sponsors"], r["committees"]) for r in got.collect()) == sorted((*p, want["legislator"][p], want["committee"][p]) for p in both)
    assert G.hub_lists(links, scope).select(F.max(F.size("bills"))).first()[0] == max(map(len, kept.values())) and G.hub_lists(links, scope).where("size(many) > 0").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(a" in plan and "hashpartitioning(a#0, b" not in plan
    assert got.select("a", "b").distinct().count() == len(both)
    bills = scope.select("bill_id", F.lit("t").alias("title"), F.lit("115").alias("congress"), F.lit("hr").alias("bill_type"), F.lit("1").alias("bill_number"), F.lit("x").alias("outcome"), F.array().cast("array<string>").alias("subjects"))
    for least in (1, 3):
        weight = {p: want["legislator"][p] + want["committee"][p] for p in both}
        weight = {p: w for p, w in weight.items() if w >= least}
        degree = Counter()
        for (a, b), w in weight.items():
            degree[a] += w
            degree[b] += w
        nodes, edges = G.bill_graph(links, bills, limit=20, min_shared=least)
        top = sorted((f"B{i}" for i in range(90)), key=lambda b: (-degree[b], b))[:20]
        assert {r["bill_id"]: r["degree"] for r in nodes.collect()} == {b: degree[b] for b in top}
        assert {(r["a"], r["b"]): r["weight"] for r in edges.collect()} == {p: w for p, w in weight.items() if p[0] in top and p[1] in top}
    near = G.ego(G.bill_pairs(G.around(links, "B0"), scope).select("a", "b", (F.col("sponsors") + F.col("committees")).alias("weight")), "B0")
    assert sorted((r["neighbour"], r["weight"]) for r in near.collect()) == sorted((b, want["legislator"][a, b] + want["committee"][a, b]) for a, b in both if a == "B0")


def test_neighbours_are_sets(spark):
    """Each node's set, whole: edges that come twice or both ways, loops, groups, and nodes whose rows go on over many batches."""
    edges = [("b", "a"), ("a", "b"), ("a", "b"), ("a", "c"), ("d", "d"), ("e", None)]
    groups = spark.createDataFrame([(list(e),) for e in edges] + [(["c", "b", "f"],), ([],), (None,)], "bills array<string>")
    want = {"a": ["b", "c"], "b": ["a", "c", "f"], "c": ["a", "b", "f"], "f": ["b", "c"]}
    assert {r["node"]: r["neighbours"] for r in G.neighbours(groups).collect()} == want
    lists = [[f"B{(i * k) % 211}" for k in range(1, 3 + i % 9)] + ["B0"] for i in range(400)]
    want = {}
    for x in lists:
        for n in x:
            want.setdefault(n, set()).update(x)
    want = {n: sorted(x - {n}) for n, x in want.items() if x - {n}}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (was, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = G.neighbours(spark.createDataFrame([(x,) for x in lists], "bills array<string>"))
            assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
            assert {r["node"]: r["neighbours"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_pieces_of_a_batch_are_not_held_whole(spark):
    """A batch of many texts leaves a task in steps; pieces stay with their rows."""
    n = 2 * X.STEP + 7
    made = X.by_steps(iter([pd.Series([f"t{i}" for i in range(n)]), pd.Series([], dtype=object), pd.Series([None])]), lambda t: [t or ""])
    assert [len(x) for x in made] == [X.STEP, X.STEP, 7, 1]
    df = spark.range(0, n, 1, 1).withColumn("t", F.when(F.col("id") % 5 > 0, F.concat(F.lit("Large ring "), F.col("id").cast("string"), F.lit(". Old plate. Ring."))))
    for strategy, cut in (("semantic", lambda t: X.group_semantic(t, 20)), ("recursive", lambda t: X.pack_sentences(t, 20, 5))):
        got = df.select("t", X.chunks(F.col("t"), strategy, 20, 5).alias("c")).collect()
        assert len(got) == n and all(r["c"] == (cut(r["t"]) if r["t"] else []) for r in got)
