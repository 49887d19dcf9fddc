"""Stored indexes: vectors by cell, posting lists, snapshots that batches are merged into, and many questions at once."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions.text import hash_vector
from evidra.functions.vectors import similarity, top_chunks
from evidra.operators import ivf, postings
from evidra.operators.merge import latest, upsert_graph
from evidra.plans import engines as N
from evidra.plans.catalog import QUERIES
from evidra.plans.index import store_of, upsert_index
from evidra.plans.params import GraphParams, VectorParams
from evidra.plans.questions import ask
from evidra.sources.seed import QUESTIONS, seed_bills
from evidra.sources.snapshots import Rule, Store

SF = "/root/testdata/sf0.1"


def brute(vectors, queries, k):
    """The k nearest by cosine, ties by id, nulls last; the same rounding."""

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    stored = [(i, unit(v)) for i, v in vectors]
    out = set()
    for q, v in queries:
        u = unit(v)
        near = [(0.0 if u is None or w is None else round(float(np.dot(u, w)), ivf.PLACES) + 0.0, i) for i, w in stored]
        near.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out |= {(q, i, r + 1, round(s, 6)) for r, (s, i) in enumerate(near[:k])}
    return out


def test_exact_search_of_awkward_vectors(spark, tmp_path):
    """Nulls, zeros, components that are null or infinite, repeated vectors, null ids; cells of one block and of many."""
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(300 + i, [float(i % 3), 1.0] + [0.0] * 6) for i in range(120)]
    vectors += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [1.0] * 7), (504, [None] + [1.0] * 7), (505, [])]
    df = spark.createDataFrame(vectors, "v bigint, e array<double>").withColumns({c: F.lit("x") for c in ("cell", "id", "block", "vector")})
    queries = [(i, v) for i, v in vectors if i % 20 == 0 or i >= 500]
    asked = spark.createDataFrame(queries, "v bigint, e array<double>")
    for cells, block in ((None, 4096), (12, 16), (1, 50)):
        file = ivf.build(df, f"{tmp_path}/{cells}", "v", "e", cells=cells, block=block)
        got = {(r["query"], r["id"], r["rank"], round(r["similarity"], 6)) for r in file.search(asked, "v", "e", 7, probe=2, exact=True).collect()}
        assert got == brute(vectors, queries, 7)
    empty = ivf.build(df.where("false"), f"{tmp_path}/none", "v", "e")
    assert empty.search(asked, "v", "e").count() == 0


def test_recall_and_the_share_that_is_read(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    file = ivf.build(e, f"{tmp_path}/v", "vec_id", "embedding")
    queries = e.where("vec_id % 20 = 0")
    exact = file.search(queries, "vec_id", "embedding", 20, exact=True)
    want = {(r["query"], r["id"]) for r in exact.where("rank <= 10").collect()}
    probe = file.probe_for(0.96)
    found = {(r["query"], r["id"]) for r in file.search(queries, "vec_id", "embedding", 10, probe).collect()}
    q = queries.select(F.col("vec_id").alias("query"), ivf.unit(F.col("embedding")).alias("vector"))
    read = file.routes(q, probe).select("query", "cell").distinct().join(file.cells(), "cell").agg(F.sum("n")).first()[0]
    print("recall", len(found & want) / len(want), "read", read / (e.count() * q.count()), "cells", file.cells().count(), "probe", probe)
    assert len(found & want) >= 0.95 * len(want)
    one = QUERIES["dense_topk"](spark, SF).collect()
    mine = exact.where("query = 0").select(F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity")).collect()
    assert sorted(map(tuple, mine)) == sorted(map(tuple, one))


def passages_of(spark, n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"k{i % 90:02d}", i // 90, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 2, 5, 20])))) for i in range(n)]
    rows += [("z", 0, None), ("z", 1, ""), ("y", 0, "w1 " * 5000), ("ü", 0, "Ünïcode w1")]
    return spark.createDataFrame(rows, "k string, chunk_index int, chunk string")


@pytest.mark.parametrize("block,first", [(1024, 4), (16, 1), (7, 2)])
def test_posting_lists_against_all_passages(spark, tmp_path, block, first):
    p = passages_of(spark, 700)
    file = postings.build(p.withColumn("block", F.lit("x")), f"{tmp_path}/p", "k", block=block)
    questions = ["w0", "w1 w2 w3 w59", "w7 w7 w7 w30", "nothing of it", "", "W5 w50 unïcode", "w40 w41 w42 w43 w44 w45"]
    asked = spark.createDataFrame(list(enumerate(questions)), "question int, text string")
    got = {(r["question"], r["rank"]): (r["key"], r["chunk_index"], r["similarity"]) for r in file.search(asked, 9, first).collect()}
    for i, q in enumerate(questions):
        want = top_chunks(similarity(p, "chunk", q), 9, ["k", "chunk_index"]).orderBy(F.desc("similarity"), "k", "chunk_index").collect()
        # a passage without tokens is stored like any other and similar to nothing
        assert [got[i, r + 1] for r in range(9)] == [(w["k"], w["chunk_index"], w["similarity"]) for w in want]


def test_blocks_that_cannot_reach_are_not_opened(spark, tmp_path):
    """Of a corpus with a few close passages only some blocks pass the bound, and files of other buckets are pruned."""
    rows = [(i, 0, " ".join(f"c{(i * 7 + j) % 400}" for j in range(30))) for i in range(3000)] + [(9000 + i, 0, "rare words here") for i in range(20)]
    file = postings.build(spark.createDataFrame(rows, "k bigint, chunk_index int, chunk string"), f"{tmp_path}/p", "k", block=32)
    terms = postings._terms(postings.vectors(spark.createDataFrame([(1, "rare words here")], "question int, text string"), ["question"], "text"), ["question"], "q")
    blocks = file.lists().select("block").distinct().count()
    assert file.bounds(terms).where("bound >= 0.9999").count() * 5 < blocks
    assert {r["key"] for r in file.search(spark.createDataFrame([(1, "rare words here")], "question int, text string"), 5).collect()} == set(range(9000, 9005))
    plan = file.asked(terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [slice" in plan and "PushedFilters: [In(bucket" in plan
    sizes = [r["n"] for r in file.lists().where("slice = -1").select(F.size("keys").alias("n")).collect()]
    assert sum(sizes) == 3020 and max(sizes) <= 32


def test_stored_vectors_are_the_embedders(spark):
    text = "The tax, the Tax and a credit 2024"
    r = postings.vectors(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").first()
    want = hash_vector(text, 512)
    assert dict(zip(r["buckets"], r["weights"])) == pytest.approx(want)


def test_many_questions_are_the_single_ones(spark, tmp_path):
    """All golden questions in one plan, two hops too, against the engines asked one by one."""
    from evidra.operators.graph import decompose, links_of
    from evidra.plans.index import enrich

    b = enrich(seed_bills(spark)).cache()
    links = links_of(decompose(b)[1]).cache()
    told = N.passages(b.select("bill_id", N.body(F.col("title"), F.col("summary")).alias("text")), "bill_id", "text")
    stored = postings.build(told, f"{tmp_path}/p", "bill_id")
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)] + [(99, "zebra crossings"), (98, "")], "question int, text string")
    for hops in (1, 2):
        p = GraphParams(top_k=5, hops=hops)
        rows = ask(asked, links, b, stored, p, VectorParams(top_k=4)).collect()
        for i, (q, _) in enumerate(QUESTIONS):
            g = N.graph_retrieve(links, b, q, p).related.collect()
            assert sorted((r["rank"], r["item"], r["score"]) for r in rows if r["engine"] == "graph" and r["question"] == i) == [(k + 1, r["bill_id"], r["score"]) for k, r in enumerate(sorted(g, key=lambda r: (-r["score"], r["bill_id"])))]
            v = N.vector_retrieve(told, "bill_id", "chunk", q, VectorParams(top_k=4), stored=told).collect()
            assert sorted((r["item"], r["score"]) for r in rows if r["engine"] == "vector" and r["question"] == i) == sorted((r["bill_id"], r["similarity"]) for r in v)
        assert not [r for r in rows if r["engine"] == "graph" and r["question"] in (98, 99)] and len([r for r in rows if r["question"] == 98]) == 4


# --- snapshots ---------------------------------------------------------------------------------------


RULES = {
    "r": Rule("replace", ("id",), order="at", parts=8),
    "k": Rule("known", ("id",), order="at", parts=4),
    "s": Rule("set", ("id", "v"), by=("id",), parts=4),
    "g": Rule("group", ("i",), by=("id",), parts=4),
}


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_batches_against_plain_merges(spark, tmp_path):
    """Random batches, null values, repeated keys; each delivered twice."""
    rng = random.Random(8)
    store = Store(spark, f"{tmp_path}/s", RULES)
    r, k, s, g = {}, {}, set(), {}
    for n in range(4):
        rows = [(rng.choice([None, *range(30)]), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), at) for at in range(40)]
        rng.shuffle(rows)
        flat = spark.createDataFrame(rows, "id int, v string, w int, at int")
        group = [(i, p, f"{n}-{p}") for i in {x[0] for x in rows} for p in (range(n) if i != 3 else [None])]
        batch = {"r": flat, "k": flat, "s": flat.select("id", "v"), "g": spark.createDataFrame(group, "id int, i int, t string")}
        assert store.merge(batch, "x", n) is True
        files = sorted(map(str, Path(f"{tmp_path}/s").rglob("*.parquet")))
        assert store.merge(batch, "x", n) is False and sorted(map(str, Path(f"{tmp_path}/s").rglob("*.parquet"))) == files
        for i, v, w, _ in sorted(rows, key=lambda x: x[3]):
            r[i] = (v, w)
            old = k.get(i, (None, None))
            k[i] = (old[0] if v is None else v, old[1] if w is None else w)
            s.add((i, v))
        g.update({i: {} for i, _, _ in group})
        for i, p, t in group:
            if p is not None:
                g[i][p] = t
    assert rows_of(store.table("r")) == sorted(((i, v, w) for i, (v, w) in r.items()), key=repr)
    assert rows_of(store.table("k")) == sorted(((i, v, w) for i, (v, w) in k.items()), key=repr)
    assert rows_of(store.table("s")) == sorted(s, key=repr)
    assert rows_of(store.table("g")) == sorted(((p, i, t) for i, ps in g.items() for p, t in ps.items()), key=repr)
    before = rows_of(store.table("r", 2))
    store.vacuum(2)
    assert rows_of(store.table("r", 2)) == before and store.versions() == [2, 3]
    assert rows_of(store.table("k")) == sorted(((i, v, w) for i, (v, w) in k.items()), key=repr)


def test_untouched_parts_keep_their_files(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", RULES)
    store.merge({"r": spark.range(1000).select(F.col("id").cast("int"), F.lit("a").alias("v"), F.lit(0).alias("at"))}, "x", 0)
    was = store.manifest()["tables"]["r"]["files"]
    size = lambda: {str(p): p.stat().st_size for p in Path(f"{tmp_path}/s/data").rglob("*.parquet")}
    first = size()
    store.merge({"r": spark.createDataFrame([(5, "b", 1)], "id int, v string, at int")}, "x", 1)
    now, second = store.manifest()["tables"]["r"]["files"], size()
    assert len(was) == 8 and sum(was[p] != now[p] for p in was) == 1
    assert {p: n for p, n in second.items() if p in first} == first and sum(second.values()) - sum(first.values()) < 0.25 * sum(first.values())
    assert store.table("r").count() == 1000 and store.table("r").where("v = 'b'").count() == 1


def test_one_of_two_writers_wins_and_a_broken_merge_changes_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", RULES)
    one = spark.createDataFrame([(1, "a", 0)], "id int, v string, at int")
    store.merge({"r": one})
    manifest = store.manifest() | {"version": 1}
    store._put(manifest)
    with pytest.raises(RuntimeError, match="another writer"):
        store._put(manifest)
    broken = one.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.merge({"r": broken})
    assert store.versions() == [0, 1] and store.table("r").count() == 1
    assert store.merge({"r": one.where("false")}, "y", 7) and store.merge({"r": one}, "y", 7) is False
    with pytest.raises(LookupError):
        store.table("g")


def test_a_repeated_key_is_named(spark, tmp_path):
    """The checked constraint: the last row wins, or with ``strict`` the load names the key."""
    two = spark.createDataFrame([("118-HR-1", "one", 0), ("118-HR-1", "two", 1), ("118-HR-2", "x", 0)], "bill_id string, title string, at int")
    assert {(r["bill_id"], r["title"]) for r in latest(two, ["bill_id"], "at").collect()} == {("118-HR-1", "two"), ("118-HR-2", "x")}
    with pytest.raises(Exception, match="more than one row of 118-HR-1"):
        latest(two, ["bill_id"], "at", strict=True).collect()
    strict = Store(spark, f"{tmp_path}/s", {"b": Rule("replace", ("bill_id",), order="at", strict=True)})
    with pytest.raises(Exception, match="more than one row of 118-HR-1"):
        strict.merge({"b": two})
    assert strict.versions() == []


def test_nodes_and_their_properties(spark):
    """One node a key: the last title of a bill, even a null one, and what is known of people."""
    from evidra.operators.graph import decompose

    person = lambda *v: dict(zip(("bioguide_id", "full_name", "party", "state"), v))
    bill = lambda o, k, t, s, c, p: {"ordinal": o, "bill_id": k, "title": t, "outcome": "became_law", "sponsor": s, "cosponsors": c, "committees": p}
    panel = lambda n, c: {"name": n, "chamber": c}
    schema = "ordinal int, bill_id string, title string, outcome string, sponsor struct<bioguide_id:string,full_name:string,party:string,state:string>, cosponsors array<struct<bioguide_id:string,full_name:string,party:string,state:string>>, committees array<struct<name:string,chamber:string>>"
    rows = [bill(1, "a", "first", person("P", "Old Name", "D", None), [person("Q", "Zed", None, None)], [panel("C", "House")]), bill(2, "a", "second", person("P", "New Name", None, "OH"), None, [panel("C", None), panel("", "x")]), bill(3, "b", "t", None, [person("Q", "Abe", "R", None), person(None, "x", "x", "x")], None)]
    nodes, edges = decompose(spark.createDataFrame(rows, schema))
    got = {(r["label"], r["key"]): (r["name"], r["party"], r["state"], r["chamber"], r["outcome"]) for r in nodes.collect()}
    assert got == {("Bill", "a"): ("second", None, None, None, "became_law"), ("Bill", "b"): ("t", None, None, None, "became_law"), ("Legislator", "P"): ("New Name", "D", "OH", None, None), ("Legislator", "Q"): ("Abe", "R", None, None, None), ("Committee", "C"): ("C", None, None, "House", None)}
    later = spark.createDataFrame([bill(1, "a", None, person("P", None, None, "TX"), [], [])], schema)
    n, e = upsert_graph(nodes, edges, *decompose(later))
    got = {(r["label"], r["key"]): (r["name"], r["party"], r["state"]) for r in n.collect()}
    assert got["Bill", "a"] == (None, None, None) and got["Legislator", "P"] == ("New Name", "D", "TX") and e.count() == edges.count()


def test_index_of_the_seed_in_batches(spark, tmp_path):
    b = seed_bills(spark)
    store = store_of(spark, f"{tmp_path}/i")
    assert upsert_index(store, b.where("ordinal < 10"), 0) and upsert_index(store, b.where("ordinal >= 8"), 1) and not upsert_index(store, b.where("ordinal < 10"), 1)
    assert store.table("bills").count() == 16 and store.table("people").count() == 6 and store.table("passages").count() >= 16
    none = b.where("ordinal = 0").withColumns({"title": F.lit(""), "summary": F.lit(None).cast("string")})
    before = store.table("passages").count()
    upsert_index(store, none, 2)
    assert store.table("passages").count() < before and store.table("bills").count() == 16


def test_a_batch_is_worked_out_once_and_dealt_once(spark, tmp_path):
    """A batch that comes again is not worked out at all, one into an empty table is shuffled once, one into a filled table once more with the
    stored rows; a task's share of a part stays small."""
    b = seed_bills(spark)
    store = store_of(spark, f"{tmp_path}/i")
    upsert_index(store, b, 0)
    broken = b.withColumn("title", F.raise_error(F.lit("worked out")).cast("string"))
    assert upsert_index(store, broken, 0) is False
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for x in batches:
            worked.add(x.num_rows)
            yield x

    rows = spark.range(0, 3000, 1, 4).select((F.col("id") % 500).cast("int").alias("id"), F.concat(F.lit("v"), F.col("id") % 7).alias("v"), F.col("id").cast("int").alias("at"))
    for name, rule in RULES.items():
        new = rows.select("id", (F.col("at") % 3).alias("i"), "v") if name == "g" else rows.select("id", "v") if name == "s" else rows
        two = Store(spark, f"{tmp_path}/{name}", RULES)
        first = rule.met(None, rule.single(new))
        assert first._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        for n in range(2):
            worked.value = 0
            two.merge({name: new.mapInArrow(seen, new.schema)}, "x", n)
            assert worked.value == 3000
        assert rows_of(two.table(name)) == rows_of(first.drop("part", "_share"))
        assert not [p for p in Path(f"{tmp_path}/{name}/data/{name}").iterdir() if p.name.endswith("-batch")]


# --- links -------------------------------------------------------------------------------------------


def test_links_laid_out_and_a_hub_of_all_bills(spark, tmp_path, monkeypatch):
    """The same related bills as from the whole table, by one hop and by three, with keys as lists and by joins; no part of a hub above
    its share."""
    from evidra.operators import graph as G
    from evidra.operators import linkfile

    rng = random.Random(9)
    n = 900
    rows = {("committee", "ALL", f"B{i}") for i in range(n)} | {(k, f"{k[0]}{rng.randrange(200)}", f"B{rng.randrange(n)}") for k in ("legislator", "committee") for _ in range(2500)}
    links = spark.createDataFrame(sorted(rows), "kind string, entity string, bill_id string").cache()
    bills = spark.createDataFrame([(f"B{i}", i, f"title {i}", "became_law", ["tax"] if i % 7 == 0 else []) for i in range(n)], "bill_id string, ordinal int, title string, outcome string, subjects array<string>")
    seeds = bills.where("ordinal in (3, 4, 500)").select("bill_id", "ordinal")
    for few, large in ((2000, 100_000), (2, 50)):
        monkeypatch.setattr(linkfile, "FEW", few)
        file = linkfile.build(links, f"{tmp_path}/{few}")
        file.large = large
        for hops in (1, 3):
            p = GraphParams(top_k=8, hops=hops)
            want = G.top_related(G.score_candidates(links, bills, seeds, ["tax"], hops), 8).collect()
            assert file.related(bills, seeds, ["tax"], p).collect() == want
    parts, sent = file.dealt(spark.createDataFrame([("committee", "ALL"), ("committee", "c1")], "kind string, entity string"))
    sizes = {(r["entity"], r["part"]): r["count"] for r in parts.groupBy("kind", "entity", "part").count().collect()}
    assert max(sizes.values()) <= 2 * 50 and len([k for k in sizes if k[0] == "ALL"]) == 18 and sent.where("entity = 'ALL'").count() == 18
    plan = linkfile.build(links, f"{tmp_path}/p").of_bills(seeds)
    monkeypatch.setattr(linkfile, "FEW", 2000)
    plan = linkfile.LinkFile(spark, f"{tmp_path}/p").of_bills(seeds)._jdf.queryExecution().toString()
    assert "PartitionFilters: [slice" in plan and "In(bill_id" in plan


def test_a_built_index_answers(spark, tmp_path):
    from evidra.plans.index import Index, build_index, enrich

    b = seed_bills(spark)
    build_index(b, f"{tmp_path}/i")
    index, q = Index(spark, f"{tmp_path}/i"), QUESTIONS[0][0]
    from evidra.operators.graph import decompose, links_of

    rich = enrich(b)
    want = N.graph_retrieve(links_of(decompose(rich)[1]), rich, q).related.collect()
    assert [(r["bill_id"], r["score"], r["legislators"], r["committees"]) for r in index.related(q).collect()] == [(r["bill_id"], r["score"], r["legislators"], r["committees"]) for r in want]
    plain = N.vector_retrieve(index.table("passages"), "bill_id", "chunk", q, VectorParams(), stored=index.table("passages"))
    served = N.vector_retrieve(index.table("passages"), "bill_id", "chunk", q, VectorParams(), stored=index.stored_passages())
    pick = lambda df: sorted((r["bill_id"], r["chunk_index"], r["chunk"], r["similarity"]) for r in df.collect())
    assert pick(served) == pick(plain) and "title" in served.columns
    trace, result = N.execute(N.vector_engine(index.table("passages"), "bill_id", "chunk", q, VectorParams(), stored=index.stored_passages()))
    assert [e["rows"] for e in trace if e["phase"] == "done"][:2] == [6, 6] and "Outcomes of the matched bills" in result["answer"]["answer"]
    index.reset()
    assert index.count("bills") == 0
