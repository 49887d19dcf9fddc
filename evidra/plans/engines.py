"""A question answered in two ways, by shared links and by similar passages."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evidra.functions import wording as W
from evidra.functions.records import enactment_rate, outcome_label, verdict
from evidra.functions.text import OVERLAP, SIZE, chunks
from evidra.functions.text import keywords as keywords_of
from evidra.functions.vectors import build_embedder, top_chunks
from evidra.operators.graph import expand, score_candidates, seed_match, subgraph, top_related
from evidra.operators.lineage import cut
from evidra.operators.postings import PostingFile
from evidra.plans.params import GraphParams, VectorParams

GRAPH_STEPS = ("parse_query", "seed_match", "expand_graph", "score_related", "retrieve", "build_context", "answer")
VECTOR_STEPS = ("embed_search", "retrieve", "build_context", "answer")


@dataclass(frozen=True)
class StoredPassages:
    """Passages that were cut when an index was built, and the posting lists of their vectors."""

    passages: DataFrame
    lists: PostingFile


@dataclass
class GraphResult:
    keywords: list[str]
    seeds: DataFrame
    hubs: DataFrame
    related: DataFrame
    nodes: DataFrame
    edges: DataFrame


def question_words(spark, question: str) -> list[str]:
    """Keywords of a question, by the same expression as for texts."""
    if not question.strip():
        raise ValueError("the question is empty")
    return spark.range(1).select(keywords_of(F.lit(question)).alias("w")).first()["w"]


def graph_retrieve(links: DataFrame, bills: DataFrame, question: str, p: GraphParams = GraphParams()) -> GraphResult:
    """All of the graph retrieval at once; it takes half as many seeds as results, three at least."""
    words = question_words(bills.sparkSession, question)
    seeds = cut(seed_match(bills, words, max(3, p.top_k // 2)))
    scored = score_candidates(links, bills, seeds, words, p.hops, p.legislator_weight, p.committee_weight, p.subject_weight)
    related = top_related(scored, p.top_k)
    nodes, edges = subgraph(links, bills, seeds, related)
    return GraphResult(words, seeds, expand(links, seeds), related, nodes, edges)


def passages(texts: DataFrame, key: str, text: str, p: VectorParams = VectorParams()) -> DataFrame:
    """One row per chunk: the columns of ``texts`` but its text, ``chunk_id``, ``chunk_index``, ``chunk``."""
    rest = [c for c in texts.columns if c != text]
    cut = texts.select(*rest, F.posexplode(chunks(F.col(text), p.chunk_strategy, p.chunk_size, p.chunk_overlap)).alias("chunk_index", "chunk"))
    return cut.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("#"), F.col("chunk_index").cast("string")))


def body(title: Column, summary: Column) -> Column:
    """What is cut into chunks of a bill: its title and summary, whatever of them there is."""
    return F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(summary, F.lit("")))


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with a key; an error if there is none."""
    found = df.where(F.col(key) == value).limit(1).collect()
    if not found:
        raise LookupError(f"no such {key}: {value}")
    return df.sparkSession.createDataFrame(found, df.schema)


def rechunk(bills: DataFrame, bill_id: str, size: int | None = None, overlap: int | None = None, strategy: str | None = None) -> DataFrame:
    """One bill's chunks as other parameters would cut it: ``bill_id, title, outcome, chunk_id, chunk_index, chunk``. A size of 0
    or none is the default one, an overlap of 0 is kept."""
    p = VectorParams(chunk_strategy=strategy or VectorParams.chunk_strategy, chunk_size=size or SIZE, chunk_overlap=OVERLAP if overlap is None else overlap)
    one = lookup(bills, "bill_id", bill_id).select("bill_id", "title", "outcome", body(F.col("title"), F.col("summary")).alias("text"))
    return passages(one, "bill_id", "text", p)


def vector_retrieve(texts: DataFrame, key: str, text: str, question: str, p: VectorParams = VectorParams(), stored: DataFrame | StoredPassages | None = None) -> DataFrame:
    """The passages most similar to a question; ``stored`` passages serve unless the parameters ask for others. Stored with their
    posting lists, they are searched through these, and only the passages found are read."""
    if not question.strip():
        raise ValueError("the question is empty")
    if isinstance(stored, StoredPassages) and not p.is_custom:
        asked = texts.sparkSession.createDataFrame([(0, question)], "question int, text string")
        found = stored.lists.search(asked, p.top_k).where(F.col("similarity") >= p.similarity_threshold).withColumnRenamed("key", key)
        found = found.select(key, "chunk_index", "similarity", F.round(1 - F.col("similarity"), 4).alias("distance"))
        return stored.passages.join(F.broadcast(found), [key, "chunk_index"])  # top_k rows
    stored = stored.passages if isinstance(stored, StoredPassages) else stored
    found = passages(texts, key, text, p) if stored is None or p.is_custom else stored
    scored = build_embedder(dim=p.embedder_dim).similarity(found, "chunk", question)
    return top_chunks(scored, p.top_k, [key, "chunk_index"], p.similarity_threshold)


def search_report(found: DataFrame, question: str, p: VectorParams = VectorParams(), stored: bool = False) -> DataFrame:
    """One row about a search, from its top-k before the threshold: ``index_mode, chunk_strategy, embedder, vector_dim,
    query_vector_preview, chunk_count, dropped_below_threshold``."""
    e = build_embedder(dim=p.embedder_dim)
    mode = "stored passages" if stored and not p.is_custom else "passages cut for this question"
    stays = F.col("similarity") >= p.similarity_threshold
    counts = found.agg(F.count_if(stays).alias("chunk_count"), F.count_if(~stays).alias("dropped_below_threshold"))
    shown = F.lit([round(x, 4) for x in e.query(question)[:8]])
    return counts.select(F.lit(mode).alias("index_mode"), F.lit(p.chunk_strategy).alias("chunk_strategy"), F.lit(e.name).alias("embedder"), F.lit(e.dim).alias("vector_dim"), shown.alias("query_vector_preview"), *counts.columns)


# --- contexts and extractive answers, over the few rows retrieved ----------------------------------


def _lines(place: Column, line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line")))), lambda x: x["line"]), "\n")


def _percent(rate: Column) -> Column:
    return F.concat(F.bround(rate * 100).cast("int").cast("string"), F.lit("%"))


def graph_context(related: DataFrame) -> DataFrame:
    """``context, n, rate, verdict, answer``: one row, also where nothing is related."""
    shared = F.concat_ws(
        ", ",
        F.when(F.size("legislators") > 0, F.concat(F.size("legislators").cast("string"), F.lit(" shared sponsor(s)"))),
        F.when(F.size("committees") > 0, F.concat(F.size("committees").cast("string"), F.lit(" shared committee(s)"))),
    )
    shared = F.when(shared == "", "subject overlap").otherwise(shared)
    title = F.coalesce("title", F.lit(W.NO_TITLE))
    line = F.concat(F.lit("- "), F.col("bill_id"), F.lit(' "'), title, F.lit('": outcome '), outcome_label(F.col("outcome")), F.lit("; connected via "), shared, F.lit("."))
    place = F.struct((-F.col("score")).alias("s"), F.col("bill_id").alias("b"))
    one = related.agg(
        F.count("*").alias("n"),
        _lines(place, line).alias("lines"),
        enactment_rate(F.col("outcome")).alias("rate"),
        F.min_by(F.struct(F.col("bill_id").alias("id"), title.alias("title"), outcome_label(F.col("outcome")).alias("outcome")), place).alias("top"),
    )
    said = F.format_string(W.GRAPH_ANSWER, "n", "top.id", "top.title", F.lower("top.outcome"), _percent(F.col("rate")), verdict(F.col("rate")))
    answer = F.when(F.col("n") == 0, W.GRAPH_NOTHING).otherwise(said)
    return one.select(F.when(F.col("n") == 0, W.GRAPH_NO_CONTEXT).otherwise(F.col("lines")).alias("context"), "n", "rate", verdict(F.col("rate")).alias("verdict"), answer.alias("answer"))


def graph_prompt(context: DataFrame, question: str) -> DataFrame:
    """``prompt`` of a graph context."""
    rate = F.when(F.col("rate").isNull(), W.NO_BASE_RATE).otherwise(F.format_string(W.BASE_RATE, _percent(F.col("rate"))))
    return context.select(F.format_string(W.GRAPH_PROMPT, F.lit(question), "context", rate).alias("prompt"))


def related_payload(related: DataFrame, nodes: DataFrame) -> DataFrame:
    """Related bills as they are shown: ``id, title, outcome, outcome_label, score`` to two places, the names of the people and committees
    they share (``nodes`` has label, key, name; the key stands for a name that isn't known), in order of their keys, and the shared subjects."""
    out = related
    for column, label in (("legislators", "Legislator"), ("committees", "Committee")):
        names = nodes.where(F.col("label") == label).select(F.col("key").alias("_key"), "name")
        rows = related.select("bill_id", F.posexplode(column).alias("at", "_key")).join(names, "_key", "left")  # of the few rows shown
        named = F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "_key").alias("name"))))
        lists = rows.groupBy("bill_id").agg(F.transform(named, lambda x: x["name"]).alias(f"shared_{column}"))
        out = out.join(lists, "bill_id", "left").withColumn(f"shared_{column}", F.coalesce(f"shared_{column}", F.array().cast("array<string>")))
    return out.select(F.col("bill_id").alias("id"), "title", "outcome", outcome_label(F.col("outcome")).alias("outcome_label"), F.round("score", 2).alias("score"), "shared_legislators", "shared_committees", "subject_overlap")


def outcome_histogram(found: DataFrame, outcome: str, order: list[str]) -> DataFrame:
    """``outcome, n, first``: outcomes of retrieved passages (not of distinct bills), most frequent first, then as they appear."""
    rows = found.where(F.coalesce(outcome, F.lit("")) != "")
    place = F.struct((-F.col("similarity")).alias("s"), *order)
    return rows.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "first")


def vector_context(found: DataFrame, key: str, outcome: str, title: str | None = None) -> DataFrame:
    """``context, n, answer``: one row, also where nothing was found. The answer names how often each outcome was found, the most
    frequent first and then as they appear."""
    place = F.struct((-F.col("similarity")).alias("s"), F.col(key).alias("k"), F.col("chunk_index").alias("i"))
    near = F.format_string("%.2f", "similarity")
    line = F.concat(F.lit("- "), F.col(key).cast("string"), F.lit(" (similarity "), near, F.lit(", outcome "), outcome_label(F.col(outcome)), F.lit("): "), F.col("chunk"))
    named = F.coalesce(F.col(title).cast("string"), F.lit(W.NO_TITLE)) if title else F.lit(W.NO_TITLE)
    told = F.when(F.coalesce(F.col(outcome), F.lit("")) != "", F.struct(place.alias("place"), outcome_label(F.col(outcome)).alias("outcome")))
    one = found.agg(
        F.count("*").alias("n"),
        _lines(place, line).alias("lines"),
        F.transform(F.array_sort(F.collect_list(told)), lambda x: x["outcome"]).alias("told"),
        F.min_by(F.struct(F.col(key).cast("string").alias("id"), near.alias("near"), named.alias("title")), place).alias("top"),
    )
    counts = F.transform(F.array_distinct("told"), lambda o, i: F.struct((-F.size(F.filter("told", lambda x: x == o))).alias("n"), i.alias("i"), o.alias("o")))
    listed = F.array_join(F.transform(F.array_sort(counts), lambda x: F.concat(x["o"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
    said = F.format_string(W.VECTOR_ANSWER, "n", "top.near", "top.id", "top.title", F.when(F.size("told") > 0, listed).otherwise(W.NO_OUTCOMES))
    answer = F.when(F.col("n") == 0, W.VECTOR_NOTHING).otherwise(said)
    return one.select(F.when(F.col("n") == 0, W.VECTOR_NO_CONTEXT).otherwise(F.col("lines")).alias("context"), "n", answer.alias("answer"))


def vector_prompt(context: DataFrame, question: str) -> DataFrame:
    """``prompt`` of a vector context."""
    return context.select(F.format_string(W.VECTOR_PROMPT, F.lit(question), "context").alias("prompt"))


def compare(related: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Both results side by side: ``engine, item, place, score``."""
    from pyspark.sql import Window

    w = lambda *by: F.row_number().over(Window.partitionBy("engine").orderBy(*by))
    g = related.select(F.lit("graph").alias("engine"), F.col("bill_id").alias("item"), F.col("score").cast("double").alias("score"))
    g = g.withColumn("place", w(F.desc("score"), "item"))
    v = found.select(F.lit("vector").alias("engine"), F.col(key).cast("string").alias("item"), F.col("similarity").alias("score"), F.col(key).alias("k"), F.col("chunk_index").alias("i"))
    v = v.withColumn("place", w(F.desc("score"), "k", "i")).drop("k", "i")
    return g.unionByName(v)


class _Run:
    """Steps of an engine, each a table that is made once; tells the start and the end of each."""

    def __init__(self, engine: str):
        self.engine, self.tables, self.k = engine, {}, 0

    def step(self, name: str, make, keep: bool = True) -> Iterator[dict]:
        at = {"engine": self.engine, "step": name, "index": self.k}
        self.k += 1
        yield at | {"phase": "start"}
        began = time.time()
        made = make()
        if isinstance(made, DataFrame):
            seen = Observation()
            made = cut(made.observe(seen, F.count(F.lit(1)).alias("rows")))  # the step's one job counts its rows, too
            at = at | {"rows": seen.get["rows"]}
        self.tables[name] = made
        yield at | {"phase": "done", "duration_ms": (time.time() - began) * 1000}


def graph_engine(links: DataFrame, bills: DataFrame, question: str, p: GraphParams = GraphParams()) -> Iterator[dict]:
    """The graph engine step by step, as events; the last one holds the tables by step and the answer's row."""
    run = _Run("graph")
    t = run.tables
    yield from run.step("parse_query", lambda: question_words(bills.sparkSession, question))
    yield from run.step("seed_match", lambda: seed_match(bills, t["parse_query"], p.seed_limit).join(bills.select("bill_id", "title", "outcome"), "bill_id"))
    yield from run.step("expand_graph", lambda: expand(links, t["seed_match"]))
    yield from run.step("score_related", lambda: top_related(score_candidates(links, bills, t["seed_match"], t["parse_query"], p.hops, p.legislator_weight, p.committee_weight, p.subject_weight), p.top_k))
    yield from run.step("retrieve", lambda: subgraph(links, bills, t["seed_match"].select("bill_id", "ordinal", "overlap"), t["score_related"])[1])
    yield from run.step("build_context", lambda: graph_context(t["score_related"]))
    yield from run.step("answer", lambda: t["build_context"].select("n", "rate", "verdict", "answer"))
    yield {"engine": "graph", "phase": "result", "tables": t, "answer": t["answer"].first().asDict()}


def vector_engine(texts: DataFrame, key: str, text: str, question: str, p: VectorParams = VectorParams(), stored: DataFrame | StoredPassages | None = None, outcome: str = "outcome") -> Iterator[dict]:
    """The vector engine step by step, as events; ``texts`` has an outcome beside its text, and so have stored passages."""
    run = _Run("vector")
    t = run.tables
    top = VectorParams.from_dict(asdict(p) | {"similarity_threshold": -1.0})
    yield from run.step("embed_search", lambda: vector_retrieve(texts, key, text, question, top, stored))
    yield from run.step("retrieve", lambda: t["embed_search"].where(F.col("similarity") >= p.similarity_threshold))
    title = "title" if stored is not None or "title" in texts.columns else None
    yield from run.step("build_context", lambda: vector_context(t["retrieve"], key, outcome, title if title in t["retrieve"].columns else None))
    yield from run.step("answer", lambda: t["build_context"].select("n", "answer"))
    report = search_report(t["embed_search"], question, p, stored is not None)
    yield {"engine": "vector", "phase": "result", "tables": t | {"report": report}, "answer": t["answer"].first().asDict()}


def execute(events: Iterator[dict]) -> tuple[list[dict], dict]:
    """Run an engine to its end: its trace, and its result."""
    got = list(events)
    return got[:-1], got[-1]


def settings(graph: GraphParams = GraphParams(), vector: VectorParams = VectorParams()) -> dict:
    return {"graph": asdict(graph), "vector": asdict(vector)}
