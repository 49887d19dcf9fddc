"""Queries that go through stored indexes, with the SQL that gives the same rows; each builds its index in the shared folder and removes it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import records as R
from evidra.functions.vocabulary import STOP_WORDS
from evidra.operators import graph as G
from evidra.operators import ivf, linkfile, postings
from evidra.operators import merge as M
from evidra.operators.lineage import cut, remove, shared_dir
from evidra.plans import engines as N
from evidra.plans import index as I
from evidra.plans.catalog import _BL, _BODY, _BUCKETS, _LABEL, _QUALITY, _SIM, _TOP, AS_OF, ORACLE_SQL, QUESTION, TEXT_QUESTION, _documents, _outcomes, _related, _summarised, _told, query, table
from evidra.plans.evaluation import class_measures
from evidra.plans.params import VectorParams
from evidra.plans.questions import ask
from evidra.plans.tables import BILLS_SQL, bills, links, texts
from evidra.sources.listing import read_listing, write_listing
from evidra.sources.xml_files import scan_xml

_PERSON = "struct<bioguide_id:string,full_name:string,party:string,state:string>"
#: Of vectors whose id this divides, the nearest ones are asked for.
EVERY = 20


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nearest(spark, d, exact: bool) -> DataFrame:
    path = _folder(spark, "vectors")
    e = table(spark, d, "embeddings")
    stored = ivf.build(e, path, "vec_id", "embedding")
    probe = ivf.PROBE if exact else stored.probe_for(0.96)
    found = cut(stored.search(e.where(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", 10, probe, exact))
    remove(spark, path)
    return found.select("query", "id", "rank", F.round("similarity", 4).alias("similarity"))


@query()
def ann_topk(spark, d):
    """The ten nearest of all vectors to every twentieth, through as many cells as 0.96 of them need on a sample."""
    return _nearest(spark, d, exact=False)


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(coalesce(list_cosine_similarity(q.e, v.e), 0), 9) AS similarity FROM v q, v WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INTEGER AS rank FROM s)
SELECT query, id, rank, round(similarity, 4) AS similarity FROM r WHERE rank <= 10""")
def ann_exact(spark, d):
    """The same ones by the exact search, which reads every cell whose bound is high enough."""
    return _nearest(spark, d, exact=True)


@query(ORACLE_SQL["cosine_topk"])
def stored_topk(spark, d):
    """The rows of ``cosine_topk``, out of stored vectors."""
    path = _folder(spark, "postings")
    stored = postings.build(N.passages(texts(spark, d), "doc_id", "text", VectorParams(chunk_strategy="fixed")), path, "doc_id")
    asked = spark.createDataFrame([(0, TEXT_QUESTION)], "question bigint, text string")
    found = cut(stored.search(asked, 50))
    remove(spark, path)
    return found.select(F.col("key").alias("doc_id"), "chunk_index", "similarity", F.round(1 - F.col("similarity"), 4).alias("distance"))


# --- many questions ---------------------------------------------------------------------------------

_ASKED = f"""{_BL}, qs AS (SELECT doc_id AS question, title || ' ' || split_part(coalesce(text, ''), '.', 1) AS t, congress, outcome FROM documents JOIN bills ON ordinal = doc_id % (SELECT count(*) FROM part) WHERE doc_id % {EVERY} = 0),
w AS (SELECT question, list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z]{{3,}}')), lambda x: NOT list_contains({STOP_WORDS}, x)) AS words FROM qs),
bw AS (SELECT bill_id, ordinal, list_distinct(list_concat(subjects, list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: NOT list_contains({STOP_WORDS}, x)))) AS told FROM bills),
sd AS (SELECT question, bill_id FROM (SELECT question, bill_id, row_number() OVER (PARTITION BY question ORDER BY len(list_intersect(told, words)) DESC, ordinal) AS n FROM w, bw WHERE len(list_intersect(told, words)) > 0) WHERE n <= 3),
hubs AS (SELECT DISTINCT question, kind, entity FROM sd JOIN links USING (bill_id)),
near AS (SELECT question, bill_id, count(*) FILTER (WHERE kind = 'legislator') AS n_leg, count(*) FILTER (WHERE kind = 'committee') AS n_com FROM hubs JOIN links USING (kind, entity) ANTI JOIN sd USING (question, bill_id) GROUP BY question, bill_id),
sc AS (SELECT question, bill_id AS item, (2 * n_leg + n_com + 0.5 * len(list_intersect(subjects, words)))::DOUBLE AS score FROM near JOIN bills USING (bill_id) JOIN w USING (question)),
b AS (SELECT bill_id, {_BODY} AS c FROM bills), qn AS ({_BUCKETS.format(k='question', t='t', f='qs')}), bn AS ({_BUCKETS.format(k='bill_id', t='c', f="(SELECT * FROM b WHERE c <> '')")}),
qv AS (SELECT question, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY question)) AS w FROM qn), bv AS (SELECT bill_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY bill_id)) AS w FROM bn),
dots AS (SELECT question, bill_id, sum(qv.w * bv.w) AS s FROM qv JOIN bv USING (bucket) GROUP BY question, bill_id),
vs AS (SELECT question, bill_id AS item, round(coalesce(s, 0), 4) AS score FROM qs CROSS JOIN (SELECT bill_id FROM b WHERE c <> '') LEFT JOIN dots USING (question, bill_id)),
found AS (SELECT * FROM (SELECT 'graph' AS engine, question, item, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, item)::INTEGER AS rank FROM sc
UNION ALL SELECT 'vector', question, item, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, item)::INTEGER FROM vs) WHERE rank <= 6)"""


def _asked(spark, d):
    """A question for every twentieth document: a bill's title and the document's first sentence."""
    b = bills(spark, d)
    n = b.count()
    docs = texts(spark, d).where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("question"), (F.col("doc_id") % n).alias("ordinal"), F.substring_index(F.coalesce("text", F.lit("")), ".", 1).alias("said"))
    return docs.join(b.select("ordinal", "title", "congress", "outcome"), "ordinal").select("question", F.concat_ws(" ", "title", "said").alias("text"), "congress", "outcome")


def _answered(spark, d):
    path = _folder(spark, "postings")
    b = _summarised(bills(spark, d))
    told = b.select("bill_id", N.body(F.col("title"), F.col("summary")).alias("text"))
    stored = postings.build(N.passages(told, "bill_id", "text"), path, "bill_id")
    asked = cut(_asked(spark, d))
    found = cut(ask(asked.select("question", "text"), cut(links(spark, d)), b, stored))
    remove(spark, path)
    return asked, found


@query(_ASKED + " SELECT engine, question, item, round(score, 4) AS score, rank FROM found")
def many_questions(spark, d):
    """Both engines' results for all questions, in one plan."""
    return _answered(spark, d)[1].withColumn("score", F.round("score", 4))


@query(_ASKED + """, rel AS (SELECT question, bill_id AS item FROM qs JOIN bills USING (congress, outcome)), size AS (SELECT question, count(*) AS size FROM rel GROUP BY question),
hit AS (SELECT found.*, CASE WHEN rel.item IS NULL THEN 0 ELSE 1 END AS hit FROM found LEFT JOIN rel ON found.question = rel.question AND found.item = rel.item)
SELECT engine, question, round(coalesce(avg(hit), 0), 6) AS precision, round(coalesce(sum(hit), 0) / size, 6) AS recall, round(coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS reciprocal_rank
FROM (SELECT * FROM size, (VALUES ('graph'), ('vector')) AS e(engine)) LEFT JOIN hit USING (question, engine) GROUP BY engine, question, size""")
def question_measures(spark, d):
    """Measures of both engines for all questions; relevant are the bills of the asked bill's congress and outcome."""
    asked, found = _answered(spark, d)
    own, items = asked.select(F.col("question").alias("query"), "congress", "outcome"), bills(spark, d).select(F.col("bill_id").alias("item"), "congress", "outcome")
    table = class_measures(found.withColumnRenamed("question", "query"), own, items, ["congress", "outcome"])
    return table.select("engine", F.col("query").alias("question"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")))


# --- merges -----------------------------------------------------------------------------------------


def _batch(spark, d, k: int):
    """Two batches of nested bills that overlap: the second has other titles, none for some, and knows other things of people."""
    b = _summarised(bills(spark, d)).where("ordinal % 3 <> 0" if k == 0 else "ordinal % 4 = 0")
    if k:
        b = b.withColumn("title", F.when(F.col("ordinal") % 8 != 0, F.upper("title")))
    line = table(spark, d, "lineitem").where("l_partkey % 3 <> 0" if k == 0 else "l_partkey % 4 = 0")  # of the bills of the batch
    line = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    text = lambda x: F.lit(x).cast("string")
    nested = line.groupBy(F.col("l_partkey").alias("ordinal")).agg(F.collect_set("l_orderkey").alias("orders"), F.collect_set("o_custkey").alias("customers"))
    person = lambda order: F.struct(
        F.concat(F.lit("O"), order.cast("string")).alias("bioguide_id"),
        F.when(order % (2 + k) == 0, F.concat(F.lit(("Rep. ", "Sen. ")[k]), order.cast("string"))).alias("full_name"),
        F.when(order % 5 == k, "D").alias("party"),
        text("OH").alias("state"),
    )
    panel = lambda c: F.struct(F.concat(F.lit("C"), c.cast("string")).alias("name"), F.when(c % 2 == k, ("House", "Senate")[k]).alias("chamber"))
    told = b.join(nested, "ordinal", "left").withColumns({"cosponsors": F.transform("orders", person), "committees": F.transform("customers", panel)})
    return told.drop("orders", "customers").withColumn("sponsor", F.lit(None).cast(_PERSON))


_BATCHES = f"""WITH {BILLS_SQL}, s AS (SELECT *, CASE WHEN ordinal % 5 = 1 THEN '' WHEN ordinal % 5 > 1 THEN 'About ' || lower(title) END AS summary FROM bills),
b0 AS (SELECT bill_id, title, summary, outcome, ordinal FROM s WHERE ordinal % 3 <> 0), b1 AS (SELECT bill_id, CASE WHEN ordinal % 8 <> 0 THEN upper(title) END AS title, summary, outcome, ordinal FROM s WHERE ordinal % 4 = 0),
b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b0 WHERE bill_id NOT IN (SELECT bill_id FROM b1)),
l AS (SELECT l_orderkey AS o, o_custkey AS c, 'B' || l_partkey AS bill_id, l_partkey % 3 <> 0 AS first, l_partkey % 4 = 0 AS second FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_partkey % 3 <> 0 OR l_partkey % 4 = 0),
people AS (SELECT 'O' || o AS key, coalesce(CASE WHEN bool_or(second) AND o % 3 = 0 THEN 'Sen. ' || o END, CASE WHEN bool_or(first) AND o % 2 = 0 THEN 'Rep. ' || o END) AS name,
  CASE WHEN (bool_or(second) AND o % 5 = 1) OR (bool_or(first) AND o % 5 = 0) THEN 'D' END AS property, count(DISTINCT bill_id) AS n FROM l GROUP BY o),
panels AS (SELECT 'C' || c AS key, 'C' || c AS name, CASE WHEN bool_or(second) AND c % 2 = 1 THEN 'Senate' WHEN bool_or(first) AND c % 2 = 0 THEN 'House' END AS property, count(DISTINCT bill_id) AS n FROM l GROUP BY c)"""


@query(_BATCHES + """ SELECT 'Bill' AS label, bill_id AS key, title AS name, outcome AS property FROM b UNION ALL SELECT 'Legislator', key, name, property FROM people UNION ALL SELECT 'Committee', key, name, property FROM panels""")
def graph_upsert(spark, d):
    """A graph and another batch: bills replaced, what is known of others kept."""
    nodes, _ = M.upsert_graph(*G.decompose(_batch(spark, d, 0)), *G.decompose(_batch(spark, d, 1)))
    property_ = F.when(F.col("label") == "Bill", F.col("outcome")).when(F.col("label") == "Legislator", F.col("party")).otherwise(F.col("chamber"))
    return nodes.select("label", "key", "name", property_.alias("property"))


@query(_BATCHES + f""" SELECT 'bill' AS label, bill_id AS key, title AS name, outcome AS property, 1 AS n FROM b UNION ALL SELECT 'person', key, name, property, n FROM people UNION ALL SELECT 'committee', key, name, property, n FROM panels
UNION ALL SELECT 'passage', bill_id || '#0', concat_ws('. ', nullif(title, ''), nullif(summary, '')), NULL, 0 FROM b WHERE concat_ws('. ', nullif(title, ''), nullif(summary, '')) <> ''""")
def index_upsert(spark, d):
    """A stored index after two batches, the second of them delivered twice."""
    path = _folder(spark, "index")
    store = I.store_of(spark, path)
    for k in (0, 1, 1):
        I.upsert_index(store, _batch(spark, d, k), k)
    ends = lambda label: store.table("edges").where(F.col("src_label") == label).groupBy(F.col("src_key").alias("key"))
    n = {"people": ends("Legislator").agg(F.count_distinct("dst_key").alias("n")), "committees": ends("Committee").agg(F.count("*").alias("n"))}  # edges are a set, and those of committees of one kind
    node = lambda name, label, prop: store.table(name).join(n[name], "key").select(F.lit(label).alias("label"), "key", "name", F.col(prop).alias("property"), "n")
    rows = store.table("bills").select(F.lit("bill").alias("label"), F.col("bill_id").alias("key"), F.col("title").alias("name"), F.col("outcome").alias("property"), F.lit(1).cast("bigint").alias("n"))
    rows = rows.unionByName(node("people", "person", "party")).unionByName(node("committees", "committee", "chamber"))
    told = store.table("passages").select(F.lit("passage").alias("label"), F.concat_ws("#", "bill_id", "chunk_index").alias("key"), F.col("chunk").alias("name"), F.lit(None).cast("string").alias("property"), F.lit(0).cast("bigint").alias("n"))
    found = cut(rows.unionByName(told))
    remove(spark, path)
    return found


# --- files ------------------------------------------------------------------------------------------


@query(ORACLE_SQL["xml_parse"])
def xml_scan(spark, d):
    """The documents of ``xml_parse`` in files of many, scanned by row tag; files of broken ones beside them."""
    path = _folder(spark, "xml")
    docs = _documents(spark, d)
    fine = F.col("xml").endswith("</billStatus>")
    docs.where(fine).select("xml").write.text(f"{path}/bills")
    docs.where(~fine).select("xml").write.text(f"{path}/broken")
    found = cut(scan_xml(spark, f"{path}/*", AS_OF).withColumn("source", F.concat(F.lit("B"), "bill_number")))
    remove(spark, path)
    return _told(found)


@query(ORACLE_SQL["package_listing"])
def listing_pages(spark, d):
    """The listing of ``package_listing`` as pages, of which only those are read that can hold what is asked for."""
    path = _folder(spark, "listing")
    o = table(spark, d, "orders")
    name = F.concat(F.lit("PKG-"), (113 + F.col("o_orderkey") % 6).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    write_listing(o.select(name.alias("package_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified")), path)
    found = cut(read_listing(spark, path, "PKG-115", "1997-01-01").select("package_id", "last_modified"))
    remove(spark, path)
    return found.orderBy("package_id").limit(500)


# --- answers in full --------------------------------------------------------------------------------


@query(_TOP + f""", r AS (SELECT avg(CASE WHEN outcome = 'became_law' THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate, count(*) AS n FROM top), f AS (SELECT bill_id, title, lower({_LABEL}) AS label FROM top ORDER BY score DESC, bill_id LIMIT 1),
x AS (SELECT string_agg('- ' || bill_id || ' "' || title || '": outcome ' || {_LABEL} || '; connected via ' || CASE WHEN n_leg + n_com = 0 THEN 'subject overlap' ELSE concat_ws(', ', CASE WHEN n_leg > 0 THEN n_leg || ' shared sponsor(s)' END, CASE WHEN n_com > 0 THEN n_com || ' shared committee(s)' END) END || '.', chr(10) ORDER BY score DESC, bill_id) AS context FROM top),
p AS (SELECT round_even(rate * 100, 0)::INTEGER || '%' AS percent FROM r)
SELECT 'Question: {QUESTION}' || chr(10) || chr(10) || 'Bills found by shared sponsors and committees:' || chr(10) || context || chr(10) || chr(10) || 'Base rate: ' || percent || ' of these bills became law.' || chr(10) || chr(10) || 'Assess the question by these bills alone.' AS prompt,
n || ' bill(s) are connected to this topic through shared sponsors and committees. The closest is ' || bill_id || ' ("' || title || '"), which ' || label || '. Of the connected bills ' || percent || ' became law.' || chr(10) || 'Assessment: ' || CASE WHEN rate >= 0.5 THEN 'likely' ELSE 'unlikely' END || ' to pass, going by connected bills.' AS answer FROM r, f, x, p""")
def graph_answer_text(spark, d):
    """The graph engine's prompt and answer, whole."""
    c = cut(N.graph_context(_related(spark, d)))
    return N.graph_prompt(c, QUESTION).select("prompt", F.lit(c.first()["answer"]).alias("answer"))


@query(f"""{_SIM}, l AS (SELECT doc_id, max({_QUALITY}) AS outcome FROM labels GROUP BY doc_id), src AS (SELECT doc_id, max(source) AS title FROM documents GROUP BY doc_id),
f AS (SELECT found.*, outcome, title, CASE WHEN outcome IS NULL THEN 'Unknown' ELSE {_LABEL} END AS label, row_number() OVER (ORDER BY similarity DESC, doc_id, chunk_index) AS place FROM found LEFT JOIN l USING (doc_id) LEFT JOIN src USING (doc_id)),
h AS (SELECT label, count(*) AS n, min(place) AS first FROM f WHERE outcome IS NOT NULL GROUP BY label), o AS (SELECT coalesce(string_agg(label || ' (' || n || ')', ', ' ORDER BY n DESC, first), 'unknown') AS outcomes FROM h)
SELECT md5('Question: {TEXT_QUESTION}' || chr(10) || chr(10) || 'Most similar passages:' || chr(10) || (SELECT string_agg('- ' || doc_id || ' (similarity ' || format('{{:.2f}}', similarity + 1e-9) || ', outcome ' || label || '): ' || chunk, chr(10) ORDER BY place) FROM f) || chr(10) || chr(10) || 'Assess the question by these passages alone.') AS prompt_md5,
(SELECT count(*) FROM f) || ' passage(s) are most similar to this question. The closest (similarity ' || format('{{:.2f}}', similarity + 1e-9) || ') is from ' || doc_id || ' ("' || title || '"). Outcomes of the matched bills: ' || outcomes || '.' || chr(10) || 'Assessment: similar words alone; related by topic, no forecast.' AS answer FROM f, o WHERE place = 1""")
def vector_answer_text(spark, d):
    """The vector engine's prompt and answer, whole, with the histogram of outcomes; a document's source stands for its title."""
    source = table(spark, d, "documents").groupBy("doc_id").agg(F.max("source").alias("title"))
    found = _outcomes(spark, d).join(source, "doc_id", "left").withColumn("similarity", F.col("similarity") + 1e-9)
    c = cut(N.vector_context(found, "doc_id", "outcome", "title"))
    return N.vector_prompt(c, TEXT_QUESTION).select(F.md5("prompt").alias("prompt_md5"), F.lit(c.first()["answer"]).alias("answer"))


@query(f"""{_BL}, b AS (SELECT bill_id, title, outcome, {_BODY} AS c FROM bills), n AS ({_BUCKETS.format(k='bill_id', t='c', f="(SELECT * FROM b WHERE c <> '')")}), q0 AS ({_BUCKETS.format(k='one', t=f"'{QUESTION}'", f='(SELECT 1 AS one)')}),
q AS (SELECT bucket, w / sqrt(sum(w * w) OVER ()) AS w FROM q0), s AS (SELECT bill_id, round(sum(n.w * coalesce(q.w, 0)) / sqrt(sum(n.w * n.w)), 4) AS similarity FROM n LEFT JOIN q USING (bucket) GROUP BY bill_id)
SELECT bill_id, title, 0 AS chunk_index, c AS chunk, similarity, round(1 - similarity, 4) AS distance FROM s JOIN b USING (bill_id) ORDER BY similarity DESC, bill_id LIMIT 6""")
def index_search(spark, d):
    """A question answered out of a built index: posting lists, then the few passages found."""
    path = _folder(spark, "index")
    nested = _summarised(bills(spark, d)).withColumns({"sponsor": F.lit(None).cast(_PERSON), "cosponsors": F.array().cast(f"array<{_PERSON}>"), "committees": F.array().cast("array<struct<name:string,chamber:string>>")})
    I.build_index(nested, path)
    found = cut(N.vector_retrieve(nested, "bill_id", "title", QUESTION, VectorParams(), I.Index(spark, path).stored_passages()))
    remove(spark, path)
    return found.select("bill_id", "title", "chunk_index", "chunk", "similarity", "distance")


@query(ORACLE_SQL["related_topk"])
def related_stored(spark, d):
    """The rows of ``related_topk``, out of links that were laid out once: only those of the seeds and of their hubs are read."""
    path = _folder(spark, "links")
    stored = linkfile.build(links(spark, d), path)
    b = bills(spark, d)
    words = N.question_words(spark, QUESTION)
    found = cut(stored.related(b, G.seed_match(b, words), words))
    remove(spark, path)
    n = lambda c: F.size(c).cast("bigint")
    return found.select("bill_id", "title", R.outcome_label(F.col("outcome")).alias("outcome_label"), n("legislators").alias("n_leg"), n("committees").alias("n_com"), F.round("score", 2).alias("score"))


@query(_TOP + f""", sh AS (SELECT links.* FROM links SEMI JOIN top USING (bill_id) SEMI JOIN h1 USING (kind, entity)),
nm AS (SELECT bill_id, string_agg(CASE WHEN kind = 'legislator' THEN CASE WHEN entity[2:]::BIGINT % 2 = 0 THEN 'Rep. ' || entity[2:] ELSE entity END END, '|' ORDER BY entity) AS shared_legislators, string_agg(CASE WHEN kind = 'committee' THEN coalesce(c_name, entity) END, '|' ORDER BY entity) AS shared_committees
  FROM sh LEFT JOIN customer ON kind = 'committee' AND entity = 'C' || c_custkey GROUP BY bill_id)
SELECT bill_id AS id, title, outcome, {_LABEL} AS outcome_label, round(score, 2) AS score, coalesce(shared_legislators, '') AS shared_legislators, coalesce(shared_committees, '') AS shared_committees, n_sub AS n_subjects FROM top LEFT JOIN nm USING (bill_id)""")
def related_named(spark, d):
    """Related bills with the names of the people and committees they share; half of the people have none."""
    order = table(spark, d, "orders").select(F.lit("Legislator").alias("label"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Rep. "), F.col("o_orderkey").cast("string"))).alias("name"))
    customer = table(spark, d, "customer").select(F.lit("Committee").alias("label"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"))
    p = N.related_payload(cut(_related(spark, d)), order.unionByName(customer))
    return p.select("id", "title", "outcome", "outcome_label", "score", *(F.array_join(c, "|").alias(c) for c in ("shared_legislators", "shared_committees")), F.size("subject_overlap").cast("bigint").alias("n_subjects"))
