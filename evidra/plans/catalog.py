"""Queries over the given tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import records as R
from evidra.functions import text as X
from evidra.functions import vectors as V
from evidra.functions.table_functions import register as register_chunks
from evidra.functions.vocabulary import BILL_TYPES, OUTCOMES, POLICY_AREAS, STOP_WORDS
from evidra.operators import graph as G
from evidra.operators import merge as M
from evidra.operators import metrics as E
from evidra.operators.lineage import cut, shared_dir
from evidra.plans import engines as N
from evidra.plans import index as I
from evidra.plans.params import VectorParams
from evidra.plans.tables import BILLS_SQL, LINKS_SQL, bills, links, table, texts
from evidra.sources import records as S
from evidra.streaming import trace as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUESTION = "What about the small ring?"
TEXT_QUESTION = "the of in und der on data"
AS_OF = "2025-06-30"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


_BL = f"WITH {BILLS_SQL}, {LINKS_SQL}"
_LABEL = "CASE " + " ".join(f"WHEN outcome = '{k}' THEN '{v}'" for k, v in OUTCOMES.items()) + " WHEN coalesce(outcome, '') = '' THEN 'Unknown' ELSE outcome END"

# --- the graph ------------------------------------------------------------------------------------


@query(f"WITH {LINKS_SQL} SELECT kind, entity, bill_id FROM links")
def graph_edges(spark, d):
    return links(spark, d)


@query(f"WITH {LINKS_SQL} SELECT kind, entity, count(*) AS n_bills FROM links GROUP BY kind, entity")
def graph_nodes(spark, d):
    return links(spark, d).groupBy("kind", "entity").agg(F.count("*").alias("n_bills"))


@query(f"""WITH {LINKS_SQL} SELECT 'Legislator' AS label, 'O' || l_orderkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'Committee', entity, count(*) FROM links WHERE kind = 'committee' GROUP BY entity UNION ALL SELECT 'Bill', 'B' || p_partkey, 0 FROM part""")
def decompose_bills(spark, d):
    """Nested bills taken apart."""
    nodes, edges = G.decompose(_nested(spark, d))
    n = edges.groupBy("src_label", "src_key").agg(F.count_distinct("dst_key").alias("n"))
    n = nodes.join(n, (nodes["label"] == n["src_label"]) & (nodes["key"] == n["src_key"]), "left")
    return n.select("label", "key", F.coalesce("n", F.lit(0)).alias("n"))


def _nested(spark, d):
    """Nested bills: orders as sponsors or cosponsors, customers as committees."""
    b = bills(spark, d)
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("B"), F.col("l_partkey").cast("string")).alias("bill_id"))
    line = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    person = F.struct(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("bioguide_id"), F.lit(None).cast("string").alias("full_name"))
    panel = F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"))
    nested = line.groupBy("bill_id").agg(
        F.min(F.when(F.col("l_linenumber") == 1, person)).alias("sponsor"), F.collect_set(person).alias("cosponsors"), F.collect_set(F.when(F.col("o_custkey").isNotNull(), panel)).alias("committees")
    )
    return _summarised(b).join(nested, "bill_id", "left")


def _summarised(b):
    k = F.col("ordinal") % 5
    return b.withColumn("summary", F.when(k == 1, "").when(k > 1, F.concat(F.lit("About "), F.lower("title"))))


_BODY = "concat_ws('. ', nullif(title, ''), CASE WHEN ordinal % 5 > 1 THEN 'About ' || lower(title) END)"


@query("""WITH x AS (SELECT 'sponsored' AS kind, 'O' || l_orderkey AS a, 'B' || l_partkey AS b FROM lineitem WHERE l_linenumber = 1),
s AS (SELECT min(l_orderkey::VARCHAR) AS o, l_partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey)
SELECT 'SPONSORED' AS rel_type, 'O' || o AS src_key, 'B' || l_partkey AS dst_key FROM s
UNION ALL SELECT DISTINCT 'COSPONSORED', 'O' || l_orderkey, 'B' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'REVIEWED', 'C' || o_custkey, 'B' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def decompose_edges(spark, d):
    """The edges of nested bills themselves; the sponsor is the first of its orders as strings."""
    return G.decompose(_nested(spark, d))[1].select("rel_type", "src_key", "dst_key")


_SEED = f"""{_BL}, k AS (SELECT ['small', 'ring'] AS w),
seeds AS (SELECT bill_id, ordinal, len(list_intersect(list_distinct(list_concat(subjects, list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: NOT list_contains({STOP_WORDS}, x)))), w)) AS overlap
  FROM bills, k WHERE overlap > 0 ORDER BY overlap DESC, ordinal LIMIT 3)"""


@query(f"{_SEED} SELECT bill_id, ordinal, overlap::INTEGER AS overlap FROM seeds")
def seed_match(spark, d):
    return G.seed_match(bills(spark, d), N.question_words(spark, QUESTION))


def _seeds(spark, d):
    return G.seed_match(bills(spark, d), N.question_words(spark, QUESTION))


@query(f"{_SEED} SELECT DISTINCT kind, entity FROM links SEMI JOIN seeds USING (bill_id)")
def expand_hubs(spark, d):
    return G.expand(links(spark, d), _seeds(spark, d))


def _layers(hops: int) -> str:
    out = [_SEED, "l0 AS (SELECT bill_id FROM seeds)"]
    for h in range(1, hops + 1):
        gone = " UNION ".join(f"SELECT bill_id FROM l{i}" for i in range(h))
        out.append(f"h{h} AS (SELECT DISTINCT kind, entity FROM links SEMI JOIN l{h - 1} USING (bill_id))")
        out.append(
            f"l{h} AS (SELECT bill_id, {h} AS hop, count(*) FILTER (WHERE kind = 'legislator') AS n_leg, count(*) FILTER (WHERE kind = 'committee') AS n_com "
            f"FROM links SEMI JOIN h{h} USING (kind, entity) WHERE bill_id NOT IN ({gone}) GROUP BY bill_id)"
        )
    layers = " UNION ALL ".join(f"SELECT * FROM l{h}" for h in range(1, hops + 1))
    out.append(
        f"near AS ({layers}), scored AS (SELECT bill_id, ordinal, title, outcome, hop, n_leg, n_com, len(list_intersect(subjects, w)) AS n_sub, "
        "(pow(0.5, hop - 1) * (2 * n_leg + n_com) + 0.5 * len(list_intersect(subjects, w)))::DOUBLE AS score FROM near JOIN bills USING (bill_id), k)"
    )
    return ", ".join(out)


def _scored(spark, d, hops, linked=None):
    linked = cut(links(spark, d)) if linked is None else linked  # each hop uses them twice
    return G.score_candidates(linked, bills(spark, d), cut(_seeds(spark, d)), N.question_words(spark, QUESTION), hops)


def _flat(scored):
    n = lambda c: F.size(c).cast("bigint")
    return scored.select("bill_id", "hop", n("legislators").alias("n_leg"), n("committees").alias("n_com"), n("subject_overlap").alias("n_sub"), F.round("score", 6).alias("score"))


_FLAT_SQL = " SELECT bill_id, hop, n_leg, n_com, n_sub, round(score, 6) AS score FROM scored"


@query(_layers(1) + _FLAT_SQL)
def score_hop1(spark, d):
    return _flat(_scored(spark, d, 1))


@query(_layers(2) + _FLAT_SQL)
def score_hops2(spark, d):
    return _flat(_scored(spark, d, 2))


@query(_layers(3) + _FLAT_SQL)
def score_hops3(spark, d):
    return _flat(_scored(spark, d, 3))


_TOP = _layers(1) + ", top AS (SELECT * FROM scored ORDER BY score DESC, bill_id LIMIT 6)"


def _related(spark, d, linked=None):
    return G.top_related(_scored(spark, d, 1, linked))


def _subgraph(spark, d):
    linked = cut(links(spark, d))
    return G.subgraph(linked, bills(spark, d), cut(_seeds(spark, d)), cut(_related(spark, d, linked)))


@query(_TOP + f" SELECT bill_id, title, {_LABEL} AS outcome_label, n_leg, n_com, round(score, 2) AS score FROM top")
def related_topk(spark, d):
    n = lambda c: F.size(c).cast("bigint")
    return _related(spark, d).select("bill_id", "title", R.outcome_label(F.col("outcome")).alias("outcome_label"), n("legislators").alias("n_leg"), n("committees").alias("n_com"), F.round("score", 2).alias("score"))


@query(_TOP + ", r AS (SELECT avg(CASE WHEN outcome = 'became_law' THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate FROM top) SELECT round(rate, 6) AS rate, CASE WHEN coalesce(rate, 0) >= 0.5 THEN 'likely' ELSE 'unlikely' END AS verdict FROM r")
def enactment_rate(spark, d):
    one = _related(spark, d).agg(R.enactment_rate(F.col("outcome")).alias("rate"))
    return one.select(F.round("rate", 6).alias("rate"), R.verdict(F.col("rate")).alias("verdict"))


_SHARED = _TOP + """, hubs AS (SELECT DISTINCT kind, entity FROM links SEMI JOIN top USING (bill_id) SEMI JOIN h1 USING (kind, entity)),
around AS (SELECT kind, entity, bill_id FROM links SEMI JOIN hubs USING (kind, entity) WHERE bill_id IN (SELECT bill_id FROM top) OR bill_id IN (SELECT bill_id FROM seeds))"""
_NODE = "CASE WHEN kind = 'legislator' THEN 'leg:' ELSE 'com:' END || entity"


@query(_SHARED + f" SELECT bill_id AS id, 'seed_bill' AS kind FROM seeds UNION ALL SELECT bill_id, 'related_bill' FROM top UNION ALL SELECT {_NODE}, kind FROM hubs")
def subgraph_nodes(spark, d):
    return _subgraph(spark, d)[0].select("id", "kind")


@query(_SHARED + f" SELECT DISTINCT {_NODE} AS source, bill_id AS target, CASE WHEN kind = 'legislator' THEN 'sponsored' ELSE 'reviewed' END AS rel FROM around")
def subgraph_edges(spark, d):
    return _subgraph(spark, d)[1]


@query(_SHARED + " SELECT entity, coalesce(c_name, entity) AS name FROM hubs LEFT JOIN customer ON entity = 'C' || c_custkey WHERE kind = 'committee'")
def entity_names(spark, d):
    """Names of the committees that link the related bills; the id where there is none."""
    hubs = _related(spark, d).select(F.explode("committees").alias("entity")).distinct()
    names = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity"), "c_name")
    return hubs.join(names, "entity", "left").select("entity", F.coalesce("c_name", "entity").alias("name"))


def _pairs(scope: str = "bills", cap: int = 40) -> str:
    return f""", inside AS (SELECT links.* FROM links SEMI JOIN {scope} USING (bill_id)),
hub AS (SELECT kind, entity FROM inside GROUP BY kind, entity HAVING count(*) BETWEEN 2 AND {cap}),
p AS (SELECT a.bill_id AS a, b.bill_id AS b, count(*) FILTER (WHERE a.kind = 'legislator') AS sponsors, count(*) FILTER (WHERE a.kind = 'committee') AS committees
  FROM inside a JOIN hub ON a.kind = hub.kind AND a.entity = hub.entity JOIN inside b ON a.kind = b.kind AND a.entity = b.entity AND a.bill_id < b.bill_id GROUP BY 1, 2)"""


@query(_BL + _pairs() + " SELECT a, b, sponsors, committees FROM p")
def bill_pairs(spark, d):
    return G.bill_pairs(links(spark, d, "bill_id"), bills(spark, d))


def _projection(least: int, scope: str = "bills") -> str:
    return _pairs(scope) + f""", e AS (SELECT a, b, sponsors + committees AS weight, CASE WHEN sponsors > 0 AND committees > 0 THEN 'both' WHEN sponsors > 0 THEN 'sponsor' ELSE 'committee' END AS rel FROM p WHERE sponsors + committees >= {least}),
deg AS (SELECT bill_id, sum(weight)::BIGINT AS degree FROM (SELECT a AS bill_id, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY bill_id),
n AS (SELECT bill_id, title, congress, outcome, bill_type, bill_number, subjects, coalesce(degree, 0) AS degree FROM {scope} LEFT JOIN deg USING (bill_id) ORDER BY degree DESC, bill_id LIMIT 120)"""


_SHORT, _LONG = ([v[i] for v in BILL_TYPES.values()] for i in (0, 1))
_TYPE = f"list_position({list(BILL_TYPES)}, bill_type)"
_ORDINAL = "congress || CASE WHEN congress::INTEGER % 100 BETWEEN 10 AND 20 THEN 'th' ELSE (['th', 'st', 'nd', 'rd', 'th', 'th', 'th', 'th', 'th', 'th'])[1 + congress::INTEGER % 10] END"
_CITATION = f"({_SHORT})[{_TYPE}] || ' ' || bill_number || ' (' || {_ORDINAL} || ')'"
_N_SQL = f" SELECT bill_id, {_CITATION} AS label, ({_LONG})[{_TYPE}] AS type_name, title, congress, outcome, {_LABEL} AS outcome_label, array_to_string(subjects, ',') AS subjects, degree, (SELECT count(*) FROM bills) AS total_bills FROM n"
_E_SQL = " SELECT a, b, weight, rel FROM e WHERE a IN (SELECT bill_id FROM n) AND b IN (SELECT bill_id FROM n)"
_SCOPE = ", scope AS (SELECT * FROM bills WHERE congress = '114' AND list_contains(subjects, 'promo'))"


@query(_BL + _projection(1) + _N_SQL)
def bill_graph_nodes(spark, d):
    return G.bill_graph(links(spark, d, "bill_id"), bills(spark, d))[0].withColumn("subjects", F.array_join("subjects", ","))


@query(_BL + _projection(1) + _E_SQL)
def bill_graph_edges(spark, d):
    return G.bill_graph(links(spark, d, "bill_id"), bills(spark, d))[1]


@query(_BL + _projection(3) + _E_SQL)
def bill_graph_min_shared(spark, d):
    return G.bill_graph(links(spark, d, "bill_id"), bills(spark, d), min_shared=3)[1]


@query(_BL + _SCOPE + _projection(1, "scope") + _E_SQL)
def bill_graph_filtered(spark, d):
    return G.bill_graph(links(spark, d, "bill_id"), bills(spark, d), subject="Promo", congress=114)[1]


@query(_BL + _pairs() + """, x AS (SELECT a AS node, b AS neighbour FROM p UNION ALL SELECT b, a FROM p)
SELECT node, count(*) AS n_neighbours, string_agg(neighbour, ',' ORDER BY neighbour) AS neighbours FROM x GROUP BY node""")
def adjacency(spark, d):
    """Each bill's set of neighbours, whole."""
    near = G.neighbours(G.hub_lists(links(spark, d, "bill_id"), bills(spark, d)))
    return near.select("node", F.size("neighbours").cast("bigint").alias("n_neighbours"), F.array_join("neighbours", ",").alias("neighbours"))


@query(_BL + _pairs() + """, e AS (SELECT a, b, sponsors + committees AS weight FROM p), x AS (SELECT b AS neighbour, weight FROM e WHERE a = 'B1' UNION ALL SELECT a, weight FROM e WHERE b = 'B1')
SELECT 'B1' AS node, neighbour, weight, row_number() OVER (ORDER BY weight DESC, neighbour)::INTEGER AS place FROM x""")
def ego_network(spark, d):
    near = G.around(links(spark, d), "B1")
    e = G.bill_pairs(near, bills(spark, d)).select("a", "b", (F.col("sponsors") + F.col("committees")).alias("weight"))
    return G.ego(e, "B1")


@query(f"WITH {BILLS_SQL} SELECT DISTINCT 'subject' AS field, s AS value, s AS label FROM bills, unnest(subjects) AS t(s) UNION ALL SELECT DISTINCT 'congress', congress, (1788 + 2 * congress::INTEGER)::VARCHAR || '-' || (1789 + 2 * congress::INTEGER)::VARCHAR FROM bills WHERE ordinal % 9 > 0")
def graph_metadata(spark, d):
    """Bills without a congress, or with one that is no number, count for their subjects only."""
    b = bills(spark, d)
    return G.metadata(b.withColumn("congress", F.when(F.col("ordinal") % 9 > 0, F.col("congress")).when(F.col("ordinal") % 18 > 0, "?")))


# --- records ----------------------------------------------------------------------------------------


@query(f"WITH {BILLS_SQL} SELECT bill_id, title, {_LABEL} AS outcome_label, array_to_string(subjects, ',') AS subjects, array_to_string(subjects[1:2], ',') AS shown FROM bills")
def bill_listing(spark, d):
    return bills(spark, d).select("bill_id", "title", R.outcome_label(F.col("outcome")).alias("outcome_label"), F.array_join("subjects", ",").alias("subjects"), F.array_join(F.slice("subjects", 1, 2), ",").alias("shown"))


@query(f"""WITH {BILLS_SQL}, c AS (SELECT * REPLACE ((ordinal % 125)::VARCHAR AS congress) FROM bills) SELECT bill_id, {_CITATION} AS citation, ({_LONG})[{_TYPE}] AS type_name FROM c""")
def citation_label(spark, d):
    b = bills(spark, d).withColumn("congress", (F.col("ordinal") % 125).cast("string"))
    return G.labelled(b).select("bill_id", "citation", R.type_name(F.col("bill_type")).alias("type_name"))


@query(f"WITH {BILLS_SQL} SELECT bill_id, title, outcome FROM bills WHERE bill_id = 'B7'")
def bill_lookup(spark, d):
    return N.lookup(bills(spark, d), "bill_id", "B7").select("bill_id", "title", "outcome")


@query(f"WITH {BILLS_SQL} SELECT bill_id, {_BODY} AS body FROM bills")
def bill_body(spark, d):
    return _summarised(bills(spark, d)).select("bill_id", N.body(F.col("title"), F.col("summary")).alias("body"))


@query(f"""WITH {BILLS_SQL}, t AS (SELECT {_BODY} AS c FROM bills WHERE bill_id = 'B8'), x AS (SELECT i, trim(substr(c, i + 1, 12)) AS chunk FROM t, unnest(range(0, len(c), 9)) AS u(i)),
y AS (SELECT chunk, row_number() OVER (ORDER BY i) - 1 AS k FROM x WHERE chunk <> '') SELECT 'B8#' || k AS chunk_id, k::INTEGER AS chunk_index, chunk FROM y""")
def rechunk_bill(spark, d):
    return N.rechunk(_summarised(bills(spark, d)), "B8", 12, 3, "fixed").select("chunk_id", "chunk_index", "chunk")


@query(f"WITH {BILLS_SQL} SELECT congress || '-' || upper(bill_type) || '-' || bill_number AS key, bill_id FROM bills")
def bill_keys(spark, d):
    return bills(spark, d).select(R.bill_id(F.col("congress"), F.col("bill_type"), F.col("bill_number")).alias("key"), "bill_id")


@query("""SELECT p_partkey, make_date(1789 + (p_size - 1) * 2 + 2, 1, 3) AS ends, DATE '2025-06-30' > make_date(1789 + (p_size - 1) * 2 + 2, 1, 3) AS ended,
(1788 + 2 * p_size)::VARCHAR || '-' || (1789 + 2 * p_size)::VARCHAR AS span, 1789 + (p_size - 1) * 2 AS first_year FROM part""")
def congress_dates(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", R.congress_end(n).alias("ends"), R.has_ended(n, F.lit(AS_OF).cast("date")).alias("ended"), R.congress_span(n).alias("span"), R.first_year(n).alias("first_year"))


@query("""WITH a AS (SELECT o_orderkey, 113 + o_orderkey % 6 AS congress, concat_ws(' ', CASE WHEN o_orderkey % 3 = 0 THEN 'Passed House by voice vote' END, CASE WHEN o_orderkey % 5 = 0 THEN 'PASSED SENATE' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Became Public Law' END, CASE WHEN o_orderkey % 11 = 0 THEN 'Vetoed by President' END) AS t FROM orders),
x AS (SELECT o_orderkey, lower(t) AS t, DATE '2025-06-30' > make_date(1789 + (congress - 1) * 2 + 2, 1, 3) AS ended FROM a)
SELECT o_orderkey, CASE WHEN contains(t, 'became public law') THEN 'became_law' WHEN contains(t, 'vetoed') THEN 'vetoed'
WHEN contains(t, 'passed senate') AND contains(t, 'passed house') THEN CASE WHEN ended THEN 'died_after_passing_both_chambers' ELSE 'passed_both_chambers_pending' END
WHEN contains(t, 'passed senate') OR contains(t, 'passed house') THEN CASE WHEN ended THEN 'died_after_passing_one_chamber' ELSE 'passed_one_chamber_pending' END
WHEN ended THEN 'died_in_committee' ELSE 'pending_in_committee' END AS outcome FROM x""")
def outcome_derive(spark, d):
    k = F.col("o_orderkey")
    said = F.concat_ws(" ", *(F.when(k % m == 0, t) for m, t in ((3, "Passed House by voice vote"), (5, "PASSED SENATE"), (7, "Became Public Law"), (11, "Vetoed by President"))))
    return table(spark, d, "orders").select(k, R.outcome_of(said, R.has_ended(113 + k % 6, F.lit(AS_OF).cast("date"))).alias("outcome"))


_TAGGED = "['tax credit', 'medicare data tax', 'farm school loan', '']"
_AREAS = ", ".join(f"('{a}', {i}, {t})" for i, (a, t) in enumerate(POLICY_AREAS.items()))


@query(f"""WITH w AS (SELECT doc_id, lower(source) AS source, list_distinct(regexp_extract_all(lower(coalesce(text, '') || ' ' || ({_TAGGED})[1 + doc_id % 4]), '[a-z]+')) AS words FROM documents),
h AS (SELECT doc_id, area, place, len(list_intersect(words, terms)) AS n FROM w, (VALUES {_AREAS}) AS v(area, place, terms)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS k FROM h WHERE n > 0),
g AS (SELECT doc_id, string_agg(area, ',' ORDER BY k) AS areas FROM r WHERE k <= 4 GROUP BY doc_id)
SELECT doc_id, concat_ws(',', source, areas) AS subjects FROM w LEFT JOIN g USING (doc_id)""")
def subject_extract(spark, d):
    tagged = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.get(F.lit(["tax credit", "medicare data tax", "farm school loan", ""]), (F.col("doc_id") % 4).cast("int")))
    return texts(spark, d).select("doc_id", F.array_join(R.subjects(tagged, F.array("source")), ",").alias("subjects"))


@query(f"""WITH {BILLS_SQL}, new AS (SELECT bill_id, congress, upper(title) AS title FROM bills WHERE congress IN ('113', '114')), old AS (SELECT bill_id, congress, title FROM bills WHERE congress <> '113')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE bill_id NOT IN (SELECT bill_id FROM new)""")
def upsert_merge(spark, d):
    b = bills(spark, d).select("bill_id", "congress", "title")
    return M.append_merge(b.where("congress <> '113'"), b.where("congress in ('113', '114')").withColumn("title", F.upper("title")), ["bill_id"])


@query("""SELECT user_id, arg_max(value, event_id) FILTER (WHERE value > 20) AS value, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS event_type FROM events GROUP BY user_id""")
def merge_known(spark, d):
    """Node merge: the last known value of each property."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 20, F.col("value")).alias("value"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    return M.latest_known(e, ["user_id"], "event_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def keep_latest(spark, d):
    return M.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT 'PKG-' || (113 + o_orderkey % 6)::VARCHAR || '-' || o_orderkey AS package_id, strftime(o_orderdate, '%Y-%m-%d') AS last_modified FROM orders WHERE (113 + o_orderkey % 6) = 115 AND strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01' ORDER BY package_id LIMIT 500")
def package_listing(spark, d):
    """Prefix and date bound on a listing, with an early limit."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("PKG-"), (113 + F.col("o_orderkey") % 6).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    return S.list_packages(o.select(name.alias("package_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified")), "PKG-115", "1997-01-01", 500)


@query(f"""WITH {BILLS_SQL} SELECT bill_id AS source, congress, upper(bill_type) AS bill_type, bill_number, title, '2023-03-15' AS introduced_date, 'S' || ordinal || '|Rep. ' || ordinal || '|D|OH' AS sponsor,
CASE WHEN ordinal % 2 = 0 THEN 'Sx|Rep. x|D|OH,Sy|Rep. y|D|OH' ELSE '' END AS cosponsors, 'Panel ' || ordinal || '|House,Other|Senate' AS committees, concat_ws(',', subjects[1], 'extra') AS subjects, 'On ' || title || ' & more' AS summary,
'2024-01-01|' || CASE WHEN ordinal % 3 = 0 THEN 'Became Public Law No: 1' ELSE 'Referred' END || '|Floor,2024-01-02|Noted|' AS actions, '2024-01-10|' || CASE WHEN ordinal % 3 = 0 THEN 'Became Public Law No: 1' ELSE 'Referred' END AS latest_action,
CASE WHEN ordinal % 3 = 0 THEN 'became_law' WHEN congress::INTEGER < 119 THEN 'died_in_committee' ELSE 'pending_in_committee' END AS outcome FROM bills WHERE ordinal % 10 <> 9""")
def xml_parse(spark, d):
    """Bills written as XML in the later or the earlier layout, every tenth one broken, and parsed again."""
    return _told(S.parse_xml(_documents(spark, d), "xml", AS_OF))


def _documents(spark, d):
    """``source, xml``: every bill as a document."""
    b, even = bills(spark, d), F.col("ordinal") % 2 == 0
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    item = lambda *inner: tag("item", *inner)
    person = lambda n: item(tag("bioguideId", F.lit("S"), n), tag("fullName", F.lit("Rep. "), n), tag("party", F.lit("D")), tag("state", F.lit("OH")))
    k, area, extra = F.col("bill_number"), tag("name", F.coalesce(F.get("subjects", F.lit(0)), F.lit(""))), item(tag("name", F.lit("extra")))
    prose = F.concat(F.lit("&lt;p&gt;On &lt;b&gt;"), F.col("title"), F.lit("&lt;/b&gt; &amp;amp; more&lt;/p&gt;"))
    law = F.when(F.col("ordinal") % 3 == 0, "Became Public Law No: 1").otherwise("Referred")
    kind = F.upper("bill_type")
    panels = F.concat(item(tag("name", F.lit("Panel "), k), tag("chamber", F.lit("House"))), item(tag("name", F.lit("Other")), tag("chamber", F.lit("Senate"))))
    later = F.concat(
        tag("type", kind), tag("number", k), tag("cosponsors", person(F.lit("x")), person(F.lit("y"))), tag("policyArea", area), tag("subjects", tag("legislativeSubjects", extra)), tag("summaries", tag("summary", tag("text", prose))), tag("committees", panels)
    )
    earlier = F.concat(
        tag("billType", kind), tag("billNumber", k), tag("subjects", tag("billSubjects", tag("policyArea", area), tag("legislativeSubjects", extra))), tag("summaries", tag("billSummaries", item(tag("text", prose)))), tag("committees", tag("billCommittees", panels))
    )
    acts = F.concat(item(tag("actionDate", F.lit("2024-01-01")), tag("text", law), tag("type", F.lit("Floor"))), item(tag("actionDate", F.lit("2024-01-02")), tag("text", F.lit("Noted"))))
    common = F.concat(
        tag("congress", F.col("congress")), tag("title", F.col("title")), tag("introducedDate", F.lit("2023-03-15")), tag("sponsors", person(k)), tag("actions", acts), tag("latestAction", tag("actionDate", F.lit("2024-01-10")), tag("text", law))
    )
    xml = F.concat(F.lit("<billStatus><bill>"), common, F.when(even, later).otherwise(earlier), F.when(F.col("ordinal") % 10 == 9, "<").otherwise("</bill></billStatus>"))
    return b.select(F.col("bill_id").alias("source"), xml.alias("xml"))


def _told(p):
    """Parsed bills, flat."""
    told = lambda x, *names: F.concat_ws("|", *(F.coalesce(x[n], F.lit("")) for n in names))
    each = lambda c, *names: F.array_join(F.transform(c, lambda x: told(x, *names)), ",")
    who = ("bioguide_id", "full_name", "party", "state")
    return p.select(
        "source", "congress", "bill_type", "bill_number", "title", "introduced_date", told(F.col("sponsor"), *who).alias("sponsor"), each("cosponsors", *who).alias("cosponsors"), each("committees", "name", "chamber").alias("committees"),
        F.array_join("subjects", ",").alias("subjects"), "summary", each("actions", "date", "text", "type").alias("actions"), told(F.col("latest_action"), "date", "text").alias("latest_action"), "outcome",
    )


# --- texts and passages -----------------------------------------------------------------------------


@query(f"SELECT doc_id, len(k) AS n, md5(array_to_string(list_sort(k), ' ')) AS digest FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')), lambda x: NOT list_contains({STOP_WORDS}, x)) AS k FROM documents)")
def keywords(spark, d):
    k = texts(spark, d).select("doc_id", X.keywords(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("k"), " ")).alias("digest"))


@query("SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS k FROM documents)")
def tokens(spark, d):
    k = texts(spark, d).select("doc_id", X.tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


def _chunks(spark, d, strategy):
    p = N.passages(texts(spark, d), "doc_id", "text", VectorParams(chunk_strategy=strategy))
    return p.select("doc_id", "chunk_id", "chunk_index", "chunk")


def _numbered(source: str) -> str:
    """Chunks ``doc_id, i, chunk`` that aren't blank, with their place."""
    return f"SELECT doc_id, doc_id || '#' || (k - 1) AS chunk_id, (k - 1)::INTEGER AS chunk_index, chunk FROM (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ({source}) WHERE regexp_matches(chunk, '\\S'))"


_T = f"WITH t AS (SELECT doc_id, {_strip('text')} AS c FROM documents WHERE text IS NOT NULL)"
_window = lambda step: _numbered(f"SELECT doc_id, i, {_strip('substr(c, i + 1, 220)')} AS chunk FROM t, unnest(range(0, len(c), {step})) AS u(i)")
_FIXED = _window(180)


@query(f"{_T} SELECT doc_id, doc_id || '#0' AS chunk_id, 0 AS chunk_index, c AS chunk FROM t WHERE c <> ''")
def chunk_whole(spark, d):
    return _chunks(spark, d, "whole")


@query(f"{_T} {_FIXED}")
def chunk_fixed(spark, d):
    return _chunks(spark, d, "fixed")


@query(f"{_T} {_window(110)}")
def chunk_sliding(spark, d):
    return _chunks(spark, d, "sliding")


@query(f"{_T} " + _numbered(r"SELECT doc_id, i, s[i] AS chunk FROM (SELECT doc_id, string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM t), unnest(range(1, len(s) + 1)) AS u(i)"))
def chunk_sentence(spark, d):
    return _chunks(spark, d, "sentence")


_RECURSIVE = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, {_strip('text')} AS c FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, list_filter(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS s FROM t),
r AS (SELECT doc_id, 0 AS i, '' AS held, []::VARCHAR[] AS made FROM s
UNION ALL SELECT doc_id, i + 1, CASE WHEN len(x) > 220 THEN {_strip('substr(x, last + 1)')} WHEN held <> '' AND len(held) + 1 + len(x) > 220 THEN x ELSE {_strip("held || ' ' || x")} END,
  CASE WHEN len(x) > 220 THEN list_filter(list_concat([held], list_transform(range(0, last, 220), lambda k: {_strip('substr(x, (k + 1)::BIGINT, 220)')})), lambda y: y <> '') WHEN held <> '' AND len(held) + 1 + len(x) > 220 THEN [held] ELSE [] END
  FROM (SELECT r.doc_id, r.i, r.held, s.s[r.i + 1] AS x, (len(s.s[r.i + 1]) - 1) // 220 * 220 AS last FROM r JOIN s ON r.doc_id = s.doc_id WHERE r.i < len(s.s))),
p AS (SELECT doc_id, i, unnest(made) AS piece, unnest(range(len(made))) AS k FROM r UNION ALL SELECT r.doc_id, i + 1, held, 0 FROM r JOIN s ON r.doc_id = s.doc_id WHERE i = len(s.s) AND held <> ''),
o AS (SELECT doc_id, piece, row_number() OVER w - 1 AS n, lag(piece) OVER w AS prev FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i, k))
SELECT doc_id, doc_id || '#' || n AS chunk_id, n::INTEGER AS chunk_index, CASE WHEN prev IS NULL THEN piece ELSE {_strip("right(prev, 40) || ' ' || piece")} END AS chunk FROM o"""


@query(_RECURSIVE)
def chunk_recursive(spark, d):
    return _chunks(spark, d, "recursive")


_SEMANTIC = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, {_strip('text')} AS c FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, c, list_filter(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS s FROM t WHERE c <> ''),
u AS MATERIALIZED (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM s WHERE len(s) > 1),
n AS (SELECT doc_id, i, bucket, 1 + ln(count(*)) AS w FROM (SELECT doc_id, i, (('0x' || md5(unnest(regexp_extract_all(lower(x), '[a-z0-9]+'))))::UHUGEINT % 256)::INTEGER AS bucket FROM u) GROUP BY ALL),
m AS (SELECT doc_id, i, map_from_entries(list((bucket, w))) AS m, sqrt(sum(w * w)) AS norm FROM n GROUP BY doc_id, i),
v AS MATERIALIZED (SELECT doc_id, i, x, list_transform(range(256), lambda b: coalesce(m[b::INTEGER] / norm, 0::DOUBLE)) AS v FROM u LEFT JOIN m USING (doc_id, i)),
r AS (SELECT doc_id, i, x AS held, v AS centre, NULL::VARCHAR AS made FROM v WHERE i = 1
UNION ALL SELECT doc_id, i, CASE WHEN ok THEN held || ' ' || x ELSE x END, CASE WHEN ok THEN list_transform(range(1, 257), lambda k: (centre[k] + v[k]) / 2) ELSE v END, CASE WHEN NOT ok THEN held END
  FROM (SELECT v.doc_id, v.i, v.x, v.v, r.held, r.centre, len(r.held) + len(v.x) + 1 <= 220 AND coalesce(nullif(list_cosine_similarity(r.centre, v.v), 'NaN'::DOUBLE), 0) >= 0.12 AS ok FROM r JOIN v ON v.doc_id = r.doc_id AND v.i = r.i + 1)),
p AS (SELECT doc_id, i, made AS piece FROM r WHERE made IS NOT NULL UNION ALL SELECT r.doc_id, i + 1, held FROM r JOIN s ON r.doc_id = s.doc_id WHERE i = len(s.s) UNION ALL SELECT doc_id, 1, c FROM s WHERE len(s) <= 1),
o AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM p)
SELECT doc_id, doc_id || '#' || k AS chunk_id, k::INTEGER AS chunk_index, piece AS chunk FROM o"""


@query(_SEMANTIC)
def chunk_semantic(spark, d):
    return _chunks(spark, d, "semantic")


@query(_SEMANTIC)
def chunk_table(spark, d):
    """The semantic chunker as a table function in SQL."""
    register_chunks(spark)
    texts(spark, d).createOrReplaceTempView("chunk_table_texts")
    return spark.sql("SELECT d.doc_id, concat(d.doc_id, '#', c.chunk_index) AS chunk_id, c.chunk_index, c.chunk FROM chunk_table_texts d, LATERAL chunks(d.text, 'semantic') c")


_BUCKETS = "SELECT {k}, (('0x' || md5(token))::UHUGEINT % 512)::INTEGER AS bucket, 1 + ln(count(*)) AS w FROM (SELECT {k}, unnest(regexp_extract_all(lower({t}), '[a-z0-9]+')) AS token FROM {f}) GROUP BY ALL"


@query("WITH n AS (" + _BUCKETS.format(k="doc_id", t="text", f="documents") + ") SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM n")
def hash_embed(spark, d):
    return V.embed(texts(spark, d), ["doc_id"], "text").withColumn("w", F.round("w", 6))


_SIM = f"""{_T}, p AS ({_FIXED}), n AS ({_BUCKETS.format(k='doc_id, chunk_index', t='chunk', f='p')}),
q0 AS ({_BUCKETS.format(k='one', t=f"'{TEXT_QUESTION}'", f='(SELECT 1 AS one)')}), q AS (SELECT bucket, w / sqrt(sum(w * w) OVER ()) AS w FROM q0),
dot AS (SELECT doc_id, chunk_index, sum(n.w * coalesce(q.w, 0)) / sqrt(sum(n.w * n.w)) AS s FROM n LEFT JOIN q USING (bucket) GROUP BY doc_id, chunk_index),
s AS (SELECT doc_id, chunk_index, chunk, round(coalesce(s, 0), 4) AS similarity FROM p LEFT JOIN dot USING (doc_id, chunk_index)), found AS (SELECT * FROM s ORDER BY similarity DESC, doc_id, chunk_index LIMIT 50)"""


def _found(spark, d, threshold=0.0):
    p = VectorParams(top_k=50, chunk_strategy="fixed", similarity_threshold=threshold)
    return N.vector_retrieve(texts(spark, d), "doc_id", "text", TEXT_QUESTION, p)


@query(f"{_SIM} SELECT doc_id, chunk_index, similarity, round(1 - similarity, 4) AS distance FROM found")
def cosine_topk(spark, d):
    return _found(spark, d).select("doc_id", "chunk_index", "similarity", "distance")


@query(f"{_SIM} SELECT doc_id, chunk_index, similarity FROM found WHERE similarity >= 0.3")
def similarity_threshold(spark, d):
    return _found(spark, d, 0.3).select("doc_id", "chunk_index", "similarity")


@query(f"""{_SIM} SELECT 'passages cut for this question' AS index_mode, 'fixed' AS chunk_strategy, 'hashing-tf-512' AS embedder, 512 AS vector_dim, (SELECT array_to_string([round(coalesce(w, 0), 4)::DECIMAL(9, 4) FOR w IN list(w ORDER BY i)], ' ') FROM (SELECT i, w FROM range(8) AS g(i) LEFT JOIN q ON q.bucket = i)) AS preview,
count(*) FILTER (WHERE similarity >= 0.3) AS chunk_count, count(*) FILTER (WHERE similarity < 0.3) AS dropped_below_threshold FROM found""")
def search_report(spark, d):
    p = VectorParams(top_k=50, chunk_strategy="fixed", similarity_threshold=0.3)
    r = N.search_report(_found(spark, d), TEXT_QUESTION, p)
    return r.withColumn("preview", F.array_join(F.transform("query_vector_preview", lambda x: x.cast("decimal(9,4)").cast("string")), " ")).drop("query_vector_preview")


_QUALITY = "CASE quality WHEN 1 THEN 'became_law' WHEN 0 THEN 'died_in_committee' END"


@query(f"{_SIM}, l AS (SELECT doc_id, max({_QUALITY}) AS outcome FROM labels GROUP BY doc_id) SELECT outcome, count(*) AS n FROM found JOIN l USING (doc_id) WHERE outcome IS NOT NULL GROUP BY outcome")
def outcome_histogram(spark, d):
    return N.outcome_histogram(_outcomes(spark, d), "outcome", ["doc_id", "chunk_index"]).select("outcome", "n")


def _outcomes(spark, d):
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "became_law").when(F.col("quality") == 0, "died_in_committee")).alias("outcome"))
    return _found(spark, d).join(l, "doc_id", "left")


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], e), 0), 4) AS similarity FROM embeddings, q ORDER BY coalesce(list_cosine_similarity(embedding::DOUBLE[], e), 0) DESC, vec_id LIMIT 20")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    scored = e.withColumn("similarity", V.cosine(F.col("embedding"), F.lit([float(x) for x in first[0]] if first else []).cast("array<double>")))
    return V.top_chunks(scored, 20, ["vec_id"], raw=True).select("vec_id", "similarity")


@query("WITH n AS (" + _BUCKETS.format(k="doc_id", t="text", f="documents") + "), v AS (SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM n), g AS (SELECT doc_id, unnest(range(0, 8)) AS bucket FROM (SELECT DISTINCT doc_id FROM v)) SELECT doc_id, array_to_string(list(round(coalesce(w, 0), 4)::DECIMAL(9, 4) ORDER BY bucket), ' ') AS preview FROM g LEFT JOIN v USING (doc_id, bucket) GROUP BY doc_id")
def vector_preview(spark, d):
    dense = V.dense(texts(spark, d), ["doc_id"], "text")
    return dense.select("doc_id", F.array_join(F.transform(V.preview(F.col("vector")), lambda x: x.cast("decimal(9,4)").cast("string")), " ").alias("preview"))


_ENTITIES = "replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&#8217;', ''''), '&quot;', '\"')"
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT page_id, regexp_replace(regexp_replace({_ENTITIES}, '{_SPACE}', ' ', 'g'), '^ | $', '', 'g') AS prose FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("prose"))


@query(f"{_T}, p AS ({_FIXED}) SELECT (SELECT count(*) FROM part) AS bills, (SELECT count(*) FROM p) AS chunks")
def health(spark, d):
    n = bills(spark, d).agg(F.count("*").alias("bills"))
    return n.join(_chunks(spark, d, "fixed").agg(F.count("*").alias("chunks")))


# --- answers, measures, traces ----------------------------------------------------------------------


@query(_TOP + """, r AS (SELECT avg(CASE WHEN outcome = 'became_law' THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate, count(*) AS n FROM top), f AS (SELECT bill_id, title FROM top ORDER BY score DESC, bill_id LIMIT 1)
SELECT n, round(rate, 6) AS rate, bill_id AS closest, """ + f"""(SELECT string_agg('- ' || bill_id || ' "' || title || '": outcome ' || {_LABEL} || '; connected via ' || CASE WHEN n_leg + n_com = 0 THEN 'subject overlap' ELSE concat_ws(', ', CASE WHEN n_leg > 0 THEN n_leg || ' shared sponsor(s)' END, CASE WHEN n_com > 0 THEN n_com || ' shared committee(s)' END) END || '.', chr(10) ORDER BY score DESC, bill_id) FROM top) AS context FROM r, f""")
def graph_answer(spark, d):
    r = N.graph_context(_related(spark, d))
    return r.select("n", F.round("rate", 6).alias("rate"), F.regexp_extract("answer", "closest is (B[0-9]+)", 1).alias("closest"), "context")


@query(f"{_SIM} SELECT count(*) AS n, md5(string_agg('- ' || doc_id || ' (similarity ' || format('{{:.2f}}', similarity + 1e-9) || ', outcome Unknown): ' || chunk, chr(10) ORDER BY similarity DESC, doc_id, chunk_index)) AS digest FROM found")
def vector_answer(spark, d):
    found = _found(spark, d).withColumn("outcome", F.lit(None).cast("string")).withColumn("similarity", F.col("similarity") + 1e-9)
    return N.vector_context(found, "doc_id", "outcome").select("n", F.md5("context").alias("digest"))


@query(_TOP.replace("WITH ", f"WITH {_SIM.removeprefix('WITH ').replace('q AS', 'qv AS').replace('LEFT JOIN q USING', 'LEFT JOIN qv q USING')}, ", 1) + """ SELECT 'graph' AS engine, bill_id AS item, score, row_number() OVER (ORDER BY score DESC, bill_id)::INTEGER AS place FROM top
UNION ALL SELECT 'vector', doc_id::VARCHAR, similarity, row_number() OVER (ORDER BY similarity DESC, doc_id, chunk_index)::INTEGER FROM found""")
def compare_engines(spark, d):
    return N.compare(_related(spark, d), _found(spark, d), "doc_id")


def _trace(spark, events):
    trace, _ = N.execute(events)
    done = [(e["engine"], e["index"], e["step"], e.get("rows")) for e in trace if e["phase"] == "done"]
    return spark.createDataFrame(done, "engine string, place int, step string, n bigint")


@query(_SHARED + f""", n AS (SELECT unnest({list(N.GRAPH_STEPS)}) AS step, unnest(range(7))::INTEGER AS place, unnest([NULL, (SELECT count(*) FROM seeds), (SELECT count(*) FROM (SELECT DISTINCT kind, entity FROM links SEMI JOIN seeds USING (bill_id))),
(SELECT count(*) FROM top), (SELECT count(*) FROM (SELECT DISTINCT kind, entity, bill_id FROM around)), 1, 1]) AS n) SELECT 'graph' AS engine, place, step, n FROM n""")
def graph_engine(spark, d):
    """The graph engine from the question to the answer: the rows of each step of its trace."""
    return _trace(spark, N.graph_engine(cut(links(spark, d)), bills(spark, d), QUESTION))


@query(f"""{_SIM}, st AS (SELECT unnest({list(N.VECTOR_STEPS)}) AS step, unnest(range(4))::INTEGER AS place, unnest([(SELECT count(*) FROM found), (SELECT count(*) FROM found WHERE similarity >= 0.3), 1, 1]) AS n) SELECT 'vector' AS engine, place, step, n FROM st""")
def vector_engine(spark, d):
    p = VectorParams(top_k=50, chunk_strategy="fixed", similarity_threshold=0.3)
    return _trace(spark, N.vector_engine(texts(spark, d).withColumn("outcome", F.lit(None).cast("string")), "doc_id", "text", TEXT_QUESTION, p))


@query(f"""WITH {BILLS_SQL}, {LINKS_SQL}, b AS (SELECT {_BODY} AS c FROM bills) SELECT 'bills' AS name, count(*) AS n FROM bills UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'passages', count(*) FROM b WHERE c <> ''
UNION ALL SELECT 'nodes', (SELECT count(*) FROM bills) + (SELECT count(DISTINCT kind || entity) FROM links) UNION ALL SELECT 'built again', count(*) FROM bills""")
def index_build(spark, d):
    """Bills, nodes, links and passages written once, kept when asked for again, and read back."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    nested = _nested(spark, d)
    I.build_index(nested, path)
    again = I.build_index(nested, path)
    index = I.Index(spark, path)
    counts = [(t, index.count(t)) for t in I.TABLES] + [("built again", again)]
    index.reset()
    return spark.createDataFrame(counts, "name string, n bigint")


_RETRIEVED = """WITH got AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
other AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 DESC, doc_id) AS rank FROM documents),
rel AS (SELECT DISTINCT source AS query, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
m AS (SELECT r.query, coalesce(avg(CASE WHEN rank <= 6 THEN hit END), 0)::DOUBLE AS precision, (coalesce(sum(CASE WHEN rank <= 6 THEN hit END), 0) / r.size)::DOUBLE AS recall, coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0)::DOUBLE AS reciprocal_rank
  FROM (SELECT query, count(*) AS size FROM rel GROUP BY query) r LEFT JOIN (SELECT got.*, CASE WHEN rel.item IS NULL THEN 0 ELSE 1 END AS hit FROM got LEFT JOIN rel ON got.query = rel.query AND got.item = rel.item) g USING (query) GROUP BY r.query, r.size)"""


def _ranked(spark, d, *by):
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("query"), F.col("doc_id").alias("item"), F.row_number().over(Window.partitionBy("source").orderBy(*by)).alias("rank"))


def _metrics(spark, d):
    got = _ranked(spark, d, F.desc("n_chars"), "doc_id")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    rel = table(spark, d, "documents").join(good, "doc_id", "left_semi").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))
    return E.retrieval_metrics(got, rel)


@query(_RETRIEVED + " SELECT query, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM m")
def precision_recall_mrr(spark, d):
    return _metrics(spark, d).select("query", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")))


@query(_RETRIEVED + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m")
def metric_averages(spark, d):
    a = E.averages(_metrics(spark, d))
    return a.select(*(F.round(c, 6).alias(c) for c in a.columns))


@query(_RETRIEVED + ", x AS (SELECT query, list(item) AS x FROM got WHERE rank <= 6 GROUP BY query), y AS (SELECT query, list(item) AS y FROM other WHERE rank <= 6 GROUP BY query) SELECT query, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM x JOIN y USING (query)")
def jaccard_overlap(spark, d):
    a, b = _ranked(spark, d, F.desc("n_chars"), "doc_id"), _ranked(spark, d, (F.col("n_chars") % 97).desc(), "doc_id")
    return E.overlap(a.where("rank <= 6"), b.where("rank <= 6")).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY rank, item)::INTEGER AS rank FROM (SELECT user_id AS query, event_type AS item, min(event_id) AS rank FROM events GROUP BY ALL)")
def keep_first(spark, d):
    return E.dedupe(table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_type").alias("item"), F.col("event_id").alias("rank")))


def _steps(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 > 0, "done").otherwise("start").alias("phase"), F.when(F.col("value") > 20, F.col("value")).alias("value"))


_STEPS = "WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 > 0 THEN 'done' ELSE 'start' END AS phase, CASE WHEN value > 20 THEN value END AS value FROM events), s AS (SELECT user_id, event_type, arg_max(phase, event_id) AS phase, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM e GROUP BY ALL)"


@query(_STEPS + " SELECT * FROM s")
def trace_state_merge(spark, d):
    return T.merge_state(_steps(spark, d), ["user_id", "event_type"], "event_id", ["phase", "value"])


@query(_STEPS + " SELECT user_id, round(count(*) FILTER (WHERE phase = 'done') / 11, 6) AS progress FROM s GROUP BY user_id")
def trace_progress(spark, d):
    return T.progress(trace_state_merge(spark, d), "user_id", "phase").withColumn("progress", F.round("progress", 6))


@query("WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INTEGER AS step FROM events) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step, event_type)::INTEGER AS at FROM s")
def trace_interleave(spark, d):
    return T.interleave(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


from evidra.plans import catalog_index  # noqa: E402, F401  it registers its queries here
