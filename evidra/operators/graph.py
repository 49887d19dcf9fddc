"""The bipartite graph of bills and the people and committees they share: seeds, expansion, scores, projection.

``links`` is the distinct table ``kind ('legislator' | 'committee'), entity, bill_id``: however often or in
whatever role someone touches a bill, it counts once. Every hop is two equi-joins on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.records import citation, congress_span, outcome_label, type_name
from evidra.functions.text import keywords
from evidra.operators.lineage import cut

HUB_CAP = 40
#: Links of a bill above which its pairs are dealt into parts.
MANY = 20_000


#: Properties of nodes beside their name: a legislator's party and state, a committee's chamber, a bill's congress, type, number and outcome.
PROPERTIES = ("party", "state", "chamber", "congress", "bill_type", "bill_number", "outcome")


def occurrences(bills: DataFrame) -> DataFrame:
    """Each person and committee of each bill: ``rel_type, label, key, name``, ``PROPERTIES``, ``order, bill_id``. Those without a key are left
    out; ``order`` is that of bills (``ordinal``, or else as they are read) and of their parts in a bill."""
    if "ordinal" not in bills.columns:
        bills = bills.withColumn("ordinal", F.monotonically_increasing_id())

    def exploded(rel: str, label: str, items, key: str, name: str, place: int) -> DataFrame:
        rows = bills.select("bill_id", "ordinal", F.posexplode(items).alias("at", "x")).where(F.coalesce(F.col(f"x.{key}"), F.lit("")) != "")
        has = rows.schema["x"].dataType.names
        given = [(F.col(f"x.{p}") if p in has else F.lit(None)).cast("string").alias(p) for p in PROPERTIES]
        order = F.struct(F.col("ordinal"), F.lit(place).alias("place"), F.col("at"))
        return rows.select(F.lit(rel).alias("rel_type"), F.lit(label).alias("label"), F.col(f"x.{key}").alias("key"), F.col(f"x.{name}").cast("string").alias("name"), *given, order.alias("order"), "bill_id")

    found = exploded("SPONSORED", "Legislator", F.array_compact(F.array("sponsor")), "bioguide_id", "full_name", 0)
    found = found.union(exploded("COSPONSORED", "Legislator", F.col("cosponsors"), "bioguide_id", "full_name", 1))
    return found.union(exploded("REVIEWED", "Committee", F.array_compact("committees"), "name", "name", 2))


def edges_of(found: DataFrame) -> DataFrame:
    """The edge of each of ``occurrences``."""
    return found.select("rel_type", F.col("label").alias("src_label"), F.col("key").alias("src_key"), F.lit("Bill").alias("dst_label"), F.col("bill_id").alias("dst_key"))


def decompose(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``label, key, name`` and ``PROPERTIES``, and edges ``rel_type, src_label, src_key, dst_label, dst_key``, of nested bills.

    There is one node for each label and key. People and committees without a key are left out, and each property of theirs has the last
    value that isn't null, in the order of bills (``ordinal``, or else as they are read) and of their parts in a bill; of bills that share an id
    the last one counts. Edges are distinct. Properties that ``bills`` doesn't have are null.
    """
    if "ordinal" not in bills.columns:
        bills = bills.withColumn("ordinal", F.monotonically_increasing_id())
    found = occurrences(bills)
    edges = edges_of(found).distinct()
    columns = ("name", *PROPERTIES)
    parts = [bills.schema["sponsor"].dataType, *(bills.schema[c].dataType.elementType for c in ("cosponsors", "committees"))]
    known = {"name", *(p for p in PROPERTIES if any(p in t.names for t in parts))}  # no rows are compared for what no part has
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))) if c in known else F.lit(None).cast("string")
    nodes = found.groupBy("label", "key").agg(*(last(c).alias(c) for c in columns))
    given = [(F.col(p) if p in bills.columns else F.lit(None)).cast("string").alias(p) for p in PROPERTIES]
    own = F.max_by(F.struct(F.col("title").alias("name"), *given), "ordinal").alias("x")
    return nodes.union(bills.groupBy(F.lit("Bill").alias("label"), F.col("bill_id").alias("key")).agg(own).select("label", "key", *(f"x.{c}" for c in columns))), edges


def links_of(edges: DataFrame) -> DataFrame:
    kind = F.when(F.col("rel_type") == "REVIEWED", "committee").otherwise("legislator")
    return edges.select(kind.alias("kind"), F.col("src_key").alias("entity"), F.col("dst_key").alias("bill_id")).distinct()


def seed_match(bills: DataFrame, query_words: list[str], limit: int = 3) -> DataFrame:
    """The bills whose subjects and title words share most with the query; ties by place in the corpus."""
    words = F.array_union(F.transform("subjects", F.lower), keywords(F.col("title")))
    overlap = F.size(F.array_intersect(words, F.lit(query_words).cast("array<string>")))
    return bills.select("bill_id", "ordinal", overlap.alias("overlap")).where("overlap > 0").orderBy(F.desc("overlap"), "ordinal").limit(limit)


def expand(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """The distinct hubs of a frontier of bills."""
    return links.join(frontier.select("bill_id"), "bill_id", "left_semi").select("kind", "entity").distinct()


def reach(links: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Every bill within ``hops`` of the seeds at its distance: ``bill_id, hop, legislators, committees``.

    Semi-naive: only the last layer is expanded, and what was reached is left out; it stops on an empty
    layer. Layers are checkpointed, so the plan doesn't grow with the hops.
    """
    reached, frontier, layers = seeds.select("bill_id"), seeds.select("bill_id"), None
    for hop in range(1, hops + 1):
        near = links.join(expand(links, frontier), ["kind", "entity"]).join(reached, "bill_id", "left_anti")
        shared = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("entity"))))
        layer = near.groupBy("bill_id").agg(F.lit(hop).alias("hop"), shared("legislator").alias("legislators"), shared("committee").alias("committees"))
        if hops > 1:
            layer = cut(layer)
        layers = layer if layers is None else layers.union(layer)
        if hop < hops:
            if layer.isEmpty():
                break
            frontier = layer.select("bill_id")
            reached = reached.union(frontier)
    return layers


def score_candidates(
    links: DataFrame, bills: DataFrame, seeds: DataFrame, query_words: list[str], hops: int = 1, legislator_weight: float = 2.0, committee_weight: float = 1.0, subject_weight: float = 0.5
) -> DataFrame:
    """Connection scores: half for each further hop, and the subjects that the query names."""
    near = reach(links, seeds, hops).join(bills.select("bill_id", "ordinal", "title", "outcome", "subjects"), "bill_id", "left")
    subject = F.array_sort(F.array_intersect(F.lit(query_words).cast("array<string>"), F.transform(F.coalesce("subjects", F.array().cast("array<string>")), F.lower)))
    decay = F.pow(F.lit(0.5), F.col("hop") - 1)
    score = decay * (legislator_weight * F.size("legislators") + committee_weight * F.size("committees")) + subject_weight * F.size(subject)
    return near.select("bill_id", "ordinal", "title", "outcome", "hop", "legislators", "committees", subject.alias("subject_overlap"), score.alias("score"))


def top_related(scored: DataFrame, k: int = 6) -> DataFrame:
    return scored.orderBy(F.desc("score"), "bill_id").limit(k)


def subgraph(links: DataFrame, bills: DataFrame, seeds: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that show why the related bills were chosen."""
    shared = related.select("bill_id", F.lit("legislator").alias("kind"), F.explode("legislators").alias("entity")).union(
        related.select("bill_id", F.lit("committee"), F.explode("committees"))
    )
    hubs = shared.select("kind", "entity").distinct()
    rel = F.when(F.col("kind") == "legislator", "sponsored").otherwise("reviewed")
    node = F.concat(F.when(F.col("kind") == "legislator", "leg:").otherwise("com:"), F.col("entity"))
    to_seeds = links.join(seeds.select("bill_id"), "bill_id", "left_semi").join(hubs, ["kind", "entity"], "left_semi")
    edges = shared.select("kind", "entity", "bill_id").union(to_seeds.select("kind", "entity", "bill_id"))
    edges = edges.select(node.alias("source"), F.col("bill_id").alias("target"), rel.alias("rel")).distinct()
    first = seeds.select("bill_id").join(bills, "bill_id").select(F.col("bill_id").alias("id"), F.lit("seed_bill").alias("kind"), F.col("bill_id").alias("label"), "title", "outcome", F.lit(None).cast("double").alias("score"))
    chosen = related.select(F.col("bill_id").alias("id"), F.lit("related_bill").alias("kind"), F.col("bill_id").alias("label"), "title", "outcome", F.round("score", 2).alias("score"))
    none = F.lit(None).cast("string")
    entity = hubs.select(node.alias("id"), "kind", F.col("entity").alias("label"), none.alias("title"), none.alias("outcome"), F.lit(None).cast("double").alias("score"))
    return first.union(chosen).union(entity), edges


def hub_lists(links: DataFrame, scope: DataFrame, hub_cap: int = HUB_CAP) -> DataFrame:
    """``kind, entity, bills, many``: the sorted bills in scope of each hub that has 2 to ``hub_cap`` of them; ``many`` are those of
    them that have more than ``MANY`` links, and the parts that their pairs are dealt into.

    The cap is part of the meaning (a hub of very many bills says nothing about two of them), counted within the scope. A hub
    beyond it sends a row more than the cap from each task, which tells it, so no list is longer.
    """
    inside = links.join(scope.select("bill_id"), "bill_id", "left_semi").where("kind is not null and entity is not null")
    inside = inside.withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("bill_id")) / MANY).cast("int"))
    hub = Window.partitionBy("entity", "kind")  # sorted by what tells rows apart first
    some = inside.withColumn("place", F.row_number().over(hub.orderBy("bill_id"))).where(F.col("place") <= hub_cap + 1)
    many = F.collect_list(F.when(F.col("parts") > 1, F.struct("bill_id", "parts"))).over(hub)
    lists = some.withColumn("bills", F.collect_list("bill_id").over(hub)).withColumn("many", many)
    return lists.where((F.col("place") == 1) & F.size("bills").between(2, hub_cap)).select("kind", "entity", F.sort_array("bills").alias("bills"), "many")


def pairs_of(hubs: DataFrame) -> DataFrame:
    """``a, b, sponsors, committees`` of ``hub_lists``. A bill goes through the shuffle with the list of those behind it in a hub, not
    once for each pair; one of very many links is dealt into parts by the other bill."""
    each = hubs.select("kind", "bills", "many", F.posexplode("bills").alias("at", "a")).where(F.col("at") + 1 < F.size("bills"))
    parts = F.coalesce(F.get(F.filter("many", lambda m: m["bill_id"] == F.col("a")), F.lit(0))["parts"], F.lit(1))
    each = each.select("kind", "a", F.slice("bills", F.col("at") + 2, F.size("bills")).alias("rest"), parts.alias("parts"))
    each = each.select("kind", "a", "rest", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = F.filter("rest", lambda b: F.pmod(F.xxhash64(b), F.col("parts")) == F.col("part"))
    dealt = each.select("a", "part", "kind", F.when(F.col("parts") > 1, own).otherwise(F.col("rest")).alias("rest")).where(F.size("rest") > 0)
    key = dealt.schema["a"].dataType.simpleString()
    return dealt.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(_shared, f"a {key}, b {key}, sponsors bigint, committees bigint")


def _starts(b: pa.RecordBatch) -> np.ndarray:
    """Where the rows of another bill, or of another part of it, begin."""
    n = b.num_rows
    new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in b.columns[:2]]
    return np.append(0, 1 + np.flatnonzero(new[0] | new[1]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, part, kind, rest`` in order of ``a, part`` as ``a, b, sponsors, committees``. A bill's rows may go on in the next batch, so the last one's wait."""

    def count(b):
        starts, rest = _starts(b), b.column("rest")
        sizes, other = rest.value_lengths().to_numpy(), rest.flatten().dictionary_encode()
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b.num_rows)))
        code, back = np.unique(np.repeat(run, sizes) * len(other.dictionary) + other.indices.to_numpy(), return_inverse=True)
        kinds = [np.repeat(pc.equal(b.column("kind"), k).to_numpy(zero_copy_only=False), sizes) for k in ("legislator", "committee")]
        a = b.column("a").take(pa.array(starts[code // len(other.dictionary)]))
        n = [pa.array(np.bincount(back, k, len(code)).astype(np.int64)) for k in kinds]
        return pa.RecordBatch.from_arrays([a, other.dictionary.take(pa.array(code % len(other.dictionary))), *n], names=["a", "b", "sponsors", "committees"])

    held = None
    for b in batches:
        if b.num_rows:
            b = b if held is None else pa.concat_batches([held, b])
            last = int(_starts(b)[-1])
            held = b.slice(last)
            if last:
                yield count(b.slice(0, last))
    if held is not None:
        yield count(held)


def bill_pairs(links: DataFrame, scope: DataFrame, hub_cap: int = HUB_CAP) -> DataFrame:
    """``a, b, sponsors, committees``: what each pair of bills in scope shares, through hubs of 2 to ``hub_cap`` bills; pairs are at most
    (cap - 1) / 2 for each link."""
    return pairs_of(hub_lists(links, scope, hub_cap))


def bill_graph(links: DataFrame, bills: DataFrame, subject: str | None = None, congress: int | None = None, limit: int = 120, min_shared: int = 1) -> tuple[DataFrame, DataFrame]:
    """The bill-to-bill projection: nodes ``bill_id, label, type_name, title, congress, outcome, outcome_label, subjects,
    degree, total_bills`` with their weighted degree, at most ``limit`` of the ``total_bills`` in scope, and the edges between them."""
    scope = bills
    if congress is not None:
        scope = scope.where(F.col("congress").cast("string") == str(congress))
    if subject:
        scope = scope.where(F.array_contains(F.transform("subjects", F.lower), subject.lower()))
    weight = F.col("sponsors") + F.col("committees")
    rel = F.when((F.col("sponsors") > 0) & (F.col("committees") > 0), "both").when(F.col("sponsors") > 0, "sponsor").otherwise("committee")
    shared = lambda hubs: pairs_of(hubs).where(weight >= min_shared).select("a", "b", weight.alias("weight"), rel.alias("rel"))
    hubs = cut(hub_lists(links, scope))  # used for degrees and for the nodes shown
    if min_shared > 1:
        ends = shared(hubs).select(F.explode(F.array("a", "b")).alias("bill_id"), "weight")
    else:  # a hub adds one to the weight of a bill with each other one in it: no pair is needed
        ends = hubs.where(F.col("kind").isin("legislator", "committee")).select(F.explode("bills").alias("bill_id"), (F.size("bills") - 1).alias("weight"))
    degree = ends.groupBy("bill_id").agg(F.sum("weight").alias("degree"))
    nodes = scope.join(degree, "bill_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    nodes = cut(nodes.orderBy(F.desc("degree"), "bill_id").limit(limit))
    keep = F.broadcast(nodes.select("bill_id"))  # ``limit`` rows
    label = citation(F.col("congress"), F.col("bill_type"), F.col("bill_number"))
    nodes = nodes.select("bill_id", label.alias("label"), type_name(F.col("bill_type")).alias("type_name"), "title", "congress", "outcome", outcome_label(F.col("outcome")).alias("outcome_label"), "subjects", "degree")
    nodes = nodes.withColumn("total_bills", F.lit(scope.count()).cast("bigint"))
    shown = hubs.select("kind", "entity", "many", F.explode("bills").alias("bill_id")).join(keep, "bill_id", "left_semi")
    shown = shown.groupBy("kind", "entity").agg(F.sort_array(F.collect_list("bill_id")).alias("bills"), F.first("many").alias("many"))
    return nodes, shared(shown)


def metadata(bills: DataFrame) -> DataFrame:
    """Distinct subjects and congresses with their spans: ``field, value, label``; what isn't a number is no congress."""
    s = bills.select(F.explode("subjects").alias("value")).distinct().select(F.lit("subject").alias("field"), "value", F.col("value").alias("label"))
    c = bills.select(F.col("congress").cast("string").alias("value")).distinct().where(F.col("value").try_cast("int").isNotNull())
    return s.union(c.select(F.lit("congress"), "value", congress_span(F.col("value"))))


def neighbours(groups: DataFrame) -> DataFrame:
    """Undirected adjacency ``node, neighbours``: for each node the sorted set of all that it shares one of ``groups`` with. Those in the array
    ``bills`` are all joined with each other; an edge is a group of two.

    Both directions of what a group joins go with it: a node is sent each of its groups once, and its set is made where they meet.
    """
    own = groups.select(F.array_distinct(F.array_compact("bills")).alias("bills")).where(F.size("bills") > 1)
    own = own.select(F.explode("bills").alias("node"), "bills")
    key = own.schema["node"].dataType.simpleString()
    return own.repartition("node").sortWithinPartitions("node").mapInArrow(_sets, f"node {key}, neighbours array<{key}>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``node, bills`` in order of ``node`` as a row for each node. A node's rows may go on in the next batch, so the set of the last one waits."""

    def sets(node, bills):
        starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(node.slice(1), node.slice(0, len(node) - 1)).to_numpy(zero_copy_only=False)))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        other = bills.flatten().dictionary_encode()
        names = other.dictionary.take(pc.sort_indices(other.dictionary))
        rank = pc.index_in(other.dictionary, names).to_numpy(zero_copy_only=False)
        code = np.unique(np.repeat(run, bills.value_lengths().to_numpy()) * len(names) + rank[other.indices.to_numpy()])
        nodes = node.take(pa.array(starts))
        own = pc.index_in(nodes, names).to_numpy(zero_copy_only=False)
        code = code[code % len(names) != own[code // len(names)]]
        ends = np.searchsorted(code, np.arange(len(starts) + 1) * len(names))
        return nodes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(code % len(names))))

    held = None
    for b in batches:
        if b.num_rows:
            node, bills = b.columns
            if held is not None:  # the set that waits, with its node, is a group of that node
                last = pa.concat_arrays([held[0], held[1].flatten()])
                node, bills = pa.concat_arrays([held[0], node]), pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(last)], pa.int32()), last), bills.cast(pa.list_(last.type))])
            nodes, found = sets(node, bills)
            if len(nodes) > 1:
                yield pa.RecordBatch.from_arrays([nodes.slice(0, len(nodes) - 1), found.slice(0, len(nodes) - 1)], names=["node", "neighbours"])
            held = nodes.slice(len(nodes) - 1), found.slice(len(nodes) - 1)
    if held is not None:
        yield pa.RecordBatch.from_arrays(list(held), names=["node", "neighbours"])


def around(links: DataFrame, bill_id: str) -> DataFrame:
    """All links of the hubs of one bill."""
    return links.join(links.where(F.col("bill_id") == bill_id).select("kind", "entity"), ["kind", "entity"], "left_semi")


def ego(edges: DataFrame, node: str) -> DataFrame:
    """A node's incident edges, strongest first by ``place``."""
    end = lambda node, other: F.struct(F.col(node).alias("node"), F.col(other).alias("neighbour"), "weight")
    near = edges.where((F.col("a") == node) | (F.col("b") == node)).select(F.inline(F.array(end("a", "b"), end("b", "a")))).where(F.col("node") == node)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "neighbour")))


def labelled(bills: DataFrame) -> DataFrame:
    return bills.withColumn("citation", citation(F.col("congress"), F.col("bill_type"), F.col("bill_number")))
