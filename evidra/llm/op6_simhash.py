"""SimHash near-duplicates: word-shingle fingerprints, linked exactly within a Hamming radius by a forest
of vantage-point trees.

Two 64-bit fingerprints within 3 bits agree within 1 bit on one of their 32-bit halves. So there is one
tree for each half. A node holds a vantage point, a radius and the metric (its half, or all 64 bits).
A fingerprint is *owned* by the one leaf on its path, and *visits* the leaves that the triangle bound
cannot exclude: with slack s (1 on a half, 3 on all bits), a point at distance d from the vantage point
has neighbours inside only if d - s <= r and outside only if d + s > r. Each leaf is one group of a
shuffle; owned fingerprints are compared with owned and visiting ones, so no pair is missed. The first trees are fitted on a bounded
sample, so in a large table their leaves are large: inside a leaf that owns more than ``BLOCK`` fingerprints another tree is fitted, on the
executors, and so on. A leaf that stays larger (a dense ball that no vantage point divides) is dealt into blocks: each owned one
belongs to one block and visits those before it, so the work of a leaf is spread over many tasks. A block sends
out star edges of its local components, never all pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import BROADCAST_KEYS, Labels, cut, groups, lean, partitions
from evidra.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
LEAF = 2048
#: Owned fingerprints of a group at most, about.
BLOCK = 4096
#: Fingerprints that the trees are fitted on; every fingerprint is routed through them. Those that the tree inside a large leaf is fitted on.
SAMPLE = 60_000
FITTED = 8_192


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    return vote(np.array([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(k)))], np.uint64))


def vote(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)``: fp is the fingerprint's bits as a signed long. A null text is empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, fp bigint")


# --- the forest ---------------------------------------------------------------------------------


def _distance(x: np.ndarray, v: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(v)) & np.uint64(mask)).astype(np.int16)


def build_tree(sample: np.ndarray, total: int, mask: int, radius: int, leaf: int = LEAF, seed: int = 7, seen: np.ndarray | None = None) -> list:
    """Nodes ``[vantage, mask, slack, r, inside, outside]``, or None for a leaf; node 0 is the root.

    ``sample``: owned fingerprints; ``seen``: those and visiting ones, the same if not given. A split is taken if it makes the comparisons
    (owned x visiting) fewer.
    """
    rng = np.random.default_rng(seed)
    full = (1 << 64) - 1
    scale = total / max(len(sample), 1)
    nodes: list = []

    def grow(own: np.ndarray, seen: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(own) * scale <= leaf or len(own) < 8:
            return at
        best = None
        for v in rng.choice(own, min(6, len(own)), replace=False):
            for m, slack in ((mask, radius // 2), (full, radius)):
                d, e = _distance(own, v, m), _distance(seen, v, m)
                ins = np.cumsum(np.bincount(d, minlength=66))
                vis = np.cumsum(np.bincount(e, minlength=66))
                for r in range(64):
                    inside, outside = ins[r], len(own) - ins[r]
                    if min(inside, outside) < 0.02 * len(own):
                        continue
                    vi, vo = vis[min(r + slack, 65)], len(seen) - (vis[r - slack] if r >= slack else 0)
                    cost = inside * vi + outside * vo
                    if best is None or cost < best[0]:
                        best = (cost, int(v), m, slack, r)
        if best is None or best[0] > 0.8 * len(own) * len(seen):
            return at
        _, v, m, slack, r = best
        d, e = _distance(own, v, m), _distance(seen, v, m)
        nodes[at] = [v, m, slack, r, 0, 0]
        nodes[at][4] = grow(own[d <= r], seen[e - slack <= r])
        nodes[at][5] = grow(own[d > r], seen[e + slack > r])
        return at

    grow(sample, sample if seen is None else seen)
    return nodes


def route(fps: np.ndarray, nodes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, leaf node, owned) of every leaf that each fingerprint owns or visits."""
    out = []
    todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        at, p, own = todo.pop()
        if not len(p):
            continue
        if nodes[at] is None:
            out.append((p, np.full(len(p), at), own))
            continue
        v, m, slack, r, inside, outside = nodes[at]
        d = _distance(fps[p], v, m)
        i, o = d - slack <= r, d + slack > r
        todo.append((inside, p[i], own[i] & (d[i] <= r)))
        todo.append((outside, p[o], own[o] & (d[o] > r)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def _leaf_edges(fp: np.ndarray, rep: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components within one leaf."""
    order = np.argsort(~own, kind="stable")
    fp, rep, n = fp[order].view(np.uint64), rep[order], int(own.sum())
    labels, step = Labels(len(fp)), max(1, 4_000_000 // max(len(fp), 1))
    for a in range(0, n, step):
        b = min(n, a + step)
        near = np.bitwise_count(fp[a:b, None] ^ fp[None, a:]) <= radius  # a pair of owned ones is seen once
        near[np.arange(b - a), np.arange(b - a)] = False
        for r in np.flatnonzero(near.any(axis=1)):
            labels.join(np.append(a + np.flatnonzero(near[r]), a + r))
    p, to = labels.stars()
    return rep[p], rep[to]


def _routed(trees: list[list], fp: np.ndarray, rep: np.ndarray, above: np.ndarray | None = None) -> pd.DataFrame:
    """The leaves of each tree that fingerprints own or visit; ``above``: whether they own the leaf that the tree divides."""
    out = []
    for tree, nodes in enumerate(trees):
        p, at, own = route(fp.view(np.uint64), nodes)
        out.append(pd.DataFrame({"tree": np.full(len(p), tree, np.int32), "leaf": at.astype(np.int64), "fp": fp[p], "rep": rep[p], "own": own.astype(bool) if above is None else own.astype(bool) & above[p]}))
    return pd.concat(out, ignore_index=True)


_ROWS = "tree int, leaf bigint, fp bigint, rep bigint, own boolean"


def _owned():
    return F.sum(F.col("own").cast("int"))


def _refined(rows: DataFrame, block: int, radius: int, leaf: int, sample: int) -> DataFrame:
    """Rows of leaves that own more than ``block``, in the leaves of trees that are fitted inside them, on the executors, until a leaf owns no
    more or no vantage point divides it.

    A tree is fitted on about ``sample`` of its leaf's own fingerprints and on visiting ones in the same measure; one task holds one tree at a
    time. A leaf's rows are dealt over tasks, and its tree is sent to each of them.
    """
    halves = ((1 << 64) - (1 << 32), (1 << 32) - 1)
    done, at = None, rows
    while True:
        sizes = at.groupBy("tree", "leaf").agg(_owned().alias("n")).where(F.col("n") > block)
        sizes = cut(sizes)
        if sizes.isEmpty():
            return at if done is None else done.unionByName(at)
        some = at.join(sizes, ["tree", "leaf"]).where(F.pmod(F.xxhash64("fp", F.lit(3)), F.ceil(F.col("n") / sample)) == 0)

        def fitted(key, g):
            own, fps = g["own"].to_numpy(bool), g["fp"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(fps)
            own, fps = own[order], fps[order]  # in one order, however rows came
            nodes = build_tree(fps[own], int(g["n"].iloc[0]), halves[key[0]], radius, leaf, seen=fps)
            return pd.DataFrame({"tree": [key[0]], "leaf": [key[1]], "nodes": [pickle.dumps(nodes) if len(nodes) > 1 else None]})

        trees = cut(some.groupBy("tree", "leaf").applyInPandas(fitted, "tree int, leaf bigint, nodes binary"))
        found = trees.where("nodes is not null")
        if found.isEmpty():
            return at if done is None else done.unionByName(at)
        known = F.broadcast(found.select("tree", "leaf"))  # no more than there are large leaves
        rest = at.join(known, ["tree", "leaf"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        parts = found.join(sizes, ["tree", "leaf"]).select("tree", "leaf", F.ceil(F.col("n") / (8 * block)).cast("int").alias("parts"), "nodes")
        share = F.pmod(F.xxhash64("fp", F.lit(9)), "parts").cast("int")
        # without nulls in numbers: pandas would make them floats
        held = parts.select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "nodes", F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("rep"), F.lit(False).alias("own"))
        inside = at.join(F.broadcast(parts.drop("nodes")), ["tree", "leaf"]).select("tree", "leaf", share.alias("part"), F.lit(None).cast("binary").alias("nodes"), "fp", "rep", "own")
        mixed = held.unionByName(inside).repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", F.col("nodes").isNull())

        def deeper(batches):
            nodes = None
            for g in (x for b in batches for _, x in b.groupby(["tree", "leaf", "part"], sort=False)):
                first = g["nodes"].iloc[0]
                if first is not None:
                    nodes, g = pickle.loads(first), g.iloc[1:]
                if len(g):
                    out = _routed([nodes], g["fp"].to_numpy(np.int64), g["rep"].to_numpy(np.int64), g["own"].to_numpy(bool))
                    tree, above = int(g["tree"].iloc[0]), int(g["leaf"].iloc[0])
                    # a leaf's name: of the one above and its own; two that share one are compared together, which costs time only
                    out["leaf"] = [xxhash.xxh64_intdigest(b"%d:%d" % (above, x)) >> 1 for x in out["leaf"].tolist()]
                    yield out.assign(tree=np.int32(tree))

        at = cut(mixed.mapInPandas(lean(deeper), _ROWS))


def near_edges(classes: DataFrame, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between the representatives of distinct fingerprints ``(fp, rep)``; their
    components are those of the graph of all pairs within ``radius`` bits."""
    spark = classes.sparkSession
    total = classes.count()
    of = max(1, -(-total // sample))
    picked = np.array([r[0] for r in classes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(of)) == 0).collect()], np.int64).view(np.uint64)
    picked.sort()
    halves = ((1 << 64) - (1 << 32), (1 << 32) - 1)
    forest = [build_tree(picked, total, m, radius, leaf) for m in halves]

    def routed(batches):
        for b in batches:
            yield _routed(forest, b["fp"].to_numpy(np.int64), b["rep"].to_numpy(np.int64))

    def linked(batches):
        for g in groups(batches, ["tree", "leaf", "block"]):
            a, b = _leaf_edges(g["fp"].to_numpy(np.int64), g["rep"].to_numpy(np.int64), g["own"].to_numpy(bool), radius)
            yield pd.DataFrame({"a": a, "b": b})

    rows = classes.select("fp", "rep").mapInPandas(lean(routed), _ROWS)
    # a row for each large leaf: no more than the first trees have leaves, and they were grown on the sample
    large = cut(rows.groupBy("tree", "leaf").agg(_owned().alias("owned")).where(F.col("owned") > block).select("tree", "leaf"))
    if not large.isEmpty():
        inside = _refined(cut(rows.join(F.broadcast(large), ["tree", "leaf"])), block, radius, leaf, FITTED)
        rows = rows.join(F.broadcast(large), ["tree", "leaf"], "left_anti").unionByName(inside)
        large = cut(inside.groupBy("tree", "leaf").agg(F.ceil(_owned() / block).cast("int").alias("blocks")).where("blocks > 1"))
        # balls that no vantage point divides are dealt into blocks
        rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_KEYS else large, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        rows = rows.withColumn("blocks", F.lit(1))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("mine")).otherwise(F.col("blocks") - 1))))
    rows = rows.select("tree", "leaf", "block", "fp", "rep", (F.col("own") & (F.col("block") == F.col("mine"))).alias("own"))
    n = max(partitions(spark), total // (8 * leaf))
    return rows.repartition(n, "tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block").mapInPandas(lean(linked), "a bigint, b bigint")


def simhash_neardup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (the smallest id
    reachable by links of at most ``radius`` bits) and ``kept`` (it is that smallest one).

    Equal fingerprints are one class, so copies cost one row in the search. Null and empty texts have the
    fingerprint zero and link like any other; very long ones are read whole. A row with a null id is returned with a null component. Rows
    that repeat an id are returned each. Other columns are ignored. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, k))
    classes = cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    comps = connected_components(near_edges(classes, radius, leaf))
    named = classes.join(comps, classes["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def op6_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    """``simhash_neardup`` over all documents; rows as its docstring says."""
    return simhash_neardup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
