"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine verification,
distributed connected components.

Equal vectors are one class with a count. Each class goes to one bucket in each table; bits and tables follow from how
often the pairs of a sample share a bucket, and from the recall asked for. A bucket is one
group of a shuffle; one with more than ``BLOCK`` classes is dealt into blocks, and each pair of blocks is
a group of its own. Within a group all cosines come from one matrix product in double precision. A pair
counts in the first table that puts both in one bucket, so link counts add up over tables without any
table of pairs; out go a count for each class and the star edges of local components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import Labels, cut, groups, partitions
from evidra.llm.components import connected_components

THRESHOLD = 0.95
#: Least probability that a pair right at the threshold shares a bucket in some table.
RECALL = 0.9995
SEED = 11
#: Bits of a table at most; vectors of the sample they are chosen by, about; what a row costs in a table, in comparisons.
MOST_BITS = 32
SAMPLE = 4000
ROW_COST = 150
#: Classes in a group at most.
BLOCK = 2048


def tables_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many tables of so many bits reach ``recall`` for a pair right at the threshold."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def bits_for(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> int:
    """The bits of a table that make the search of n vectors cheapest, by how often pairs of a sample share a bucket: vectors
    around a common mean need more of them than evenly spread ones. The choice bears on the cost only."""
    if len(sample) < 2:
        return 4
    up = sample @ planes(sample.shape[1], MOST_BITS, 4, seed) > 0
    best = (math.inf, 4)
    for bits in range(4, MOST_BITS + 1, 2):
        together = 0.0
        for t in range(4):
            key = up[:, t * MOST_BITS : t * MOST_BITS + bits] @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            _, c = np.unique(key, return_counts=True)
            together += float((c * (c - 1)).sum()) / (4 * len(sample) * (len(sample) - 1))
        together = max(together, 2.0**-bits)
        cost = tables_for(bits, threshold, recall) * (ROW_COST * n + together * n * n)
        best = min(best, (cost, bits))
    return best[1]


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One bucket number for each row and table."""
    up = (x @ planes(x.shape[1], bits, tables, seed) > 0).reshape(len(x), tables, bits)
    return up @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _verify(g: pd.DataFrame, threshold: float, bits: int, tables: int, seed: int) -> pd.DataFrame:
    """Links of one group: of all pairs, or of those between its two blocks."""
    x, rep, mult = _unit(g["v"]), g["rep"].to_numpy(), g["mult"].to_numpy(np.int64)
    sigs = signatures(x, bits, tables, seed)
    t, block = int(g["tbl"].iloc[0]), g["block"].to_numpy()
    cross = g["lo"].iloc[0] != g["hi"].iloc[0]
    links, labels = np.zeros(len(g), np.int64), Labels(len(g))
    for a in range(0, len(g), 512):
        near = x[a : a + 512] @ x.T >= threshold
        near[np.arange(len(near)), a + np.arange(len(near))] = False
        if cross:
            near &= block[a : a + 512, None] != block[None, :]
        i, j = np.nonzero(near)
        for s in range(t):
            if not len(i):
                break
            new = sigs[a + i, s] != sigs[j, s]
            i, j = i[new], j[new]
        links[a : a + 512] += np.bincount(i, weights=mult[j], minlength=len(near)).astype(np.int64)
        near[:] = False
        near[i, j] = True
        labels.join_rows(a, near)
    p, to = labels.stars()
    star = rep.copy()
    star[p] = rep[to]
    found = (links > 0) | (star != rep)
    return pd.DataFrame({"a": star[found], "b": rep[found], "links": links[found]})


def embedding_neardup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, ``n_links`` (other rows found with cosine >= threshold), ``component_id``
    (smallest id reachable) and ``kept``.

    Null, empty and zero vectors, and those with null or non-finite parts, link with nothing; nor do
    vectors of different lengths, or rows with a null id (whose component is null). Rows that repeat an
    id count each. Other columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(good, F.transform("vec", lambda x: x + F.lit(0.0))).alias("vec"))
    narrow = df.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if narrow else "array<double>"
    classes = cut(rows.where("vec is not null").groupBy(F.col("vec").cast(kind).alias("v")).agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    n = classes.count()
    of = max(1, -(-n // SAMPLE))
    some = [r[0] for r in classes.where(F.pmod(F.xxhash64("rep"), F.lit(of)) == 0).select("v").collect()]
    length = max((len(v) for v in some), key=[len(v) for v in some].count, default=0)  # the most frequent one
    bits = bits_for(_unit([v for v in some if len(v) == length]) if length else np.zeros((0, 1)), n, threshold, recall, seed)
    tables = tables_for(bits, threshold, recall)

    def signed(batches):
        for b in batches:
            for _, g in b.groupby(b["v"].map(len)):
                yield g.assign(sigs=list(signatures(_unit(g["v"]), bits, tables, seed)), dim=g["v"].map(len))

    keyed = classes.mapInPandas(signed, f"v {kind}, rep bigint, mult bigint, sigs array<bigint>, dim int")
    spread = keyed.select("*", F.posexplode("sigs").alias("tbl", "sig"))
    large = keyed.select("dim", F.posexplode("sigs").alias("tbl", "sig")).groupBy("dim", "tbl", "sig").count().where(F.col("count") > block)
    large = cut(large.select("dim", "tbl", "sig", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    spread = spread.join(F.broadcast(large) if large.count() <= 10_000 else large, ["dim", "tbl", "sig"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = spread.select("dim", "tbl", "sig", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "v", "rep", "mult")
    key = ["dim", "tbl", "sig", "lo", "hi"]

    def linked(batches):
        for g in groups(batches, key):
            if len(g) > 1:
                yield _verify(g, threshold, bits, tables, seed)

    n = max(partitions(spark), 64)
    found = cut(spread.repartition(n, *key).sortWithinPartitions(*key).mapInPandas(linked, "a bigint, b bigint, links bigint"))
    comps = connected_components(found.select("a", "b"))
    links = found.groupBy("b").agg(F.sum("links").alias("links"))
    member = rows.where("vec is not null").select("id", F.col("vec").cast(kind).alias("v")).join(classes, "v").select("id", "rep", "mult")
    member = member.join(links, member["rep"] == links["b"], "left").join(comps, member["rep"] == comps["node"], "left")
    out = member.select("id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(rows.where("vec is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op1_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """``embedding_neardup`` over all embeddings; rows as its docstring says."""
    return embedding_neardup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
