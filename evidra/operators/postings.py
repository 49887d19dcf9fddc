"""Stored term vectors of passages as an inverted file, and exact top-k search over it with bounds of blocks.

Passages of equal text that one task stores are one entry, so a search scores a text once, however often it occurs. Entries of similar greatest
weight share blocks of ``BLOCK`` at most. A posting list is (bucket, block): the places of the block's entries that have the bucket, how often, and
the greatest weight among them. A question's bound for a block is the sum of its own weights times these, and no passage of the block is more similar. So a search scores the few most promising blocks of each question first, and then only those blocks
whose bound reaches the k-th similarity so far; the lists of all others are never opened. Lists are laid out in folders by slices of buckets, in order
of bucket and block: a search reads its own buckets only, and bounds come from a column of their own.

Questions come as a table, so one plan answers one or many.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions.vectors import DIM, STEP, Counts, counted
from evidra.operators.lineage import cut

#: Entries of a block; folders that buckets are dealt into, and the one that names the passages of blocks; blocks that a task makes together; blocks that a search scores first.
BLOCK = 1024
SLICES = 32
MEMBERS = -1
TOGETHER = 32
FIRST = 4
#: Passages that a task holds at most before it makes blocks.
HELD = 1_000_000
#: Similarities count to so many places; passages that share nothing with a question have 0.
PLACES = 4


def vectors(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """``keys, buckets, weights``: damped counts of unit length, the same vectors as ``embed`` makes."""
    w = F.transform("counts", lambda c: (1 + F.log(c)) / F.col("norm"))
    return counted(df, keys, text, dim).select(*keys, "buckets", w.alias("weights"))


def _terms(v: DataFrame, keys: list[str], weight: str) -> DataFrame:
    return v.select(*keys, F.explode(F.arrays_zip("buckets", "weights")).alias("t")).select(*keys, F.col("t.buckets").alias("bucket"), F.col("t.weights").alias(weight))


def _best(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("question").orderBy(F.desc("similarity"), "key", "chunk_index")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


_NAMES = ["slice", "bucket", "block", "at", "n", "most", "keys", "chunks", "norms"]


def _in_order(passage: tuple) -> tuple:
    return tuple(y for x in passage for y in (x is not None, x))


def _block(number: int, rows: list[tuple], key: pa.DataType, named: int):
    """The lists of a block of ``(peak, passages, buckets, counts, norm)``: a row for each bucket, and such as name its passages, those of an
    entry by key and chunk, ``named`` of them at most."""
    sizes = np.array([len(r[2]) for r in rows])
    norms = np.array([r[4] for r in rows])
    bucket, n = (np.concatenate([r[i] for r in rows]).astype(np.int32) for i in (2, 3))
    at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(bucket, kind="stable")
    bucket, n, at = bucket[order], n[order], at[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    own, k = bucket[edges], len(edges)
    most = np.maximum.reduceat((1 + np.log(n)) / norms[at], edges) if k else np.zeros(0)
    offsets = pa.array(np.append(edges, len(bucket)), pa.int32())
    none = [pa.nulls(k, pa.list_(t)) for t in (key, pa.int32(), pa.float64())]
    if k:
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (at, n)]
        yield pa.RecordBatch.from_arrays([pa.array(own % SLICES, pa.int32()), pa.array(own, pa.int32()), pa.array([number] * k, pa.int64()), *lists, pa.array(most), *none], names=_NAMES)
    # of a passage: its entry, its place within that, key, chunk and norm
    each = [(i, j, *p, r[4]) for i, r in enumerate(rows) for j, p in enumerate(sorted(r[1], key=_in_order))]
    for some in (each[a : a + named] for a in range(0, len(each), named)):
        at, place, keys, chunks, norm = ([list(x)] for x in zip(*some))
        ints = pa.list_(pa.int32())
        columns = [pa.array(at, ints), pa.array(place, ints), pa.array([0.0]), pa.array(keys, pa.list_(key)), pa.array(chunks, ints), pa.array(norm, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([MEMBERS], pa.int32()), pa.array([MEMBERS], pa.int32()), pa.array([number], pa.int64()), *columns], names=_NAMES)


def build(passages: DataFrame, path: str, key: str, text: str = "chunk", dim: int = DIM, block: int = BLOCK) -> PostingFile:
    """Store the posting lists of passages (``key, chunk_index`` name one each) under ``path``, in one pass over them.

    Each task gathers passages of equal text in an entry; at its end, or when it holds very many entries or passages, entries are cut into blocks in
    order of their greatest weight. A passage without tokens is named in a block, is in no list, and is similar to nothing. No passages give an empty file.
    """
    spark = passages.sparkSession
    rows = passages.select(key, F.col("chunk_index").cast("int"), F.col(text).cast("string"))
    kind = passages.schema[key].dataType.simpleString()

    def run(batches):
        counts, known, made, held, first = Counts(dim), {}, 0, 0, TaskContext.get().partitionId() << 32
        type_ = None

        def blocks():
            nonlocal made, held
            entries = sorted(known.values(), key=lambda e: e[0])
            for a in range(0, len(entries), block):
                yield from _block(first + made, entries[a : a + block], type_, block)
                made += 1
            known.clear()
            held = 0

        for b in (whole.slice(a, STEP) for whole in batches for a in range(0, whole.num_rows, STEP)):
            type_ = b.column(0).type
            for k, c, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if t not in known:
                    buckets, n, norm = counts.of(t)
                    known[t] = ((1 + math.log(max(n))) / norm if n else 0.0, [], np.array(buckets, np.int32), np.array(n, np.int32), norm)
                known[t][1].append((k, c))
                held += 1
                if len(known) == TOGETHER * block or held == HELD:
                    yield from blocks()
        yield from blocks()

    lists = rows.mapInArrow(run, f"slice int, bucket int, block bigint, at array<int>, n array<int>, most double, keys array<{kind}>, chunks array<int>, norms array<double>")
    lists.sortWithinPartitions("slice", "bucket", "block").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/lists")
    return PostingFile(spark, path, kind, dim)


@dataclass
class PostingFile:
    """Posting lists of ``dim`` buckets stored at ``path``; ``kind`` is the type of the passages' keys."""

    spark: SparkSession
    path: str
    kind: str
    dim: int = DIM

    def members(self, first: int | None = None) -> DataFrame:
        """``block, at, key, chunk_index, norm, place``: the passages of blocks, or the ``first`` ones by key and chunk of each entry."""
        each = F.arrays_zip("at", "n", "keys", "chunks", "norms")
        each = each if first is None else F.filter(each, lambda p: p["n"] < first)
        p = self.lists().where(F.col("slice") == MEMBERS).select("block", F.explode(each).alias("p"))
        return p.select("block", "p.at", F.col("p.keys").alias("key"), F.col("p.chunks").alias("chunk_index"), F.col("p.norms").alias("norm"), F.col("p.n").alias("place"))

    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"bucket int, block bigint, at array<int>, n array<int>, most double, keys array<{self.kind}>, chunks array<int>, norms array<double>, slice int").parquet(f"{self.path}/lists")

    def asked(self, terms: DataFrame) -> DataFrame:
        """The lists of the buckets that are asked for."""
        buckets = sorted(r["bucket"] for r in terms.select("bucket").distinct().collect())  # no more than ``dim``
        return self.lists().where(F.col("slice").isin(sorted({b % SLICES for b in buckets})) & F.col("bucket").isin(buckets))

    def bounds(self, terms: DataFrame) -> DataFrame:
        """``question, block, bound``: no passage of the block is more similar to the question."""
        most = self.asked(terms).select("bucket", "block", "most")
        return terms.join(most, "bucket").groupBy("question", "block").agg(F.sum(F.col("q") * F.col("most")).alias("bound"))

    def scores(self, blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
        """``question, key, chunk_index, similarity``: of the passages that share a bucket with the question, in these blocks, the k most similar
        ones. They are among the first k of the k best entries, entries that tie being in the order of their first passages."""
        wanted = blocks.select("question", "block").join(terms, "question")
        hits = self.asked(terms).select("bucket", "block", "at", "n").join(wanted, ["bucket", "block"])
        hits = hits.select("question", "block", "q", F.explode(F.arrays_zip("at", "n")).alias("x"))
        dots = hits.groupBy("question", "block", F.col("x.at").alias("at")).agg(F.sum(F.col("q") * (1 + F.log("x.n"))).alias("dot"))
        named = self.members(k).join(blocks.select("block").distinct(), "block", "left_semi")
        scored = dots.join(named.where("place = 0"), ["block", "at"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), PLACES))
        entries = _best(scored, k).select("question", "block", "at", "similarity")
        return _best(entries.join(named, ["block", "at"]), k).select("question", "key", "chunk_index", "similarity")

    def search(self, questions: DataFrame, k: int = 6, first: int = FIRST) -> DataFrame:
        """``questions``: question, text. ``question, key, chunk_index, similarity, rank``: the k most similar passages of each, by similarity to
        ``PLACES`` places, then key and place; exact, also where fewer than k share a bucket with it (then the first ones by key fill up)."""
        q = cut(vectors(questions, ["question"], "text", self.dim))
        terms = cut(_terms(q, ["question"], "q"))
        bounds = cut(self.bounds(terms))
        by = lambda *c: Window.partitionBy("question").orderBy(*c)
        best = lambda rows: _best(rows, k)
        near = bounds.withColumn("place", F.row_number().over(by(F.desc("bound"), "block")))
        top = near.where(F.col("place") <= first).select("question", "block")
        found = cut(self.scores(top, terms, k))
        least = found.groupBy("question").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(0.0).alias("least"))
        rest = bounds.join(top, ["question", "block"], "left_anti").join(least, "question", "left")
        rest = rest.where(F.round(F.col("bound") + 1e-9, PLACES) >= F.coalesce("least", F.lit(0.0)))
        found = cut(best(found.unionByName(self.scores(rest, terms, k))))
        short = q.select("question").join(found.where("similarity > 0").groupBy("question").agg(F.count("*").alias("n")), "question", "left").where(F.coalesce("n", F.lit(0)) < k).select("question")
        if not short.isEmpty():
            lead = self.members(2 * k).select("key", "chunk_index").orderBy("key", "chunk_index").limit(2 * k).collect()
            place = lambda r: F.struct(F.lit(r["key"]).cast(self.kind).alias("key"), F.lit(r["chunk_index"]).alias("chunk_index"))
            lead = F.array(*map(place, lead)).cast(f"array<struct<key:{self.kind},chunk_index:int>>")
            zeros = short.select("question", F.explode(lead).alias("p")).select("question", "p.key", "p.chunk_index")
            zeros = zeros.join(found, ["question", "key", "chunk_index"], "left_anti")
            found = best(found.drop("rank").unionByName(zeros.withColumn("similarity", F.lit(0.0))))
        return found.select("question", "key", "chunk_index", "similarity", "rank")
