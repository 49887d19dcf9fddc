"""Feature-hashed term vectors and exact cosine search."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import hash_vector

DIM = 512
#: Entries of a task's table of tokens, after which it is emptied, and rows that a task reads at once.
TOKENS = 500_000
STEP = 1000
_TOKEN = re.compile("[a-z0-9]+")


class Counts:
    """Tokens of texts by md5 bucket: buckets, how often, and the length of the damped counts."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}
        self.damped = [0.0, *((1 + math.log(c)) ** 2 for c in range(1, 1000))]

    def by_bucket(self, text: str | None) -> Counter:
        known, dim = self.known, self.dim
        tokens = _TOKEN.findall((text or "").lower())
        for x in set(tokens).difference(known):
            known[x] = int.from_bytes(hashlib.md5(x.encode()).digest(), "big") % dim
        n = Counter(map(known.__getitem__, tokens))
        if len(known) > TOKENS:
            known.clear()
        return n

    def norm(self, n: Counter) -> float:
        return math.sqrt(sum(self.damped[x] if x < 1000 else (1 + math.log(x)) ** 2 for x in n.values()))

    def of(self, text: str | None) -> tuple[list[int], list[int], float]:
        n = self.by_bucket(text)
        return list(n), list(n.values()), self.norm(n)

    def cosine(self, text: str | None, query: list[tuple[int, float]]) -> float:
        n = self.by_bucket(text)
        dot = sum(w * (1 + math.log(n[b])) for b, w in query if b in n)
        return dot / self.norm(n) if dot else 0.0


def counted(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """``keys, buckets, counts, norm``; empty arrays for a text without tokens. One row for each text, nothing is shuffled."""

    def run(batches):
        counts = Counts(dim)
        for b in (whole.slice(a, STEP) for whole in batches for a in range(0, whole.num_rows, STEP)):
            got = [counts.of(t) for t in b.column(len(keys)).to_pylist()]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *columns], names=[*keys, "buckets", "counts", "norm"])

    rows = df.select(*keys, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, buckets array<int>, counts array<int>, norm double")


def units(df: DataFrame, keys: list[str], text: str, dim: int = DIM, whole: bool = False) -> DataFrame:
    """``keys, bucket, w``: arrays of the buckets that a key's texts have and of their 1 + ln(count), of unit length; with ``whole`` there is
    one array ``vector`` of all buckets instead. A key without tokens has no row.

    A text is one row on its way, its tokens never are. Rows of a key (of values that Python can hash) are put together within a task's step,
    and then, dealt and sorted by key, as they follow each other, so a key of very many rows is never held whole.
    """
    at = len(keys)

    def lists(flat, ends, type_):
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, type_))

    def count(batches):
        counts = Counts(dim)
        for b in (all_.slice(a, STEP) for all_ in batches for a in range(0, all_.num_rows, STEP)):
            found: dict[tuple, tuple[int, Counter]] = {}
            for i, (*key, t) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if n := counts.by_bucket(t):
                    found.setdefault(tuple(key), (i, Counter()))[1].update(n)
            rows = b.take(pa.array([i for i, _ in found.values()], pa.int32()))
            ends = np.cumsum([len(n) for _, n in found.values()], dtype=np.int64)
            flat = (chain.from_iterable(f(n) for _, n in found.values()) for f in (Counter.keys, Counter.values))
            values = [lists(np.fromiter(x, np.int32), ends, pa.int32()) for x in flat]
            yield pa.RecordBatch.from_arrays([*rows.columns[:at], *values], names=[*keys, "bucket", "n"])

    def merge(b):
        """Rows that follow each other with the same key as one."""
        key = list(zip(*(c.to_pylist() for c in b.columns[:at])))
        first = np.array([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
        bucket, n = b.column(at), b.column(at + 1)
        run = np.repeat(np.cumsum(first) - 1, bucket.value_lengths().to_numpy())
        code, back = np.unique(run * dim + bucket.flatten().to_numpy(), return_inverse=True)
        n = np.bincount(back, n.flatten().to_numpy()).astype(np.int64)
        ends = np.searchsorted(code, (np.arange(first.sum()) + 1) * dim)
        rows = b.take(pa.array(np.flatnonzero(first)))
        return pa.RecordBatch.from_arrays([*rows.columns[:at], lists(code % dim, ends, pa.int32()), lists(n, ends, pa.int32())], names=b.schema.names)

    def made(b):
        size, bucket = b.column(at).value_lengths().to_numpy(), b.column(at).flatten().to_numpy()
        w = 1 + np.log(b.column(at + 1).flatten().to_numpy())
        ends = np.cumsum(size, dtype=np.int64)
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, ends - size)), size)
        if not whole:
            return pa.RecordBatch.from_arrays([*b.columns[:at], lists(bucket, ends, pa.int32()), lists(w, ends, pa.float64())], names=[*keys, "bucket", "w"])
        vector = np.zeros(len(size) * dim)
        vector[np.repeat(np.arange(len(size)) * dim, size) + bucket] = w
        return pa.RecordBatch.from_arrays([*b.columns[:at], lists(vector, (np.arange(len(size)) + 1) * dim, pa.float64())], names=[*keys, "vector"])

    def weigh(batches):
        held = None  # the last key so far: the next batch may go on with it
        for b in (all_.slice(a, STEP) for all_ in batches for a in range(0, all_.num_rows, STEP)):
            b = merge(b if held is None else pa.concat_batches([held, b]))
            held = b.slice(b.num_rows - 1)
            if b.num_rows > 1:
                yield made(b.slice(0, b.num_rows - 1))
        if held is not None:
            yield made(held)

    rows = df.select(*keys, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    counted_ = rows.mapInArrow(count, f"{kept}, bucket array<int>, n array<int>").repartition(*keys).sortWithinPartitions(*keys)
    return counted_.mapInArrow(weigh, f"{kept}, vector array<double>" if whole else f"{kept}, bucket array<int>, w array<double>")


def embed(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """Sparse vectors ``keys, bucket, w``: 1 + ln(count) by bucket, of unit length; a text without tokens has no rows."""
    return units(df, keys, text, dim).select(*keys, F.inline(F.arrays_zip("bucket", "w")))


def dense(df: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """``keys, vector``: arrays of all buckets, zeros included; a text without tokens has no row."""
    return units(df, keys, text, dim, whole=True)


def preview(vector: Column, n: int = 8) -> Column:
    return F.transform(F.slice(vector, 1, n), lambda x: F.round(x, 4))


def similarity(df: DataFrame, text: str, query: str, dim: int = DIM) -> DataFrame:
    """``df`` with its rows' cosine to a query; rows that share no bucket have 0.

    All within the row, so nothing is shuffled or joined; tokens are counted in Python, where a task knows the buckets of those it has met.
    """
    q = sorted(hash_vector(query, dim).items())

    @F.pandas_udf("double")
    def to_query(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(dim)
        for b in batches:
            yield pd.Series([counts.cosine(t, q) for t in b], dtype="float64")

    return df.withColumn("similarity", to_query(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top_chunks(scored: DataFrame, k: int, order: list[str], threshold: float = 0.0, raw: bool = False) -> DataFrame:
    """The k most similar rows, by similarity rounded to four places (or, with ``raw``, as it is), then ``order``; the
    threshold comes after, on the rounded value."""
    shown = F.round("similarity", 4)
    top = scored.orderBy(F.desc("similarity") if raw else F.desc(shown), *order).limit(k).withColumn("similarity", shown)
    return top.where(F.col("similarity") >= threshold).withColumn("distance", F.round(1 - F.col("similarity"), 4))


@dataclass(frozen=True)
class Embedder:
    """Feature-hashed term vectors of ``dim`` buckets."""

    dim: int = DIM

    @property
    def name(self) -> str:
        return f"hashing-tf-{self.dim}"

    def query(self, text: str) -> list[float]:
        w = hash_vector(text, self.dim)
        return [w.get(i, 0.0) for i in range(self.dim)]

    def similarity(self, df: DataFrame, text: str, query: str) -> DataFrame:
        return similarity(df, text, query, self.dim)


#: Embedders by the kind that settings name; more can be added.
EMBEDDERS = {"hashing": Embedder}


def build_embedder(kind: str = "hashing", dim: int = DIM) -> Embedder:
    if kind not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {kind}")
    return EMBEDDERS[kind](dim)
