"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.lineage import cut, drop, remove, shared_dir  # noqa: F401  for the operators

#: Keys of rows (16 bytes each) up to this number are broadcast.
BROADCAST_KEYS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Texts can be very long: let Python workers of this session get batches of a few megabytes, unless it asks for smaller ones."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def lean(run):
    """A task's function whose worker gives its memory back when the task ends: workers are kept for later tasks, and what they have
    once held would stay with them, beside the memory of the workers of the next stage."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library on Linux
            if trim:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, scattered."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of a row's columns, ``k1`` and ``k2``: rows with equal columns, nulls included, share them."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose key is not among ``gone`` (or, with ``left_semi``, is). Few keys are broadcast, so that the
    texts stay where they are; more are joined by a shuffle."""
    gone = gone.select(F.col("k1").alias("_gone1"), F.col("k2").alias("_gone2"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.withColumns({"_key1": k1, "_key2": k2})
    return keyed.join(gone, (F.col("_key1") == F.col("_gone1")) & (F.col("_key2") == F.col("_gone2")), how).drop("_key1", "_key2")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal ``keys`` of a partition that is sorted by them; only one group is held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pd.concat([*held, batch.iloc[a:b]], ignore_index=True)
            held = []
        held.append(batch.iloc[edges[-2] :])
    if held:
        yield pd.concat(held, ignore_index=True)


class Labels:
    """Local connected components over positions 0..n-1; the label is the smallest position."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.of[x]
        while True:
            above = self.of[up]
            if (above == up).all():
                return up
            up = above

    def join(self, touched: np.ndarray) -> None:
        """Join the components of these positions."""
        roots = self.roots(touched)
        low = roots.min()
        self.of[roots] = low
        self.of[touched] = low

    def join_rows(self, first: int, linked: np.ndarray) -> None:
        """``linked[r, c]``: position ``first + r`` is linked with position ``c``."""
        for r in np.flatnonzero(linked.any(axis=1)):
            self.join(np.append(np.flatnonzero(linked[r]), first + r))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions other than their component's label, and those labels."""
        self.of = self.roots(np.arange(len(self.of)))
        p = np.flatnonzero(self.of != np.arange(len(self.of)))
        return p, self.of[p]
