"""Nearest neighbours by cosine through an inverted file: vectors are stored by the k-means cell they lie in, and a search reads the
cells that are nearest to its queries.

Cells are fitted on a bounded sample, every vector is stored. A cell knows its radius, the widest angle of its vectors to its centre, so
no vector in it is nearer to a query than the angle to the centre less the radius: the exact search reads the nearest cells
first and then, for each query, those whose bound reaches its k-th similarity so far.

A large cell is stored in blocks of ``BLOCK`` vectors, and a query is sent to each block of its cells, so that a task holds one block at a
time however many vectors, or queries, a cell draws.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.operators.lineage import cut

#: Vectors that cells are fitted on, about; cells at most; vectors of a block.
SAMPLE = 50_000
MOST_CELLS = 4096
BLOCK = 4096
#: Cells that a search reads for each query.
PROBE = 8
#: Vectors that a search is tried on to learn how many it must read.
TRIED = 200
#: Similarities are told apart to so many places; the cell of vectors without a direction.
PLACES = 9
NOWHERE = -1
_STEP = 256


def unit(vector: Column) -> Column:
    """A vector of length 1; null for one that is null, zero, or has a component that is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(fine & (norm > 0), F.transform(x, lambda v: v / norm))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length; zeros for a null, or one of another length."""
    return np.array([r if r is not None and len(r) == dim else [0.0] * dim for r in column.to_pylist()]).reshape(-1, dim)


def build(vectors: DataFrame, path: str, id_col: str, vector_col: str, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorFile:
    """Store vectors (whole numbers as ids) by cell under ``path``. ``cells`` is about the root of their number if not given.

    A vector without a direction (null, zero, components null or not finite, or another length than most) has similarity 0 to all; such
    vectors have a cell of their own. Repeated rows are stored each; no rows give an empty file.
    """
    spark = vectors.sparkSession
    v = cut(vectors.select(F.col(id_col).cast("bigint").alias("id"), unit(F.col(vector_col)).alias("vector")))
    lengths = v.where("vector is not null").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (lengths["dim"], lengths["count"]) if lengths else (1, 0)
    centres = np.zeros((0, dim))
    if n:
        some = v.where(F.size("vector") == dim).where(F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, -(-n // sample)))) == 0).select(array_to_vector("vector").alias("features"))
        fit = KMeans(k=max(2, min(MOST_CELLS, cells or round(n**0.5))), seed=7, maxIter=10).fit(some if some.count() else v.where(F.size("vector") == dim).limit(1).select(array_to_vector("vector").alias("features")))
        centres = np.array(fit.clusterCenters())
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.where(length > 0, centres / np.where(length > 0, length, 1), 0.0)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        c = shared.value
        for b in (whole.slice(a, _STEP) for whole in batches for a in range(0, whole.num_rows, _STEP)):
            m = _matrix(b.column(1), dim)
            near = m @ c.T if len(c) else np.zeros((len(m), 1))
            some = m.any(axis=1)
            cell = np.where(some, near.argmax(axis=1), NOWHERE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(m), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(near.max(axis=1))], names=["id", "vector", "cell", "near"])

    placed = cut(v.mapInArrow(assign, "id bigint, vector array<double>, cell int, near double"))
    table = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()  # a row for each cell
    rows = [(r["cell"], r["n"], -(-r["n"] // block), float(np.arccos(np.clip(r["near"], -1, 1))) + 1e-6, centres[r["cell"]].tolist() if r["cell"] >= 0 else [0.0] * dim) for r in sorted(table)]
    cells_of = spark.createDataFrame(rows, "cell int, n bigint, blocks bigint, radius double, centre array<double>")
    cells_of.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    placed = placed.join(F.broadcast(cells_of.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int"))
    laid = placed.select("id", "vector", "block", "cell").repartition("cell", "block").sortWithinPartitions("cell", "block")
    laid.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return VectorFile(spark, path)


@dataclass
class VectorFile:
    """Vectors stored at ``path``."""

    spark: SparkSession
    path: str

    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell int, n bigint, blocks bigint, radius double, centre array<double>").parquet(f"{self.path}/cells")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id bigint, vector array<double>, block int, cell int").parquet(f"{self.path}/vectors")

    def routes(self, queries: DataFrame, probe: int | None, reached: bool = False) -> DataFrame:
        """``query, vector, cell, block``: where each query goes: to its ``probe`` nearest cells, or (``reached``) to others whose
        bound is no less than its column ``least``. Cells are few, so each task has their table."""
        rows = self.cells().orderBy("cell").collect()
        dim = max((len(r["centre"]) for r in rows), default=1)
        c, radius = np.array([r["centre"] for r in rows]).reshape(-1, dim), np.array([r["radius"] for r in rows])
        cell, blocks = np.array([r["cell"] for r in rows], int), np.array([r["blocks"] for r in rows], int)
        shared = self.spark.sparkContext.broadcast((c, radius, cell, blocks))

        def run(batches):
            c, radius, cell, blocks = shared.value
            for b in (whole.slice(a, _STEP) for whole in batches for a in range(0, whole.num_rows, _STEP)):
                m = _matrix(b.column(1), dim)
                near = m @ c.T
                order = np.argsort(-np.where(cell == NOWHERE, -2.0, near), axis=1, kind="stable")
                chosen = np.zeros_like(near, bool)
                np.put_along_axis(chosen, order[:, :probe], True, axis=1)
                if reached:
                    bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0.0))
                    bound[:, cell == NOWHERE] = 0.0
                    bound[~m.any(axis=1)] = 0.0
                    chosen = ~chosen & (bound >= np.array(b.column(2).to_pylist(), float)[:, None] - 2 * 10.0**-PLACES)
                q, at = np.nonzero(chosen)
                each = np.repeat(np.arange(len(q)), blocks[at])
                part = np.arange(len(each)) - np.repeat(np.cumsum(blocks[at]) - blocks[at], blocks[at])
                take = pa.array(q[each])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(list(m[q[each]]), pa.list_(pa.float64())), pa.array(cell[at][each], pa.int32()), pa.array(part, pa.int32())], names=["query", "vector", "cell", "block"])

        return queries.mapInArrow(run, "query bigint, vector array<double>, cell int, block int")

    def meet(self, routes: DataFrame, k: int) -> DataFrame:
        """``query, id, similarity, cell``: the k nearest of each block to each query that is sent to it."""
        wanted = [r["cell"] for r in routes.select("cell").distinct().collect()]  # no more than there are cells
        stored = self.vectors().where(F.col("cell").isin(wanted)).select("cell", "block", F.lit(0).alias("asks"), "id", "vector")
        rows = stored.unionByName(routes.select("cell", "block", F.lit(1).alias("asks"), F.col("query").alias("id"), "vector"))
        rows = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")

        def run(batches):
            held, ids, parts = None, np.zeros(0, np.int64), []
            for b in (whole.slice(a, _STEP) for whole in batches for a in range(0, whole.num_rows, _STEP)):
                cell, block, asks, id_ = (np.array(b.column(i).to_pylist(), np.int64) for i in range(4))
                data = b.column(4).to_pylist()
                edges = np.flatnonzero(np.diff(cell) | np.diff(block) | np.diff(asks)) + 1
                for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                    if held != (cell[lo], block[lo]):
                        held, ids, parts = (cell[lo], block[lo]), np.zeros(0, np.int64), []
                    m = np.array(data[lo:hi])
                    if not asks[lo]:
                        ids, parts = np.concatenate([ids, id_[lo:hi]]), [*parts, m]
                        continue
                    if not len(ids):
                        continue
                    parts = [np.concatenate(parts)]
                    near = np.round(m @ parts[0].T, PLACES) + 0.0
                    out = []
                    for i, s in enumerate(near):
                        at = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                        at = at[np.lexsort((ids[at], -s[at]))[:k]]
                        out.append((np.full(len(at), id_[lo + i]), ids[at], s[at], np.full(len(at), cell[lo], np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query", "id", "similarity", "cell"])

        return rows.mapInArrow(run, "query bigint, id bigint, similarity double, cell int")

    def probe_for(self, recall: float, k: int = 10, sample: int = TRIED) -> int:
        """How many cells a search must read to find this share of the k nearest, by an exact search for about ``sample`` stored vectors."""
        n = self.cells().where(F.col("cell") != NOWHERE).agg(F.sum("n")).first()[0] or 0
        some = self.vectors().where(F.col("cell") != NOWHERE).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, n // sample))) == 0)
        tried = cut(some.select(F.col("id").alias("query"), "vector"))
        found = self.search(tried, "query", "vector", k, exact=True)
        centres = self.cells().where(F.col("cell") != NOWHERE).orderBy("cell").collect()
        shared = self.spark.sparkContext.broadcast((np.array([r["cell"] for r in centres]), np.array([r["centre"] for r in centres])))

        def places(batches):
            cell, c = shared.value
            for b in (whole.slice(a, 16) for whole in batches for a in range(0, whole.num_rows, 16)):
                order = cell[np.argsort(-(_matrix(b.column(1), c.shape[1]) @ c.T), axis=1, kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), len(cell))), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, len(cell) + 1), len(order)), pa.int32())], names=["of", "at", "place"])

        place = tried.mapInArrow(places, "of bigint, at int, place int")
        rows = found.join(place, (F.col("query") == F.col("of")) & (F.col("cell") == F.col("at"))).groupBy("place").count().orderBy("place").collect()
        total, seen = sum(r["count"] for r in rows), 0
        for r in rows:  # one for each cell at most
            seen += r["count"]
            if seen >= recall * total:
                return r["place"]
        return PROBE

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, probe: int = PROBE, exact: bool = False) -> DataFrame:
        """``query, id, rank, similarity, cell``: the k nearest stored vectors of each query, by cosine to ``PLACES`` places, then id.

        ``exact``: also read every cell that could hold one of them. A query without a direction has similarity 0 to all. Queries that share an
        id are one query's rows; null ids go last among ties.
        """
        q = cut(queries.select(F.col(id_col).cast("bigint").alias("query"), unit(F.col(vector_col)).alias("vector")))
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc_nulls_last("id"))
        best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = best(self.meet(cut(self.routes(q, probe)), k))
        if exact:
            found = cut(found.drop("rank"))
            least = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-2.0).alias("least"))
            more = q.join(least.withColumnRenamed("query", "of"), F.col("query").eqNullSafe(F.col("of")), "left").select("query", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
            found = best(found.unionByName(self.meet(cut(self.routes(more, probe, reached=True)), k)))
        return found.select("query", "id", "rank", "similarity", "cell")
