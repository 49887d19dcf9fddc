"""Step events of a run: keyed state, progress, interleaving; as batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.sources.snapshots import PARTS, Rule, Store

STEPS = 11
#: The query log, one JSON object a line.
LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("ts", "query", "graph_answer", "vector_answer", "model", "graph_params", "vector_params")])


def merge_state(events: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The state of each key: later values overwrite, those a later event leaves out stay. Grouped
    aggregates only, so it runs on a stream in update mode too."""
    return events.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))


def progress(state: DataFrame, run: str, phase: str, total: int = STEPS) -> DataFrame:
    return state.groupBy(run).agg((F.count_if(F.col(phase) == "done") / total).alias("progress"))


def interleave(steps: DataFrame, run: str, lane: str, order: str, closing: str | None = None) -> DataFrame:
    """One timeline g0, v0, g1, v1, ...; a longer lane goes on alone. With ``closing`` a last row ends each run."""
    place = F.row_number().over(Window.partitionBy(run, lane).orderBy(order))
    out = steps.withColumn("step", place).withColumn("at", F.row_number().over(Window.partitionBy(run).orderBy("step", lane)))
    if closing is None:
        return out
    ends = out.groupBy(run).agg((F.max("at") + 1).alias("at")).withColumn(lane, F.lit(closing))
    return out.unionByName(ends, allowMissingColumns=True)


def now_utc():
    """The time in UTC as ISO text, whatever the session's zone."""
    text = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(text, F.lit("+00:00"))


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The query log as it grows."""
    return spark.readStream.schema(LOG).json(path)


def append_log(rows: DataFrame, path: str) -> bool:
    """Append to the query log, stamped now where rows have no ``ts``. A log that can't be written must not stop an answer: the
    failure is told by the result."""
    blank = lambda f: now_utc() if f.name == "ts" else F.lit(None).cast("string")
    out = rows.select(*(F.col(f.name).cast("string") if f.name in rows.columns else blank(f).alias(f.name) for f in LOG))
    try:
        out.write.mode("append").json(path)
    except Exception:  # of any store
        return False
    return True


def merge_stream(source: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, name: str = "rows", parts: int = PARTS):
    """Append-merge each micro-batch into a table of the store at ``target``; of rows of a batch that share a key the last by
    ``order`` counts, and ``order`` is stored beside them.

    Each batch is one version of the store, under its number: a batch that runs again after a failure finds its number in the manifest and
    does nothing, or, if the failure was before that, merges as if for the first time. Only the parts that hold keys of the batch are
    written, so a batch costs what it touches. The last two versions stay for readers.
    """
    store = Store(source.sparkSession, target, {name: Rule("replace", tuple(keys), order="_latest", parts=parts)})

    def put(batch: DataFrame, number: int) -> None:
        if store.merge({name: batch.withColumn("_latest", F.col(order))}, checkpoint, number):
            store.vacuum()

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
