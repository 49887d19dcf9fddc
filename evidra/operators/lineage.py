"""Cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster's session must name it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="evidra-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


#: Drops the shuffle files of a plan when its action has ended; a plan takes the setting when it is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: An adaptive plan does not tell how its rows are dealt out.
ADAPTIVE = "spark.sql.adaptive.enabled"


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``; where a local session names none, as in tests, in a temporary folder.

    Rows are in the shared folder then, so the shuffle files that led to them go at once, and a lost executor loses none.
    With ``dealt`` the checkpoint keeps the partitioning and order of ``df``, so that later joins and groups need not shuffle it anew.
    """
    spark = df.sparkSession
    shared_dir(spark)
    names = {CLEANUP: "true"} | ({ADAPTIVE: "false"} if dealt else {})
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the checkpoint of a frame that ``cut`` made and that nothing will read any more."""
    rdd = df._jdf.rdd()
    while not rdd.isCheckpointed():
        above = rdd.dependencies()
        if above.isEmpty():
            return
        rdd = above.head().rdd()
    remove(df.sparkSession, rdd.getCheckpointFile().get())
