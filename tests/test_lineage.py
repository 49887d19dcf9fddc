"""Checkpoints: rows stay, what led to them goes, and the session's settings are as before."""

import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from evidra.operators.lineage import CLEANUP, cut, drop


def folders(spark):
    return {p for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("*/rdd-*")}


def shuffles(spark):
    root = spark.conf.get("spark.local.dir")
    return {f for _, _, fs in os.walk(root) for f in fs if f.startswith("shuffle")}


def test_a_checkpoint_drops_its_shuffles_and_can_be_dropped(spark):
    before, was = shuffles(spark), folders(spark)
    a = cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n")))
    end = time.time() + 20
    while shuffles(spark) - before and time.time() < end:  # Spark deletes them in the background
        time.sleep(0.2)
    assert shuffles(spark) - before == set() and len(folders(spark) - was) == 1 and spark.conf.get(CLEANUP) == "false"
    b = cut(a.join(a.withColumnRenamed("n", "m"), "k").groupBy("m").agg(F.sum("n").alias("n")))
    drop(a)
    assert len(folders(spark) - was) == 1 and sorted(map(tuple, b.collect())) == [(142, 142), (143, 858)]
    drop(b)
    assert folders(spark) - was == set()
    drop(spark.range(3))  # not a checkpoint: nothing to delete


def test_checkpoint_keeps_how_rows_are_dealt_out(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    rows = cut(spark.range(50).repartition(5, "id").sortWithinPartitions("id"), dealt=True)
    plan = lambda df: df.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan(rows) and spark.conf.get("spark.sql.adaptive.enabled") == was
    assert rows.groupBy("id").count().count() == 50
