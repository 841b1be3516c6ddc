"""Connected components of a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; only a local master may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached over ``pairs``. Nodes without pairs have no row.

    Each round hangs what a node is linked with on the smallest of it: larger neighbours first, then the smaller ones and the
    node. It ends when nothing changes, after a number of rounds that grows with the logarithm of the longest path.
    """
    links = cut(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    before = None
    while True:
        around = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        top = around.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("top"))
        hung = around.where("lo > hi").join(top, "hi").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        low = hung.groupBy("hi").agg(F.min("lo").alias("top"))
        moved = hung.join(low, "hi").select(F.col("lo").alias("hi"), F.col("top").alias("lo")).where("hi > lo")
        links = cut(moved.unionByName(low.select("hi", F.col("top").alias("lo"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select("lo", "lo")).distinct()
