"""What the operators of this subpackage share: lineage cuts, the train/held-out rule, components of a link table."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast, at most: 16 MB. More are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows and bytes of the batches that go to Python workers: a worker holds a batch of texts and what it makes of them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only for a local master, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches set to the sizes above."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lost executors lose none of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def only(rows: DataFrame, ids: DataFrame, how: str, on: str = "doc_id") -> DataFrame:
    """``rows`` semi- or anti-joined with ``ids``: these are broadcast if they were counted to be few, else both sides shuffle."""
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node that can be reached over ``links``. Nodes without links have no row.

    Alternating large-star and small-star steps: each is one aggregation over node ids and a join with its result, which is
    broadcast where the links were counted to be few. The link table never grows beyond its first size plus the number of
    nodes, and the number of steps grows with the logarithm of the longest path.
    """
    edges = cut(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    few = F.broadcast if edges.count() <= BROADCAST_IDS else lambda df: df
    seen = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: the smaller neighbours of a node, and the node itself, point to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(few(down), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(both.select("e.*").where("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
