"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Sorted by size, each goes to the shard with the least load. Groups of one size are
interchangeable: the driver gets a table of (size, number of groups), schedules size by size and returns how many groups of
each size a shard takes; which of them is decided by their rank within the size. Distinct sizes of a total of T bytes are
fewer than the square root of 2 T (14 million for 100 TB, if every size occurred), however many groups there are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.llm import _runtime

SHARDS = 16
#: Rows of a shard, or groups of one size, that one task numbers, about.
RUN = 20_000
#: A group of at least this share of the rows is joined by a broadcast: 1 / LARGE groups at most.
LARGE = 1 / 1000


def _dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard takes if one after another goes to the least loaded one."""
    shards = range(len(loads))
    if count <= 8 * len(loads):
        heap, taken = [(load, k) for k, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            taken[k] += 1
        return taken
    # shard k takes its j-th group at load k + j size: the ``count`` smallest of these, of equal ones those of smaller shards
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]
    top = min(loads) + size * (count + 1)
    level = bisect_left(range(top + 1), True, key=lambda x: sum(below(x)) > count) - 1
    taken = below(level)
    left = count - sum(taken)
    for k in shards:
        if left and loads[k] + taken[k] * size == level:
            taken[k] += 1
            left -= 1
    return taken


def schedule(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """Longest processing time first: of each (size, number of groups), largest first, how many groups go to each shard."""
    loads, out = [0] * shards, {}
    for size, count in sorted(classes, reverse=True):
        out[size] = _dealt(loads, size, count)
        loads = [load + size * k for load, k in zip(loads, out[size], strict=True)]
    return out


def _numbered(rows: DataFrame, by: str, order: list[str], parts: int) -> DataFrame:
    """``rows`` with ``place``, numbered from 0 without gaps within ``by``: in parts by hash, side by side."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = rows.groupBy(by, "part").count()
    before = before.withColumn("before", F.sum("count").over(W.partitionBy(by).orderBy("part")) - F.col("count")).select(by, "part", "before")
    place = F.row_number().over(W.partitionBy(by, "part").orderBy(*order))
    return rows.withColumn("place", place).join(before, [by, "part"]).withColumn("place", (F.col("before") + F.col("place") - 1).cast("long")).drop("part", "before")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row; ``law`` is 'bytes': shards have near equal sizes.

    ``size`` is the number of UTF-8 bytes of the text plus 1. Rows with equal texts get one shard; null counts as empty.
    ``slot`` numbers the rows of a shard from 0 without gaps. ``grown_shard`` is null, as this law moves rows when a shard is
    added. Null and repeated ids get a slot like any other; other columns are ignored; an empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1).cast("long")).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("grp"))
    rows = _runtime.cut(rows)
    spark = docs.sparkSession
    groups = _runtime.cut(rows.groupBy("grp").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")))
    classes = groups.groupBy("load").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n, n_groups = rows.count(), int(classes["n"].sum())
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    taken = schedule(list(zip(classes["load"].tolist(), classes["n"].tolist(), strict=True)), shards)
    # of a size, the groups up to the first bound in rank go to shard 0, those up to the next one to shard 1, and so on
    table = spark.createDataFrame(pd.DataFrame({"load": list(taken), "bounds": [np.cumsum(k).tolist() for k in taken.values()]}), "load long, bounds array<long>")
    ranked = _numbered(groups, "load", ["grp"], max(1, -(-n_groups // RUN)))
    placed = ranked.join(F.broadcast(table) if len(taken) <= _runtime.BROADCAST_IDS // shards else table, "load")
    placed = placed.select("grp", "n", F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("shard"))
    placed = _runtime.cut(placed)
    large = F.broadcast(placed.where(F.col("n") >= max(2, n * LARGE)).select("grp", F.col("shard").alias("of_large")))
    rows = rows.join(large, "grp", "left")
    rest = rows.where("of_large IS NULL").drop("of_large").join(placed.where(F.col("n") < max(2, n * LARGE)).select("grp", "shard"), "grp")
    rows = rows.where("of_large IS NOT NULL").withColumnRenamed("of_large", "shard").union(rest)
    rows = _numbered(rows, "shard", ["doc_id", "grp"], max(1, -(-n // (shards * RUN)))).withColumnRenamed("place", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
