"""How well stated confidences and pieces of evidence turned out, and similar objects by embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calibration(rows: DataFrame) -> DataFrame:
    """(bucket, n, mean_confidence, hit_rate, brier, log_loss, bias) of (confidence, hit 0/1) in ten buckets."""
    p = F.least(F.greatest(F.col("confidence"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("hit") * F.log(p) + (1 - F.col("hit")) * F.log(1 - p))
    bucket = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    out = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("hit_rate"), F.avg((F.col("confidence") - F.col("hit")) ** 2).alias("brier"), F.avg(loss).alias("log_loss"))
    return out.withColumn("bias", F.col("mean_confidence") - F.col("hit_rate"))


def evidence_effectiveness(rows: DataFrame, least: int = 25) -> DataFrame:
    """(kind, regime, n, hit_rate, lift) over the cube of both, of groups with enough rows; null stands for all."""
    out = rows.cube("kind", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"), F.grouping_id().alias("g"))
    base = out.where("g = 3").select(F.col("hit_rate").alias("base"))
    return out.where(F.col("n") >= least).join(F.broadcast(base)).select("kind", "regime", "n", "hit_rate", (F.col("hit_rate") / F.nullif("base", F.lit(0.0))).alias("lift"))


def verdict(pnl: Column, thesis_held: Column) -> Column:
    return F.when((pnl > 0) & thesis_held, "CORRECT").when(pnl > 0, "LUCKY").when(thesis_held, "UNLUCKY").otherwise("WRONG")


def similar_objects(vectors: DataFrame, queries: DataFrame, k: int, chunk: int = 65_536) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest by cosine of each query among all vectors but its own; ties by smaller id.

    Vectors are dealt into chunks, each of about ``chunk`` rows, and every query goes to every chunk: a task holds one chunk while the
    queries stream past it, and each leaves its k best there. A larger chunk sends fewer copies of the queries and needs more memory, 0.5
    KB a row of 64 numbers. Rows without an id, a vector, or with a number that isn't finite take no part; queries of one id are one.
    """

    def whole(df: DataFrame) -> DataFrame:
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~odd).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    vectors, queries = whole(vectors), whole(queries).dropDuplicates(["vec_id"])
    chunks = max(1, -(-vectors.count() // chunk))
    # by place, not by content: rows that repeat are spread too
    dealt = vectors.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))).withColumn("asked", F.lit(False))
    every = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).withColumn("asked", F.lit(True))

    def scaled(rows: pd.Series) -> np.ndarray:
        x = np.stack(rows.to_numpy())
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def best(ids: np.ndarray, x: np.ndarray, asked: pd.DataFrame) -> pd.DataFrame:
        of = asked["vec_id"].to_numpy()
        s = scaled(asked["embedding"]) @ x.T
        s[of[:, None] == ids[None, :]] = -np.inf
        least = np.partition(s, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        found = pd.DataFrame({"query_id": of[i], "vec_id": ids[j], "similarity": s[i, j]})
        return found.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, x = None, [], []
        for pdf in batches:
            for c, rows in pdf.groupby("chunk"):
                if c != at:
                    at, ids, x = c, [], []
                held, asked = rows[~rows["asked"]], rows[rows["asked"]]
                if len(held):
                    ids.append(held["vec_id"].to_numpy())
                    x.append(scaled(held["embedding"]))
                if len(asked) and ids:
                    ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    for n in range(0, len(asked), 64):
                        yield best(ids[0], x[0], asked.iloc[n : n + 64])

    # a chunk's vectors come before the queries
    rows = dealt.unionByName(every).repartition("chunk").sortWithinPartitions("chunk", "asked")
    found = rows.mapInPandas(nearest, "query_id long, vec_id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
