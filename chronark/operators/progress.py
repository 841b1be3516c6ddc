"""Progress of ingest jobs, folded from a log of attempts (key, at, ok, value, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import text


def _fold(attempts: DataFrame, key: list[str], value) -> DataFrame:
    later = W.partitionBy(*key).orderBy(F.desc("at"), F.desc("seq"))
    rows = attempts.withColumn("oks_after", F.sum(F.col("ok").cast("int")).over(later.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*key).agg(
        value.alias("progress"), F.max("at").alias("last_attempt"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"),
        F.count_if(~F.col("ok") & (F.col("oks_after") == 0)).alias("consecutive_errors"),
        F.max_by(F.when(~F.col("ok"), text.truncate(F.col("message"), 500)), F.struct("at", "seq")).alias("last_error"),
    )


def advance_watermarks(attempts: DataFrame, key: list[str]) -> DataFrame:
    """The greatest value of any success; errors since the last one."""
    return _fold(attempts, key, F.max(F.when(F.col("ok"), F.col("value"))))


def advance_cursors(attempts: DataFrame, key: list[str]) -> DataFrame:
    """The value of the last success."""
    return _fold(attempts, key, F.max_by(F.when(F.col("ok"), F.col("value")), F.when(F.col("ok"), F.struct("at", "seq"))))


def feed_health(attempts: DataFrame, key: list[str]) -> DataFrame:
    return advance_cursors(attempts, key).drop("progress")


def register_feeds(existing: DataFrame, feeds: DataFrame) -> DataFrame:
    """Upsert on url: name and enabled of the new row."""
    return existing.alias("o").join(feeds.alias("n"), "url", "full_outer").select("url", *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("name", "enabled")))
