"""Registers and ledgers as tables: reads of feeds and instruments, counts, commits, appends, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronark.functions import text


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where("enabled").orderBy("name", "url")


def list_instruments(instruments: DataFrame) -> DataFrame:
    return instruments.orderBy("exchange", "symbol")


def find_instruments(instruments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Instruments by EXCHANGE:SYMBOL (``wanted``: ref), with a null spec and a reason where there is none."""
    asked = wanted.select("ref", text.split_symbol(F.col("ref")).alias("p")).select("ref", "p.exchange", "p.symbol", "p.reason")
    found = asked.join(instruments.withColumn("found", F.lit(True)), ["exchange", "symbol"], "left")
    reason = F.coalesce("reason", F.when(F.col("found").isNull(), "UNKNOWN_INSTRUMENT"))
    return found.select("ref", *(c for c in instruments.columns), reason.alias("reason"))


def object_counts(objects: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(type, objects): objects that weren't deleted, by type."""
    live = objects.where("deleted_at IS NULL")
    return (live if types is None else live.where(F.col("type").isin(*types))).groupBy("type").agg(F.count(F.lit(1)).alias("objects"))


def open_value_counts(objects: DataFrame, values: DataFrame) -> DataFrame:
    """(type, property, open_values): values that are open and not retracted, of objects that weren't deleted."""
    live = values.where("valid_to IS NULL AND retracted_at IS NULL").join(objects.where("deleted_at IS NULL").select("object_id", "type"), "object_id")
    return live.groupBy("type", "property").agg(F.count(F.lit(1)).alias("open_values"))


def missing_required(objects: DataFrame, values: DataFrame, required: DataFrame) -> DataFrame:
    """(object_id, type, property): required properties (type, property) that a live object has no open value of."""
    wanted = objects.where("deleted_at IS NULL").select("object_id", "type").join(F.broadcast(required), "type")
    have = values.where("valid_to IS NULL AND retracted_at IS NULL").select("object_id", "property").distinct()
    return wanted.join(have, ["object_id", "property"], "left_anti").select("object_id", "type", "property")


def open_commits(contexts: DataFrame, written_at: Column) -> DataFrame:
    """Commits of contexts (commit_id, actor, reason, declared_at): the time that the writer declares is the knowledge time, now
    if none is declared; the time it was really written is kept apart and never before it counts."""
    return contexts.withColumn("written_at", written_at).withColumn("recorded_at", F.coalesce("declared_at", "written_at")).withColumn("backdated", F.col("recorded_at") < F.col("written_at"))


def record(assertions: DataFrame, commits: DataFrame) -> DataFrame:
    """Assertions with the knowledge time of their commit; those of a commit that was never opened are left out."""
    return assertions.drop("recorded_at").join(commits.select("commit_id", "recorded_at"), "commit_id")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a ledger of Parquet files. There is no other write: what a ledger holds is never changed."""
    rows.write.mode("append").parquet(path)


def archive(rows: DataFrame, at: str, older_than: Column, path: str) -> DataFrame:
    """Writes the rows whose time ``at`` is before ``older_than`` to ``path``, by month, and returns the others. Open rows have no
    such time and stay."""
    month = F.date_format(at, "yyyy-MM").alias("month")
    rows.where(F.col(at) < older_than).select("*", month).repartition("month").write.mode("append").partitionBy("month").parquet(path)
    return rows.where(F.col(at).isNull() | (F.col(at) >= older_than))
