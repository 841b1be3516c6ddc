"""The two time axes: when a fact holds (valid) and when it was known (recorded, retracted). Open ends are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_at(t: Column, strict_knowledge: bool = False) -> Column:
    """Rows of values or links that were known at ``t`` to hold at ``t``.

    A row's closing carries no knowledge time of its own, so a late update hides both rows between its start and its
    recording; ``strict_knowledge`` keeps the old row visible until the closing was recorded (column closed_recorded_at).
    """
    ends = F.col("valid_to").isNull() | (t < F.col("valid_to"))
    if strict_knowledge:
        ends = ends | (F.col("closed_recorded_at") > t)
    return (F.col("valid_from") <= t) & ends & (F.col("recorded_at") <= t) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > t))


def exists_at(t: Column) -> Column:
    return (F.col("exists_from") <= t) & (F.col("recorded_at") <= t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t))


def is_current() -> Column:
    """Open and not retracted; whether it has begun isn't asked."""
    return F.col("valid_to").isNull() & F.col("retracted_at").isNull()


def valid_at(t: Column) -> Column:
    """By valid time alone, whenever it became known."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))) & F.col("retracted_at").isNull()


def as_of_many(values: DataFrame, instants: DataFrame, key: list[str]) -> DataFrame:
    """Values known at each of many instants: (at, key..., value columns), instants being (key..., at).

    A key's time from its first instant to its last is cut into as many slices as it has instants. Rows are dealt to the slices they span
    and met with the instants of that slice: an equi-join with an exact filter behind it instead of a join on inequalities. So a
    row is repeated about as often as it has instants, whatever time it spans.
    """
    spans = instants.groupBy(*key).agg(F.max("at").alias("last"), F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    width = F.floor((micros(F.col("last")) - micros(F.col("least"))) / F.col("n")) + 1
    slice_ = lambda c: F.floor((micros(c) - micros(F.col("least"))) / width).cast("long")
    rows = values.join(spans, key).where(F.col("valid_from") <= F.col("last"))
    start = F.greatest(F.col("valid_from"), F.col("recorded_at"), F.col("least"))
    end = F.least(F.coalesce("valid_to", "last"), F.coalesce("retracted_at", "last"), F.col("last"))
    rows = rows.where(start <= end).withColumn("slice", F.explode(F.sequence(slice_(start), slice_(end)))).drop("last", "least", "n")
    met = rows.join(instants.join(spans, key).withColumn("slice", slice_(F.col("at"))).drop("last", "least", "n"), [*key, "slice"])
    return met.where(known_at(F.col("at"))).drop("slice")


def detect_overlaps(rows: DataFrame, key: list[str], then: str | None = None) -> DataFrame:
    """Rows that are not retracted and begin before an earlier one of their key has ended.

    Of rows that begin and were recorded at the same instants the one with the smaller ``then`` (``commit_id`` if there is one) is
    earlier, next the one that ends first: the same rows are found however the table is dealt.
    """
    far = F.lit("9999-12-31").cast("timestamp")
    then = then or ("commit_id" if "commit_id" in rows.columns else None)
    order = ["valid_from", "recorded_at", *([then] if then else []), F.coalesce("valid_to", far)]
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    held = rows.where("retracted_at IS NULL").withColumn("held_until", F.max(F.coalesce("valid_to", far)).over(before))
    return held.where("valid_from < held_until")
