"""Macro series whose figures are revised: vintages as half-open ranges of what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import text

OPEN = "9999-12-31"


def vintage_ranges(observations: DataFrame) -> DataFrame:
    """(series, period, value, vintage_from, vintage_to, is_revision) from raw (series, date, value, realtime_start, realtime_end).

    A vintage ends the day after its last day; the open one has no end. Blank and unreadable values are left out.
    """
    rows = observations.withColumn("v", F.col("value").try_cast("decimal(38,12)")).where("v IS NOT NULL")
    nth = F.row_number().over(W.partitionBy("series", "date").orderBy("realtime_start", "realtime_end"))
    end = F.when(F.col("realtime_end") < F.lit(OPEN).cast("date"), F.date_add("realtime_end", 1))
    return rows.select("series", F.col("date").alias("period"), F.col("v").alias("value"), F.col("realtime_start").alias("vintage_from"), end.alias("vintage_to"), (nth > 1).alias("is_revision"))


def write_observations(points: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Assertions for the points whose (object, valid_from) has no value yet; recorded when the vintage began. Label and period
    stay open, value and revision end with the vintage."""
    rows = points.withColumn("object_id", text.external_id("FRED", F.col("series").cast("string"), F.col("period").cast("string")))
    if existing is not None:
        have = existing.where("retracted_at IS NULL AND property = 'value'").select("object_id", F.col("valid_from").cast("date").alias("vintage_from"))
        rows = rows.join(have.distinct(), ["object_id", "vintage_from"], "left_anti")
    start, end = F.col("vintage_from").cast("timestamp"), F.col("vintage_to").cast("timestamp")
    one = lambda name, value, until: F.struct(F.lit(name).alias("property"), value.cast("string").alias("value"), until.alias("until"))
    none = F.lit(None).cast("timestamp")
    each = F.explode(F.array(one("label", F.concat_ws(" ", "series", "period"), none), one("period", F.col("period"), none), one("value", F.col("value"), end), one("revision", F.col("is_revision"), end))).alias("p")
    rows = rows.select("object_id", each, start.alias("valid_from"), F.xxhash64("object_id", "vintage_from").alias("seq"))
    return rows.select("object_id", "p.property", F.lit(0).alias("ordinal"), "p.value", F.lit("set").alias("op"), "valid_from", F.col("p.until").alias("valid_to"), F.col("valid_from").alias("recorded_at"), "seq")


def observation_links(points: DataFrame) -> DataFrame:
    """OBSERVATION_OF links of each point's observation to its series' indicator: many to one, from the first vintage on."""
    rows = points.groupBy("series", "period").agg(F.min("vintage_from").cast("timestamp").alias("valid_from"))
    rows = rows.withColumn("from_id", text.external_id("FRED", F.col("series").cast("string"), F.col("period").cast("string"))).withColumn("to_id", text.external_id("FRED", F.col("series").cast("string")))
    return rows.select(F.lit("OBSERVATION_OF").alias("link_type"), "from_id", "to_id", F.lit(None).cast("double").alias("weight"), "valid_from", F.col("valid_from").alias("recorded_at"), F.xxhash64("from_id").alias("seq"))


def indicator_assertions(meta: DataFrame, at: Column) -> DataFrame:
    """Title and units of each series' indicator from (series, title, units), valid from ``at``."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in ("title", "units")))).alias("p")
    rows = meta.select(text.external_id("FRED", F.col("series").cast("string")).alias("object_id"), each, F.xxhash64("series").alias("seq"))
    return rows.select("object_id", "p.property", F.lit(0).alias("ordinal"), "p.value", F.lit("set").alias("op"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), at.alias("recorded_at"), "seq").where("value <> ''")


def known_at(points: DataFrame, t: Column) -> DataFrame:
    """The value of each period that was known at ``t``."""
    return points.where((F.col("vintage_from") <= t) & (F.col("vintage_to").isNull() | (t < F.col("vintage_to")))).select("series", "period", "value", "is_revision")


def sync_series(observations: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(assertions to write, cursor of each series: its latest period)."""
    points = vintage_ranges(observations)
    return write_observations(points, existing), points.groupBy("series").agg(F.max("period").alias("cursor"))


