"""OHLCV bars: idempotent upsert, complete roll-ups, gaps, freshness and readers that never look ahead.

Bars have (instrument_id, timeframe, open_time, close_time, open, high, low, close, volume, quote_volume, trade_count,
taker_buy_base, is_final). All operators work on all instruments in one plan, hash-partitioned by instrument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.functions import timeframe as tf

KEY = ["instrument_id", "timeframe", "open_time"]
MEASURES = ["close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_base"]


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """One bar per key: measures of the newest arrival, final once any version was final. ``existing`` counts as oldest."""
    old = existing.select(*KEY, *MEASURES, "is_final", F.lit(None).cast("long").alias(order))
    both = old.unionByName(incoming.select(*KEY, *MEASURES, "is_final", F.col(order).cast("long").alias(order)))
    place = F.struct(F.coalesce(F.col(order), F.lit(-(2**62))).alias("o"), *(F.col(c) for c in MEASURES))
    newest = both.groupBy(*KEY).agg(F.max(place).alias("m"), F.max("is_final").alias("is_final"))
    return newest.select(*KEY, *(F.col(f"m.{c}").alias(c) for c in MEASURES), "is_final")


def rollup(bars: DataFrame, base: str, targets: list[str], until: Column | None = None, since: Column | None = None) -> DataFrame:
    """Bars of longer timeframes from final base bars: only buckets with every base bar, and that end by ``until``.

    All targets come from one scan and one shuffle: each base bar is dealt to its bucket of each target.
    """
    rows = bars.where((F.col("timeframe") == base) & F.col("is_final"))
    if since is not None:
        rows = rows.where(F.col("open_time") >= since)
    wanted = F.array(*(F.struct(F.lit(t).alias("timeframe"), F.lit(tf.SECONDS[t]).cast("long").alias("step"), F.lit(tf.base_bars(t, base)).cast("long").alias("expected")) for t in targets))
    rows = rows.drop("timeframe").withColumn("t", F.explode(wanted)).select("*", "t.*").drop("t")
    rows = rows.withColumn("bucket", tf.floor_time(F.col("open_time"), F.col("step")))
    out = rows.groupBy("instrument_id", "timeframe", "bucket", "step", "expected").agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"), F.sum("quote_volume").alias("quote_volume"), F.sum("trade_count").alias("trade_count"), F.sum("taker_buy_base").alias("taker_buy_base"), F.count(F.lit(1)).alias("n"),
    ).where("n = expected")
    if until is not None:
        out = out.where(tf.next_open(F.col("bucket"), F.col("step")) <= until)
    return out.select("instrument_id", "timeframe", F.col("bucket").alias("open_time"), tf.close_time(F.col("bucket"), F.col("step")).alias("close_time"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_base", F.lit(True).alias("is_final"))


def find_gaps(bars: DataFrame, timeframe: str, since: Column, until: Column) -> DataFrame:
    """(instrument_id, gap_from, gap_to, missing): runs of expected opens in [since, until) without a final bar.

    Each final bar looks at the next one's open, so the work follows the bars there are, not the ones expected.
    """
    step = tf.SECONDS[timeframe]
    lo, hi = F.unix_seconds(tf.floor_time(since, step)), F.unix_seconds(tf.floor_time(until, step))
    rows = bars.where((F.col("timeframe") == timeframe))
    at = F.unix_seconds("open_time")
    opens = rows.where(F.col("is_final") & (at >= lo) & (at < hi)).select("instrument_id", at.alias("at")).distinct()
    # every instrument has the edges of the range as if they were bars
    edges = rows.select("instrument_id").distinct().select("instrument_id", F.explode(F.array(lo - step, hi)).alias("at"))
    nxt = F.lead("at").over(W.partitionBy("instrument_id").orderBy("at"))
    gaps = opens.union(edges).withColumn("next", nxt).where(F.col("next") - F.col("at") > step)
    return gaps.select("instrument_id", F.timestamp_seconds(F.col("at") + step).alias("gap_from"), F.timestamp_seconds("next").alias("gap_to"), ((F.col("next") - F.col("at")) / step - 1).cast("long").alias("missing"))


def last_final_open(bars: DataFrame) -> DataFrame:
    return bars.where("is_final").groupBy("instrument_id", "timeframe").agg(F.max("open_time").alias("last_open"))


def freshness(instruments: DataFrame, bars: DataFrame, timeframe: str, now: Column, tolerance_s: int = 300) -> DataFrame:
    """(instrument_id, last_open, staleness_s, is_stale); without a bar: 36 500 days and stale."""
    step = tf.SECONDS[timeframe]
    last = last_final_open(bars.where(F.col("timeframe") == timeframe)).drop("timeframe")
    late = F.greatest(F.lit(0).cast("long"), F.unix_seconds(tf.last_closed_open(now, step)) - F.unix_seconds("last_open"))
    late = F.when(F.col("last_open").isNull(), F.lit(36_500 * 86_400).cast("long")).otherwise(late)
    return instruments.select("instrument_id").distinct().join(last, "instrument_id", "left").select("instrument_id", "last_open", late.alias("staleness_s"), (late > tolerance_s).alias("is_stale"))


def last_final_bars(bars: DataFrame, timeframe: str, as_of: Column, n: int) -> DataFrame:
    """The ``n`` latest final bars of each instrument that are closed before ``as_of``."""
    rows = bars.where((F.col("timeframe") == timeframe) & F.col("is_final") & (F.col("close_time") < as_of))
    place = F.row_number().over(W.partitionBy("instrument_id").orderBy(F.desc("open_time")))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def final_bars(bars: DataFrame, timeframe: str, since: Column, until: Column) -> DataFrame:
    return bars.where((F.col("timeframe") == timeframe) & F.col("is_final") & (F.col("open_time") >= since) & (F.col("open_time") < until)).orderBy("instrument_id", "open_time")


def final_bars_at(bars: DataFrame, keys: DataFrame) -> DataFrame:
    """Final bars of exact (instrument_id, timeframe, open_time) keys."""
    return bars.where("is_final").join(keys.select(*KEY).distinct(), KEY, "left_semi")


def last_bars_before(instants: DataFrame, bars: DataFrame, timeframe: str) -> DataFrame:
    """As-of join: for each (instrument_id, at) the open time and close of the last final bar closed before ``at``.

    Bars and instants are merged in time order per instrument and day; each day starts with the last bar of the days before,
    so a long series is spread over tasks and no inequality join is needed.
    """
    b = bars.where((F.col("timeframe") == timeframe) & F.col("is_final")).select("instrument_id", F.col("close_time").alias("at"), F.struct("open_time", "close").alias("bar"), F.lit(1).alias("kind"))
    i = instants.select("instrument_id", "at", F.lit(None).cast(b.schema["bar"].dataType).alias("bar"), F.lit(0).alias("kind"))
    every = b.unionByName(i).withColumn("day", F.to_date("at"))
    last = every.groupBy("instrument_id", "day").agg(F.max_by("bar", F.when(F.col("kind") == 1, F.col("at"))).alias("of_day"))
    before = last.withColumn("carried", F.last("of_day", True).over(W.partitionBy("instrument_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1))).drop("of_day")
    # instants come before bars that close at the same moment: closed strictly before
    within = F.last("bar", True).over(W.partitionBy("instrument_id", "day").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = every.withColumn("seen", within).where("kind = 0").join(before, ["instrument_id", "day"])
    found = F.coalesce("seen", "carried")
    return out.select("instrument_id", "at", found["open_time"].alias("open_time"), found["close"].alias("close"))


def missing_in_source(landed: DataFrame, gaps: DataFrame, timeframe: str) -> DataFrame:
    """Landed bars whose open lies inside a gap: what a refill upserts. No gaps, no bars.

    Gaps are dealt to the days they touch, so the range test runs within (instrument, day).
    """
    days = gaps.select("instrument_id", "gap_from", "gap_to", F.explode(F.expr("sequence(to_date(gap_from), to_date(gap_to), interval 1 day)")).alias("day"))
    rows = landed.where(F.col("timeframe") == timeframe).withColumn("day", F.to_date("open_time"))
    hit = rows.join(days, ["instrument_id", "day"]).where("open_time >= gap_from AND open_time < gap_to")
    return hit.drop("day", "gap_from", "gap_to").dropDuplicates(KEY)


def write_monthly(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet in folders by timeframe and month; ``overwrite`` replaces only the months that ``bars`` holds."""
    rows = bars.withColumn("month", F.date_format("open_time", "yyyy-MM")).repartition("timeframe", "month").sortWithinPartitions("instrument_id", "open_time")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "month").parquet(path)


def read_monthly(bars: DataFrame, since: Column, until: Column) -> DataFrame:
    """Bars of [since, until) with the month predicate that prunes folders."""
    months = (F.col("month") >= F.date_format(since, "yyyy-MM")) & (F.col("month") <= F.date_format(until, "yyyy-MM"))
    return bars.where(months & (F.col("open_time") >= since) & (F.col("open_time") < until))


def register_instruments(existing: DataFrame, specs: DataFrame) -> DataFrame:
    """Upsert on (exchange, symbol): trading rules and status of the new spec, base and quote asset of the first."""
    old, new = existing.alias("o"), specs.alias("n")
    key = ["exchange", "symbol"]
    kept, replaced = ["base_asset", "quote_asset"], ["status", "tick_size", "step_size", "min_notional"]
    joined = old.join(new, key, "full_outer")
    return joined.select(*key, *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in replaced))


def instrument_assertions(specs: DataFrame, at: Column) -> DataFrame:
    """Property assertions that mirror instruments as objects EXCHANGE:SYMBOL: assets, status and trading rules, valid from ``at``."""
    names = ("base_asset", "quote_asset", "status", "tick_size", "step_size")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.col(n).cast("string").alias("value")) for n in names))).alias("p")
    rows = specs.select(F.concat_ws(":", "exchange", "symbol").alias("object_id"), each)
    return rows.select("object_id", "p.property", F.lit(0).alias("ordinal"), "p.value", F.lit("set").alias("op"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), at.alias("recorded_at"), F.xxhash64("object_id").alias("seq")).where("value IS NOT NULL")


def select_configured(instruments: DataFrame, configured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruments whose symbol is configured, configured symbols not found), case aside."""
    names = configured.select(F.upper("symbol").alias("wanted")).distinct()
    have = instruments.withColumn("wanted", F.upper("symbol"))
    return have.join(names, "wanted", "left_semi").drop("wanted"), names.join(have.select("wanted").distinct(), "wanted", "left_anti").withColumnRenamed("wanted", "symbol")
