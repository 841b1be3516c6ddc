"""Queries over bars: roll-up, gaps, freshness, readers, statistics, indicators, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.functions import timeframe as tf
from chronark.operators import bars as B
from chronark.operators import series, signals
from chronark.plans import adapters as A
from chronark.plans.registry import query


def _bars_sql(step: int) -> str:
    return f"""
e AS (SELECT instrument_id, event_id, user_id, CAST(value AS DECIMAL(18,4)) AS v, CAST(floor(epoch(ts) / {step}) AS BIGINT) * {step} AS o
  FROM (SELECT *, unnest(['ALL', event_type]) AS instrument_id FROM events)),
b AS (SELECT instrument_id, o, arg_min(v, event_id) AS open, max(v) AS high, min(v) AS low, arg_max(v, event_id) AS close, count(*) AS volume,
  sum(v) AS quote_volume, count(*) AS trade_count, sum(CASE WHEN user_id % 2 = 0 THEN v ELSE 0 END) AS taker, (o // {step}) % 37 <> 5 AS is_final
  FROM e GROUP BY 1, 2)"""


B15, B1H = _bars_sql(900), _bars_sql(3600)
NOW = "timestamp '2024-01-20 10:07:00'"
SINCE, UNTIL = "timestamp '2024-01-05 00:20:00'", "timestamp '2024-01-25 00:00:00'"


def _epoch(c: str) -> F.Column:
    return F.unix_seconds(c).alias(c)


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns))


MEASURES = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base")
_MEASURES_SQL = "CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume, CAST(quote_volume AS DOUBLE) AS quote_volume"


@query(f"""
WITH {B15}, r AS (
  SELECT instrument_id, t.tf AS timeframe, (o // t.step) * t.step AS open_time, t.step AS step, t.n AS n,
    arg_min(open, o) AS open, max(high) AS high, min(low) AS low, arg_max(close, o) AS close, sum(volume) AS volume, sum(quote_volume) AS quote_volume,
    sum(trade_count) AS trade_count, sum(taker) AS taker, count(*) AS c
  FROM b, (VALUES ('1h', 3600, 4), ('4h', 14400, 16), ('1d', 86400, 96)) t(tf, step, n) WHERE is_final GROUP BY ALL)
SELECT instrument_id, timeframe, open_time, {_MEASURES_SQL}, CAST(trade_count AS BIGINT) AS trade_count, CAST(taker AS DOUBLE) AS taker_buy_base
FROM r WHERE c = n AND open_time + step <= epoch({NOW})
""")
def rollup_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.rollup(A.bars(spark, sf_dir, "15m", 900), "15m", ["1h", "4h", "1d"], until=F.expr(NOW))
    return _doubles(out.select("instrument_id", "timeframe", _epoch("open_time"), *MEASURES, F.col("trade_count").cast("long").alias("trade_count")), *MEASURES)


@query(f"""
WITH {B15}, lim AS (SELECT CAST(floor(epoch({SINCE}) / 900) AS BIGINT) * 900 AS lo, CAST(floor(epoch({UNTIL}) / 900) AS BIGINT) * 900 AS hi),
expected AS (SELECT i.instrument_id, unnest(range(lo, hi, 900)) AS m FROM (SELECT DISTINCT instrument_id FROM b) i, lim),
missing AS (SELECT x.* FROM expected x LEFT JOIN b ON b.instrument_id = x.instrument_id AND b.o = x.m AND is_final WHERE b.o IS NULL),
isle AS (SELECT *, m // 900 - row_number() OVER (PARTITION BY instrument_id ORDER BY m) AS k FROM missing)
SELECT instrument_id, min(m) AS gap_from, max(m) + 900 AS gap_to, count(*) AS missing FROM isle GROUP BY instrument_id, k
""")
def find_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.find_gaps(A.bars(spark, sf_dir, "15m", 900), "15m", F.expr(SINCE), F.expr(UNTIL))
    return out.select("instrument_id", _epoch("gap_from"), _epoch("gap_to"), "missing")


@query(f"""
WITH {B15}, l AS (SELECT instrument_id, max(o) AS last_open FROM b WHERE is_final AND o < epoch({NOW}) - 86400 * (CASE WHEN instrument_id = 'ALL' THEN 0 ELSE 1 END) GROUP BY 1),
f AS (SELECT *, greatest(0, CAST(floor(epoch({NOW}) / 900) AS BIGINT) * 900 - 900 - last_open) AS staleness_s FROM l)
SELECT *, staleness_s > 300 AS is_stale FROM f
""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but ALL are cut off a day before."""
    bars = A.bars(spark, sf_dir, "15m", 900)
    cut = F.unix_seconds(F.expr(NOW)) - 86_400 * F.when(F.col("instrument_id") == "ALL", 0).otherwise(1)
    out = B.freshness(bars, bars.where(F.unix_seconds("open_time") < cut), "15m", F.expr(NOW))
    return out.select("instrument_id", _epoch("last_open"), "staleness_s", "is_stale")


@query(f"""
WITH {B15}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY o DESC) AS k FROM b WHERE is_final AND o + 900 <= epoch({NOW}))
SELECT instrument_id, o AS open_time, {_MEASURES_SQL} FROM r WHERE k <= 50
""")
def last_final_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.last_final_bars(A.bars(spark, sf_dir, "15m", 900), "15m", F.expr(NOW), 50)
    return _doubles(out.select("instrument_id", _epoch("open_time"), *MEASURES[:-1]), *MEASURES)


@query(f"WITH {B15} SELECT instrument_id, o AS open_time, {_MEASURES_SQL} FROM b WHERE is_final AND o >= epoch({SINCE}) AND o < epoch({UNTIL})")
def final_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.final_bars(A.bars(spark, sf_dir, "15m", 900), "15m", F.expr(SINCE), F.expr(UNTIL))
    return _doubles(out.select("instrument_id", _epoch("open_time"), *MEASURES[:-1]), *MEASURES)


@query(f"WITH {B15} SELECT instrument_id, o AS open_time, {_MEASURES_SQL} FROM b WHERE is_final AND o % 7200 = 0")
def final_bar_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = A.bars(spark, sf_dir, "15m", 900)
    out = B.final_bars_at(bars, bars.where(F.unix_seconds("open_time") % 7200 == 0).select(*B.KEY))
    return _doubles(out.select("instrument_id", _epoch("open_time"), *MEASURES[:-1]), *MEASURES)


@query(f"WITH {B15} SELECT instrument_id, max(o) AS last_open FROM b WHERE is_final GROUP BY 1")
def last_final_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_final_open(A.bars(spark, sf_dir, "15m", 900)).select("instrument_id", _epoch("last_open"))


@query(f"""
WITH {B15}, i AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ALL' ELSE event_type END AS instrument_id, ts AS moment FROM events)
SELECT i.event_id, i.instrument_id, b.o AS open_time, CAST(b.close AS DOUBLE) AS close
FROM i ASOF LEFT JOIN (SELECT instrument_id, o, close, to_timestamp(o + 900)::TIMESTAMP - INTERVAL 1 MILLISECOND AS c FROM b WHERE is_final) b ON i.instrument_id = b.instrument_id AND i.moment > b.c
""")
def last_bar_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    at = e.select("event_id", F.when(F.col("event_id") % 2 == 0, "ALL").otherwise(F.col("event_type")).alias("instrument_id"), F.col("ts").cast("timestamp").alias("at"))
    out = B.last_bars_before(at.select("instrument_id", "at"), A.bars(spark, sf_dir, "15m", 900), "15m").distinct()
    return at.join(out, ["instrument_id", "at"]).select("event_id", "instrument_id", _epoch("open_time"), F.col("close").cast("double").alias("close"))


@query(f"""
WITH {B15}, x AS (SELECT instrument_id, o, close, is_final, -1 AS seq FROM b UNION ALL SELECT instrument_id, o, close + 1, o % 1800 = 0, o FROM b WHERE o % 2700 = 0
  UNION ALL SELECT instrument_id, o, close + 2, false, o - 1 FROM b WHERE o % 5400 = 0)
SELECT instrument_id, o AS open_time, CAST(arg_max(close, seq) AS DOUBLE) AS close, bool_or(is_final) AS is_final FROM x GROUP BY 1, 2
""")
def upsert_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bars(spark, sf_dir, "15m", 900).withColumn("o", F.unix_seconds("open_time"))
    one = b.where("o % 2700 = 0").withColumn("close", (F.col("close") + 1).cast("decimal(24,12)")).withColumn("is_final", F.expr("o % 1800 = 0")).withColumn("seq", F.col("o"))
    two = b.where("o % 5400 = 0").withColumn("close", (F.col("close") + 2).cast("decimal(24,12)")).withColumn("is_final", F.lit(False)).withColumn("seq", F.col("o") - 1)
    return B.upsert(b, one.unionByName(two)).select("instrument_id", _epoch("open_time"), F.col("close").cast("double").alias("close"), "is_final")


@query(f"""
WITH {B15} SELECT instrument_id, o AS open_time, CAST(high - low AS DOUBLE) AS bar_range, close > open AS is_bullish, round(CAST(quote_volume AS DOUBLE) / volume, 6) AS vwap_approx,
  (o // 14400) * 14400 AS bucket, (o // 14400) * 14400 + 14400 AS next_open, ((o // 14400) * 14400 + 14400) * 1000 - 1 AS close_ms, (o // 14400) * 14400 - 14400 AS last_closed FROM b
""")
def bar_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tf.bar_shape()
    o = tf.floor_time(F.col("open_time"), 14400)
    return A.bars(spark, sf_dir, "15m", 900).select(
        "instrument_id", _epoch("open_time"), s["bar_range"].cast("double").alias("bar_range"), s["is_bullish"].alias("is_bullish"), F.round(s["vwap_approx"], 6).alias("vwap_approx"),
        F.unix_seconds(o).alias("bucket"), F.unix_seconds(tf.next_open(o, 14400)).alias("next_open"), F.unix_millis(tf.close_time(o, 14400)).alias("close_ms"), F.unix_seconds(tf.last_closed_open(F.col("open_time"), 14400)).alias("last_closed"),
    )


@query(f"""
WITH {B15}, g AS (SELECT instrument_id, o FROM b WHERE NOT is_final)
SELECT b.instrument_id, b.o AS open_time FROM b JOIN g ON g.instrument_id = b.instrument_id AND g.o = b.o WHERE b.o >= epoch({SINCE}) - 1200 AND b.o < epoch({UNTIL})
""")
def refill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the landed bars can refill of the gaps that the final ones have."""
    bars = A.bars(spark, sf_dir, "15m", 900)
    gaps = B.find_gaps(bars, "15m", F.expr(SINCE), F.expr(UNTIL))
    return B.missing_in_source(bars, gaps, "15m").select("instrument_id", _epoch("open_time"))


@query(f"""
WITH {B1H}, x AS (SELECT instrument_id, o, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM b WHERE is_final),
y AS (SELECT *, ln(close / lag(close) OVER w) AS r, row_number() OVER w AS n,
  100 * (close / lag(close, 1) OVER w - 1) AS return1, 100 * (close / lag(close, 24) OVER w - 1) AS return24, 100 * (close / lag(close, 168) OVER w - 1) AS return168,
  avg(volume) OVER p AS mv, stddev_samp(volume) OVER p AS sv, list(close) OVER h AS closes
  FROM x WINDOW w AS (PARTITION BY instrument_id ORDER BY o), p AS (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
  h AS (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 719 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN n > 24 THEN stddev_samp(r) OVER (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) * sqrt(8760) * 100 END AS vol,
  CASE WHEN n > 96 THEN stddev_samp(r) OVER (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) * sqrt(8760) * 100 END AS slow FROM y)
SELECT instrument_id, o AS open_time, round(return1 + 1e-7, 4) AS return1, round(return24 + 1e-7, 4) AS return24, round(return168 + 1e-7, 4) AS return168, round(vol + 1e-7, 4) AS realized_vol, round(slow + 1e-7, 4) AS realized_vol_slow,
  round(CASE WHEN n > 24 AND sv <> 0 THEN (volume - mv) / sv END + 1e-7, 4) AS volume_z,
  round(100 * (len(list_filter(closes, lambda c: c < close)) + len(list_filter(closes, lambda c: c = close)) / 2) / len(closes) + 1e-7, 4) AS price_percentile
FROM v
""")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.statistics(A.bars(spark, sf_dir, "1h", 3600), 3600)
    names = ["return1", "return24", "return168", "realized_vol", "realized_vol_slow", "volume_z", "price_percentile"]
    return out.select("instrument_id", _epoch("open_time"), *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in names))


_RANK = "CASE WHEN len({l}) >= 30 AND {v} IS NOT NULL THEN round(100 * (len(list_filter({l}, lambda c: c < {v})) + len(list_filter({l}, lambda c: c = {v})) / 2) / len({l}) + 1e-7, 4) END"


@query(f"""
WITH {B1H}, x AS (SELECT instrument_id, o, CAST(close AS DOUBLE) AS close FROM b WHERE is_final),
y AS (SELECT *, ln(close / lag(close) OVER w) AS r, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY instrument_id ORDER BY o)),
v AS (SELECT *, CASE WHEN n > 24 THEN stddev_samp(r) OVER (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS fast,
  CASE WHEN n > 96 THEN stddev_samp(r) OVER (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) END AS slow FROM y),
l AS (SELECT *, list_filter(list(fast) OVER (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 695 PRECEDING AND CURRENT ROW), lambda c: c IS NOT NULL) AS fasts,
  list_filter(list(slow) OVER (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 623 PRECEDING AND CURRENT ROW), lambda c: c IS NOT NULL) AS slows FROM v)
SELECT instrument_id, o AS open_time, {_RANK.format(l='fasts', v='fast')} AS vol_percentile, {_RANK.format(l='slows', v='slow')} AS vol_percentile_slow FROM l
""")
def vol_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.statistics(A.bars(spark, sf_dir, "1h", 3600), 3600)
    return out.select("instrument_id", _epoch("open_time"), *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("vol_percentile", "vol_percentile_slow")))


_EMA = "list_reduce(list_prepend(closes[1], closes), lambda s, x: s + (x - s) * {a})"


@query(f"""
WITH {B1H}, x AS (SELECT instrument_id, o, CAST(close AS DOUBLE) AS close, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(volume AS DOUBLE) AS volume FROM b WHERE is_final),
d AS (SELECT *, close - lag(close) OVER w AS d, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM x WINDOW w AS (PARTITION BY instrument_id ORDER BY o)),
y AS (SELECT *, list(close) OVER h AS closes, list(d) OVER h AS ds, list(tr) OVER h AS trs, first_value(high - low) OVER h AS tr0, count(*) OVER h AS n, count(*) OVER k AS m,
  avg(close) OVER k AS mid, stddev_pop(close) OVER k AS sd, sum((high + low + close) / 3 * volume) OVER k / sum(volume) OVER k AS vw
  FROM d WINDOW h AS (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 799 PRECEDING AND CURRENT ROW), k AS (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, list_transform(ds[2:], lambda g: greatest(g, 0))), lambda s, g: s + (g - s) / 14) AS gain,
  list_reduce(list_prepend(0.0::DOUBLE, list_transform(ds[2:], lambda g: greatest(-g, 0))), lambda s, g: s + (g - s) / 14) AS loss,
  list_reduce(list_prepend(tr0, trs[2:]), lambda s, g: s + (g - s) / 14) AS atr FROM y)
SELECT instrument_id, o AS open_time, round(CASE WHEN n >= 80 THEN {_EMA.format(a='2 / 21')} END + 1e-7, 4) AS ema20, round(CASE WHEN n >= 200 THEN {_EMA.format(a='2 / 51')} END + 1e-7, 4) AS ema50,
  round(CASE WHEN n >= 56 THEN CASE WHEN loss = 0 THEN CASE WHEN gain = 0 THEN 0 ELSE 100 END ELSE 100 - 100 / (1 + gain / loss) END END + 1e-7, 4) AS rsi14, round(CASE WHEN n >= 56 THEN atr END + 1e-7, 4) AS atr14,
  round(CASE WHEN m >= 20 THEN mid END + 1e-7, 4) AS bb_middle, round(CASE WHEN m >= 20 THEN mid + 2 * sd END + 1e-7, 4) AS bb_upper, round(CASE WHEN m >= 20 THEN vw END + 1e-7, 4) AS vwap20
FROM z
""")
def compute_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.indicators(A.bars(spark, sf_dir, "1h", 3600))
    return out.select("instrument_id", _epoch("open_time"), *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("ema20", "ema50", "rsi14", "atr14", "bb_middle", "bb_upper", "vwap20")))


_NEEDED = "ema20:80 ema50:200 ema200:800 rsi14:56 macd:104 macd_signal:140 macd_histogram:140 atr14:56 atr_percent:56 bb_middle:20 bb_upper:20 bb_lower:20 bb_width:20 bb_percent_b:20 vwap20:20".split()


@query(f"""
WITH {B1H}, x AS (SELECT instrument_id, o, CAST(close AS DOUBLE) AS close, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(volume AS DOUBLE) AS volume FROM b WHERE is_final),
d AS (SELECT *, close - lag(close) OVER w AS d, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM x WINDOW w AS (PARTITION BY instrument_id ORDER BY o)),
y AS (SELECT *, list(close) OVER h AS closes, list(d) OVER h AS ds, list(tr) OVER h AS trs, first_value(high - low) OVER h AS tr0, count(*) OVER h AS n,
  avg(close) OVER k AS bb_middle, stddev_pop(close) OVER k AS sd, sum((high + low + close) / 3 * volume) OVER k / nullif(sum(volume) OVER k, 0) AS vwap20
  FROM d WINDOW h AS (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 799 PRECEDING AND CURRENT ROW), k AS (PARTITION BY instrument_id ORDER BY o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, {_EMA.format(a='2 / 21')} AS ema20, {_EMA.format(a='2 / 51')} AS ema50, {_EMA.format(a='2 / 201')} AS ema200,
  list_reduce(list_prepend(0.0::DOUBLE, list_transform(ds[2:], lambda g: greatest(g, 0))), lambda s, g: s + (g - s) / 14) AS gain,
  list_reduce(list_prepend(0.0::DOUBLE, list_transform(ds[2:], lambda g: greatest(-g, 0))), lambda s, g: s + (g - s) / 14) AS loss,
  list_reduce(list_prepend(tr0, trs[2:]), lambda s, g: s + (g - s) / 14) AS atr14, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower,
  list_reduce(list_prepend([closes[1], closes[1], 0.0::DOUBLE], list_transform(closes, lambda c: [c, c, 0.0::DOUBLE])), lambda s, c: [s[1] + (c[1] - s[1]) * 2 / 13, s[2] + (c[2] - s[2]) * 2 / 27,
    s[3] + (s[1] + (c[1] - s[1]) * 2 / 13 - (s[2] + (c[2] - s[2]) * 2 / 27) - s[3]) * 0.2]) AS m FROM y),
v AS (SELECT *, CASE WHEN loss = 0 THEN CASE WHEN gain = 0 THEN 0 ELSE 100 END ELSE 100 - 100 / (1 + gain / loss) END AS rsi14, m[1] - m[2] AS macd, m[3] AS macd_signal, m[1] - m[2] - m[3] AS macd_histogram, atr14 / nullif(close, 0) * 100 AS atr_percent,
  CASE WHEN bb_upper <> bb_lower AND bb_middle <> 0 THEN (bb_upper - bb_lower) / bb_middle END AS bb_width, CASE WHEN bb_upper <> bb_lower AND bb_middle <> 0 THEN (close - bb_lower) / (bb_upper - bb_lower) END AS bb_percent_b FROM z)
SELECT instrument_id, o AS open_time, {", ".join("round(CASE WHEN n >= {1} THEN {0} END + 1e-7, 4) AS {0}".format(*x.split(":")) for x in _NEEDED)},
  concat_ws(',', {", ".join("CASE WHEN n < {1} OR {0} IS NULL THEN '{0}' END".format(*x.split(":")) for x in _NEEDED)}) AS unavailable FROM v
""")
def all_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator at every final bar, and the names of those that can't be told there."""
    out = series.indicators(A.bars(spark, sf_dir, "1h", 3600))
    return out.select("instrument_id", _epoch("open_time"), *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in series.NEEDS), F.array_join("unavailable", ",").alias("unavailable"))


def _signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = A.bars(spark, sf_dir, "1h", 3600)
    key = [*series.BY, "open_time"]
    ind = series.indicators(bars).drop("volume")
    stats = series.statistics(bars, 3600).drop("close")
    rows = ind.join(stats, key)
    hour = F.unix_seconds("open_time") / 3600
    return rows.select("instrument_id", F.col("open_time").alias("as_of"), "close", "ema20", "ema50", F.coalesce("ema200", "ema50").alias("ema200"), "rsi14", "macd_histogram", "bb_percent_b", "atr_percent", "volume_z", "return1", "vol_percentile_slow", (F.col("close") % 1).alias("max_news_materiality"), (hour % 3 == 0).alias("has_open_position"))


@query()
def replay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators, statistics, regime and gate of every hourly bar."""
    return signals.replay(_signal_rows(spark, sf_dir)).withColumn("as_of", F.unix_seconds("as_of"))


@query()
def trigger_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.trigger_rates(signals.replay(_signal_rows(spark, sf_dir)))
