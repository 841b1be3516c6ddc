"""The gate over signals made of events by whole-number rules, so that SQL can walk the same rows one by one."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronark.operators import graph, signals
from chronark.plans import adapters as A
from chronark.plans.more_queries import _with_rocksdb
from chronark.plans.registry import query
from chronark.plans.text_queries import _streamed
from chronark.streaming import streams

#: Every expression is read alike by both engines: each event is a row ten minutes after the one before.
_SIGNALS = {
    "close": "100.0D", "ema20": "(10000 + S + Q) / 100.0D", "ema50": "(10000 + S) / 100.0D", "ema200": "CASE WHEN event_id % 97 <> 0 THEN 100.0D END",
    "rsi14": "CASE WHEN event_id % 40 < 3 THEN event_id * 13 % 101 ELSE 50 END + 0.0D", "macd_histogram": "(CASE WHEN event_id % 50 IN (7, 8, 9) THEN event_id % 3 - 1 ELSE 0 END) / 10.0D",
    "bb_percent_b": "CASE event_id % 60 WHEN 11 THEN 1.2D WHEN 31 THEN -0.2D ELSE 0.5D END", "atr_percent": "1.0D", "volume_z": "CASE WHEN event_id % 70 = 5 THEN -3.5D ELSE 0.0D END",
    "return1": "CASE WHEN event_id % 80 = 9 THEN 2.5D ELSE 0.1D END", "vol_percentile_slow": "CASE WHEN event_id % 83 <> 0 THEN G * 17 % 101 + 0.0D END",
    "max_news_materiality": "CASE WHEN event_id % 90 = 17 THEN 0.7D ELSE 0.1D END", "has_open_position": "H % 2 = 0",
}


def _in(engine_floor: str) -> list[str]:
    """The signals' expressions for an engine with this whole-number division."""
    step = lambda n: engine_floor.format(n=n)
    names = {"S": f"({step(60)} * 5 % 11 - 5) * 5", "Q": f"({step(45)} * 7 % 13 - 6) * 4 + event_id % 5 - 2", "G": f"({step(40)})", "H": f"({step(200)})"}
    out = []
    for name, text in _SIGNALS.items():
        for letter, meaning in names.items():
            text = text.replace(f"{letter} ", f"({meaning}) ").replace(f" {letter})", f" ({meaning}))")
        out.append(f"{re.sub(r'([0-9.]+)D', r'CAST(\1 AS DOUBLE)', text)} AS {name}")
    return out


_WALK = f"""RECURSIVE e AS (SELECT event_type AS instrument_id, 1704067200 + event_id * 600 AS at_s, {", ".join(_in("(event_id // {n})"))} FROM events),
l AS MATERIALIZED (SELECT *, row_number() OVER w AS n, lag(rsi14) OVER w AS rsi0, lag(macd_histogram) OVER w AS macd0, lag(bb_percent_b) OVER w AS band0, abs(macd_histogram) / close * 100 AS size,
  ema20 IS NULL OR ema50 IS NULL OR ema200 IS NULL OR ema200 <= 0 AS blind, (ema20 - ema50) / ema200 * 100 AS fast, (ema50 - ema200) / ema200 * 100 AS slow FROM e WINDOW w AS (PARTITION BY instrument_id ORDER BY at_s)),
f AS MATERIALIZED (SELECT *, list_concat(list_concat(list_concat(CASE WHEN rsi14 <= 30 AND rsi0 > 30 OR rsi14 >= 70 AND rsi0 < 70 THEN ['RSI_EXTREME'] ELSE [] END,
    CASE WHEN (macd0 <= 0 AND macd_histogram > 0 OR macd0 >= 0 AND macd_histogram < 0) AND size >= 0.05 THEN ['MACD_CROSS'] ELSE [] END),
  list_concat(CASE WHEN bb_percent_b > 1.05 AND band0 <= 1.05 OR bb_percent_b < -0.05 AND band0 >= -0.05 THEN ['BOLLINGER_BREAKOUT'] ELSE [] END, CASE WHEN abs(volume_z) >= 3 THEN ['VOLUME_ANOMALY'] ELSE [] END)),
  list_concat(CASE WHEN abs(return1) > 2 * atr_percent THEN ['PRICE_SHOCK'] ELSE [] END, CASE WHEN max_news_materiality > 0.6 THEN ['NEWS'] ELSE [] END)) AS fired FROM l),
r AS (SELECT DISTINCT instrument_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_s, 'UNKNOWN' AS trend, 'UNKNOWN' AS volatility, CAST(NULL AS BIGINT) AS round_at, false AS changed, CAST([] AS VARCHAR[]) AS reasons FROM f
  UNION ALL
  SELECT instrument_id, n, at_s, trend, volatility, CASE WHEN len(reasons) > 0 THEN at_s ELSE round_at END, changed, reasons FROM (
    SELECT *, list_concat(list_concat(fired, CASE WHEN changed THEN ['REGIME_CHANGE'] ELSE [] END), CASE WHEN has_open_position AND (round_at IS NULL OR at_s - round_at >= 14400) THEN ['SCHEDULED_REVIEW'] ELSE [] END) AS reasons FROM (
      SELECT *, trend <> 'UNKNOWN' AND (trend <> trend0 OR volatility <> volatility0) AS changed FROM (
        SELECT f.instrument_id, f.n, f.at_s, f.fired, f.has_open_position, r.round_at, r.trend AS trend0, r.volatility AS volatility0,
          CASE WHEN blind THEN 'UNKNOWN' WHEN fast > CASE r.trend WHEN 'UPTREND' THEN 0.08 ELSE 0.15 END AND slow > CASE r.trend WHEN 'UPTREND' THEN 0.08 ELSE 0.15 END THEN 'UPTREND'
            WHEN -fast > CASE r.trend WHEN 'DOWNTREND' THEN 0.08 ELSE 0.15 END AND -slow > CASE r.trend WHEN 'DOWNTREND' THEN 0.08 ELSE 0.15 END THEN 'DOWNTREND' ELSE 'RANGE' END AS trend,
          CASE WHEN blind OR vol_percentile_slow IS NULL THEN 'UNKNOWN' WHEN r.volatility = 'HIGH' AND vol_percentile_slow >= 60 THEN 'HIGH' WHEN r.volatility = 'LOW' AND vol_percentile_slow <= 40 THEN 'LOW'
            WHEN vol_percentile_slow > 80 THEN 'HIGH' WHEN vol_percentile_slow < 20 THEN 'LOW' ELSE 'NORMAL' END AS volatility
        FROM r JOIN f ON f.instrument_id = r.instrument_id AND f.n = r.n + 1))))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.selectExpr("event_type AS instrument_id", "timestamp_seconds(1704067200 + event_id * 600) AS as_of", *_in("(event_id div {n})"))


@query(f"WITH {_WALK} SELECT instrument_id, at_s AS as_of, trend, volatility, changed AS regime_changed, len(reasons) > 0 AS is_open, array_to_string(reasons, ',') AS reasons FROM r WHERE n > 0")
def gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, regime and reviews of every row, by windows."""
    out = signals.replay(_rows(spark, sf_dir))
    return out.select("instrument_id", F.unix_seconds("as_of").alias("as_of"), "trend", "volatility", "regime_changed", "is_open", F.array_join("reasons.type", ",").alias("reasons"))


@query(f"""WITH {_WALK}, t AS (SELECT unnest(list_concat(CASE WHEN len(reasons) > 0 THEN ['OPEN'] ELSE [] END, reasons)) AS type FROM r WHERE n > 0)
SELECT type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM events), 4) AS percent FROM t GROUP BY 1""")
def gate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.trigger_rates(signals.replay(_rows(spark, sf_dir)))


@query(f"WITH {_WALK} SELECT instrument_id, at_s AS as_of, trend, volatility, changed AS regime_changed, len(reasons) > 0 AS is_open, array_to_string(reasons, ',') AS reasons FROM r WHERE n > 0")
def stream_gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream, with the gate as its state."""
    at = f"{graph.shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    _rows(spark, sf_dir).write.parquet(f"{at}/in")
    s = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    return _with_rocksdb(spark, lambda: _streamed(spark, streams.stream_gate(s))).withColumn("as_of", F.unix_seconds("as_of"))
