"""Structured Streaming forms: bars from events, a store of bars that is synced and rolled up as they land, exact duplicates in a window, the gate as state.

Each takes a streaming DataFrame and returns one, or a foreachBatch function; sources, sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronark.functions import timeframe as tf
from chronark.operators import bars as B
from chronark.operators import graph, signals


def stream_bars(events: DataFrame, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling-window bars of (instrument_id, ts, value, seq), each emitted once, when the watermark has passed its end."""
    w = F.window("ts", f"{seconds} seconds")
    out = events.withWatermark("ts", lateness).groupBy("instrument_id", w).agg(
        F.min_by("value", "seq").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "seq").alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return out.select("instrument_id", F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume")


def _stored(path: str, like: DataFrame, touched: list) -> DataFrame:
    """Bars of the touched (timeframe, month) folders only; none if the store doesn't exist yet."""
    spark = like.sparkSession
    try:
        bars = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)
    folders = [(F.col("timeframe") == t) & (F.col("month") == m) for t, m in touched]
    return bars.where(reduce(or_, folders, F.lit(False))).select(*B.KEY, *B.MEASURES, "is_final")


def merge_bars(path: str, incoming: DataFrame, order: str = "seq") -> None:
    """Upserts ``incoming`` into the monthly store at ``path``: only folders of months that it holds are read and replaced.

    A merge that is run again changes nothing, so one that was cut short is simply run again.
    """
    incoming = graph.cut(incoming)
    month = F.date_format("open_time", "yyyy-MM").alias("month")
    touched = [tuple(r) for r in incoming.select("timeframe", month).distinct().collect()]
    if touched:
        old = _stored(path, incoming.select(*B.KEY, *B.MEASURES, "is_final"), touched)
        B.write_monthly(graph.cut(B.upsert(old, incoming, order)), path, "overwrite")


def roll_touched(path: str, batch: DataFrame, base: str, targets: list[str]) -> DataFrame:
    """Complete buckets of ``targets`` that hold a bar of ``batch``, from the stored base bars of these buckets: a bucket lies within one
    month, so only folders of the batch's months are read."""
    longest = max(tf.SECONDS[t] for t in targets)
    span = tf.floor_time(F.col("open_time"), longest).alias("span")
    rows = batch.where(F.col("timeframe") == base)
    months = [(base, r[0]) for r in rows.select(F.date_format("open_time", "yyyy-MM")).distinct().collect()]
    old = _stored(path, batch.select(*B.KEY, *B.MEASURES, "is_final"), months).select("*", span)
    rolled = B.rollup(old.join(rows.select("instrument_id", span).distinct(), ["instrument_id", "span"], "left_semi").drop("span"), base, targets)
    kinds = dict(batch.dtypes)  # sums are wider than what the store has
    return rolled.select(*(F.col(c).cast(kinds[c]).alias(c) for c in (*B.KEY, *B.MEASURES, "is_final")))


def stream_rollup(path: str, base: str, targets: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch of base bars (with seq) is upserted into the store, then the buckets that it touches are rolled up and upserted.

    Late bars complete their bucket whenever they come; a batch that is run again changes nothing.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        batch = graph.cut(batch)
        merge_bars(path, batch)
        merge_bars(path, roll_touched(path, batch, base, targets).withColumn("seq", F.lit(0).cast("long")))

    return on_batch


def sync(landed: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> int:
    """Gives ``on_batch`` all that has landed since the last call with this checkpoint, and returns the number of rows read.

    ``landed`` is a streaming read of a folder; files that were read by an earlier call aren't read again, and a batch that failed halfway
    comes again as it was.
    """
    run = landed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p.numInputRows for p in run.recentProgress)


class _Dedup(StatefulProcessor):
    """The newest accepted publication of each content of a bucket, forgotten once no item in time can be within the window of it."""

    def __init__(self, hours: float, names: list[str]):
        self.window, self.names = int(hours * 3_600_000_000), names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "content array<string>, at array<long>, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        newest, before = {}, None
        if self.state.exists():
            contents, times, before = self.state.get()
            newest = dict(zip(contents, times, strict=True))
        keep = []
        for content, at in zip(pdf["content"].tolist(), pdf["micros"].tolist(), strict=True):
            last = newest.get(content)
            new = last is None or last < at - self.window
            keep.append(new)
            if new:
                newest[content] = at if last is None else max(last, at)
        # later batches hold nothing from before the watermark of this one
        oldest = timer_values.getCurrentWatermarkInMs() * 1000 - self.window
        newest = {content: at for content, at in newest.items() if at >= oldest}
        due = (max(newest.values()) + self.window) // 1000 + 2 if newest else None
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if newest:
            if before != due:
                self.handle.registerTimer(due)
            self.state.update((list(newest), list(newest.values()), due))
        elif before is not None:
            self.state.clear()
        yield pdf.loc[keep, self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        self.state.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def stream_dedup(items: DataFrame, hours: float = 72, lateness: str = "1 hour", buckets: int = 256) -> DataFrame:
    """Items (content, seq, published_at, ...) whose content no accepted item of the last ``hours`` had, in order of arrival and of seq within a
    batch: what ``news.dedup_content`` keeps.

    Contents share a state by hash, in ``buckets`` that stay the same for a checkpoint's life: a batch costs a few calls to the state store for each
    bucket, not for each content. A content's time goes when the watermark has passed its window. Items published more than ``lateness`` before
    the newest of earlier batches are late and dropped, as in any query with a watermark. Needs the RocksDB state store.
    """
    late = items.withColumn("micros", F.unix_micros("published_at")).withColumn("bucket", F.pmod(F.xxhash64("content"), F.lit(buckets))).withWatermark("published_at", lateness)
    return late.groupBy("bucket").transformWithStateInPandas(_Dedup(hours, items.columns), items.schema, "append", "eventTime")


#: Rows of an instrument that are walked and given out at once.
GATE_ROWS = 5000
_GATE_COLUMNS = (
    "as_of", "close", "ema20", "ema50", "ema200", "rsi14", "macd_histogram", "bb_percent_b", "atr_percent", "volume_z", "return1", "vol_percentile_slow", "max_news_materiality",
    "has_open_position",
)


class _Gate(StatefulProcessor):
    """Regime and the time of the last round of one instrument, over rows in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "trend string, volatility string, strength double, round_at double, rsi14 double, macd_histogram double, bb_percent_b double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        # numbers by column; only some thousand rows at a time become objects
        batches = [{c: pdf[c].to_numpy(copy=True) for c in pdf.columns if c in _GATE_COLUMNS} for pdf in rows]
        columns = {c: np.concatenate([b.pop(c) for b in batches]) for c in list(batches[0])}
        order = np.argsort(columns["as_of"], kind="stable")
        last, round_at, before = signals.Regime(), None, None
        if self.state.exists():
            s = self.state.get()
            last, round_at, before = signals.Regime(s[0], s[1], s[2]), s[3], dict(zip(("rsi14", "macd_histogram", "bb_percent_b"), s[4:], strict=True))
        for begin in range(0, len(order), GATE_ROWS):
            out = []
            part = order[begin : begin + GATE_ROWS]
            for r in pd.DataFrame({c: v[part] for c, v in columns.items()}).to_dict("records"):
                fired = _fired(r, before)
                at = r["as_of"].timestamp()
                trend, volatility, strength, changed, is_open, reasons, round_at = next(signals.fold(iter([(at, r["ema20"], r["ema50"], r["ema200"], r["vol_percentile_slow"], r["has_open_position"], fired)]), last, round_at))
                last, before = signals.Regime(trend, volatility, strength), r
                out.append((key[0], r["as_of"], trend, volatility, changed, is_open, ",".join(x["type"] for x in reasons)))
            self.state.update((last.trend, last.volatility, last.strength, round_at, before["rsi14"], before["macd_histogram"], before["bb_percent_b"]))
            yield pd.DataFrame(out, columns=["instrument_id", "as_of", "trend", "volatility", "regime_changed", "is_open", "reasons"])

    def close(self) -> None:
        pass


def _fired(r: dict, before: dict | None) -> list[dict]:
    """The rules on a row and the one before; comparisons with what is missing don't hold."""
    b = before or {"rsi14": None, "macd_histogram": None, "bb_percent_b": None}
    n = lambda x: float("nan") if x is None else float(x)
    rsi, was_rsi, macd, was_macd, band, was_band = (n(x) for x in (r["rsi14"], b["rsi14"], r["macd_histogram"], b["macd_histogram"], r["bb_percent_b"], b["bb_percent_b"]))
    size = abs(macd) / n(r["close"]) * 100 if r["close"] else float("nan")
    rules = (
        ("RSI_EXTREME", (rsi <= 30 and was_rsi > 30) or (rsi >= 70 and was_rsi < 70), rsi),
        ("MACD_CROSS", ((was_macd <= 0 < macd) or (was_macd >= 0 > macd)) and size >= 0.05, size),
        ("BOLLINGER_BREAKOUT", (band > 1.05 and was_band <= 1.05) or (band < -0.05 and was_band >= -0.05), band),
        ("VOLUME_ANOMALY", abs(n(r["volume_z"])) >= 3, abs(n(r["volume_z"]))),
        ("PRICE_SHOCK", abs(n(r["return1"])) > 2 * n(r["atr_percent"]), abs(n(r["return1"]))),
        ("NEWS", n(r["max_news_materiality"]) > 0.6, n(r["max_news_materiality"])),
    )
    return [{"type": t, "magnitude": m} for t, holds, m in rules if holds]


def stream_gate(rows: DataFrame) -> DataFrame:
    """The gate over a stream of signal rows; each instrument's state is its regime, last round and last crossing values."""
    schema = "instrument_id string, as_of timestamp, trend string, volatility string, regime_changed boolean, is_open boolean, reasons string"
    return rows.groupBy("instrument_id").transformWithStateInPandas(_Gate(), schema, "append", "none")


def resume_from(bars: DataFrame, timeframe: str, now: Column, back: int = 200) -> DataFrame:
    """(instrument_id, since): where a sync goes on: after the last final bar, at first ``back`` bars ago."""
    step = tf.SECONDS[timeframe]
    last = B.last_final_open(bars.where(F.col("timeframe") == timeframe))
    first = F.timestamp_seconds(F.unix_seconds(tf.floor_time(now, step)) - back * step)
    return bars.select("instrument_id").distinct().join(last, "instrument_id", "left").select("instrument_id", F.coalesce(tf.next_open(F.col("last_open"), step), first).alias("since"))
