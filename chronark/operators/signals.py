"""Market regime with hysteresis and the trigger gate, over each instrument's rows in time order.

Input rows: (instrument_id, as_of, close, ema20, ema50, ema200, rsi14, macd_histogram, bb_percent_b, atr_percent, volume_z, return1,
vol_percentile_slow, max_news_materiality, has_open_position). What a rule needs of the row before is a ``lag``, the regime is decided
by windows, and only the times of reviews between other rounds are picked one after another. ``classify`` and ``fold`` are the same
rules row by row, as a stream needs them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronark.operators import ordered

ENTER_TREND, STAY_TREND = 0.15, 0.08
ENTER_HIGH, LEAVE_HIGH, ENTER_LOW, LEAVE_LOW = 80.0, 60.0, 20.0, 40.0
UNKNOWN = "UNKNOWN"
REVIEW_S = 4 * 3600


@dataclass
class Regime:
    trend: str = UNKNOWN
    volatility: str = UNKNOWN
    strength: float = 0.0


def _missing(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def classify(ema20, ema50, ema200, percentile, last: Regime) -> Regime:
    """The regime after ``last``: harder to enter than to stay in."""
    if _missing(ema20, ema50, ema200) or ema200 <= 0:
        return Regime()
    fast, slow = (ema20 - ema50) / ema200 * 100, (ema50 - ema200) / ema200 * 100
    trend = "RANGE"
    for name, sign in (("UPTREND", 1), ("DOWNTREND", -1)):
        limit = STAY_TREND if last.trend == name else ENTER_TREND
        if sign * fast > limit and sign * slow > limit:
            trend = name
    if _missing(percentile):
        volatility = UNKNOWN
    elif last.volatility == "HIGH" and percentile >= LEAVE_HIGH:
        volatility = "HIGH"
    elif last.volatility == "LOW" and percentile <= LEAVE_LOW:
        volatility = "LOW"
    else:
        volatility = "HIGH" if percentile > ENTER_HIGH else "LOW" if percentile < ENTER_LOW else "NORMAL"
    return Regime(trend, volatility, round(min(abs(fast), abs(slow)), 4))


def stateless_reasons() -> dict[str, object]:
    """Rules on a row and the one before it, as Columns over an (instrument, as_of) window; null: doesn't fire."""
    w = W.partitionBy("instrument_id").orderBy("as_of")
    c = F.col
    before = lambda x: F.lag(x).over(w)
    rsi, macd, band = before("rsi14"), before("macd_histogram"), before("bb_percent_b")
    size = F.abs("macd_histogram") / F.nullif("close", F.lit(0.0)) * 100
    crossed = ((macd <= 0) & (c("macd_histogram") > 0)) | ((macd >= 0) & (c("macd_histogram") < 0))
    return {
        "RSI_EXTREME": F.when(((c("rsi14") <= 30) & (rsi > 30)) | ((c("rsi14") >= 70) & (rsi < 70)), c("rsi14")),
        "MACD_CROSS": F.when(crossed & (size >= 0.05), size),
        "BOLLINGER_BREAKOUT": F.when(((c("bb_percent_b") > 1.05) & (band <= 1.05)) | ((c("bb_percent_b") < -0.05) & (band >= -0.05)), c("bb_percent_b")),
        "VOLUME_ANOMALY": F.when(F.abs("volume_z") >= 3, F.abs("volume_z")),
        "PRICE_SHOCK": F.when(F.abs("return1") > 2 * c("atr_percent"), F.abs("return1")),
        "NEWS": F.when(c("max_news_materiality") > 0.6, c("max_news_materiality")),
    }


REASON = "struct<type:string,magnitude:double>"
STATE = ["ema20", "ema50", "ema200", "vol_percentile_slow", "has_open_position", "reasons"]


def fold(rows: Iterator[tuple], last: Regime, round_at: float | None) -> Iterator[tuple]:
    """(trend, volatility, strength, changed, open, reasons, round_at) for rows of (seconds, *STATE) in time order."""
    for at, ema20, ema50, ema200, percentile, position, fired in rows:
        now = classify(ema20, ema50, ema200, percentile, last)
        changed = now.trend != UNKNOWN and (now.trend, now.volatility) != (last.trend, last.volatility)
        reasons = [dict(r) if isinstance(r, dict) else r.asDict() for r in (fired if fired is not None else [])]
        if changed:
            reasons.append({"type": "REGIME_CHANGE", "magnitude": now.strength})
        if position and (round_at is None or at - round_at >= REVIEW_S):
            reasons.append({"type": "SCHEDULED_REVIEW", "magnitude": None if round_at is None else float(at - round_at)})
        if reasons:
            round_at = at
        yield now.trend, now.volatility, now.strength, changed, bool(reasons), reasons, round_at
        last = now


def _settled(sure: Column, leaning: Column, either: tuple[str, str], resting: str) -> Column:
    """A state with hysteresis: ``sure`` where the row alone decides it; else the row leans to one of ``either``, which holds if
    the last sure state is that one and no row has leaned to the other since; else it is ``resting``."""
    w = W.partitionBy("instrument_id").orderBy("as_of").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(sure, ignorenulls=True).over(w)
    since = F.max(F.when(sure.isNotNull(), F.col("as_of"))).over(w)
    out = sure
    for name, other in (either, either[::-1]):
        against = F.max(F.when(sure.isNull() & (leaning == other), F.col("as_of"))).over(w)
        holds = sure.isNull() & (leaning == name) & (last == name) & (against.isNull() | (against < since))
        out = F.coalesce(out, F.when(holds, name))
    return F.coalesce(out, F.lit(resting))


def regimes(rows: DataFrame) -> DataFrame:
    """``rows`` with trend, volatility, strength and regime_changed: ``classify`` walked over each instrument, as windows."""
    none = lambda c: F.col(c).isNull() | F.isnan(c)
    blind = none("ema20") | none("ema50") | none("ema200") | (F.col("ema200") <= 0)
    fast, slow = (F.when(~blind, (F.col(x) - F.col(y)) / F.col("ema200") * 100) for x, y in (("ema20", "ema50"), ("ema50", "ema200")))
    rows = rows.withColumns({"__blind": blind, "__fast": fast, "__slow": slow})
    both = lambda sign, limit: (sign * F.col("__fast") > limit) & (sign * F.col("__slow") > limit)
    lean = F.when(both(1, STAY_TREND), "UPTREND").when(both(-1, STAY_TREND), "DOWNTREND")
    sure = F.when(F.col("__blind"), UNKNOWN).when(both(1, ENTER_TREND), "UPTREND").when(both(-1, ENTER_TREND), "DOWNTREND").when(lean.isNull(), "RANGE")
    p = F.col("vol_percentile_slow")
    settled = F.when(F.col("__blind") | none("vol_percentile_slow"), UNKNOWN).when(p > ENTER_HIGH, "HIGH").when(p < ENTER_LOW, "LOW").when((p > LEAVE_LOW) & (p < LEAVE_HIGH), "NORMAL")
    rows = rows.withColumns({"__sure": sure, "__lean": lean, "__level": settled, "__near": F.when(p >= LEAVE_HIGH, "HIGH").when(p <= LEAVE_LOW, "LOW")})
    trend = _settled(F.col("__sure"), F.col("__lean"), ("UPTREND", "DOWNTREND"), "RANGE")
    volatility = _settled(F.col("__level"), F.col("__near"), ("HIGH", "LOW"), "NORMAL")
    rows = rows.withColumns({"trend": trend, "volatility": volatility, "strength": F.coalesce(F.bround(F.least(F.abs("__fast"), F.abs("__slow")), 4), F.lit(0.0))})
    w = W.partitionBy("instrument_id").orderBy("as_of")
    was = F.coalesce(F.lag(F.struct("trend", "volatility")).over(w), F.struct(F.lit(UNKNOWN).alias("trend"), F.lit(UNKNOWN).alias("volatility")))
    rows = rows.withColumn("regime_changed", (F.col("trend") != UNKNOWN) & (F.struct("trend", "volatility") != was))
    return rows.drop("__blind", "__fast", "__slow", "__sure", "__lean", "__level", "__near")


class _Reviews:
    """Times of a span's rows that are due for review, each at least ``REVIEW_S`` after the one before or after the span's anchor."""

    def __init__(self):
        self.last = None

    def put(self, r: dict) -> list[tuple]:
        last = r["anchor"] if self.last is None else self.last
        if last is not None and r["at"] - last < REVIEW_S:
            return []
        self.last = r["at"]
        return [(r["instrument_id"], int(r["at"]))]

    def end(self) -> list[tuple]:
        return []


def replay(rows: DataFrame) -> DataFrame:
    """(instrument_id, as_of, trend, volatility, strength, regime_changed, is_open, reasons): the gate walked over every row.

    Rules and regime are windows. A row with any such reason opens a round whatever came before, so reviews, which depend on
    the round before, are picked in each span between two such rows for itself, whose rows stream through one task.
    """
    fired = F.array_compact(F.array(*(F.when(m.isNotNull(), F.struct(F.lit(t).alias("type"), m.cast("double").alias("magnitude"))) for t, m in stateless_reasons().items())))
    out = regimes(rows.withColumn("reasons", fired).select("instrument_id", "as_of", F.unix_seconds("as_of").alias("at"), *STATE))
    changed = F.when(F.col("regime_changed"), F.array(F.struct(F.lit("REGIME_CHANGE").alias("type"), F.col("strength").alias("magnitude")))).otherwise(F.array().cast(f"array<{REASON}>"))
    out = out.withColumn("reasons", F.concat("reasons", changed)).withColumn("certain", F.size("reasons") > 0)
    w = W.partitionBy("instrument_id").orderBy("as_of")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumns({"span": F.count_if("certain").over(upto), "anchor": F.max(F.when(F.col("certain"), F.col("at"))).over(upto)})
    waiting = out.where(F.col("has_open_position") & ~F.col("certain") & (F.col("anchor").isNull() | (F.col("at") - F.col("anchor") >= REVIEW_S)))

    kind = dict(rows.dtypes)["instrument_id"]
    reviews = ordered.fold(waiting.select("instrument_id", "span", "anchor", "at"), ["instrument_id", "span"], ["at"], _Reviews, f"instrument_id {kind}, at long")
    out = out.join(reviews.withColumn("reviewed", F.lit(True)), ["instrument_id", "at"], "left")
    before = F.max(F.when(F.col("certain") | F.col("reviewed"), F.col("at"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("before", before)
    due = F.coalesce(F.col("has_open_position"), F.lit(False)) & (F.col("before").isNull() | (F.col("at") - F.col("before") >= REVIEW_S))
    review = F.when(due, F.array(F.struct(F.lit("SCHEDULED_REVIEW").alias("type"), (F.col("at") - F.col("before")).cast("double").alias("magnitude")))).otherwise(F.array().cast(f"array<{REASON}>"))
    out = out.withColumn("reasons", F.concat("reasons", review))
    return out.select("instrument_id", "as_of", "trend", "volatility", "strength", "regime_changed", (F.size("reasons") > 0).alias("is_open"), "reasons")


def trigger_rates(decisions: DataFrame) -> DataFrame:
    """(type, n, percent): how often each rule fired, and OPEN for the gate itself, of all rows of all instruments."""
    n = decisions.agg(F.count(F.lit(1)).alias("rows"))
    fired = decisions.select(F.explode(F.concat(F.when(F.col("is_open"), F.array(F.lit("OPEN"))).otherwise(F.array().cast("array<string>")), F.col("reasons.type"))).alias("type"))
    return fired.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n)).select("type", "n", F.round(100 * F.col("n") / F.col("rows"), 4).alias("percent"))
