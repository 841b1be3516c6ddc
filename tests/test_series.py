"""Bars, indicators and signals: fixtures, independent recomputation, and relations that must hold."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from chronark.operators import bars as B
from chronark.operators import series, signals

SCHEMA = "instrument_id long, timeframe string, open_time timestamp, close_time timestamp, open decimal(24,12), high decimal(24,12), low decimal(24,12), close decimal(24,12), volume decimal(30,12), quote_volume decimal(30,12), trade_count int, taker_buy_base decimal(30,12), is_final boolean"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def minute_bars(spark, n, skip=(), open_=()):
    from decimal import Decimal as D

    rows = []
    for i in range(n):
        if i in skip:
            continue
        o, v = 100 + i, 10 + i
        t = START + timedelta(minutes=i)
        rows.append((1, "1m", t, t + timedelta(seconds=59, milliseconds=999), D(o), D(o + 2), D(o - 1), D(o + 1), D(v), D(o * v), 5 + i, D(v) / 2, i not in open_))
    return spark.createDataFrame(rows, SCHEMA)


def test_rollup_of_minutes(spark):
    out = B.rollup(minute_bars(spark, 240), "1m", ["5m", "15m", "1h"])
    assert {r.timeframe: r["count"] for r in out.groupBy("timeframe").count().collect()} == {"5m": 48, "15m": 16, "1h": 4}
    first = out.where("timeframe = '5m'").orderBy("open_time").first()
    assert [float(first[c]) for c in ("open", "high", "low", "close", "volume")] == [100, 106, 99, 105, 60]
    assert B.rollup(minute_bars(spark, 10, skip=(3,)), "1m", ["5m"]).count() == 1
    assert B.rollup(minute_bars(spark, 10, open_=(7,)), "1m", ["5m"]).count() == 1


def test_rollup_of_rollup(spark):
    bars = minute_bars(spark, 240)
    direct = B.rollup(bars, "1m", ["1h"])
    twice = B.rollup(B.rollup(bars, "1m", ["15m"]), "15m", ["1h"])
    cols = ["open_time", "open", "high", "low", "close", "trade_count"]
    assert sorted(map(str, direct.select(cols).collect())) == sorted(map(str, twice.select(cols).collect()))


def test_gaps_and_freshness(spark):
    end = START + timedelta(minutes=20)
    gaps = B.find_gaps(minute_bars(spark, 20, skip=(3, 4, 5, 12)), "1m", F.lit(START), F.lit(end)).orderBy("gap_from").collect()
    assert [r.missing for r in gaps] == [3, 1]
    assert [r.missing for r in B.find_gaps(minute_bars(spark, 20, open_=(7,)), "1m", F.lit(START), F.lit(end)).collect()] == [1]
    bars = minute_bars(spark, 10)
    for minutes, stale in ((12, False), (40, True)):
        r = B.freshness(bars, bars, "1m", F.lit(START + timedelta(minutes=minutes))).first()
        assert r.is_stale is stale
    assert B.freshness(bars, bars.where("false"), "1m", F.lit(end)).first().staleness_s == 36_500 * 86_400


def test_upsert_is_idempotent_and_final_sticks(spark):
    bars = minute_bars(spark, 5)
    late = bars.withColumn("close", (F.col("close") + 1).cast("decimal(24,12)")).withColumn("is_final", F.lit(False)).withColumn("seq", F.lit(1))
    once = B.upsert(bars, late)
    again = B.upsert(once, late)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.select(once.columns).collect()))
    assert once.where("is_final").count() == 5 and float(once.orderBy("open_time").first().close) == 102


def test_readers_never_look_ahead(spark):
    bars = minute_bars(spark, 10)
    at = START + timedelta(minutes=5)
    assert [r.open_time.minute for r in B.last_final_bars(bars, "1m", F.lit(at), 2).orderBy("open_time").collect()] == [3, 4]
    instants = spark.createDataFrame([(1, at), (1, at - timedelta(milliseconds=1)), (1, START)], "instrument_id long, at timestamp")
    got = [None if r.open_time is None else r.open_time.minute for r in B.last_bars_before(instants, bars, "1m").orderBy("at").collect()]
    assert got == [None, 3, 4]


def hourly(spark, closes):
    rows = []
    for i, c in enumerate(closes):
        t = START + timedelta(hours=i)
        rows.append((1, "1h", t, float(c), float(c) + 0.5, float(c) - 0.5, 10 + 2 * math.sin(0.9 * i)))
    df = spark.createDataFrame(rows, "instrument_id long, timeframe string, open_time timestamp, close double, high double, low double, volume double")
    return df.withColumn("is_final", F.lit(True))


def direct(closes, n):
    """EMA20 and MACD signal from the window's bars alone."""
    x = closes[max(0, n - series.WINDOW + 1) : n + 1]

    def ema(v, alpha):
        s = v[0]
        for y in v[1:]:
            s += alpha * (y - s)
        return s

    line = []
    a = b = x[0]
    for y in x:
        a, b = a + 2 / 13 * (y - a), b + 2 / 27 * (y - b)
        line.append(a - b)
    gain = loss = 0.0
    for p, q in zip(x, x[1:]):
        gain, loss = gain + (max(q - p, 0) - gain) / 14, loss + (max(p - q, 0) - loss) / 14
    return ema(x, 2 / 21), ema(x, 2 / 201), ema(line, 0.2), 100 - 100 / (1 + gain / loss)


def test_recursive_indicators_restart_with_the_window(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 900)
    rng = np.random.default_rng(3)
    closes = 30_000 * np.exp(np.cumsum(rng.normal(0, 0.006, 2100)))
    got = series.recursive_indicators(hourly(spark, closes)).orderBy("open_time").collect()
    assert len(got) == len(closes)
    for n in (10, 500, 799, 800, 899, 900, 1500, 1799, 1800, 2099):
        want = direct(closes, n)
        have = [got[n][c] for c in ("ema20", "ema200", "macd_signal", "rsi14")]
        assert np.allclose(have, want, rtol=1e-9, atol=1e-6), n


def test_warm_up_and_scale(spark):
    rng = np.random.default_rng(5)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    a = series.indicators(hourly(spark, closes)).orderBy("open_time").collect()
    assert set(a[10].unavailable) == set(series.NEEDS) and a[-1].unavailable == ["ema200"]
    s = series.statistics(hourly(spark, closes), 3600).orderBy("open_time").collect()
    t = series.statistics(hourly(spark, closes * 7), 3600).orderBy("open_time").collect()
    assert abs(s[-1].return24 - (closes[-1] / closes[-25] - 1) * 100) < 1e-6
    for x, y in zip(s[-5:], t[-5:]):
        assert all(abs(x[c] - y[c]) < 1e-5 for c in ("return1", "realized_vol", "price_percentile"))
    assert s[5].return24 is None and s[5].realized_vol is None


def test_regime_hysteresis():
    def regime(fast, slow, percentile, last):
        return signals.classify(100 + fast + slow, 100 + slow, 100.0, percentile, last)

    up = regime(0.2, 0.2, 50, signals.Regime())
    assert (up.trend, up.volatility) == ("UPTREND", "NORMAL")
    assert regime(0.1, 0.1, 50, up).trend == "UPTREND" and regime(0.1, 0.1, 50, signals.Regime()).trend == "RANGE"
    high = regime(0, 0, 85, up)
    assert high.volatility == "HIGH" and regime(0, 0, 65, high).volatility == "HIGH" and regime(0, 0, 59, high).volatility == "NORMAL"
    assert regime(0, 0, 10, high).volatility == "LOW"
    assert signals.classify(None, 1.0, 1.0, 50, up).trend == "UNKNOWN"


def row(i, **more):
    base = {"instrument_id": "x", "as_of": START + timedelta(hours=i), "close": 100.0, "ema20": 100.0, "ema50": 100.0, "ema200": 100.0, "rsi14": 50.0, "macd_histogram": 1.0, "bb_percent_b": 0.5, "atr_percent": 1.0, "volume_z": 0.0, "return1": 0.0, "vol_percentile_slow": 50.0, "max_news_materiality": 0.0, "has_open_position": False}
    return base | more


KIND = "instrument_id string, as_of timestamp, close double, ema20 double, ema50 double, ema200 double, rsi14 double, macd_histogram double, bb_percent_b double, atr_percent double, volume_z double, return1 double, vol_percentile_slow double, max_news_materiality double, has_open_position boolean"


def test_gate_rules(spark):
    rows = [row(0), row(1, rsi14=29.0), row(2, rsi14=28.0), row(3, macd_histogram=-0.2), row(4, macd_histogram=0.01), row(5, bb_percent_b=1.2), row(6, volume_z=-3.5), row(7, return1=-2.5), row(8, max_news_materiality=0.7), row(9), row(12, has_open_position=True), row(13, has_open_position=True)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in KIND.split(", ")) for r in rows], KIND)
    out = signals.replay(df).orderBy("as_of").collect()
    got = [[x.type for x in r.reasons] for r in out]
    assert got == [["REGIME_CHANGE"], ["RSI_EXTREME"], [], ["MACD_CROSS"], [], ["BOLLINGER_BREAKOUT"], ["VOLUME_ANOMALY"], ["PRICE_SHOCK"], ["NEWS"], [], ["SCHEDULED_REVIEW"], []]
    rates = {r.type: r.n for r in signals.trigger_rates(signals.replay(df)).collect()}
    assert rates["OPEN"] == 8


@pytest.mark.parametrize("step", [1, 3])
def test_gate_stays_shut_on_a_ramp(spark, step):
    closes = 100 + step * np.arange(400.0)
    rows = series.indicators(hourly(spark, closes)).drop("volume").join(series.statistics(hourly(spark, closes), 3600).drop("close"), ["instrument_id", "timeframe", "open_time"])
    df = rows.withColumn("instrument_id", F.lit("x")).withColumn("as_of", F.col("open_time")).withColumn("ema200", F.col("ema50")).withColumn("max_news_materiality", F.lit(0.0)).withColumn("has_open_position", F.lit(False))
    out = signals.replay(df).where("as_of > timestamp '2026-01-10'")
    assert out.where("is_open").count() < 0.05 * out.count()


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_the_fold(spark, seed):
    """Windows against the rules walked row by row: every band of the hysteresis, missing values, open positions, quiet spans."""
    rng = random.Random(seed)
    rows = []
    for name in ("a", "b"):
        fast = slow = 0.0
        level = 50.0
        for k in range(400):
            fast, slow = (max(-0.3, min(0.3, x + rng.uniform(-0.06, 0.06))) for x in (fast, slow))
            level = max(0.0, min(100.0, level + rng.uniform(-15, 15)))
            quiet = 150 < k < 260
            e200 = rng.choice([100.0] * 30 + [None, 0.0]) if not quiet else 100.0
            rows.append((name, k * 3600, 100.0, None if e200 is None else 100 + fast + slow, 100 + slow, e200, rng.choice([50.0] * 20 + [25.0, 75.0]) if not quiet else 50.0, 0.0, 0.5, 1.0, 0.0, 0.0, rng.choice([level] * 15 + [None]) if not quiet else 50.0, 0.0, rng.random() < 0.7))
    names = "close ema20 ema50 ema200 rsi14 macd_histogram bb_percent_b atr_percent volume_z return1 vol_percentile_slow max_news_materiality".split()
    df = spark.createDataFrame(rows, "instrument_id string, at long, " + ", ".join(f"{n} double" for n in names) + ", has_open_position boolean")
    got = signals.replay(df.withColumn("as_of", F.timestamp_seconds("at")).drop("at").repartition(3)).collect()
    of = {(r.instrument_id, int(r.as_of.timestamp())): r for r in got}
    assert len(of) == len(rows)
    for name in ("a", "b"):
        mine = [r for r in rows if r[0] == name]
        fired = []
        for k, r in enumerate(mine):
            was, now = (mine[k - 1][6] if k else None), r[6]
            crossed = was is not None and ((now <= 30 < was) or (now >= 70 > was))
            fired.append([{"type": "RSI_EXTREME", "magnitude": now}] if crossed else [])
        walk = signals.fold(iter([(r[1], r[3], r[4], r[5], r[12], r[14], f) for r, f in zip(mine, fired, strict=True)]), signals.Regime(), None)
        for r, (trend, volatility, strength, changed, is_open, reasons, _) in zip(mine, walk, strict=True):
            x = of[name, r[1]]
            assert (x.trend, x.volatility, x.regime_changed, x.is_open) == (trend, volatility, changed, is_open)
            assert abs(x.strength - strength) < 1.1e-4 and [(y.type, y.magnitude) for y in x.reasons if y.type != "REGIME_CHANGE"] == [(y["type"], y["magnitude"]) for y in reasons if y["type"] != "REGIME_CHANGE"]


@pytest.mark.parametrize("size", [7, 4000])
def test_trailing_ranks_equal_brute_force(spark, size, monkeypatch):
    """Ties, missing values, windows longer and shorter than a chunk."""
    monkeypatch.setattr(series, "CHUNK", size)
    rng = np.random.default_rng(size)
    rows = [(k, "1h", i, None if rng.random() < 0.1 else float(rng.integers(6))) for k in ("a", "b") for i in range(90)]
    df = spark.createDataFrame(rows, "instrument_id string, timeframe string, open_time long, x double").repartition(3)
    got = {(r.instrument_id, r.open_time): (r.short, r.long) for r in series.with_trailing_ranks(df, {"short": ("x", 5, 3), "long": ("x", 40, 1)}).collect()}

    def rank(values, least):
        v, have = values[-1], [x for x in values if x is not None]
        if v is None or len(have) < least:
            return None
        return 100 * (sum(x < v for x in have) + sum(x == v for x in have) / 2) / len(have)

    by = {k: [x for i, _, _, x in rows if i == k] for k in ("a", "b")}
    assert got == {(k, i): (rank(v[max(0, i - 4) : i + 1], 3), rank(v[max(0, i - 39) : i + 1], 1)) for k, v in by.items() for i in range(90)}
