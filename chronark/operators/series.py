"""Indicators and statistics for every bar at once, as if computed at that bar from its trailing window alone.

Windowed forms are Spark windows. Recursive averages restart at the first bar of each trailing window of ``WINDOW`` bars; one
pass gives them all by subtracting what lies before the window, and a long series is cut into chunks that overlap by one
window, so neither needs a task that holds a whole series.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 800
HISTORY = 720
CHUNK = 4000
BY = ["instrument_id", "timeframe"]
#: Bars each indicator needs: recursive ones four times their period.
NEEDS = {
    "ema20": 80, "ema50": 200, "ema200": 800, "rsi14": 56, "macd": 104, "macd_signal": 140, "macd_histogram": 140,
    "atr14": 56, "atr_percent": 56, "bb_middle": 20, "bb_upper": 20, "bb_lower": 20, "bb_width": 20, "bb_percent_b": 20, "vwap20": 20,
}


def _order() -> W:
    return W.partitionBy(*BY).orderBy("open_time")


def _trailing(n: int) -> W:
    return _order().rowsBetween(-(n - 1), 0)


def _ema(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _restarted(x: np.ndarray, seed: np.ndarray, alpha: float) -> np.ndarray:
    """At each n the average that starts with ``seed`` at the first bar of the window of n and goes on with ``x``."""
    total = _ema(np.concatenate((seed[:1], x[1:])), alpha)
    n = np.arange(len(x))
    first = n - (WINDOW - 1)
    late = first > 0
    left = (1 - alpha) ** (WINDOW - 1)
    out = total.copy()
    out[late] += left * (seed[first[late]] - total[first[late]])
    return out


def _recursive(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx", ignore_index=True)
    close, high, low = (pdf[c].to_numpy(float) for c in ("close", "high", "low"))
    before = np.concatenate((close[:1], close[:-1]))
    change = close - before
    zero = np.zeros(len(close))
    out = {f"ema{n}": _restarted(close, close, 2 / (n + 1)) for n in (12, 20, 26, 50, 200)}
    gain, loss = (_restarted(np.maximum(s * change, 0), zero, 1 / 14) for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi14"] = np.where(loss == 0, np.where(gain == 0, 0.0, 100.0), 100 - 100 / (1 + gain / loss))
    spread = np.maximum.reduce([high - low, np.abs(high - before), np.abs(low - before)])
    out["atr14"] = _restarted(spread, high - low, 1 / 14)
    # the signal averages a line that itself restarts with the window: its two restarts decay geometrically
    e12, e26 = _ema(close, 2 / 13), _ema(close, 2 / 27)
    line = e12 - e26
    total = _ema(line, 0.2)
    signal = total.copy()
    n = np.arange(len(close))
    first = n - (WINDOW - 1)
    late = first > 0
    s, k = first[late], WINDOW - 1
    signal[late] -= 0.8**k * total[s]
    for sign, alpha, e in ((1, 2 / 13, e12), (-1, 2 / 27, e26)):
        r = 1 - alpha
        signal[late] += sign * (close[s] - e[s]) * 0.2 * r * (0.8**k - r**k) / (0.8 - r)
    out["macd"], out["macd_signal"] = out["ema12"] - out["ema26"], signal
    keep = pdf["own"].to_numpy(bool)
    return pd.DataFrame({**{c: pdf[c] for c in (*BY, "open_time")}, **{c: out[c] for c in _RECURSIVE}})[keep]


_RECURSIVE = ["ema20", "ema50", "ema200", "rsi14", "atr14", "macd", "macd_signal"]


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """(instrument_id, timeframe, open_time, ema20, ema50, ema200, rsi14, atr14, macd, macd_signal) for each bar."""
    rows = bars.select(*BY, "open_time", *(F.col(c).cast("double").alias(c) for c in ("close", "high", "low"))).withColumn("idx", F.row_number().over(_order()) - 1)
    chunk = F.floor(F.col("idx") / CHUNK)
    own = F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))
    ahead = F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))
    # the first bar of a chunk sees one window and, for its true range and change, the bar before that
    dealt = F.when(F.col("idx") % CHUNK >= CHUNK - WINDOW, F.array(own, ahead)).otherwise(F.array(own))
    rows = rows.withColumn("d", F.explode(dealt)).select("*", "d.chunk", "d.own").drop("d")
    kinds = dict(bars.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*BY, "open_time")), *(f"{c} double" for c in _RECURSIVE)])
    return rows.groupBy(*BY, "chunk").applyInPandas(_recursive, schema)


def indicators(bars: DataFrame, sd: str = "stddev_pop") -> DataFrame:
    """All 17 indicators at each final bar, null and named in ``unavailable`` where there are too few bars; 10 places."""
    bars = bars.where("is_final")
    key = [*BY, "open_time"]
    d = lambda c: F.col(c).cast("double")
    w20 = _trailing(20)
    typical = (d("high") + d("low") + d("close")) / 3
    rows = bars.select(*key, d("close").alias("close"), d("volume").alias("volume"), F.count(F.lit(1)).over(_trailing(WINDOW)).alias("bars"),
        F.avg(d("close")).over(w20).alias("bb_middle"), F.call_function(sd, d("close")).over(w20).alias("sd"),
        (F.sum(typical * d("volume")).over(w20) / F.nullif(F.sum(d("volume")).over(w20), F.lit(0.0))).alias("vwap20"))
    rows = rows.withColumn("bb_upper", F.col("bb_middle") + 2 * F.col("sd")).withColumn("bb_lower", F.col("bb_middle") - 2 * F.col("sd"))
    width = F.col("bb_upper") - F.col("bb_lower")
    usable = (width != 0) & (F.col("bb_middle") != 0)
    rows = rows.withColumn("bb_width", F.when(usable, width / F.col("bb_middle"))).withColumn("bb_percent_b", F.when(usable, (F.col("close") - F.col("bb_lower")) / width))
    rows = rows.join(recursive_indicators(bars), key).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).withColumn("atr_percent", F.col("atr14") / F.nullif("close", F.lit(0.0)) * 100)
    named = {c: F.round(F.when(F.col("bars") >= n, F.col(c)), 10) for c, n in NEEDS.items()}
    out = rows.select(*key, "close", "volume", *(v.alias(c) for c, v in named.items()))
    return out.withColumn("unavailable", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDS))))


def trailing_ranks(values: np.ndarray, width: int, least: int = 1) -> np.ndarray:
    """100 * (below + equal / 2) / n of each value among the last ``width``, itself included, those that are there: NaN for none or
    fewer than ``least``. The window is kept sorted: a value costs two binary searches, and only the window is held."""
    out, held = np.full(len(values), np.nan), []
    for i, v in enumerate(values.tolist()):
        if i >= width and (gone := values[i - width]) == gone:
            del held[bisect_left(held, gone)]
        if v == v:
            insort(held, v)
            if len(held) >= least:
                lo, hi = bisect_left(held, v), bisect_right(held, v)
                out[i] = 100 * (lo + (hi - lo) / 2) / len(held)
    return out


def with_trailing_ranks(rows: DataFrame, ranks: dict[str, tuple[str, int, int]], order: str = "open_time") -> DataFrame:
    """``rows`` with a column for each of ``ranks``: name to (column, width, least), see ``trailing_ranks``.

    A long series is cut into chunks, each of which also gets the rows of one window before it.
    """
    most = max(width for _, width, _ in ranks.values())
    size = max(CHUNK, most)
    rows = rows.withColumn("__idx", F.row_number().over(W.partitionBy(*BY).orderBy(order)) - 1)
    chunk = F.floor(F.col("__idx") / size)
    part = lambda c, own: F.struct(c.alias("chunk"), F.lit(own).alias("own"))
    dealt = F.when(F.col("__idx") % size > size - most, F.array(part(chunk, True), part(chunk + 1, False))).otherwise(F.array(part(chunk, True)))
    rows = rows.withColumn("__part", F.explode(dealt)).withColumn("__chunk", F.col("__part.chunk")).withColumn("__own", F.col("__part.own")).drop("__part")
    kept = [c for c in rows.columns if c not in ("__idx", "__chunk", "__own")]
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__idx")
        for name, (column, width, least) in ranks.items():
            pdf[name] = trailing_ranks(pdf[column].to_numpy(float), width, least)
        return pdf.loc[pdf["__own"], [*kept, *ranks]]

    out = rows.groupBy(*BY, "__chunk").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), *(f"{c} double" for c in ranks)]))
    return out.select(*kept, *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ranks))


def z_score(x: Column, mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n >= 2) & (sd != 0), (x - mean) / sd)


def statistics(bars: DataFrame, step_s: int, fast: int = 24, slow: int = 96, least: int = 30) -> DataFrame:
    """Nine price statistics at each final bar over its last 720 bars, rounded to 8 places; null where there are too few."""
    o, w = _order(), _trailing(HISTORY)
    rows = bars.where("is_final").select(*BY, "open_time", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
    before = F.lag("close").over(o)
    rows = rows.withColumn("r", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))).withColumn("n", F.count(F.lit(1)).over(w))
    scale = (365 * 86_400 / step_s) ** 0.5 * 100
    for name, k in (("realized_vol", fast), ("realized_vol_slow", slow)):
        rows = rows.withColumn(name, F.when(F.col("n") > k, F.coalesce(F.stddev_samp("r").over(_trailing(k)), F.lit(0.0)) * scale))
    for k in (1, 24, 168):
        past = F.lag("close", k).over(o)
        rows = rows.withColumn(f"return{k}", F.when(past > 0, (F.col("close") / past - 1) * 100))
    prior = o.rowsBetween(-fast, -1)
    count, sd = F.count("volume").over(prior), F.stddev_samp("volume").over(prior)
    rows = rows.withColumn("volume_z", F.when(F.col("n") > fast, z_score(F.col("volume"), F.avg("volume").over(prior), sd, count)))
    # the rolling series inside the history: its first values lie k bars after the history's start
    inside = {"vol_percentile": ("realized_vol", HISTORY - fast, least), "vol_percentile_slow": ("realized_vol_slow", HISTORY - slow, least)}
    rows = with_trailing_ranks(rows, {"price_percentile": ("close", HISTORY, 1)} | inside)
    names = ["return1", "return24", "return168", "realized_vol", "realized_vol_slow", "vol_percentile", "vol_percentile_slow", "volume_z", "price_percentile"]
    return rows.select(*BY, "open_time", "close", *(F.round(F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)), 8).alias(c) for c in names))
