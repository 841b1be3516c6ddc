"""Fixed, epoch-aligned bar lengths and arithmetic on them (all as Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bar lengths in seconds.
SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def step(timeframe: Column) -> Column:
    """Length in seconds of a timeframe column."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv)), timeframe).cast("long")


def floor_time(ts: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def next_open(open_time: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.unix_seconds(open_time) + seconds)


def close_time(open_time: Column, seconds: Column | int) -> Column:
    """A bar closes a millisecond before the next one opens."""
    return F.timestamp_millis(F.unix_millis(next_open(open_time, seconds)) - 1)


def last_closed_open(at: Column, seconds: Column | int) -> Column:
    """Open time of the last bar that is complete at ``at``."""
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.unix_seconds(floor_time(at, seconds)) - seconds)


def base_bars(target: str, base: str) -> int:
    """How many base bars make a complete target bar."""
    if SECONDS[target] <= SECONDS[base] or SECONDS[target] % SECONDS[base]:
        raise ValueError(f"{target} is not a multiple of {base}")
    return SECONDS[target] // SECONDS[base]


def bar_shape() -> dict[str, Column]:
    """Range, direction and approximate vwap of a bar row."""
    vwap = F.when(F.col("volume") > 0, F.round(F.col("quote_volume").cast("double") / F.col("volume").cast("double"), 12)).otherwise(F.col("close").cast("double"))
    return {"bar_range": F.col("high") - F.col("low"), "is_bullish": F.col("close") > F.col("open"), "vwap_approx": vwap}
