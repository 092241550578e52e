"""Scalar price math: every function returns a Column and stays inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candle_features(bars: DataFrame) -> DataFrame:
    """Median, body ends and length; a bar whose high is under its low is rejected."""
    return bars.where(F.col("high") >= F.col("low")).withColumns(
        {
            "median": (F.col("high") + F.col("low")) / 2,
            "body_low": F.least("open", "close"),
            "body_high": F.greatest("open", "close"),
            "candle_length": F.greatest(F.col("high") - F.col("low"), F.lit(0.0)),
        }
    )


def is_strength_bar(up: bool) -> Column:
    length = F.col("high") - F.col("low")
    edge = F.col("high") if up else F.col("low")
    return F.coalesce((length > 0) & (F.abs(F.col("close") - edge) / F.nullif(length, F.lit(0.0)) < 0.1), F.lit(False))


def round_price(x: Column, digits: Column | int, up: bool | Column) -> Column:
    """Toward zero for a rising setup, toward plus infinity for a falling one."""
    scale = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    scaled = x * scale
    rising = F.lit(up) if isinstance(up, bool) else up
    to_zero = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return F.when(rising, to_zero).otherwise(F.ceil(scaled)).cast("double") / scale


def round_beyond(x: Column, digits: int, up: Column) -> Column:
    """Down for a rising setup, up for a falling one, on either side of zero."""
    scaled = x * F.lit(10.0**digits)
    return F.when(up, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("double") / F.lit(10.0**digits)


def position_volume(risk_percent: Column, balance: Column, range_pips: Column, pip_value: Column) -> Column:
    return risk_percent / (F.abs(range_pips) * pip_value / balance * 100)


def cap_volume(
    volume: Column, risk_percent: Column, balance: Column, max_money: float, lot_size: float, max_lots: float
) -> Column:
    """Scale down to the money limit per setup; null (rejected) beyond the lot limit."""
    if max_money > 0:
        over = risk_percent * balance / 100 / F.lit(float(max_money))
        volume = F.when(over > 1, volume / over).otherwise(volume)
    return F.when(volume / F.lit(float(lot_size)) <= max_lots, volume)


def is_big_spread(spread: Column, tp: Column, sl: Column, max_ratio: float = 0.2) -> Column:
    span = F.abs(tp - sl)
    return (spread > 0) & ((span == 0) | (spread / F.nullif(span, F.lit(0.0)) > max_ratio))


def has_trade_break(start: Column, end: Column, sessions: Sequence[tuple[int, int, int, int]]) -> Column:
    """True unless [start, end] lies strictly inside one weekly session shortened by an hour at both ends.

    A session is (start day, start second, end day, end second), Sunday = 0; times are shifted to
    seconds since the start's own week began, so no join is needed for the handful of sessions.
    """
    if not sessions:
        return F.lit(False)
    week_start = F.unix_seconds(F.date_trunc("day", start)) - (F.dayofweek(start) - 1) * 86400
    s = F.unix_micros(start.cast("timestamp")) - week_start * 1000000
    e = F.unix_micros(end.cast("timestamp")) - week_start * 1000000
    inside = F.lit(False)
    for d1, t1, d2, t2 in sessions:
        inside = inside | ((s > (d1 * 86400 + t1 + 3600) * 1000000) & (e < (d2 * 86400 + t2 - 3600) * 1000000))
    return ~inside


def risk_reward(is_long: Column, entry: Column, tp: Column, sl: Column) -> Column:
    """Null when a level is on the wrong side of the entry."""
    ok = (is_long & (tp > entry) & (sl < entry)) | (~is_long & (tp < entry) & (sl > entry))
    return F.when(ok, F.abs(tp - entry) / F.abs(entry - sl))


def break_even_price(tp: Column, sl: Column, ratio: float | Column) -> Column:
    return sl + F.abs(tp - sl) * ratio * F.when(tp > sl, 1).otherwise(-1)


def within(actual: Column, expected: Column, error_percent: float | Column = 20.0) -> Column:
    err = (F.lit(error_percent) if isinstance(error_percent, (int, float)) else error_percent) / F.lit(100.0)
    return (actual <= expected * (F.lit(1.0) + err)) & (actual >= expected * (F.lit(1.0) - err))


def within_any(actual: Column, expected: Column, error_percent: float = 20.0) -> Column:
    return F.coalesce(F.exists(expected, lambda e: within(actual, e, error_percent)), F.lit(False))


def relative_error(actual: Column, expected: Column) -> Column:
    """Smallest |1 - actual/expected| over the list; null for an empty list."""
    return F.array_min(F.transform(expected, lambda e: F.abs(F.lit(1.0) - actual / e)))


def levels_between(levels: Column, lo: Column, hi: Column) -> Column:
    """From a sorted array: skip while below ``lo``, then take while not above ``hi``."""
    return F.filter(levels, lambda v: (v >= lo) & (v <= hi))


def ratio_similarity(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def entropy_unevenness(values: Column) -> Column:
    """1 - H/Hmax of the shares of an array, log base 2; 0 for an empty or zero-sum array."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    h = F.aggregate(
        values, F.lit(0.0), lambda acc, v: acc - F.when(v / total > 0, (v / total) * F.log2(v / total)).otherwise(0.0)
    )
    return F.when((F.size(values) == 0) | (total == 0), F.lit(0.0)).otherwise(F.lit(1.0) - h / F.log2(F.size(values).cast("double")))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs (x, y), closed from the last point to the first."""
    ring = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(area)


def line_at(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    return F.when(x1 == x2, y1).otherwise(y1 + (y2 - y1) / (x2 - x1) * (x - x1))


def normalize(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low))
