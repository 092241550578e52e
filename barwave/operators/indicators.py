"""Indicators: bounded frames as window stages, recurrences as folds.

A window stage is a function WindowSpec -> columns, to be given to ``series.framed``; the number
of rows it reaches back is returned beside it where it is not simply its period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.operators.series import Fold, fold_series, framed

ZERO = F.lit


def median_price() -> Column:
    return (F.col("high") + F.col("low")) / 2


def _when_full(p: int, c: Column) -> Column:
    """A moving value exists from bar p on; bar 0 never enters a window."""
    return F.when(F.col("bar_index") >= p, c)


def sma_stage(p: int = 14, out: str = "sma", price: str = "close"):
    return lambda w: {out: _when_full(p, F.sum(price).over(w.rowsBetween(-(p - 1), 0)) / F.lit(float(p)))}


def sma(bars: DataFrame, p: int = 14, out: str = "sma", price: str = "close") -> DataFrame:
    return framed(bars, p, 0, sma_stage(p, out, price))


def true_range_stage(out: str = "tr"):
    def stage(w):
        prev = F.lag("close").over(w)
        return {out: F.greatest("high", prev) - F.least("low", prev)}

    return stage


def atr_stages(p: int = 14, out: str = "atr"):
    return true_range_stage("tr"), sma_stage(p, out, "tr")


def atr(bars: DataFrame, p: int = 14, out: str = "atr") -> DataFrame:
    return framed(bars, p + 1, 0, *atr_stages(p, out))


def stddev_stages(p: int = 14, out: str = "stddev"):
    """Spread of the median price around the SMA of the close; absent SMA reads 0; divisor is always p."""

    def spread(w):
        # bars of index 0 are left out of the sum, which is still divided by p
        frame = F.collect_list(F.when(F.col("bar_index") >= 1, median_price())).over(w.rowsBetween(-(p - 1), 0))
        mid = F.coalesce("_sma", F.lit(0.0))
        total = F.aggregate(frame, F.lit(0.0), lambda acc, m: acc + (m - mid) * (m - mid))
        return {out: F.sqrt(total / F.lit(float(p)))}

    return sma_stage(p, "_sma"), spread


def stddev(bars: DataFrame, p: int = 14, out: str = "stddev") -> DataFrame:
    return framed(bars, p, 0, *stddev_stages(p, out)).drop("_sma")


def bollinger_stages(p: int = 20, k: float = 2.0):
    def bands(_):
        mid, dev = F.col("_sma"), F.lit(k) * F.col("_dev")
        return {"bb_mid": mid, "bb_top": mid + dev, "bb_bottom": mid - dev}

    return (*stddev_stages(p, "_dev"), bands)


def bollinger(bars: DataFrame, p: int = 20, k: float = 2.0) -> DataFrame:
    return framed(bars, p, 0, *bollinger_stages(p, k)).drop("_sma", "_dev")


def awesome_stages(out: str = "ao"):
    def diff(_):
        return {out: F.coalesce("_sma5", F.lit(0.0)) - F.coalesce("_sma34", F.lit(0.0))}

    return sma_stage(5, "_sma5"), sma_stage(34, "_sma34"), diff


def awesome_oscillator(bars: DataFrame, out: str = "ao") -> DataFrame:
    return framed(bars, 34, 0, *awesome_stages(out)).drop("_sma5", "_sma34")


def alligator_stages(jaw: int = 13, teeth: int = 8, lips: int = 5, out: str = "alligator"):
    def state(_):
        j, t, l = (F.coalesce(c, F.lit(0.0)) for c in ("_jaw", "_teeth", "_lips"))
        return {out: F.when((l > j) & (l > t), 1).when((l < j) & (l < t), -1).otherwise(0)}

    return sma_stage(jaw, "_jaw"), sma_stage(teeth, "_teeth"), sma_stage(lips, "_lips"), state


def zone_alligator(bars: DataFrame, out: str = "alligator") -> DataFrame:
    return framed(bars, 13, 0, *alligator_stages(out=out)).drop("_jaw", "_teeth", "_lips")


def price_speed_stage(period: int, out: str = "speed"):
    """Percent change against the close ``period`` bars back, or the first close of the series."""

    def stage(w):
        past = F.coalesce(F.lag("close", period).over(w), F.first("close").over(w.rowsBetween(-period, 0)))
        return {out: F.lit(100.0) * (F.col("close") - past) / past}

    return stage


def price_speed(bars: DataFrame, period: int, out: str = "speed") -> DataFrame:
    return framed(bars, period, 0, price_speed_stage(period, out))


def trend_name(c: Column) -> Column:
    return F.when(c > 0, "BULLISH").when(c < 0, "BEARISH").otherwise("NO_TREND")


def spike_of(value: Column) -> Column:
    """High when the value is on or above the top band, Low on or below the bottom one; absent bands read 0."""
    top, bottom = F.coalesce("bb_top", F.lit(0.0)), F.coalesce("bb_bottom", F.lit(0.0))
    return F.when(value >= top, "High").when(value <= bottom, "Low").otherwise("NoSpike")


# ---- recurrences -------------------------------------------------------------------------------


def ema_fold(p: int = 14) -> Fold:
    alpha = 2.0 / (p + 1)

    def step(state, _i, close):
        (prev,) = state
        now = close if not prev else close * alpha + prev * (1.0 - alpha)
        return (now,), (now,)

    return Fold(("close",), "ema double", "ema double", (None,), step, warmup=40 * p, tolerance=1e-14)


def rsi_fold(p: int = 14) -> Fold:
    alpha = 2.0 / ((2 * p - 1) + 1)

    def step(state, _i, high, low):
        prev, gain, loss = state
        price = (high + low) / 2
        if prev is None:
            return (price, None, None), None
        up, down = max(price - prev, 0.0), max(prev - price, 0.0)
        gain = up if gain is None else up * alpha + gain * (1.0 - alpha)
        loss = down if loss is None else down * alpha + loss * (1.0 - alpha)
        if loss == 0.0:
            value = 50 if gain == 0.0 else 100
        else:
            value = round(100 - 100 / (1 + gain / loss))  # half to even
        return (price, gain, loss), (value,)

    return Fold(
        ("high", "low"), "price double, gain double, loss double", "rsi int", (None, None, None), step,
        warmup=40 * p, tolerance=1e-14,
    )


def supertrend_fold(mult: float = 3.0) -> Fold:
    """Needs a column ``atr`` (absent = 0). State: band values, direction and flat-bar count of the bar before."""

    def step(state, i, high, low, close, atr):
        up0, down0, dir0, flat0 = state
        median = (high + low) / 2
        width = mult * (0.0 if atr is None or atr != atr else atr)
        up, down = median + width, median - width
        if dir0 is None:
            return (up, down, 1, 0), (up, down, 1, 0)
        now = 1 if close > up0 else -1 if close < down0 else dir0
        if now < 0 and dir0 < 0:
            up = min(up, up0)
        if now > 0 and dir0 > 0:
            down = max(down, down0)
        held = down == down0 if now > 0 else up == up0
        flat = flat0 + 1 if held else 0
        return (up, down, now, flat), (up, down, now, flat)

    ddl = "up double, down double, direction int, flat_bars int"
    return Fold(("high", "low", "close", "atr"), ddl, ddl, (None,) * 4, step, warmup=512)


def ema(bars: DataFrame, p: int = 14) -> DataFrame:
    return fold_series(bars, ema_fold(p))[0]


def rsi(bars: DataFrame, p: int = 14) -> DataFrame:
    return fold_series(bars, rsi_fold(p))[0]


def supertrend(bars: DataFrame, mult: float = 3.0, p: int = 10) -> DataFrame:
    return fold_series(atr(bars, p), supertrend_fold(mult))[0]


# ---- whole-series estimates --------------------------------------------------------------------

# fixed values
SAMPLE_BARS, MIN_SAMPLE, FALLBACK_BPS = 8000, 200, 12.0
PERIOD_RULES = {"impulse": (3.3, 8, 120), "triangle": (0.7, 5, 20)}


def range_bps() -> Column:
    return F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close") * 10000.0)


def median_bar_bps(bars: DataFrame) -> DataFrame:
    """Upper median of the bar range over the last bars of each series."""
    last = bars.groupBy("symbol", "tf").agg((F.max("bar_index") + 1).alias("_n"))
    tail = bars.join(last, ["symbol", "tf"]).where(F.col("bar_index") >= F.col("_n") - SAMPLE_BARS)
    # at most SAMPLE_BARS values per key by the filter above
    g = tail.groupBy("symbol", "tf", "_n").agg(F.sort_array(F.collect_list(range_bps())).alias("_v"))
    pick = F.try_element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int"))
    value = F.when(F.col("_n") < MIN_SAMPLE, F.lit(FALLBACK_BPS)).otherwise(F.coalesce(pick, F.lit(FALLBACK_BPS)))
    return g.select("symbol", "tf", value.alias("median_bps"))


def auto_period(bps: Column, kind: str) -> Column:
    coef, lo, hi = PERIOD_RULES[kind]
    return F.least(F.greatest(F.bround(F.lit(coef) * bps, 0).cast("int"), F.lit(lo)), F.lit(hi))


def period_ladder(base: Column, ratios: tuple[float, ...]) -> Column:
    """Distinct rounded multiples of the base period, at least 1."""
    return F.array_distinct(
        F.transform(F.array(*[F.lit(r) for r in ratios]), lambda r: F.greatest(F.bround(base * r, 0).cast("int"), F.lit(1)))
    )


def analysis_window(bars: DataFrame, n: int = 200) -> DataFrame:
    """In the last n bars: first bar of the highest high and of the lowest low; the earlier one is the start."""
    last = bars.groupBy("symbol", "tf").agg(F.max("bar_index").alias("end_bar"))
    tail = bars.join(last, ["symbol", "tf"]).where(F.col("bar_index") > F.col("end_bar") - n)
    first = -F.col("bar_index")
    g = tail.groupBy("symbol", "tf", "end_bar").agg(
        F.max_by("bar_index", F.struct("high", first)).alias("high_bar"),
        F.max_by("bar_index", F.struct(-F.col("low"), first)).alias("low_bar"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
    )
    return g.withColumn("start_bar", F.least("high_bar", "low_bar")).withColumn("is_up", F.col("low_bar") < F.col("high_bar"))
