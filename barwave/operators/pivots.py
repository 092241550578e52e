"""Pivots, zigzags and legs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.operators.series import BLOCK, KEY, Fold, block_of, fold_series, framed, with_seq

# ---- fractal pivots ----------------------------------------------------------------------------


def fractal_flags(bars: DataFrame, period: int) -> DataFrame:
    """Per bar: whether the right edge allows a pivot, and the nearest earlier bar that forbids it.

    The right frame holds ``period - 1`` bars.  Bars without a full frame of ``period`` bars on
    both sides are dropped.
    """

    def stage(w):
        left, right = w.rowsBetween(-period, -1), w.rowsBetween(1, period - 1)
        past = F.collect_list(F.struct("bar_index", "high", "low")).over(left)
        beyond = lambda test: F.array_max(F.transform(F.filter(past, test), lambda b: b["bar_index"]))
        if period > 1:
            right_high, right_low = F.max("high").over(right), F.min("low").over(right)
        else:
            right_high = right_low = F.lit(None).cast("double")
        return {
            "_rh": F.coalesce(right_high <= F.col("high"), F.lit(True)),
            "_rl": F.coalesce(right_low >= F.col("low"), F.lit(True)),
            "_bh": F.coalesce(beyond(lambda b: b["high"] > F.col("high")), F.lit(-1).cast("long")),
            "_bl": F.coalesce(beyond(lambda b: b["low"] < F.col("low")), F.lit(-1).cast("long")),
            "_next": F.lead("bar_index", period).over(w),
        }

    flagged = framed(bars, period, period, stage)
    return flagged.where((F.col("bar_index") >= period) & F.col("_next").isNotNull()).drop("_next")


def fractal_fold(period: int) -> Fold:
    """The left edge of a bar's window is cut at the last pivot found, which makes the scan ordered."""

    def step(state, i, right_high, right_low, beyond_high, beyond_low):
        (last,) = state
        left = max(i - period, last)
        is_high, is_low = right_high and beyond_high < left, right_low and beyond_low < left
        if is_high or is_low:
            return (i,), (is_high, is_low)
        return state, None

    return Fold(("_rh", "_rl", "_bh", "_bl"), "last long", "is_high boolean, is_low boolean", (0,), step, warmup=16 * period)


def fractal_pivots(bars: DataFrame, period: int) -> DataFrame:
    """Bars that are a high and/or low pivot: keys, bar_index, is_high, is_low."""
    return fold_series(fractal_flags(bars, period), fractal_fold(period))[0]


def fractal_pivots_pine(bars: DataFrame, depth: int) -> DataFrame:
    """Symmetric frame without the cut: strictly beyond the newer side, not below the older side."""

    def stage(w):
        old, new = w.rowsBetween(-depth, -1), w.rowsBetween(1, depth)
        return {
            "is_high": (F.max("high").over(old) <= F.col("high")) & (F.max("high").over(new) < F.col("high")),
            "is_low": (F.min("low").over(old) >= F.col("low")) & (F.min("low").over(new) > F.col("low")),
            "_full": F.lag("bar_index", depth).over(w).isNotNull() & F.lead("bar_index", depth).over(w).isNotNull(),
        }

    p = framed(bars, depth, depth, stage)
    return p.where(F.col("_full") & (F.col("is_high") | F.col("is_low"))).drop("_full")


# ---- zigzags -----------------------------------------------------------------------------------


def zigzag_fold() -> Fold:
    """Percent zigzag; ``dev`` (percent) is a column, so one pass can hold many variants.

    Emits the finished extremum when the direction flips.
    """

    def step(state, i, high, low, dev):
        up, ext, at = state
        if ext is None:
            return (up, low if up else high, i), None
        if up:
            if high >= ext:
                return (True, high, i), None
            if low <= ext * (1.0 - dev * 0.01):
                return (False, low, i), (at, ext, True)
        else:
            if low <= ext:
                return (False, low, i), None
            if high >= ext * (1.0 + dev * 0.01):
                return (True, high, i), (at, ext, False)
        return state, None

    return Fold(
        ("high", "low", "dev"), "up boolean, ext double, at long", "pivot_bar long, value double, is_high boolean",
        (False, None, None), step,
    )


def zigzag_bps_fold() -> Fold:
    """As the percent zigzag with ``scale`` basis points; the first bar seeds its high and is then processed."""

    def step(state, i, high, low, scale):
        up, ext, at = state
        if ext is None:
            ext, at = high, i
        if up:
            if high >= ext:
                return (True, high, i), None
            if low <= ext * (1.0 + scale * -0.0001):
                return (False, low, i), (at, ext, True)
        else:
            if low <= ext:
                return (False, low, i), None
            if high >= ext * (1.0 + scale * 0.0001):
                return (True, high, i), (at, ext, False)
        return (up, ext, at), None

    return Fold(
        ("high", "low", "scale"), "up boolean, ext double, at long", "pivot_bar long, value double, is_high boolean",
        (False, None, None), step,
    )


def _as_pivots(outputs: DataFrame, finals: DataFrame, keys: Sequence[str]) -> DataFrame:
    done = outputs.select(*keys, F.col("pivot_bar").alias("bar_index"), "value", "is_high", F.lit(False).alias("is_last"))
    last = finals.where(F.col("ext").isNotNull()).select(
        *keys, F.col("at").alias("bar_index"), F.col("ext").alias("value"), F.col("up").alias("is_high"), F.lit(True).alias("is_last")
    )
    return done.unionByName(last)


def zigzag_pct(bars: DataFrame, dev: float | Column | str, keys: Sequence[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Pivots of the percent zigzag: keys, bar_index, value, is_high, is_last."""
    d = F.lit(float(dev)) if isinstance(dev, (int, float)) else dev if isinstance(dev, Column) else F.col(dev)
    out, fin = fold_series(bars.withColumn("dev", d.cast("double")) if dev != "dev" else bars, zigzag_fold(), keys, block=block)
    return _as_pivots(out, fin, keys)


def zigzag_bps(bars: DataFrame, scale: int | Column, keys: Sequence[str] = KEY, block: int = BLOCK) -> DataFrame:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    out, fin = fold_series(bars.withColumn("scale", s.cast("double")), zigzag_bps_fold(), keys, block=block)
    return _as_pivots(out, fin, keys)


def pivot_zigzag_fold() -> Fold:
    """Alternate fractal pivots; a bar that is both never flips twice."""

    def step(state, i, is_high, is_low, high, low):
        up, ext, at = state
        was_up, done = up, None
        if is_high:
            if up:
                if ext is None or high >= ext:
                    ext, at = high, i
            else:
                done = (at, ext, False) if ext is not None else None
                up, ext, at = True, high, i
        if is_low:
            if not up:
                if ext is None or low <= ext:
                    ext, at = low, i
            elif was_up:
                done = (at, ext, True) if ext is not None else None
                up, ext, at = False, low, i
        return (up, ext, at), done

    return Fold(
        ("is_high", "is_low", "high", "low"), "up boolean, ext double, at long",
        "pivot_bar long, value double, is_high boolean", (False, None, None), step,
    )


def zigzag_pivots(bars: DataFrame, period: int) -> DataFrame:
    marks = fractal_pivots(bars, period).join(bars.select(*KEY, "bar_index", "high", "low"), [*KEY, "bar_index"])
    out, fin = fold_series(marks, pivot_zigzag_fold())
    return _as_pivots(out, fin, KEY)


def pivot_order() -> Column:
    """Two pivots may share a bar, the high first."""
    return F.col("bar_index") * 2 + F.when(F.col("is_high"), 0).otherwise(1)


def with_pivot_seq(pivots: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return with_seq(pivots.withColumn("_ord", pivot_order()), keys, "_ord", block=2 * BLOCK).drop("_ord")


def segments(pivots: DataFrame, keys: Sequence[str] = KEY, wanted: Sequence[str] = ()) -> DataFrame:
    """Legs between consecutive pivots, numbered by the pivot they start from.

    The next pivot of the last one in a block sits in the following block: leads run over pivot
    numbers, blocked with a one-row halo.
    """
    p = pivots if "seq" in pivots.columns else with_pivot_seq(pivots, keys)

    def stage(w):
        return {
            "end_bar": F.lead("bar_index").over(w),
            "end_value": F.lead("value").over(w),
            "open_end": F.lead("is_last").over(w),
        }

    legs = framed(p, 0, 1, stage, keys=keys, order="seq").where(F.col("end_bar").isNotNull())
    return legs.select(
        *keys, *wanted, "seq",
        F.col("bar_index").alias("start_bar"), F.col("value").alias("start_value"), "end_bar", "end_value",
        (F.col("end_value") > F.col("value")).alias("is_up"),
        F.abs(F.col("end_value") - F.col("value")).alias("length"),
        (F.col("end_bar") - F.col("bar_index") + 1).alias("bars"),
        "open_end",
    )


def alternating_fold() -> Fold:
    """Merge equal values and runs of one direction, keeping the extreme end of each run."""

    def step(state, i, value):
        prev, prev_at, last, last_at = state
        if last is None:
            return (None, None, value, i), None
        if value == last:
            return state, None
        if prev is None:
            return (last, last_at, value, i), (last_at, last)
        if (last > prev) == (value > last):
            return (prev, prev_at, value, i), None
        return (last, last_at, value, i), (last_at, last)

    return Fold(
        ("value",), "prev double, prev_at long, last double, last_at long", "point_bar long, point_value double",
        (None,) * 4, step,
    )


def reduce_to_alternating(points: DataFrame, keys: Sequence[str] = KEY, order: str = "bar_index") -> DataFrame:
    """Strictly alternating points from any ordered point list."""
    out, fin = fold_series(points, alternating_fold(), keys, order)
    done = out.select(*keys, F.col("point_bar").alias(order), F.col("point_value").alias("value"))
    last = fin.where(F.col("last").isNotNull()).select(*keys, F.col("last_at").alias(order), F.col("last").alias("value"))
    return done.unionByName(last)


# ---- sweeps ------------------------------------------------------------------------------------


def with_grid(df: DataFrame, name: str, values: Column) -> DataFrame:
    """Every row once per grid value (a narrow explode of a constant array, not a join)."""
    return df.withColumn(name, F.explode(values))


def deviation_counts(bars: DataFrame, devs: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Pivot count per key and deviation."""
    keys = list(keys)
    grid = with_grid(bars, "dev", devs)
    return zigzag_pct(grid, "dev", [*keys, "dev"]).groupBy(*keys, "dev").agg(F.count("*").alias("pivots"))


DOUBLING = tuple(0.1 * 2.0**i for i in range(9))  # 0.1 .. 25.6, then 50


def optimal_deviation(bars: DataFrame, min_dev: float = 0.001, keys: Sequence[str] = KEY) -> DataFrame:
    """Knee of the pivot-count curve over a logarithmic sweep below the first deviation with two pivots."""
    keys = list(keys)
    counts = deviation_counts(bars, F.array(*[F.lit(d) for d in DOUBLING]), keys)
    upper = counts.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("pivots") <= 2, F.col("dev"))), F.lit(50.0)).alias("upper")
    )
    steps = F.greatest(F.lit(20), F.floor(F.log(F.col("upper") / min_dev) / F.log(F.lit(1.2))).cast("int"))
    ratio = F.pow(F.lit(min_dev) / F.col("upper"), F.lit(1.0) / F.col("steps"))
    grid = (
        upper.withColumn("steps", steps)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps"))))
        .withColumn(
            "dev",
            F.when(F.col("step") == F.col("steps"), F.lit(min_dev)).otherwise(
                F.greatest(F.col("upper") * F.pow(ratio, F.col("step").cast("double")), F.lit(min_dev))
            ),
        )
    )
    # one row per (key, step): joined by key, then folded per (key, step)
    swept = bars.select(*keys, "bar_index", "high", "low").join(grid.select(*keys, "step", "dev"), keys)
    found = zigzag_pct(swept, "dev", [*keys, "step"]).groupBy(*keys, "step").agg(F.count("*").alias("pivots"))
    curve = grid.join(found, [*keys, "step"])
    ends = curve.groupBy(*keys).agg(
        F.min_by("pivots", "step").alias("_lo"), F.max_by("pivots", "step").alias("_hi"),
        F.min_by("dev", "step").alias("_d0"), F.max_by("dev", "step").alias("_dn"),
    )
    x = (F.log("dev") - F.log("_d0")) / (F.log("_dn") - F.log("_d0"))
    y = (F.col("pivots") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    scored = curve.join(ends, keys).withColumn("_dist", F.when(F.col("_hi") > F.col("_lo"), F.round(y - x, 12)))
    best = scored.groupBy(*keys).agg(
        F.max_by("dev", F.struct(F.coalesce("_dist", F.lit(-9.0)), -F.col("step"))).alias("_knee"),
        F.first("_d0").alias("_d0"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
    )
    return best.select(*keys, F.when(F.col("_hi") <= F.col("_lo"), F.col("_d0")).otherwise(F.col("_knee")).alias("deviation"))
