"""Operators over two time frames and over price profiles; pivots refined on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwave.operators import indicators as ind
from barwave.operators.joins import range_join
from barwave.operators.pivots import fractal_pivots_pine, segments, with_pivot_seq
from barwave.operators.series import KEY, Fold, fold_series, framed
from barwave.session import cut
from barwave.sources.ticks import frame_start
from barwave.sources.timeframes import SPAN


def is_high_first(bars: DataFrame, lower: DataFrame, tf: str) -> DataFrame:
    """Whether a bar's high came before its low, seen on the lower frame (null without lower bars).

    The first lower bar that holds exactly one of the two decides; none means no.
    """
    inner = lower.select("symbol", frame_start("open_time", tf).alias("open_time"), F.col("bar_index").alias("_i"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    j = bars.join(inner, ["symbol", "open_time"])
    h, l = F.col("_h") == F.col("high"), F.col("_l") == F.col("low")
    first = F.min(F.when(h != l, F.struct(F.col("_i").alias("i"), h.alias("h"))))
    return j.groupBy(*KEY, "bar_index").agg(F.coalesce(first["h"], F.lit(False)).alias("is_high_first"))


def exact_extrema(bars: DataFrame, order: DataFrame) -> DataFrame:
    """Two points per bar, the one met first in front."""
    j = bars.join(order, [*KEY, "bar_index"])
    up = F.col("is_high_first")
    pts = F.array(
        F.struct(F.lit(0).alias("pos"), F.when(up, F.col("high")).otherwise(F.col("low")).alias("value"), up.alias("is_high")),
        F.struct(F.lit(1).alias("pos"), F.when(up, F.col("low")).otherwise(F.col("high")).alias("value"), (~up).alias("is_high")),
    )
    return j.select(*KEY, "bar_index", F.explode(pts).alias("_p")).select(*KEY, "bar_index", "_p.*")


def mtf_trend(lower: DataFrame, main: DataFrame, higher: DataFrame, lower_tf: str, main_tf: str, higher_tf: str) -> DataFrame:
    """Trend of the main frame where the alligators of all three frames agree; a missing bar has no trend.

    Lower frame: its last bar inside the main bar. Higher frame: the bar opening with the main bar,
    else the bar one higher span before the main bar's own open. All look-ups are exact times.
    """
    state = lambda b, out: ind.zone_alligator(b, out)
    m = state(main, "m").select(*KEY, "bar_index", "open_time", "m")
    low = state(lower, "l").select("symbol", (F.col("open_time") - F.expr(f"INTERVAL {SPAN[main_tf] - SPAN[lower_tf]} SECONDS")).alias("open_time"), "l")
    hi = state(higher, "h")
    here = hi.select("symbol", "open_time", F.col("h").alias("h0"))
    before = hi.select("symbol", (F.col("open_time") + F.expr(f"INTERVAL {SPAN[higher_tf]} SECONDS")).alias("open_time"), F.col("h").alias("h1"))
    j = m.join(low, ["symbol", "open_time"], "left").join(here, ["symbol", "open_time"], "left").join(before, ["symbol", "open_time"], "left")
    z = F.lit(0)
    vals = [F.coalesce("l", z), F.col("m"), F.coalesce("h0", "h1", z)]
    total = vals[0] + vals[1] + vals[2]
    return j.select(*KEY, "bar_index", F.when(total == 3, "BULLISH").when(total == -3, "BEARISH").otherwise("NO_TREND").alias("trend"))


def volume_profile_groups(profile: DataFrame) -> DataFrame:
    """Runs of neighbouring profile entries whose value is at least the upper median.

    ``profile``: symbol, key, value - one row per price level, so it is bounded by the price range.
    """
    by = Window.partitionBy("symbol")
    rank = F.row_number().over(by.orderBy("value"))
    p = profile.withColumns({"_k": rank, "_n": F.count("*").over(by)})
    p = p.withColumn("_med", F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("value"))).over(by))
    p = p.withColumn("_in", F.col("value") >= F.col("_med"))
    start = F.col("_in") & ~F.coalesce(F.lag("_in").over(by.orderBy("key")), F.lit(False))
    p = p.withColumn("grp", F.sum(start.cast("int")).over(by.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    return p.where("_in").groupBy("symbol", "grp").agg(F.min("key").alias("from_key"), F.max("key").alias("to_key"), F.count("*").alias("entries"), F.sum("value").alias("total"))


def _depth_zigzag_fold(dev: float) -> Fold:
    """Pivots of one side replace each other when further out; a turn needs ``dev`` percent."""

    def step(state, i, is_high, is_low, high, low):
        side, value, at = state
        done = None
        for hit, this, price in ((is_high, True, high), (is_low, False, low)):
            if not hit:
                continue
            if side is None:
                side, value, at = this, price, i
            elif side == this:
                if (price > value) if this else (price < value):
                    value, at = price, i
            elif done is None and abs(price - value) / value * 100.0 >= dev:
                done = (at, value, side)
                side, value, at = this, price, i
        return (side, value, at), done

    return Fold(
        ("is_high", "is_low", "high", "low"), "up boolean, ext double, at long", "pivot_bar long, value double, is_high boolean", (None,) * 3, step
    )


def zigzag_volume(bars: DataFrame, dev: float = 0.5, depth: int = 10) -> DataFrame:
    """Legs of the depth zigzag with the volume traded after their start, the unfinished one included."""
    marks = fractal_pivots_pine(bars, depth // 2).select(*KEY, "bar_index", "is_high", "is_low", "high", "low")
    out, fin = fold_series(marks, _depth_zigzag_fold(dev))
    done = out.select(*KEY, F.col("pivot_bar").alias("bar_index"), "value", "is_high", F.lit(False).alias("is_last"))
    last = fin.where(F.col("ext").isNotNull()).select(*KEY, F.col("at").alias("bar_index"), F.col("ext").alias("value"), F.col("up").alias("is_high"), F.lit(True).alias("is_last"))
    legs = segments(done.unionByName(last)).withColumn("_from", F.col("start_bar") + 1)
    v = range_join(legs, bars.select(*KEY, "bar_index", "volume"), "_from", "end_bar").groupBy(*KEY, "seq").agg(F.sum("volume").alias("leg_volume"))
    return legs.join(v, [*KEY, "seq"]).select(*KEY, "seq", "start_bar", "end_bar", "start_value", "end_value", "leg_volume")


def _corridor_pass(pivots: DataFrame, bars: DataFrame, forward: bool) -> DataFrame:
    """Move inner pivots to the true extreme of the leg before (``forward`` False) or after them."""

    def stage(w):
        return {f"_{n}{k}": f(c).over(w) for k, f in (("0", F.lag), ("1", F.lead)) for n, c in (("b", "bar_index"), ("v", "value"))}

    p = framed(pivots, 1, 1, stage, order="seq")
    inner = p.where(F.col("_b0").isNotNull() & F.col("_b1").isNotNull())
    if forward:
        up, frm, to = F.col("_v1") < F.col("value"), F.col("bar_index"), F.col("_b1")
    else:
        up, frm, to = F.col("value") > F.col("_v0"), F.col("_b0") + 1, F.col("bar_index")
    span = inner.select(*KEY, "seq", F.col("value").alias("_now"), F.col("_b1").alias("_nb"), up.alias("_up"), frm.alias("_f"), to.alias("_t"))
    price = F.when(F.col("_up"), F.col("high")).otherwise(-F.col("low"))
    now = F.when(F.col("_up"), F.col("_now")).otherwise(-F.col("_now"))
    best = range_join(span, bars.select(*KEY, "bar_index", "high", "low"), "_f", "_t").where(price > now).groupBy(*KEY, "seq", "_up", "_nb").agg(
        F.max(F.struct(price.alias("v"), (-F.col("bar_index")).alias("i"))).alias("_x")
    )
    best = best.where(-F.col("_x.i") != F.col("_nb")).select(*KEY, "seq", F.when(F.col("_up"), F.col("_x.v")).otherwise(-F.col("_x.v")).alias("_nv"), (-F.col("_x.i")).alias("_ni"))
    j = pivots.join(best, [*KEY, "seq"], "left")
    return j.select(*KEY, "seq", F.coalesce("_ni", "bar_index").alias("bar_index"), F.coalesce("_nv", "value").alias("value"), F.col("_ni").isNotNull().alias("_moved"))


def refine_corridors(pivots: DataFrame, bars: DataFrame, passes: int = 16) -> DataFrame:
    """Alternate both moves until no pivot moves; every pass is materialised."""
    p = cut(with_pivot_seq(pivots).select(*KEY, "seq", "bar_index", "value"))
    for _ in range(passes):
        a = cut(_corridor_pass(p, bars, False))
        b = cut(_corridor_pass(a.drop("_moved"), bars, True))
        moved = not a.where("_moved").isEmpty() or not b.where("_moved").isEmpty()
        p = b.drop("_moved")
        if not moved:
            break
    return p
