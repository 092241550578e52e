"""Statistics of a move between two pivots (a leg).

Legs carry symbol, tf, seq, start_bar, start_value, end_bar, end_value, is_up, length.  All metrics
start from one bucketed join of legs and bars.  Prices are mirrored for falling legs (``main`` is
the side of the move, ``counter`` the other side), so one formula serves both directions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.operators.joins import first_hit, range_join
from barwave.operators.series import KEY, Fold, block_of, fold_series, framed, with_seq

from barwave.session import cut

LEG = ["symbol", "tf", "seq"]
LEG_COLS = ["start_bar", "start_value", "end_bar", "end_value", "is_up", "length"]
PIECE = 1024


def leg_bars(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per (leg, bar inside it, ends included)."""
    l = legs.select(*LEG, *LEG_COLS)
    b = bars.select(*KEY, "bar_index", "open_time", "open", "high", "low", "close")
    up = F.col("is_up")
    return range_join(l, b).withColumns(
        {
            "main": F.when(up, F.col("high")).otherwise(-F.col("low")),
            "counter": F.when(up, F.col("low")).otherwise(-F.col("high")),
            "pos": F.col("bar_index") - F.col("start_bar"),
        }
    )


def size(legs: DataFrame) -> DataFrame:
    v = F.abs(F.col("end_value") - F.col("start_value")) / F.abs(F.least("start_value", "end_value"))
    return legs.select(*LEG, v.alias("size"))


def heterogeneity(lb: DataFrame) -> DataFrame:
    """Unevenness of the distances from the straight line and the largest of them; (1, 1) under three bars."""
    n = F.col("end_bar") - F.col("start_bar")
    lo, hi = F.least("start_value", "end_value"), F.greatest("start_value", "end_value")
    line = F.col("start_value") + F.when(F.col("is_up"), 1.0).otherwise(-1.0) * F.col("pos") * (F.col("length") / n)
    dev = F.greatest(F.abs(F.greatest("low", lo) - line), F.abs(F.least("high", hi) - line))
    d = lb.where(F.col("pos") > 0).withColumn("_d", dev)
    g = d.groupBy(*LEG, n.alias("_n")).agg(
        F.sum("_d").alias("_s"),
        F.sum(F.when(F.col("_d") > 0, F.col("_d") * F.log2("_d")).otherwise(0.0)).alias("_dl"),
        F.count("*").alias("_c"),
        F.max("_d").alias("_m"),
    )
    entropy = F.log2("_s") - F.col("_dl") / F.col("_s")
    uneven = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(1.0 - entropy / F.log2(F.col("_c").cast("double")))
    short = F.col("_n") < 3
    return g.select(
        *LEG, F.when(short, 1.0).otherwise(uneven).alias("unevenness"), F.when(short, 1.0).otherwise(F.col("_m")).alias("max_distance")
    )


def running_main(lb: DataFrame, eligible: Column, value: Column, out: str) -> DataFrame:
    """Largest ``value`` over the eligible earlier bars of the leg: per piece, then carried over pieces."""
    df = lb.withColumn("_pc", block_of("bar_index", PIECE)).withColumn("_v", F.when(eligible, value))
    tops = df.groupBy(*LEG, "_pc").agg(F.max("_v").alias("_t"))
    prior = Window.partitionBy(*LEG).orderBy("_pc").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*LEG, "_pc", F.max("_t").over(prior).alias("_carry"))
    inside = Window.partitionBy(*LEG, "_pc").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(tops, [*LEG, "_pc"]).withColumn(out, F.greatest(F.max("_v").over(inside), "_carry")).drop("_pc", "_v", "_carry")


def pullback_score(lb: DataFrame) -> DataFrame:
    """Sum of the retreats below the running extreme over length x bars, at most 1."""
    n = F.col("end_bar") - F.col("start_bar")
    inner = running_main(lb, F.col("pos") > 0, F.col("main"), "_run")
    start = F.when(F.col("is_up"), F.col("start_value")).otherwise(-F.col("start_value"))
    back = F.greatest(F.greatest(F.col("_run"), start) - F.col("counter"), F.lit(0.0))
    return inner.groupBy(*LEG, "length", n.alias("_n")).agg(F.sum(F.when(F.col("pos") > 0, back)).alias("_s")).select(
        *LEG, F.least(F.col("_s") / (F.col("length") * F.col("_n")), F.lit(1.0)).alias("pullback")
    )


def _may_start() -> Column:
    """An end bar counts only if its candle goes with the move."""
    with_move = (F.col("open") < F.col("close")) == F.col("is_up")
    at_end = (F.col("pos") == 0) | (F.col("bar_index") == F.col("end_bar"))
    return ~at_end | with_move


def max_overlap(lb: DataFrame) -> DataFrame:
    """Deepest counter-move inside the leg and its share of the duration.

    The deepest of all per-bar retreats equals the largest drop of the counter side below the
    running main extreme: a later bar that had turned past the extreme would itself be a higher one.
    """
    n = F.col("end_bar") - F.col("start_bar")
    run = running_main(lb, _may_start(), F.struct(F.col("main").alias("m"), (-F.col("bar_index")).alias("i")), "_top")
    drop = F.col("_top.m") - F.col("counter")
    ok = (F.col("bar_index") < F.col("end_bar")) & F.col("_top").isNotNull() & (drop >= 0)
    g = run.groupBy(*LEG, "length", n.alias("_n")).agg(
        F.max(F.when(ok, F.struct(F.round(drop, 9).alias("d"), F.col("_top.i").alias("i"), (-F.col("bar_index")).alias("k")))).alias("_b")
    )
    has = F.col("_b").isNotNull()
    dist = (-F.col("_b.k") + F.col("_b.i")) / F.col("_n")
    return g.select(
        *LEG,
        F.when(has, F.col("_b.d") / F.col("length")).otherwise(0.0).alias("overlap_depth"),
        F.when(has, dist).otherwise(0.0).alias("overlap_distance"),
    )


def bar_retreats(lb: DataFrame, bars: DataFrame, whole: bool = False) -> DataFrame:
    """Per bar of a leg: the deepest later counter price before price turns past the bar's own extreme,
    and how many bars back from it that price was not met.

    ``whole`` lets every bar start and looks at the end bar too.  Both searches look ahead (behind)
    in growing steps, so the work follows the distances found, not the leg length squared.
    """
    ident = [*LEG, "i"]
    last = F.col("end_bar") if whole else F.col("end_bar") - 1
    cand = lb if whole else lb.where(_may_start())
    cand = cand.select(*LEG, "is_up", "start_bar", F.col("bar_index").alias("i"), F.col("main").alias("top"), last.alias("stop_at"))
    cand = cand.where(F.col("i") < F.col("stop_at"))
    slim = bars.select(*KEY, "bar_index", "high", "low")
    counter = F.when(F.col("is_up"), F.col("low")).otherwise(-F.col("high"))
    turn = first_hit(
        cand, slim, ident, "i", [F.min(F.when(counter > F.col("top"), F.col("bar_index"))).alias("turn")],
        F.col("turn").isNotNull(), end="stop_at",
    )
    span = turn.withColumn("_from", F.col("i") + 1).withColumn("_to", F.coalesce(F.col("turn") - 1, F.col("stop_at")))
    deepest = range_join(span, slim, "_from", "_to").groupBy(*ident, "is_up", "start_bar", "top").agg(F.min(counter).alias("deep"))
    deepest = deepest.where((F.col("deep") < F.col("top")) if whole else (F.col("deep") <= F.col("top")))
    mirrored = slim.withColumn("bar_index", -F.col("bar_index"))
    back = deepest.withColumn("_s", -F.col("i") - 1).withColumn("_e", -F.col("start_bar"))
    found = first_hit(
        back, mirrored, ident, "_s", [F.min(F.when(counter <= F.col("deep"), F.col("bar_index"))).alias("met")],
        F.col("met").isNotNull(), end="_e",
    )
    clear = F.when(F.col("met").isNotNull(), F.col("i") + F.col("met")).otherwise(F.col("i") - F.col("start_bar") + 1)
    return found.select(*ident, F.col("top"), F.col("deep"), clear.alias("clear_bars"))


def ratio_zigzag(legs: DataFrame, bars: DataFrame, whole: bool = False, lb: DataFrame | None = None) -> DataFrame:
    """Longest clear look-back over the duration of the leg."""
    lb = leg_bars(legs, bars) if lb is None else lb
    best = bar_retreats(lb, bars, whole).groupBy(*LEG).agg(F.max("clear_bars").alias("_m"))
    n = F.col("end_bar") - F.col("start_bar")
    return legs.join(best, LEG, "left").select(*LEG, F.coalesce(F.col("_m") / n, F.lit(0.0)).alias("ratio_zigzag"))


def price_profile(lb: DataFrame, keys: list[str] = LEG, low: str = "low", high: str = "high") -> DataFrame:
    """Intervals between neighbouring price levels with the number of bars covering each.

    A sweep over the sorted levels (+1 at a low, -1 at a high) instead of a level x bar join; the
    levels of one leg are cut in 64 price buckets, so a huge leg is shared out.
    """
    box = lb.groupBy(*keys).agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    ends = F.array(F.struct(F.col(low).alias("p"), F.lit(1).alias("d")), F.struct(F.col(high).alias("p"), F.lit(-1).alias("d")))
    pts = lb.select(*keys, F.explode(ends).alias("_e")).groupBy(*keys, F.col("_e.p").alias("price")).agg(F.sum("_e.d").alias("_d"))
    b = F.floor((F.col("price") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)) * 64)
    pts = pts.join(box, keys).withColumn("_pb", b)
    per = pts.groupBy(*keys, "_pb").agg(F.sum("_d").alias("_t"), F.min("price").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_pb")
    per = per.select(
        *keys, "_pb", F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.lead("_first").over(w).alias("_next"),
    )
    inside = Window.partitionBy(*keys, "_pb").orderBy("price")
    out = pts.join(per, [*keys, "_pb"]).select(
        *keys, F.col("price").alias("level_low"),
        F.coalesce(F.lead("price").over(inside), F.col("_next")).alias("level_high"),
        (F.col("_base") + F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("cover"),
        (F.col("_hi") - F.col("_lo")).alias("range"),
    )
    return out.where(F.col("level_high").isNotNull())


def profile_stats(profile: DataFrame, counts: DataFrame, keys: list[str] = LEG) -> DataFrame:
    """Overlap index, single-candle share, gap flag, overlap degree and uniformity of each leg.

    ``counts`` has the number of candles as ``n``.
    """
    p = profile.join(counts, keys)
    share = (F.col("level_high") - F.col("level_low")) / F.col("range")
    c = F.greatest(F.col("cover"), F.lit(1))
    n1 = F.nullif(F.col("n") - 1, F.lit(0))
    one = F.col("n") > 1
    zero = F.lit(0.0)
    g = p.groupBy(*keys, "n").agg(
        F.coalesce(F.sum(F.when(c > 1, share * c / n1)), zero).alias("_oi"),
        F.coalesce(F.sum(F.when(c == 1, share)), zero).alias("single_share"),
        F.max((F.col("cover") == 0).cast("int")).alias("_gap"),
        F.coalesce(F.sum(F.when(F.col("cover") > 1, share * (F.col("cover") - 1) / n1)), zero).alias("_deg"),
        F.avg(c).alias("_avg"), F.max(c).alias("_max"),
    )
    return g.select(
        *keys,
        F.when(one, F.least(F.col("_oi"), F.lit(1.0))).otherwise(1.0).alias("overlap_index"),
        "single_share",
        F.when(one, F.col("_gap") == 1).otherwise(False).alias("has_gap"),
        F.when(one, F.least(F.col("_deg"), F.lit(1.0))).otherwise(0.0).alias("overlap_degree"),
        F.when(one, 1.0 - F.col("_avg") / F.col("_max")).otherwise(0.0).alias("uniformity"),
    )


def overlap_stats(lb: DataFrame) -> DataFrame:
    return profile_stats(price_profile(lb), lb.groupBy(*LEG).agg(F.count("*").alias("n")))


def deviation_from_line(lb: DataFrame) -> DataFrame:
    """Largest and mean distance of the inner bars from the chord, over the range, at most 1."""
    n = F.col("end_bar") - F.col("start_bar")
    line = F.col("start_value") + (F.col("end_value") - F.col("start_value")) * (F.col("pos") / n)
    dist = F.greatest(F.abs(F.col("high") - line), F.abs(F.col("low") - line))
    inner = (F.col("pos") > 0) & (F.col("bar_index") < F.col("end_bar"))
    g = lb.groupBy(*LEG, "length").agg(F.max(F.when(inner, dist)).alias("_m"), F.avg(F.when(inner, dist)).alias("_a"))
    cap = lambda c: F.least(F.coalesce(F.col(c), F.lit(0.0)) / F.col("length"), F.lit(1.0))
    return g.select(*LEG, cap("_m").alias("max_deviation"), cap("_a").alias("avg_deviation"))


def deviation_from_nearest(lb: DataFrame) -> DataFrame:
    """As above with the distance of each inner counter price to the nearest main price of the leg.

    Both price sets are merged in value order; the nearest main price is the last one below or the
    first one above, found per price bucket and carried across buckets.
    """
    main = F.when(F.col("is_up"), F.col("high")).otherwise(F.col("low"))
    other = F.when(F.col("is_up"), F.col("low")).otherwise(F.col("high"))
    box = lb.groupBy(*LEG).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    inner = (F.col("pos") > 0) & (F.col("bar_index") < F.col("end_bar"))
    both = F.filter(
        F.array(
            F.struct(main.alias("v"), F.lit(True).alias("m")),
            F.struct(F.when(inner, other).alias("v"), F.lit(False).alias("m")),
        ),
        lambda e: e["v"].isNotNull(),
    )
    u = lb.select(*LEG, "length", F.explode(both).alias("_e")).select(*LEG, "length", "_e.v", "_e.m").join(box, LEG)
    u = u.withColumn("_pb", F.floor((F.col("v") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)) * 64))
    mv = F.when(F.col("m"), F.col("v"))
    per = u.groupBy(*LEG, "_pb").agg(F.min(mv).alias("_f"), F.max(mv).alias("_l"))
    w = Window.partitionBy(*LEG).orderBy("_pb")
    per = per.select(
        *LEG, "_pb", F.max("_l").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.min("_f").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_above"),
    )
    inside = Window.partitionBy(*LEG, "_pb").orderBy("v")
    u = u.join(per, [*LEG, "_pb"]).withColumns(
        {
            "_p": F.coalesce(F.max(mv).over(inside.rangeBetween(Window.unboundedPreceding, 0)), F.col("_below")),
            "_q": F.coalesce(F.min(mv).over(inside.rangeBetween(0, Window.unboundedFollowing)), F.col("_above")),
        }
    )
    dist = F.least(F.col("v") - F.col("_p"), F.col("_q") - F.col("v"))
    d = F.when(~F.col("m"), dist)
    g = u.groupBy(*LEG, "length").agg(F.max(d).alias("_m"), F.avg(d).alias("_a"))
    cap = lambda c: F.least(F.coalesce(F.col(c), F.lit(0.0)) / F.col("length"), F.lit(1.0))
    return g.select(*LEG, cap("_m").alias("max_deviation_near"), cap("_a").alias("avg_deviation_near"))


def smooth_impulse(lb: DataFrame, gaps: DataFrame) -> DataFrame:
    """Flag of an even, gapless move without deep corrections, with the numbers it rests on."""
    n = F.col("end_bar") - F.col("start_bar")
    up, length = F.col("is_up"), F.col("length")
    run = running_main(lb, F.lit(True), F.col("main"), "_run")
    start_m = F.when(up, F.col("start_value")).otherwise(-F.col("start_value"))
    end_m = F.when(up, F.col("end_value")).otherwise(-F.col("end_value"))
    drop = F.greatest(F.greatest(F.col("_run"), start_m, F.col("main")) - F.col("counter"), F.lit(0.0))
    beyond = (F.col("counter") < start_m - 0.001 * length) | (F.col("main") > end_m + 0.001 * length)
    # closing path from the start value over inner closes to the end value
    here = F.when(F.col("pos") == 0, F.col("start_value")).when(F.col("bar_index") == F.col("end_bar"), F.col("end_value")).otherwise(F.col("close"))
    run = run.withColumn("_px", here)
    step = _lag_over_pieces(run, "_px", "_prev")
    b1 = F.col("start_bar") + F.floor(n / 3)
    b2 = F.col("start_bar") + F.floor(2 * n / 3)
    g = step.groupBy(*LEG, *LEG_COLS).agg(
        F.max(beyond.cast("int")).alias("_beyond"),
        F.max(drop).alias("_drop"),
        F.sum(F.abs(F.col("_px") - F.col("_prev"))).alias("_path"),
        F.max(F.when(F.col("bar_index") == b1, F.col("close"))).alias("_c1"),
        F.max(F.when(F.col("bar_index") == b2, F.col("close"))).alias("_c2"),
    )
    sign = F.when(up, 1.0).otherwise(-1.0)
    g = g.join(gaps.select(*LEG, "has_gap"), LEG).withColumns(
        {
            "correction": F.col("_drop") / length,
            "path_ratio": F.col("_path") / length,
            "first_third": sign * (F.col("_c1") - F.col("start_value")) / length,
            "second_third": sign * (F.col("_c2") - F.col("_c1")) / length,
            "last_third": sign * (F.col("end_value") - F.col("_c2")) / length,
        }
    )
    a, b, c = F.col("first_third"), F.col("second_third"), F.col("last_third")
    line = a.between(0.15, 0.55) & b.between(0.15, 0.55) & c.between(0.15, 0.55)
    lo, hi = F.least(a, c), F.greatest(a, c)
    loop = (b >= 0.45) & (lo >= 0) & F.when(lo < 5e-324, hi < 0.1).otherwise(hi / F.nullif(lo, F.lit(0.0)) <= 3.0)
    ok = (n >= 3) & ~F.col("has_gap") & (F.col("_beyond") == 0) & (F.col("correction") <= 0.35) & (F.col("path_ratio") <= 2.0) & (line | loop)
    return g.select(*LEG, "correction", "path_ratio", "first_third", "second_third", "last_third", ok.alias("is_smooth"))


def _lag_over_pieces(df: DataFrame, value: str, out: str) -> DataFrame:
    """Previous bar's value inside the leg; the first row of a piece takes the last of the piece before."""
    df = df.withColumn("_pc", block_of("bar_index", PIECE))
    ends = df.groupBy(*LEG, "_pc").agg(F.max_by(value, "bar_index").alias("_e"))
    ends = ends.select(*LEG, (F.col("_pc") + 1).alias("_pc"), "_e")
    w = Window.partitionBy(*LEG, "_pc").orderBy("bar_index")
    return df.join(ends, [*LEG, "_pc"], "left").withColumn(out, F.coalesce(F.lag(value).over(w), F.col("_e"))).drop("_pc", "_e")


# ---- envelope ----------------------------------------------------------------------------------


def _chain(points: list[tuple[int, float]], upper: bool) -> list[tuple[int, float]]:
    """Upper or lower hull of points in ascending x."""
    sign, out = (1.0 if upper else -1.0), []
    for x, y in points:
        while len(out) > 1:
            (x1, y1), (x2, y2) = out[-2:]
            if sign * ((x2 - x1) * (y - y2) - (y2 - y1) * (x - x2)) < 0:
                break
            out.pop()
        out.append((x, y))
    return out


_HULL = "symbol string, tf string, seq long, upper boolean, x long, y double"


def _piece_hull(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("x")
    head = pdf.iloc[0]
    rows = []
    for upper, col in ((True, "hi"), (False, "lo")):
        for x, y in _chain(list(zip(pdf["x"].tolist(), pdf[col].tolist())), upper):
            rows.append((head["symbol"], head["tf"], head["seq"], upper, x, y))
    return pd.DataFrame(rows, columns=["symbol", "tf", "seq", "upper", "x", "y"])


def _hull_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of the envelope heights at every bar after the first."""
    head, total, area = pdf.iloc[0], 0.0, 0.0
    for upper in (True, False):
        part = pdf[pdf["upper"] == upper].sort_values("x")
        chain = _chain(list(zip(part["x"].tolist(), part["y"].tolist())), upper)
        sign = 1.0 if upper else -1.0
        for (x1, y1), (x2, y2) in zip(chain, chain[1:]):
            k = x2 - x1
            total += sign * (k * y1 + (y2 - y1) / k * (k * (k + 1) / 2))
            area += sign * k * (y1 + y2) / 2
    return pd.DataFrame([(head["symbol"], head["tf"], head["seq"], total, area)], columns=["symbol", "tf", "seq", "height_sum", "area"])


def envelope_area(lb: DataFrame, pine: bool = False) -> DataFrame:
    """Share of the leg's box between its upper and lower convex envelopes.

    Hulls are built per piece of a leg; only hull corners go on to the leg's own hull.
    """
    lo, hi = F.least("start_value", "end_value"), F.greatest("start_value", "end_value")
    at_start, at_end = F.col("pos") == 0, F.col("bar_index") == F.col("end_bar")
    if pine:  # plain prices, the ends pinned to the pivots, area under the chains
        cut = lambda c: F.when(at_start, F.col("start_value")).when(at_end, F.col("end_value")).otherwise(F.col(c))
    else:
        cut = lambda c: F.least(F.greatest(F.col(c), lo), hi)
    pts = lb.select(*LEG, F.col("bar_index").alias("x"), cut("high").alias("hi"), cut("low").alias("lo"), block_of("bar_index", PIECE).alias("_pc"))
    corners = pts.groupBy(*LEG, "_pc").applyInPandas(_piece_hull, _HULL)
    sums = corners.groupBy(*LEG).applyInPandas(_hull_sum, "symbol string, tf string, seq long, height_sum double, area double")
    box = lb.where(F.col("pos") == 0).select(*LEG, (F.col("length") * (F.col("end_bar") - F.col("start_bar"))).alias("_box"))
    share = lambda c: F.least(F.greatest(F.col(c) / F.col("_box"), F.lit(0.0)), F.lit(1.0))
    return sums.join(box, LEG).select(*LEG, share("area" if pine else "height_sum").alias("envelope_area"))


# ---- legs seen through finer zigzags -----------------------------------------------------------

MIN_DEVIATION = 0.005


def _leg_zigzag_fold() -> Fold:
    """Percent zigzag over legs laid end to end; a new leg restarts it, opposite to the leg's direction."""

    def step(state, _i, seq, bar_index, high, low, dev, is_up):
        leg, up, ext, at = state
        if leg != seq:
            done = (leg, at, ext, up, True) if ext is not None else None
            return (seq, not is_up, high if is_up else low, bar_index), done
        if up:
            if high >= ext:
                return (leg, True, high, bar_index), None
            if low <= ext * (1.0 - dev * 0.01):
                return (leg, False, low, bar_index), (leg, at, ext, True, False)
        else:
            if low <= ext:
                return (leg, False, low, bar_index), None
            if high >= ext * (1.0 + dev * 0.01):
                return (leg, True, high, bar_index), (leg, at, ext, False, False)
        return state, None

    return Fold(
        ("seq", "bar_index", "high", "low", "dev", "is_up"), "leg long, up boolean, ext double, at long",
        "leg_seq long, pivot_bar long, value double, is_high boolean, is_last boolean", (None,) * 4, step,
    )


def leg_zigzag(lb: DataFrame) -> DataFrame:
    """Pivots of each leg at each ``k`` (its deviation is in ``dev``).

    The legs of a series are folded as one long series per ``k`` (neighbours share one bar, so
    ``bar_index + seq`` orders them), which keeps the number of groups small.
    """
    keys = [*KEY, "k"]
    line = lb.withColumn("_at", F.col("bar_index") + F.col("seq"))
    out, fin = fold_series(line, _leg_zigzag_fold(), keys, "_at")
    cols = [*keys, F.col("leg_seq").alias("seq"), F.col("pivot_bar").alias("bar_index"), "value", "is_high", "is_last"]
    last = fin.select(
        *keys, F.col("leg").alias("seq"), F.col("at").alias("bar_index"), F.col("ext").alias("value"), F.col("up").alias("is_high"),
        F.lit(True).alias("is_last"),
    )
    return out.select(*cols).unionByName(last)


def halving_steps(legs: DataFrame) -> DataFrame:
    """One row per leg and halving step: deviation from the leg's own size down to the minimum."""
    percent = F.greatest(
        F.abs(F.col("end_value") - F.col("start_value")) / F.least("start_value", "end_value") * 100.0, F.lit(MIN_DEVIATION)
    )
    steps = F.floor(F.log2(percent / MIN_DEVIATION) + 1e-12).cast("int")
    g = legs.withColumn("_p", percent).withColumn("k", F.explode(F.sequence(F.lit(0), steps)))
    return g.withColumn("dev", F.col("_p") / F.pow(F.lit(2.0), F.col("k").cast("double"))).drop("_p")


def _stepped(legs: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    grid = halving_steps(legs)
    lb = leg_bars(legs, bars).select(*LEG, "bar_index", "high", "low", "is_up")
    return grid, leg_zigzag(lb.join(grid.select(*LEG, "k", "dev"), LEG))


def sub_extremum_ranks(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """Step at which each inner extremum of a leg first shows as the deviation halves.

    Only halvings that change the set of inner extrema count as steps; sets are compared by size
    and hash sum.
    """
    legs = legs.where(F.col("end_bar") - F.col("start_bar") >= 3)
    grid, piv = _stepped(legs, bars)
    ends = legs.select(*LEG, "start_bar", "end_bar")
    inner = piv.join(ends, LEG).where((F.col("bar_index") > F.col("start_bar")) & (F.col("bar_index") < F.col("end_bar")))
    mark = inner.groupBy(*LEG, "k").agg(F.count_distinct("bar_index").alias("_n"), F.sum(F.xxhash64("bar_index").cast("decimal(38,0)")).alias("_h"))
    zero = F.lit(0).cast("decimal(38,0)")
    st = grid.select(*LEG, "k").join(mark, [*LEG, "k"], "left").withColumn(
        "_f", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_h", zero).alias("h"))
    )
    w = Window.partitionBy(*LEG).orderBy("k")  # one row per halving, a dozen or so
    none = F.struct(F.lit(0).cast("long").alias("n"), zero.alias("h"))
    st = st.withColumn("_chg", (F.col("_f") != F.coalesce(F.lag("_f").over(w), none)).cast("int"))
    st = st.withColumn("_step", F.lit(1) + F.coalesce(F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = inner.join(st.where("_chg = 1").select(*LEG, "k", "_step"), [*LEG, "k"])
    return seen.groupBy(*LEG, "bar_index").agg(
        F.min_by("value", "k").alias("value"), F.min("_step").cast("int").alias("rank")
    )


def segment_count_class(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """First leg count other than 1, 2 or 4 met while the deviation halves; none means an impulse."""
    grid, piv = _stepped(legs, bars)
    n = piv.groupBy(*LEG, "k").agg((F.count("*") - 1).alias("_c"))
    bad = n.where((F.col("_c") == 3) | (F.col("_c") >= 5))
    first = bad.groupBy(*LEG).agg(F.min_by("_c", "k").alias("inner_legs"))
    out = legs.select(*LEG).join(first, LEG, "left")
    long_enough = legs.select(*LEG, (F.col("end_bar") - F.col("start_bar") >= 3).alias("_long"))
    return out.join(long_enough, LEG).withColumn("is_impulse", F.col("_long") & F.col("inner_legs").isNull()).drop("_long")


def profile_by_zigzag(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """Overlap numbers of the fine swings inside each leg instead of its bars."""
    lb = leg_bars(legs, bars).withColumns({"k": F.lit(0), "dev": F.lit(MIN_DEVIATION)})
    piv = leg_zigzag(lb).withColumn("_at", (F.col("bar_index") + F.col("seq")) * 2 + F.when(F.col("is_high"), 0).otherwise(1))
    line = with_seq(piv, list(KEY), "_at", "_n")
    nxt = framed(line, 0, 1, lambda w: {"_v": F.lead("value").over(w), "_q": F.lead("seq").over(w)}, order="_n")
    sw = nxt.where(F.col("_q") == F.col("seq")).select(*LEG, F.least("value", "_v").alias("low"), F.greatest("value", "_v").alias("high"))
    return profile_stats(price_profile(sw), sw.groupBy(*LEG).agg(F.count("*").alias("n"))).select(*LEG, "overlap_index", "single_share")


def leg_labels(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """Whole percents of the look-back ratio, the overlap depth and the uniformity."""
    lb = cut(leg_bars(legs, bars))
    pct = lambda c: F.bround(F.col(c) * 100.0, 0).cast("int")
    out = ratio_zigzag(legs, bars, lb=lb).join(max_overlap(lb), LEG).join(overlap_stats(lb), LEG)
    return out.select(
        *LEG, pct("ratio_zigzag").alias("rz"), pct("overlap_depth").alias("depth"), pct("uniformity").alias("uniformity")
    )


# ---- chart-script variants ---------------------------------------------------------------------


def pine_depth(lb: DataFrame) -> DataFrame:
    """Deepest retreat over the leg's range; every bar counts, the end bar too."""
    run = running_main(lb, F.lit(True), F.col("main"), "_run")
    return run.groupBy(*LEG, "length").agg(F.max(F.col("_run") - F.col("counter")).alias("_d")).select(
        *LEG, (F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0)) / F.col("length")).alias("depth_pine")
    )


def pine_heterogeneity(lb: DataFrame) -> DataFrame:
    """Ten price bins: |bars through the lower three - bars through the upper three| / all."""
    box = lb.groupBy(*LEG).agg(
        F.least(F.min("low"), F.min(F.least("start_value", "end_value"))).alias("_lo"),
        F.greatest(F.max("high"), F.max(F.greatest("start_value", "end_value"))).alias("_hi"),
    )
    step = (F.col("_hi") - F.col("_lo")) / 10
    bin_of = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("_lo")) / step), F.lit(0)), F.lit(9))
    j = lb.join(box, LEG).withColumn("_a", bin_of("low")).withColumn("_b", bin_of("high"))
    over = lambda lo, hi: F.greatest(F.least(F.col("_b"), F.lit(hi)) - F.greatest(F.col("_a"), F.lit(lo)) + 1, F.lit(0))
    g = j.groupBy(*LEG).agg(F.sum(over(0, 2)).alias("_f"), F.sum(over(7, 9)).alias("_l"), F.sum(over(0, 9)).alias("_w"))
    return g.select(*LEG, (F.abs(F.col("_f") - F.col("_l")) / F.col("_w")).alias("heterogeneity_pine"))


def pine_impulse_filter(legs: DataFrame, bars: DataFrame, limit: float = 30.0, min_bars: int = 10) -> DataFrame:
    """All chart-script metrics of each leg and whether every one is under the limit (percent)."""
    lb = cut(leg_bars(legs, bars))
    near = deviation_from_nearest(lb).select(*LEG, F.col("max_deviation_near").alias("dev_candle"))
    line = deviation_from_line(lb).select(*LEG, F.col("max_deviation").alias("dev_line"))
    out = ratio_zigzag(legs, bars, whole=True, lb=lb).withColumnRenamed("ratio_zigzag", "rz_pine")
    for part in (
        pine_depth(lb), pine_heterogeneity(lb), overlap_stats(lb).select(*LEG, "uniformity"), line, near,
        envelope_area(lb, pine=True),
    ):
        out = out.join(part, LEG)
    names = ["rz_pine", "depth_pine", "heterogeneity_pine", "uniformity", "dev_line", "dev_candle", "envelope_area"]
    passed = F.lit(True)
    for n in names:
        passed = passed & (F.col(n) * 100.0 < limit)
    n_bars = legs.select(*LEG, (F.col("end_bar") - F.col("start_bar")).alias("_n"))
    return out.join(n_bars, LEG).withColumn("is_impulse", passed & (F.col("_n") >= min_bars)).drop("_n")


# ---- look-ups around a leg ---------------------------------------------------------------------


def extremum_between(legs: DataFrame, bars: DataFrame, high: bool) -> DataFrame:
    """Highest high (lowest low) strictly between the ends; the last bar wins a tie."""
    v = F.col("high") if high else -F.col("low")
    span = legs.select(*LEG, (F.col("start_bar") + 1).alias("_from"), (F.col("end_bar") - 1).alias("_to"))
    b = bars.select(*KEY, "bar_index", "high", "low")
    g = range_join(span, b, "_from", "_to").groupBy(*LEG).agg(F.max(F.struct(v.alias("v"), F.col("bar_index").alias("i"))).alias("_b"))
    value = F.col("_b.v") if high else -F.col("_b.v")
    return g.select(*LEG, F.col("_b.i").alias("extremum_bar"), value.alias("extremum_value"))


def normalize_extrema(legs: DataFrame, pivots: DataFrame) -> DataFrame:
    """Finer pivots inside each leg with the leg's ends forced, points that do not alternate dropped.

    Legs are laid end to end (``bar_index + seq`` orders them), so neighbours come from blocked frames.
    Lists under four points are kept as they are.
    """
    ends = F.array(
        F.struct(F.col("start_bar").alias("bar_index"), F.col("start_value").alias("value")),
        F.struct(F.col("end_bar").alias("bar_index"), F.col("end_value").alias("value")),
    )
    falls = (F.col("start_value") > F.col("end_value")).alias("_falls")
    forced = legs.select(*LEG, falls, F.explode(ends).alias("_e")).select(*LEG, "_falls", "_e.*")
    inside = legs.select(*LEG, falls, (F.col("start_bar") + 1).alias("_from"), (F.col("end_bar") - 1).alias("_to"))
    inner = range_join(inside, pivots.select(*KEY, "bar_index", "value"), "_from", "_to").select(*LEG, "_falls", "bar_index", "value")
    pts = forced.unionByName(inner).withColumn("_at", F.col("bar_index") + F.col("seq"))
    line = with_seq(pts, list(KEY), "_at", "_n")

    def stage(w):
        return {"_pv": F.lag("value").over(w), "_ps": F.lag("seq").over(w), "_nv": F.lead("value").over(w), "_ns": F.lead("seq").over(w)}

    line = framed(line, 1, 1, stage, order="_n").join(pts.groupBy(*LEG).agg(F.count("*").alias("_c")), LEG)
    came = F.when(F.col("_ps") == F.col("seq"), F.col("_pv") < F.col("value")).otherwise(F.col("_falls"))
    goes = F.when(F.col("_ns") == F.col("seq"), F.col("value") < F.col("_nv"))
    drop = (F.col("_c") >= 4) & F.coalesce(came == goes, F.lit(False))
    return line.where(~drop).select(*LEG, "bar_index", "value")


def is_initial_movement(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """Going back from the start, price beyond the end is met before price back at the start."""
    up = F.col("is_up")
    back = F.when(up, F.col("low") <= F.col("start_value")).otherwise(F.col("high") >= F.col("start_value"))
    beyond = F.when(up, F.col("high") > F.col("end_value")).otherwise(F.col("low") < F.col("end_value"))
    mirrored = bars.select(*KEY, (-F.col("bar_index")).alias("bar_index"), "high", "low")
    cand = legs.select(*LEG, *LEG_COLS, (-F.col("start_bar")).alias("_s"))
    hit = first_hit(
        cand, mirrored, LEG, "_s",
        [F.min(F.when(back, F.col("bar_index"))).alias("_back"), F.min(F.when(beyond, F.col("bar_index"))).alias("_beyond")],
        F.col("_back").isNotNull() | F.col("_beyond").isNotNull(),
    )
    far = F.lit(2**62)
    b, y = F.coalesce("_back", far), F.coalesce("_beyond", far)
    edge = F.when(F.least(b, y) < far, -F.least(b, y)).when(F.col("start_bar") > 0, F.lit(0).cast("long"))
    return hit.select(*LEG, (y < b).alias("is_initial"), edge.alias("edge_bar"))


def find_divergence(legs: DataFrame, bars_ao: DataFrame) -> DataFrame:
    """Bar before the leg's end where the oscillator was beyond its end value while price was not.

    ``bars_ao`` has ``ao`` and ``ao_prev``. A falling leg asks for a bullish divergence.
    """
    bull = ~F.col("is_up")
    l = legs.select(*LEG, *LEG_COLS)
    at_end = bars_ao.select(*KEY, F.col("bar_index").alias("end_bar"), F.col("ao").alias("_ao1"), F.col("low").alias("_l1"), F.col("high").alias("_h1"))
    l = l.join(at_end, [*KEY, "end_bar"])
    sgn = F.when(bull, 1.0).otherwise(-1.0)
    l = l.where(F.col("_ao1") * sgn <= 0)
    j = range_join(l.withColumn("_to", F.col("end_bar") - 1), bars_ao.select(*KEY, "bar_index", "high", "low", "ao", "ao_prev"), "start_bar", "_to")
    price = F.when(bull, F.col("low")).otherwise(-F.col("high"))
    end_price = F.when(bull, F.col("_l1")).otherwise(-F.col("_h1"))
    end_value = F.when(bull, F.col("end_value")).otherwise(-F.col("end_value"))
    broke = (F.col("ao") * sgn > 0) | (price < end_value) | (price < end_price)
    weaker = F.col("ao") * sgn > F.col("_ao1") * sgn
    found = ~weaker & (F.col("bar_index") - 1 > F.col("start_bar")) & (F.col("ao_prev") * sgn > F.col("ao") * sgn)
    g = j.groupBy(*LEG).agg(
        F.max(F.when(broke, F.col("bar_index"))).alias("_stop"), F.max(F.when(found & ~broke, F.col("bar_index"))).alias("_hit")
    )
    ok = F.col("_hit") > F.coalesce("_stop", F.lit(-1))
    return g.where(ok).select(*LEG, F.col("_hit").alias("divergence_bar"))


def movement_statistic(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """All leg metrics side by side; the field called heterogeneity carries the uniformity."""
    lb = cut(leg_bars(legs, bars))
    out = size(legs).join(max_overlap(lb).drop("overlap_distance"), LEG)
    out = out.join(ratio_zigzag(legs, bars, lb=lb), LEG)
    out = out.join(overlap_stats(lb).select(*LEG, F.col("uniformity").alias("heterogeneity"), "overlap_degree"), LEG)
    out = out.join(deviation_from_line(lb).select(*LEG, "max_deviation"), LEG)
    out = out.join(envelope_area(lb).select(*LEG, "envelope_area"), LEG)
    n = legs.select(*LEG, (F.col("end_bar") - F.col("start_bar")).alias("bar_count"))
    return out.join(n, LEG)
