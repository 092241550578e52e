"""Setups from waves, figures and price speed: candidates, gates, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.functions.prices import risk_reward, round_price
from barwave.operators import indicators as ind
from barwave.operators import movement as mv
from barwave.operators.harmonic import DEPTH, default_targets, pattern_height, stop_loss
from barwave.operators.joins import first_hit, range_join
from barwave.operators.outcomes import break_even_outcomes, signal_outcomes
from barwave.operators.pivots import with_pivot_seq, zigzag_bps_fold
from barwave.operators.series import KEY, Fold, fold_series, framed, with_seq

SL_PERCENT = 2.0

# ---- impulses -----------------------------------------------------------------------------------


def confirmed_legs(bars: DataFrame, scale: float) -> DataFrame:
    """Legs of the basis-point zigzag with the bars at which they are the last finished leg: [live_from, live_to]."""
    flips, _ = fold_series(bars.withColumn("scale", F.lit(float(scale))), zigzag_bps_fold())
    last = bars.groupBy(*KEY).agg(F.max("bar_index").alias("_last"))
    p = with_seq(flips, list(KEY), "bar_index", "n")

    def stage(w):
        return {
            "start_bar": F.lag("pivot_bar").over(w), "start_value": F.lag("value").over(w), "_next": F.lead("bar_index").over(w),
        }

    p = framed(p, 1, 1, stage, order="n").where(F.col("start_bar").isNotNull()).join(last, list(KEY))
    return p.select(
        *KEY, F.col("n").alias("seq"), "start_bar", "start_value", F.col("pivot_bar").alias("end_bar"), F.col("value").alias("end_value"),
        (F.col("value") > F.col("start_value")).alias("is_up"), F.abs(F.col("value") - F.col("start_value")).alias("length"),
        F.col("bar_index").alias("live_from"), F.coalesce(F.col("_next") - 1, F.col("_last")).alias("live_to"),
    )


def impulse_levels(df: DataFrame, take_ratio: float, digits: int) -> DataFrame:
    """Stop 2 % of the entry distance beyond the start, target a multiple of the leg; rejected when already passed.

    Needs entry, start_value, length, is_up.
    """
    up = F.col("is_up")
    side = F.when(up, 1.0).otherwise(-1.0)
    slack = F.abs(F.col("entry") - F.col("start_value")) * (SL_PERCENT / 100.0)
    sl = round_price(F.col("start_value") - side * slack, digits, up)
    tp = round_price(F.col("start_value") + side * F.col("length") * take_ratio, digits, up)
    out = df.withColumns({"sl": sl, "tp": tp, "is_long": up})
    ok = F.when(up, (F.col("entry") < F.col("tp")) & (F.col("entry") > F.col("sl"))).otherwise(
        (F.col("entry") > F.col("tp")) & (F.col("entry") < F.col("sl"))
    )
    return out.where(ok)


def impulse_setups(
    bars: DataFrame, scale: float = 30, enter_ratio: float = 0.5, take_ratio: float = 1.6, min_bars: int = 3, digits: int = 2
) -> DataFrame:
    """A leg that starts a movement, untouched at both ends since, pulled back to the entry level.

    Reaching only 0.8 of the pull-back gives a limit order at the level.  The leg statistics are
    reported, never filtered on.
    """
    legs = confirmed_legs(bars, scale)
    legs = legs.where(F.col("end_bar") - F.col("start_bar") >= min_bars)
    initial = mv.is_initial_movement(legs, bars).where("is_initial").select(*mv.LEG)
    legs = legs.join(initial, mv.LEG)
    up = F.col("is_up")
    side = F.when(up, 1.0).otherwise(-1.0)
    level = lambda r: round_price(F.col("end_value") - side * F.col("length") * r, digits, ~up)
    legs = legs.withColumns({"trigger": level(enter_ratio), "near": level(enter_ratio * 0.8), "_s": F.col("end_bar")})
    counter = F.when(up, F.col("low")).otherwise(-F.col("high"))
    main = F.when(up, F.col("high")).otherwise(-F.col("low"))
    sgn = lambda c: F.when(up, F.col(c)).otherwise(-F.col(c))
    live = F.col("bar_index") >= F.col("live_from")
    bar = F.col("bar_index")
    slim = bars.select(*KEY, "bar_index", "high", "low")
    hit = first_hit(
        legs, slim, mv.LEG, "_s",
        [
            F.min(F.when(live & (counter <= sgn("near")) & (counter > sgn("start_value")), bar)).alias("entry_bar"),
            F.min(F.when((main >= sgn("end_value")) | (counter <= sgn("start_value")), bar)).alias("_broken"),
        ],
        F.col("entry_bar").isNotNull() | F.col("_broken").isNotNull(), end="live_to",
    )
    hit = hit.where(F.col("entry_bar").isNotNull() & (F.coalesce("_broken", F.lit(2**62)) >= F.col("entry_bar")))
    at = slim.select(*KEY, F.col("bar_index").alias("entry_bar"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    hit = hit.join(at, [*KEY, "entry_bar"])
    market = F.when(up, F.col("_l") <= F.col("trigger")).otherwise(F.col("_h") >= F.col("trigger"))
    t = F.col("trigger")
    real = F.when(t.between(F.col("_l"), F.col("_h")), t).when(F.abs(t - F.col("_l")) < F.abs(t - F.col("_h")), F.col("_l")).otherwise(F.col("_h"))
    hit = hit.withColumns({"is_limit": ~market, "entry": real})
    out = impulse_levels(hit, take_ratio, digits).withColumn("entry", F.when(F.col("is_limit"), t).otherwise(F.col("entry")))
    out = out.withColumn("signal_id", F.concat_ws("|", "symbol", "tf", F.lit("IMP"), "entry_bar", "start_bar", "end_bar"))
    return out.select("signal_id", *KEY, "is_long", "entry_bar", "entry", "tp", "sl", "is_limit", "seq", "start_bar", "start_value", "end_bar", "end_value")


# ---- diagonals ----------------------------------------------------------------------------------

REACH, ALTERNATIVES, PULLBACK = 40, 4, 0.5
# fixed values: penetration, W4/W3, W4 depth into W2, wedge spill, duration ratio, W5/W3
PENETRATION, MIN_W4_W3, MIN_W4_W2_LEVEL, MAX_SPILL, MAX_DURATION, MIN_W5 = 0.03, 0.382, 0.236, 0.005, 8.0, 0.786


def _wave_ends(tolerance: float) -> Column:
    """For 1, 2, ... pivots ahead: how many pivots ahead the wave from this pivot ends if it may use so many.

    ``_v`` holds this and the next prices, turned so that the wave rises. The wave is over at the first pull-back of more
    than ``tolerance`` of its height until then; it ends at its highest price before that (the first, if several are equal).
    """
    v, n = F.col("_v"), F.size("_v") - 1
    once = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
    highest = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_max(F.slice(v, 2, i)))

    def usable(peaks: Column) -> Column:
        before = lambda i: F.get(peaks, i - 2)
        pulled = lambda i: before(i) - F.get(v, i) > tolerance * F.greatest(F.lit(1e-12), before(i) - F.get(v, F.lit(0)))
        return F.coalesce(F.when(n > 1, F.get(F.filter(F.sequence(F.lit(2), n), pulled), F.lit(0))) - 1, n)

    place = lambda peaks, most: F.transform(F.sequence(F.lit(1), n), lambda i: (F.array_position(v, F.get(peaks, F.least(i, most) - 1)) - 1).cast("int"))
    ends = once(highest, lambda peaks: once(usable(peaks), lambda most: place(peaks, most)))
    return F.when(n >= 1, ends).otherwise(F.array().cast("array<int>"))


def _skeleton_to(last: Column) -> Column:
    """Points 1, 2, 3 (pivots ahead of point 0) of the skeleton whose point 4 is ``last`` pivots ahead; null if there is none.

    Wave 1 is the longest possible, else one of the ``ALTERNATIVES`` next shorter ones that end in a peak; waves 2 to 4
    are the longest possible, and wave 4 has to end at ``last``.
    """
    v, ends = F.col("_v"), F.col("_all")
    end = lambda start: start + F.get(F.get(ends, start), last - start - 1)
    one = F.get(F.get(ends, F.lit(0)), last - 1)
    latest = F.least(one - 1, last - 3)
    is_peak = lambda i: (F.get(v, i) > F.get(v, F.lit(0))) & (F.get(v, i) > F.get(v, i + 1))
    shorter = F.when(latest >= 1, F.slice(F.filter(F.sequence(latest, F.lit(1), F.lit(-1)), is_peak), 1, ALTERNATIVES)).otherwise(F.array().cast("array<int>"))
    two = F.transform(F.concat(F.array(one), shorter), lambda i: F.struct(i.alias("s1"), end(i).alias("s2")))
    three = F.transform(F.filter(two, lambda w: w["s2"] < last), lambda w: F.struct(w["s1"].alias("s1"), w["s2"].alias("s2"), end(w["s2"]).alias("s3")))
    return F.get(F.filter(three, lambda w: (w["s3"] < last) & (end(w["s3"]) == last)), F.lit(0))


def diagonal_skeletons(pivots: DataFrame, block: int = 1024, tolerance: float = PULLBACK) -> DataFrame:
    """0-1-2-3-4 skeletons; point 0 owns a skeleton and sees the next ``REACH`` pivots. Highs and lows of ``pivots`` take turns."""
    p = with_pivot_seq(pivots).select(*KEY, "seq", "bar_index", "value", (~F.col("is_high")).alias("is_low"))
    facing = F.when(F.col("is_low"), 1.0).otherwise(-1.0)
    ahead = lambda w: w.rowsBetween(0, REACH)
    seen = framed(
        p.withColumn("_up", facing), 0, REACH,
        lambda w: {"_v": F.transform(F.collect_list("value").over(ahead(w)), lambda x: x * F.col("_up"))},
        lambda w: {"_ends": _wave_ends(tolerance)},
        lambda w: {"_all": F.collect_list("_ends").over(ahead(w))},
        order="seq", block=block,
    )
    lasts = F.filter(F.array(*map(F.lit, range(4, REACH + 1, 2))), lambda i: i < F.size("_v"))
    each = F.filter(F.transform(lasts, lambda i: F.struct(_skeleton_to(i).alias("inner"), i.alias("s4"))), lambda s: s["inner"].isNotNull())
    found = seen.select(*KEY, F.col("is_low").alias("is_up"), "seq", F.explode(each).alias("_s"))
    offsets = [F.lit(0), *[F.col(f"_s.inner.s{i}") for i in (1, 2, 3)], F.col("_s.s4")]
    found = found.select(*KEY, "is_up", *[(F.col("seq") + o).alias(f"s{i}") for i, o in enumerate(offsets)])
    ids = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("seq")) for i in range(5)])
    long = found.withColumn("_e", F.explode(ids)).select(*KEY, "is_up", *[f"s{i}" for i in range(5)], "_e.i", "_e.seq")
    pts = long.join(p.select(*KEY, "seq", "bar_index", "value"), [*KEY, "seq"])
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return pts.groupBy(*KEY, "is_up", *[f"s{i}" for i in range(5)]).agg(
        *[pick("value", i).alias(f"p{i}") for i in range(5)], *[pick("bar_index", i).alias(f"b{i}") for i in range(5)]
    )


SKEL = [*KEY, "is_up", "b0", "b1", "b2", "b3", "b4"]


def diagonal_filters(skeletons: DataFrame, bars: DataFrame, min_convergence: float = 0.0, min_bars: int = 0) -> DataFrame:
    """First failed rule of every skeleton in ``gate`` (REGISTERED = none); containment and wedge spill come from one range join."""
    one = skeletons.groupBy(*SKEL).agg(*[F.first(f"p{i}").alias(f"p{i}") for i in range(5)])
    s = F.when(F.col("is_up"), 1.0).otherwise(-1.0)
    p, b = [F.col(f"p{i}") for i in range(5)], [F.col(f"b{i}") for i in range(5)]
    w = [None] + [F.abs(p[i] - p[i - 1]) for i in range(1, 5)]
    top = (p[3] - p[1]) / (b[3] - b[1])
    floor = (p[4] - p[2]) / (b[4] - b[2])
    at1 = s * (p[1] - (p[2] + floor * (b[1] - b[2])))
    at4 = s * ((p[1] + top * (b[4] - b[1])) - p[4])
    one = one.withColumn("convergence", at1 / F.greatest(F.lit(1e-12), at4) - 1)
    x = F.col("bar_index")
    j = range_join(one, bars.select(*KEY, "bar_index", "high", "low"), "b0", "b4")
    outside = F.lit(False)
    for i in range(4):
        inner = (x > b[i]) & (x < b[i + 1])
        outside = outside | (inner & ((F.col("high") > F.greatest(p[i], p[i + 1])) | (F.col("low") < F.least(p[i], p[i + 1]))))
    ceil_at, floor_at = s * (p[1] + top * (x - b[1])), s * (p[2] + floor * (x - b[2]))
    hi, lo = F.greatest(s * F.col("high"), s * F.col("low")), F.least(s * F.col("high"), s * F.col("low"))
    zero = F.lit(0.0)
    wedge = (x >= b[1]) & (x <= b[4])
    sums = j.groupBy(*SKEL).agg(
        F.max(outside.cast("int")).alias("_out"),
        F.sum(F.when(wedge, F.greatest(zero, hi - ceil_at) + F.greatest(zero, floor_at - lo))).alias("_spill"),
        F.sum(F.when(wedge, ceil_at - floor_at)).alias("_area"),
    )
    one = one.join(sums, SKEL).withColumn("spill", F.col("_spill") / F.greatest(F.lit(1e-12), F.col("_area")))

    def sane(i: int) -> Column:
        a, c = (b[i - 2] - b[i - 3]).cast("double"), (b[i] - b[i - 1]).cast("double")
        return F.greatest(c / a, a / c) <= MAX_DURATION

    gates = [
        ("W2_BEYOND_START", s * (p[2] - p[0]) > 0),
        ("W3_NO_PENETRATION", s * (p[3] - p[1]) >= PENETRATION * w[1]),
        ("W3_NOT_CONTRACTING", w[3] < w[1]),
        ("W4_NOT_CONTRACTING", w[4] < w[2]),
        ("W4_TOO_SHALLOW", w[4] >= MIN_W4_W3 * w[3]),
        ("W4_TOO_LONG", b[4] - b[3] < b[2] - b[1]),
        ("NO_OVERLAP", s * (p[4] - p[1]) < 0),
        ("W4_SHALLOW_INTO_W2", s * (p[1] - p[4]) >= MIN_W4_W2_LEVEL * w[2]),
        ("W4_BEYOND_W2", s * (p[4] - p[2]) > 0),
        ("LINES_DIVERGE", F.col("convergence") >= min_convergence),
        ("DURATIONS", sane(3) & sane(4)),
        ("NOT_CONTAINED", F.col("_out") == 0),
        ("TOO_FEW_BARS", b[4] - b[0] >= min_bars),
        ("SPILLS_OUT", F.col("spill") <= MAX_SPILL),
    ]
    gate = F.lit("REGISTERED")
    for name, passes in reversed(gates):
        gate = F.when(~passes, F.lit(name)).otherwise(gate)
    return one.withColumn("gate", gate).drop("_out", "_spill", "_area")


def diagonal_wave5(candidates: DataFrame, bars: DataFrame, need_ratio: bool = False) -> DataFrame:
    """Bar at which wave 5 first passes point 3, before price breaks point 4, W5 reaches W3, or it takes too long."""
    up = F.col("is_up")
    s = F.when(up, 1.0).otherwise(-1.0)
    w3 = F.abs(F.col("p3") - F.col("p2"))
    c = candidates.withColumns(
        {
            "w3": w3,
            "_goal": F.greatest(s * F.col("p3"), s * F.col("p4") + (MIN_W5 * w3 if need_ratio else F.lit(0.0))),
            "_end": F.col("b4") + F.floor(MAX_DURATION * (F.col("b3") - F.col("b2"))).cast("long"),
        }
    )
    fwd = F.when(up, F.col("high")).otherwise(-F.col("low"))
    back = F.when(up, F.col("low")).otherwise(-F.col("high"))
    bar = F.col("bar_index")
    beyond = (fwd >= F.col("_goal")) & (fwd > s * F.col("p3")) if need_ratio else fwd > F.col("_goal")
    dead = (back < s * F.col("p4")) | (fwd - s * F.col("p4") >= F.col("w3"))
    hit = first_hit(
        c, bars.select(*KEY, "bar_index", "high", "low"), SKEL, "b4",
        [F.min(F.when(beyond, bar)).alias("fire_bar"), F.min(F.when(dead, bar)).alias("dead_bar")],
        F.col("fire_bar").isNotNull() | F.col("dead_bar").isNotNull(), end="_end",
    )
    ok = F.col("fire_bar").isNotNull() & (F.coalesce("dead_bar", F.lit(2**62)) > F.col("fire_bar"))
    return hit.where(ok).drop("_goal", "_end", "dead_bar")


def diagonal_levels(fired: DataFrame, bars: DataFrame, risk_ratio: float = 1.0, mode: str = "RISK_RATIO", digits: int = 2) -> DataFrame:
    """Counter-trend signal at the close: stop at P4 + W3 with 2 % allowance; target by risk, or 23.6 % of the diagonal; once per point 0."""
    at = bars.select(*KEY, F.col("bar_index").alias("fire_bar"), F.col("close").alias("entry"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    f = fired.join(at, [*KEY, "fire_bar"])
    up = F.col("is_up")
    long = ~up
    s = F.when(up, 1.0).otherwise(-1.0)
    raw = F.col("p4") + s * F.col("w3")
    sl = round_price(raw + s * F.abs(F.col("entry") - raw) * (SL_PERCENT / 100.0), digits, long)
    w5 = F.when(up, F.col("_h")).otherwise(F.col("_l"))
    retrace = w5 - s * 0.236 * F.abs(w5 - F.col("p0"))
    f = f.withColumns({"sl": sl, "is_long": long, "retrace": retrace})
    gap = F.abs(F.col("sl") - F.col("entry"))
    target = F.col("retrace") if mode == "DIAGONAL_RETRACE" else F.col("entry") - s * risk_ratio * gap
    f = f.withColumn("tp", round_price(target, digits, long))
    right = F.when(long, (F.col("sl") < F.col("entry")) & (F.col("tp") > F.col("entry"))).otherwise((F.col("sl") > F.col("entry")) & (F.col("tp") < F.col("entry")))
    hit = F.when(long, (F.col("_h") >= F.col("tp")) | (F.col("_l") <= F.col("sl"))).otherwise((F.col("_l") <= F.col("tp")) | (F.col("_h") >= F.col("sl")))
    f = f.where(right & (gap >= 0.05 * F.col("w3")) & ~hit)
    keep = ["is_long", "entry", "tp", "sl", "retrace", "b1", "b2", "b3", "b4", "fire_bar"]
    one = f.groupBy(*KEY, "is_up", "b0").agg(F.min_by(F.struct(*keep), F.struct("fire_bar", "b4", "b1")).alias("_f")).select(*KEY, "is_up", "b0", "_f.*")
    one = one.withColumnRenamed("fire_bar", "entry_bar")
    return one.withColumn("signal_id", F.concat_ws("|", "symbol", "tf", F.lit("DIAG"), "entry_bar", "b0", "is_up"))


def retrace_management(signals: DataFrame, bars: DataFrame, action: str) -> DataFrame:
    """One-shot action when the retrace level is touched in favour: BREAKEVEN, CLOSE, HALF or HALF_BREAKEVEN.

    Rows are position parts with their share; HALF closes one half at the level.
    """
    s = signals.withColumn("break_even", F.col("retrace"))
    long = F.col("is_long")
    nearer = F.when(long, F.least("tp", "retrace")).otherwise(F.greatest("tp", "retrace"))
    plain = lambda df: signal_outcomes(df, bars, "tp_first").drop("conflict")
    moved = lambda df: break_even_outcomes(df, bars, to_entry=True, policy="tp_first")
    early = s.withColumn("tp", nearer)
    if action == "BREAKEVEN":
        return moved(s).withColumn("share", F.lit(1.0))
    if action == "CLOSE":
        return plain(early).withColumn("share", F.lit(1.0))
    rest = moved(s) if action == "HALF_BREAKEVEN" else plain(s)
    return plain(early).withColumn("share", F.lit(0.5)).unionByName(rest.withColumn("share", F.lit(0.5)), allowMissingColumns=True)


# ---- price speed --------------------------------------------------------------------------------


def rate_fold(percent: float, ratio: float, ready: int) -> Fold:
    """Enter when the major speed is beyond the limit, leave when the minor speed turns; one trade at a time."""

    def step(state, i, close, major, minor):
        up, entry, entry_bar, tp, sl, sl_bar, used, down_bar, down_close, up_bar, up_close = state
        if major <= 0:
            down_bar, down_close = i, close
        if major >= 0:
            up_bar, up_close = i, close
        tail = (down_bar, down_close, up_bar, up_close)
        if i < ready - 1:
            return (up, entry, entry_bar, tp, sl, sl_bar, used, *tail), None
        if entry is not None:
            if (up and minor <= 0) or (not up and minor >= 0):
                # a falling trade closed under its entry counts as the stop: kept as it is
                won = entry < close if up else entry <= close
                row = (entry_bar, up, entry, tp, sl, sl_bar, close, "TP" if won else "SL")
                return (None, None, None, None, None, None, used, *tail), row
            return (up, entry, entry_bar, tp, sl, sl_bar, used, *tail), None
        rising = major > 0
        at, level = (down_bar, down_close) if rising else (up_bar, up_close)
        if level is not None and level > 0 and at != used:
            goal = close + (1 if rising else -1) * abs(close - level) * ratio
            wrong = level >= goal if rising else level <= goal
            if not wrong and abs(major) > percent:
                return (rising, close, i, goal, level, at, at, *tail), None
        return (None, None, None, None, None, None, used, *tail), None

    state = (
        "up boolean, entry double, entry_bar long, tp double, sl double, sl_bar long, used long, "
        "down_bar long, down_close double, up_bar long, up_close double"
    )
    out = "entry_bar long, is_long boolean, entry double, tp double, sl double, sl_bar long, exit_price double, outcome string"
    return Fold(("close", "major", "minor"), state, out, (None,) * 11, step)


def rate_setups(bars: DataFrame, major: int = 14, minor: int = 4, percent: float = 0.2, ratio: float = 2.0) -> DataFrame:
    """Closed trades of the speed finder; ``exit_bar`` is the bar it left on."""
    b = framed(bars, major, 0, ind.price_speed_stage(major, "major"), ind.price_speed_stage(minor, "minor"))
    out, _ = fold_series(b, rate_fold(percent, ratio, major))
    return out.withColumnRenamed("bar_index", "exit_bar")


# ---- figure gates -------------------------------------------------------------------------------


def _at(bars: DataFrame, prefix: str, *cols: str) -> DataFrame:
    return bars.select(*KEY, F.col("bar_index").alias(f"{prefix}_bar"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def gartley_setups(items: DataFrame, bars: DataFrame, min_bars: int = 0, use_candles: DataFrame | None = None, skip_first: bool = False) -> DataFrame:
    """Items that pass the length, RSI (bull rejects under 25, bear over 75) and candle gates."""
    rsi = ind.rsi(bars).select(*KEY, F.col("bar_index").alias("d_bar"), "rsi")
    j = items.where(F.col("d_bar") - F.col("x_bar") >= min_bars).join(rsi, [*KEY, "d_bar"])
    j = j.where(F.when(F.col("is_bull"), F.col("rsi") >= 25).otherwise(F.col("rsi") <= 75))
    if use_candles is not None:
        c = use_candles.where(F.col("pattern").isin("DOWN_OUTER_BAR", "UP_OUTER_BAR", "DOWN_PIN_BAR", "UP_PIN_BAR"))
        j = j.join(c.select(*KEY, F.col("bar_index").alias("d_bar"), "is_bull").distinct(), [*KEY, "d_bar", "is_bull"], "left_semi")
    if skip_first:
        w = Window.partitionBy(*KEY, "d_bar").orderBy("x_bar", "a_bar", "model")
        j = j.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > 1).drop("_n")
    out = j.withColumns({"entry_bar": F.col("d_bar"), "entry": F.col("d_close"), "tp": F.col("tp1"), "is_long": F.col("is_bull")})
    return out.withColumn("signal_id", F.concat_ws("|", "symbol", "tf", F.lit("GART"), "model", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar"))


def harmonic_setups(
    items: DataFrame, bars: DataFrame, min_score: float = 0.0, min_atr: float = 4.0, min_rr: float = 0.0, stop_percent: float = 5.0, use_rsi: bool = False
) -> DataFrame:
    """Figures that pass the gates, entered at the close of the bar after D with target and stop from the pattern's height.

    The RSI gate runs the other way than the Gartley one: a bull needs RSI <= 25.
    """
    j = items.where(F.col("score") >= min_score).withColumn("entry_bar", F.col("d_bar") + 1)
    a = ind.atr(bars, 14).select(*KEY, F.col("bar_index").alias("entry_bar"), F.col("close").alias("entry"), "atr")
    j = j.join(a, [*KEY, "entry_bar"])
    if use_rsi:
        rsi = ind.rsi(bars).select(*KEY, F.col("bar_index").alias("d_bar"), "rsi")
        j = j.join(rsi, [*KEY, "d_bar"]).where(F.when(F.col("is_bull"), F.col("rsi") <= 25).otherwise(F.col("rsi") >= 75))
    side = F.when(F.col("is_bull"), 1.0).otherwise(-1.0)
    tp = F.greatest(F.lit(0.0), F.col("entry") + side * pattern_height())
    j = j.withColumns({"tp": tp, "sl": stop_loss("PATTERN_PERCENT_BEYOND_D", stop_percent, F.col("entry"), tp), "is_long": F.col("is_bull")})
    gap = F.abs(F.col("entry") - F.col("sl"))
    j = j.where(~((F.coalesce("atr", F.lit(0.0)) > 0) & (gap < min_atr * F.col("atr"))))
    j = j.withColumn("risk_reward", risk_reward(F.col("is_long"), F.col("entry"), F.col("tp"), F.col("sl")))
    j = j.where(F.col("risk_reward").isNotNull() & (F.col("risk_reward") >= min_rr))
    return j.withColumn("signal_id", F.concat_ws("|", "symbol", "tf", F.lit("HARM"), "model", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar"))
