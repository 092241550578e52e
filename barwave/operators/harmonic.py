"""Harmonic figures X-A-B-C-D.

Points are columns x, a, b, c, d (prices) and x_bar .. d_bar.  Ratio tests and levels are plain
expressions; the search for X-A-B before a point C reads at most ``DEPTH`` bars back and runs per
block of bars; what becomes of a candidate is a bounded range join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.functions.prices import relative_error, risk_reward, within, within_any
from barwave.operators.joins import range_join
from barwave.operators.pivots import segments, with_pivot_seq
from barwave.operators.series import BLOCK, KEY, Fold, fold_series, framed, halo, with_seq
from barwave.session import cut

# fixed values: model -> (AB/XA, BC/AB, CD/BC, final), final is AD/XA, for CYPHER CD/XC; SHARK only asks AB/XA < 1
DEFINITIONS: dict[str, tuple[tuple, tuple, tuple, tuple]] = {
    "GARTLEY": ((0.6180339887498948,), (0.3819660112501052, 0.8866517793121622), (1.2720196495140689, 1.6180339887498948), (0.7861513777574233,)),
    "BAT": ((0.3819660112501052, 0.5), (0.3819660112501052, 0.8866517793121622), (1.6180339887498948, 2.6180339887498948), (0.8866517793121622,)),
    "BUTTERFLY": ((0.7861513777574233,), (0.3819660112501052, 0.8866517793121622), (1.6180339887498948, 2.6180339887498948), (1.2720196495140689, 1.6180339887498948)),
    "CRAB": ((0.3819660112501052, 0.6180339887498948), (0.3819660112501052, 0.8866517793121622), (2.24, 3.618), (1.6180339887498948,)),
    "SHARK": ((), (1.13, 1.6180339887498948), (1.6180339887498948, 2.24), (0.8866517793121622, 1.13)),
    "CYPHER": ((0.3819660112501052, 0.6180339887498948), (1.2720196495140689, 1.4142135623730950), (), (0.7861513777574233,)),
}
# fixed values: model -> (TP1 basis, ratio), (TP2 basis, ratio)
TARGETS = {
    "GARTLEY": (("AD", 0.6180339887498948), ("AD", 1.2720196495140689)),
    "BAT": (("AD", 0.6180339887498948), ("AD", 1.2720196495140689)),
    "BUTTERFLY": (("AD", 0.6180339887498948), ("AD", 1.2720196495140689)),
    "CRAB": (("AD", 0.6180339887498948), ("AD", 1.6180339887498948)),
    "SHARK": (("AD", 0.3819660112501052), ("POINT_C", 0.0)),
    "CYPHER": (("CD", 0.6180339887498948), ("XA", 1.6180339887498948)),
}
DEPTH, MIN_PERIOD, MAX_PERIOD, LOOKBACK_MULT, BEFORE_PIVOT = 500, 3, 40, 25, 3
FIB_ERROR, ASYMMETRY = 20.0, 250.0
WEIGHTS = (4.0, 2.0, 3.0)  # ratio error, zone confluence, distance of D from the zone


def by_model(pick) -> Column:
    """A column chosen by the ``model`` column."""
    out = None
    for m in DEFINITIONS:
        cond = F.col("model") == m
        out = F.when(cond, pick(m)) if out is None else out.when(cond, pick(m))
    return out


def _ratios(i: int) -> Column:
    """The model's list of allowed ratios: 0 = AB/XA, 1 = BC/AB, 2 = CD/BC, 3 = final (a constant map, folded once)."""
    row = lambda m: f"'{m}', CAST(array({', '.join(repr(r) + 'D' for r in DEFINITIONS[m][i])}) AS ARRAY<DOUBLE>)"
    return F.expr(f"map({', '.join(row(m) for m in DEFINITIONS)})[model]")


def with_models(df: DataFrame) -> DataFrame:
    return df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in DEFINITIONS])))


def xabc_ratios() -> dict[str, Column]:
    return {
        "ab_ratio": F.abs(F.col("a") - F.col("b")) / F.abs(F.col("a") - F.col("x")),
        "bc_ratio": F.abs(F.col("c") - F.col("b")) / F.abs(F.col("a") - F.col("b")),
    }


def d_ratios() -> dict[str, Column]:
    final = F.when(F.col("model") == "CYPHER", F.abs(F.col("c") - F.col("d")) / F.abs(F.col("c") - F.col("x"))).otherwise(
        F.abs(F.col("a") - F.col("d")) / F.abs(F.col("a") - F.col("x"))
    )
    return {"cd_ratio": F.abs(F.col("c") - F.col("d")) / F.abs(F.col("c") - F.col("b")), "final_ratio": final}


def test_xabc(error: float = FIB_ERROR) -> Column:
    """AB and BC legs fit the model."""
    ab = F.when(F.size(_ratios(0)) == 0, F.col("ab_ratio") < 1.0).otherwise(within_any(F.col("ab_ratio"), _ratios(0), error))
    bc = within_any(F.col("bc_ratio"), _ratios(1), error)
    return ab & bc


def test_cd(error: float = FIB_ERROR) -> Column:
    """CD leg and final ratio fit the model; a model without CD/BC ratios skips the former."""
    cd = (F.size(_ratios(2)) == 0) | within_any(F.col("cd_ratio"), _ratios(2), error)
    final = within_any(F.col("final_ratio"), _ratios(3), error)
    return cd & final


def test_ratios(error: float = FIB_ERROR) -> Column:
    return test_xabc(error) & test_cd(error)


def prz_levels() -> Column:
    """Projected price levels of the model, ascending."""
    cypher = F.col("model") == "CYPHER"
    origin = F.when(cypher, F.col("c")).otherwise(F.col("a"))
    base = F.when(cypher, F.col("c") - F.col("x")).otherwise(F.col("a") - F.col("x"))
    by_bc = F.transform(_ratios(2), lambda r: F.col("c") - r * (F.col("c") - F.col("b")))
    return F.array_sort(F.concat(by_bc, F.transform(_ratios(3), lambda r: origin - r * base)))


def with_prz(df: DataFrame) -> DataFrame:
    """Zone ends, the closest pair of levels (the lower pair on a tie) and its score 1 - gap/XA."""
    df = df.withColumn("_lv", prz_levels())
    n = F.size("_lv")
    pairs = F.zip_with(
        F.slice("_lv", F.lit(1), n - 1), F.slice("_lv", F.lit(2), n - 1),
        lambda p, q: F.struct((q - p).alias("gap"), p.alias("lo"), q.alias("hi")),
    )
    near = F.when(n == 1, F.struct(F.lit(0.0).alias("gap"), F.element_at("_lv", 1).alias("lo"), F.element_at("_lv", 1).alias("hi"))).otherwise(
        F.array_min(pairs)
    )
    height = F.abs(F.col("a") - F.col("x"))
    df = df.withColumn("_near", near)
    return df.withColumns(
        {
            "prz_low": F.element_at("_lv", 1),
            "prz_high": F.element_at("_lv", -1),
            "confluent_low": F.col("_near.lo"),
            "confluent_high": F.col("_near.hi"),
            "prz_score": F.when(height > 0, 1.0 - (F.col("_near.hi") - F.col("_near.lo")) / height).otherwise(0.0),
        }
    ).drop("_lv", "_near")


def _mean(*cols: Column) -> Column:
    present = [F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum(present[1:], present[0])
    return F.when(n > 0, total / F.nullif(n, F.lit(0.0))).otherwise(0.0)


def with_score(df: DataFrame, has_d: bool = True) -> DataFrame:
    """Mean ratio error and the weighted score; the zone part does not exist for CYPHER."""
    err = lambda i, c: relative_error(F.col(c), _ratios(i))
    parts = [err(0, "ab_ratio"), err(1, "bc_ratio")]
    height = F.abs(F.col("a") - F.col("x"))
    if has_d:
        parts += [err(2, "cd_ratio"), err(3, "final_ratio")]
        d_err = F.when(
            height > 0, F.least(F.abs(F.col("confluent_low") - F.col("d")), F.abs(F.col("confluent_high") - F.col("d"))) / height
        ).otherwise(0.0)
    df = df.withColumn("fib_error", _mean(*parts))
    wf, wp, wd = WEIGHTS
    use = F.when(F.col("model") == "CYPHER", 0.0).otherwise(1.0)
    num = (1.0 - F.col("fib_error")) * wf + use * F.col("prz_score") * wp
    den = F.lit(wf) + use * wp
    if has_d:
        num, den = num + (1.0 - d_err) * wd, den + wd
    return df.withColumn("score", num / den)


def _legs() -> list[Column]:
    bars = ["x_bar", "a_bar", "b_bar", "c_bar", "d_bar"]
    return [F.col(q) - F.col(p) for p, q in zip(bars, bars[1:])]


def leg_symmetry(percent: float = ASYMMETRY) -> Column:
    """Every leg's duration within +/- percent of the mean of the other three."""
    legs, ok = _legs(), F.lit(True)
    for i, leg in enumerate(legs):
        rest = [l for j, l in enumerate(legs) if j != i]
        mean = (rest[0] + rest[1] + rest[2]) / 3.0
        ok = ok & (leg <= mean * (1.0 + percent / 100.0)) & (leg >= mean * (1.0 - percent / 100.0))
    return ok


def asymmetry() -> Column:
    legs, total = _legs(), F.lit(0.0)
    for i, leg in enumerate(legs):
        rest = [l for j, l in enumerate(legs) if j != i]
        total = total + F.abs(1.0 - leg / ((rest[0] + rest[1] + rest[2]) / 3.0))
    return total / 4.0


def pattern_height() -> Column:
    return F.greatest("x", "a", "b", "c", "d") - F.least("x", "a", "b", "c", "d")


def resolve_target(basis: str, ratio: float, anchor: Column) -> Column:
    """Target price; ``anchor`` is D or the entry price. Points are taken as they are."""
    if basis.startswith("POINT_"):
        return F.col(basis[-1].lower())
    span = {
        "AD": F.col("a") - F.col("d"),
        "XA": F.col("a") - F.col("x"),
        "CD": F.col("c") - F.col("d"),
        "PATTERN_HEIGHT": F.when(F.col("a") > F.col("x"), pattern_height()).otherwise(-pattern_height()),
    }[basis]
    return F.greatest(F.lit(0.0), anchor + F.lit(float(ratio)) * span)


def default_targets(anchor: Column) -> dict[str, Column]:
    return {f"tp{i + 1}": by_model(lambda m, i=i: resolve_target(*TARGETS[m][i], anchor)) for i in (0, 1)}


def stop_loss(mode: str, percent: float, entry: Column, tp1: Column) -> Column:
    p = percent / 100.0
    h = pattern_height()
    bull = F.col("a") > F.col("x")
    sign = F.when(bull, -1.0).otherwise(1.0)
    scale = F.when(bull, 1.0 - p).otherwise(1.0 + p)
    worst = F.when(bull, F.least("x", "d")).otherwise(F.greatest("x", "d"))
    far = F.when(bull, F.col("prz_low")).otherwise(F.col("prz_high"))
    value = {
        "PERCENT_BEYOND_D": F.col("d") * scale,
        "PERCENT_BEYOND_X_OR_D": worst * scale,
        "PERCENT_BEYOND_ENTRY": entry * scale,
        "TARGET_DISTANCE_BEYOND_ENTRY": entry + sign * p * F.abs(tp1 - entry),
        "PERCENT_BEYOND_FARTHEST_PRZ": far * scale,
        "PATTERN_PERCENT_BEYOND_D": F.col("d") + sign * p * h,
        "PATTERN_PERCENT_BEYOND_ENTRY": entry + sign * p * h,
    }[mode]
    return F.when(bull, F.greatest(F.lit(0.0), value)).otherwise(value)


STOP_MODES = (
    "PERCENT_BEYOND_D", "PERCENT_BEYOND_X_OR_D", "PERCENT_BEYOND_ENTRY", "TARGET_DISTANCE_BEYOND_ENTRY",
    "PERCENT_BEYOND_FARTHEST_PRZ", "PATTERN_PERCENT_BEYOND_D", "PATTERN_PERCENT_BEYOND_ENTRY",
)


def target_from_stop(is_bull: Column, entry: Column, sl: Column, ratio: float) -> Column:
    gap = F.abs(entry - sl) * ratio
    return F.greatest(F.lit(0.0), F.when(is_bull, entry + gap).otherwise(entry - gap))


# ---- five consecutive zigzag pivots -------------------------------------------------------------


def five_points(pivots: DataFrame) -> DataFrame:
    """X..D = every five consecutive pivots (windows over pivot numbers, blocked)."""
    names = ["x", "a", "b", "c", "d"]

    def stage(w):
        out = {}
        for i, n in enumerate(names):
            out[n] = F.lead("value", i).over(w) if i else F.col("value")
            out[f"{n}_bar"] = F.lead("bar_index", i).over(w) if i else F.col("bar_index")
        return out

    p = framed(with_pivot_seq(pivots), 0, 4, stage, order="seq")
    return p.where(F.col("d_bar").isNotNull()).select(
        *KEY, "seq", (F.col("a") > F.col("x")).alias("is_bull"), *names, *[f"{n}_bar" for n in names]
    )


def five_point_zigzag(pivots: DataFrame, error: float = FIB_ERROR) -> DataFrame:
    """Five-point windows that fit a model, scored."""
    p = with_models(five_points(pivots).withColumns(xabc_ratios())).where(test_xabc(error))
    p = p.withColumns(d_ratios()).where(test_cd(error))
    return with_score(with_prz(p)).withColumn("asymmetry", asymmetry())


# ---- pivots per period and the X-A-B search -----------------------------------------------------


def pivots_left_right(bars: DataFrame, periods: Sequence[int], right: int | None = None) -> DataFrame:
    """One row per (bar, period) whose high / low is not exceeded in [i - period, i + right]."""
    reach = max(periods)

    def stage(w):
        out = {}
        for p in periods:
            r = p if right is None else right
            span = w.rowsBetween(-p, r)
            full = F.lag("bar_index", p).over(w).isNotNull() & F.lead("bar_index", r).over(w).isNotNull()
            out[f"_h{p}"] = full & (F.max("high").over(span) <= F.col("high"))
            out[f"_l{p}"] = full & (F.min("low").over(span) >= F.col("low"))
        return out

    f = framed(bars, reach, reach if right is None else right, stage)
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_h{p}").alias("is_high"), F.col(f"_l{p}").alias("is_low")) for p in periods])
    out = f.select(*KEY, "bar_index", F.explode(rows).alias("_r")).select(*KEY, "bar_index", "_r.*")
    return out.where(F.col("is_high") | F.col("is_low"))


class Extremes:
    """Largest value of spans of a series, from the maxima of all spans of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray, longest: int):
        self.spans, width = [values], 1
        while 2 * width <= min(longest, len(values)):
            self.spans.append(np.maximum(self.spans[-1][:-width], self.spans[-1][width:]))
            width *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level, out = np.frexp(last - first + 1)[1] - 1, np.empty(len(first))
        for k in np.unique(level):
            at = level == k
            out[at] = np.maximum(self.spans[k][first[at]], self.spans[k][last[at] - (1 << k) + 1])
        return out

    def peaks(self, back: int, ahead: int) -> np.ndarray:
        """Places not exceeded ``back`` values before and ``ahead`` values after them."""
        at = np.arange(back, len(self.spans[0]) - ahead)
        return at[self(at - back, at + ahead) <= self.spans[0][at]]


def _nearest(points: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The largest of the sorted ``points`` up to each limit, -1 if there is none."""
    return np.append(-1, points)[np.searchsorted(points, limit, side="right")]


_XABC = "symbol string, tf string, is_bull boolean, period int, x_bar long, a_bar long, b_bar long, c_bar long, x double, a double, b double, c double"


def _xabc_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per period, all C pivots at once: B, A and X are the nearest earlier pivots of the other kind, and a leg holds if no bar of it goes beyond its ends."""
    pdf = pdf.sort_values("bar_index")
    idx, high, low, own = (pdf[c].to_numpy() for c in ("bar_index", "high", "low", "_own"))
    parts = []
    for bull in (True, False):
        up, dn = (high, low) if bull else (-low, -high)
        top, bottom = (Extremes(v, max(DEPTH, 2 * MAX_PERIOD) + 1) for v in (up, -dn))
        for period in range(MIN_PERIOD, MAX_PERIOD + 1):
            highs, lows = top.peaks(period, period), bottom.peaks(period, period)
            highs, lows = np.setdiff1d(highs, lows), np.setdiff1d(lows, highs)
            c = top.peaks(period, 1)
            found = c[own[c]][None, :]  # newest point first
            for older_kind, gap, inside in ((lows, period, 0), (highs, 1, 1), (lows, 1, 1)):
                oldest = np.maximum(np.maximum(found[0] - min(DEPTH, LOOKBACK_MULT * period), period - idx[0]), 0)
                older = _nearest(older_kind, found[-1] - gap)
                found = np.vstack([found, older])[:, older >= oldest]
                newer, older = found[-2:]
                peak, trough = (older, newer) if older_kind is highs else (newer, older)
                found = found[:, (top(older, newer - inside) <= up[peak]) & (bottom(older, newer - inside) <= -dn[trough])]
            c, b, a, x = found
            of = {"x": (x, dn), "a": (a, up), "b": (b, dn), "c": (c, up)}
            parts.append(pd.DataFrame({"is_bull": bull, "period": period} | {f"{k}_bar": idx[at] for k, (at, _) in of.items()} | {k: np.abs(v[at]) for k, (at, v) in of.items()}))
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "symbol", pdf["symbol"].iloc[0])
    out.insert(1, "tf", pdf["tf"].iloc[0])
    return out


def find_xabc(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """X-A-B-C of every pivot period; each block sees ``DEPTH`` plus one pivot frame of earlier bars and one later bar."""
    b = halo(bars.select(*KEY, "bar_index", "high", "low"), DEPTH + MAX_PERIOD + 1, 1, block=block)
    return b.groupBy(*KEY, "_blk").applyInPandas(_xabc_of_block, _XABC)


# ---- candidates and their point D ---------------------------------------------------------------

CAND = [*KEY, "model", "is_bull", "x_bar", "a_bar", "b_bar", "c_bar"]


def candidates(xabc: DataFrame) -> DataFrame:
    """Model candidates with zone, score, expiry, and the bar at which a newer C on the same X/A/B replaces them."""
    spot = [*KEY, "is_bull", "x_bar", "a_bar", "b_bar", "c_bar"]
    one = xabc.where((F.col("x") != F.col("a")) & (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")))
    one = one.groupBy(*spot, "x", "a", "b", "c").agg(F.min("period").alias("period"))
    # C points on one X/A/B all lie within DEPTH bars, which bounds this window
    w = Window.partitionBy(*KEY, "is_bull", "x_bar", "a_bar", "b_bar").orderBy("c_bar")
    one = one.withColumn("replaced_at", F.lead("c_bar").over(w) + 1)
    grow = (F.col("c_bar") - F.col("x_bar")) / 3.0 * (1.0 + ASYMMETRY / 100.0)
    one = one.withColumn("expires", F.col("c_bar") + F.floor(grow).cast("long")).withColumns(xabc_ratios())
    return with_score(with_prz(with_models(one).where(test_xabc())), has_d=False)


def completions(cands: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar at which a live candidate's point D is confirmed (one bar after D)."""

    def stage(w):
        span = w.rowsBetween(-(BEFORE_PIVOT + 1), 0)
        d_low, d_high = F.lag("low").over(w), F.lag("high").over(w)
        return {
            "_low_pivot": F.min("low").over(span) >= d_low,
            "_high_pivot": F.max("high").over(span) <= d_high,
            "_d_low": d_low,
            "_d_high": d_high,
        }

    b = framed(bars.select(*KEY, "bar_index", "high", "low"), BEFORE_PIVOT + 1, 0, stage)
    b = b.where(F.col("bar_index") >= BEFORE_PIVOT + 1)
    last = F.least(F.col("expires"), F.col("c_bar") + DEPTH)
    live = F.least(last, F.coalesce(F.col("replaced_at") - 1, last))
    j = range_join(cands.withColumn("_from", F.col("c_bar")).withColumn("_to", live), b, "_from", "_to")
    bull = F.col("is_bull")
    broken = (F.col("bar_index") > F.col("c_bar") + 1) & F.when(
        bull, (F.col("high") > F.col("c")) | (F.col("low") < F.col("prz_low"))
    ).otherwise((F.col("low") < F.col("c")) | (F.col("high") > F.col("prz_high")))
    # at most DEPTH bars per candidate
    w = Window.partitionBy(*CAND).orderBy("bar_index")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumns(
        {
            "_dead": F.max(broken.cast("int")).over(so_far),
            "_rl": F.min("low").over(before),
            "_rh": F.max("high").over(before),
            "d": F.when(bull, F.col("_d_low")).otherwise(F.col("_d_high")),
            "d_bar": F.col("bar_index") - 1,
        }
    )
    pivot = F.when(bull, F.col("_low_pivot")).otherwise(F.col("_high_pivot"))
    edge = F.when(bull, (F.col("d") <= F.col("_rl")) & (F.col("c") >= F.col("_rh"))).otherwise(
        (F.col("d") >= F.col("_rh")) & (F.col("c") <= F.col("_rl"))
    )
    hit = j.where((F.col("_dead") == 0) & (F.col("d_bar") > F.col("c_bar")) & pivot & edge & leg_symmetry())
    hit = hit.withColumns(d_ratios()).where(test_cd())
    first = hit.groupBy(*CAND).agg(F.min_by(F.struct("d_bar", "d"), "bar_index").alias("_d"))
    return cands.join(first, CAND).select(*cands.columns, "_d.d_bar", "_d.d")


def _repeat_fold() -> Fold:
    """Drops a candidate registered while the last completed figure of its model and side had the same X, A and B.

    Events come in time order, a registration (kind 0) before a completion (kind 1) of the same bar.
    The state is the last completed X/A/B and the ids of dropped candidates still waiting.
    """

    def step(state, _i, kind, cand, xab):
        last, dropped = state
        waiting = dropped.split(",") if dropped else []
        if kind == 0:
            if xab == last:
                waiting.append(str(cand))
                return (last, ",".join(waiting)), None
            return state, None
        if str(cand) in waiting:
            waiting.remove(str(cand))
            return (last, ",".join(waiting)), (cand, False)
        return (xab, dropped), (cand, True)

    return Fold(("kind", "cand", "xab"), "last string, dropped string", "cand_id long, kept boolean", (None, ""), step, warmup=256)


def drop_repeats(done: DataFrame) -> DataFrame:
    """Completed candidates without re-openings of the figure completed last."""
    keys = [*KEY, "model", "is_bull"]
    done = done.withColumn("xab", F.concat_ws("-", "x_bar", "a_bar", "b_bar"))
    # many candidates may share a bar: a time slot, then the place inside it
    evs = F.array(
        F.struct((F.col("c_bar") + 1).alias("t"), F.lit(0).alias("kind")), F.struct((F.col("d_bar") + 1).alias("t"), F.lit(1).alias("kind"))
    )
    rank = Window.partitionBy(*keys, "c_bar").orderBy("x_bar", "a_bar", "b_bar")
    done = done.withColumn("cand", F.col("c_bar") * (DEPTH + 1) * 64 + F.row_number().over(rank) - 1)
    e = done.select(*keys, "cand", "xab", "x_bar", "a_bar", "b_bar", "c_bar", F.explode(evs).alias("_e")).select("*", "_e.t", "_e.kind")
    # C bars of figures completing at one bar lie within DEPTH, so a slot holds a bounded number of events
    inside = Window.partitionBy(*keys, "t").orderBy("kind", "x_bar", "a_bar", "b_bar", "c_bar")
    slot = e.withColumn("ord", F.col("t") * (DEPTH + 1) * 64 + F.row_number().over(inside))
    seq = with_seq(slot, keys, "ord", "ev_seq", block=4096 * (DEPTH + 1) * 64)
    out, _ = fold_series(seq, _repeat_fold(), keys, "ev_seq")
    kept = out.where("kept").select(*keys, F.col("cand_id").alias("cand"))
    return done.join(kept, [*keys, "cand"]).drop("cand", "xab")


def harmonic_items(bars: DataFrame, xabc: DataFrame | None = None) -> DataFrame:
    """Final figures with score and default targets from D."""
    found = cut(candidates(find_xabc(bars) if xabc is None else xabc).drop("fib_error", "score"))
    done = drop_repeats(cut(completions(found, bars)))
    done = with_score(done.withColumns(d_ratios())).withColumn("asymmetry", asymmetry())
    return done.withColumns(default_targets(F.col("d")))
