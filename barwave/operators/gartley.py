"""Gartley-family figures found by projecting price bands from X and A.

A projection lives at most ``DEPTH`` bars, so each block of bars owns the figures whose X lies in it
and sees only that many bars ahead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.functions.prices import ratio_similarity
from barwave.operators.joins import range_join
from barwave.operators.pivots import fractal_pivots
from barwave.operators.series import BLOCK, KEY, framed, halo

# fixed values: ratio ladder; model -> (XB, XD, BD, AC, basis of the target and of AC)
LADDER = (0.236, 0.382, 0.5, 0.618, 0.707, 0.786, 0.886, 1.0, 1.13, 1.272, 1.41, 1.618, 2.0, 2.24, 2.618, 3.14, 3.618)


def ladder(lo: float, hi: float) -> tuple[float, ...]:
    return tuple(r for r in LADDER if lo <= r <= hi)


MODELS: dict[str, tuple[tuple, tuple, tuple, tuple, str]] = {
    "GARTLEY": ((0.618,), (0.786,), (1.618,), ladder(0.382, 0.886), "AD"),
    "BUTTERFLY": ((0.786,), (1.41,), (2.24,), ladder(0.382, 0.886), "AD"),
    "SHARK": (ladder(0.382, 0.618), (1.13,), (2.24,), ladder(1.13, 1.618), "AD"),
    "CRAB": (ladder(0.382, 0.618), (1.618,), (3.618,), ladder(0.382, 0.886), "AD"),
    "DEEP_CRAB": ((0.886,), (1.618,), (3.618,), ladder(0.382, 0.886), "AD"),
    "BAT": (ladder(0.382, 0.5), (0.886,), (2.618,), ladder(0.382, 0.886), "AD"),
    "ALT_BAT": ((0.382,), (1.13,), (3.618,), ladder(0.382, 0.886), "AD"),
    "CYPHER": (ladder(0.382, 0.618), (0.786,), (2.0,), ladder(1.13, 1.41), "CD"),
}
DEPTH, PERIOD, ALLOWANCE = 300, 3, 0.05
SL_RATIO, TP2_RATIO, MAX_SL_TP = 0.272, 0.618, 4.0


# ---- bands as expressions -----------------------------------------------------------------------


def price_band(origin: Column, base: Column, ratio: Column | float, direction: Column, allowance: float = ALLOWANCE) -> Column:
    """(low, high) of ratio x (1 +/- allowance) of a base leg, laid off from a point."""
    r = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio
    p = origin + direction * (base * (r * (1 - allowance)))
    q = origin + direction * (base * (r * (1 + allowance)))
    return F.struct(F.least(p, q).alias("low"), F.greatest(p, q).alias("high"))


def band_overlap(xd: Column, bd: Column) -> Column:
    """Common part of two bands; null when they do not meet."""
    lo, hi = F.greatest(xd["low"], bd["low"]), F.least(xd["high"], bd["high"])
    return F.when(hi >= lo, F.struct(lo.alias("low"), hi.alias("high")))


def gartley_levels(items: DataFrame) -> DataFrame:
    """Stop and targets from D and the close of D's bar; rows not fit for trade are dropped."""
    bull, close = F.col("is_bull"), F.col("d_close")
    side = F.when(bull, 1.0).otherwise(-1.0)
    size = F.when(F.col("basis") == "CD", F.abs(F.col("c") - F.col("d"))).otherwise(F.abs(F.col("a") - F.col("d")))
    span = F.abs(F.col("d") - close) * (1 + SL_RATIO)
    out = items.withColumns({"sl": close - side * span, "tp1": close + side * span, "tp2": F.col("d") + side * size * TP2_RATIO})
    ok = F.when(bull, close < F.col("tp1")).otherwise(close > F.col("tp1"))
    return out.where(ok & (F.abs(close - F.col("sl")) / F.abs(close - F.col("tp1")) <= MAX_SL_TP))


# ---- X-A pairs ----------------------------------------------------------------------------------


def gartley_pivots(bars: DataFrame, period: int = PERIOD) -> DataFrame:
    """Bars with their pivot flags."""
    marks = fractal_pivots(bars, period)
    b = bars.select(*KEY, "bar_index", "high", "low", "close")
    out = b.join(marks, [*KEY, "bar_index"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_high", "is_low")})


def gartley_xa_pairs(pivots: DataFrame, period: int = PERIOD, depth: int = DEPTH) -> DataFrame:
    """Each X pivot with each later opposite pivot that is a new extreme while X is unbroken.

    A is known ``period`` bars after it formed.  Pairs lie within ``depth`` bars, so every X meets a
    bounded number of bars.
    """
    b = pivots.withColumns({"up": F.col("is_low"), "down": F.col("is_high")})
    sides = F.filter(
        F.array(F.when(F.col("is_low"), F.lit(True)), F.when(F.col("is_high"), F.lit(False))), lambda s: s.isNotNull()
    )
    x = pivots.where(F.col("is_low") | F.col("is_high")).select(*KEY, F.col("bar_index").alias("x_bar"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.explode(sides).alias("is_bull"))
    x = x.select(*KEY, "x_bar", "is_bull", F.when(F.col("is_bull"), F.col("_l")).otherwise(F.col("_h")).alias("x"))
    span = x.withColumn("_from", F.col("x_bar") + 1).withColumn("_to", F.col("x_bar") + depth)
    j = range_join(span, pivots, "_from", "_to")
    sgn = F.when(F.col("is_bull"), 1.0).otherwise(-1.0)
    near = F.when(F.col("is_bull"), F.col("low")).otherwise(-F.col("high"))
    far = F.when(F.col("is_bull"), F.col("high")).otherwise(-F.col("low"))
    opposite = F.when(F.col("is_bull"), F.col("is_high")).otherwise(F.col("is_low"))
    same = F.when(F.col("is_bull"), F.col("is_low")).otherwise(F.col("is_high"))
    w = Window.partitionBy(*KEY, "x_bar", "is_bull").orderBy("bar_index")
    xv = F.col("x") * sgn
    # a broken X is seen from the bar after X was confirmed up to the bar that confirms A
    breach = (F.col("bar_index") > F.col("x_bar") + period) & (near < xv)
    spoiled = same & (near < xv)
    j = j.withColumns(
        {
            "_broken": F.max(breach.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, period)),
            "_spoiled": F.coalesce(F.max(spoiled.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_best": F.max(F.when(opposite, far)).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_last": F.lead("bar_index", period).over(w),
        }
    )
    ok = opposite & (F.col("_broken") == 0) & (F.col("_spoiled") == 0) & (far > xv) & (far >= F.coalesce(F.col("_best"), xv))
    fits = F.col("bar_index") + period - F.col("x_bar") <= depth
    out = j.where(ok & fits & F.col("_last").isNotNull())
    return out.select(*KEY, "is_bull", "x_bar", "x", F.col("bar_index").alias("a_bar"), (far * sgn).alias("a"))


# ---- projections --------------------------------------------------------------------------------


class Lanes:
    """Projections of one model, one lane per X-A pair; every bar offset is one step over all lanes at once.

    Prices are mirrored so that A lies above X: ``up`` and ``down`` are the far and the near side of a bar. Unset points are NaN. B is the
    lowest price so far while that lies in an XB band and no C is set; C is the highest price in an AC band over a B that still is the lowest; D is in
    the zone where the XD and BD bands meet. XD and BD have one ratio each, so a lane has one zone.
    """

    def __init__(self, model: str, x: np.ndarray, a: np.ndarray):
        xb, (xd,), (self.bd,), self.ac, basis = MODELS[model]
        self.xb, self.x, self.a, self.from_x = np.array(xb), x, a, basis == "CD"
        self.xb_low, self.xb_high = self.around(a, x - a, self.xb)
        self.xd_low, self.xd_high = (e[:, 0] for e in self.around(a, x - a, np.array([xd])))
        self.low, self.low_at = np.full(len(x), np.inf), np.full(len(x), -1)
        self.b, self.c, self.d, self.floor, self.ceiling, self.b_ratio, self.c_ratio = (np.full(len(x), np.nan) for _ in range(7))
        self.b_at, self.c_at, self.d_at = (np.full(len(x), -1) for _ in range(3))
        self.open, self.found = np.ones(len(x), bool), np.zeros(len(x), bool)

    @staticmethod
    def around(origin: np.ndarray, leg: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Low and high ends of every ratio's band, lanes by ratios."""
        reach = leg[:, None] * ratios[None, :]
        ends = origin[:, None] + reach * (1 - ALLOWANCE), origin[:, None] + reach * (1 + ALLOWANCE)
        return np.minimum(*ends), np.maximum(*ends)

    @staticmethod
    def rung(price: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a band holds the price, and which is the first."""
        inside = (low <= price[:, None]) & (price[:, None] <= high)
        return inside.any(axis=1), inside.argmax(axis=1)

    def forget(self, lanes: np.ndarray, *points: str) -> None:
        for p in points:
            getattr(self, p)[lanes] = np.nan

    def step(self, here: np.ndarray, at: np.ndarray, up: np.ndarray, down: np.ndarray, close: np.ndarray, quirk: np.ndarray) -> None:
        """One bar. ``quirk``: a falling figure without B is given up on a bar whose high is under A (a rising one: above A)."""
        lower = down < self.low
        self.low[lower], self.low_at[lower] = down[lower], at[lower]
        without_c = np.isnan(self.c)
        self.open &= ~here | ~((down < self.floor) | (without_c & (down < self.x)) | (np.isnan(self.b) & quirk))
        here = here & self.open
        self.forget(here & (up > self.c), "c", "c_ratio", "floor", "ceiling")
        self._place_c(here, at, up)
        hit, which = self.rung(self.low, self.xb_low, self.xb_high)
        takes = here & np.isnan(self.c) & hit & ~(self.b < self.low)
        self.b[takes], self.b_at[takes], self.b_ratio[takes] = self.low[takes], self.low_at[takes], self.xb[which][takes]
        reached = here & (down >= self.floor) & (down <= self.ceiling) & ~(self.d < down)
        self.d[reached], self.d_at[reached] = down[reached], at[reached]
        done = reached & (close != down)
        self.found |= done
        self.open &= ~done

    def _place_c(self, here: np.ndarray, at: np.ndarray, up: np.ndarray) -> None:
        origin, leg = (self.x, self.a - self.x) if self.from_x else (self.b, self.a - self.b)
        hit, which = self.rung(up, *self.around(origin, leg, np.array(self.ac)))
        tries = here & hit & ~np.isnan(self.b) & ~(self.c > up) & (at > self.b_at)
        stale = tries & (self.low < self.b) & (self.low_at > self.b_at)
        self.forget(stale, "b", "b_ratio", "c", "c_ratio", "d", "floor", "ceiling")
        sets = tries & ~stale
        bd_low, bd_high = (e[:, 0] for e in self.around(up, -np.abs(self.b - up), np.array([self.bd])))
        floor, ceiling = np.maximum(bd_low, self.xd_low), np.minimum(bd_high, self.xd_high)
        meet = sets & (ceiling >= floor)
        self.c[sets], self.c_at[sets], self.c_ratio[sets] = up[sets], at[sets], np.array(self.ac)[which][sets]
        self.floor[sets], self.ceiling[sets] = np.where(meet, floor, np.nan)[sets], np.where(meet, ceiling, np.nan)[sets]


_ITEM = (
    "symbol string, tf string, model string, is_bull boolean, x_bar long, x double, a_bar long, a double, b_bar long, b double, "
    "c_bar long, c double, d_bar long, d double, d_close double, xb_want double, ac_want double, bd_want double, xd_want double"
)


def _figures_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Projections of the X-A pairs of one block (rows of pairs and of bars share the group)."""
    names = [f.split()[0] for f in _ITEM.split(", ")]
    bars, pairs = pdf[pdf["a_bar"].isna()].sort_values("bar_index"), pdf[~pdf["a_bar"].isna()]
    if not len(bars) or not len(pairs):
        return pd.DataFrame([], columns=names).astype(object)
    first, last = int(bars["bar_index"].iloc[0]), len(bars) - 1
    high, low, close = (bars[c].to_numpy(float) for c in ("high", "low", "close"))
    bull, x_bar, a_bar = pairs["is_bull"].to_numpy(bool), pairs["x_bar"].to_numpy("int64"), pairs["a_bar"].to_numpy("int64")
    side, x, a = np.where(bull, 1.0, -1.0), pairs["x"].to_numpy(float), pairs["a"].to_numpy(float)
    begin, end = a_bar + PERIOD - first, np.minimum(x_bar + DEPTH - first, last)
    out = []
    for model in MODELS:
        lanes = Lanes(model, side * x, side * a)
        for offset in range(int((end - begin).max(initial=-1)) + 1):
            at = begin + offset
            here = lanes.open & (at <= end)
            if not here.any():
                break
            k = np.minimum(at, last)
            up, down = np.where(bull, high[k], -low[k]), np.where(bull, low[k], -high[k])
            # bars beyond a lane's end leave it as it is
            lanes.step(here, k, np.where(here, up, -np.inf), np.where(here, down, np.inf), side * close[k], np.where(bull, high[k] > a, high[k] < a))
        f = lanes.found
        point = lambda v, f=f: side[f] * v[f]
        out.append(
            pd.DataFrame(
                {
                    "symbol": pairs["symbol"].to_numpy()[f], "tf": pairs["tf"].to_numpy()[f], "model": model, "is_bull": bull[f], "x_bar": x_bar[f], "x": x[f], "a_bar": a_bar[f], "a": a[f],
                    "b_bar": lanes.b_at[f] + first, "b": point(lanes.b), "c_bar": lanes.c_at[f] + first, "c": point(lanes.c), "d_bar": lanes.d_at[f] + first, "d": point(lanes.d),
                    "d_close": close[lanes.d_at[f]], "xb_want": lanes.b_ratio[f], "ac_want": lanes.c_ratio[f], "bd_want": lanes.bd, "xd_want": MODELS[model][1][0],
                }
            )
        )
    return pd.concat(out, ignore_index=True)[names]


def gartley_projection(pivots: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Finished projections: B in the XB band, C in the AC band, D where the XD and BD bands meet."""
    own = pairs.withColumn("_blk", F.floor(F.col("x_bar") / block).cast("long"))
    seen = halo(pivots.select(*KEY, "bar_index", "high", "low", "close"), 0, DEPTH, block=block).drop("_own")
    both = own.unionByName(seen, allowMissingColumns=True)
    return both.groupBy(*KEY, "_blk").applyInPandas(_figures_of_block, _ITEM)


def gartley_items(figures: DataFrame, pivots: DataFrame, levels: bool = True) -> DataFrame:
    """Figures with no bar outside a leg between its points, B and C on pivots, and their accuracy."""
    legs = F.array(
        *[
            F.struct(F.col(f"{p}_bar").alias("s"), F.col(f"{q}_bar").alias("e"), F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
            for p, q in zip("xabc", "abcd")
        ]
    )
    ident = [*KEY, "model", "is_bull", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar"]
    l = figures.select(*ident, F.explode(legs).alias("_l")).select(*ident, (F.col("_l.s") + 1).alias("_from"), (F.col("_l.e") - 1).alias("_to"), "_l.lo", "_l.hi")
    out_of = range_join(l, pivots, "_from", "_to").where((F.col("high") > F.col("hi")) | (F.col("low") < F.col("lo")))
    clean = figures.join(out_of.select(*ident).distinct(), ident, "left_anti")
    mark = lambda n: pivots.select(*KEY, F.col("bar_index").alias(f"{n}_bar"), F.col("is_high").alias(f"_{n}h"), F.col("is_low").alias(f"_{n}l"))
    clean = clean.join(mark("b"), [*KEY, "b_bar"]).join(mark("c"), [*KEY, "c_bar"])
    bull = F.col("is_bull")
    clean = clean.where(F.when(bull, F.col("_bl") & F.col("_ch")).otherwise(F.col("_bh") & F.col("_cl")))
    xa, ab, cb = F.abs(F.col("a") - F.col("x")), F.abs(F.col("b") - F.col("a")), F.abs(F.col("c") - F.col("b"))
    basis = F.when(F.col("model") == "CYPHER", "CD").otherwise("AD")
    clean = clean.drop("_bh", "_bl", "_ch", "_cl").withColumns(
        {
            "basis": basis,
            "xb": ab / xa,
            "xd": F.abs(F.col("a") - F.col("d")) / xa,
            "bd": F.abs(F.col("c") - F.col("d")) / cb,
            "ac": F.when(basis == "CD", F.abs(F.col("c") - F.col("x")) / xa).otherwise(cb / ab),
        }
    )
    parts = [ratio_similarity(F.col(f"{n}_want"), F.col(n)) for n in ("ac", "bd", "xb", "xd")]
    clean = clean.withColumn("accuracy", F.bround((parts[0] + parts[1] + parts[2] + parts[3]) / 4 * 100, 0).cast("int"))
    return gartley_levels(clean) if levels else clean


def dedupe_items(items: DataFrame) -> DataFrame:
    """One item per X/A/B/C, then one per D and stop: the first in time order stays."""
    order = [F.col("d_bar"), F.col("x_bar"), F.col("a_bar"), F.col("model")]
    pick = F.struct("d_bar", "x_bar", "a_bar", "model")
    rest = lambda keys: [c for c in items.columns if c not in keys]
    first = [*KEY, "x_bar", "a_bar", "b_bar", "c_bar"]
    one = items.groupBy(*first).agg(F.min_by(F.struct(*rest(first)), pick).alias("_r")).select(*first, "_r.*")
    second = [*KEY, "d_bar", "sl"]
    two = one.groupBy(*second).agg(F.min_by(F.struct(*rest(second)), pick).alias("_r")).select(*second, "_r.*")
    return two.select(*items.columns)
