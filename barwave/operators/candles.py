"""Candle patterns: boolean expressions over one window of lagged bars.

Bars are named by age: 1 = current, 2 = previous, ... with columns o/h/l/c plus age.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwave.operators.series import framed

LOOKBACK = 9  # a bar is judged once nine earlier bars exist

# fixed values: pattern -> (is_bull, stop bar age offset or -1 = extreme of the pattern, bars, limit bar)
SETTINGS: dict[str, tuple[bool, int, int, int | None]] = {
    "HAMMER": (True, 0, 1, None),
    "INVERTED_HAMMER": (False, 0, 1, None),
    "UP_PIN_BAR": (True, 0, 2, None),
    "DOWN_PIN_BAR": (False, 0, 2, None),
    "UP_PIN_BAR_TRIO": (True, 1, 3, None),
    "DOWN_PIN_BAR_TRIO": (False, 1, 3, None),
    "UP_OUTER_BAR": (True, 0, 2, None),
    "DOWN_OUTER_BAR": (False, 0, 2, None),
    "UP_OUTER_BAR_BODIES": (True, -1, 2, None),
    "DOWN_OUTER_BAR_BODIES": (False, -1, 2, None),
    "UP_INNER_BAR": (True, 1, 2, None),
    "DOWN_INNER_BAR": (False, 1, 2, None),
    "UP_PPR": (True, 1, 3, None),
    "DOWN_PPR": (False, 1, 3, None),
    "UP_RAILS": (True, -1, 2, 0),
    "DOWN_RAILS": (False, -1, 2, 0),
    "UP_PPR_IB": (True, -1, 4, 0),
    "DOWN_PPR_IB": (False, -1, 4, 0),
    "UP_DOUBLE_INNER_BAR": (True, -1, 3, 0),
    "DOWN_DOUBLE_INNER_BAR": (False, -1, 3, 0),
    "UP_CPPR": (True, -1, 0, None),
    "DOWN_CPPR": (False, -1, 0, None),
    "UP_DOJI": (True, 0, 2, None),
    "DOWN_DOJI": (False, 0, 2, None),
    "PIECING_LINE": (True, 0, 2, None),
    "DARK_CLOUD": (False, 0, 2, None),
    "UP_HARAMI": (True, 0, 2, None),
    "DOWN_HARAMI": (False, 0, 2, None),
}
UNGATED = {
    "HAMMER", "INVERTED_HAMMER", "UP_RAILS", "DOWN_RAILS", "UP_PPR_IB", "DOWN_PPR_IB",
    "UP_DOUBLE_INNER_BAR", "DOWN_DOUBLE_INNER_BAR", "UP_CPPR", "DOWN_CPPR",
}


def _body(i: int) -> str:
    return f"abs(c{i} - o{i})"


def _inner(up: bool, i: int = 1) -> str:
    p = i + 1
    if up:
        return f"(o{i} < c{i} AND h{p} > h{i} AND l{p} < l{i} AND c{p} > o{i} AND o{p} <= o{i})"
    return f"(o{i} > c{i} AND o{p} < c{p} AND h{p} > h{i} AND l{p} < l{i} AND c{p} >= o{i})"


def _ppr(up: bool, i: int = 1) -> str:
    a, b = i + 1, i + 2
    if up:
        return f"(o{b} > c{b} AND o{a} > c{a} AND h{b} > h{a} AND o{i} < c{i} AND l{i} > l{a} AND l{b} > l{a})"
    return f"(o{b} < c{b} AND o{a} < c{a} AND l{b} < l{a} AND o{i} > c{i} AND h{i} < h{a} AND h{b} < h{a})"


def _doji(up: bool, min_body: float) -> str:
    top, bottom = "greatest(o1, c1)", "least(o1, c1)"
    shape = f"({_body(1)} < 0.4 * (h1 - l1) AND h1 - {top} > 0.3 * (h1 - l1) AND {bottom} - l1 > 0.3 * (h1 - l1))"
    hi, lo = ("o2", "c2") if up else ("c2", "o2")
    return f"({shape} AND {hi} > {lo} AND {hi} - {lo} > {min_body!r} AND {hi} >= {top} AND {lo} <= {bottom})"


def predicates(digits: int) -> dict[str, str]:
    """SQL text of every fixed-length pattern."""
    min_body = 15 * 10.0 ** -digits
    rng = "(h1 - l1)"
    rails_len = "(greatest(h2, h1) - least(l2, l1))"
    rails = (
        f"({rails_len} > 0 AND (h3 - l3) <= {rails_len} * 0.5 AND {_body(2)} >= {rails_len} * 0.7 AND {_body(1)} >= {rails_len} * 0.7"
        f" AND abs(c2 - o1) < {rails_len} * 0.1 AND abs(o2 - c1) < {rails_len} * 0.1)"
    )
    wide = f"({_body(2)} >= 0.7 * (h2 - l2) AND {_body(1)} >= 0.7 * {rng} AND h2 > l2 AND h1 > l1)"
    ppr_ib = f"(({_ppr(False, 2)} AND {_inner(True)}) OR ({_ppr(True, 2)} AND {_inner(False)}))"
    bodies = "greatest(o2, c2) <= greatest(o1, c1) AND least(o2, c2) >= least(o1, c1)"
    around = "h2 < h1 AND l2 > l1"
    return {
        "HAMMER": f"o1 > c1 AND o1 > l1 + {rng} * 0.7 AND c1 > l1 + {rng} * 0.7",
        "INVERTED_HAMMER": f"o1 < c1 AND o1 < h1 - {rng} * 0.7 AND c1 < h1 - {rng} * 0.7",
        "UP_PIN_BAR": f"{_body(2)} > {_body(1)} AND o2 > c2 AND o1 - l1 > 0.5 * {_body(1)} AND o1 - l1 > 2 * (h1 - c1)",
        "DOWN_PIN_BAR": f"{_body(2)} > {_body(1)} AND c2 > o2 AND h1 - o1 > 0.5 * {_body(1)} AND h1 - o1 > 2 * (c1 - l1)",
        "UP_PIN_BAR_TRIO": "least(o2, c2) >= h2 - (h2 - l2) / 3 AND l3 >= h2 - (h2 - l2) / 2 AND c2 <= h3"
        " AND l1 >= h2 - (h2 - l2) / 2 AND c1 > h2",
        "DOWN_PIN_BAR_TRIO": "greatest(o2, c2) <= l2 + (h2 - l2) / 3 AND h3 <= l2 + (h2 - l2) / 2 AND c2 >= l3"
        " AND h1 <= l2 + (h2 - l2) / 2 AND c1 < l2",
        "UP_OUTER_BAR": f"o1 < c1 AND o2 > c1 AND {around}",
        "DOWN_OUTER_BAR": f"o1 > c1 AND o2 < c1 AND {around}",
        "UP_OUTER_BAR_BODIES": f"o1 < c1 AND {bodies}",
        "DOWN_OUTER_BAR_BODIES": f"o1 > c1 AND {bodies}",
        "UP_INNER_BAR": _inner(True),
        "DOWN_INNER_BAR": _inner(False),
        "UP_PPR": _ppr(True),
        "DOWN_PPR": _ppr(False),
        "UP_RAILS": f"{rails} AND o2 > c2 AND o1 < c1",
        "DOWN_RAILS": f"{rails} AND o2 < c2 AND o1 > c1",
        "UP_PPR_IB": ppr_ib,
        "DOWN_PPR_IB": ppr_ib,
        "UP_DOUBLE_INNER_BAR": f"{_inner(True, 2)} AND {_inner(False)}",
        "DOWN_DOUBLE_INNER_BAR": f"{_inner(False, 2)} AND {_inner(True)}",
        "UP_DOJI": _doji(True, min_body),
        "DOWN_DOJI": _doji(False, min_body),
        "PIECING_LINE": f"{wide} AND o2 - c2 > {min_body!r} AND o1 < c1 AND o1 <= c2 AND c1 < o2 AND c1 > (o2 + c2) / 2",
        "DARK_CLOUD": f"{wide} AND o2 < c2 AND o1 > c1 AND o1 >= c2 AND c1 > o2 AND c1 < (o2 + c2) / 2",
        "UP_HARAMI": "o2 > c2 AND c1 > o1 AND c1 <= o2 AND c1 - o1 < o2 - c2",
        "DOWN_HARAMI": "o2 < c2 AND o1 > c1 AND o1 <= c2 AND o2 <= c1 AND o1 - c1 < c2 - o2",
    }


def strength(up: bool) -> str:
    return f"(h1 > l1 AND abs(c1 - {'h1' if up else 'l1'}) < 0.1 * (h1 - l1))"


def mother_offset() -> str:
    """Age offset 2..9 of the nearest bar that strictly contains all later bars, else null (columns mh/ml per offset)."""
    return "CASE " + " ".join(f"WHEN h{k + 1} > mh{k} AND l{k + 1} < ml{k} THEN {k}" for k in range(2, LOOKBACK + 1)) + " END"


def lagged(bars: DataFrame) -> DataFrame:
    """Bars with the nine bars before them as columns, and the running extremes the mother-bar test needs."""

    def stage(w):
        cols = {}
        for k in range(LOOKBACK + 1):
            for name in ("high", "low") + (("open", "close") if k < 4 else ()):
                cols[f"{name[0]}{k + 1}"] = F.lag(name, k).over(w)
        for k in range(2, LOOKBACK + 1):
            cols[f"mh{k}"] = F.max("high").over(w.rowsBetween(-(k - 1), 0))
            cols[f"ml{k}"] = F.min("low").over(w.rowsBetween(-(k - 1), 0))
        return cols

    return framed(bars, LOOKBACK, 0, stage).where(F.col("bar_index") >= LOOKBACK)


def _extreme(is_bull: bool, bars: int) -> tuple[str, str]:
    """Value and bar of the pattern's extreme; the most recent bar wins a tie."""
    col, pick = ("l", "least") if is_bull else ("h", "greatest")
    ages = range(1, bars + 1)
    value = f"{pick}({', '.join(f'{col}{a}' for a in ages)})"
    where = "CASE " + " ".join(f"WHEN {col}{a} = {value} THEN bar_index - {a - 1}" for a in ages) + " END"
    return value, where


def level_texts(name: str) -> tuple[str, str, str, str]:
    """SQL text of (bars, stop, stop_bar, limit_price) of a pattern that fired."""
    is_bull, stop_bar, bars, limit = SETTINGS[name]
    near, far = ("l", "h") if is_bull else ("h", "l")
    if bars == 0:
        pick = lambda c: "CASE mother " + " ".join(f"WHEN {k} THEN {c}{k + 1}" for k in range(2, LOOKBACK + 1)) + " END"
        return "mother + 1", pick(near), "bar_index - mother - 1", pick(far)
    if stop_bar >= 0:
        stop, at = f"{near}{stop_bar + 1}", f"bar_index - {stop_bar}"
    else:
        stop, at = _extreme(is_bull, bars)
    return str(bars), stop, at, "CAST(NULL AS DOUBLE)" if limit is None else f"{far}{limit + 1}"


def fires(name: str, preds: dict[str, str], use_strength: bool) -> str:
    if SETTINGS[name][2] == 0:
        return "mother IS NOT NULL"
    text = preds[name]
    return f"({text}) AND {strength(SETTINGS[name][0])}" if use_strength and name not in UNGATED else text


def candle_patterns(
    bars: DataFrame, digits: int = 2, use_strength: bool = False, patterns: Collection[str] | None = None
) -> DataFrame:
    """One row per (bar, pattern) with stop, stop bar and limit price."""
    names = [p for p in SETTINGS if patterns is None or p in patterns]
    preds = predicates(digits)
    rows = lagged(bars).withColumn("mother", F.expr(mother_offset()))
    fired = F.array(*[F.when(F.expr(fires(n, preds, use_strength)), F.lit(n)) for n in names])
    ages = range(1, LOOKBACK + 2)
    hit = rows.select(
        "symbol", "tf", "bar_index", "close", "mother",
        F.array(*[f"h{a}" for a in ages]).alias("_h"), F.array(*[f"l{a}" for a in ages]).alias("_l"),
        F.explode(F.filter(fired, lambda n: n.isNotNull())).alias("pattern"),
    )
    def setting(i: int, cast: str):
        value = lambda v: "NULL" if v is None else str(v).lower()
        pairs = ", ".join(f"'{n}', CAST({value(SETTINGS[n][i])} AS {cast})" for n in names)
        return F.expr(f"map({pairs})[pattern]")

    hit = hit.withColumns({"is_bull": setting(0, "boolean"), "_stop": setting(1, "int"), "_n": setting(2, "int"), "_lim": setting(3, "int")})
    mother = (F.col("_n") == 0)
    count = F.when(mother, F.col("mother") + 1).otherwise(F.col("_n")).cast("int")
    near = F.when(F.col("is_bull"), F.col("_l")).otherwise(F.col("_h"))
    far = F.when(F.col("is_bull"), F.col("_h")).otherwise(F.col("_l"))
    span = F.slice(near, F.lit(1), count)
    edge = F.when(F.col("is_bull"), F.array_min(span)).otherwise(F.array_max(span))
    # the most recent bar holding the extreme; a mother bar's stop bar is one further back
    offset = F.when(F.col("_stop") >= 0, F.col("_stop")).when(mother, count).otherwise(F.array_position(span, edge) - 1)
    stop = F.when(F.col("_stop") >= 0, F.element_at(near, F.col("_stop") + 1)).when(mother, F.element_at(near, count)).otherwise(edge)
    limit = F.when(mother, F.element_at(far, count)).when(F.col("_lim").isNotNull(), F.element_at(far, F.coalesce("_lim", F.lit(0)) + 1))
    out = hit.select(
        "symbol", "tf", "bar_index", "close", "pattern", "is_bull", count.alias("bars"), stop.alias("stop"),
        (F.col("bar_index") - offset).cast("long").alias("stop_bar"), limit.alias("limit_price"),
    )
    return out.where(F.col("stop") != 0)


def pattern_rectangle(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Low and high over the bars of each pattern (at most ten bars, so lags suffice)."""
    wide = lagged(bars).select("symbol", "tf", "bar_index", *[f"{c}{k}" for c in "hl" for k in range(1, LOOKBACK + 2)])
    j = patterns.join(wide, ["symbol", "tf", "bar_index"])
    ages = range(1, LOOKBACK + 2)
    lo = F.least(*[F.when(F.lit(a) <= F.col("bars"), F.col(f"l{a}")) for a in ages])
    hi = F.greatest(*[F.when(F.lit(a) <= F.col("bars"), F.col(f"h{a}")) for a in ages])
    return j.select("symbol", "tf", "bar_index", "pattern", lo.alias("rect_low"), hi.alias("rect_high"))


def pattern_histogram(bars: DataFrame, period: int = 10) -> DataFrame:
    """Rolling count of upward minus downward three-bar reversals."""
    preds = predicates(2)

    def stage(w):
        out = {}
        for k in range(3):
            for name in ("high", "low", "open", "close"):
                out[f"{name[0]}{k + 1}"] = F.lag(name, k).over(w)
        return out

    def score(_):
        up, down = F.expr(preds["UP_PPR"]), F.expr(preds["DOWN_PPR"])
        net = F.when(F.coalesce(up, F.lit(False)), 1).otherwise(0) - F.when(F.coalesce(down, F.lit(False)), 1).otherwise(0)
        return {"_net": F.when(F.col("bar_index") >= LOOKBACK, net).otherwise(0)}

    def total(w):
        return {"histogram": F.sum("_net").over(w.rowsBetween(-(period - 1), 0))}

    return framed(bars, period + 2, 0, stage, score, total).select("symbol", "tf", "bar_index", "histogram")


PINE = {
    # fixed values: minimum body 15 points, doji wicks 60 %, pin share 70 %
    "DARK_CLOUD_PINE": "c2 > o2 AND c2 - o2 > {m} AND abs(c2 - o2) >= 0.7 * (h2 - l2) AND c1 < o1 AND abs(c1 - o1) >= 0.7 * (h1 - l1)"
    " AND o1 >= c2 AND c1 > o2 AND c1 < (o2 + c2) / 2",
    "PIERCING_PINE": "c2 < o2 AND o2 - c2 > {m} AND abs(o2 - c2) >= 0.7 * (h2 - l2) AND c1 > o1 AND abs(c1 - o1) >= 0.7 * (h1 - l1)"
    " AND o1 <= c2 AND c1 < o2 AND c1 > (o2 + c2) / 2",
    "DOJI_BULL_PINE": "o2 > c2 AND o2 - c2 > {m} AND o2 >= greatest(c1, o1) AND c2 <= least(c1, o1) AND abs(c1 - o1) < 0.4 * (h1 - l1)"
    " AND h1 - greatest(c1, o1) > 0.3 * (h1 - l1) AND least(c1, o1) - l1 > 0.3 * (h1 - l1)",
    "DOJI_BEAR_PINE": "o2 < c2 AND c2 - o2 > {m} AND c2 >= greatest(c1, o1) AND o2 <= least(c1, o1) AND abs(c1 - o1) < 0.4 * (h1 - l1)"
    " AND h1 - greatest(c1, o1) > 0.3 * (h1 - l1) AND least(c1, o1) - l1 > 0.3 * (h1 - l1)",
    "BULL_ENGULF_PINE": "c2 < o2 AND c1 > o1 AND c1 >= h2 AND o1 <= c2",
    "BEAR_ENGULF_PINE": "c2 > o2 AND c1 < o1 AND c1 <= l2 AND o1 >= c2",
    "INSIDE_PINE": "h1 < h2 AND l1 > l2",
    "OUTSIDE_BULL_PINE": "o2 > c2 AND o1 < c1 AND h1 > h2 AND l1 < l2",
    "OUTSIDE_BEAR_PINE": "o2 < c2 AND o1 > c1 AND h1 > h2 AND l1 < l2",
    "UP_REJECTION_PINE": "o1 > c1 AND o1 < h1 - (h1 - l1) * 0.7 AND c1 < h1 - (h1 - l1) * 0.7",
    "DOWN_REJECTION_PINE": "o1 < c1 AND o1 > l1 + (h1 - l1) * 0.7 AND c1 > l1 + (h1 - l1) * 0.7",
    "INVERTED_HAMMER_PINE": "o1 < c1 AND o1 < h1 - (h1 - l1) * 0.7 AND c1 < h1 - (h1 - l1) * 0.7",
    "HAMMER_PINE": "o1 > c1 AND o1 > l1 + (h1 - l1) * 0.7 AND c1 > l1 + (h1 - l1) * 0.7",
    "PIN_HIGH_PINE": "c2 > o2 AND abs(c2 - o2) > abs(c1 - o1) AND h1 - greatest(o1, c1) > 0.5 * abs(c1 - o1)"
    " AND h1 - greatest(o1, c1) > 2 * (least(o1, c1) - l1)",
    "PIN_LOW_PINE": "o2 > c2 AND abs(c2 - o2) > abs(c1 - o1) AND least(o1, c1) - l1 > 0.5 * abs(c1 - o1)"
    " AND least(o1, c1) - l1 > 2 * (h1 - greatest(o1, c1))",
}


def pine_patterns(bars: DataFrame, tick: float = 0.01) -> DataFrame:
    def stage(w):
        return {f"{n[0]}{k + 1}": F.lag(n, k).over(w) for k in range(2) for n in ("open", "high", "low", "close")}

    rows = framed(bars, 1, 0, stage).where(F.col("bar_index") >= 1)
    names = F.array(*[F.when(F.expr(t.format(m=repr(15 * tick))), F.lit(n)) for n, t in PINE.items()])
    return rows.select("symbol", "tf", "bar_index", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("pattern"))
