"""Scalar price math queries: each function applied to every bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.functions import fib, prices
from barwave.operators.series import framed
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.sources.ticks import walk_bars

ID = ("symbol", "tf", "bar_index")
I = "symbol, tf, bar_index"
# a long setup for green bars, a short one for the rest; stop at the far end, target twice as far
_LV = """, lv AS (SELECT *, close >= open AS up, close AS entry, CASE WHEN close >= open THEN low ELSE high END AS sl,
    CASE WHEN close >= open THEN close + 2 * (close - low) ELSE close - 2 * (high - close) END AS tp FROM bars)"""


def levels(spark, sf):
    b = walk_bars(spark, sf)
    up = F.col("close") >= F.col("open")
    return b.withColumns(
        {
            "up": up,
            "entry": F.col("close"),
            "sl": F.when(up, F.col("low")).otherwise(F.col("high")),
            "tp": F.when(up, F.col("close") + 2 * (F.col("close") - F.col("low"))).otherwise(F.col("close") - 2 * (F.col("high") - F.col("close"))),
        }
    )


@query(
    "p01_candle_features",
    with_bars(
        f"SELECT {I}, (high + low) / 2 AS median, least(open, close) AS body_low, greatest(open, close) AS body_high, round(greatest(high - low, 0), 6) AS candle_length FROM bars WHERE high >= low"
    ),
)
def q1(spark, sf):
    return prices.candle_features(walk_bars(spark, sf)).select(*ID, "median", "body_low", "body_high", F.round("candle_length", 6).alias("candle_length"))


@query(
    "p02_is_strength_bar",
    with_bars(
        f"SELECT {I}, coalesce(high > low AND abs(close - high) / nullif(high - low, 0) < 0.1, false) AS strong_up, coalesce(high > low AND abs(close - low) / nullif(high - low, 0) < 0.1, false) AS strong_down FROM bars"
    ),
)
def q2(spark, sf):
    return walk_bars(spark, sf).select(*ID, prices.is_strength_bar(True).alias("strong_up"), prices.is_strength_bar(False).alias("strong_down"))


@query("p03_bar_range_bps", with_bars(f"SELECT {I}, round((high - low) / close * 10000, 8) AS bps FROM bars WHERE close > 0"))
def q3(spark, sf):
    from barwave.operators.indicators import range_bps

    return walk_bars(spark, sf).where("close > 0").select(*ID, F.round(range_bps(), 8).alias("bps"))


@query(
    "p04_true_range",
    with_bars(
        f"SELECT {I}, round(greatest(high, p) - least(low, p), 6) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_index) AS p FROM bars)"
    ),
)
def q4(spark, sf):
    from barwave.operators.indicators import true_range_stage

    return framed(walk_bars(spark, sf), 1, 0, true_range_stage()).select(*ID, F.round("tr", 6).alias("tr"))


@query(
    "p05_round_price",
    with_bars(
        f"SELECT {I}, CASE WHEN close >= open THEN trunc(close / 7 * 10) ELSE ceil(close / 7 * 10) END / 10 AS level FROM bars"
    ),
)
def q5(spark, sf):
    return walk_bars(spark, sf).select(*ID, prices.round_price(F.col("close") / 7, 1, F.col("close") >= F.col("open")).alias("level"))


@query(
    "p06_p07_position_volume",
    with_bars(
        _LV
        + f""", v AS (SELECT *, 1.0::DOUBLE / (abs(entry - sl) * 0.1::DOUBLE / 10000.0::DOUBLE * 100) AS vol FROM lv WHERE abs(entry - sl) > 0)
        SELECT {I}, round(vol, 5) AS volume, CASE WHEN vol / 2 / 1 <= 4.7713 THEN round(vol / 2, 5) END AS capped FROM v"""
    ),
)
def q6(spark, sf):
    v = prices.position_volume(F.lit(1.0), F.lit(10000.0), F.col("entry") - F.col("sl"), F.lit(0.1))
    l = levels(spark, sf).where(F.abs(F.col("entry") - F.col("sl")) > 0).withColumn("volume", v)
    # 1 % of 10000 is twice the money limit of 50
    capped = prices.cap_volume(F.col("volume"), F.lit(1.0), F.lit(10000.0), 50.0, 1.0, 4.7713)
    return l.select(*ID, F.round("volume", 5).alias("volume"), F.round(capped, 5).alias("capped"))


@query("p08_is_big_spread", with_bars(_LV + f" SELECT {I}, 30 / nullif(abs(tp - sl), 0) > 0.2 OR abs(tp - sl) = 0 AS big FROM lv"))
def q8(spark, sf):
    return levels(spark, sf).select(*ID, prices.is_big_spread(F.lit(30.0), F.col("tp"), F.col("sl")).alias("big"))


SESSIONS = ((1, 8 * 3600, 1, 20 * 3600), (2, 8 * 3600, 4, 20 * 3600), (5, 8 * 3600, 5, 18 * 3600))


@query(
    "p09_has_trade_break",
    with_bars(
        f""", s AS (SELECT unnest([1, 2, 5]) AS d1, 28800 AS t1, unnest([1, 4, 5]) AS d2, unnest([72000, 72000, 64800]) AS t2),
        w AS (SELECT *, date_trunc('day', open_time) - to_days(CAST(dayofweek(open_time) AS INTEGER)) AS wk FROM bars)
        SELECT {I}, NOT bool_or(open_time > wk + to_seconds(d1 * 86400 + t1 + 3600) AND open_time + INTERVAL 5 HOUR < wk + to_seconds(d2 * 86400 + t2 - 3600)) AS has_break
        FROM w, s GROUP BY {I}"""
    ),
)
def q9(spark, sf):
    return walk_bars(spark, sf).select(
        *ID, prices.has_trade_break(F.col("open_time"), F.col("open_time") + F.expr("INTERVAL 5 HOURS"), SESSIONS).alias("has_break")
    )


@query(
    "p10_risk_reward",
    with_bars(
        _LV
        + f" SELECT {I}, round(CASE WHEN up AND tp > entry AND sl < entry OR NOT up AND tp < entry AND sl > entry THEN abs(tp - entry) / abs(entry - sl) END, 8) AS rr FROM lv"
    ),
)
def q10(spark, sf):
    return levels(spark, sf).select(*ID, F.round(prices.risk_reward(F.col("up"), F.col("entry"), F.col("tp"), F.col("sl")), 8).alias("rr"))


@query(
    "p11_break_even_price",
    with_bars(_LV + f" SELECT {I}, round(sl + abs(tp - sl) * 0.4::DOUBLE * CASE WHEN tp > sl THEN 1 ELSE -1 END, 6) AS be FROM lv"),
)
def q11(spark, sf):
    return levels(spark, sf).select(*ID, F.round(prices.break_even_price(F.col("tp"), F.col("sl"), 0.4), 6).alias("be"))


_RATIO = ", rt AS (SELECT *, (high - low) / nullif(lag(high - low) OVER (PARTITION BY symbol ORDER BY bar_index), 0) AS ratio FROM bars)"


def ratios(spark, sf):
    span = F.col("high") - F.col("low")
    return framed(
        walk_bars(spark, sf), 1, 0, lambda w: {"ratio": span / F.nullif(F.lag(span).over(w), F.lit(0.0))}
    ).where(F.col("ratio").isNotNull())


@query(
    "p12_within",
    with_bars(
        _RATIO
        + f""" SELECT {I}, (ratio <= 0.5 * 1.2 AND ratio >= 0.5 * 0.8) OR (ratio <= 0.886 * 1.2 AND ratio >= 0.886 * 0.8) AS hit,
        round(least(abs(1 - ratio / 0.5::DOUBLE), abs(1 - ratio / 0.886::DOUBLE)), 8) AS error FROM rt WHERE ratio IS NOT NULL"""
    ),
)
def q12(spark, sf):
    e = F.array(F.lit(0.5), F.lit(0.886))
    return ratios(spark, sf).select(*ID, prices.within_any(F.col("ratio"), e).alias("hit"), F.round(prices.relative_error(F.col("ratio"), e), 8).alias("error"))


@query(
    "p13_levels_between",
    with_bars(
        f"SELECT {I}, v AS level FROM (SELECT *, unnest(range(40000, 60000, 50)) AS v FROM bars) WHERE v >= low AND v <= high"
    ),
)
def q13(spark, sf):
    lv = F.sequence(F.lit(40000), F.lit(59950), F.lit(50))
    return walk_bars(spark, sf).select(*ID, F.explode(prices.levels_between(lv, F.col("low"), F.col("high"))).alias("level")).withColumn("level", F.col("level").cast("long"))


@query(
    "p14_ratio_similarity",
    with_bars(_RATIO + f" SELECT {I}, round(least(ratio, 0.618::DOUBLE) / greatest(ratio, 0.618::DOUBLE), 8) AS similarity FROM rt WHERE ratio IS NOT NULL"),
)
def q14(spark, sf):
    return ratios(spark, sf).select(*ID, F.round(prices.ratio_similarity(F.col("ratio"), F.lit(0.618)), 8).alias("similarity"))


_DAYS = ", dy AS (SELECT symbol, tf, strftime(open_time, '%Y-%m-%d') AS day, bar_index, high - low AS v, close FROM bars)"


@query(
    "p15_entropy_unevenness",
    with_bars(
        _DAYS
        + """, t AS (SELECT *, sum(v) OVER (PARTITION BY symbol, day) AS s FROM dy)
        SELECT symbol, tf, day, CASE WHEN any_value(s) = 0 THEN 0 ELSE round(1 + sum(CASE WHEN v > 0 THEN v / s * log2(v / s) ELSE 0 END) / log2(count(*)), 6) END AS unevenness
        FROM t GROUP BY symbol, tf, day HAVING count(*) > 1"""
    ),
)
def q15(spark, sf):
    b = walk_bars(spark, sf).groupBy("symbol", "tf", F.date_format("open_time", "yyyy-MM-dd").alias("day"))
    # a day holds at most 24 hourly bars
    v = b.agg(F.collect_list(F.col("high") - F.col("low")).alias("v")).where(F.size("v") > 1)
    return v.select("symbol", "tf", "day", F.round(prices.entropy_unevenness(F.col("v")), 6).alias("unevenness"))


@query(
    "p16_polygon_area",
    with_bars(
        _DAYS
        + """, p AS (SELECT symbol, tf, day, bar_index AS x, close AS y, lead(bar_index) OVER k AS x2, lead(close) OVER k AS y2,
          first_value(bar_index) OVER k AS x1, first_value(close) OVER k AS y1, count(*) OVER (PARTITION BY symbol, day) AS n FROM dy WINDOW k AS (PARTITION BY symbol, day ORDER BY bar_index))
        SELECT symbol, tf, day, CASE WHEN any_value(n) < 3 THEN 0 ELSE round(abs(sum(x * coalesce(y2, y1) - coalesce(x2, x1) * y)) / 2, 4) END AS area FROM p GROUP BY symbol, tf, day"""
    ),
)
def q16(spark, sf):
    b = walk_bars(spark, sf).groupBy("symbol", "tf", F.date_format("open_time", "yyyy-MM-dd").alias("day"))
    p = b.agg(F.sort_array(F.collect_list(F.struct(F.col("bar_index").alias("x"), F.col("close").alias("y")))).alias("p"))
    return p.select("symbol", "tf", "day", F.round(prices.polygon_area(F.col("p")), 4).alias("area"))


@query(
    "p17_line_at",
    with_bars(
        f"SELECT {I}, round(close + (close - p) / 3 * 5, 6) AS y FROM (SELECT *, lag(close, 3) OVER (PARTITION BY symbol ORDER BY bar_index) AS p FROM bars) WHERE p IS NOT NULL"
    ),
)
def q17(spark, sf):
    b = framed(walk_bars(spark, sf), 3, 0, lambda w: {"p": F.lag("close", 3).over(w)}).where("p IS NOT NULL")
    i = F.col("bar_index")
    return b.select(*ID, F.round(prices.line_at(i - 3, F.col("p"), i, F.col("close"), i + 5), 6).alias("y"))


def weight_sql(name: str, ratio: str = "ratio") -> str:
    if name == "correction":
        return f"greatest({weight_sql('deep_correction', ratio)}, {weight_sql('shallow_correction', ratio)})"
    lv = fib.FIB_MAPS[name]
    top = max(w for w, _ in lv) / 100.0
    parts = ", ".join(f"CASE WHEN {ratio} >= {r} THEN {w / 100.0}::DOUBLE * exp(-5 * (({ratio} - {r}::DOUBLE) / {r}::DOUBLE)) ELSE 0 END" for w, r in lv)
    return f"greatest(0.001::DOUBLE, greatest({parts}) / {top}::DOUBLE)"


@query(
    "p18_fib_weight",
    with_bars(_RATIO + f" SELECT {I}, " + ", ".join(f"round({weight_sql(n)}, 7) AS {n}" for n in fib.FIB_MAPS) + " FROM rt WHERE ratio IS NOT NULL"),
)
def q18(spark, sf):
    return ratios(spark, sf).select(*ID, *[F.round(fib.fib_weight(n, F.col("ratio")), 7).alias(n) for n in fib.FIB_MAPS])


@query(
    "p19_fib_in_range",
    with_bars(
        _RATIO
        + f" SELECT {I}, "
        + ", ".join("ratio >= {}::DOUBLE AND ratio <= {}::DOUBLE AS {}".format(*map(repr, fib.fib_range(n)), n) for n in ("correction", *fib.FIB_MAPS))
        + " FROM rt WHERE ratio IS NOT NULL"
    ),
)
def q19(spark, sf):
    return ratios(spark, sf).select(*ID, *[fib.fib_in_range(n, F.col("ratio")).alias(n) for n in ("correction", *fib.FIB_MAPS)])


@query(
    "p20_normalize_ohlc",
    with_bars(
        f""", w AS (SELECT *, min(low) OVER (PARTITION BY symbol, date_trunc('day', open_time)) AS lo, max(high) OVER (PARTITION BY symbol, date_trunc('day', open_time)) AS hi FROM bars)
        SELECT {I}, round((open - lo) / (hi - lo), 8) AS o, round((high - lo) / (hi - lo), 8) AS h, round((low - lo) / (hi - lo), 8) AS l, round((close - lo) / (hi - lo), 8) AS c FROM w WHERE hi > lo"""
    ),
)
def q20(spark, sf):
    b = walk_bars(spark, sf).withColumn("_d", F.to_date("open_time"))
    box = b.groupBy("symbol", "tf", "_d").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    j = b.join(box, ["symbol", "tf", "_d"]).where("hi > lo")
    n = lambda c, a: F.round(prices.normalize(F.col(c), F.col("lo"), F.col("hi")), 8).alias(a)
    return j.select(*ID, n("open", "o"), n("high", "h"), n("low", "l"), n("close", "c"))
