"""Indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import indicators as ind
from barwave.operators.series import framed
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.sources.ticks import walk_bars

ID = ("symbol", "tf", "bar_index")


def _w(p):
    return f"(PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def _sma(p, x="close"):
    return f"CASE WHEN bar_index >= {p} THEN sum({x}) OVER {_w(p)} / {p} END"


@query("w01_sma", with_bars(f"SELECT symbol, tf, bar_index, round({_sma(14)}, 6) AS sma FROM bars"))
def q_sma(spark, sf):
    return ind.sma(walk_bars(spark, sf), 14).select(*ID, F.round("sma", 6).alias("sma"))


@query(
    "w02_ema",
    with_bars(
        """, r AS (SELECT symbol, tf, bar_index, close AS ema FROM bars WHERE bar_index = 0
        UNION ALL SELECT b.symbol, b.tf, b.bar_index,
          CASE WHEN r.ema = 0 THEN b.close ELSE b.close * (2.0::DOUBLE/15) + r.ema * (1.0::DOUBLE - 2.0::DOUBLE/15) END
          FROM r JOIN bars b ON b.symbol = r.symbol AND b.bar_index = r.bar_index + 1)
        SELECT symbol, tf, bar_index, round(ema, 6) AS ema FROM r""",
        recursive=True,
    ),
)
def q_ema(spark, sf):
    return ind.ema(walk_bars(spark, sf), 14).select(*ID, F.round("ema", 6).alias("ema"))


_STD = """, s AS (SELECT *, {sma} AS m FROM bars),
    d AS (SELECT a.symbol, a.tf, a.bar_index, any_value(a.m) AS mid,
      sqrt(sum(pow((b.high + b.low) / 2 - coalesce(a.m, 0), 2)) / {p}) AS dev
      FROM s a LEFT JOIN bars b ON b.symbol = a.symbol AND b.bar_index BETWEEN greatest(a.bar_index - {p} + 1, 1) AND a.bar_index
      GROUP BY 1, 2, 3)"""


@query(
    "w03_stddev",
    with_bars(_STD.format(sma=_sma(14), p=14) + " SELECT symbol, tf, bar_index, round(coalesce(dev, 0), 5) AS stddev FROM d"),
)
def q_stddev(spark, sf):
    return ind.stddev(walk_bars(spark, sf), 14).select(*ID, F.round("stddev", 5).alias("stddev"))


@query(
    "w04_bollinger",
    with_bars(
        _STD.format(sma=_sma(20), p=20)
        + """ SELECT symbol, tf, bar_index, round(mid, 5) AS bb_mid, round(mid + 2 * dev, 5) AS bb_top,
          round(mid - 2 * dev, 5) AS bb_bottom FROM d"""
    ),
)
def q_bollinger(spark, sf):
    b = ind.bollinger(walk_bars(spark, sf), 20)
    return b.select(*ID, *[F.round(c, 5).alias(c) for c in ("bb_mid", "bb_top", "bb_bottom")])


_TR = """, t AS (SELECT *, greatest(high, lag(close) OVER k) - least(low, lag(close) OVER k) AS tr FROM bars
    WINDOW k AS (PARTITION BY symbol ORDER BY bar_index))"""


@query("w05_atr", with_bars(_TR + f" SELECT symbol, tf, bar_index, round({_sma(14, 'tr')}, 6) AS atr FROM t"))
def q_atr(spark, sf):
    return ind.atr(walk_bars(spark, sf), 14).select(*ID, F.round("atr", 6).alias("atr"))


@query(
    "w06_rsi",
    with_bars(
        """, c AS (SELECT symbol, tf, bar_index,
          (high + low) / 2 - lag((high + low) / 2) OVER (PARTITION BY symbol ORDER BY bar_index) AS d FROM bars),
        r AS (SELECT symbol, tf, bar_index, greatest(d, 0.0::DOUBLE) AS g, greatest(-d, 0.0::DOUBLE) AS l FROM c WHERE bar_index = 1
        UNION ALL SELECT c.symbol, c.tf, c.bar_index,
          greatest(d, 0.0::DOUBLE) * (2.0::DOUBLE/28) + r.g * (1.0::DOUBLE - 2.0::DOUBLE/28),
          greatest(-d, 0.0::DOUBLE) * (2.0::DOUBLE/28) + r.l * (1.0::DOUBLE - 2.0::DOUBLE/28)
          FROM r JOIN c ON c.symbol = r.symbol AND c.bar_index = r.bar_index + 1)
        SELECT symbol, tf, bar_index, CAST(CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50 ELSE 100 END
          ELSE round_even(100 - 100 / (1 + g / l), 0) END AS INTEGER) AS rsi FROM r""",
        recursive=True,
    ),
)
def q_rsi(spark, sf):
    return ind.rsi(walk_bars(spark, sf), 14).select(*ID, "rsi")


@query(
    "w07_awesome_oscillator",
    with_bars(f"SELECT symbol, tf, bar_index, round(coalesce({_sma(5)}, 0) - coalesce({_sma(34)}, 0), 6) AS ao FROM bars"),
)
def q_ao(spark, sf):
    return ind.awesome_oscillator(walk_bars(spark, sf)).select(*ID, F.round("ao", 6).alias("ao"))


_ALLIGATOR = f""", g AS (SELECT *, coalesce({_sma(13)}, 0) AS j, coalesce({_sma(8)}, 0) AS t, coalesce({_sma(5)}, 0) AS l FROM bars),
    al AS (SELECT *, CASE WHEN l > j AND l > t THEN 1 WHEN l < j AND l < t THEN -1 ELSE 0 END AS alligator FROM g)"""


@query("w08_zone_alligator", with_bars(_ALLIGATOR + " SELECT symbol, tf, bar_index, alligator FROM al"))
def q_alligator(spark, sf):
    return ind.zone_alligator(walk_bars(spark, sf)).select(*ID, "alligator")


_SUPERTREND = _TR + f""", a AS (SELECT *, coalesce({_sma(10, 'tr')}, 0) AS atr FROM t),
    q AS (SELECT symbol, tf, bar_index, close, (high + low) / 2 + 3.0::DOUBLE * atr AS u, (high + low) / 2 - 3.0::DOUBLE * atr AS w FROM a),
    r AS (SELECT symbol, tf, bar_index, u AS up, w AS down, 1 AS direction, 0 AS flat_bars FROM q WHERE bar_index = 0
    UNION ALL SELECT symbol, tf, bar_index, up, down, direction,
      CASE WHEN (direction = 1 AND down = pdown) OR (direction = -1 AND up = pup) THEN pflat + 1 ELSE 0 END FROM (
        SELECT symbol, tf, bar_index, pup, pdown, pflat, direction,
          CASE WHEN direction < 0 AND pdir < 0 THEN least(u, pup) ELSE u END AS up,
          CASE WHEN direction > 0 AND pdir > 0 THEN greatest(w, pdown) ELSE w END AS down FROM (
          SELECT q.symbol, q.tf, q.bar_index, q.u, q.w, r.up AS pup, r.down AS pdown, r.flat_bars AS pflat, r.direction AS pdir,
            CASE WHEN q.close > r.up THEN 1 WHEN q.close < r.down THEN -1 ELSE r.direction END AS direction
          FROM r JOIN q ON q.symbol = r.symbol AND q.bar_index = r.bar_index + 1)))"""


@query(
    "w09_supertrend",
    with_bars(
        _SUPERTREND + " SELECT symbol, tf, bar_index, round(up, 5) AS up, round(down, 5) AS down, direction, flat_bars FROM r",
        recursive=True,
    ),
)
def q_supertrend(spark, sf):
    s = ind.supertrend(walk_bars(spark, sf))
    return s.select(*ID, F.round("up", 5).alias("up"), F.round("down", 5).alias("down"), "direction", "flat_bars")


@query(
    "w10_price_speed",
    with_bars(
        """SELECT symbol, tf, bar_index, round(100.0::DOUBLE * (close - p) / p, 8) AS speed FROM (SELECT *,
          coalesce(lag(close, 30) OVER k, first_value(close) OVER k) AS p FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY bar_index))"""
    ),
)
def q_speed(spark, sf):
    return ind.price_speed(walk_bars(spark, sf), 30).select(*ID, F.round("speed", 8).alias("speed"))


_BPS = """, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    v AS (SELECT symbol, tf, any_value(n) AS n, list_sort(list((high - low) / close * 10000) FILTER (WHERE close > 0)) AS v
      FROM n WHERE bar_index >= n - 8000 GROUP BY symbol, tf),
    bp AS (SELECT symbol, tf, CASE WHEN n < 200 THEN 12.0 ELSE coalesce(v[len(v) // 2 + 1], 12.0) END::DOUBLE AS bps FROM v)"""


@query("w12_median_bar_bps", with_bars(_BPS + " SELECT symbol, tf, round(bps, 9) AS median_bps FROM bp"))
def q_bps(spark, sf):
    return ind.median_bar_bps(walk_bars(spark, sf)).withColumn("median_bps", F.round("median_bps", 9))


@query(
    "w13_auto_period",
    with_bars(
        _BPS
        + """ SELECT symbol, tf, CAST(least(greatest(round_even(3.3::DOUBLE * bps, 0), 8), 120) AS INTEGER) AS impulse_period,
          CAST(least(greatest(round_even(0.7::DOUBLE * bps, 0), 5), 20) AS INTEGER) AS triangle_period FROM bp"""
    ),
)
def q_auto_period(spark, sf):
    b = ind.median_bar_bps(walk_bars(spark, sf))
    bps = F.col("median_bps")
    return b.select(
        "symbol", "tf", ind.auto_period(bps, "impulse").alias("impulse_period"), ind.auto_period(bps, "triangle").alias("triangle_period")
    )


LADDER = (0.5, 0.7, 1.0, 1.4, 2.0)


@query(
    "w14_period_ladder",
    with_bars(
        _BPS
        + """, p AS (SELECT symbol, tf, least(greatest(round_even(0.7::DOUBLE * bps, 0), 5), 20) AS p FROM bp)
        SELECT DISTINCT symbol, tf, CAST(greatest(round_even(p * r, 0), 1) AS INTEGER) AS period
        FROM p, (SELECT unnest([0.5, 0.7, 1.0, 1.4, 2.0]::DOUBLE[]) AS r)"""
    ),
)
def q_ladder(spark, sf):
    b = ind.median_bar_bps(walk_bars(spark, sf))
    base = ind.auto_period(F.col("median_bps"), "triangle")
    return b.select("symbol", "tf", F.explode(ind.period_ladder(base, LADDER)).alias("period"))


@query(
    "w15_trend_state",
    with_bars(
        _SUPERTREND
        + _ALLIGATOR
        + """ SELECT al.symbol, al.tf, al.bar_index,
          CASE WHEN alligator > 0 THEN 'BULLISH' WHEN alligator < 0 THEN 'BEARISH' ELSE 'NO_TREND' END AS alligator_trend,
          CASE WHEN direction > 0 THEN 'BULLISH' WHEN direction < 0 THEN 'BEARISH' ELSE 'NO_TREND' END AS supertrend_trend,
          flat_bars FROM al JOIN r USING (symbol, bar_index)""",
        recursive=True,
    ),
)
def q_trend_state(spark, sf):
    bars = walk_bars(spark, sf)
    a = ind.zone_alligator(bars).select(*ID, ind.trend_name(F.col("alligator")).alias("alligator_trend"))
    s = ind.supertrend(bars).select(*ID, ind.trend_name(F.col("direction")).alias("supertrend_trend"), "flat_bars")
    return a.join(s, list(ID))


@query(
    "w17_spike",
    with_bars(
        _STD.format(sma=_sma(20), p=20)
        + """ SELECT d.symbol, d.tf, d.bar_index, CASE WHEN high >= coalesce(mid + 2 * dev, 0) THEN 'High'
          WHEN high <= coalesce(mid - 2 * dev, 0) THEN 'Low' ELSE 'NoSpike' END AS high_spike,
          CASE WHEN low >= coalesce(mid + 2 * dev, 0) THEN 'High'
          WHEN low <= coalesce(mid - 2 * dev, 0) THEN 'Low' ELSE 'NoSpike' END AS low_spike
          FROM d JOIN bars USING (symbol, bar_index)"""
    ),
)
def q_spike(spark, sf):
    b = ind.bollinger(walk_bars(spark, sf), 20)
    return b.select(*ID, ind.spike_of(F.col("high")).alias("high_spike"), ind.spike_of(F.col("low")).alias("low_spike"))


@query(
    "w21_analysis_window",
    with_bars(
        """, e AS (SELECT *, max(bar_index) OVER (PARTITION BY symbol) AS end_bar FROM bars),
        x AS (SELECT symbol, tf, end_bar, arg_max(bar_index, (high, -bar_index)) AS high_bar,
          arg_max(bar_index, (-low, -bar_index)) AS low_bar, max(high) AS high, min(low) AS low
          FROM e WHERE bar_index > end_bar - 200 GROUP BY ALL)
        SELECT *, least(high_bar, low_bar) AS start_bar, low_bar < high_bar AS is_up FROM x"""
    ),
)
def q_window(spark, sf):
    return ind.analysis_window(walk_bars(spark, sf))
