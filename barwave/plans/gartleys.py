"""Gartley-family queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import gartley as gt
from barwave.operators import pivots as pv
from barwave.operators.harmonic import five_points
from barwave.plans.harmonics import sql as five_sql
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.plans.zigzags import fractal_sql
from barwave.session import cut
from barwave.sources import exports
from barwave.sources.ticks import bar_table

DEV = 0.5


@query(
    "h15_h17_price_bands",
    five_sql(
        ", mo AS (SELECT unnest(["
        + ", ".join(f"'{m}'" for m in gt.MODELS)
        + "]) AS model, unnest(["
        + ", ".join(f"{list(d[1])}" for d in gt.MODELS.values())
        + """]::DOUBLE[][]) AS xds), u AS (SELECT symbol, tf, seq, p5.x, p5.a, mo.model, unnest(xds) AS r FROM p5, mo WHERE d IS NOT NULL)
        SELECT symbol, tf, seq, model, r AS ratio, round(least(a - (a - x) * r * 0.95, a - (a - x) * r * 1.05), 7) AS low, round(greatest(a - (a - x) * r * 0.95, a - (a - x) * r * 1.05), 7) AS high FROM u"""
    ),
)
def q_bands(spark, sf):
    p = five_points(pv.zigzag_pct(bar_table(spark, sf), DEV))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(r)).alias("ratio")) for m, d in gt.MODELS.items() for r in d[1]])
    p = p.withColumn("_m", F.explode(rows)).select("*", "_m.model", "_m.ratio")
    band = gt.price_band(F.col("a"), F.abs(F.col("a") - F.col("x")), F.col("ratio"), F.when(F.col("is_bull"), -1.0).otherwise(1.0))
    return p.withColumn("_b", band).select("symbol", "tf", "seq", "model", "ratio", F.round("_b.low", 7).alias("low"), F.round("_b.high", 7).alias("high"))


@query(
    "h18_xd_bd_intersection",
    five_sql(
        ", mo AS (SELECT unnest(["
        + ", ".join(f"'{m}'" for m in gt.MODELS)
        + "]) AS model, unnest(["
        + ", ".join(str(d[1][0]) for d in gt.MODELS.values())
        + "]::DOUBLE[]) AS xd, unnest(["
        + ", ".join(str(d[2][0]) for d in gt.MODELS.values())
        + """]::DOUBLE[]) AS bd),
        u AS (SELECT symbol, tf, seq, mo.model, a > x AS up, a - (a - x) * xd * 0.95 AS x1, a - (a - x) * xd * 1.05 AS x2, c - (c - b) * bd * 0.95 AS b1, c - (c - b) * bd * 1.05 AS b2 FROM p5, mo WHERE d IS NOT NULL),
        v AS (SELECT symbol, tf, seq, model, up, greatest(least(x1, x2), least(b1, b2)) AS lo, least(greatest(x1, x2), greatest(b1, b2)) AS hi FROM u)
        SELECT symbol, tf, seq, model, round(lo, 7) AS low, round(hi, 7) AS high, round(CASE WHEN up THEN lo ELSE hi END, 7) AS cancel_price FROM v WHERE hi >= lo"""
    ),
)
def q_meet(spark, sf):
    p = five_points(pv.zigzag_pct(bar_table(spark, sf), DEV))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(d[1][0])).alias("rx"), F.lit(float(d[2][0])).alias("rb")) for m, d in gt.MODELS.items()])
    p = p.withColumn("_m", F.explode(rows)).select("*", "_m.model", "_m.rx", "_m.rb")
    down = F.when(F.col("is_bull"), -1.0).otherwise(1.0)
    xd = gt.price_band(F.col("a"), F.abs(F.col("a") - F.col("x")), F.col("rx"), down)
    bd = gt.price_band(F.col("c"), F.abs(F.col("c") - F.col("b")), F.col("rb"), down)
    p = p.withColumns({"_x": xd, "_d": bd}).withColumn("_o", gt.band_overlap(F.col("_x"), F.col("_d"))).where("_o IS NOT NULL")
    cancel = F.when(F.col("is_bull"), F.col("_o.low")).otherwise(F.col("_o.high"))
    return p.select("symbol", "tf", "seq", "model", F.round("_o.low", 7).alias("low"), F.round("_o.high", 7).alias("high"), F.round(cancel, 7).alias("cancel_price"))


# pivots, and every pair that stands in CTE ``xa``
XA_SQL = (
    fractal_sql(3)
    + """, sd AS (SELECT f.symbol, f.tf, f.bar_index AS x_bar, true AS is_bull, b.low AS x FROM fp f JOIN bars b USING (symbol, bar_index) WHERE f.is_low
      UNION ALL SELECT f.symbol, f.tf, f.bar_index, false, b.high FROM fp f JOIN bars b USING (symbol, bar_index) WHERE f.is_high),
    mx AS (SELECT symbol, max(bar_index) AS last FROM bars GROUP BY symbol),
    pr AS (SELECT s.*, f.bar_index AS a_bar, CASE WHEN is_bull THEN b.high ELSE b.low END AS a FROM sd s JOIN fp f ON f.symbol = s.symbol AND f.bar_index > s.x_bar AND f.bar_index + 3 - s.x_bar <= 300
      AND CASE WHEN s.is_bull THEN f.is_high ELSE f.is_low END JOIN bars b ON b.symbol = f.symbol AND b.bar_index = f.bar_index JOIN mx ON mx.symbol = s.symbol AND f.bar_index + 3 <= last), xa AS MATERIALIZED (SELECT symbol, tf, is_bull, x_bar, x, a_bar, a FROM pr p WHERE CASE WHEN is_bull THEN a > x ELSE a < x END
          AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = p.symbol AND b.bar_index > p.x_bar + 3 AND b.bar_index <= p.a_bar + 3 AND CASE WHEN is_bull THEN b.low < x ELSE b.high > x END)
          AND NOT EXISTS (SELECT 1 FROM fp f JOIN bars b USING (symbol, bar_index) WHERE f.symbol = p.symbol AND f.bar_index > p.x_bar AND f.bar_index < p.a_bar
            AND CASE WHEN p.is_bull THEN f.is_low AND b.low < x ELSE f.is_high AND b.high > x END)
          AND NOT EXISTS (SELECT 1 FROM pr o WHERE o.symbol = p.symbol AND o.is_bull = p.is_bull AND o.x_bar = p.x_bar AND o.a_bar < p.a_bar AND CASE WHEN p.is_bull THEN o.a > p.a ELSE o.a < p.a END))"""
)


@query("h16_gartley_xa_pairs", with_bars(XA_SQL + " SELECT * FROM xa", recursive=True))
def q_pairs(spark, sf):
    return gt.gartley_xa_pairs(gt.gartley_pivots(bar_table(spark, sf)))


def figures(spark, sf):
    piv = cut(gt.gartley_pivots(bar_table(spark, sf)))
    return piv, gt.gartley_projection(piv, gt.gartley_xa_pairs(piv))


def figures_sql() -> str:
    """CTE ``fg``: projections walked bar by bar, one row per pair, model and bar; prices mirrored so that A is above X."""
    models = ", ".join(f"('{m}', {list(xb)}::DOUBLE[], {xd[0]}::DOUBLE, {bd[0]}::DOUBLE, {list(ac)}::DOUBLE[], {basis == 'CD'})" for m, (xb, xd, bd, ac, basis) in gt.MODELS.items())
    first = lambda price, ratios, origin, leg: (
        f"list_filter({ratios}, lambda r: {price} BETWEEN least({origin} + {leg} * r * 0.95::DOUBLE, {origin} + {leg} * r * 1.05::DOUBLE) AND greatest({origin} + {leg} * r * 0.95::DOUBLE, {origin} + {leg} * r * 1.05::DOUBLE))[1]"
    )
    band = lambda origin, leg, r: (f"least({origin} + {leg} * {r} * 0.95::DOUBLE, {origin} + {leg} * {r} * 1.05::DOUBLE)", f"greatest({origin} + {leg} * {r} * 0.95::DOUBLE, {origin} + {leg} * {r} * 1.05::DOUBLE)")
    (xd_low, xd_high), (bd_low, bd_high) = band("a", "(x - a)", "xd"), band("up", "(-abs(b - up))", "bd")
    kept = "symbol, tf, model, s, x_bar, a_bar, x, a, xb, xd, bd, ac, from_x"
    return XA_SQL + f""", mo AS (SELECT * FROM (VALUES {models}) AS t(model, xb, xd, bd, ac, from_x)),
    wk AS (SELECT symbol, tf, model, CASE WHEN is_bull THEN 1.0 ELSE -1.0 END::DOUBLE AS s, x_bar, a_bar, CASE WHEN is_bull THEN x ELSE -x END AS x, CASE WHEN is_bull THEN a ELSE -a END AS a, xb, xd, bd, ac, from_x,
        a_bar + {gt.PERIOD - 1} AS i, 1e300::DOUBLE AS low, -1::BIGINT AS low_at, NULL::DOUBLE AS b, NULL::BIGINT AS b_at, NULL::DOUBLE AS rb, NULL::DOUBLE AS c, NULL::BIGINT AS c_at, NULL::DOUBLE AS rc,
        NULL::DOUBLE AS fl, NULL::DOUBLE AS ce, NULL::DOUBLE AS d, NULL::BIGINT AS d_at, false AS done FROM xa, mo
      UNION ALL SELECT {kept}, i, low, low_at, b, b_at, rb, c, c_at, rc, fl, ce, CASE WHEN hit THEN dn ELSE d END, CASE WHEN hit THEN i ELSE d_at END, hit AND cl <> dn
      FROM (SELECT *, coalesce(dn >= fl AND dn <= ce AND (d IS NULL OR d >= dn), false) AS hit
      FROM (SELECT * REPLACE (CASE WHEN takes THEN low ELSE b END AS b, CASE WHEN takes THEN low_at ELSE b_at END AS b_at, CASE WHEN takes THEN r1 ELSE rb END AS rb)
      FROM (SELECT *, c IS NULL AND r1 IS NOT NULL AND (b IS NULL OR b >= low) AS takes FROM (SELECT *, {first('low', 'xb', 'a', '(x - a)')} AS r1
      FROM (SELECT * REPLACE (CASE WHEN sets THEN up WHEN stale THEN NULL ELSE c END AS c, CASE WHEN sets THEN i WHEN stale THEN NULL ELSE c_at END AS c_at, CASE WHEN sets THEN r2 WHEN stale THEN NULL ELSE rc END AS rc,
          CASE WHEN stale THEN NULL ELSE b END AS b, CASE WHEN stale THEN NULL ELSE b_at END AS b_at, CASE WHEN stale THEN NULL ELSE rb END AS rb, CASE WHEN stale THEN NULL ELSE d END AS d,
          CASE WHEN sets AND zh >= zl THEN zl WHEN sets OR stale THEN NULL ELSE fl END AS fl, CASE WHEN sets AND zh >= zl THEN zh WHEN sets OR stale THEN NULL ELSE ce END AS ce)
      FROM (SELECT *, tries AND low < b AND low_at > b_at AS stale, tries AND NOT (low < b AND low_at > b_at) AS sets, greatest({bd_low}, {xd_low}) AS zl, least({bd_high}, {xd_high}) AS zh
      FROM (SELECT *, coalesce(b IS NOT NULL AND r2 IS NOT NULL AND (c IS NULL OR c <= up) AND i > b_at, false) AS tries
      FROM (SELECT *, CASE WHEN from_x THEN {first('up', 'ac', 'x', '(a - x)')} ELSE {first('up', 'ac', 'b', '(a - b)')} END AS r2
      FROM (SELECT * REPLACE (CASE WHEN up > c THEN NULL ELSE c END AS c, CASE WHEN up > c THEN NULL ELSE c_at END AS c_at, CASE WHEN up > c THEN NULL ELSE rc END AS rc, CASE WHEN up > c THEN NULL ELSE fl END AS fl, CASE WHEN up > c THEN NULL ELSE ce END AS ce)
      FROM (SELECT w.* REPLACE (q.bar_index AS i, CASE WHEN least(s * q.high, s * q.low) < w.low THEN least(s * q.high, s * q.low) ELSE w.low END AS low, CASE WHEN least(s * q.high, s * q.low) < w.low THEN q.bar_index ELSE low_at END AS low_at),
          greatest(s * q.high, s * q.low) AS up, least(s * q.high, s * q.low) AS dn, s * q.close AS cl, CASE WHEN s > 0 THEN q.high > a ELSE q.high < -a END AS quirk
        FROM wk w JOIN bars q ON q.symbol = w.symbol AND q.bar_index = w.i + 1 WHERE NOT w.done AND w.i + 1 <= w.x_bar + {gt.DEPTH})
      WHERE NOT (coalesce(dn < fl, false) OR (c IS NULL AND dn < x) OR (b IS NULL AND quirk)))))))))))),
    fg AS MATERIALIZED (SELECT symbol, tf, model, s > 0 AS is_bull, x_bar, s * x AS x, a_bar, s * a AS a, b_at AS b_bar, s * b AS b, c_at AS c_bar, s * c AS c, d_at AS d_bar, s * d AS d, (SELECT close FROM bars q WHERE q.symbol = wk.symbol AND q.bar_index = d_at) AS d_close,
        rb AS xb_want, rc AS ac_want, bd AS bd_want, xd AS xd_want, from_x FROM wk WHERE done)"""


def items_sql() -> str:
    """CTE ``it``: figures whose legs hold all bars between and whose B and C are pivots, with levels."""
    legs = " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM bars q WHERE q.symbol = f.symbol AND q.bar_index > {p}_bar AND q.bar_index < {n}_bar AND (q.high > greatest(f.{p}, f.{n}) OR q.low < least(f.{p}, f.{n})))"
        for p, n in zip("xabc", "abcd", strict=False)
    )
    pivot = lambda bar, kind: f"EXISTS (SELECT 1 FROM fp q WHERE q.symbol = f.symbol AND q.bar_index = {bar} AND q.{kind})"
    like = lambda want, got: f"least({want}, {got}) / greatest({want}, {got})"
    return figures_sql() + f""", cl AS (SELECT *, abs(b - a) / abs(a - x) AS xb, abs(a - d) / abs(a - x) AS xd, abs(c - d) / abs(c - b) AS bd, CASE WHEN from_x THEN abs(c - x) / abs(a - x) ELSE abs(c - b) / abs(b - a) END AS ac,
          CASE WHEN is_bull THEN 1 ELSE -1 END AS side FROM fg f WHERE {legs} AND CASE WHEN is_bull THEN {pivot('b_bar', 'is_low')} AND {pivot('c_bar', 'is_high')} ELSE {pivot('b_bar', 'is_high')} AND {pivot('c_bar', 'is_low')} END),
    lv AS (SELECT *, CAST(round_even((ACC) / 4 * 100, 0) AS INTEGER) AS accuracy, d_close - side * abs(d - d_close) * 1.272::DOUBLE AS sl, d_close + side * abs(d - d_close) * 1.272::DOUBLE AS tp1,
          d + side * (CASE WHEN from_x THEN abs(c - d) ELSE abs(a - d) END) * 0.618::DOUBLE AS tp2 FROM cl),
    it AS MATERIALIZED (SELECT * FROM lv WHERE CASE WHEN is_bull THEN d_close < tp1 ELSE d_close > tp1 END AND abs(d_close - sl) / abs(d_close - tp1) <= 4)""".replace(
        "ACC", " + ".join(like(f"{n}_want", n) for n in ("ac", "bd", "xb", "xd"))
    )


@query(
    "h19_gartley_projection",
    with_bars(figures_sql() + " SELECT symbol, tf, model, is_bull, x_bar, a_bar, b_bar, c_bar, d_bar, d, xb_want, ac_want, bd_want, xd_want FROM fg", recursive=True),
)
def q_projection(spark, sf):
    return figures(spark, sf)[1].select("symbol", "tf", "model", "is_bull", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar", "d", "xb_want", "ac_want", "bd_want", "xd_want")


@query(
    "h20_h21_gartley_items",
    with_bars(items_sql() + " SELECT symbol, tf, model, is_bull, x_bar, a_bar, b_bar, c_bar, d_bar, accuracy, round(sl, 4) AS sl, round(tp1, 4) AS tp1, round(tp2, 4) AS tp2 FROM it", recursive=True),
)
def q_items(spark, sf):
    piv, f = figures(spark, sf)
    i = gt.gartley_items(cut(f), piv)
    return i.select("symbol", "tf", "model", "is_bull", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar", "accuracy", F.round("sl", 4).alias("sl"), F.round("tp1", 4).alias("tp1"), F.round("tp2", 4).alias("tp2"))


@query(
    "h22_dedupe_items",
    with_bars(
        items_sql()
        + """, o1 AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY symbol, x_bar, a_bar, b_bar, c_bar ORDER BY d_bar, x_bar, a_bar, model) = 1),
        o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY symbol, d_bar, sl ORDER BY d_bar, x_bar, a_bar, model) = 1)
        SELECT symbol, tf, model, is_bull, x_bar, a_bar, b_bar, c_bar, d_bar, accuracy FROM o2""",
        recursive=True,
    ),
)
def q_dedupe(spark, sf):
    piv, f = figures(spark, sf)
    d = gt.dedupe_items(gt.gartley_items(cut(f), piv))
    return d.select("symbol", "tf", "model", "is_bull", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar", "accuracy")
