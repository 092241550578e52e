"""Leg statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import indicators as ind
from barwave.operators import movement as mv
from barwave.operators import pivots as pv
from barwave.operators.series import framed
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.plans.windows import _sma
from barwave.plans.zigzags import legs_sql, zigzag_sql
from barwave.session import cut
from barwave.sources.ticks import bar_table

DEV = 0.5
BASE = zigzag_sql() + legs_sql() + """, lb AS MATERIALIZED (SELECT l.symbol, l.tf, l.seq, l.start_bar, l.start_value, l.end_bar, l.end_value, l.is_up, l.length,
      b.bar_index, b.open, b.high, b.low, b.close, b.bar_index - l.start_bar AS pos, l.end_bar - l.start_bar AS n,
      CASE WHEN is_up THEN high ELSE -low END AS m, CASE WHEN is_up THEN low ELSE -high END AS c
      FROM legs l JOIN bars b ON b.symbol = l.symbol AND b.bar_index BETWEEN l.start_bar AND l.end_bar)"""


def sql(body: str) -> str:
    return with_bars(BASE + body, recursive=True)


def base(spark, sf):
    bars = bar_table(spark, sf)
    legs = cut(pv.segments(pv.zigzag_pct(bars, DEV)))
    return bars, legs


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("m01_size", sql(" SELECT symbol, tf, seq, round(length / abs(least(start_value, end_value)), 9) AS size FROM legs"))
def q_size(spark, sf):
    return mv.size(base(spark, sf)[1]).withColumn("size", F.round("size", 9))


@query(
    "m02_heterogeneity",
    sql(
        """, d AS (SELECT *, greatest(abs(greatest(low, least(start_value, end_value)) - ln), abs(least(high, greatest(start_value, end_value)) - ln)) AS d
          FROM (SELECT *, start_value + CASE WHEN is_up THEN 1 ELSE -1 END * pos * (length / n) AS ln FROM lb WHERE pos > 0)),
        s AS (SELECT *, sum(d) OVER (PARTITION BY symbol, seq) AS t FROM d)
        SELECT symbol, tf, seq, CASE WHEN any_value(n) < 3 THEN 1.0::DOUBLE WHEN any_value(t) = 0 THEN 0.0::DOUBLE ELSE
          round(1 + sum(CASE WHEN d > 0 THEN d / t * log2(d / t) ELSE 0 END) / log2(count(*)), 6) END AS unevenness,
          CASE WHEN any_value(n) < 3 THEN 1.0::DOUBLE ELSE round(max(d), 6) END AS max_distance FROM s GROUP BY ALL"""
    ),
)
def q_het(spark, sf):
    bars, legs = base(spark, sf)
    return r6(mv.heterogeneity(mv.leg_bars(legs, bars)), "unevenness", "max_distance")


@query(
    "m03_envelope_area",
    sql(
        # heights of the hull at each bar: the best chord over all point pairs around it
        """, p AS (SELECT symbol, tf, seq, length, n, pos, least(greatest(high, least(start_value, end_value)), greatest(start_value, end_value)) AS h,
            least(greatest(low, least(start_value, end_value)), greatest(start_value, end_value)) AS l FROM lb),
        e AS (SELECT x.symbol, x.tf, x.seq, x.pos, any_value(x.length) AS length, any_value(x.n) AS n,
            max(CASE WHEN b.pos = a.pos THEN a.h ELSE a.h + (b.h - a.h) * (x.pos - a.pos) / (b.pos - a.pos) END) AS u,
            min(CASE WHEN b.pos = a.pos THEN a.l ELSE a.l + (b.l - a.l) * (x.pos - a.pos) / (b.pos - a.pos) END) AS w
            FROM p x JOIN p a ON a.symbol = x.symbol AND a.seq = x.seq AND a.pos <= x.pos
            JOIN p b ON b.symbol = x.symbol AND b.seq = x.seq AND b.pos >= x.pos WHERE x.pos > 0 GROUP BY 1, 2, 3, 4)
        SELECT symbol, tf, seq, round(least(sum(u - w) / any_value(length * n), 1), 6) AS envelope_area FROM e GROUP BY ALL"""
    ),
)
def q_area(spark, sf):
    bars, legs = base(spark, sf)
    return r6(mv.envelope_area(mv.leg_bars(legs, bars)), "envelope_area")


@query(
    "m04_pullback_score",
    sql(
        """, r AS (SELECT *, greatest(max(m) FILTER (pos > 0) OVER (PARTITION BY symbol, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            CASE WHEN is_up THEN start_value ELSE -start_value END) AS run FROM lb)
        SELECT symbol, tf, seq, round(least(sum(greatest(run - c, 0)) FILTER (pos > 0) / any_value(length * n), 1), 6) AS pullback FROM r GROUP BY 1, 2, 3"""
    ),
)
def q_pullback(spark, sf):
    bars, legs = base(spark, sf)
    return r6(mv.pullback_score(mv.leg_bars(legs, bars)), "pullback")


# the literal definition: every pair of a bar and a later bar before price turns past the first
RETREAT_SQL = """, el AS (SELECT *, NOT ((pos = 0 OR bar_index = end_bar) AND ((open < close) <> is_up)) AS ok FROM lb),
    tn AS (SELECT a.symbol, a.tf, a.seq, a.bar_index AS i, any_value(a.m) AS top, any_value(a.start_bar) AS s, any_value(a.end_bar) AS e,
      min(k.bar_index) FILTER (k.c > a.m) AS turn FROM el a JOIN lb k ON k.symbol = a.symbol AND k.seq = a.seq AND k.bar_index > a.bar_index AND k.bar_index < a.end_bar
      WHERE a.ok GROUP BY 1, 2, 3, 4),
    dp AS (SELECT t.symbol, t.tf, t.seq, i, any_value(top) AS top, any_value(s) AS s, any_value(e) AS e, min(k.c) AS deep, arg_min(k.bar_index, (k.c, k.bar_index)) AS at_bar
      FROM tn t JOIN lb k ON k.symbol = t.symbol AND k.seq = t.seq AND k.bar_index > i AND k.bar_index < coalesce(turn, e) GROUP BY 1, 2, 3, 4)"""


@query(
    "m05_max_overlap",
    sql(
        RETREAT_SQL
        + """, b AS (SELECT symbol, seq, max((round(top - deep, 9), -i, -at_bar)) AS b FROM dp GROUP BY ALL)
        SELECT l.symbol, l.tf, l.seq, round(coalesce(b[1] / length, 0), 6) AS overlap_depth,
          round(coalesce((-b[3] + b[2]) / (end_bar - start_bar), 0), 6) AS overlap_distance FROM legs l LEFT JOIN b USING (symbol, seq)"""
    ).replace("max((round(top - deep, 9), -i, -at_bar)) AS b", "max([round(top - deep, 9), -i::DOUBLE, -at_bar::DOUBLE]) AS b"),
)
def q_overlap(spark, sf):
    bars, legs = base(spark, sf)
    return r6(mv.max_overlap(mv.leg_bars(legs, bars)), "overlap_depth", "overlap_distance")


RZ_SQL = RETREAT_SQL + """, bk AS (SELECT d.symbol, d.seq, i, any_value(i - s + 1) AS whole, max(k.bar_index) FILTER (k.c <= deep) AS met
      FROM dp d JOIN lb k ON k.symbol = d.symbol AND k.seq = d.seq AND k.bar_index <= i GROUP BY 1, 2, 3),
    rz AS (SELECT l.symbol, l.tf, l.seq, coalesce(max(coalesce(i - met, whole)) / any_value(end_bar - start_bar), 0) AS ratio_zigzag
      FROM legs l LEFT JOIN bk USING (symbol, seq) GROUP BY 1, 2, 3)"""


@query("m06_ratio_zigzag", sql(RZ_SQL + " SELECT symbol, tf, seq, round(ratio_zigzag, 6) AS ratio_zigzag FROM rz"))
def q_rz(spark, sf):
    bars, legs = base(spark, sf)
    return r6(mv.ratio_zigzag(legs, bars), "ratio_zigzag")


PROFILE_SQL = """, lv AS (SELECT DISTINCT symbol, tf, seq, unnest([low, high]) AS p FROM lb),
    iv AS (SELECT *, lead(p) OVER (PARTITION BY symbol, seq ORDER BY p) AS q FROM lv),
    pf AS MATERIALIZED (SELECT i.symbol, i.tf, i.seq, i.p AS level_low, i.q AS level_high, count(*) FILTER (b.low <= p AND b.high >= q) AS cover, count(*) AS n, max(b.high) - min(b.low) AS rng
      FROM iv i JOIN lb b ON b.symbol = i.symbol AND b.seq = i.seq WHERE q IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
    ps AS MATERIALIZED (SELECT symbol, tf, seq, CASE WHEN any_value(n) > 1 THEN least(coalesce(sum((level_high - level_low) / rng * cover / (n - 1)) FILTER (cover > 1), 0), 1) ELSE 1 END AS overlap_index,
      coalesce(sum((level_high - level_low) / rng) FILTER (cover <= 1), 0) AS single_share, bool_or(cover = 0) AND any_value(n) > 1 AS has_gap,
      CASE WHEN any_value(n) > 1 THEN least(coalesce(sum((level_high - level_low) / rng * (cover - 1) / (n - 1)) FILTER (cover > 1), 0), 1) ELSE 0 END AS overlap_degree,
      CASE WHEN any_value(n) > 1 THEN 1 - avg(greatest(cover, 1)) / max(greatest(cover, 1)) ELSE 0 END AS uniformity FROM pf GROUP BY 1, 2, 3)"""


@query("m07_overlap_profile", sql(PROFILE_SQL + " SELECT symbol, tf, seq, level_low, level_high, cover FROM pf"))
def q_profile(spark, sf):
    bars, legs = base(spark, sf)
    return mv.price_profile(mv.leg_bars(legs, bars)).drop("range")


for _k, _cols in (
    ("m07_overlap_index", ("overlap_index", "single_share")),
    ("m08_overlap_degree", ("overlap_degree",)),
    ("m10_has_unclosed_gap", ("has_gap",)),
    ("m11_uniformity", ("uniformity",)),
):
    _e = ", ".join(c if c == "has_gap" else f"round({c}, 6) AS {c}" for c in _cols)

    @query(_k, sql(PROFILE_SQL + f" SELECT symbol, tf, seq, {_e} FROM ps"))
    def _q(spark, sf, cols=_cols):
        bars, legs = base(spark, sf)
        out = mv.overlap_stats(mv.leg_bars(legs, bars)).select(*mv.LEG, *cols)
        return r6(out, *[c for c in cols if c != "has_gap"])


LINE_SQL = """, dv AS (SELECT symbol, tf, seq, any_value(length) AS length, max(d) AS mx, avg(d) AS av FROM (SELECT *,
      CASE WHEN pos > 0 AND bar_index < end_bar THEN greatest(abs(high - (start_value + (end_value - start_value) * (pos::DOUBLE / n))),
      abs(low - (start_value + (end_value - start_value) * (pos::DOUBLE / n)))) END AS d FROM lb) GROUP BY 1, 2, 3)"""


@query(
    "m09_deviation_from_line",
    sql(
        LINE_SQL
        + """, nr AS (SELECT a.symbol, a.seq, a.bar_index, min(abs(CASE WHEN b.is_up THEN b.high ELSE b.low END - CASE WHEN a.is_up THEN a.low ELSE a.high END)) AS d
            FROM lb a JOIN lb b ON b.symbol = a.symbol AND b.seq = a.seq WHERE a.pos > 0 AND a.bar_index < a.end_bar GROUP BY 1, 2, 3),
        ng AS (SELECT symbol, seq, max(d) AS nx, avg(d) AS na FROM nr GROUP BY ALL)
        SELECT dv.symbol, dv.tf, dv.seq, round(least(coalesce(mx, 0) / length, 1), 6) AS max_deviation, round(least(coalesce(av, 0) / length, 1), 6) AS avg_deviation,
          round(least(coalesce(nx, 0) / length, 1), 6) AS max_deviation_near, round(least(coalesce(na, 0) / length, 1), 6) AS avg_deviation_near
          FROM dv LEFT JOIN ng USING (symbol, seq)"""
    ),
)
def q_dev(spark, sf):
    bars, legs = base(spark, sf)
    lb = mv.leg_bars(legs, bars)
    out = mv.deviation_from_line(lb).join(mv.deviation_from_nearest(lb), mv.LEG)
    return r6(out, "max_deviation", "avg_deviation", "max_deviation_near", "avg_deviation_near")


@query("m12_profile_by_zigzag")
def q_profile_zz(spark, sf):
    bars, legs = base(spark, sf)
    return r6(mv.profile_by_zigzag(legs, bars), "overlap_index", "single_share")


@query(
    "m13_movement_statistic",
    sql(
        RZ_SQL
        + PROFILE_SQL
        + LINE_SQL
        + """, b AS (SELECT symbol, seq, max(round(top - deep, 9)) AS b FROM dp GROUP BY ALL)
        SELECT l.symbol, l.tf, l.seq, round(l.length / abs(least(start_value, end_value)), 6) AS size, round(coalesce(b / l.length, 0), 6) AS overlap_depth,
          round(ratio_zigzag, 6) AS ratio_zigzag, round(uniformity, 6) AS heterogeneity, round(overlap_degree, 6) AS overlap_degree,
          round(least(coalesce(mx, 0) / l.length, 1), 6) AS max_deviation, end_bar - start_bar AS bar_count
          FROM legs l LEFT JOIN b USING (symbol, seq) JOIN rz USING (symbol, seq) JOIN ps USING (symbol, seq) JOIN dv USING (symbol, seq)"""
    ),
)
def q_bundle(spark, sf):
    bars, legs = base(spark, sf)
    out = mv.movement_statistic(legs, bars).drop("envelope_area")
    return r6(out, "size", "overlap_depth", "ratio_zigzag", "heterogeneity", "overlap_degree", "max_deviation")


@query(
    "m14_smooth_impulse",
    sql(
        PROFILE_SQL
        + """, t AS (SELECT *, CASE WHEN is_up THEN start_value ELSE -start_value END AS sm, CASE WHEN is_up THEN end_value ELSE -end_value END AS em,
            CASE WHEN pos = 0 THEN start_value WHEN bar_index = end_bar THEN end_value ELSE close END AS px FROM lb),
        u AS (SELECT *, greatest(max(m) OVER k, sm) - c AS drop_, abs(px - lag(px) OVER k) AS st FROM t WINDOW k AS (PARTITION BY symbol, seq ORDER BY pos)),
        g AS (SELECT symbol, tf, seq, any_value(n) AS n, any_value(length) AS length, any_value(is_up) AS is_up, any_value(start_value) AS s, any_value(end_value) AS e,
          bool_or(c < sm - 0.001 * length OR m > em + 0.001 * length) AS beyond, greatest(max(drop_), 0) / any_value(length) AS correction, sum(st) / any_value(length) AS path_ratio,
          max(close) FILTER (pos = n // 3) AS c1, max(close) FILTER (pos = 2 * n // 3) AS c2 FROM u GROUP BY 1, 2, 3),
        h AS (SELECT g.*, has_gap, CASE WHEN is_up THEN 1 ELSE -1 END * (c1 - s) / length AS a, CASE WHEN is_up THEN 1 ELSE -1 END * (c2 - c1) / length AS b,
          CASE WHEN is_up THEN 1 ELSE -1 END * (e - c2) / length AS z FROM g JOIN ps USING (symbol, seq))
        SELECT symbol, tf, seq, round(correction, 6) AS correction, round(path_ratio, 6) AS path_ratio, round(a, 6) AS first_third, round(b, 6) AS second_third, round(z, 6) AS last_third,
          n >= 3 AND NOT has_gap AND NOT beyond AND correction <= 0.35 AND path_ratio <= 2 AND ((a BETWEEN 0.15 AND 0.55 AND b BETWEEN 0.15 AND 0.55 AND z BETWEEN 0.15 AND 0.55)
          OR (b >= 0.45 AND least(a, z) >= 0 AND CASE WHEN least(a, z) <= 0 THEN greatest(a, z) < 0.1 ELSE greatest(a, z) / least(a, z) <= 3 END)) AS is_smooth FROM h"""
    ),
)
def q_smooth(spark, sf):
    bars, legs = base(spark, sf)
    lb = mv.leg_bars(legs, bars)
    return r6(mv.smooth_impulse(lb, mv.overlap_stats(lb)), "correction", "path_ratio", "first_third", "second_third", "last_third")


@query("m15_pine_impulse_filter")
def q_pine(spark, sf):
    bars, legs = base(spark, sf)
    return mv.pine_impulse_filter(legs, bars)


@query(
    "m15_pine_depth_heterogeneity",
    sql(
        """, dd AS (SELECT a.symbol, a.tf, a.seq, greatest(coalesce(max(a.m - k.c), 0), 0) / any_value(a.length) AS depth_pine
            FROM lb a LEFT JOIN lb k ON k.symbol = a.symbol AND k.seq = a.seq AND k.bar_index > a.bar_index GROUP BY 1, 2, 3),
        bx AS (SELECT symbol, seq, least(min(low), min(least(start_value, end_value))) AS lo, greatest(max(high), max(greatest(start_value, end_value))) AS hi FROM lb GROUP BY ALL),
        bn AS (SELECT symbol, seq, least(greatest(floor((low - lo) / ((hi - lo) / 10)), 0), 9) AS a, least(greatest(floor((high - lo) / ((hi - lo) / 10)), 0), 9) AS b FROM lb JOIN bx USING (symbol, seq)),
        bb AS (SELECT symbol, seq, x FROM bn, (SELECT unnest(range(10)) AS x) WHERE x BETWEEN a AND b),
        hh AS (SELECT symbol, seq, abs(count(*) FILTER (x <= 2) - count(*) FILTER (x >= 7)) / count(*) AS heterogeneity_pine FROM bb GROUP BY ALL)
        SELECT dd.symbol, dd.tf, dd.seq, round(depth_pine, 6) AS depth_pine, round(heterogeneity_pine, 6) AS heterogeneity_pine FROM dd JOIN hh USING (symbol, seq)"""
    ),
)
def q_pine2(spark, sf):
    bars, legs = base(spark, sf)
    lb = mv.leg_bars(legs, bars)
    return r6(mv.pine_depth(lb).join(mv.pine_heterogeneity(lb), mv.LEG), "depth_pine", "heterogeneity_pine")


@query(
    "m16_leg_labels",
    sql(
        RZ_SQL
        + PROFILE_SQL
        + """, b AS (SELECT symbol, seq, max(round(top - deep, 9)) AS b FROM dp GROUP BY ALL)
        SELECT l.symbol, l.tf, l.seq, CAST(round_even(ratio_zigzag * 100, 0) AS INTEGER) AS rz, CAST(round_even(coalesce(b / l.length, 0) * 100, 0) AS INTEGER) AS depth,
          CAST(round_even(uniformity * 100, 0) AS INTEGER) AS uniformity FROM legs l LEFT JOIN b USING (symbol, seq) JOIN rz USING (symbol, seq) JOIN ps USING (symbol, seq)"""
    ),
)
def q_labels(spark, sf):
    bars, legs = base(spark, sf)
    return mv.leg_labels(legs, bars)


@query(
    "z13_extremum_between",
    sql(
        """ SELECT symbol, tf, seq, arg_max(bar_index, (high, bar_index)) AS extremum_bar, max(high) AS extremum_value
        FROM lb WHERE pos > 0 AND bar_index < end_bar GROUP BY 1, 2, 3"""
    ),
)
def q_between(spark, sf):
    bars, legs = base(spark, sf)
    return mv.extremum_between(legs, bars, True)


@query(
    "z18_is_initial_movement",
    sql(
        """, h AS (SELECT l.symbol, l.tf, l.seq, any_value(l.start_bar) AS s, max(b.bar_index) FILTER (CASE WHEN is_up THEN low <= start_value ELSE high >= start_value END) AS k,
            max(b.bar_index) FILTER (CASE WHEN is_up THEN high > end_value ELSE low < end_value END) AS y
            FROM legs l LEFT JOIN bars b ON b.symbol = l.symbol AND b.bar_index < l.start_bar GROUP BY 1, 2, 3)
        SELECT symbol, tf, seq, coalesce(y, -1) > coalesce(k, -1) AS is_initial, CASE WHEN s > 0 THEN greatest(coalesce(y, 0), coalesce(k, 0)) ELSE -1 END AS edge_bar FROM h"""
    ),
)
def q_initial(spark, sf):
    bars, legs = base(spark, sf)
    return mv.is_initial_movement(legs, bars).withColumn("edge_bar", F.coalesce("edge_bar", F.lit(-1)).cast("long"))


@query(
    "w18_find_divergence",
    sql(
        f""", ao0 AS (SELECT symbol, bar_index, round(coalesce({_sma(5)}, 0) - coalesce({_sma(34)}, 0), 6) AS ao FROM bars),
        ao AS (SELECT *, lag(ao) OVER (PARTITION BY symbol ORDER BY bar_index) AS ap FROM ao0),
        j AS (SELECT l.symbol, l.tf, l.seq, b.bar_index AS i, CASE WHEN is_up THEN -1 ELSE 1 END AS g, l.start_bar, a.ao, a.ap, e.ao AS eao,
          CASE WHEN is_up THEN -b.high ELSE b.low END AS p, CASE WHEN is_up THEN -eb.high ELSE eb.low END AS ep, CASE WHEN is_up THEN -end_value ELSE end_value END AS ev
          FROM legs l JOIN bars b ON b.symbol = l.symbol AND b.bar_index >= l.start_bar AND b.bar_index < l.end_bar JOIN ao a ON a.symbol = b.symbol AND a.bar_index = b.bar_index
          JOIN ao e ON e.symbol = l.symbol AND e.bar_index = l.end_bar JOIN bars eb ON eb.symbol = l.symbol AND eb.bar_index = l.end_bar),
        k AS (SELECT *, (ao * g > 0 OR p < ev OR p < ep) AS broke, (NOT ao * g > eao * g) AND i - 1 > start_bar AND ap * g > ao * g AS fnd FROM j WHERE eao * g <= 0),
        q AS (SELECT symbol, tf, seq, max(i) FILTER (broke) AS st, max(i) FILTER (fnd AND NOT broke) AS hit FROM k GROUP BY 1, 2, 3)
        SELECT symbol, tf, seq, hit AS divergence_bar FROM q WHERE hit > coalesce(st, -1)"""
    ),
)
def q_divergence(spark, sf):
    bars, legs = base(spark, sf)
    ao = ind.awesome_oscillator(bars).withColumn("ao", F.round("ao", 6))
    ao = framed(ao, 1, 0, lambda w: {"ao_prev": F.lag("ao").over(w)})
    return mv.find_divergence(legs, ao)


@query("z15_sub_extremum_ranks")
def q_ranks(spark, sf):
    bars, legs = base(spark, sf)
    return mv.sub_extremum_ranks(legs, bars)


@query("z16_segment_count_class")
def q_class(spark, sf):
    bars, legs = base(spark, sf)
    return mv.segment_count_class(legs, bars)


@query("z17_seniority_ranks")
def q_seniority(spark, sf):
    bars, legs = base(spark, sf)
    return mv.sub_extremum_ranks(legs.where(~F.col("open_end")), bars)


@query(
    "z11_normalize_extrema",
    with_bars(
        zigzag_sql("za", "2.0::DOUBLE")
        + legs_sql("la", "za")
        + zigzag_sql("zb", "0.5::DOUBLE")
        + """, pt AS (SELECT symbol, tf, seq, start_value > end_value AS falls, start_bar AS bar_index, start_value AS value FROM la
            UNION ALL SELECT symbol, tf, seq, start_value > end_value, end_bar, end_value FROM la
            UNION ALL SELECT l.symbol, l.tf, l.seq, l.start_value > l.end_value, z.bar_index, z.value FROM la l JOIN zb z ON z.symbol = l.symbol AND z.bar_index > l.start_bar AND z.bar_index < l.end_bar),
        w AS (SELECT *, lag(value) OVER k AS pv, lead(value) OVER k AS nv, count(*) OVER (PARTITION BY symbol, seq) AS c FROM pt WINDOW k AS (PARTITION BY symbol, seq ORDER BY bar_index))
        SELECT symbol, tf, seq, bar_index, value FROM w WHERE NOT (c >= 4 AND nv IS NOT NULL AND coalesce(pv < value, falls) = (value < nv))""",
        recursive=True,
    ),
)
def q_normalize(spark, sf):
    bars = bar_table(spark, sf)
    return mv.normalize_extrema(pv.segments(pv.zigzag_pct(bars, 2.0)), pv.zigzag_pct(bars, 0.5))
