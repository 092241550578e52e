"""Harmonic figure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.functions.prices import risk_reward
from barwave.operators import harmonic as hm
from barwave.operators import pivots as pv
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.plans.zigzags import zigzag_sql
from barwave.session import cut
from barwave.sources.ticks import bar_table, walk_bars

DEV = 0.5
ID = ("symbol", "tf", "seq", "model")

_PTS = ", ".join(f"lead(value, {i}) OVER k AS {n}, lead(bar_index, {i}) OVER k AS {n}_bar" for i, n in enumerate("xabcd"))
_DEF_ROWS = ", ".join(
    f"('{m}', {list(d[0])}::DOUBLE[], {list(d[1])}::DOUBLE[], {list(d[2])}::DOUBLE[], {list(d[3])}::DOUBLE[])" for m, d in hm.DEFINITIONS.items()
)
_W = lambda r, l: f"len(list_filter({l}, lambda e: {r} <= e * 1.2 AND {r} >= e * 0.8)) > 0"
_E = lambda r, l: f"list_min(list_transform({l}, lambda e: abs(1 - {r} / e)))"
FIVE_SQL = zigzag_sql() + f""", p5 AS (SELECT symbol, tf, row_number() OVER k - 1 AS seq, {_PTS} FROM zz WINDOW k AS (PARTITION BY symbol ORDER BY bar_index, is_high DESC)),
    df AS (SELECT * FROM (VALUES {_DEF_ROWS}) t(model, l_ab, l_bc, l_cd, l_fin)),
    r5 AS (SELECT *, abs(a - b) / abs(a - x) AS ab_ratio, abs(c - b) / abs(a - b) AS bc_ratio, abs(c - d) / abs(c - b) AS cd_ratio,
      CASE WHEN model = 'CYPHER' THEN abs(c - d) / abs(c - x) ELSE abs(a - d) / abs(a - x) END AS final_ratio FROM p5, df WHERE d IS NOT NULL),
    m5 AS MATERIALIZED (SELECT * FROM r5 WHERE (CASE WHEN model = 'SHARK' THEN ab_ratio < 1 ELSE {_W('ab_ratio', 'l_ab')} END) AND {_W('bc_ratio', 'l_bc')}
      AND (model = 'CYPHER' OR {_W('cd_ratio', 'l_cd')}) AND {_W('final_ratio', 'l_fin')}),
    lv5 AS (SELECT *, list_sort(CASE WHEN model = 'CYPHER' THEN list_transform(l_fin, lambda e: c - e * (c - x))
      ELSE list_concat(list_transform(l_cd, lambda e: c - e * (c - b)), list_transform(l_fin, lambda e: a - e * (a - x))) END) AS lv FROM m5),
    g5 AS (SELECT *, CASE WHEN len(lv) = 1 THEN [0, lv[1], lv[1]] ELSE list_min(list_transform(range(1, len(lv)), lambda i: [lv[i + 1] - lv[i], lv[i], lv[i + 1]])) END AS nr FROM lv5),
    z5 AS MATERIALIZED (SELECT *, lv[1] AS prz_low, lv[len(lv)] AS prz_high, nr[2] AS confluent_low, nr[3] AS confluent_high, 1 - (nr[3] - nr[2]) / abs(a - x) AS prz_score,
      list_avg(list_filter([{_E('ab_ratio', 'l_ab')}, {_E('bc_ratio', 'l_bc')}, {_E('cd_ratio', 'l_cd')}, {_E('final_ratio', 'l_fin')}], lambda e: e IS NOT NULL)) AS fib_error,
      least(abs(nr[2] - d), abs(nr[3] - d)) / abs(a - x) AS d_error, a > x AS is_bull, a_bar - x_bar AS b1, b_bar - a_bar AS b2, c_bar - b_bar AS b3, d_bar - c_bar AS b4,
      greatest(x, a, b, c, d) - least(x, a, b, c, d) AS height FROM g5)"""


def sql(body):
    return with_bars(FIVE_SQL + body, recursive=True)


def matches(spark, sf):
    return hm.five_point_zigzag(pv.zigzag_pct(bar_table(spark, sf), DEV))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "h01_h04_test_ratios",
    sql(" SELECT symbol, tf, seq, model, round(ab_ratio, 6) AS ab_ratio, round(bc_ratio, 6) AS bc_ratio, round(cd_ratio, 6) AS cd_ratio, round(final_ratio, 6) AS final_ratio FROM m5"),
)
def q_ratios(spark, sf):
    return r6(matches(spark, sf).select(*ID, "ab_ratio", "bc_ratio", "cd_ratio", "final_ratio"), "ab_ratio", "bc_ratio", "cd_ratio", "final_ratio")


@query(
    "h02_pivots_left_right",
    with_bars(
        """, g AS (SELECT unnest([5, 13, 34]) AS period),
        p AS (SELECT m.symbol, m.tf, m.bar_index, period, count(*) AS n, NOT bool_or(b.high > m.high) AS is_high, NOT bool_or(b.low < m.low) AS is_low
          FROM bars m, g JOIN bars b ON b.symbol = m.symbol AND b.bar_index BETWEEN m.bar_index - period AND m.bar_index + period GROUP BY 1, 2, 3, 4)
        SELECT symbol, tf, bar_index, CAST(period AS INTEGER) AS period, is_high, is_low FROM p WHERE n = 2 * period + 1 AND (is_high OR is_low)"""
    ),
)
def q_pivots(spark, sf):
    return hm.pivots_left_right(walk_bars(spark, sf), (5, 13, 34))


_PIVOT = lambda other, at: f"ASOF JOIN {other} o ON t.symbol = o.symbol AND t.bull = o.bull AND t.period = o.period AND {at}"
_SPAN = lambda values, first, last: f"{values}[{first} + 1 : {last} + 1]"
XABC_SQL = with_bars(
    f""", s AS (SELECT symbol, tf, bar_index, bull, CASE WHEN bull THEN high ELSE -low END AS up, CASE WHEN bull THEN low ELSE -high END AS dn
      FROM bars, (VALUES (true), (false)) d(bull)),
    l AS (SELECT symbol, bull, list(up ORDER BY bar_index) AS ups, list(dn ORDER BY bar_index) AS dns FROM s GROUP BY 1, 2),
    f AS (SELECT s.*, period FROM s, (SELECT unnest(range({hm.MIN_PERIOD}, {hm.MAX_PERIOD} + 1)) AS period)),
    q AS MATERIALIZED (SELECT *, count(*) OVER w = 2 * period + 1 AND max(up) OVER w <= up AS is_up, count(*) OVER w = 2 * period + 1 AND min(dn) OVER w >= dn AS is_dn,
      count(*) OVER e = period + 2 AND max(up) OVER e <= up AS is_c FROM f WINDOW w AS (PARTITION BY symbol, bull, period ORDER BY bar_index
      ROWS BETWEEN period PRECEDING AND period FOLLOWING), e AS (PARTITION BY symbol, bull, period ORDER BY bar_index ROWS BETWEEN period PRECEDING AND 1 FOLLOWING)),
    highs AS (SELECT symbol, bull, period, bar_index AS at FROM q WHERE is_up AND NOT is_dn),
    lows AS (SELECT symbol, bull, period, bar_index AS at FROM q WHERE is_dn AND NOT is_up),
    tc AS (SELECT symbol, tf, bull, period, bar_index AS c_bar, bar_index - period AS reach, greatest(period, bar_index - least(500, 25 * period)) AS oldest FROM q WHERE is_c),
    tb AS (SELECT t.*, o.at AS b_bar FROM tc t {_PIVOT('lows', 't.reach >= o.at')}),
    ta AS (SELECT t.*, o.at AS a_bar FROM tb t {_PIVOT('highs', 't.b_bar > o.at')}),
    tx AS (SELECT t.*, o.at AS x_bar FROM ta t {_PIVOT('lows', 't.a_bar > o.at')})
    SELECT symbol, tf, bull AS is_bull, CAST(period AS INTEGER) AS period, x_bar, a_bar, b_bar, c_bar,
      abs(dns[x_bar + 1]) AS x, abs(ups[a_bar + 1]) AS a, abs(dns[b_bar + 1]) AS b, abs(ups[c_bar + 1]) AS c
    FROM tx JOIN l USING (symbol, bull) WHERE x_bar >= oldest
      AND list_max({_SPAN('ups', 'b_bar', 'c_bar')}) <= ups[c_bar + 1] AND list_min({_SPAN('dns', 'b_bar', 'c_bar')}) >= dns[b_bar + 1]
      AND list_max({_SPAN('ups', 'a_bar', 'b_bar - 1')}) <= ups[a_bar + 1] AND list_min({_SPAN('dns', 'a_bar', 'b_bar - 1')}) >= dns[b_bar + 1]
      AND list_max({_SPAN('ups', 'x_bar', 'a_bar - 1')}) <= ups[a_bar + 1] AND list_min({_SPAN('dns', 'x_bar', 'a_bar - 1')}) >= dns[x_bar + 1]"""
)


@query("h03_find_xabc", XABC_SQL)
def q_xabc(spark, sf):
    return hm.find_xabc(bar_table(spark, sf))


_PRZ = ("prz_low", "prz_high", "confluent_low", "confluent_high", "prz_score")


@query("h05_prz", sql(" SELECT symbol, tf, seq, model, " + ", ".join(f"round({c}, 5) AS {c}" for c in _PRZ) + " FROM z5"))
def q_prz(spark, sf):
    return matches(spark, sf).select(*ID, *[F.round(c, 5).alias(c) for c in _PRZ])


@query(
    "h06_harmonic_score",
    sql(
        """ SELECT symbol, tf, seq, model, round(fib_error, 6) AS fib_error, round(CASE WHEN model = 'CYPHER' THEN ((1 - fib_error) * 4 + (1 - d_error) * 3) / 7
        ELSE ((1 - fib_error) * 4 + prz_score * 2 + (1 - d_error) * 3) / 9 END, 6) AS score FROM z5"""
    ),
)
def q_score(spark, sf):
    return r6(matches(spark, sf).select(*ID, "fib_error", "score"), "fib_error", "score")


_SYM = " AND ".join(
    f"b{i} <= ({' + '.join(f'b{j}' for j in range(1, 5) if j != i)}) / 3 * 3.5 AND b{i} >= ({' + '.join(f'b{j}' for j in range(1, 5) if j != i)}) / 3 * -1.5"
    for i in range(1, 5)
)
_ASY = " + ".join(f"abs(1 - b{i} / (({' + '.join(f'b{j}' for j in range(1, 5) if j != i)}) / 3))" for i in range(1, 5))


@query("h07_leg_symmetry", sql(f" SELECT symbol, tf, seq, model, {_SYM} AS symmetric, round(({_ASY}) / 4, 6) AS asymmetry FROM z5"))
def q_sym(spark, sf):
    return matches(spark, sf).select(*ID, hm.leg_symmetry().alias("symmetric"), F.round("asymmetry", 6).alias("asymmetry"))


_TP = lambda i: "CASE model " + " ".join(
    f"WHEN '{m}' THEN " + ("c" if t[i][0] == "POINT_C" else f"greatest(0, d + {t[i][1]!r} * ({ {'AD': 'a - d', 'CD': 'c - d', 'XA': 'a - x'}[t[i][0]] }))")
    for m, t in hm.TARGETS.items()
) + " END"


@query(
    "h11_resolve_target",
    sql(
        f""" SELECT symbol, tf, seq, model, round({_TP(0)}, 4) AS tp1, round({_TP(1)}, 4) AS tp2,
        round(greatest(0, d + 0.5 * CASE WHEN a > x THEN height ELSE -height END), 4) AS tp_height, a AS tp_a FROM z5"""
    ),
)
def q_targets(spark, sf):
    t = matches(spark, sf).withColumns(hm.default_targets(F.col("d")))
    return t.select(
        *ID, F.round("tp1", 4).alias("tp1"), F.round("tp2", 4).alias("tp2"),
        F.round(hm.resolve_target("PATTERN_HEIGHT", 0.5, F.col("d")), 4).alias("tp_height"), hm.resolve_target("POINT_A", 0, F.col("d")).alias("tp_a"),
    )


_STOP_SQL = {
    "PERCENT_BEYOND_D": ("d * 0.95", "d * 1.05"),
    "PERCENT_BEYOND_X_OR_D": ("least(x, d) * 0.95", "greatest(x, d) * 1.05"),
    "PERCENT_BEYOND_ENTRY": ("e * 0.95", "e * 1.05"),
    "TARGET_DISTANCE_BEYOND_ENTRY": ("e - 0.05 * abs(a - e)", "e + 0.05 * abs(a - e)"),
    "PERCENT_BEYOND_FARTHEST_PRZ": ("prz_low * 0.95", "prz_high * 1.05"),
    "PATTERN_PERCENT_BEYOND_D": ("d - 0.05 * height", "d + 0.05 * height"),
    "PATTERN_PERCENT_BEYOND_ENTRY": ("e - 0.05 * height", "e + 0.05 * height"),
}


@query(
    "h12_h13_stops",
    sql(
        ", e5 AS (SELECT *, (c + 3 * d) / 4 AS e FROM z5) SELECT symbol, tf, seq, model, "
        + ", ".join(f"round(CASE WHEN is_bull THEN greatest(0, {b}) ELSE {s} END, 3) AS {m.lower()}" for m, (b, s) in _STOP_SQL.items())
        + ", round(height, 4) AS height, round(greatest(0, CASE WHEN is_bull THEN e + 1.5 * abs(e - d) ELSE e - 1.5 * abs(e - d) END), 3) AS tp_from_stop FROM e5"
    ),
)
def q_stops(spark, sf):
    m = matches(spark, sf)
    e = (F.col("c") + 3 * F.col("d")) / 4
    return m.select(
        *ID, *[F.round(hm.stop_loss(k, 5.0, e, F.col("a")), 3).alias(k.lower()) for k in hm.STOP_MODES],
        F.round(hm.pattern_height(), 4).alias("height"), F.round(hm.target_from_stop(F.col("is_bull"), e, F.col("d"), 1.5), 3).alias("tp_from_stop"),
    )


@query("h14_five_point_zigzag", sql(" SELECT symbol, tf, seq, model, is_bull, x_bar, a_bar, b_bar, c_bar, d_bar FROM z5"))
def q_five(spark, sf):
    return matches(spark, sf).select(*ID, "is_bull", "x_bar", "a_bar", "b_bar", "c_bar", "d_bar")


@query("h08_candidate_pool")
def q_pool(spark, sf):
    c = hm.candidates(hm.find_xabc(bar_table(spark, sf)))
    return c.select(*hm.CAND, "expires", F.coalesce("replaced_at", F.lit(-1)).alias("replaced_at"), F.round("score", 6).alias("score"))


@query("h09_confirm_d")
def q_confirm(spark, sf):
    bars = bar_table(spark, sf)
    return hm.completions(hm.candidates(cut(hm.find_xabc(bars))), bars).select(*hm.CAND, "d_bar", "d")


@query("h10_harmonic_items")
def q_items(spark, sf):
    bars = bar_table(spark, sf)
    return hm.harmonic_items(bars).select(*hm.CAND, "d_bar", "d", F.round("score", 6).alias("score"), "tp1", "tp2")
