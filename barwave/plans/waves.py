"""Wave rule, score and markup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.functions.wave_tables import COEFFICIENT, GRAMMAR, POSITION_PROBABILITY, RATIOS
from barwave.operators import pivots as pv
from barwave.operators import waves as wv
from barwave.plans.oracle import with_bars
from barwave.plans.prices import weight_sql
from barwave.plans.registry import query
from barwave.plans.zigzags import legs_sql, zigzag_sql
from barwave.session import cut
from barwave.sources.ticks import bar_table, walk_bars

DEV = 0.5


def cand_sql(n: int) -> str:
    """CTE ``cd``: every n-wave model on every n consecutive legs with its reason."""
    models = wv.FIVE if n == 5 else wv.THREE
    pts = ", ".join(f"lead(value, {i}) OVER k AS p{i}, lead(bar_index, {i}) OVER k AS b{i}" for i in range(n + 1))
    lens = ", ".join(f"abs(p{i} - p{i - 1}) AS w{i}" for i in range(1, n + 1))
    text = "CASE model " + " ".join(f"WHEN '{m}' THEN {wv.reason_text(m)}" for m in models) + " END"
    return zigzag_sql() + f""", pp AS (SELECT symbol, tf, row_number() OVER k - 1 AS seq, {pts} FROM zz WINDOW k AS (PARTITION BY symbol ORDER BY bar_index, is_high DESC)),
    pw AS (SELECT *, {lens}, CASE WHEN p1 > p0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM pp WHERE p{n} IS NOT NULL),
    cd AS MATERIALIZED (SELECT *, {text} AS reason FROM pw, (SELECT unnest({list(models)}) AS model))"""


def sql(n: int, body: str) -> str:
    return with_bars(cand_sql(n) + body, recursive=True)


def cands(spark, sf, n):
    return wv.flat_candidates(pv.zigzag_pct(bar_table(spark, sf), DEV), n)


for _key, _n, _models in (
    ("e02_impulse_rules", 5, ("IMPULSE",)),
    ("e03_diagonal_rules", 5, wv.DIAGONALS),
    ("e04_zigzag_rules", 3, ("ZIGZAG", "DOUBLE_ZIGZAG")),
    ("e04_triple_zigzag_rules", 5, ("TRIPLE_ZIGZAG",)),
    ("e05_e07_flat_rules", 3, ("FLAT_EXTENDED", "FLAT_RUNNING", "FLAT_REGULAR")),
    ("e06_e07_triangle_rules", 5, wv.TRIANGLES),
):

    @query(_key, sql(_n, f" SELECT symbol, tf, seq, model, coalesce(reason, 'NONE') AS reason FROM cd WHERE model IN {tuple(_models) if len(_models) > 1 else repr(tuple(_models)).replace(',)', ')')}"))
    def _q(spark, sf, n=_n, models=_models):
        return cands(spark, sf, n).where(F.col("model").isin(*models)).select("symbol", "tf", "seq", "model", F.coalesce("reason", F.lit("NONE")).alias("reason"))


def _time_text(models):
    parts = [f"WHEN '{m}' THEN {' OR '.join(f'({t})' for t in wv.TIME_RULES[m].values())}" for m in models if m in wv.TIME_RULES]
    return "CASE model " + " ".join(parts) + " ELSE false END"


@query("e08_time_window", sql(3, f" SELECT symbol, tf, seq, model, {_time_text(wv.THREE)} AS outside FROM cd"))
def q_time(spark, sf):
    return cands(spark, sf, 3).select("symbol", "tf", "seq", "model", F.expr(_time_text(wv.THREE)).alias("outside"))


def _ratio_text(models):
    return "CASE model " + " ".join(f"WHEN '{m}' THEN {wv.ratio_rule(m)}" for m in models) + " END"


@query("e10_ratio_bounds", sql(5, f" SELECT symbol, tf, seq, model, {_ratio_text(wv.FIVE)} AS outside FROM cd"))
def q_bounds(spark, sf):
    return cands(spark, sf, 5).select("symbol", "tf", "seq", "model", F.expr(_ratio_text(wv.FIVE)).alias("outside"))


def fib_sql(models) -> str:
    def one(m):
        parts = [weight_sql(n, f"(w{a} / w{b})") for n, a, b in RATIOS[m]]
        return "pow(" + " * ".join(parts) + f", 1.0 / {len(parts)})"

    return "CASE model " + " ".join(f"WHEN '{m}' THEN {one(m)}" for m in models) + " END"


def over_sql(models) -> str:
    f = lambda i: f"CASE WHEN w{i} / w{i - 1} <= 0.9 THEN 1 WHEN w{i} / w{i - 1} >= 1.3 THEN 0.7 ELSE 1 - 0.3 * (w{i} / w{i - 1} - 0.9) / 0.4 END::DOUBLE"

    def one(m):
        skip = m.startswith("FLAT") or m == "TRIANGLE_RUNNING"
        waves = [i for i in range(2, wv.WAVES[m] + 1, 2) if not (skip and i == 2)]
        return "pow(" + " * ".join(f(i) for i in waves) + f", 1.0 / {len(waves)})" if waves else "1::DOUBLE"

    return "CASE model " + " ".join(f"WHEN '{m}' THEN {one(m)}" for m in models) + " END"


def time_sql(models) -> str:
    def f(i, c):
        r = f"((b{c} - b{c - 1})::DOUBLE / (b{i} - b{i - 1}))"
        return f"CASE WHEN {r} >= 1 THEN 1 ELSE 0.6 + 0.4 * greatest(least(({r} - 0.3) / 0.7, 1), 0) END::DOUBLE"

    def one(m):
        pairs = wv.PAIRS.get(m, ())
        return "pow(" + " * ".join(f(i, c) for i, c in pairs) + f", 1.0 / {len(pairs)})" if pairs else "1::DOUBLE"

    return "CASE model " + " ".join(f"WHEN '{m}' THEN {one(m)}" for m in models) + " END"


def line_sql(models) -> str:
    a = "(p3 + (p3 - p1) / (b3 - b1) * (b5 - b3))"
    b = "(p4 + (p4 - p2) / (b4 - b2) * (b5 - b4))"
    lo, hi = f"least({a}, {b})", f"greatest({a}, {b})"
    text = f"CASE WHEN {hi} - {lo} <= 0 OR p5 BETWEEN {lo} AND {hi} THEN 1 ELSE 0.7 + 0.3 * (1 - least(greatest({lo} - p5, p5 - {hi}) / nullif({hi} - {lo}, 0), 1)) END::DOUBLE"
    return f"CASE WHEN model IN {wv.DIAGONALS + wv.TRIANGLES} THEN {text} ELSE 1::DOUBLE END"


for _n in (3, 5):
    _m = wv.FIVE if _n == 5 else wv.THREE
    _line = line_sql(_m) if _n == 5 else "1::DOUBLE"

    @query(
        f"e11_e14_scores_{_n}",
        sql(_n, f" SELECT symbol, tf, seq, model, round({fib_sql(_m)}, 6) AS fib, round({over_sql(_m)}, 6) AS overshoot, round({time_sql(_m)}, 6) AS duration, round({_line}, 6) AS trendline FROM cd"),
    )
    def _q2(spark, sf, n=_n, m=_m):
        c = cands(spark, sf, n)
        return c.select(
            "symbol", "tf", "seq", "model", F.round(wv.fib_score(m), 6).alias("fib"), F.round(wv.overshoot_penalty(m), 6).alias("overshoot"),
            F.round(wv.time_penalty(m), 6).alias("duration"), F.round(wv.trendline_penalty(m), 6).alias("trendline"),
        )


_GRAMMAR_ROWS = ", ".join(
    f"('{p}', {i}, '{c}', {POSITION_PROBABILITY.get((p, k, c), COEFFICIENT[c])})"
    for p, g in GRAMMAR.items()
    for i, (k, kids) in enumerate(g.items(), 1)
    for c in (*kids, "SIMPLE_IMPULSE")
)


@query(
    "e01_e15_position_probability",
    sql(3, f", gr AS (SELECT * FROM (VALUES {_GRAMMAR_ROWS}) t(model, pos, child, prob)) SELECT symbol, tf, seq, cd.model, CAST(pos AS INTEGER) AS pos, child, round(prob::DOUBLE, 6) AS prob FROM cd JOIN gr USING (model) WHERE reason IS NULL"),
)
def q_grammar(spark, sf):
    ok = cands(spark, sf, 3).where("reason IS NULL").select("symbol", "tf", "seq", "model")
    return ok.join(F.broadcast(wv.position_table(spark)), "model").withColumn("prob", F.round("prob", 6))


_V1_DUR = "CASE WHEN {a} / {b} > {l} THEN greatest(0.1, 1 - ({a} / {b} / {l} - 1) * 0.5) ELSE 1 END::DOUBLE"
_DUR = "(" + _V1_DUR.format(a="(b4 - b3)::DOUBLE", b="(b2 - b1)", l=1.5) + " * " + _V1_DUR.format(a="(b2 - b1)::DOUBLE", b="(b4 - b3)", l=1.1) + ")"


def bonus_sql(models) -> str:
    def one(m):
        idx = wv._CORRECTIVE.get(m, (2,))
        if not idx:
            return "1::DOUBLE"
        return "1 + 0.3 * (" + " + ".join(f"(b{i} - b{i - 1})::DOUBLE / (b{wv.WAVES[m]} - b0)" for i in idx) + f") / {len(idx)}"

    return "CASE model " + " ".join(f"WHEN '{m}' THEN {one(m)}" for m in models) + " END"


@query("e31_duration_penalty_bonus", sql(5, f" SELECT symbol, tf, seq, model, round({_DUR}, 9) AS penalty, round({bonus_sql(wv.FIVE)}, 9) AS bonus FROM cd"))
def q_v1(spark, sf):
    return cands(spark, sf, 5).select(
        "symbol", "tf", "seq", "model", F.round(wv.duration_penalty_v1(), 9).alias("penalty"), F.round(wv.bar_count_bonus_v1(wv.FIVE), 9).alias("bonus")
    )


def v1_sql(models) -> str:
    def one(m):
        parts = [weight_sql(n, f"(w{a} / w{b})") for n, a, b in RATIOS[m]]
        n, prod = len(parts), " * ".join(parts)
        plain = f"pow({prod}, 1.0 / {n}) * (1 + log2({n + 1}) * 0.15)"
        if m == "IMPULSE" or m in wv.DIAGONALS:
            plain = f"CASE WHEN {_DUR} < 1 THEN pow({prod} * {_DUR}, 1.0 / {n + 1}) * (1 + log2({n + 2}) * 0.15) ELSE {plain} END"
        out = f"{wv.V1_COEF[m]} * {plain}"
        return out + (" * CASE WHEN s * (p5 - p3) < 0 THEN 0.3 ELSE 1 END" if m == "IMPULSE" else "")

    return "(CASE model " + " ".join(f"WHEN '{m}' THEN {one(m)}" for m in models) + f" END) * ({bonus_sql(models)})"


@query("e26_fib_score_v1", sql(5, f" SELECT symbol, tf, seq, model, round({v1_sql(wv.FIVE)}, 6) AS score FROM cd"))
def q_v1_score(spark, sf):
    return cands(spark, sf, 5).select("symbol", "tf", "seq", "model", F.round(wv.fib_score_v1(wv.FIVE), 6).alias("score"))


@query("e29_death_funnel", sql(5, " SELECT symbol, tf, model, coalesce(reason, 'NONE') AS reason, count(*) AS n FROM cd GROUP BY ALL"))
def q_funnel(spark, sf):
    return wv.death_funnel(cands(spark, sf, 5))


@query(
    "e17_beam_topk",
    sql(
        3,
        f""", sc AS (SELECT symbol, tf, seq // 40 AS chunk, model, seq AS start_seq, seq + 3 AS end_seq, list_position({['IMPULSE'] + ['x'] * 7 + ['ZIGZAG', 'DOUBLE_ZIGZAG', 'x', 'FLAT_REGULAR', 'FLAT_EXTENDED', 'FLAT_RUNNING']}, model) AS model_rank,
          round({fib_sql(wv.THREE)}, 6) AS score FROM cd WHERE model <> 'FLAT_RUNNING'),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol, chunk, model ORDER BY score DESC, model_rank, start_seq, end_seq) AS m FROM sc),
        f AS (SELECT *, sum(CASE WHEN m <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, chunk) AS kept,
          row_number() OVER (PARTITION BY symbol, chunk, m <= 3 ORDER BY score DESC, model_rank, start_seq, end_seq) AS k FROM r)
        SELECT symbol, tf, chunk, model, start_seq, end_seq, score FROM f WHERE m <= 3 OR k <= 20 - kept""",
    ),
)
def q_beam(spark, sf):
    c = cands(spark, sf, 3).where("model <> 'FLAT_RUNNING'")
    c = c.select(
        "symbol", "tf", F.floor(F.col("seq") / 40).alias("chunk"), "model", F.col("seq").alias("start_seq"), (F.col("seq") + 3).alias("end_seq"),
        wv.model_rank().alias("model_rank"), F.round(wv.fib_score(wv.THREE), 6).alias("score"),
    )
    return wv.beam_topk(c, ["symbol", "tf", "chunk"]).drop("model_rank")


@query(
    "e27_flat_wave_c",
    sql(
        3,
        """, f AS (SELECT DISTINCT symbol, tf, seq, s, p0, p1, p2, p3, w1, w2 / w1 AS ba, w3 / w1 AS ca FROM cd),
        g AS (SELECT *, s * (p2 - p0) < 0 AND ba >= 0.786::DOUBLE * 0.9::DOUBLE AND ba <= 1.618::DOUBLE * 1.1::DOUBLE AS base FROM f)
        SELECT symbol, tf, seq, 'FLAT_EXTENDED' AS model, round(ba, 6) AS b_to_a, round(ca, 6) AS c_to_a FROM g WHERE base AND s * (p3 - p1) > 0
          AND len(list_filter([0.618, 1.0, 1.618, 2.618]::DOUBLE[], lambda r: ca >= r / 1.1 AND ca <= r * 1.1)) > 0
        UNION ALL SELECT symbol, tf, seq, 'FLAT_RUNNING', round(ba, 6), round(ca, 6) FROM g WHERE base AND s * (p0 - p3) >= 0.382 * w1 - 1e-9 AND s * (p3 - p0) < 0 AND ca <= 1.618 * 1.1""",
    ),
)
def q_flat(spark, sf):
    f = wv.flat_wave_c(pv.zigzag_pct(bar_table(spark, sf), DEV))
    return f.withColumns({c: F.round(c, 6) for c in ("b_to_a", "c_to_a")})


@query("e21_partial_candidates")
def q_partial(spark, sf):
    return wv.partial_candidates(pv.zigzag_pct(bar_table(spark, sf), DEV)).select("symbol", "tf", "model", "seq", "confirmed", "waves", F.round("score", 6).alias("score"))


@query("e32_partial_candidates_anywhere")
def q_partial_all(spark, sf):
    p = wv.partial_candidates(pv.zigzag_pct(bar_table(spark, sf), DEV), all_ends=True)
    # the older scoring squares the completeness
    share = F.col("confirmed") / F.col("waves")
    return p.select("symbol", "tf", "model", "seq", "confirmed", "waves", F.round(F.col("score") * share, 6).alias("score"))


@query("e22_project_waves")
def q_project(spark, sf):
    p = wv.project_waves(wv.partial_candidates(pv.zigzag_pct(bar_table(spark, sf), DEV)))
    return p.select("symbol", "tf", "model", "seq", "confirmed", "wave", F.round("price", 4).alias("price"), "bar", "label", "weight", "cancel_price", "cancel_bar")


@query(
    "e23_cluster_zones",
    sql(
        5,
        """, pr AS (SELECT DISTINCT symbol, tf, seq, p0, p1, p5, b5 FROM cd),
        pj AS (SELECT symbol, tf, seq, unnest([1, 2, 3]) AS i, unnest([0.618, 1.0, 1.618]::DOUBLE[]) AS r, p5 + (p1 - p0) * unnest([0.618, 1.0, 1.618]::DOUBLE[]) AS price, b5 + unnest([5, 8, 13]) AS bar FROM pr)
        SELECT a.symbol, a.tf, a.seq, least(a.price, b.price) AS zone_low, greatest(a.price, b.price) AS zone_high, round(a.r * b.r, 6) AS weight, a.bar AS bar_from, b.bar AS bar_to
        FROM pj a JOIN pj b ON a.symbol = b.symbol AND a.seq = b.seq AND a.i < b.i WHERE abs(a.price - b.price) / ((a.price + b.price) / 2) <= 0.05""",
    ),
)
def q_zones(spark, sf):
    w = wv.leg_windows(pv.zigzag_pct(bar_table(spark, sf), DEV), 5)
    pts = F.array(
        *[
            F.struct((F.col("p5") + (F.col("p1") - F.col("p0")) * F.lit(r)).alias("price"), (F.col("b5") + b).alias("bar"), F.lit(r).alias("weight"), F.lit(str(r)).alias("label"))
            for r, b in ((0.618, 5), (1.0, 8), (1.618, 13))
        ]
    )
    z = wv.cluster_zones(w.select("symbol", "tf", "seq", pts.alias("pts")), "pts")
    return z.select("symbol", "tf", "seq", "zone_low", "zone_high", F.round("weight", 6).alias("weight"), "bar_from", "bar_to")


@query(
    "e25_candle_breach",
    with_bars(
        zigzag_sql()
        + legs_sql()
        + """, sp AS (SELECT symbol, tf, seq, start_bar, start_value, lead(end_bar, 2) OVER k AS end_bar, lead(end_value, 2) OVER k AS end_value FROM legs WINDOW k AS (PARTITION BY symbol ORDER BY seq))
        SELECT sp.symbol, sp.tf, seq, bool_or(bar_index > start_bar AND bar_index < end_bar AND (high > greatest(start_value, end_value) OR low < least(start_value, end_value))) AS breached,
          bool_or(bar_index = end_bar AND (high = end_value OR low = end_value)) AS on_bar
          FROM sp JOIN bars b ON b.symbol = sp.symbol AND b.bar_index BETWEEN start_bar AND end_bar WHERE end_bar IS NOT NULL GROUP BY 1, 2, 3""",
        recursive=True,
    ),
)
def q_breach(spark, sf):
    bars = bar_table(spark, sf)
    w = wv.leg_windows(pv.zigzag_pct(bars, DEV), 3)
    s = w.select("symbol", "tf", "seq", F.col("b0").alias("start_bar"), F.col("p0").alias("start_value"), F.col("b3").alias("end_bar"), F.col("p3").alias("end_value"))
    return wv.candle_breach(s, bars, ["seq"])


PEAK_SQL = """, n AS (SELECT symbol, max(bar_index) AS last FROM bars GROUP BY symbol),
    h AS (SELECT a.symbol, a.tf, a.bar_index, a.high AS peak, any_value(last) AS last,
      (SELECT min(b.bar_index) FROM bars b WHERE b.symbol = a.symbol AND b.bar_index >= a.bar_index + 5 AND b.high > a.high) AS fa,
      (SELECT max(b.bar_index) FROM bars b WHERE b.symbol = a.symbol AND b.bar_index <= a.bar_index - 5 AND b.high > a.high) AS ba FROM bars a JOIN n ON n.symbol = a.symbol GROUP BY 1, 2, 3, 4),
    pk AS (SELECT symbol, tf, bar_index, peak, CAST(least(greatest(coalesce(fa, last + 1) - bar_index - 5, 0), greatest(bar_index - 5 - coalesce(ba, -1), 0)) AS BIGINT) AS score FROM h)"""


@query("e28_peak_scores", with_bars(PEAK_SQL + " SELECT * FROM pk WHERE score > 0"))
def q_peaks(spark, sf):
    return wv.peak_scores(bar_table(spark, sf))


@query("e28_top_peaks")
def q_top(spark, sf):
    return wv.top_peaks(cut(wv.peak_scores(bar_table(spark, sf))))


@query(
    "e30_markup_diff",
    with_bars(
        zigzag_sql("za", "0.5::DOUBLE")
        + legs_sql("la", "za")
        + zigzag_sql("zb", "0.7::DOUBLE")
        + legs_sql("lb", "zb")
        + """, o AS (SELECT symbol, tf, start_bar || '-' || end_bar AS node_id, open_end AS p FROM la), n AS (SELECT symbol, tf, start_bar || '-' || end_bar AS node_id, open_end AS p FROM lb)
        SELECT symbol, tf, node_id, CASE WHEN o.p IS NULL THEN 'BORN' WHEN n.p IS NULL THEN 'DIED' WHEN o.p AND NOT n.p THEN 'COMPLETED' WHEN NOT o.p AND n.p THEN 'PROJECTED' ELSE 'SAME' END AS change
        FROM o FULL JOIN n USING (symbol, tf, node_id)""",
        recursive=True,
    ),
)
def q_diff(spark, sf):
    bars = bar_table(spark, sf)
    ids = lambda d: pv.segments(pv.zigzag_pct(bars, d)).select(
        "symbol", "tf", F.concat_ws("-", "start_bar", "end_bar").alias("node_id"), F.col("open_end").alias("is_projected")
    )
    return wv.markup_diff(ids(0.5), ids(0.7))
