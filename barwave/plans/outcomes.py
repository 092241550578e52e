"""Outcome and report queries over candle-pattern signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.functions.prices import break_even_price
from barwave.operators import candles as cd
from barwave.operators import indicators as ind
from barwave.operators import outcomes as oc
from barwave.operators import reports as rp
from barwave.operators.setups import price_action_setups
from barwave.plans.candles import patterns_sql
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.sources.ticks import bar_table, walk_bars

# ---- DuckDB building blocks ----

SETUPS_SQL = patterns_sql() + """, lim AS (SELECT p.symbol, p.tf, p.pattern, p.is_bull, p.bar_index, p.stop, p.limit_price,
      min(b.bar_index) FILTER (CASE WHEN is_bull THEN b.high >= limit_price ELSE b.low <= limit_price END) AS touch,
      min(b.bar_index) FILTER (CASE WHEN is_bull THEN b.low <= stop ELSE b.high >= stop END) AS stopped
      FROM pats p JOIN bars b ON b.symbol = p.symbol AND b.bar_index > p.bar_index WHERE p.limit_price IS NOT NULL GROUP BY ALL),
    lim2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar_index, regexp_replace(pattern, '^(UP|DOWN)_', '') ORDER BY touch, is_bull DESC) AS k
      FROM lim WHERE touch IS NOT NULL AND touch < coalesce(stopped, 1e15)),
    ent AS (SELECT symbol, tf, pattern, is_bull, bar_index AS pattern_bar, bar_index AS entry_bar, bar_index AS scan_from, close AS entry, stop
      FROM pats WHERE limit_price IS NULL
      UNION ALL SELECT symbol, tf, pattern, is_bull, bar_index, touch, touch - 1, limit_price, stop FROM lim2 WHERE k = 1),
    sig AS MATERIALIZED (SELECT concat_ws('|', symbol, tf, 'PA', pattern, pattern_bar) AS signal_id, symbol, tf, pattern, is_bull AS is_long,
      pattern_bar, entry_bar, scan_from, entry, CASE WHEN is_bull THEN entry + abs(entry - stop) ELSE entry - abs(entry - stop) END AS tp,
      CASE WHEN is_bull THEN stop - abs(entry - stop) * 0.1::DOUBLE ELSE stop + abs(entry - stop) * 0.1::DOUBLE END AS sl
      FROM ent WHERE abs(entry - stop) > 0)"""


def outcomes_sql(name: str = "oc", src: str = "sig", policy: str = "sl_first", strict: bool = False, start: str = "scan_from") -> str:
    ge, le = (">", "<") if strict else (">=", "<=")
    cmp = "<=" if policy == "sl_first" else "<"
    return f""", {name}_h AS (SELECT s.*,
      (SELECT min(b.bar_index) FROM bars b WHERE b.symbol = s.symbol AND b.bar_index > s.{start}
        AND CASE WHEN s.is_long THEN b.low {le} s.sl ELSE b.high {ge} s.sl END) AS sl_bar,
      (SELECT min(b.bar_index) FROM bars b WHERE b.symbol = s.symbol AND b.bar_index > s.{start}
        AND CASE WHEN s.is_long THEN b.high {ge} s.tp ELSE b.low {le} s.tp END) AS tp_bar FROM {src} s),
    {name}_k AS (SELECT *, CASE WHEN sl_bar IS NULL AND tp_bar IS NULL THEN 'OPEN'
      WHEN coalesce(sl_bar, 1000000000) {cmp} coalesce(tp_bar, 1000000000) THEN 'SL' ELSE 'TP' END AS outcome FROM {name}_h),
    {name} AS MATERIALIZED (SELECT *, CASE outcome WHEN 'SL' THEN sl_bar WHEN 'TP' THEN tp_bar END AS exit_bar,
      CASE outcome WHEN 'SL' THEN sl WHEN 'TP' THEN tp END AS exit_price, coalesce(sl_bar = tp_bar, false) AS conflict FROM {name}_k)"""


R_SQL = """, rr AS (SELECT *, CASE WHEN is_long THEN 1 ELSE -1 END * (exit_price - entry) / abs(entry - sl) AS r,
      entry * (2.0::DOUBLE / 10000.0::DOUBLE) / abs(entry - sl) AS c FROM oc)"""

STATS_SQL = """count(*) AS trades, count(*) FILTER (outcome = 'TP') AS tp_count, count(*) FILTER (outcome = 'SL') AS sl_count,
      count(*) FILTER (outcome = 'OPEN') AS open_count,
      round(count(*) FILTER (outcome = 'TP')::DOUBLE / nullif(count(*) FILTER (outcome <> 'OPEN'), 0), 6) AS win_rate,
      round(avg(abs(tp - entry) / abs(entry - sl)) FILTER (outcome <> 'OPEN'), 6) AS avg_rr,
      round(sum(r) FILTER (outcome <> 'OPEN'), 6) AS total_r, round(sum(c) FILTER (outcome <> 'OPEN'), 6) AS cost_r,
      round(sum(r - c) FILTER (outcome <> 'OPEN'), 6) AS net_r, round(avg(r - c) FILTER (outcome <> 'OPEN'), 6) AS expectancy"""


def bar_or_none(name: str):
    """A bar number, -1 where there is none."""
    return F.coalesce(F.col(name), F.lit(-1)).cast("long").alias(name)


def pa_signals(spark, sf):
    bars = bar_table(spark, sf)
    return bars, price_action_setups(cd.candle_patterns(bars), bars)


def pa_outcomes(spark, sf, policy="sl_first"):
    bars, sig = pa_signals(spark, sf)
    return bars, oc.signal_outcomes(sig, bars, policy, start="scan_from")


@query(
    "flagship_pattern_outcomes",
    with_bars(SETUPS_SQL + outcomes_sql() + R_SQL + f" SELECT symbol, pattern, {STATS_SQL} FROM rr GROUP BY symbol, pattern"),
)
def q_flagship(spark, sf):
    _, out = pa_outcomes(spark, sf)
    return rp.trade_stats(out, ["symbol", "pattern"])


_SIG_COLS = "signal_id, symbol, tf, is_long, pattern_bar, entry_bar, entry, tp, sl"


@query(
    "g12_price_action_setups",
    with_bars(SETUPS_SQL + " SELECT signal_id, symbol, tf, is_long, pattern_bar, entry_bar, entry, round(tp, 6) AS tp, round(sl, 6) AS sl FROM sig"),
)
def q_setups(spark, sf):
    _, s = pa_signals(spark, sf)
    return s.select("signal_id", "symbol", "tf", "is_long", "pattern_bar", "entry_bar", "entry", F.round("tp", 6).alias("tp"), F.round("sl", 6).alias("sl"))


for _policy in ("sl_first", "tp_first"):

    @query(
        f"g14_signal_outcomes_{_policy}",
        with_bars(
            SETUPS_SQL + outcomes_sql(policy=_policy) + " SELECT signal_id, outcome, coalesce(exit_bar, -1) AS exit_bar, round(exit_price, 6) AS exit_price, conflict FROM oc"
        ),
    )
    def _q(spark, sf, policy=_policy):
        _, o = pa_outcomes(spark, sf, policy)
        return o.select("signal_id", "outcome", bar_or_none("exit_bar"), F.round("exit_price", 6).alias("exit_price"), "conflict")


# pending orders: entry half way to the stop
PENDING_SQL = SETUPS_SQL + """, pend AS (SELECT signal_id, symbol, tf, is_long, entry_bar, (entry + sl) / 2 AS entry, tp, sl FROM sig)"""


@query(
    "g15_limit_activation",
    with_bars(
        PENDING_SQL
        + """, h AS (SELECT s.signal_id, min(b.bar_index) FILTER (CASE WHEN is_long THEN low <= entry ELSE high >= entry END) AS a,
          min(b.bar_index) FILTER (CASE WHEN is_long THEN low <= sl OR high >= tp ELSE high >= sl OR low <= tp END) AS o
          FROM pend s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_index > s.entry_bar GROUP BY s.signal_id),
        k AS (SELECT *, CASE WHEN a IS NULL AND o IS NULL THEN 'PENDING'
          WHEN coalesce(o, 1000000000) < coalesce(a, 1000000000) THEN 'CANCELED' ELSE 'ACTIVE' END AS state FROM h)
        SELECT signal_id, state, CASE WHEN state = 'ACTIVE' THEN a ELSE -1 END AS active_bar FROM k"""
    ),
)
def q_limit(spark, sf):
    bars, s = pa_signals(spark, sf)
    p = s.withColumn("entry", (F.col("entry") + F.col("sl")) / 2)
    return oc.limit_activation(p, bars).select("signal_id", "state", bar_or_none("active_bar"))


@query(
    "g16_break_even_move",
    with_bars(
        SETUPS_SQL
        + """, s0 AS (SELECT *, sl + abs(tp - sl) * 0.75::DOUBLE * CASE WHEN tp > sl THEN 1 ELSE -1 END AS be FROM sig),
        h AS (SELECT s0.*, f.sb, f.tb, f.bb FROM s0 LEFT JOIN (SELECT s.signal_id,
          min(b.bar_index) FILTER (CASE WHEN is_long THEN low <= sl ELSE high >= sl END) AS sb,
          min(b.bar_index) FILTER (CASE WHEN is_long THEN high >= tp ELSE low <= tp END) AS tb,
          min(b.bar_index) FILTER (CASE WHEN is_long THEN high >= be ELSE low <= be END) AS bb
          FROM s0 s JOIN bars b ON b.symbol = s.symbol AND b.bar_index > s.entry_bar GROUP BY 1) f USING (signal_id)),
        m AS (SELECT *, coalesce(bb, 1000000000) < least(coalesce(sb, 1000000000), coalesce(tb, 1000000000)) AS moved FROM h),
        l AS (SELECT s.signal_id, min(b.bar_index) FILTER (CASE WHEN is_long THEN low <= be ELSE high >= be END) AS sb2,
          min(b.bar_index) FILTER (CASE WHEN is_long THEN high >= tp ELSE low <= tp END) AS tb2
          FROM m s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_index > s.bb WHERE moved GROUP BY 1),
        u AS (SELECT m.*, CASE WHEN moved THEN sb2 ELSE sb END AS s2, CASE WHEN moved THEN tb2 ELSE tb END AS t2 FROM m LEFT JOIN l USING (signal_id))
        SELECT signal_id, CASE WHEN s2 IS NULL AND t2 IS NULL THEN 'OPEN' WHEN coalesce(s2, 1000000000) <= coalesce(t2, 1000000000)
          THEN CASE WHEN moved THEN 'BE' ELSE 'SL' END ELSE 'TP' END AS outcome,
          coalesce(CASE WHEN coalesce(s2, 1000000000) <= coalesce(t2, 1000000000) THEN s2 ELSE t2 END, -1) AS exit_bar FROM u"""
    ),
)
def q_break_even(spark, sf):
    bars, s = pa_signals(spark, sf)
    s = s.withColumn("break_even", break_even_price(F.col("tp"), F.col("sl"), 0.75))
    return oc.break_even_outcomes(s, bars).select("signal_id", "outcome", bar_or_none("exit_bar"))


@query(
    "g18_one_open_setup",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, entry_bar ORDER BY signal_id) AS k FROM oc) WHERE k = 1),
        g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar) AS n FROM f),
        r AS (SELECT symbol, n, signal_id, coalesce(exit_bar, 1000000000) AS busy, true AS taken FROM g WHERE n = 1
        UNION ALL SELECT g.symbol, g.n, g.signal_id, CASE WHEN g.entry_bar <= r.busy THEN r.busy ELSE coalesce(g.exit_bar, 1000000000) END,
          g.entry_bar > r.busy FROM r JOIN g ON g.symbol = r.symbol AND g.n = r.n + 1)
        SELECT symbol, signal_id FROM r WHERE taken""",
        recursive=True,
    ),
)
def q_one_open(spark, sf):
    _, o = pa_outcomes(spark, sf)
    return oc.one_open_setup(o).select("symbol", "signal_id")


@query(
    "g19_cross_tf_duplicates",
    with_bars(
        """, h AS (SELECT symbol, 'h1' AS tf, open_time AS entry_time, open_time + INTERVAL 5 HOUR AS exit_time, round(high, -2) AS tp, round(low, -2) AS sl FROM bars
          UNION ALL SELECT symbol, 'h4', open_time + INTERVAL 2 HOUR, open_time + INTERVAL 7 HOUR, round(high, -2), round(low, -2) FROM bars)
        SELECT tf, symbol, entry_time, sl, tp FROM h s WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.symbol = s.symbol AND o.sl = s.sl AND o.tp = s.tp
          AND o.tf <> s.tf AND o.entry_time < s.entry_time AND s.entry_time <= o.exit_time)"""
    ),
)
def q_duplicates(spark, sf):
    bars = walk_bars(spark, sf)
    hours = lambda n: F.col("open_time") + F.expr(f"INTERVAL {n} HOURS")
    level = lambda c: F.round(c, -2)
    a = bars.select("symbol", F.lit("h1").alias("tf"), F.col("open_time").alias("entry_time"), hours(5).alias("exit_time"), level("high").alias("tp"), level("low").alias("sl"))
    b = bars.select("symbol", F.lit("h4").alias("tf"), hours(2).alias("entry_time"), hours(7).alias("exit_time"), level("high").alias("tp"), level("low").alias("sl"))
    return oc.cross_tf_duplicates(a.unionByName(b)).select("symbol", "tf", "entry_time", "sl", "tp")


@query(
    "g20_split_by_break_even",
    with_bars(
        SETUPS_SQL
        + """, s AS (SELECT signal_id, tp, sl + abs(tp - sl) * 0.75::DOUBLE * CASE WHEN tp > sl THEN 1 ELSE -1 END AS be, 1000.0 / abs(entry - sl) AS v FROM sig)
        SELECT signal_id, 'TP' AS part, round(tp, 6) AS target, round(v / 2, 8) AS half_volume FROM s
        UNION ALL SELECT signal_id, 'BE', round(be, 6), round(v / 2, 8) FROM s"""
    ),
)
def q_split(spark, sf):
    _, s = pa_signals(spark, sf)
    s = s.withColumn("break_even", break_even_price(F.col("tp"), F.col("sl"), 0.75)).withColumn("volume", 1000.0 / F.abs(F.col("entry") - F.col("sl")))
    return oc.split_by_break_even(s).select("signal_id", "part", F.round("target", 6).alias("target"), F.round("half_volume", 8).alias("half_volume"))


_SEQ_SQL = """, cl AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_bar, entry_bar, signal_id) - 1 AS trade_seq FROM {src} WHERE outcome IN ('TP', 'SL'))"""


@query(
    "g21_progressive_risk",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + _SEQ_SQL.format(src="oc")
        + """, r AS (SELECT symbol, trade_seq, signal_id, 1.0::DOUBLE AS risk, CASE outcome WHEN 'SL' THEN 2.0 ELSE 1.0 END::DOUBLE AS nxt FROM cl WHERE trade_seq = 0
        UNION ALL SELECT c.symbol, c.trade_seq, c.signal_id, r.nxt,
          CASE WHEN c.outcome = 'SL' THEN least(5.0, r.nxt + 1) ELSE greatest(1.0, r.nxt - 1) END FROM r JOIN cl c ON c.symbol = r.symbol AND c.trade_seq = r.trade_seq + 1)
        SELECT signal_id, trade_seq, risk FROM r""",
        recursive=True,
    ),
)
def q_risk(spark, sf):
    _, o = pa_outcomes(spark, sf)
    return oc.progressive_risk(o).select("signal_id", "trade_seq", "risk")


@query("r01_result_in_r", with_bars(SETUPS_SQL + outcomes_sql() + R_SQL + " SELECT signal_id, round(r, 8) AS r FROM rr"))
def q_r(spark, sf):
    _, o = pa_outcomes(spark, sf)
    return rp.result_in_r(o).select("signal_id", F.round("r", 8).alias("r"))


@query(
    "r01_weighted_r",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + """ SELECT signal_id, round((CASE WHEN is_long THEN 1 ELSE -1 END) * ((exit_price - entry) / abs(entry - sl) * 0.75::DOUBLE
          + ((entry + exit_price) / 2 - entry) / abs(entry - sl) * 0.25::DOUBLE), 8) AS r FROM oc WHERE outcome <> 'OPEN'"""
    ),
)
def q_weighted(spark, sf):
    _, o = pa_outcomes(spark, sf)
    parts = F.array(
        F.struct(F.col("exit_price").alias("p"), F.lit(0.75).alias("w")),
        F.struct(((F.col("entry") + F.col("exit_price")) / 2).alias("p"), F.lit(0.25).alias("w")),
    )
    o = o.where(F.col("outcome") != "OPEN").withColumn("_p", F.explode(parts))
    o = o.withColumn("exit_price", F.col("_p.p")).withColumn("share", F.col("_p.w"))
    return rp.weighted_r(o).withColumn("r", F.round("r", 8))


@query(
    "r02_running_total",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + R_SQL
        + _SEQ_SQL.format(src="rr")
        + """ SELECT signal_id, trade_seq, round(sum(r) OVER (PARTITION BY symbol ORDER BY trade_seq), 6) AS total_r, trade_seq + 1 AS total_count FROM cl"""
    ),
)
def q_running(spark, sf):
    _, o = pa_outcomes(spark, sf)
    seq = oc.progressive_risk(o)
    return rp.running_total(rp.result_in_r(seq)).select("signal_id", "trade_seq", F.round("total_r", 6).alias("total_r"), "total_count")


@query("r03_trade_stats", with_bars(SETUPS_SQL + outcomes_sql() + R_SQL + f" SELECT symbol, tf, {STATS_SQL} FROM rr GROUP BY symbol, tf"))
def q_stats(spark, sf):
    _, o = pa_outcomes(spark, sf)
    return rp.trade_stats(o, ["symbol", "tf"])


@query(
    "r08_per_model_stats",
    with_bars(SETUPS_SQL + outcomes_sql() + R_SQL + f" SELECT pattern, symbol, {STATS_SQL} FROM rr GROUP BY CUBE (pattern, symbol)"),
)
def q_models(spark, sf):
    _, o = pa_outcomes(spark, sf)
    return rp.per_model_stats(o)


_TG = (0.5, 1.0, 1.5, 2.0)
_SG = (0.5, 1.0, 2.0)
_GRID_SQL = (
    SETUPS_SQL
    + f""", lv AS (SELECT signal_id, symbol, tf, is_long, entry_bar, entry, abs(entry - sl) AS risk FROM sig),
    tl AS (SELECT *, 'T' || t AS target, entry + CASE WHEN is_long THEN 1 ELSE -1 END * t * risk AS tp FROM lv, (SELECT unnest({list(_TG)}::DOUBLE[]) AS t)),
    sl0 AS (SELECT *, 'S' || s AS stop, entry - CASE WHEN is_long THEN 1 ELSE -1 END * s * risk AS sl FROM lv, (SELECT unnest({list(_SG)}::DOUBLE[]) AS s)),
    th AS MATERIALIZED (SELECT t.signal_id, target, any_value(tp) AS tp, min(b.bar_index) FILTER (CASE WHEN is_long THEN high >= tp ELSE low <= tp END) AS tb
      FROM tl t LEFT JOIN bars b ON b.symbol = t.symbol AND b.bar_index > t.entry_bar GROUP BY 1, 2),
    sh AS MATERIALIZED (SELECT s.signal_id, stop, any_value(sl) AS sl, min(b.bar_index) FILTER (CASE WHEN is_long THEN low <= sl ELSE high >= sl END) AS sb
      FROM sl0 s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_index > s.entry_bar GROUP BY 1, 2),
    oc AS MATERIALIZED (SELECT lv.*, target, stop, tp, sl, CASE WHEN tb IS NULL AND sb IS NULL THEN 'OPEN'
      WHEN coalesce(sb, 1000000000) <= coalesce(tb, 1000000000) THEN 'SL' ELSE 'TP' END AS outcome,
      CASE WHEN tb IS NULL AND sb IS NULL THEN NULL WHEN coalesce(sb, 1000000000) <= coalesce(tb, 1000000000) THEN sl ELSE tp END AS exit_price
      FROM lv JOIN th USING (signal_id) JOIN sh USING (signal_id))"""
)


def grid_cells(spark, sf):
    bars, s = pa_signals(spark, sf)
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    risk = F.abs(F.col("entry") - F.col("sl"))
    targets = F.array(*[F.struct(F.lit(f"T{t}").alias("name"), (F.col("entry") + side * F.lit(t) * risk).alias("price")) for t in _TG])
    stops = F.array(*[F.struct(F.lit(f"S{t}").alias("name"), (F.col("entry") - side * F.lit(t) * risk).alias("price")) for t in _SG])
    return bars, rp.target_stop_grid(s, bars, targets, stops)


@query("r04_target_stop_grid", with_bars(_GRID_SQL + R_SQL + f" SELECT target, stop, {STATS_SQL} FROM rr GROUP BY target, stop"))
def q_grid(spark, sf):
    _, cells = grid_cells(spark, sf)
    return rp.trade_stats(cells, ["target", "stop"])


_ATR_SQL = """, tr AS (SELECT *, greatest(high, lag(close) OVER k) - least(low, lag(close) OVER k) AS tr FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY bar_index)),
    at AS (SELECT symbol, bar_index AS entry_bar, CASE WHEN bar_index >= 14 THEN sum(tr) OVER (PARTITION BY symbol ORDER BY bar_index
      ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 END AS atr FROM tr)""".replace(" at AS", " atrs AS")


@query(
    "r05_min_atr_thresholds",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + R_SQL
        + _ATR_SQL
        + f""", th AS (SELECT unnest([0, 0.5, 1, 1.5, 2]::DOUBLE[]) AS threshold)
        SELECT threshold, {STATS_SQL} FROM rr JOIN atrs USING (symbol, entry_bar) JOIN th ON abs(entry - sl) >= threshold * atr GROUP BY threshold"""
    ),
)
def q_atr(spark, sf):
    bars, o = pa_outcomes(spark, sf)
    a = ind.atr(bars, 14).select("symbol", "tf", F.col("bar_index").alias("entry_bar"), "atr")
    return rp.min_atr_thresholds(o.join(a, ["symbol", "tf", "entry_bar"]), (0, 0.5, 1, 1.5, 2))


_SAMPLE_SQL = """, nb AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol),
    sm AS (SELECT rr.*, CASE WHEN entry_bar < n // 2 THEN 'IN' ELSE 'OUT' END AS sample FROM rr JOIN nb USING (symbol))"""


@query(
    "r06_in_out_sample",
    with_bars(SETUPS_SQL + outcomes_sql() + R_SQL + _SAMPLE_SQL + f" SELECT sample, pattern, {STATS_SQL} FROM sm GROUP BY sample, pattern"),
)
def q_sample(spark, sf):
    bars, o = pa_outcomes(spark, sf)
    return rp.trade_stats(rp.in_out_sample(o, bars), ["sample", "pattern"])


@query(
    "r07_best_cell",
    with_bars(
        _GRID_SQL
        + R_SQL
        + _SAMPLE_SQL
        + """, c AS (SELECT sample, target, stop, count(*) AS trades, round(avg(r - c) FILTER (outcome <> 'OPEN'), 6) AS expectancy FROM sm GROUP BY ALL),
        b AS (SELECT target, stop, trades AS in_trades, expectancy AS in_expectancy FROM c WHERE sample = 'IN' AND trades >= 100
          ORDER BY expectancy DESC, target DESC, stop DESC LIMIT 1)
        SELECT b.*, c.trades AS out_trades, c.expectancy AS out_expectancy FROM b LEFT JOIN c ON c.target = b.target AND c.stop = b.stop AND c.sample = 'OUT'"""
    ),
)
def q_best(spark, sf):
    bars, cells = grid_cells(spark, sf)
    return rp.best_cell(rp.trade_stats(rp.in_out_sample(cells, bars), ["sample", "target", "stop"]), ["target", "stop"])


_EXC_SQL = SETUPS_SQL + outcomes_sql(start="entry_bar") + """, run0 AS (SELECT oc.signal_id,
      max(CASE WHEN is_long THEN b.high - entry ELSE entry - b.low END / abs(entry - sl)) AS run,
      max(CASE WHEN is_long THEN b.high - entry ELSE entry - b.low END / abs(entry - sl)) FILTER (b.bar_index <= entry_bar + 10) AS own_run
      FROM oc JOIN bars b ON b.symbol = oc.symbol AND b.bar_index > oc.entry_bar AND b.bar_index < coalesce(oc.sl_bar, 1000000000) GROUP BY 1),
    ex AS MATERIALIZED (SELECT oc.*, greatest(coalesce(run, 0), 0) AS run, greatest(coalesce(own_run, 0), 0) AS own_run FROM oc LEFT JOIN run0 USING (signal_id))"""


def excursions(spark, sf):
    bars, s = pa_signals(spark, sf)
    s = s.withColumn("unit", F.abs(F.col("entry") - F.col("sl")))
    return rp.excursion(s, bars, F.col("unit"), F.lit(10))


@query("r09_excursion", with_bars(_EXC_SQL + " SELECT signal_id, coalesce(sl_bar, -1) AS stop_bar, round(run, 8) AS run, round(own_run, 8) AS own_run FROM ex"))
def q_excursion(spark, sf):
    return excursions(spark, sf).select("signal_id", bar_or_none("stop_bar"), F.round("run", 8).alias("run"), F.round("own_run", 8).alias("own_run"))


@query(
    "r10_percentile_report",
    with_bars(
        _EXC_SQL
        + """, o AS (SELECT pattern, list_sort(list(round(run, 8))) AS v, count(*) AS n FROM ex GROUP BY pattern)
        SELECT pattern, n, """
        + ", ".join(f"v[CAST(floor({p / 100.0} * (n - 1) + 0.5) AS BIGINT) + 1] AS p{p}" for p in (10, 25, 50, 75, 90, 95))
        + " FROM o"
    ),
)
def q_percentiles(spark, sf):
    return rp.percentile_report(excursions(spark, sf).withColumn("run", F.round("run", 8)), "run", ["pattern"])


@query(
    "r11_edge_histogram",
    with_bars(
        _EXC_SQL
        + """, e AS (SELECT is_long, CASE WHEN round(run, 8) >= 3 THEN 3.0 WHEN round(run, 8) >= 2 THEN 2.0 WHEN round(run, 8) >= 1 THEN 1.0 WHEN round(run, 8) >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS edge,
          count(*) AS n FROM ex GROUP BY ALL)
        SELECT is_long, edge, n, round(n / sum(n) OVER (PARTITION BY is_long), 6) AS share,
          round(sum(n) OVER (PARTITION BY is_long ORDER BY edge DESC) / sum(n) OVER (PARTITION BY is_long), 6) AS at_least FROM e"""
    ),
)
def q_edges(spark, sf):
    return rp.edge_histogram(excursions(spark, sf).withColumn("run", F.round("run", 8)), "run", (0.5, 1.0, 2.0, 3.0), ["is_long"])


@query(
    "r12_target_table",
    with_bars(
        _EXC_SQL
        + """, t AS (SELECT unnest(['0.5', '1', '2']) AS target, unnest([0.5, 1, 2]::DOUBLE[]) AS lv),
        z AS (SELECT pattern, target, round(run, 8) >= lv AS hit, sl_bar, lv AS gain, entry * 0.0002::DOUBLE / abs(entry - sl) AS c FROM ex, t)
        SELECT pattern, target, count(*) AS tradable, count(*) FILTER (hit) AS reached,
          round(sum(CASE WHEN hit THEN gain - c WHEN sl_bar IS NOT NULL THEN -1 - c END), 6) AS net_r FROM z GROUP BY ALL"""
    ),
)
def q_targets(spark, sf):
    return rp.target_table(
        excursions(spark, sf).withColumn("run", F.round("run", 8)), (("0.5", 0.5), ("1", 1.0), ("2", 2.0)), ["pattern"]
    )


@query(
    "r17_conflict_bars",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + """ SELECT pattern, count(*) AS trades, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (outcome = 'OPEN') AS open_trades FROM oc GROUP BY pattern"""
    ),
)
def q_conflicts(spark, sf):
    _, o = pa_outcomes(spark, sf)
    return rp.conflict_bars(o, ["pattern"])


@query(
    "r21_validate_signals",
    with_bars(
        SETUPS_SQL
        + """, j AS (SELECT s.*, b.low AS lo, b.high AS hi FROM sig s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.entry_bar)
        SELECT signal_id, symbol, tf, 'LEVEL_SIDE' AS violation FROM j WHERE NOT CASE WHEN is_long THEN sl < entry AND entry < tp ELSE tp < entry AND entry < sl END
        UNION ALL SELECT signal_id, symbol, tf, 'ENTRY_OFF_BAR' FROM j WHERE NOT coalesce(entry BETWEEN lo - 1e-9 AND hi + 1e-9, false)
        UNION ALL SELECT signal_id, symbol, tf, 'REPEATED_ID' FROM sig GROUP BY ALL HAVING count(*) > 1"""
    ),
)
def q_validate(spark, sf):
    bars, s = pa_signals(spark, sf)
    return rp.validate_signals(s, bars)


@query(
    "g22_gate_funnel",
    with_bars(
        SETUPS_SQL
        + outcomes_sql()
        + """, g AS (SELECT symbol, tf, CASE WHEN NOT (entry_bar >= 20) THEN 'TOO_EARLY' WHEN NOT (abs(entry - sl) >= 100) THEN 'STOP_TOO_NEAR'
          WHEN NOT (outcome <> 'OPEN') THEN 'NOT_CLOSED' ELSE 'ENTERED' END AS gate FROM oc)
        SELECT symbol, tf, gate, count(*) AS n FROM g GROUP BY ROLLUP (symbol, tf, gate)"""
    ),
)
def q_funnel(spark, sf):
    _, o = pa_outcomes(spark, sf)
    gates = [
        ("TOO_EARLY", F.col("entry_bar") >= 20),
        ("STOP_TOO_NEAR", F.abs(F.col("entry") - F.col("sl")) >= 100),
        ("NOT_CLOSED", F.col("outcome") != "OPEN"),
    ]
    return rp.gate_funnel(o, gates)
