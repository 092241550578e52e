"""Setup finders and parameter sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwave.operators import candles as cd
from barwave.operators import gartley as gt
from barwave.operators import harmonic as hm
from barwave.operators import outcomes as oc
from barwave.operators import pivots as pv
from barwave.operators import reports as rp
from barwave.operators import wave_setups as ws
from barwave.plans.gartleys import figures
from barwave.plans.movements import BASE
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.session import cut
from barwave.sources import exports
from barwave.sources.ticks import bar_table

SIG = ("signal_id", "symbol", "tf", "is_long", "entry_bar")
r4 = lambda df, *cols: df.withColumns({c: F.round(c, 4) for c in cols})


@query("g01_impulse_setups")
def q_impulse(spark, sf):
    s = ws.impulse_setups(bar_table(spark, sf))
    return r4(s.select(*SIG, "entry", "tp", "sl", "is_limit"), "entry", "tp", "sl")


@query(
    "g02_impulse_levels",
    with_bars(
        BASE
        + """, e AS (SELECT symbol, tf, seq, is_up, start_value, length, end_value - CASE WHEN is_up THEN 1 ELSE -1 END * length * 0.35::DOUBLE AS entry FROM legs),
        k AS (SELECT *, CASE WHEN is_up THEN floor((start_value - abs(entry - start_value) * 0.02::DOUBLE) * 100) / 100 ELSE ceil((start_value + abs(entry - start_value) * 0.02::DOUBLE) * 100) / 100 END AS sl,
          CASE WHEN is_up THEN floor((start_value + length * 1.6::DOUBLE) * 100) / 100 ELSE ceil((start_value - length * 1.6::DOUBLE) * 100) / 100 END AS tp FROM e)
        SELECT symbol, tf, seq, round(entry, 4) AS entry, round(tp, 4) AS tp, round(sl, 4) AS sl FROM k WHERE CASE WHEN is_up THEN entry < tp AND entry > sl ELSE entry > tp AND entry < sl END""",
        recursive=True,
    ),
)
def q_levels(spark, sf):
    legs = pv.segments(pv.zigzag_pct(bar_table(spark, sf), 0.5))
    e = legs.withColumn("entry", F.col("end_value") - F.when(F.col("is_up"), 1).otherwise(-1) * F.col("length") * F.lit(0.35))
    return r4(ws.impulse_levels(e, 1.6, 2).select("symbol", "tf", "seq", "entry", "tp", "sl"), "entry", "tp", "sl")


def skeletons(bars):
    return ws.diagonal_skeletons(pv.zigzag_bps(bars, 20))


@query("g06_diagonal_skeletons")
def q_skeletons(spark, sf):
    return skeletons(bar_table(spark, sf)).select("symbol", "tf", "is_up", "b0", "b1", "b2", "b3", "b4")


@query("g07_diagonal_filters")
def q_filters(spark, sf):
    bars = bar_table(spark, sf)
    return ws.diagonal_filters(cut(skeletons(bars)), bars).groupBy("symbol", "tf", "gate").agg(F.count("*").alias("n"))


def registered(bars):
    return cut(ws.diagonal_filters(cut(skeletons(bars)), bars).where("gate = 'REGISTERED'"))


@query("g08_diagonal_wave5")
def q_wave5(spark, sf):
    bars = bar_table(spark, sf)
    return ws.diagonal_wave5(registered(bars), bars).select(*ws.SKEL, "fire_bar", "gate")


@query("g09_diagonal_levels")
def q_diag(spark, sf):
    bars = bar_table(spark, sf)
    return r4(ws.diagonal_levels(ws.diagonal_wave5(registered(bars), bars), bars).select(*SIG, "entry", "tp", "sl"), "tp", "sl")


@query("g10_gartley_setups")
def q_gartley(spark, sf):
    piv, f = figures(spark, sf)
    bars = bar_table(spark, sf)
    s = ws.gartley_setups(gt.gartley_items(cut(f), piv), bars)
    return r4(s.select(*SIG, "entry", "tp", "sl", "accuracy", "rsi"), "tp", "sl")


def harmonic_signals(spark, sf, min_atr=1.0):
    bars = bar_table(spark, sf)
    return bars, cut(ws.harmonic_setups(cut(hm.harmonic_items(bars)), bars, min_atr=min_atr))


@query("g11_harmonic_setups")
def q_harmonic(spark, sf):
    _, s = harmonic_signals(spark, sf)
    return r4(s.select(*SIG, "entry", "tp", "sl", "risk_reward"), "tp", "sl", "risk_reward")


@query("g13_rate_setups")
def q_rate(spark, sf):
    r = ws.rate_setups(bar_table(spark, sf))
    return r4(r.select("symbol", "tf", "is_long", "entry_bar", "entry", "tp", "sl", "exit_bar", "exit_price", "outcome"), "tp")


@query("g17_retrace_management")
def q_retrace(spark, sf):
    bars = bar_table(spark, sf)
    s = cut(ws.diagonal_levels(ws.diagonal_wave5(registered(bars), bars), bars))
    parts = [ws.retrace_management(s, bars, a).select("signal_id", "symbol", "tf", F.lit(a).alias("action"), "share", "outcome", F.round("exit_price", 4).alias("exit_price")) for a in ("BREAKEVEN", "HALF", "HALF_BREAKEVEN", "CLOSE")]
    return reduce(DataFrame.unionByName, parts)


@query("s12_write_gartley_report")
def q_report(spark, sf):
    from barwave.plans.sources import scratch

    piv, f = figures(spark, sf)
    bars = bar_table(spark, sf)
    items = ws.gartley_setups(gt.gartley_items(cut(f), piv), bars)
    done = oc.signal_outcomes(items.drop("close"), bars, "tp_first").withColumn("won", F.col("outcome") == "TP")
    times = bars.select("symbol", "tf", F.col("bar_index").alias("d_bar"), F.col("open_time").alias("d_time"))
    path = scratch(spark, "gartley")
    exports.write_report(exports.gartley_report_lines(done.join(times, ["symbol", "tf", "d_bar"])), path)
    return spark.read.text(path)


@query("s13_write_harmonic_report")
def q_harmonic_report(spark, sf):
    from barwave.plans.sources import scratch

    bars, s = harmonic_signals(spark, sf)
    done = oc.signal_outcomes(s, bars).withColumn("won", F.col("outcome") == "TP")
    times = bars.select("symbol", "tf", F.col("bar_index").alias("d_bar"), F.col("open_time").alias("d_time"))
    path = scratch(spark, "harmonic")
    exports.write_report(exports.harmonic_report_lines(done.join(times, ["symbol", "tf", "d_bar"])), path)
    return spark.read.text(path)


@query("s15_markup_json")
def q_markup(spark, sf):
    """Two-level trees: every standing three-wave candidate with its legs."""
    from barwave.operators import waves as wv

    bars = bar_table(spark, sf)
    c = wv.flat_candidates(pv.zigzag_pct(bars, 0.5), 3).where("reason IS NULL AND model <> 'FLAT_RUNNING'")
    c = c.withColumn("root", F.concat_ws("-", "seq", "model"))
    c = c.withColumn("score", wv.structural_score(wv.THREE))
    node = lambda i, j, pos, model, score, parent: F.struct(
        F.concat_ws(".", "root", F.lit(str(pos))).alias("node_id"), parent.alias("parent_id"), F.lit(0 if pos else 1).alias("level"), F.lit(pos).alias("wave_pos"),
        F.lit("abc"[pos - 1] if pos else None).cast("string").alias("wave_name"), model.alias("model"), score.alias("score"), (F.col(f"p{j}") > F.col(f"p{i}")).alias("is_up"),
        F.col(f"b{i}").alias("start_bar"), F.col(f"p{i}").alias("start_value"), F.col(f"b{j}").alias("end_bar"), F.col(f"p{j}").alias("end_value"),
    )
    top = F.concat_ws(".", "root", F.lit("0"))
    rows = [node(0, 3, 0, F.col("model"), F.col("score"), F.lit(None).cast("string"))]
    rows += [node(i - 1, i, i, F.lit("SIMPLE_IMPULSE"), F.lit(0.25), top) for i in (1, 2, 3)]
    n = c.select("symbol", "tf", F.explode(F.array(*rows)).alias("_n")).select("symbol", "tf", "_n.*")
    at = lambda p: bars.select("symbol", "tf", F.col("bar_index").alias(f"{p}_bar"), F.col("open_time").alias(f"{p}_time"))
    n = n.join(at("start"), ["symbol", "tf", "start_bar"]).join(at("end"), ["symbol", "tf", "end_bar"])
    return exports.markup_json(n, levels=1)


# ---- sweeps ----


@query("r13_search_sweep")
def q_search(spark, sf):
    """Stats per ratio tolerance and ATR threshold, on one search of the bars."""
    bars = bar_table(spark, sf)
    xabc = cut(hm.find_xabc(bars))
    parts = []
    for name, atr in (("base", 0.0), ("strict", 1.0)):
        items = hm.harmonic_items(bars, xabc)
        s = ws.harmonic_setups(items, bars, min_atr=atr, min_score=0.0 if name == "base" else 0.85)
        parts.append(s.withColumn("variant", F.lit(name)).withColumn("signal_id", F.concat_ws("|", "signal_id", "variant")))
    s = cut(reduce(DataFrame.unionByName, parts))
    return rp.min_atr_thresholds(oc.signal_outcomes(s, bars), (0, 2, 4), ["variant"])


@query("r14_period_sweep")
def q_periods(spark, sf):
    """Setups per zigzag period and the period with most of them, per series."""
    bars = bar_table(spark, sf)
    parts = [ws.impulse_setups(bars, p).groupBy("symbol", "tf").agg(F.count("*").alias("setups")).withColumn("period", F.lit(p)) for p in (20, 40, 80)]
    n = cut(reduce(DataFrame.unionByName, parts))
    best = n.groupBy("symbol", "tf").agg(F.max_by("period", F.struct("setups", -F.col("period"))).alias("best_period"))
    return n.join(best, ["symbol", "tf"])


@query("r15_mode_sweep")
def q_modes(spark, sf):
    """Diagonal options x risk-reward on one set of fired candidates."""
    bars = bar_table(spark, sf)
    base = cut(ws.diagonal_filters(cut(skeletons(bars)), bars))
    parts = []
    for name, gates in (("wedge", ("REGISTERED",)), ("open", ("REGISTERED", "SPILLS_OUT", "NOT_CONTAINED"))):
        fired = cut(ws.diagonal_wave5(base.where(F.col("gate").isin(*gates)), bars))
        for rr in (1.0, 1.5, 2.0):
            s = ws.diagonal_levels(fired, bars, rr)
            parts.append(s.withColumns({"mode": F.lit(name), "rr": F.lit(rr)}).withColumn("signal_id", F.concat_ws("|", "signal_id", "mode", "rr")))
    s = cut(reduce(DataFrame.unionByName, parts))
    return rp.trade_stats(oc.signal_outcomes(s, bars, "tp_first"), ["mode", "rr"])
