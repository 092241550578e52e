"""Result statistics, sweeps and checks over outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.operators.joins import first_hit, range_join
from barwave.operators.outcomes import slim
from barwave.operators.series import KEY, running_sum

COST_BPS = 2.0  # per round trip


def result_in_r(trades: DataFrame) -> DataFrame:
    """Signed result in units of the initial risk; open trades have none."""
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    risk = F.abs(F.col("entry") - F.col("sl"))
    return trades.withColumn("r", F.when(risk > 0, side * (F.col("exit_price") - F.col("entry")) / risk))


def weighted_r(parts: DataFrame) -> DataFrame:
    """One result per signal from parts closed at different prices, weighted by their share."""
    r = result_in_r(parts)
    return r.groupBy("signal_id").agg((F.sum(F.col("r") * F.col("share")) / F.sum("share")).alias("r"))


def cost_in_r() -> Column:
    return F.col("entry") * (COST_BPS / 10000.0) / F.abs(F.col("entry") - F.col("sl"))


def stats_columns() -> list[Column]:
    """Aggregates over trades that carry outcome, r, entry, sl, tp."""
    closed = F.col("outcome").isin("TP", "SL", "BE")
    win = F.col("outcome") == "TP"
    n = F.count(F.when(closed, 1))
    net = F.sum(F.when(closed, F.col("r") - cost_in_r()))
    return [
        F.count("*").alias("trades"),
        F.count(F.when(win, 1)).alias("tp_count"),
        F.count(F.when(F.col("outcome") == "SL", 1)).alias("sl_count"),
        F.count(F.when(F.col("outcome") == "OPEN", 1)).alias("open_count"),
        F.round(F.when(n > 0, F.count(F.when(win, 1)) / n), 6).alias("win_rate"),
        F.round(F.avg(F.when(closed, F.abs(F.col("tp") - F.col("entry")) / F.abs(F.col("entry") - F.col("sl")))), 6).alias("avg_rr"),
        F.round(F.sum(F.when(closed, F.col("r"))), 6).alias("total_r"),
        F.round(F.sum(F.when(closed, cost_in_r())), 6).alias("cost_r"),
        F.round(net, 6).alias("net_r"),
        F.round(net / n, 6).alias("expectancy"),
    ]


def trade_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    return result_in_r(trades).groupBy(*by).agg(*stats_columns())


def per_model_stats(trades: DataFrame, model: str = "pattern") -> DataFrame:
    """Per model and symbol, per model, per symbol and overall in one pass."""
    return result_in_r(trades).cube(model, "symbol").agg(*stats_columns())


def running_total(trades: DataFrame, order: str = "trade_seq") -> DataFrame:
    """Cumulative result and count per series in exit order; ``order`` is dense."""
    out = running_sum(trades, "r", "total_r", KEY, order)
    return out.withColumn("total_count", F.col(order) + 1)


def min_atr_thresholds(trades: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Stats of the trades whose stop distance is at least each multiple of ``atr``."""
    t = result_in_r(trades).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    kept = t.where(F.abs(F.col("entry") - F.col("sl")) >= F.col("threshold") * F.col("atr"))
    return kept.groupBy(*by, "threshold").agg(*stats_columns())


def in_out_sample(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """IN for entries in the first half of the series' bars, else OUT."""
    n = bars.groupBy(*KEY).agg((F.max("bar_index") + 1).alias("_n"))
    half = F.when(F.col("entry_bar") < F.floor(F.col("_n") / 2), "IN").otherwise("OUT")
    return trades.join(n, list(KEY)).withColumn("sample", half).drop("_n")


def target_stop_grid(trades: DataFrame, bars: DataFrame, targets: Column, stops: Column) -> DataFrame:
    """Every target x stop cell of every trade; the stop wins ties, levels on the wrong side are skipped.

    Each level is searched once: targets + stops first-touch searches per trade, then cells are
    combined inside one row of arrays, never by pairing rows.
    """
    levels = F.concat(
        F.transform(targets, lambda x: F.struct(F.lit("T").alias("kind"), x["name"].alias("name"), x["price"].alias("price"))),
        F.transform(stops, lambda x: F.struct(F.lit("S").alias("kind"), x["name"].alias("name"), x["price"].alias("price"))),
    )
    long = F.col("is_long")
    l = trades.select("signal_id", *KEY, "is_long", "entry_bar", "entry", F.explode(levels).alias("_l")).select(
        "signal_id", *KEY, "is_long", "entry_bar", "entry", "_l.*"
    )
    above = F.col("price") > F.col("entry")
    wants_above = long == (F.col("kind") == "T")
    l = l.where(F.when(wants_above, above).otherwise(F.col("price") < F.col("entry")))
    hit = F.when(wants_above, F.col("high") >= F.col("price")).otherwise(F.col("low") <= F.col("price"))
    found = first_hit(
        l, slim(bars), ["signal_id", *KEY, "kind", "name"], "entry_bar",
        [F.min(F.when(hit, F.col("bar_index"))).alias("hit_bar")], F.col("hit_bar").isNotNull(),
    )
    per_trade = found.groupBy("signal_id", *KEY).agg(
        F.first("is_long").alias("is_long"), F.first("entry_bar").alias("entry_bar"), F.first("entry").alias("entry"),
        F.collect_list(F.when(F.col("kind") == "T", F.struct("name", "price", "hit_bar"))).alias("_t"),
        F.collect_list(F.when(F.col("kind") == "S", F.struct("name", "price", "hit_bar"))).alias("_s"),
    )
    cells = per_trade.withColumn("_t", F.explode("_t")).withColumn("_s", F.explode("_s"))
    far = F.lit(2**62)
    t, s = F.coalesce("_t.hit_bar", far), F.coalesce("_s.hit_bar", far)
    kind = F.when((t == far) & (s == far), "OPEN").when(s <= t, "SL").otherwise("TP")
    return cells.select(
        "signal_id", *KEY, "is_long", "entry_bar", "entry",
        F.col("_t.name").alias("target"), F.col("_s.name").alias("stop"),
        F.col("_t.price").alias("tp"), F.col("_s.price").alias("sl"), kind.alias("outcome"),
        F.when(kind == "SL", F.col("_s.price")).when(kind == "TP", F.col("_t.price")).alias("exit_price"),
    )


def best_cell(cells: DataFrame, dims: Sequence[str], min_trades: int = 100) -> DataFrame:
    """The in-sample cell of the highest net R per trade, with its out-of-sample row."""
    dims = list(dims)
    ins = cells.where((F.col("sample") == "IN") & (F.col("trades") >= min_trades))
    best = ins.agg(F.max_by(F.struct(*dims, "trades", "expectancy"), F.struct("expectancy", *dims)).alias("_b")).select("_b.*")
    best = best.select(*dims, F.col("trades").alias("in_trades"), F.col("expectancy").alias("in_expectancy"))
    out = cells.where(F.col("sample") == "OUT").select(*dims, F.col("trades").alias("out_trades"), F.col("expectancy").alias("out_expectancy"))
    return best.join(out, dims, "left")


def excursion(trades: DataFrame, bars: DataFrame, unit: Column, own_bars: Column | None = None) -> DataFrame:
    """Best run in favour until the stop is touched (that bar excluded), in ``unit``s; also within ``own_bars`` bars."""
    long = F.col("is_long")
    stop_hit = F.when(long, F.col("low") <= F.col("sl")).otherwise(F.col("high") >= F.col("sl"))
    stopped = first_hit(
        trades, slim(bars), ["signal_id", *KEY], "entry_bar",
        [F.min(F.when(stop_hit, F.col("bar_index"))).alias("stop_bar")], F.col("stop_bar").isNotNull(),
    )
    last = bars.groupBy(*KEY).agg(F.max("bar_index").alias("_last"))
    span = stopped.join(last, list(KEY)).withColumn("_from", F.col("entry_bar") + 1)
    span = span.withColumn("_to", F.coalesce(F.col("stop_bar") - 1, F.col("_last")))
    run = F.when(long, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low"))
    near = F.lit(True) if own_bars is None else F.col("bar_index") <= F.col("entry_bar") + own_bars
    best = (
        range_join(span, slim(bars), "_from", "_to")
        .groupBy("signal_id", *KEY)
        .agg(F.max(run / unit).alias("_run"), F.max(F.when(near, run / unit)).alias("_own"))
    )
    zero = F.lit(0.0)
    out = stopped.join(best, ["signal_id", *KEY], "left")
    return out.withColumns(
        {
            "run": F.greatest(F.coalesce("_run", zero), zero),
            "own_run": F.greatest(F.coalesce("_own", zero), zero),
        }
    ).drop("_run", "_own")


def percentile_report(df: DataFrame, value: str, by: Sequence[str], percents=(10, 25, 50, 75, 90, 95)) -> DataFrame:
    """Nearest-rank percentiles, rank rounded half away from zero.

    Ranks come from counts per distinct value, so no group is gathered into an array.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*by)
    c = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(total))
    # zero-based rank round(p * (n - 1))
    rank = lambda p: F.floor(F.lit(p / 100.0) * (F.col("_n") - 1) + 0.5)
    return c.groupBy(*by).agg(
        F.max("_n").alias("n"), *[F.min(F.when(F.col("_hi") > rank(p), F.col(value))).alias(f"p{p}") for p in percents]
    )


def edge_histogram(df: DataFrame, value: str, edges: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Counts per edge bucket, their share and the share at or beyond the bucket's edge."""
    by = list(by)
    bucket = F.lit(0.0)
    for e in edges:
        bucket = F.when(F.col(value) >= e, F.lit(float(e))).otherwise(bucket)
    c = df.where(F.col(value).isNotNull()).groupBy(*by, bucket.alias("edge")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    beyond = F.sum("n").over(Window.partitionBy(*by).orderBy(F.col("edge").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return c.select(*by, "edge", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(beyond / total, 6).alias("at_least"))


def target_table(runs: DataFrame, targets: Sequence[tuple[str, float]], by: Sequence[str]) -> DataFrame:
    """Per target (in excursion units): trades that can hold it, trades that reached it, net R.

    ``runs`` carry run, unit (price per unit), entry, sl, stop_bar.
    """
    t = runs.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.lit(float(x)).alias("level")) for n, x in targets])))
    risk = F.abs(F.col("entry") - F.col("sl"))
    gain = F.col("_t.level") * F.col("unit") / risk
    hit = F.col("run") >= F.col("_t.level")
    cost = cost_in_r()
    net = F.when(hit, gain - cost).when(F.col("stop_bar").isNotNull(), F.lit(-1.0) - cost)
    return t.where(risk > 0).groupBy(*by, F.col("_t.target").alias("target")).agg(
        F.count("*").alias("tradable"), F.count(F.when(hit, 1)).alias("reached"), F.round(F.sum(net), 6).alias("net_r")
    )


def gate_funnel(rows: DataFrame, gates: Sequence[tuple[str, Column]], dims: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """Rows rejected by each gate (the first failed one counts) and rows that entered, with subtotals."""
    first = F.lit("ENTERED")
    for name, passes in reversed(gates):
        first = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(first)
    return rows.withColumn("gate", first).rollup(*dims, "gate").agg(F.count("*").alias("n"))


def conflict_bars(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trades whose deciding bar touched target and stop together, and trades still open."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("trades"),
        F.count(F.when(F.col("conflict"), 1)).alias("conflicts"),
        F.count(F.when(F.col("outcome") == "OPEN", 1)).alias("open_trades"),
    )


def validate_signals(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows that break an invariant: levels on the wrong side, entry outside its bar, repeated id."""
    long = F.col("is_long")
    sides = F.when(long, (F.col("sl") < F.col("entry")) & (F.col("entry") < F.col("tp"))).otherwise(
        (F.col("tp") < F.col("entry")) & (F.col("entry") < F.col("sl"))
    )
    eps = 1e-9
    b = bars.select(*KEY, F.col("bar_index").alias("entry_bar"), F.col("low").alias("_lo"), F.col("high").alias("_hi"))
    j = signals.join(b, [*KEY, "entry_bar"], "left")
    on_bar = (F.col("entry") >= F.col("_lo") - eps) & (F.col("entry") <= F.col("_hi") + eps)
    bad = F.concat(
        F.when(F.coalesce(sides, F.lit(False)), F.array()).otherwise(F.array(F.lit("LEVEL_SIDE"))),
        F.when(F.coalesce(on_bar, F.lit(False)), F.array()).otherwise(F.array(F.lit("ENTRY_OFF_BAR"))),
    ).cast("array<string>")
    row_level = j.select("signal_id", *KEY, F.explode(bad).alias("violation"))
    twice = signals.groupBy("signal_id", *KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return row_level.unionByName(twice.select("signal_id", *KEY, F.lit("REPEATED_ID").alias("violation")))
