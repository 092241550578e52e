"""What became of a signal: first-touch joins with growing look-ahead.

Signals carry: signal_id, symbol, tf, is_long, entry_bar, entry, tp, sl.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.operators.joins import first_hit
from barwave.operators.series import KEY, Fold, fold_series, running_sum

ID = ["signal_id", *KEY]


def _first(cond: Column, name: str) -> Column:
    return F.min(F.when(cond, F.col("bar_index"))).alias(name)


def touches(level: Column, is_long: Column, strict: bool = False) -> Column:
    """Price has reached a level above (long) or below (short)."""
    up = F.col("high") > level if strict else F.col("high") >= level
    down = F.col("low") < level if strict else F.col("low") <= level
    return F.when(is_long, up).otherwise(down)


def stops(level: Column, is_long: Column, strict: bool = False) -> Column:
    return touches(level, ~is_long, strict)


def slim(bars: DataFrame) -> DataFrame:
    return bars.select(*KEY, "bar_index", "high", "low")


def signal_outcomes(
    signals: DataFrame, bars: DataFrame, policy: str = "sl_first", strict: bool = False, start: str = "entry_bar"
) -> DataFrame:
    """Adds outcome (TP, SL, OPEN), exit_bar and exit_price; bars after ``start`` are examined."""
    long = F.col("is_long")
    aggs = [_first(stops(F.col("sl"), long, strict), "sl_bar"), _first(touches(F.col("tp"), long, strict), "tp_bar")]
    hit = first_hit(signals, slim(bars), ID, start, aggs, F.col("sl_bar").isNotNull() | F.col("tp_bar").isNotNull())
    s, t = F.col("sl_bar"), F.col("tp_bar")
    far = F.lit(2**62)
    stop_wins = F.coalesce(s, far) <= F.coalesce(t, far) if policy == "sl_first" else F.coalesce(s, far) < F.coalesce(t, far)
    kind = F.when(s.isNull() & t.isNull(), "OPEN").when(stop_wins, "SL").otherwise("TP")
    return (
        hit.withColumn("outcome", kind)
        .withColumn("exit_bar", F.when(kind == "SL", s).when(kind == "TP", t))
        .withColumn("exit_price", F.when(kind == "SL", F.col("sl")).when(kind == "TP", F.col("tp")))
        .withColumn("conflict", F.coalesce(s == t, F.lit(False)))
        .drop("sl_bar", "tp_bar")
    )


def limit_activation(signals: DataFrame, bars: DataFrame, strict: bool = False) -> DataFrame:
    """Pending orders: ACTIVE at the bar the level is touched unless TP or SL came first (CANCELED), else PENDING."""
    long = F.col("is_long")
    aggs = [
        _first(stops(F.col("entry"), long), "act_bar"),
        _first(stops(F.col("sl"), long, strict) | touches(F.col("tp"), long, strict), "off_bar"),
    ]
    hit = first_hit(signals, slim(bars), ID, "entry_bar", aggs, F.col("act_bar").isNotNull() | F.col("off_bar").isNotNull())
    a, o, far = F.col("act_bar"), F.col("off_bar"), F.lit(2**62)
    state = (
        F.when(a.isNull() & o.isNull(), "PENDING").when(F.coalesce(o, far) < F.coalesce(a, far), "CANCELED").otherwise("ACTIVE")
    )
    return hit.withColumn("state", state).withColumn("active_bar", F.when(state == "ACTIVE", a)).drop("act_bar", "off_bar")


def break_even_outcomes(
    signals: DataFrame, bars: DataFrame, to_entry: bool = False, policy: str = "sl_first"
) -> DataFrame:
    """As ``signal_outcomes`` but the stop moves once, when ``break_even`` is touched, from the next bar on.

    The stop goes to the break-even price, or to the entry; leaving there gives outcome BE.
    """
    long = F.col("is_long")
    aggs = [
        _first(stops(F.col("sl"), long), "sl_bar"),
        _first(touches(F.col("tp"), long), "tp_bar"),
        _first(touches(F.col("break_even"), long), "be_bar"),
    ]
    any_hit = F.col("sl_bar").isNotNull() | F.col("tp_bar").isNotNull() | F.col("be_bar").isNotNull()
    one = first_hit(signals, slim(bars), ID, "entry_bar", aggs, any_hit)
    far = F.lit(2**62)
    exit_bar = F.least(F.coalesce("sl_bar", far), F.coalesce("tp_bar", far))
    moved = F.coalesce("be_bar", far) < exit_bar
    wanted = [c for c in signals.columns]
    still = one.where(~moved)
    s, t = F.coalesce("sl_bar", far), F.coalesce("tp_bar", far)
    stop_wins = (s <= t) if policy == "sl_first" else (s < t)
    kind = F.when((s == far) & (t == far), "OPEN").when(stop_wins, "SL").otherwise("TP")
    still = still.select(
        *wanted, kind.alias("outcome"), F.when(kind == "SL", s).when(kind == "TP", t).alias("exit_bar"),
        F.when(kind == "SL", F.col("sl")).when(kind == "TP", F.col("tp")).alias("exit_price"),
    )
    new_stop = F.col("entry") if to_entry else F.col("break_even")
    late = one.where(moved).select(*wanted, "be_bar").withColumn("_sl0", F.col("sl")).withColumn("sl", new_stop)
    late = signal_outcomes(late, bars, policy, start="be_bar")
    late = late.withColumn("outcome", F.when(F.col("outcome") == "SL", "BE").otherwise(F.col("outcome"))).withColumn("sl", F.col("_sl0"))
    return still.unionByName(late.select(*wanted, "outcome", "exit_bar", "exit_price"))


def one_open_fold() -> Fold:
    """Greedy choice in entry order: a signal is taken only if the last taken one has already ended."""

    def step(state, _i, entry_bar, exit_bar):
        (busy_until,) = state
        if busy_until is not None and entry_bar <= busy_until:
            return state, (False,)
        return (2**62 if exit_bar is None or exit_bar != exit_bar else int(exit_bar),), (True,)

    return Fold(("entry_bar", "exit_bar"), "busy_until long", "taken boolean", (None,), step, warmup=256)


def one_open_setup(signals: DataFrame) -> DataFrame:
    """Signals that a finder able to hold one setup at a time would have taken."""
    ranked = signals.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "entry_bar").orderBy("signal_id")))
    # only the first signal of a bar can be taken: a taken one occupies its own bar
    first = ranked.where(F.col("_n") == 1).drop("_n")
    taken, _ = fold_series(first, one_open_fold(), KEY, "entry_bar")
    return first.join(taken.where("taken").select(*KEY, "entry_bar"), [*KEY, "entry_bar"])


def cross_tf_duplicates(signals: DataFrame) -> DataFrame:
    """Drop a signal while an earlier one with the same SL and TP is open on another frame of the symbol.

    The pairing is an equi-join on (symbol, sl, tp); signals that share all three are copies of one setup.
    """
    other = signals.select(
        "symbol", "sl", "tp", F.col("tf").alias("_tf"), F.col("entry_time").alias("_from"),
        F.coalesce("exit_time", F.lit("9999-12-31").cast("timestamp_ntz")).alias("_to"),
    )
    s = signals.alias("s")
    o = other.alias("o")
    cond = (
        (F.col("s.symbol") == F.col("o.symbol")) & (F.col("s.sl") == F.col("o.sl")) & (F.col("s.tp") == F.col("o.tp"))
        & (F.col("s.tf") != F.col("o._tf")) & (F.col("o._from") < F.col("s.entry_time")) & (F.col("s.entry_time") <= F.col("o._to"))
    )
    return s.join(o, cond, "left_anti")


def split_by_break_even(signals: DataFrame) -> DataFrame:
    """Two half positions: one to the take-profit, one to the break-even price."""
    halves = F.array(
        F.struct(F.lit("TP").alias("part"), F.col("tp").alias("target")),
        F.struct(F.lit("BE").alias("part"), F.col("break_even").alias("target")),
    )
    rows = signals.withColumn("_p", F.explode(halves))
    return rows.select(*signals.columns, "_p.part", "_p.target", (F.col("volume") / 2).alias("half_volume"))


def progressive_risk_fold(unit: float, top: float) -> Fold:
    def step(state, _i, outcome):
        (risk,) = state
        used = risk
        if outcome == "SL":
            risk = top if risk >= top else risk + unit
        elif outcome == "TP":
            risk = unit if risk <= unit else risk - unit
        return (risk,), (used,)

    return Fold(("outcome",), "risk double", "risk double", (unit,), step, warmup=256)


def progressive_risk(outcomes: DataFrame, unit: float = 1.0, top: float = 5.0) -> DataFrame:
    """Risk percent in force for every closed signal, in exit order: up a unit after a stop, down after a target."""
    closed = outcomes.where(F.col("outcome").isin("TP", "SL"))
    # many signals may end on one bar: number the bars by running count, then rank inside the bar
    per_bar = closed.groupBy(*KEY, "exit_bar").agg(F.count("*").alias("_n"))
    upto = running_sum(per_bar, "_n", "_upto", KEY, "exit_bar").withColumn("_base", F.col("_upto") - F.col("_n"))
    inside = Window.partitionBy(*KEY, "exit_bar").orderBy("entry_bar", "signal_id")
    seq = closed.join(upto.select(*KEY, "exit_bar", "_base"), [*KEY, "exit_bar"])
    seq = seq.withColumn("trade_seq", F.col("_base") + F.row_number().over(inside) - 1).drop("_base")
    risk, _ = fold_series(seq, progressive_risk_fold(unit, top), KEY, "trade_seq")
    return seq.join(risk, [*KEY, "trade_seq"])
