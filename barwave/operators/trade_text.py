"""Trade messages: free text -> sides, prices, levels and actions.

Messages carry channel, id, date, reply_id, text and, where a market price matters, ``market``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.operators.joins import asof_join
from barwave.operators.outcomes import limit_activation, signal_outcomes

# fixed values: patterns of the message language
SIGNAL = r"(buy|sell)([^\n]*?(?:\n[^\d\n@\-_]*)?)(?:[@\-_]|\baround\b|\s+)\s*(\d+(?:[.,]\d{0,5})?)"
STRUCK = r'\{(\n|\s)*"type":(\n|\s)*"strikethrough",(\n|\s)*"text":(\n|\s)*"(.)*"(\n|\s)*\},'
STOP = r"(sl|stop\s?loss)\D*(\d{1,9}(?:[.,]\d{0,5})?)"
TAKE = r"(tp|take profit)(.*)[ \t_](\d+(?:[.,]\d{0,5})?)"
ACTIONS: tuple[tuple[int, str], ...] = (
    (512, r"(activated)"),
    (32, r"(running in profit|entry point|break\s*-?\s*even|to the entry|b\.e|move sl to entry|sl\s+move\s+to\s+(?:the\s+)?entry|(?:sl|stop.?loss)\s+move\s*(?:@|at)\s*entry|(?:move|bring)\s+(?:your\s+)?sl\s*(?:@|at)\s*entry|sl\s+shift\s+(?:at|@)\s+entry|running\s+profits?|secure\s+(?:some\s+|your\s+)?profits?|booked\s+(?:some|half)\s+profits?)"),
    (2048, r"\b(extra)\b"),
    (64, r"(tp\s*\d*\s*hit|target\s+hit|🎯)"),
    (128, r"(sl\s*(was\s*)?hit|stop\s*out)"),
    (1024, r"(delete|cancel|remove)"),
)
CLOSE, HOLD, LIMIT, PIPS = r"(close[d\s]|close$)", r"\bhold\b", r"(limit)", r"\+\d+\s*pips?\s+running"
GOLD = r"(gold|xauusd|one\s*more)"
BUY, SELL, SET_TP, SET_SL, DO_CLOSE, BREAK_EVEN, LIMIT_FLAG = 1, 2, 4, 8, 16, 32, 256
DEFAULT_PIPS, MAX_STOP = 1000.0, 0.20

# fixed values: classes of the sampling script, first match wins; replies first
CLASSES: tuple[tuple[str, str], ...] = (
    ("breakeven", r"(?i)(entry point|break\s*-?\s*even|move sl to entry|b\.e\b|to the entry|running in profit)"),
    ("tp_hit", r"(?i)(tp\s*\d*\s*hit|target\s*(hit|reached)|🎯)"),
    ("sl_hit", r"(?i)(sl\s*(was\s*)?hit|stop\s*out)"),
    ("close", r"(?i)(close[d\s]|close$)"),
    ("signal", r"(?i)(buy|sell)\s*(now|market)?\s*[@\-\|:]\s*\d{3,5}"),
)


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), STRUCK, "")


def to_price(text: Column) -> Column:
    """Thousands separators are dropped."""
    return F.regexp_replace(F.when(text != "", text), ",", "").cast("double")


def parse_messages(messages: DataFrame, pip: float = 0.01, symbol: str = GOLD, pips_running: bool = False) -> DataFrame:
    """Side, entry, stop, targets and the action bit mask of every message."""
    m = messages.withColumn("_t", clean_text(F.col("text")))
    t = F.col("_t")
    m = m.withColumns(
        {
            "has_signal": t.rlike(SIGNAL),
            "has_symbol": t.rlike(symbol),
            "is_long": F.regexp_extract(t, SIGNAL, 1) == "buy",
            "_p": to_price(F.regexp_extract(t, SIGNAL, 3)),
            "_sl": to_price(F.regexp_extract(t, STOP, 2)),
            "_tp": F.transform(F.regexp_extract_all(t, F.lit(TAKE), F.lit(3)), to_price),
        }
    )
    enter = F.col("has_signal") & F.col("has_symbol")
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    price = F.when(enter, F.coalesce("_p", F.col("market")))
    base = F.coalesce(price, F.col("market"))
    default_sl = base - side * pip * DEFAULT_PIPS
    explicit = F.col("_sl").isNotNull() & (default_sl > 0) & (F.abs(F.col("_sl") - default_sl) / default_sl < MAX_STOP)
    implied = F.col("_sl").isNull() & F.col("has_signal") & (F.abs(F.col("market") - default_sl) / F.col("market") < MAX_STOP)
    bit = lambda cond, flag: F.when(F.coalesce(cond, F.lit(False)), F.lit(flag)).otherwise(0)
    flags = bit(enter & F.col("is_long"), BUY) + bit(enter & ~F.col("is_long"), SELL)
    flags = flags + bit(enter & F.col("_p").isNotNull() & t.rlike(LIMIT), LIMIT_FLAG)
    flags = flags + bit(F.col("_sl").isNotNull() | implied, SET_SL) + bit(F.size("_tp") > 0, SET_TP)
    flags = flags + bit(t.rlike(CLOSE) & ~t.rlike(HOLD), DO_CLOSE)
    for flag, pattern in ACTIONS:
        hit = t.rlike(pattern)
        if flag == BREAK_EVEN and pips_running:
            hit = hit | t.rlike(PIPS)
        flags = flags + bit(hit, flag)
    # a signal for another symbol says nothing else
    other = F.col("has_signal") & ~F.col("has_symbol")
    return m.withColumns(
        {
            "price": price,
            "sl": F.when(other, None).when(explicit, F.col("_sl")).otherwise(default_sl),
            "has_explicit_sl": F.coalesce(explicit & ~other, F.lit(False)),
            "tps": F.when(other, F.array().cast("array<double>")).otherwise(F.col("_tp")),
            "flags": F.when(other, 0).otherwise(flags),
        }
    ).drop("_t", "_p", "_sl", "_tp")


def select_tp(tps: Column, entry: Column, n: int = 1) -> Column:
    """The n-th target by distance from the entry, or the farthest one."""
    near = F.array_sort(F.transform(tps, lambda p: F.struct(F.abs(p - entry).alias("gap"), p.alias("p"))))
    return F.when(F.size(near) > 0, F.element_at(near, F.least(F.lit(n), F.size(near)))["p"])


def opened_signals(parsed: DataFrame, n: int = 1, pip: float = 0.01) -> DataFrame:
    """Messages that open a setup: a side, an explicit stop and no limit keyword."""
    enters = (F.col("flags").bitwiseAND(BUY | SELL) != 0) & F.col("has_explicit_sl") & (F.col("flags").bitwiseAND(LIMIT_FLAG) == 0)
    side = F.when(F.col("is_long"), 1.0).otherwise(-1.0)
    tp = F.coalesce(select_tp(F.col("tps"), F.col("price"), n), F.col("price") + side * pip * DEFAULT_PIPS)
    return parsed.where(enters).withColumns({"tp": tp, "entry": F.col("price")})


def resolve_reply(parsed: DataFrame, opened: DataFrame) -> DataFrame:
    """The message a reply acts on: its reply id, else the signal opened last before it."""
    last = opened.select("channel", F.col("date").alias("_d"), F.col("id").alias("last_opened"))
    j = asof_join(parsed, last, ["channel"], "date", ["last_opened"], strict=True, right_on="_d")
    return j.withColumn("ref_id", F.coalesce("reply_id", "last_opened")).drop("asof_time")


def message_order_type(opened: DataFrame, bars: DataFrame) -> DataFrame:
    """Limit when the price at the message is worse than the entry it names."""
    quotes = bars.select(F.col("symbol").alias("channel"), "open_time", F.col("close").alias("quote"))
    j = asof_join(opened, quotes, ["channel"], "date", ["quote"], right_on="open_time")
    worse = F.when(F.col("is_long"), F.col("quote") > F.col("entry")).otherwise(F.col("quote") < F.col("entry"))
    return j.withColumn("is_limit", F.coalesce(worse, F.lit(False))).drop("asof_time")


def messages_to_bars(messages: DataFrame, bars: DataFrame) -> DataFrame:
    """Bar that handles a message: the first one opening at or after it."""
    b = bars.select(F.col("symbol").alias("channel"), "tf", "open_time", "bar_index")
    return asof_join(messages, b, ["channel"], "date", ["tf", "bar_index"], direction="forward", right_on="open_time")


def due_messages(messages: DataFrame, ticks: DataFrame, stale_seconds: int = 10) -> DataFrame:
    """Messages met by the next tick unless that tick comes too late."""
    t = ticks.select(F.col("symbol").alias("channel"), F.col("ts").alias("tick_time"))
    j = asof_join(messages, t.withColumn("_x", F.col("tick_time")), ["channel"], "date", ["_x"], direction="forward", tolerance_seconds=stale_seconds, right_on="tick_time")
    return j.where(F.col("asof_time").isNotNull()).withColumnRenamed("asof_time", "tick_time").drop("_x")


def apply_actions(resolved: DataFrame, opened: DataFrame) -> DataFrame:
    """First closing action on every opened signal, and whether its stop was moved to the entry before it."""
    rank = (
        F.when(F.col("flags").bitwiseAND(32) != 0, "BREAK_EVEN").when(F.col("flags").bitwiseAND(64) != 0, "TP")
        .when(F.col("flags").bitwiseAND(128) != 0, "SL").when(F.col("flags").bitwiseAND(12) != 0, "EDIT")
        .when(F.col("flags").bitwiseAND(16) != 0, "CLOSE")
    )
    opens = opened.select("channel", F.col("id").alias("signal_id"), F.col("date").alias("opened_at"))
    acts = resolved.withColumn("action", rank).where(F.col("action").isNotNull())
    acts = acts.select("channel", F.col("ref_id").alias("signal_id"), F.col("id").alias("_mid"), F.col("date").alias("_at"), "action")
    j = opens.join(acts, ["channel", "signal_id"]).where((F.col("_at") > F.col("opened_at")) & (F.col("_mid") != F.col("signal_id")))
    ends = F.col("action").isin("TP", "SL", "CLOSE")
    at = F.struct("_at", "_mid")
    g = j.groupBy("channel", "signal_id").agg(
        F.min(F.when(ends, F.struct("_at", "_mid", "action"))).alias("_e"),
        F.min(F.when(F.col("action") == "BREAK_EVEN", at)).alias("_b"),
        F.count(F.when(F.col("action") == "EDIT", 1)).alias("edits"),
    )
    moved = F.col("_b").isNotNull() & (F.col("_e").isNull() | (F.col("_b._at") < F.col("_e._at")))
    return g.select("channel", "signal_id", F.col("_e.action").alias("closed_by"), F.col("_e._at").alias("closed_at"), moved.alias("moved_to_entry"), "edits")


def message_outcomes(opened: DataFrame, bars: DataFrame) -> DataFrame:
    """Strict bar check of message setups: target first, then stop; bars after the message's bar."""
    at = messages_to_bars(opened, bars).where(F.col("bar_index").isNotNull())
    s = at.select(
        F.col("id").cast("string").alias("signal_id"), F.col("channel").alias("symbol"), "tf", "is_long", F.col("bar_index").alias("entry_bar"), "entry", "tp", "sl"
    )
    return signal_outcomes(s, bars, "tp_first", strict=True)


def classify_messages(messages: DataFrame) -> DataFrame:
    kind = F.lit("other")
    for name, pattern in reversed(CLASSES):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    return messages.withColumn("category", F.concat(F.when(F.col("reply_id").isNotNull(), "reply_").otherwise(""), kind))
