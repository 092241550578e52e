"""Stream queries: each runs to the end of the given tables and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators.indicators import rsi_fold, supertrend_fold
from barwave.operators.indicators import atr
from barwave.operators.pivots import zigzag_fold
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.plans.sources import scratch
from barwave.plans.windows import q_rsi
from barwave.plans.registry import ORACLES
from barwave.sources.ticks import bar_table
from barwave.streaming import live

BARS = "symbol STRING, tf STRING, bar_index LONG, open_time TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def landed(spark, stream, mode: str = "append"):
    """Run a stream over what is there and read its sink."""
    out, ck = scratch(spark, "sink"), scratch(spark, "ck")
    live.append_closed_bars(stream, out, ck).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def bar_files(spark, sf) -> str:
    """The bar table as files in time order, so that a stream sees it in several batches."""
    path = scratch(spark, "barfiles")
    b = bar_table(spark, sf)
    for lo, hi in ((0, 250), (250, 500), (500, None)):
        part = b.where(F.col("bar_index") >= lo) if hi is None else b.where((F.col("bar_index") >= lo) & (F.col("bar_index") < hi))
        # a key lies in one file of a slice, and slices are written in time order
        part.repartition(4, "symbol", "tf").write.mode("append").parquet(path)
    return path


@query(
    "x02_tumbling_bars",
    """WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
    SELECT symbol, 'h1' AS tf, open_time, open, high, low, close, volume FROM b
    WHERE open_time + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
)
def q_tumbling(spark, sf):
    out = landed(spark, live.tumbling_bars(live.tick_stream(spark, sf), "h1"))
    return out.withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


@query("s08_append_closed_bars", with_bars("SELECT symbol, tf, bar_index, open_time, close FROM bars"))
def q_append(spark, sf):
    return landed(spark, live.bar_stream(spark, bar_files(spark, sf), BARS, 1)).select("symbol", "tf", "bar_index", "open_time", "close")


@query("x01_x03_late_bar_drop", with_bars("SELECT symbol, tf, bar_index, close FROM bars"))
def q_late(spark, sf):
    path = bar_files(spark, sf)
    b = live.bar_stream(spark, path, BARS).withColumn("open_time", F.col("open_time").cast("timestamp"))
    twice = b.unionByName(b)
    return landed(spark, live.late_bar_drop(twice)).select("symbol", "tf", "bar_index", "close")


@query("x04_rsi_state", ORACLES["w06_rsi"])
def q_rsi_stream(spark, sf):
    return landed(spark, live.fold_stream(live.bar_stream(spark, bar_files(spark, sf), BARS, 1), rsi_fold(14))).select("symbol", "tf", "bar_index", "rsi")


@query("x04_zigzag_state", ORACLES["z03_zigzag_pct"].rsplit("SELECT * FROM zz", 1)[0] + "SELECT symbol, tf, bar_index, value, is_high FROM zz WHERE NOT is_last")
def q_zigzag_stream(spark, sf):
    b = live.bar_stream(spark, bar_files(spark, sf), BARS, 1).withColumn("dev", F.lit(0.5))
    out = landed(spark, live.fold_stream(b, zigzag_fold()))
    return out.select("symbol", "tf", F.col("pivot_bar").alias("bar_index"), "value", "is_high")


def _signals(bars):
    """Every 24th bar opens a long from its close, half of them as limit orders 100 lower."""
    limit = F.col("bar_index") % 48 == 0
    level = F.when(limit, F.col("close") - 100).otherwise(F.col("close"))
    return bars.where("bar_index % 24 = 0").select(
        "symbol", F.col("open_time").cast("timestamp").alias("ts"), F.concat_ws("|", "symbol", "bar_index").alias("signal_id"),
        F.lit(True).alias("is_long"), level.alias("level"), (level + 150).alias("tp"), (level - 150).alias("sl"), limit.alias("is_limit"),
    )


@query("x05_x07_tick_triggers")
def q_triggers(spark, sf):
    path = bar_files(spark, sf)
    b = live.bar_stream(spark, path, BARS)
    ticks = b.select("symbol", (F.col("open_time") + F.expr("INTERVAL 59 MINUTES")).cast("timestamp").alias("ts"), F.col("close").alias("bid"), (F.col("close") + 1).alias("ask"))
    return landed(spark, live.tick_triggers(_signals(b), ticks)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "x08_message_stream",
    """SELECT m.event_id AS message_id, t.event_id AS tick_id FROM events m JOIN events t ON t.event_type = m.event_type AND t.ts >= date_trunc('second', m.ts)
    AND t.ts <= date_trunc('second', m.ts) + INTERVAL 10 SECOND WHERE m.event_id % 3 = 0""",
)
def q_message_stream(spark, sf):
    t = live.tick_stream(spark, sf)
    m = live.tick_stream(spark, sf).where("event_id % 3 = 0").select(
        F.col("symbol").alias("channel"), F.date_trunc("second", "ts").alias("date"), F.col("event_id").alias("message_id")
    )
    return landed(spark, live.message_stream(m, t).select("message_id", "tick_id"))


@query("x09_signal_sink", with_bars("SELECT symbol || '|' || bar_index AS signal_id, close AS level FROM bars WHERE bar_index % 24 = 0"))
def q_sink(spark, sf):
    out, ck = scratch(spark, "signals"), scratch(spark, "ck")
    b = live.bar_stream(spark, bar_files(spark, sf), BARS, 1)
    s = b.where("bar_index % 24 = 0").select(F.concat_ws("|", "symbol", "bar_index").alias("signal_id"), F.col("close").alias("level"))
    live.signal_sink(s.unionByName(s), out, ck).awaitTermination()
    return spark.read.parquet(out).select("signal_id", "level")
