"""Bars from ticks, and the tick feed derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwave.operators.series import with_bar_index
from barwave.session import cut
from barwave.sources.timeframes import SPAN


def frame_start(time: str | Column, tf: str) -> Column:
    """Open time of the bar that holds ``time``; weeks start on Monday, months on day one."""
    c = F.col(time) if isinstance(time, str) else time
    if tf == "M1":
        return F.date_trunc("month", c).cast("timestamp_ntz")
    if tf == "w1":
        return F.date_trunc("week", c).cast("timestamp_ntz")
    span = SPAN[tf]
    secs = F.floor(F.unix_seconds(c.cast("timestamp")) / span) * span
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def ticks_to_bars(ticks: DataFrame, tf: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """OHLC and tick count per (symbol, bar). All aggregates combine before the shuffle."""
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    bars = (
        ticks.groupBy("symbol", frame_start("ts", tf).alias("open_time"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .withColumn("tf", F.lit(tf))
    )
    return with_bar_index(bars)


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """A higher frame from a lower one."""
    out = (
        bars.groupBy("symbol", frame_start("open_time", tf).alias("_t"))
        .agg(
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_t", "open_time")
        .withColumn("tf", F.lit(tf))
    )
    return with_bar_index(out)


BASE_LEVEL = 50000


def minute_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (symbol, minute): OHLC and sum of the signed event values.

    The only pass over the raw table; everything combines before the shuffle, whatever the share of
    one symbol or minute.  Sums are decimal, hence exact in any order.  The result is bounded by
    symbols x calendar minutes and is materialised, as two branches read it.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    amount = F.col("value").cast("decimal(18,2)")
    # time then id as one decimal: its buffer is mutable, so the aggregate hashes instead of sorting
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("event_id")
    m = (
        ev.select(
            F.col("event_type").alias("symbol"),
            frame_start("ts", "m1").alias("minute"),
            "ts",
            "event_id",
            F.when(F.col("event_id") % 2 == 0, amount).otherwise(-amount).alias("v"),
        )
        .groupBy("symbol", "minute")
        .agg(
            F.min_by("v", at).alias("o"),
            F.max("v").alias("h"),
            F.min("v").alias("l"),
            F.max_by("v", at).alias("c"),
            F.sum("v").alias("s"),
            F.count("*").alias("n"),
        )
    )
    return cut(m.withColumn("_day", F.to_date("minute")))


def walk_bars(spark: SparkSession, sf_dir: str, tf: str = "h1") -> DataFrame:
    """Bars of a signed walk over ``events``: symbol = event type, step = +/- value.

    A tick's price is the level reached by all earlier minutes plus its own signed value.  Levels
    and bar numbers need order: totals per day, a prefix over the day table (one row per symbol and
    day), then windows inside one day.
    """
    if SPAN[tf] > 86400:
        return resample(walk_bars(spark, sf_dir, "d1"), tf)
    m = minute_moves(spark, sf_dir).withColumn("open_time", frame_start("minute", tf))
    days = m.groupBy("symbol", "_day").agg(F.sum("s").alias("_s"), F.count_distinct("open_time").alias("_n"))
    prior = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(18,2)")
    days = days.select(
        "symbol", "_day", F.coalesce(F.sum("_s").over(prior), zero).alias("_level"),
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy("symbol", "_day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    level = F.lit(BASE_LEVEL) + F.col("_level") + F.coalesce(F.sum("s").over(inside), zero)
    priced = m.join(days, ["symbol", "_day"]).withColumn("_lvl", level)
    price = lambda c: (F.col("_lvl") + F.col(c)).cast("double")
    bars = priced.groupBy("symbol", "_day", "_base", "open_time").agg(
        F.min_by(price("o"), "minute").alias("open"),
        F.max(price("h")).alias("high"),
        F.min(price("l")).alias("low"),
        F.max_by(price("c"), "minute").alias("close"),
        F.sum("n").cast("double").alias("volume"),
    )
    rank = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("open_time"))
    return bars.select(
        "symbol", F.lit(tf).alias("tf"), (F.col("_base") + rank - 1).cast("long").alias("bar_index"),
        "open_time", "open", "high", "low", "close", "volume",
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticks: price = event value."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id")


def bar_table(spark: SparkSession, sf_dir: str, tf: str = "h1") -> DataFrame:
    """``walk_bars`` materialised once, for plans that read the bars more than once."""
    return cut(walk_bars(spark, sf_dir, tf))
