"""Source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barwave.plans.oracle import bars_cte, with_bars
from barwave.plans.registry import query
from barwave.session import ensure_checkpoint_dir
from barwave.sources import bars_csv, exports, messages
from barwave.sources import ticks as tk
from barwave.sources.timeframes import TIMEFRAMES, next_tf, timeframe_dim


def scratch(spark, name: str) -> str:
    """A fresh folder beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def archive(spark, sf) -> str:
    path = scratch(spark, "bars")
    bars_csv.write_bars_csv(tk.bar_table(spark, sf), path, digits=2)
    return path


@query("s01_read_bars_csv", with_bars("SELECT symbol, tf, bar_index, open_time, open, high, low, close FROM bars"))
def q_csv(spark, sf):
    return bars_csv.read_bars_csv(spark, archive(spark, sf))


@query(
    "s02_with_file_meta",
    with_bars(
        """SELECT symbol || '_' || tf || '_' || strftime(min(open_time), '%Y-%m-%dT%H-%M-%S') || '_' || strftime(max(open_time), '%Y-%m-%dT%H-%M-%S') AS series,
        symbol, tf, count(*) AS n FROM bars GROUP BY symbol, tf"""
    ),
)
def q_meta(spark, sf):
    return bars_csv.parse_bars(bars_csv.read_bars_text(spark, archive(spark, sf))).groupBy("series", "symbol", "tf").agg(F.count("*").alias("n"))


@query("s03_price_digits", with_bars("SELECT symbol, tf, 2::INTEGER AS digits FROM bars GROUP BY symbol, tf"))
def q_digits(spark, sf):
    return bars_csv.price_digits(bars_csv.read_bars_text(spark, archive(spark, sf))).select("symbol", "tf", "digits")


@query(
    "s04_bars_between",
    with_bars(
        """, e AS (SELECT symbol, arg_min(bar_index, (abs(epoch_us(open_time) - epoch_us(TIMESTAMP '2024-01-20 10:25:00')), bar_index)) AS a,
          arg_min(bar_index, (abs(epoch_us(open_time) - epoch_us(TIMESTAMP '2024-01-05 03:40:00')), bar_index)) AS b FROM bars GROUP BY symbol)
        SELECT symbol, tf, bar_index, open_time, close FROM bars JOIN e USING (symbol) WHERE bar_index BETWEEN least(a, b) AND greatest(a, b)"""
    ),
)
def q_between(spark, sf):
    b = bars_csv.bars_between(tk.bar_table(spark, sf), "2024-01-20 10:25:00", "2024-01-05 03:40:00")
    return b.select("symbol", "tf", "bar_index", "open_time", "close")


@query(
    "s05_write_bars_csv",
    with_bars(
        """SELECT symbol, tf, strftime(open_time, '%Y-%m-%dT%H:%M:%S') AS open_time, printf('%.2f', open) AS open, printf('%.2f', close) AS close FROM bars"""
    ),
)
def q_write(spark, sf):
    text = bars_csv.read_bars_text(spark, archive(spark, sf))
    return text.where(F.col("open_time") != "Time").select("symbol", "tf", "open_time", "open", "close")


def _two_frames_sql(body: str) -> str:
    return "WITH " + bars_cte("h1", "bars") + ", " + bars_cte("h4", "bars4") + ", bb AS (SELECT * FROM bars UNION ALL SELECT * FROM bars4) " + body


def two_frames(spark, sf):
    return tk.walk_bars(spark, sf, "h1").unionByName(tk.walk_bars(spark, sf, "h4"))


@query(
    "s06_common_range",
    _two_frames_sql(
        """, f AS (SELECT symbol, tf, min(open_time) AS a, max(open_time) AS b FROM bb GROUP BY symbol, tf)
        SELECT symbol, max(a) AS range_start, min(b) AS range_end FROM f GROUP BY symbol"""
    ),
)
def q_range(spark, sf):
    return bars_csv.common_range(two_frames(spark, sf))


@query(
    "s07_archive_summary",
    _two_frames_sql("SELECT symbol, tf, count(*) AS bar_count, min(open_time) AS first_time, max(open_time) AS last_time FROM bb GROUP BY symbol, tf"),
)
def q_summary(spark, sf):
    return bars_csv.archive_summary(two_frames(spark, sf))


@query(
    "s09_read_messages_json",
    """WITH m AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn // 2) AS date, text FROM conversations),
    l AS (SELECT id, arg_max(date, turn) AS date, arg_max(text, turn) AS text FROM m GROUP BY id)
    SELECT arg_max(id, id) AS id, date, arg_max(length(text), id) AS n_chars FROM l GROUP BY date""",
)
def q_messages(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.floor(F.col("turn") / 2))
    item = F.struct(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("text")
    )
    docs = c.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("messages"))).alias("json"))
    return messages.parse_messages(docs).select("id", "date", F.length("text").cast("long").alias("n_chars"))


_LABEL_SQL = """raw AS (SELECT event_type AS ticker, 'h1' AS timeframe, CAST(user_id % 7 AS VARCHAR) AS model, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start_time,
      strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d') AS end_time, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS sp,
      CAST(event_id AS VARCHAR) AS ep, lpad(CAST(event_id AS VARCHAR), 12, '0') AS received_at FROM events),
    ok AS (SELECT *, TRY_CAST(sp AS DOUBLE) AS start_price, TRY_CAST(ep AS DOUBLE) AS end_price FROM raw),
    lab AS (SELECT ticker, timeframe, start_time, end_time, model, arg_min(start_price, received_at) AS start_price, arg_min(end_price, received_at) AS end_price, min(received_at) AS received_at
      FROM ok WHERE start_price IS NOT NULL AND end_price IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def raw_labels(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    day = F.date_trunc("day", "ts")
    return ev.select(
        F.col("event_type").alias("ticker"), F.lit("h1").alias("timeframe"), (F.col("user_id") % 7).cast("string").alias("model"),
        F.date_format(day, "yyyy-MM-dd").alias("start_time"), F.date_format(day + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd").alias("end_time"),
        F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("start_price"),
        F.col("event_id").cast("string").alias("end_price"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("received_at"),
    )


@query("s10_ingest_labels", "WITH " + _LABEL_SQL + " SELECT * FROM lab")
def q_ingest(spark, sf):
    return exports.ingest_labels(raw_labels(spark, sf))


@query("s11_list_labels", "WITH " + _LABEL_SQL + " SELECT * FROM lab WHERE ticker = 'click' AND model = '3'")
def q_list(spark, sf):
    return exports.list_labels(exports.ingest_labels(raw_labels(spark, sf)), ticker="click", model="3")


@query("s11_export_labels", "WITH " + _LABEL_SQL + " SELECT ticker, timeframe, start_time, model, start_price, received_at FROM lab")
def q_export(spark, sf):
    path = scratch(spark, "labels")
    exports.export_labels(exports.ingest_labels(raw_labels(spark, sf)), path)
    back = spark.read.csv(
        path, header=True,
        schema="ticker STRING, timeframe STRING, start_time STRING, end_time STRING, model STRING, start_price DOUBLE, end_price DOUBLE, received_at STRING, broker STRING",
    )
    return back.select("ticker", "timeframe", "start_time", "model", "start_price", "received_at")


@query("s14_candles_json")
def q_candles(spark, sf):
    bars = tk.bar_table(spark, sf)
    w = bars.groupBy("symbol", "tf", F.to_date("open_time").alias("_d")).agg(F.min("open_time").alias("from_time"), F.max("open_time").alias("to_time"))
    w = w.withColumn("window_id", F.concat_ws("|", "symbol", "tf", "_d"))
    return exports.candles_json(bars, w)


_TF_SQL = "tfs AS (SELECT unnest([" + ", ".join(f"'{n}'" for n, _ in TIMEFRAMES) + "]) AS tf, unnest([" + ", ".join(str(s) for _, s in TIMEFRAMES) + "]) AS span)"


@query(
    "s16_next_tf",
    _two_frames_sql(
        ", "
        + _TF_SQL
        + """, b AS (SELECT symbol, tf, count(*) AS n FROM bb GROUP BY symbol, tf)
        SELECT b.symbol, b.tf, n, span AS span_seconds, coalesce((SELECT arg_min(t.tf, t.span) FROM tfs t WHERE t.span >= f.span * 5), b.tf) AS next5,
          coalesce((SELECT arg_max(t.tf, t.span) FROM tfs t WHERE t.span < f.span), b.tf) AS prev_tf,
          coalesce((SELECT arg_min(t.tf, t.span) FROM tfs t WHERE t.span > f.span), b.tf) AS next_tf FROM b JOIN tfs f ON f.tf = b.tf"""
    ),
)
def q_next(spark, sf):
    b = two_frames(spark, sf).groupBy("symbol", "tf").agg(F.count("*").alias("n"))
    dim = timeframe_dim(spark)  # fifteen rows
    return b.join(F.broadcast(dim), "tf").withColumn("next5", next_tf(F.col("tf"), 5.0))


@query(
    "s17_ticks_to_bars",
    """WITH b AS (SELECT event_type AS symbol, to_timestamp(floor(epoch(ts)/900)*900) AT TIME ZONE 'UTC' AS open_time, arg_min(value, (ts, event_id)) AS open,
      max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
    SELECT symbol, 'm15' AS tf, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS bar_index, open_time, open, high, low, close, volume FROM b""",
)
def q_ticks(spark, sf):
    return tk.ticks_to_bars(tk.event_ticks(spark, sf), "m15", ("ts", "event_id"))


@query("s17_resample", _two_frames_sql("SELECT symbol, tf, bar_index, open_time, open, high, low, close, volume FROM bars4"))
def q_resample(spark, sf):
    return tk.resample(tk.walk_bars(spark, sf, "h1"), "h4")
