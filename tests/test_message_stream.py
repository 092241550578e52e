"""Messages meet ticks within a time slot, not all ticks of their channel."""

from pyspark.sql import functions as F

from barwave.plans import load
from barwave.streaming import live

load()

from barwave.plans.streams import landed  # noqa: E402


def test_pairs_at_the_edges_of_slots(spark, tmp_path):
    at = lambda c: F.timestamp_micros(F.lit(1704067200_000_000) + F.col(c)).alias(c)
    ticks = [("a", x, 1.0, i) for i, x in enumerate((0, 9_999_999, 10_000_000, 10_000_001, 13_000_000, 19_999_999, 20_000_000, 30_000_000))] + [("b", 3_000_000, 1.0, 100)]
    said = [("a", 0, 1), ("a", 3_000_000, 2), ("a", 10_000_000, 3), ("b", 4_000_000, 4)]
    spark.createDataFrame(ticks, "symbol string, ts long, price double, event_id long").select("symbol", at("ts"), "price", "event_id").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame(said, "channel string, date long, message_id long").select("channel", at("date"), "message_id").write.parquet(f"{tmp_path}/m")
    t = spark.readStream.schema("symbol string, ts timestamp, price double, event_id long").parquet(f"{tmp_path}/t")
    m = spark.readStream.schema("channel string, date timestamp, message_id long").parquet(f"{tmp_path}/m")
    joined = live.message_stream(m, t)
    got = sorted((r["message_id"], r["tick_id"]) for r in landed(spark, joined).collect())
    assert got == sorted((k, i) for c, d, k in said for s, x, _, i in ticks if s == c and d <= x <= d + 10_000_000)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_slot" in next(line for line in plan.splitlines() if "Join Inner" in line)
