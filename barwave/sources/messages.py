"""Chat exports as message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ITEM = "STRUCT<id: BIGINT, date: STRING, reply_to_message_id: BIGINT, text: STRING>"


def read_messages_json(spark: SparkSession, path: str) -> DataFrame:
    """Either an object with ``messages`` or a bare array; text may be a string or an array of parts.

    The last message wins per id, then per date.
    """
    raw = spark.read.text(path, wholetext=True)
    return parse_messages(raw.select(F.col("value").alias("json")))


def parse_messages(df: DataFrame, column: str = "json") -> DataFrame:
    doc = F.ltrim(F.col(column))
    items = F.when(doc.startswith("["), F.from_json(doc, f"ARRAY<{_ITEM}>")).otherwise(
        F.from_json(doc, f"messages ARRAY<{_ITEM}>")["messages"]
    )
    m = df.select(F.posexplode(items).alias("pos", "_m")).select("pos", "_m.*")
    when = F.to_utc_timestamp(F.expr("try_cast(date AS TIMESTAMP)"), "UTC").cast("timestamp_ntz")
    m = m.select("pos", "id", when.alias("date"), F.col("reply_to_message_id").alias("reply_id"), "text")
    # last one per id and then per date, as aggregates that combine before the shuffle
    last = m.groupBy("id").agg(F.max(F.struct("pos", "date", "reply_id", "text")).alias("_l")).select("id", "_l.*")
    best = last.groupBy("date").agg(F.max(F.struct("pos", "id", "reply_id", "text")).alias("_l"))
    return best.select("_l.id", "date", "_l.reply_id", "_l.text")
