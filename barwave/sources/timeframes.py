"""Time-frame dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: name, span in seconds (a month counts 30 days)
TIMEFRAMES = (
    ("m1", 60), ("m2", 120), ("m3", 180), ("m5", 300), ("m10", 600), ("m15", 900), ("m30", 1800),
    ("h1", 3600), ("h2", 7200), ("h4", 14400), ("h6", 21600), ("h12", 43200),
    ("d1", 86400), ("w1", 604800), ("M1", 2592000),
)
SPAN = dict(TIMEFRAMES)


def timeframe_dim(spark: SparkSession) -> DataFrame:
    """One row per frame with its span and its neighbours (the ends point at themselves)."""
    names = [n for n, _ in TIMEFRAMES]
    rows = [
        (n, s, names[max(i - 1, 0)], names[min(i + 1, len(names) - 1)]) for i, (n, s) in enumerate(TIMEFRAMES)
    ]
    return spark.createDataFrame(rows, "tf string, span_seconds long, prev_tf string, next_tf string")


def next_tf(tf: Column, ratio: float) -> Column:
    """The first frame whose span is at least ``ratio`` times the given one, else the frame itself."""
    span = F.create_map(*[F.lit(x) for n, s in TIMEFRAMES for x in (n, s)])[tf]
    ladder = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in TIMEFRAMES])
    fits = F.filter(ladder, lambda e: e["s"] >= span * F.lit(float(ratio)))
    return F.coalesce(F.try_element_at(fits, F.lit(1))["n"], tf)
