import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barwave.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(spark, closes, symbol="T", spread=0.5, tf="h1"):
    """Bars around a list of closes: open = close before, high and low a spread beyond the body."""
    rows, prev = [], closes[0]
    for i, c in enumerate(closes):
        o, prev = prev, c
        rows.append((symbol, tf, i, float(o), float(max(o, c) + spread), float(min(o, c) - spread), float(c), 1.0))
    df = spark.createDataFrame(rows, "symbol string, tf string, bar_index long, open double, high double, low double, close double, volume double")
    from pyspark.sql import functions as F

    return df.withColumn("open_time", F.timestamp_seconds(F.lit(1704067200) + F.col("bar_index") * 3600).cast("timestamp_ntz"))


def walk(n, seed=7, step=1.0, start=1000.0):
    import random

    rng, out, v = random.Random(seed), [], start
    for _ in range(n):
        v += rng.uniform(-step, step)
        out.append(round(v, 2))
    return out


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
