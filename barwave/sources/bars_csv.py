"""Bar archives as text: one folder entry per series, named ``{symbol}_{tf}_{from}_{to}.csv``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwave.operators.joins import epoch_us
from barwave.operators.series import KEY, block_of, with_bar_index
from barwave.sources.timeframes import TIMEFRAMES

SEPARATOR = ";"
COLUMNS = ("open_time", "open", "high", "low", "close")


def with_file_meta(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Symbol = name up to the first underscore; frame = the short name between underscores, else h1."""
    path = F.col("_metadata.file_path") if path is None else path
    # the series name is the last path element that looks like one, be it a file or a folder
    name = F.regexp_extract(path, r"([^/=]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    tf = F.lower(F.regexp_extract(name, r"_([a-zA-Z]\d{1,2})_", 1))
    known = F.array(*[F.lit(n) for n, _ in TIMEFRAMES if n != "M1"])
    month = F.regexp_extract(name, r"_(M1)_", 1) == "M1"
    return df.withColumns(
        {
            "series": name,
            "symbol": F.substring_index(name, "_", 1),
            "tf": F.when(month, "M1").when(F.array_contains(known, tf), tf).otherwise("h1"),
        }
    )


def read_bars_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw text columns with symbol and frame; header lines and bad rows are still in."""
    schema = ", ".join(f"{c} STRING" for c in COLUMNS)
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, sep=SEPARATOR, schema=schema)
    return with_file_meta(raw)


def parse_bars(text: DataFrame) -> DataFrame:
    """Typed rows; a row whose time or any price does not parse (a header, for one) is skipped."""
    typed = text.select(
        "series", *KEY, F.expr("try_cast(open_time AS TIMESTAMP_NTZ)").alias("open_time"),
        *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in COLUMNS[1:]],
    )
    return typed.dropna(subset=list(COLUMNS))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of every file under ``path`` with a dense index per series."""
    bars = with_bar_index(parse_bars(read_bars_text(spark, path)).drop("series"))
    return bars.select(*KEY, "bar_index", *COLUMNS)


def price_digits(text: DataFrame) -> DataFrame:
    """Most decimals seen in the four price texts of a series; 5 when there are none."""
    decimals = lambda c: F.length(F.regexp_extract(F.col(c), r"^[^.]*\.([^eE]*)", 1))
    widest = F.greatest(*[decimals(c) for c in COLUMNS[1:]])
    g = text.groupBy("series", *KEY).agg(F.max(widest).alias("_d"))
    return g.select("series", *KEY, F.when(F.col("_d") > 0, F.col("_d")).otherwise(5).cast("int").alias("digits"))


def bars_between(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars from the one nearest ``start`` to the one nearest ``end`` (swapped if reversed).

    The nearest bars come from one aggregate; the filter is then on bar_index.
    """
    t = epoch_us("open_time")
    ends = []
    for name, when in (("_a", start), ("_b", end)):
        gap = F.abs(t - epoch_us(F.lit(when).cast("timestamp_ntz")))
        ends.append(F.min_by("bar_index", F.struct(gap, F.col("bar_index"))).alias(name))
    span = bars.groupBy(*KEY).agg(*ends)
    lo, hi = F.least("_a", "_b"), F.greatest("_a", "_b")
    return bars.join(span, list(KEY)).where(F.col("bar_index").between(lo, hi)).drop("_a", "_b")


def write_bars_csv(bars: DataFrame, path: str, digits: int = 5, rows_per_file: int = 1_000_000) -> None:
    """One folder per series holding bounded files, so no series is written by one task."""
    span = bars.groupBy(*KEY).agg(F.min("open_time").alias("_f"), F.max("open_time").alias("_t"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH-mm-ss")
    name = F.concat_ws("_", "symbol", "tf", iso("_f"), iso("_t"))
    fmt = lambda c: F.format_string(f"%.{digits}f", F.col(c)).alias(c)
    rows = bars.join(span, list(KEY)).select(
        F.concat(name, F.lit(".csv")).alias("series"), block_of("bar_index", rows_per_file).alias("_chunk"), "bar_index",
        F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss").alias("Time"),
        fmt("open").alias("Open"), fmt("high").alias("High"), fmt("low").alias("Low"), fmt("close").alias("Close"),
    )
    out = rows.repartition("series", "_chunk").sortWithinPartitions("series", "bar_index").drop("_chunk", "bar_index")
    out.write.mode("overwrite").partitionBy("series").csv(path, sep=SEPARATOR, header=True)


def common_range(bars: DataFrame) -> DataFrame:
    """Per symbol the time span covered by all its frames."""
    per = bars.groupBy(*KEY).agg(F.min("open_time").alias("_f"), F.max("open_time").alias("_l"))
    return per.groupBy("symbol").agg(F.max("_f").alias("range_start"), F.min("_l").alias("range_end"))


def archive_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEY).agg(
        F.count("*").alias("bar_count"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time")
    )
