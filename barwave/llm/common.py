"""What the text operators share: words, folds, and joins that broadcast only after counting."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwave.session import cut, ensure_checkpoint_dir

__all__ = ["WORD", "attach", "broadcast_if_small", "crc_mod", "cut", "ensure_checkpoint_dir", "let", "n_words", "pass_few_bytes", "release", "running", "shuffles"]

WORD = r"[^\x20\x09-\x0D]+"


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once a row, also where ``fn`` reads it inside a lambda."""
    return F.transform(F.array(value), fn)[0]


def broadcast_if_small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has few rows; else as it is, for a shuffled join."""
    few = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if few else df


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pass_few_bytes(spark: SparkSession) -> None:
    """From now on, tasks pass texts to their Python workers in batches of about 4 MB: by rows alone, a batch of long texts is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints of frames that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def attach(rows: DataFrame, facts: DataFrame, on: list[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row a key; ``size`` is its number of rows of that key, or more.

    Keys that hold more than one part in ``share`` of all are ``share`` at most and are broadcast; only the others are shuffled,
    so no task gets more than its part of a hot key.
    """
    most = facts.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0] // share
    hot = F.broadcast(facts.filter(F.col(size) > most))
    light = rows.join(hot.select(*on), on, "left_anti").join(facts.filter(F.col(size) <= most), on, "left")
    return rows.join(hot, on).unionByName(light)


def running(rows: DataFrame, key: list[str], order: list[str], totals: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
    """``rows`` (written rows) with running totals before each row of its key, in ascending ``order``, null first.

    ``totals`` maps a new long column to (column, aggregate, how two aggregates combine); the total of no rows is 0. Rows are
    dealt out by ranges of key and order, so a key of any size is shared out. At most one key reaches over each border
    between two tasks, so what the tasks before hold of such keys is a table bounded by the number of tasks; it is broadcast.
    """
    dealt = cut(rows.repartitionByRange(shuffles(rows), *key, *order).withColumn("task", F.spark_partition_id()))
    parts = dealt.groupBy(*key, "task").agg(*[agg(F.col(c)).alias(f"own_{name}") for name, (c, agg, _) in totals.items()])
    earlier = Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = [agg(F.col(f"own_{name}")).over(earlier).alias(f"before_{name}") for name, (_, agg, _) in totals.items()]
    before = parts.select(*key, "task", F.row_number().over(Window.partitionBy(*key).orderBy("task")).alias("place"), *before).filter("place > 1").drop("place")
    within = Window.partitionBy("task", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({name: F.coalesce(agg(F.col(c)).over(within), F.lit(0)).cast("long") for name, (c, agg, _) in totals.items()})
    joined = placed.join(F.broadcast(cut(before)), [*key, "task"], "left")
    joined = joined.withColumns({name: both(F.col(name), F.coalesce(f"before_{name}", F.lit(0))).cast("long") for name, (_, _, both) in totals.items()})
    return joined.drop("task", *[f"before_{name}" for name in totals])
