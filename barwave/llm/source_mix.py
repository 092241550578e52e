"""Mixing sources to target weights: hash-random order within each source, prefix sums, and an exact cut at each budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwave.llm.common import cut, n_words

BUCKET_DIGITS = 3  # leading hex digits of the random key: 4096 ranges a source


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """Target of each source from (``source``, ``source_size``).

    Sources in code point order, null last, weigh ``weights``, repeated. They share ``share`` of the sum of all sizes by
    weight; no target goes above ``most_epochs`` times its source's size, and what is cut there goes to the others by
    weight. In order of size / weight the sources at their cap come first, so one running sum finds the level: no loop.
    The tables have one row a source. A source of size 0 has target 0; without sources there are no rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.select("source", "source_size").withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        caps.withColumn("total", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fair", (F.col("total") - F.col("capped")) / F.col("left_weight"))
        .withColumn("open", F.col("fair") * F.col("weight") <= F.col("cap"))
    )
    water = F.min(F.when(F.col("open"), F.struct("capped", "left_weight", "fair"))).over(every)
    return level.select(
        "source",
        "source_size",
        F.least(F.coalesce(water["fair"] * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"),
    )


def mix_sources(
    sized: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    seed: int = 7,
    share: float = 1.0,
    most_epochs: int = 3,
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """How much of each document the mix takes. ``sized`` has ``doc_id``, ``source``, ``size`` (long).

    Returns ``doc_id, source, size, source_size, target, taken``. Every document gets the key md5(seed:doc_id). Within a
    source, documents in key order fill the rounded target: whole passes over the source first, then the part of one more
    pass that is left; the document at the cut gives just the words that are missing, so taken sums to the budget.
    Key ranges (leading digits) are summed first, so each task orders one range of one source, however large the source.

    Null source: a source of its own, last. Null size counts as 0, takes 0. Null ids share a key; rows equal in id are
    ordered by size, and equal rows are interchangeable. Empty table: no rows. Extra columns are ignored.
    """
    rows = cut(
        sized.select(
            "doc_id",
            "source",
            F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
        )
        .withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("bucket", F.substring("key", 1, bucket_digits))
    )
    per_bucket = rows.groupBy("s", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = per_bucket.groupBy("s", "source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most_epochs).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_bucket.select("s", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
        .join(targets, "s")
        .withColumn("budget", F.round("target").cast("long"))
    )
    within = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["s", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("budget") - F.col("passes") * F.col("source_size")
    part = F.least(F.greatest(left - F.col("start"), F.lit(0)), F.col("size"))
    return placed.withColumn("passes", passes.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 7, length_column: str = "n_chars") -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it, its text cut after the words taken where a budget ends.

    Same columns. Rows of which nothing is taken are absent (a row without words is never taken). ``length_column``, where there is one,
    follows a cut text. Rows equal in id, source and text are one row that may be taken for each of them.
    """
    mark = F.xxhash64("doc_id", "source", "text", F.col("source").isNull())
    sized = docs.select(mark.alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    taken = mix_sources(sized, weights, seed).groupBy("doc_id").agg(F.sum("taken").alias("mix_taken"), F.max("size").alias("mix_size"), F.count("*").alias("mix_rows"))
    taken = cut(taken.filter("mix_taken > 0").withColumnRenamed("doc_id", "mix_key"))
    columns = docs.columns
    joined = docs.join(taken, mark == taken["mix_key"])
    if not taken.filter("mix_rows > 1").isEmpty():
        many = joined.filter(taken["mix_rows"] > 1)
        joined = joined.filter(taken["mix_rows"] == 1).unionByName(many.dropDuplicates(["mix_key"]))
    whole, left = F.floor(taken["mix_taken"] / taken["mix_size"]).cast("int"), (taken["mix_taken"] % taken["mix_size"]).cast("int")
    text = docs["text"]
    some = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, left), "")
    texts = F.concat(F.array_repeat(text, whole), F.when(left > 0, F.array(some)).otherwise(F.array().cast("array<string>")))
    shown = joined.select(*[docs[c] for c in columns if c != "text"], F.explode(texts).alias("text"), text.alias("mix_whole"))
    if length_column in columns:
        kind = docs.schema[length_column].dataType
        shown = shown.withColumn(length_column, F.when(F.col("text") == F.col("mix_whole"), F.col(length_column)).otherwise(F.length("text").cast(kind)))
    return shown.select(*columns)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5('7:' || CAST(doc_id AS VARCHAR)) AS key FROM {documents}),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
  w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
  l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
      coalesce(sum(cap) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
    FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, (total - capped::DOUBLE) / left_weight::DOUBLE AS fair FROM l),
  m AS (SELECT *, min(CASE WHEN fair * weight <= cap THEN {{'a': capped, 'b': left_weight, 'c': fair}} END) OVER () AS water FROM f),
  t AS (SELECT source, source_size, least(coalesce(water.c * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM m),
  p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + least(greatest(budget % source_size - start, 0), size) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
