"""Exact duplicates by progressive refinement: length, then hash of the first characters, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.llm.common import attach, cut

SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"  # what one space doesn't already stand for
FILTER_BITS = 1 << 26  # bits of a filter: 2048 rows of 4 KB at most, 8 MB broadcast however many keys there are
ROW_BITS = 1 << 15  # bits of one row of a filter, fixed by bitmap_construct_agg


def normalised(text: Column) -> Column:
    """``text`` with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def bit_of(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def repeated(keys: DataFrame, bits: int) -> DataFrame:
    """A filter of the rows of ``keys`` that occur twice or more: bitmaps of their hashes, of at most ``bits`` bits."""
    bit = bit_of([F.col(c) for c in keys.columns], bits)
    twice = keys.groupBy(*keys.columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select(bit.alias("bit"))
    return cut(twice.groupBy((F.col("bit") / ROW_BITS).cast("long").alias("filter_row")).agg(F.bitmap_construct_agg((F.col("bit") % ROW_BITS).cast("long")).alias("bitmap")))


def may_repeat(rows: DataFrame, keys: list[str], found: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``survives``: false only where no other row has the same ``keys``."""
    bit = bit_of([F.col(c) for c in keys], bits)
    joined = rows.withColumn("filter_row", (bit / ROW_BITS).cast("long")).join(F.broadcast(found), "filter_row", "left")
    at = (bit % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("survives", F.coalesce(hit, F.lit(False))).drop("filter_row", "bitmap")


def exact_groups(docs: DataFrame, digest_all: bool = False, prefix_chars: int = 64, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, keep_id, group_size, kept, n_chars, text_sha256``.

    Texts are equal when identical after each run of white space became one space. Three steps, each on what the one
    before left: lengths that occur once are done; among the others, (length, hash of the first ``prefix_chars``
    characters) that occur once are done; only the rest have their whole text hashed, and equal (length, SHA-256) are a
    group. What goes on is decided by a bitmap of ``filter_bits`` bits, of bounded size: it never drops a row
    that has a partner, and two keys that share a bit merely let a row go on to the next step. Texts stay where they are
    read: lengths, hashes and ids alone are shuffled, counted before they move, so a group may hold any share of the rows.

    ``text_sha256`` is the lower-case hex digest of the normalised text where the last step read it, else null;
    with ``digest_all`` it is there for every row. ``keep_id`` is the smallest doc_id of the group.

    Null text: empty; all empty and blank-only texts follow the same rule (blank ones become one space). Null ids come after
    all others. One row of each group has ``kept``; of rows that repeat the smallest id one, whichever was read first.
    Long texts are read whole. Empty table: no rows. Other columns are ignored.
    """
    texts = docs.select("doc_id", normalised(docs["text"]).alias("body")).withColumn("n_chars", F.length("body"))
    lengths = repeated(texts.select("n_chars"), filter_bits)
    heads = may_repeat(texts, ["n_chars"], lengths, filter_bits).withColumn("head", F.when(F.col("survives"), F.xxhash64(F.left("body", F.lit(prefix_chars)))))
    prefixes = repeated(heads.filter("survives").select("n_chars", "head"), filter_bits)
    last = may_repeat(heads.withColumnRenamed("survives", "same_length"), ["n_chars", "head"], prefixes, filter_bits)
    whole = F.sha2("body", 256)
    reads = F.col("survives") & F.col("same_length")
    digest = whole if digest_all else F.when(reads, whole)
    rows = cut(last.select("doc_id", "n_chars", reads.alias("survives"), digest.alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = rows.filter("survives").groupBy("n_chars", "text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    groups = cut(groups.filter("group_size > 1"))
    members = attach(rows.filter("survives"), groups, ["n_chars", "text_sha256"], "group_size")
    alone = rows.filter(~F.col("survives")).withColumns({"group_size": F.lit(None).cast("long"), "first": F.lit(None).cast(groups.schema["first"].dataType)})
    every = members.unionByName(alone)
    return every.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "n_chars",
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
  g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
