"""Fingerprints of whole texts that keep edit distance: shared random walks over characters, bit-sampled bands, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwave.llm.common import cut, shuffles

BITS = 256
PIECE = 256  # mean characters between two places where the text itself starts a new walk
LONGEST_PIECE = 512
LEAST_STEPS = 1024  # shorter texts are walked again with other randomness
BANDS, BAND_BITS = 24, 14
SLICE = 512  # mean fingerprints in a slice of a band's bucket
SEED = 20_240_601


def mix(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint32(15))
    v = v * np.uint32(0x2C1B3C6D)
    v = v ^ (v >> np.uint32(12))
    v = v * np.uint32(0x297A2D39)
    return v ^ (v >> np.uint32(15))


_rng = np.random.default_rng(SEED)
STEP_KEYS = _rng.integers(0, 1 << 32, 1 << 16, np.uint32)  # one a step: shared by all texts and machines
BAND_PLACES = np.stack([_rng.choice(BITS, BAND_BITS, replace=False) for _ in range(BANDS)])


def pieces(chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the stretches that are walked by themselves.

    A stretch ends where a hash of four characters says so, at the end of a text, and after ``LONGEST_PIECE``; an edit moves only
    the ends near it. The first three characters of a text have no four of their own and end none, so texts before it have no say.
    """
    n = len(chars)
    h = chars * np.uint32(0x9E3779B1)
    for k, factor in ((1, 0x85EBCA77), (2, 0xC2B2AE3D), (3, 0x27D4EB2F)):
        h[k:] += chars[:-k] * np.uint32(factor)
    ends_at = np.cumsum(lengths)
    within = np.arange(n) - np.repeat(ends_at - lengths, lengths)
    last = (mix(h) % np.uint32(PIECE) == 0) & (within >= 3)
    last[ends_at[lengths > 0] - 1] = True
    end = np.flatnonzero(last) + 1
    start = np.concatenate([[0], end[:-1]])
    parts = -(-(end - start) // LONGEST_PIECE)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start2 = np.repeat(start, parts) + k * LONGEST_PIECE
    end2 = np.minimum(start2 + LONGEST_PIECE, np.repeat(end, parts))
    return start2, end2, np.searchsorted(ends_at, start2, side="right")


def fingerprints(texts: list[str]) -> np.ndarray:
    """Bits (texts x ``BITS``, 0 or 1) of whole texts.

    Edit embedding: a walk stands on a character; each step hashes (step, character) with randomness that all texts share, emits the
    hash, and moves on or stays by one of its bits. After an edit two walks fall in step again, so texts at small edit distance emit
    sequences at small Hamming distance. The emitted hashes vote on the bits, which keeps the share of places where two
    sequences agree. Without characters there are no votes and all bits are 0.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    votes = np.zeros(len(texts) * BITS)
    if not lengths.sum():
        return np.zeros((len(texts), BITS), np.uint8)
    chars = np.frombuffer(b"".join(raw), "<u4").astype(np.uint32)
    at, end, text = pieces(chars, lengths)
    again = np.maximum(1, -(-LEAST_STEPS // np.maximum(2 * lengths, 1)))[text]
    walk = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    at, end, text = np.repeat(at, again), np.repeat(end, again), np.repeat(text, again)
    shift, base = walk * 1_201, text * BITS
    chars = chars * np.uint32(0x9E3779B1)
    held_slots, held_signs, n, step = [], [], 0, 0
    while len(at):
        v = mix(chars[at] ^ STEP_KEYS[(shift + step) & 0xFFFF])
        held_slots.append(base + ((v >> np.uint32(8)) & np.uint32(BITS - 1)))
        held_signs.append((v >> np.uint32(1)) & np.uint32(1))
        n += len(at)
        at = at + (v & np.uint32(1))
        going = at < end
        if not going.all():
            at, end, shift, base = at[going], end[going], shift[going], base[going]
        step += 1
        if n > 2_000_000 or not len(at):
            votes += np.bincount(np.concatenate(held_slots), np.concatenate(held_signs) * 2.0 - 1, len(votes))
            held_slots, held_signs, n = [], [], 0
    return (votes.reshape(-1, BITS) > 0).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of walks in common, 0 to 1, from the bits in which two fingerprints differ."""
    return np.maximum(0, np.cos(np.pi * (a != b).mean(axis=-1)))


def bands(bits: np.ndarray) -> np.ndarray:
    """Keys of the bit-sampled bands: (texts x ``BANDS``), each from ``BAND_BITS`` bits."""
    return (bits[:, BAND_PLACES] << np.arange(BAND_BITS)).sum(axis=2, dtype=np.int64)


def to_hex(bits: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` (hex), ``bands`` (keys) of whole texts. Null counts as empty; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                some = batch.slice(at, 400)
                texts = [t or "" for t in some.column(1).to_pylist()]
                bits = fingerprints(texts)
                cols = [some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(to_hex(bits)), pa.array(bands(bits).tolist(), pa.list_(pa.int64()))]
                yield pa.record_batch(cols, ["doc_id", "n_chars", "fingerprint", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string, bands array<long>")


def near_fingerprints(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints that share a band and are alike: ``a, b, likeness`` (a < b), from ``fingerprint, bands``.

    Equal fingerprints are one row here. All pairs of a band's bucket are verified: a bucket is dealt into slices of about
    ``SLICE`` by a hash of the fingerprint, and each two slices meet in a cell of their own, so no task holds a large bucket.
    """
    each = prints.groupBy("fingerprint").agg(F.first("bands").alias("bands")).select("fingerprint", F.posexplode("bands").alias("band", "key"))
    rows = cut(each)
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    dealt = rows.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("fingerprint", F.lit(SEED)), F.col("slices")).cast("int"))
    lower = dealt.select("band", "key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("slices") - 1)).alias("j"), F.col("fingerprint").alias("x"))
    upper = dealt.select("band", "key", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("fingerprint").alias("y"))
    met = lower.join(upper, ["band", "key", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    differ = sum(F.bit_count(F.conv(F.substring("a", i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", i, 8), 16, 10).cast("long"))) for i in range(1, BITS // 4, 8))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    alike = pairs.withColumn("likeness", F.greatest(F.lit(0.0), F.cos(F.lit(np.pi / BITS) * differ))).filter(F.col("likeness") >= least)
    return alike.dropDuplicates(["a", "b"])


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows ``bucket, halo, doc_id, text`` in partitions that hold whole buckets in descending ``doc_id`` order.

    Buckets are ranges of ids at quantiles (a list of ``buckets`` numbers is all the driver sees). The first row of each bucket is
    also in the bucket before it, as ``halo`` 1, and that of the first in the last: so every row's next row is at hand after one
    shuffle of the texts. Null ids come last, rows equal in id are ordered by a hash of their text.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    shares = [k / buckets for k in range(buckets - 1, 0, -1)]
    bounds = keyed.agg(F.percentile_approx("doc_id", shares or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    above = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    placed = keyed.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(above))
    firsts = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("first")).collect()
    firsts = sorted((r["bucket"], r["first"]["h"], r["first"]["doc_id"]) for r in firsts)
    spark = docs.sparkSession
    back = [(b, h, i, firsts[k - 1][0]) for k, (b, h, i) in enumerate(firsts)]  # the first goes to the last
    heads = spark.createDataFrame(back, "b int, fh long, fid long, to int")
    head = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh"))
    twice = F.when(F.col("to").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("halo")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("halo")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("halo")))
    )
    rows = placed.join(F.broadcast(heads), head, "left").select(F.explode(twice).alias("p"), "doc_id", "h", "text").select("p.bucket", "p.halo", "doc_id", "h", "text")
    return rows.repartition(shuffles(docs), "bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), F.desc("h"), "text").drop("h")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they and the next document's are.

    Edited: the last floor(n / 3) code points give way to the first as many (or all) of the next document in descending id order;
    after the last comes the first. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edited_banded`` (do the two share a band). Null texts count as empty. Each row of ``docs`` gives one row; no rows give none.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_banded boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def answer(held: list[tuple]) -> pa.RecordBatch:
        """``held``: rows of one bucket in order, the last of which is only a next row."""
        texts = [t for _, t in held]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, texts[1:], strict=False)]
        bits = fingerprints(texts + edited)
        own, new = bits[: len(texts)], bits[len(texts) :]
        m = len(edited)
        shown = to_hex(bits)
        cols = [
            pa.array([i for i, _ in held[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(shown[:m]),
            pa.array(shown[len(texts) :]),
            pa.array(likeness(own[:-1], new)),
            pa.array(likeness(own[:-1], own[1:])),
            pa.array((bands(own[:-1]) == bands(new)).any(axis=1)),
        ]
        return pa.record_batch(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current, closed = [], 0, None, False
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for bucket, halo, doc_id, text in zip(*(some.column(c).to_pylist() for c in range(4)), strict=True):
                    if bucket != current:
                        if len(held) > 1:
                            yield answer(held)
                        held, size, current, closed = [], 0, bucket, False
                    if closed:
                        continue
                    held.append((doc_id, text))
                    size += len(text)
                    closed = halo == 1
                    if size > 2_000_000 and len(held) > 1:
                        yield answer(held)
                        held, size = held[-1:], len(text)
        if len(held) > 1:
            yield answer(held)

    return with_next(docs, 4 * shuffles(docs)).mapInArrow(run, schema)
