"""Token ids on disk as wavelet matrices: one compressed payload a shard, with access, counting and occurrence lookup."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwave.llm.common import broadcast_if_small, shuffles
from barwave.llm.word_tokenizer import word_tokenizer

MAGIC = b"WVM1"
BLOCK = 512  # bits between two entries of the rank directory
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """Bit-planes of a sequence, top bit first; each plane orders zeros before ones for the next."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (seq & seq.dtype.type(1 << k)) != 0
            plane = np.packbits(one, bitorder="little")
            planes.append(plane)
            ranks.append(directory(plane))
            low = seq[~one]
            zeros.append(len(low))
            seq = np.concatenate([low, seq[one]])
        return cls(len(ids), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        """Magic, length, planes; then zstd of: zeros of each plane, rank directories, planes."""
        body = b"".join([np.array(self.zeros, "<u4").tobytes(), *(r.astype("<u4").tobytes() for r in self.ranks), *(p.tobytes() for p in self.planes)])
        return MAGIC + struct.pack("<IB", self.n, len(self.planes)) + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack("<IB", raw[4:9])
        body = zstandard.ZstdDecompressor().decompress(raw[9:])
        width, entries = -(-n // 8), -(-n // BLOCK) + 1
        zeros = np.frombuffer(body, "<u4", bits).tolist()
        at = 4 * bits
        ranks = [np.frombuffer(body, "<u4", entries, at + 4 * entries * k) for k in range(bits)]
        at += 4 * entries * bits
        return cls(n, [np.frombuffer(body, np.uint8, width, at + width * k) for k in range(bits)], zeros, ranks)

    def rank1(self, plane: int, i: int) -> int:
        """Ones before position ``i``."""
        block = i // BLOCK
        count, at = int(self.ranks[plane][block]), block * BLOCK
        if i > at:
            count += int(np.unpackbits(self.planes[plane][at // 8 : -(-i // 8)], bitorder="little")[: i - at].sum())
        return count

    def access(self, i: int) -> int:
        value = 0
        for p in range(len(self.planes)):
            one = self.planes[p][i >> 3] >> (i & 7) & 1
            value = value << 1 | int(one)
            i = self.zeros[p] + self.rank1(p, i) if one else i - self.rank1(p, i)
        return value

    def span(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` in [lo, hi) stand below the last plane."""
        if value >> len(self.planes):
            return 0, 0
        for p in range(len(self.planes)):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            one = value >> (len(self.planes) - 1 - p) & 1
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.span(value, lo, self.n if hi is None else hi)
        return b - a

    def positions(self, value: int) -> np.ndarray:
        """All positions of ``value``, ascending: those below the last plane, carried up by select."""
        lo, hi = self.span(value, 0, self.n)
        at = np.arange(lo, hi)
        for p in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").astype(bool)
            is_one = value >> (len(self.planes) - 1 - p) & 1
            at = np.flatnonzero(one)[at - self.zeros[p]] if is_one else np.flatnonzero(~one)[at]
        return at

    def select(self, value: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``value``; -1 if there are not as many."""
        at = self.positions(value)
        return int(at[k]) if 0 <= k < len(at) else -1

    def decode(self) -> np.ndarray:
        """The whole sequence: undo the planes from the last to the first."""
        seq = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(seq)
            up[~one] = seq[: self.zeros[p]]
            up[one] = seq[self.zeros[p] :] | seq.dtype.type(1 << (len(self.planes) - 1 - p))
            seq = up
        return seq


def directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block, and in all, of a plane."""
    ones = np.bitwise_count(plane).astype(np.uint32)
    pad = -len(ones) % (BLOCK // 8)
    per = np.pad(ones, (0, pad)).reshape(-1, BLOCK // 8).sum(axis=1) if len(ones) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, byte_level: bool = False, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Tokenise ``docs`` in ascending ``doc_id`` order (null last, equal ids by text) and write shards under ``path``.

    One range shuffle of the texts; a partition streams its rows into shards of ``shard_tokens`` ids or, for a longer
    document, more (a document stays in one shard). Each row written: part, shard (both ascending in doc_id order), n,
    doc_ids, lengths, payload (a wavelet matrix). Null and empty texts give the end id alone. Empty table: no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, part = word_tokenizer(tokenizer_path, byte_level), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        doc_ids, ids, held, shard = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            payload = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4")).to_bytes()
            cols = [[part], [shard], [sum(lengths)], [doc_ids], [lengths], [payload]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, KINDS.values(), strict=True)], list(KINDS))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(tok.encode(text) + end)
                    held += len(ids[-1]) // 4
                    if held >= shard_tokens:
                        yield flush()
                        doc_ids, ids, held, shard = [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    KINDS = {"part": pa.int32(), "shard": pa.int32(), "n": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "payload": pa.binary()}
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions or shuffles(docs), *order[:1]).sortWithinPartitions(*order)
    shards = rows.mapInArrow(run, "part int, shard int, n long, doc_ids array<long>, lengths array<int>, payload binary")
    shards.write.mode("overwrite").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards under ``path``."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, shard, doc_ids, lengths, payload = (batch.column(c)[k].as_py() for c in range(5))
                ids = WaveletMatrix.from_bytes(payload).decode().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                m = len(doc_ids)
                cols = [pa.array(c, t) for c, t in (([part] * m, pa.int32()), ([shard] * m, pa.int32()), (doc_ids, pa.int64()), (starts, pa.int64()), (lengths, pa.int64()), (crc, pa.int64()))]
                yield pa.record_batch(cols, ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    read = shards.select("part", "shard", "doc_ids", "lengths", "payload").mapInArrow(run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.select("part", "shard", "n")
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    starts = sums.join(broadcast_if_small(parts), "part").select(
        "part", "shard", (F.col("part_start") + F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("shard")), F.lit(0))).alias("shard_start")
    )
    return read.join(broadcast_if_small(starts), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Each place of ``token``: part, shard, position in the shard. Shards are searched, not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = WaveletMatrix.from_bytes(batch.column(2)[k].as_py()).positions(token)
                m = len(at)
                yield pa.record_batch([pa.array([batch.column(0)[k].as_py()] * m, pa.int32()), pa.array([batch.column(1)[k].as_py()] * m, pa.int32()), pa.array(at, pa.int64())], ["part", "shard", "position"])

    return spark.read.parquet(path).select("part", "shard", "payload").mapInArrow(run, "part int, shard int, position long")
