"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwave.llm.common import cut
from barwave.llm.word_tokenizer import KEEP, word_tokenizer

CAPACITY = 2048
SMALLEST_CUT = 256
GROUP_PIECES = 6_000


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT) -> list[int]:
    """Lengths a document of ``n`` tokens is cut into: full sequences, then halves, quarters ... down to ``smallest``, then the rest."""
    out = [capacity] * (n // capacity)
    left, size = n % capacity, capacity // 2
    while size >= smallest and left:
        if left >= size:
            out.append(size)
            left -= size
        size //= 2
    return out + [left] * (left > 0)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, byte_level: bool = True, with_ids: bool = False, keep_words: int = KEEP) -> DataFrame:
    """Pieces of each tokenised document: ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``).

    A document is its text's ids and ``end_id``; null text counts as empty and so gives one piece of one id. Whole texts
    are tokenised, once. Rows equal in id give pieces for each row. Other columns of ``docs`` are ignored.
    A worker remembers the ids of up to twice ``keep_words`` words: fewer take less memory and more time.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer_path, byte_level, keep_words), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = tok.encode(text) + end
                    n, start = len(ids) // 4, 0
                    for k in cuts(n, capacity):
                        part = ids[4 * start : 4 * (start + k)]
                        out.append((doc_id, start, k, zlib.crc32(part), n) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
                        start += k
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names[: len(kinds)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def balance(lengths: np.ndarray, costs: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces come in descending cost.

    There are as many sequences as the tokens need at least. Each piece goes to the sequence of lowest cost that has room
    (the first of equals); a piece that fits nowhere opens another.
    """
    n = len(lengths)
    wide = max(1, -(-int(lengths.sum()) // capacity))
    cost, room = np.zeros(wide + n), np.full(wide + n, capacity)
    cost[wide:] = np.inf  # not open yet
    seq, offset, used = np.zeros(n, np.int64), np.zeros(n, np.int64), wide
    for i in range(n):
        k = int(np.where(room[:used] >= lengths[i], cost[:used], np.inf).argmin())
        if room[k] < lengths[i]:
            k, used = used, used + 1
            cost[k] = 0
        seq[i], offset[i] = k, capacity - room[k]
        room[k] -= lengths[i]
        cost[k] += costs[i]
    return seq, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 6144, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (``length`` at most ``capacity``).

    Cost of a piece: linear * length + quadratic * length^2 (attention does not look across documents). Pieces are dealt
    at random to groups of about ``group_pieces``, so a task holds a bounded number whatever the ids; each group is balanced
    by itself and pads less than one sequence beyond what the packing leaves. Equal costs go by id and start. No pieces: no rows.
    """
    kept = cut(pieces)
    n = kept.count()
    groups = max(1, -(-n // group_pieces))
    dealt = kept.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        length = pdf["length"].to_numpy().astype(float)
        pdf = pdf.assign(cost=linear * length + quadratic * length**2).sort_values(["cost", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        full = pdf["length"].to_numpy() == capacity  # these come first and fill a sequence each
        k = int(full.sum())
        seq, offset = balance(pdf["length"].to_numpy()[k:], pdf["cost"].to_numpy()[k:], capacity)
        base = int(pdf["pack_group"].iloc[0]) << 32
        return pdf.assign(sequence_id=base + np.concatenate([np.arange(k), k + seq]), offset=np.concatenate([np.zeros(k, np.int64), offset])).drop(columns=["cost", "pack_group"])

    return dealt.groupBy("pack_group").applyInPandas(one, kept.schema.add("sequence_id", "long").add("offset", "long"))
