"""Language-model scores from a class-based bigram model whose classes come from exchange clustering."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.llm.common import cut, release

HEAD = 60_000  # commonest words whose class is looked up in memory; all others meet theirs in a join
HEAD_UNITS = 512  # commonest words that start as units of their own
ENDING_UNITS = 512  # all other words start as units of one ending; each then moves by itself
CLASSES = 40
SWEEPS = 4
HELD = 400_000  # distinct words a task holds before it passes them on
CHUNK = 2_000_000  # tokens that are worked on at once
TEXTS = 30_000  # most texts of a chunk; their numbers fit in 15 bits
END_WORD = b" end"  # no word has a space


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower and bytes.split touch ASCII alone."""
    return (text or "").encode("utf-8", "replace").lower().split()


def unit_of(word: bytes, head: dict[bytes, int]) -> int:
    """The unit a word starts from: its rank among the first ``HEAD_UNITS`` words, else one of its ending; the end of a text is the last.

    Each training word then moves by itself (``word_classes``); words that training has not seen stay with their ending.
    """
    rank = head.get(word, HEAD)
    return rank if rank < HEAD_UNITS else HEAD_UNITS + zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % ENDING_UNITS


UNITS = HEAD_UNITS + ENDING_UNITS + 1
END = HEAD + UNITS - 1  # code of the end of a text; codes fit in two bytes


class Codes(dict):
    """Word -> its number in the head, or HEAD plus its unit."""

    def __init__(self, head: dict[bytes, int]):
        super().__init__()
        self.head = head

    def __missing__(self, word: bytes) -> int:
        code = self.head.get(word)
        if code is None:
            code = HEAD + unit_of(word, self.head)
            if len(self) > HELD:
                self.clear()
            if len(word) < 64:
                self[word] = code
        return code


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``c`` of all texts, with a row ``END_WORD`` for the number of texts. Counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                held[END_WORD] += 1
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def packed(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Binary column: of ``values``, the first ``lens[0]`` in the first row, and so on."""
    at = np.concatenate([[0], np.cumsum(lens)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of a binary column, and the row of each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].tobytes() if at[-1] > at[0] else b""
    values = np.frombuffer(data, kind)
    return values, np.repeat(np.arange(len(column)), np.diff(at) // values.itemsize)


def encoded(docs: DataFrame, head: Broadcast) -> DataFrame:
    """Rows of ``docs`` (``doc_id, text, learn``) in chunks of about ``CHUNK`` tokens with one value of ``learn``; written, so that texts are split once.

    ``codes``: an end before the first text and after each; ``rest``: the words outside the head, a space between; ``ids``, ``no_id``: a value a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end = Codes(head.value), np.array([END], np.uint16)
        held = {flag: ([end], [], [], []) for flag in (False, True)}
        sizes = {False: 0, True: 0}

        def flush(flag: bool) -> pa.RecordBatch:
            parts, rest, ids, none = held[flag]
            out = [np.concatenate(parts).tobytes(), b" ".join(rest), np.array(ids, np.int64).tobytes(), np.array(none, np.uint8).tobytes()]
            held[flag], sizes[flag] = ([end], [], [], []), 0
            return pa.record_batch([*[pa.array([x], pa.binary()) for x in out], pa.array([flag])], ["codes", "rest", "ids", "no_id", "learn"])

        for batch in batches:
            for doc_id, text, flag in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = tokens(text)
                code = np.fromiter(map(codes.__getitem__, words), np.uint16, len(words))
                parts, rest, ids, none = held[flag]
                parts += [code, end]
                rest += [words[i] for i in np.flatnonzero(code >= HEAD).tolist()]
                ids.append(doc_id or 0)
                none.append(doc_id is None)
                sizes[flag] += len(words) + 1
                if sizes[flag] > CHUNK or len(ids) == TEXTS:
                    yield flush(flag)
        for flag in held:
            if held[flag][2]:
                yield flush(flag)

    return cut(docs.select("doc_id", "text", "learn").mapInArrow(run, "codes binary, rest binary, ids binary, no_id binary, learn boolean"))


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for batch in batches:
        for x, rest in zip(batch.column("codes"), batch.column("rest"), strict=True):
            yield np.frombuffer(x.as_py(), np.uint16).astype(np.int64), rest.as_py().split()


def is_rest(x: np.ndarray) -> np.ndarray:
    return (x >= HEAD) & (x < END)


def unit_bigrams(texts: DataFrame, unit: np.ndarray) -> np.ndarray:
    """Counts of neighbouring units in all texts (``encoded``), from end to end: a table of ``UNITS`` x ``UNITS``, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for x, _ in read_chunks(batches):
            u = unit[x]
            total += np.bincount(u[:-1] * UNITS + u[1:], minlength=UNITS * UNITS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    pdf = texts.select("codes", "rest").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(UNITS * UNITS)
    out[pdf["pair"].to_numpy(np.int64)] = pdf["n"]
    return out.reshape(UNITS, UNITS)


def h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(b: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: each in turn moves to the class that gives the bigram model the highest likelihood, until none moves.

    The last unit (the end of a text) keeps a class of its own, the last one. Ties go to the lower class.
    """
    units = len(b)
    k = min(classes, units)
    freq = b.sum(0) + b.sum(1)
    cls = np.zeros(units, np.int64)
    cls[np.argsort(-freq, kind="stable")] = np.arange(units) % max(k - 1, 1)
    cls[-1] = k - 1
    one = np.eye(k)[cls]
    n = one.T @ b @ one
    right, left = b @ one, b.T @ one  # by class of the next, of the previous unit

    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-freq[:-1], kind="stable"):
            if not freq[u]:
                break
            c, own = cls[u], b[u, u]
            r, lft = right[u].copy(), left[u].copy()
            r[c] -= own
            lft[c] -= own
            n[c] -= r
            n[:, c] -= lft
            n[c, c] -= own
            rows, cols = n.sum(1), n.sum(0)
            # what a class gains when the unit joins it: its row, its column, the cell of both, and its totals
            gain = (h(n + r[None]) - h(n)).sum(1) + (h(n + lft[:, None]) - h(n)).sum(0)
            d = np.diag(n)
            gain += h(d + r + lft + own) - h(d + r) - h(d + lft) + h(d)
            gain -= h(rows + r.sum() + own) - h(rows) + h(cols + lft.sum() + own) - h(cols)
            best = int(gain[: k - 1].argmax()) if k > 1 else 0
            cls[u] = best
            n[best] += r
            n[:, best] += lft
            n[best, best] += own
            if best != c:
                moved += 1
                right[:, c] -= b[:, u]
                right[:, best] += b[:, u]
                left[:, c] -= b[u]
                left[:, best] += b[u]
        if not moved:
            break
    return cls


def best_classes(near: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for each word, all others as they are.

    ``near`` counts, a word a row, the classes before it and then those after it; ``own`` is its class, ``n`` the counts of class pairs.
    Its own counts are taken out of its class first. The last class is the end's. Ties go to the lower class.
    """
    k = len(n)
    word, j = np.nonzero(near)
    x = near[word, j].astype(float)[:, None]
    base = np.concatenate([n, n.T])[j]
    base[np.arange(len(j)), own[word]] -= x[:, 0]
    np.maximum(base, 0, out=base)
    gain = np.zeros((len(near), k))
    if len(j):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[first]] = np.add.reduceat(h(base + x) - h(base), first, axis=0)
    freq = near[:, k:].sum(1, dtype=float)[:, None]
    for sums in (n.sum(1), n.sum(0)):
        rest = np.maximum(sums[None] - freq * (np.arange(k) == own[:, None]), 0)
        gain -= h(rest + freq) - h(rest)
    return gain[:, : max(k - 1, 1)].argmax(1)


def word_classes(texts: DataFrame, head: Broadcast, words: list[bytes], code_class: np.ndarray, n: np.ndarray) -> DataFrame:
    """``word, code`` (null outside the head), ``c, cls`` of every training word: each moves by the classes beside all its occurrences.

    All words move at once, from the classes of their units (``code_class``, by code) and the class pairs ``n`` of these.
    Tasks send, for each word outside the head, the classes before and after each occurrence, and for words of the head counts by class.
    """
    k = len(n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((2, HEAD * k), np.int64)
        ids, number, beside = {}, [], []

        def flush() -> pa.RecordBatch:
            w, pairs = np.concatenate(number), np.concatenate(beside)
            out = [pa.array(list(ids), pa.binary()), packed(pairs[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(ids))), pa.nulls(len(ids), pa.binary())]
            ids.clear(), number.clear(), beside.clear()
            return pa.record_batch(out, ["word", "beside", "cells"])

        for x, rest in read_chunks(batches):
            cls = code_class[x].astype(np.int64)
            left, right = x[1:] < HEAD, x[:-1] < HEAD
            cells[0] += np.bincount(x[1:][left] * k + cls[:-1][left], minlength=HEAD * k)
            cells[1] += np.bincount(x[:-1][right] * k + cls[1:][right], minlength=HEAD * k)
            at = np.flatnonzero(is_rest(x))
            if len(at):
                number.append(np.fromiter((ids.setdefault(w, len(ids)) for w in rest), np.int64, len(rest)))
                beside.append((cls[at - 1] * 256 + cls[at + 1]).astype(np.uint16))
            if len(ids) > HELD:
                yield flush()
        if ids:
            yield flush()
        both = np.concatenate([cells[0].reshape(HEAD, k), cells[1].reshape(HEAD, k)], 1)
        seen = np.flatnonzero(both.any(1))
        for some in np.array_split(seen, len(seen) // 5000 + 1):
            count = np.full(len(some), 2 * k)
            yield pa.record_batch([pa.array([words[i] for i in some.tolist()], pa.binary()), pa.nulls(len(some), pa.binary()), packed(both[some].astype(np.int32).ravel(), count)], ["word", "beside", "cells"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            names = rows.column(0).take(pa.array(first)).to_pylist()
            group = np.cumsum(np.isin(np.arange(rows.num_rows), first)) - 1
            pairs, row = unpacked(rows.column(1), np.uint16)
            of = group[row] * (2 * k)
            near = np.bincount(of + (pairs >> 8), minlength=len(names) * 2 * k) + np.bincount(of + k + (pairs & 255), minlength=len(names) * 2 * k)
            near = near.reshape(len(names), 2 * k)
            cells, row = unpacked(rows.column(2), np.int32)
            np.add.at(near, group[row[:: 2 * k]], cells.reshape(-1, 2 * k))
            codes = [head.value.get(w) for w in names]
            own = code_class[[HEAD + unit_of(w, head.value) if i is None else i for w, i in zip(names, codes, strict=True)]].astype(np.int64)
            cls = best_classes(near, own, n)
            return pa.record_batch([pa.array(names, pa.binary()), pa.array(codes, pa.int32()), pa.array(near[:, k:].sum(1)), pa.array(cls, pa.int32())], ["word", "code", "c", "cls"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:  # the last word may go on
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            names = batch.column(0)
            first = np.concatenate([[0], np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1])
            if len(first) > 1:
                yield settle(batch.slice(0, int(first[-1])), first[:-1])
            held = batch.slice(int(first[-1]))
        if held is not None:
            yield settle(held, np.zeros(1, np.int64))

    dealt = texts.select("codes", "rest").mapInArrow(send, "word binary, beside binary, cells binary").repartition("word").sortWithinPartitions("word")
    return cut(dealt.mapInArrow(move, "word binary, code int, c long, cls int"))


def rest_rows(x: np.ndarray, words: list[bytes], text: np.ndarray, cls: np.ndarray, chunk: int) -> pa.RecordBatch:
    """Rows ``origin, word, met, sums`` of the words outside the head, one for each word of a chunk.

    ``met`` holds a number for each occurrence: its text in the chunk, its position, the classes before and after it, ``OPEN`` where that
    neighbour is outside the head too. ``origin`` is the chunk and the class that the word has if training has not seen it.
    """
    at = np.flatnonzero(is_rest(x))
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    near = np.where(is_rest(x), OPEN, cls)
    met = (text << 48) + (at << 16) + (near[at - 1] << 8) + near[at + 1]
    order = np.argsort(number, kind="stable")
    count = np.bincount(number, minlength=len(ids))
    start = np.zeros(len(ids), np.int64)
    start[number] = cls[at]
    return pa.record_batch([pa.array(chunk * JOINT + start), pa.array(list(ids), pa.binary()), packed(met[order].astype(np.uint64), count), pa.nulls(len(ids), pa.binary())], MET_NAMES)


OPEN = 255
JOINT = 64  # classes are below; two classes as one number: left * JOINT + right
MET = "origin long, word binary, met binary, sums binary"
MET_NAMES = [f.split()[0] for f in MET.split(", ")]


class Met:
    """Occurrences in rows of ``rest_rows`` that were joined with ``c`` and ``cls``: ``row``, its place in the batch; classes before, of it, and after."""

    def __init__(self, rows: pa.RecordBatch):
        met, self.row = unpacked(rows.column("met"), np.uint64)
        met = met.astype(np.int64)
        origin = rows.column("origin").to_numpy()
        given = rows.column("cls")
        cls = np.where(given.is_valid().to_numpy(zero_copy_only=False), given.fill_null(0).to_numpy(), origin % JOINT).astype(np.int64)
        chunk = (origin // JOINT)[self.row]
        self.cls, self.text, at = cls[self.row], (chunk << 16) + (met >> 48), (chunk << 32) + ((met >> 16) & 0xFFFFFFFF)
        self.before, self.after = (met >> 8) & 255, met & 255
        left, right = self.after == OPEN, self.before == OPEN
        # where two words outside the head meet, both rows hold the joint: the position of its left word
        self.joint = np.concatenate([at[left], at[right] - 1])
        self.joint_text = np.concatenate([self.text[left], self.text[right]])
        self.code = np.concatenate([self.cls[left] * JOINT, self.cls[right]])

    def known(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences, left and right classes of the pairs with a word of the head, or an end."""
        yield (at := np.flatnonzero(self.before != OPEN)), self.before[at], self.cls[at]
        yield (at := np.flatnonzero(self.after != OPEN)), self.cls[at], self.after[at]


def next_chunk() -> Iterator[int]:
    """Numbers of a task's chunks, which no other task uses."""
    return itertools.count(TaskContext.get().partitionId() << 14)


def class_pairs(texts: DataFrame, classes: DataFrame, code_class: np.ndarray, k: int) -> np.ndarray:
    """Counts of neighbouring classes in all texts (``encoded``), each word in its own class."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for chunk, (x, words) in zip(next_chunk(), read_chunks(batches)):
            cls, known = code_class[x].astype(np.int64), ~is_rest(x)
            both = known[:-1] & known[1:]
            total += np.bincount((cls[:-1] * k + cls[1:])[both], minlength=k * k)
            yield rest_rows(x, words, np.zeros(len(words), np.int64), cls, chunk)
        yield pa.record_batch([pa.array([0]), pa.array([b" "], pa.binary()), pa.nulls(1, pa.binary()), packed(total, np.array([k * k]))], MET_NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for rows in batches:
            met = Met(rows)
            for _, left, right in met.known():
                total += np.bincount(left * k + right, minlength=k * k)
            total += unpacked(rows.column("sums"), np.int64)[0].reshape(-1, k * k).sum(0)
            yield pa.record_batch([pa.array(met.joint), pa.array(met.code), pa.array(np.zeros(len(met.joint), np.int64))], ["joint", "code", "n"])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(-1 - (at // k * JOINT + at % k)), pa.array(at // k * JOINT + at % k), pa.array(total[at])], ["joint", "code", "n"])

    rows = texts.select("codes", "rest").mapInArrow(split, MET).join(classes.select("word", "cls"), "word", "left").drop("word")
    # negative joints are counts of pairs, not joints
    found = rows.mapInArrow(add, "joint long, code long, n long").groupBy("joint").agg(F.sum("code").alias("code"), F.max("code").alias("pair"), F.sum("n").alias("n"))
    pair = F.when(F.col("joint") < 0, F.col("pair")).otherwise(F.col("code")).alias("pair")
    pdf = found.groupBy(pair).agg(F.sum(F.when(F.col("joint") < 0, F.col("n")).otherwise(1)).alias("n")).toPandas()
    out, code = np.zeros((k, k)), pdf["pair"].to_numpy(np.int64)
    out[code // JOINT, code % JOINT] = pdf["n"]
    return out


def score(docs: DataFrame, training: DataFrame | Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (``doc_id, text``).

    Learnt from ``training`` (``text``), or, if that is a condition, from the rows of ``docs`` that meet it, which are then split into words once less.

    Base: each token's log10((c + 0.5) / (N + 0.5 (V + 1))). Model: log10 P(class | class before) P(word | class); a class gives its
    words (c + 0.5) / (n + 0.5 (v + 1)) with n tokens and v words of its own, which leaves one share for words not seen; transitions are
    mixed with the classes' frequencies. A text starts after an end and its end is a token, so null and empty texts have one token.

    Classes: units (the commonest words, endings) are exchanged one after the other; then every training word moves by itself, by the
    classes beside all its occurrences. A word that training has not seen has the class its ending started from.

    Counts and classes cover all training texts and grow with them; what the driver sees is bounded: the ``HEAD`` commonest words, the
    unit table and class pairs. All other words of a text meet their counts and classes in a join, once for each text and word. Rows are told apart by
    their place, so ids may be null or repeat. Without training texts N is 0 and every token scores log10(0.5 / 0.5 (0 + 1)) = 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", (F.coalesce(training, F.lit(False)) if isinstance(training, Column) else F.lit(False)).alias("learn"))
    taught = docs.filter("learn") if isinstance(training, Column) else training.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("learn"))
    counts = cut(word_counts(taught))
    head_rows = counts.filter(F.col("word") != F.lit(END_WORD)).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    words = [bytes(r["word"]) for r in head_rows]
    head = {w: i for i, w in enumerate(words)}
    n_end = sum(r["c"] for r in counts.filter(F.col("word") == F.lit(END_WORD)).collect())
    del counts
    release(spark)
    shared = spark.sparkContext.broadcast(head)
    asked = encoded(docs, shared)
    texts = asked.filter("learn") if isinstance(training, Column) else encoded(taught, shared)
    unit = np.concatenate([[unit_of(w, head) for w in words], np.zeros(HEAD - len(words)), np.arange(UNITS)]).astype(np.int64)
    table = unit_bigrams(texts, unit)
    cls = exchange(table)
    k = int(cls.max()) + 1
    one = np.eye(k)[cls]
    code_class = cls[unit].astype(np.uint8)
    classes = word_classes(texts, shared, words, code_class, one.T @ table @ one)
    release(spark)
    found = classes.filter("code is not null").select("code", "cls").toPandas()
    code_class[found["code"].to_numpy(np.int64)] = found["cls"]
    pairs = class_pairs(texts, classes, code_class, k)
    del texts
    release(spark)
    sums = classes.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    n_class, v_class = np.zeros(k), np.zeros(k)
    n_class[sums["cls"].to_numpy(np.int64)], v_class[sums["cls"].to_numpy(np.int64)] = sums["n"], sums["v"]
    end_known = int(n_end > 0)
    n_class[k - 1], v_class[k - 1] = n_class[k - 1] + n_end, v_class[k - 1] + end_known
    total, distinct = int(n_class.sum()), int(v_class.sum())
    prior = (n_class + 0.5) / (n_class.sum() + 0.5 * k)
    trans = np.log10((pairs + prior[None]) / (pairs.sum(1, keepdims=True) + 1))
    spread = np.log10(n_class + 0.5 * (v_class + 1))
    log_count = np.zeros(HEAD + UNITS)
    flat = float(np.log10(total + 0.5 * (distinct + 1)))
    log_count[: len(words)] = np.log10(np.array([r["c"] for r in head_rows], float) + 0.5) - flat
    log_count[END] = np.log10(n_end + 0.5) - flat
    tables = spark.sparkContext.broadcast((code_class, log_count, trans, spread))

    def per_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lc, tr, sp = tables.value
        rows = (row for batch in batches for row in zip(*[batch.column(c) for c in ("codes", "rest", "ids", "no_id")], strict=True))
        for chunk, row in zip(next_chunk(), rows):
            codes, rest, ids, none = (v.as_py() for v in row)
            x, m = np.frombuffer(codes, np.uint16).astype(np.int64), len(none)
            c, known = of[x].astype(np.int64), ~is_rest(x)
            text = np.cumsum(x == END)[:-1] - 1  # of each token but the first end
            local = np.where(known[:-1] & known[1:], tr[c[:-1], c[1:]], 0) - np.where(known[1:], sp[c[1:]], 0)
            n_tokens, n_known = np.bincount(text, minlength=m), np.bincount(text[known[1:]], minlength=m) - 1 + end_known
            numbers = [np.arange(m), np.frombuffer(ids, np.int64), np.frombuffer(none, np.uint8), n_tokens, n_known]
            floats = [np.bincount(text, lc[x[1:]], m), np.bincount(text, local, m)]
            sums = np.stack([*[v.astype(np.int64) for v in numbers], *[v.view(np.int64) for v in floats]], 1)
            parts = np.array_split(sums, m // 500 + 1)
            names = pa.array([b" %d %d" % (chunk, i) for i in range(len(parts))], pa.binary())
            yield pa.record_batch([pa.array(np.full(len(parts), chunk * JOINT)), names, pa.nulls(len(parts), pa.binary()), packed(sums.ravel(), np.array([p.size for p in parts]))], MET_NAMES)
            found = rest_rows(x, rest.split(), text[~known[1:]], c, chunk)
            for i in range(0, found.num_rows, 50_000):
                yield found.slice(i, 50_000)

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, tr, sp = tables.value
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            text, known, log_c, local = (np.concatenate(v) for v in zip(*held, strict=True))
            rows, of = np.unique(text, return_inverse=True)
            m = len(rows)
            sums = [pa.array(np.bincount(of, known, m).astype(np.int64)), pa.array(np.bincount(of, log_c, m)), pa.array(np.bincount(of, local, m))]
            return pa.record_batch([pa.array(rows), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, np.int64)), *sums, pa.array(np.zeros(m, np.int64))], names)

        for rows in batches:
            met = Met(rows)
            c = rows.column("c").fill_null(0).to_numpy()[met.row]
            local = -sp[met.cls]
            for at, left, right in met.known():
                local[at] += tr[left, right]
            if len(c):
                held.append((met.text, c > 0, np.log10(c + 0.5) - flat, local))
                n += len(c)
            if n > 1_000_000:
                yield flush()
                held, n = [], 0
            m = len(met.joint)
            zero, none = pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m))
            yield pa.record_batch([pa.array(met.joint_text), pa.nulls(m, pa.int64()), pa.array(met.joint), zero, zero, none, none, pa.array(met.code)], names)
            sums, row = unpacked(rows.column("sums"), np.int64)
            if len(sums):
                sums, chunk = sums.reshape(-1, 7), (rows.column("origin").to_numpy() // JOINT)[row[::7]]
                number, doc_id, none, n_tokens, n_known, log_c, local = np.ascontiguousarray(sums.T)
                cols = [pa.array((chunk << 16) + number), pa.array(doc_id, mask=none > 0), pa.nulls(len(sums), pa.int64()), pa.array(n_tokens), pa.array(n_known)]
                yield pa.record_batch([*cols, pa.array(log_c.view(float)), pa.array(local.view(float)), pa.array(np.zeros(len(sums), np.int64))], names)
        if held:
            yield flush()

    schema = "row long, doc_id long, joint long, n_tokens long, n_known long, log_c double, local double, code long"
    names = [f.split()[0] for f in schema.split(", ")]
    met = asked.drop("learn").mapInArrow(per_chunk, MET).join(classes.select("word", "c", "cls"), "word", "left").drop("word")
    met = met.mapInArrow(per_text, schema).repartition("row")
    met = met.groupBy("row", "joint").agg(F.max("doc_id").alias("doc_id"), *[F.sum(name).alias(name) for name in names[3:]])
    code = np.arange(JOINT * k)[np.arange(JOINT * k) % JOINT < k]
    step = F.broadcast(spark.createDataFrame([(int(i), float(trans[i // JOINT, i % JOINT])) for i in code], "code long, step double"))
    return (
        met.join(step, "code", "left")
        .withColumn("local", F.when(F.col("joint").isNull(), F.col("local")).otherwise(F.col("step")))
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), *[F.sum(name).alias(name) for name in names[3:-1]])
        .select(
            "doc_id",
            "n_tokens",
            "n_known",
            F.lit(total).cast("long").alias("train_tokens"),
            F.col("log_c").alias("base_score"),
            (F.col("log_c") + F.col("n_tokens") * flat + F.col("local")).alias("score"),
        )
    )
