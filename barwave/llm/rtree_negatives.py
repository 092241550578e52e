"""Hard negatives by exact inner-product search in an STR-packed R-tree whose shelves are dealt out over the cluster."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.llm.common import cut, shuffles

SHELF = 2048  # rows of one packed part of the tree
ANCHORS = 256  # anchors searched together
LEAF, FAN = 32, 8  # rows of a leaf, leaves of a node
SAMPLE = 4096  # rows, about, from which the two coordinates of the outer tiles and their borders are taken
DIRECTORY = 4096  # boxes of shelves, about, held by the driver and sent to tasks at a time
SHELF_SCHEMA = "dims int, label_lo long, label_hi long, box binary, ids binary, labels binary, rows binary, kind string, vectors binary"
FOUND_SCHEMA = "anchor_row long, want int, k int, score long, vec_id long"
WANT = "struct<i:int,want:int,k:int,lo:long,hi:long,kth:long,kth_id:long>"


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` and ``b`` as exact longs."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products must fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``q`` with any point of each box: coordinate by coordinate, then summed."""
    above, below = np.maximum(q, 0), np.minimum(q, 0)
    return dots(above, low) + dots(below, high), dots(above, high) + dots(below, low)


def tile_order(labels: np.ndarray, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order: by label, slabs of the coordinate that varies most, the next coordinate in a slab, then id."""
    m, dims = v.shape
    if not dims:
        return np.lexsort((ids, labels))
    by_spread = np.argsort(-v.astype(np.float64).var(axis=0), kind="stable")
    first, second = v[:, by_spread[0]], v[:, by_spread[min(1, dims - 1)]]
    place = np.empty(m, np.int64)
    place[np.lexsort((ids, first))] = np.arange(m)
    slab = place // (LEAF * math.ceil(math.sqrt(math.ceil(m / LEAF))))
    return np.lexsort((ids, second, slab, labels))


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, rows, vectors) of up to ``size`` rows of one length, in the order read."""
    held: list[tuple] = []
    n = 0
    for batch in batches:
        ids, labels, rows, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "row", "dims"))
        flat, at = batch.column("vec").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)]).astype(np.int64)
        start = 0
        while start < len(ids):
            same = np.nonzero(dims[start:] != dims[start])[0]
            if held and held[0][3].shape[1] != dims[start]:
                yield tuple(np.concatenate(part) for part in zip(*held, strict=True))
                held, n = [], 0
            stop = min(start + (int(same[0]) if len(same) else len(ids) - start), start + size - n)
            held.append((ids[start:stop], labels[start:stop], rows[start:stop], flat[at[start] : at[stop]].reshape(stop - start, int(dims[start]))))
            n, start = n + stop - start, stop
            if n == size:
                yield tuple(np.concatenate(part) for part in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held, strict=True))


def packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, rows, v in runs(batches, size):
            order = tile_order(labels, ids, v)
            ids, labels, rows, v = ids[order], labels[order], rows[order], v[order]
            most = int(np.abs(v).max(initial=0))
            kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
            box = np.stack([v.min(axis=0), v.max(axis=0)]).astype(np.int64)
            row = [v.shape[1], int(labels.min()), int(labels.max()), box.tobytes(), ids.tobytes(), labels.tobytes(), rows.tobytes(), kind, v.astype(kind).tobytes()]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in SHELF_SCHEMA.split(", ")])

    return pack


class Tree:
    """One shelf: rows in tile order, boxes of leaves and of nodes over leaves."""

    def __init__(self, dims: int, ids: bytes, labels: bytes, rows: bytes, kind: str, vectors: bytes):
        self.ids, self.labels, self.rows = (np.frombuffer(x, np.int64) for x in (ids, labels, rows))
        self.v = np.frombuffer(vectors, kind).reshape(len(self.ids), dims).astype(np.int64)
        self.starts = np.arange(0, len(self.ids), LEAF)
        self.leaves = self.boxes(self.starts, self.v, self.v, self.labels, self.labels, self.ids)
        self.nodes = self.boxes(np.arange(0, len(self.starts), FAN), *self.leaves)

    @staticmethod
    def boxes(starts: np.ndarray, low: np.ndarray, high: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray, least: np.ndarray) -> tuple:
        return (
            np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0),
            np.minimum.reduceat(label_lo, starts), np.maximum.reduceat(label_hi, starts), np.minimum.reduceat(least, starts),
        )


class Want:
    """The best ``k`` of the rows with a score from ``low`` to ``high``; a candidate is (score, -id)."""

    def __init__(self, want: dict):
        self.want, self.k = want["want"], want["k"]
        self.low, self.high = (s * math.inf if want[c] is None else want[c] for c, s in (("lo", -1), ("hi", 1)))
        self.floor = None if want["kth"] is None else (want["kth"], -want["kth_id"])
        self.bar: tuple[int, int] | None = None
        self.best: list[tuple[int, int]] = []

    def needs(self, least: int, most: int, least_id: int) -> bool:
        """Whether a box with scores from ``least`` to ``most`` may hold one of the best: it meets the window and isn't below the kth."""
        return least <= self.high and most >= self.low and self.takes(min(most, self.high), least_id)

    def takes(self, score: float, vec_id: int) -> bool:
        """Not below the kth of an earlier visit, and above the kth of this one."""
        return (self.floor is None or (score, -vec_id) >= self.floor) and (self.bar is None or (score, -vec_id) > self.bar)

    def lowest(self) -> float:
        """The least score that may still count."""
        return max(self.low, -math.inf if self.floor is None else self.floor[0], -math.inf if self.bar is None else self.bar[0])

    def offer(self, score: int, vec_id: int) -> None:
        if not (self.low <= score <= self.high and self.takes(score, vec_id)):
            return
        heapq.heappush(self.best, (score, -vec_id))
        if len(self.best) > self.k:
            heapq.heappop(self.best)
        if len(self.best) == self.k:
            self.bar = self.best[0]


class Scores:
    """Scores of all anchors held and the rows of a node, worked out when the first anchor opens the node."""

    def __init__(self, tree: Tree, q: np.ndarray):
        self.tree, self.q, self.known = tree, q, {}

    def of(self, i: int, node: int) -> np.ndarray:
        if node not in self.known:
            self.known[node] = dots(self.q, self.tree.v[node * LEAF * FAN : (node + 1) * LEAF * FAN])
        return self.known[node][i]


def best_first(tree: Tree, i: int, label: int, row: int, same_label: bool, wants: list[Want], bounds: list[tuple[np.ndarray, np.ndarray]], scores: Scores) -> None:
    """Nodes in the order of their greatest score; nodes and leaves that no want needs are left out, also once they are reached."""

    def right(level: tuple) -> np.ndarray:
        return (level[2] <= label) & (label <= level[3]) if same_label else ~((level[2] == label) & (level[3] == label))

    least, most, first_ids = bounds[0][0][i].tolist(), bounds[0][1][i].tolist(), tree.nodes[4].tolist()
    leaf_least, leaf_most, leaf_right = bounds[1][0][i], bounds[1][1][i], right(tree.leaves)
    queue = [(-most[at], at) for at in np.nonzero(right(tree.nodes))[0].tolist()]
    heapq.heapify(queue)
    while queue:
        _, at = heapq.heappop(queue)
        needy = [w for w in wants if w.needs(least[at], most[at], first_ids[at])]
        if not needy:
            continue
        low, high = min(w.lowest() for w in needy), max(w.high for w in needy)
        leaves = slice(at * FAN, (at + 1) * FAN)
        open_ = leaf_right[leaves] & (leaf_least[leaves] <= high) & (leaf_most[leaves] >= low)
        if not open_.any():
            continue
        part = slice(at * FAN * LEAF, (at + 1) * FAN * LEAF)
        got = scores.of(i, at)
        fits = np.repeat(open_, LEAF)[: len(got)] & (got >= low) & (got <= high) & ((tree.labels[part] == label) == same_label)
        for j in np.nonzero(fits)[0].tolist():
            if tree.rows[part][j] != row:
                for w in needy:
                    w.offer(int(got[j]), int(tree.ids[part][j]))


def visitor(same_label: bool):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row is anchors and a shelf: the best rows of the shelf for each want of each anchor."""
        for batch in batches:
            for pair in range(batch.num_rows):
                r = {c: batch.column(c)[pair].as_py() for c in batch.schema.names}
                tree = Tree(*(r[c] for c in ("dims", "ids", "labels", "rows", "kind", "vectors")))
                labels, rows = (np.frombuffer(r[c], np.int64) for c in ("q_labels", "q_rows"))
                q = np.frombuffer(r["q_vectors"], r["q_kind"]).reshape(len(rows), r["dims"]).astype(np.int64)
                bounds = [intervals(q, level[0], level[1]) for level in (tree.nodes, tree.leaves)]
                scores = Scores(tree, q)
                wants: dict[int, list[Want]] = {}
                for w in r["wants"]:
                    wants.setdefault(w["i"], []).append(Want(w))
                out: list[tuple] = []
                for i, mine in wants.items():
                    best_first(tree, i, int(labels[i]), int(rows[i]), same_label, mine, bounds, scores)
                    out += [(int(rows[i]), w.want, w.k, score, -vec_id) for w in mine for score, vec_id in w.best]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_row", "want", "k", "score", "vec_id"])

    return visit


def chooser(directory: list[tuple], same_label: bool, first: bool):
    """Which shelves of ``directory`` anchors must visit: first the one shelf a query likes best, then all others that a want needs."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                labels = np.frombuffer(r["q_labels"], np.int64)
                q = np.frombuffer(r["q_vectors"], r["q_kind"]).reshape(len(labels), r["dims"]).astype(np.int64)
                shelves = [s for s in directory if s[1] == r["dims"]]
                chosen: set[int] = set()
                if shelves and r["wants"]:
                    boxes = np.stack([np.frombuffer(s[4], np.int64).reshape(2, r["dims"]) for s in shelves])
                    least, most = intervals(q, boxes[:, 0], boxes[:, 1])
                    low, high = np.array([s[2] for s in shelves]), np.array([s[3] for s in shelves])
                    wants: dict[int, list[Want]] = {}
                    for w in r["wants"]:
                        wants.setdefault(w["i"], []).append(Want(w))
                    for i, mine in wants.items():
                        may = (low <= labels[i]) & (labels[i] <= high) if same_label else ~((low == labels[i]) & (high == labels[i]))
                        may &= np.any([(least[i] <= w.high) & (most[i] >= w.low) for w in mine], axis=0)
                        if may.any():
                            top = max(w.high for w in mine)
                            liking = most[i] if top == math.inf else -np.abs((least[i] + most[i]) / 2 - top)
                            liked = int(np.argmax(np.where(may, liking, -np.inf)))
                            if first:
                                chosen.add(liked)
                            else:
                                chosen.update(j for j in np.nonzero(may)[0].tolist() if any(least[i, j] <= w.high and most[i, j] >= w.low and (w.floor is None or min(int(most[i, j]), w.high) >= w.floor[0]) for w in mine))
                yield pa.RecordBatch.from_arrays([pa.array([r["q_shelf"]] * len(chosen), pa.int64()), pa.array([shelves[j][0] for j in sorted(chosen)], pa.int64())], names=["q_shelf", "shelf"])

    return choose


def shelve(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (``vec_id, label, vec, dims, row``) packed into shelves of up to ``size``, each with its box and a number, ``shelf``.

    The outer tiles are ranges of (length, label, slab of one coordinate, another coordinate, id); the coordinates and slab
    borders come from about ``SAMPLE`` rows. Equal vectors are told apart by id, so any number of them is dealt out.
    """
    n = rows.count()
    tiles = max(1, math.ceil(n / size))
    part = F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, SAMPLE / max(1, n)))
    sample = [r["vec"] for r in rows.filter(part).select("vec").collect()]
    dims = max((len(v) for v in sample), default=0)
    spread = [float(np.var([float(v[c]) for v in sample if len(v) > c])) for c in range(dims)]
    a, b = ([*np.argsort(-np.array(spread), kind="stable").tolist(), 0, 0][:2]) if dims else (0, 0)
    values = sorted(v[a] for v in sample if len(v) > a)
    slabs = math.ceil(math.sqrt(tiles))
    borders = sorted({values[len(values) * s // slabs] for s in range(1, slabs)}) if values else []
    slab = F.lit(0)
    for x in borders[:256]:
        slab = slab + F.when(F.get("vec", F.lit(a)) >= x, 1).otherwise(0)
    order = ["dims", "label", "slab", "next", "vec_id", "row"]
    packed = rows.withColumns({"slab": slab, "next": F.get("vec", F.lit(b))}).repartitionByRange(tiles, *order).sortWithinPartitions(*order).coalesce(tiles).select("vec_id", "label", "row", "dims", "vec").mapInArrow(packer(size), SHELF_SCHEMA)
    return cut(packed.withColumn("shelf", F.monotonically_increasing_id()))


def visits(queries: DataFrame, shelves: DataFrame, same_label: bool, first: bool) -> DataFrame:
    """What anchors find in the shelves of this round."""
    boxes = cut(shelves.select("shelf", "dims", "label_lo", "label_hi", "box"))
    parts = math.ceil(boxes.count() / DIRECTORY) or 1
    pairs = None
    for part in range(parts):
        directory = [tuple(r) for r in boxes.filter(F.pmod(F.xxhash64("shelf"), F.lit(parts)) == part).collect()]
        some = queries.mapInArrow(chooser(directory, same_label, first), "q_shelf long, shelf long")
        pairs = some if pairs is None else pairs.unionByName(some)
    both = cut(pairs).join(queries.drop("dims"), "q_shelf").join(shelves, "shelf")
    spread = both.repartition(shuffles(both), "q_shelf", "shelf")
    return cut(spread.mapInArrow(visitor(same_label), FOUND_SCHEMA))


def best(found: DataFrame) -> DataFrame:
    """The first k of each want: higher scores, then smaller ids; ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor_row", "want").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter("rank <= k")


def search(anchors: DataFrame, shelves: DataFrame, wants: DataFrame, same_label: bool) -> DataFrame:
    """The best rows of all shelves for ``wants`` (``q_shelf, i, want, k, lo, hi``, and the anchor's ``row``), exactly.

    Every anchor visits the shelf it likes best first; the kth score found there keeps shelves, nodes and leaves below it out of the second visit, which finds all of the result.
    """
    if wants.isEmpty():
        return anchors.sparkSession.createDataFrame([], FOUND_SCHEMA + ", rank int")

    def asked(w: DataFrame) -> DataFrame:
        listed = w.groupBy("q_shelf").agg(F.collect_list(F.struct("i", "want", "k", "lo", "hi", "kth", "kth_id").cast(WANT)).alias("wants"))
        return anchors.join(listed, "q_shelf")

    none = F.lit(None).cast("long")
    seen = visits(cut(asked(wants.withColumns({"kth": none, "kth_id": none}))), shelves, same_label, first=True)
    bars = best(seen).filter("rank = k").select(F.col("anchor_row").alias("row"), "want", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    # the kth itself is found again: its shelf isn't below the bar
    rest = visits(cut(asked(wants.join(bars, ["row", "want"], "left"))), shelves, same_label, first=False)
    return best(rest)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shelf: int = SHELF, anchors_at_once: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors`` (``vec_id, label, vec`` of longs).

    Scores are inner products; higher come first, ties by smaller id. An anchor's positives are its first ``positives`` other
    rows of its label; for each, the first ``negatives`` rows of another label with ``low`` * positive <= 100 * negative <= ``high`` * positive
    are returned. The search is exact: an R-tree packed sort-tile-recursively over all rows, cut into shelves; anchors visit
    only shelves, nodes and leaves whose interval of possible scores meets a window and isn't below the kth best.

    Rows with a null id, label, vector or component take no part. Vectors are compared with those of their own length. Rows that repeat
    an id are rows of their own. Scores must fit a long, else the job fails. Few positives or negatives: all; none: no row. Empty table: no rows.
    """
    whole = vectors.filter("vec_id is not null and label is not null and vec is not null").filter(F.forall("vec", lambda x: x.isNotNull()))
    rows = cut(whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"), F.size("vec").alias("dims"), is_anchor.alias("is_anchor"), F.monotonically_increasing_id().alias("row")))
    shelves = shelve(rows.drop("is_anchor"), shelf)
    packed = shelve(rows.filter("is_anchor").drop("is_anchor"), anchors_at_once)
    anchors = packed.select(F.col("shelf").alias("q_shelf"), "dims", F.col("labels").alias("q_labels"), F.col("rows").alias("q_rows"), F.col("kind").alias("q_kind"), F.col("vectors").alias("q_vectors"))
    places = cut(packed.select("shelf", "rows").mapInArrow(placed, "q_shelf long, i int, row long"))
    none = F.lit(None).cast("long")
    near = cut(search(anchors, shelves, places.withColumns({"want": F.lit(0), "k": F.lit(positives), "lo": none, "hi": none}), same_label=True))
    near = near.select(F.col("anchor_row").alias("row"), F.col("rank").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    lower, upper = F.col("positive_score") * low, F.col("positive_score") * high
    window = near.withColumns({"lo": ((lower + F.pmod(-lower, F.lit(100))) / 100).cast("long"), "hi": ((upper - F.pmod(upper, F.lit(100))) / 100).cast("long")}).filter("lo <= hi")
    wants = cut(places.join(window, "row").select("q_shelf", "i", "row", "want", F.lit(negatives).alias("k"), "lo", "hi"))
    far = search(anchors, shelves, wants, same_label=False)
    ids = rows.filter("is_anchor").select("row", F.col("vec_id").alias("anchor_id"))
    found = far.select(F.col("anchor_row").alias("row"), "want", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["row", "want"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each anchor stands: its shelf and its place there."""
    for batch in batches:
        for shelf, raw in zip(batch.column("shelf").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            rows = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shelf)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], names=["q_shelf", "i", "row"])


def relabelled(embeddings: DataFrame, scale: int = 256, every: int = 7, n_labels: int = 10) -> DataFrame:
    """``vec_id, label, vec`` of ``embeddings``: components floor(``scale`` * x), labels of ids divisible by ``every`` moved on by one.

    Rows with a null label, a null vector or a null or non-finite component are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = embeddings.filter("label is not null and embedding is not null").filter(finite)
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
      CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
