"""Exact Jaccard join of whole texts on word shingles: pivots, regions, triangle-inequality windows, recursion.

Jaccard distance d = 1 - J is a metric. Texts that share no shingle are at distance 1, so regions are only made among texts that
share one of their first shingles in a common order (rare ones first; two texts within the radius always share one). In such
a block the place of the shared shingle bounds the size of a linked text, which rules most pairs out. The member with the fewest
shingles before the shared one (of near copies, the one the others were made from) is the pivot and gets its distance to every
member: what is within the radius is linked to the pivot. Links inside a component add nothing, so only blocks that still hold two components go on: by the triangle inequality
two linked texts differ by at most the radius in their distance to any pivot, so members are cut into rings of that width, copied
to the ring above, and joined ring by ring; large rings choose pivots of their own and are cut again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.llm.common import WORD, broadcast_if_small, cut, ensure_checkpoint_dir, release, shuffles

WORDS = 5
NUM, DEN = 80, 100  # linked when DEN * intersection >= NUM * union
RADIUS = 1 - NUM / DEN
LEAST_CELLS = 64
HEAVY = 40_000  # commonest shingles that come last in the order, by count
HEAVY_IN_TASK = 12
SMALL = 12  # blocks and rings of so many members are joined directly
SLICE = 128  # members of a region that meet in one task
LEVELS = 3
WORD_CACHE = 300_000

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h
        return h


def mix64(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def all_shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """64-bit hashes of a text's shingles in order; A-Z is lower-cased and ASCII white space parts words (so bytes do both).

    A text of fewer words than ``width`` has one shingle, all its words; without words it has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)] if n else [], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    v = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        v += h[k : n - width + 1 + k] * MULTIPLIERS[k % 5] ^ np.uint64(k // 5)
    return mix64(v)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The set of a text: its distinct shingles, sorted."""
    return np.unique(all_shingles(text, hashes))


def signature(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def prefix_length(n: int) -> int:
    """So many first elements of a set of ``n`` that a linked set shares one of them with its own first elements."""
    return n - -(-NUM * n // DEN) + 1


def often_met(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur ``least`` times or more in the arrays of ``held``, which is emptied, and how often; sorted in place, for few copies."""
    v = np.concatenate(held)
    held.clear()
    v.sort()
    # a value fills ``least`` places in a row
    often = np.unique(v[least - 1 :][v[least - 1 :] == v[: max(len(v) - least + 1, 0)]])
    return often, np.searchsorted(v, often, side="right") - np.searchsorted(v, often)


def parities(s: np.ndarray) -> bytes:
    """A bit for each of 2^k >= ``len(s)`` hash cells: whether an odd number of the set's elements falls in it."""
    cells = max(LEAST_CELLS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def odd_cells(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many cells the parities of each pair differ; the longer of two is folded in half, cell on cell, to the length of the other."""
    out = np.zeros(len(a), np.int64)
    lengths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(lengths, axis=0).tolist():
        at = np.flatnonzero((lengths == (la, lb)).all(axis=1))
        one, two = (np.frombuffer(b"".join([v[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, min(la, lb)) for v in (a, b))
        differ = np.bitwise_xor.reduce(one, axis=1) ^ np.bitwise_xor.reduce(two, axis=1)
        out[at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def heavy_shingles(docs: DataFrame) -> np.ndarray:
    """The commonest shingles over all texts, rarest first: at most ``HEAVY``. They only decide the order, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0

        def counted() -> pa.RecordBatch:
            v, c = often_met(held, HEAVY_IN_TASK)
            return pa.record_batch([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    held.append(all_shingles(text, hashes))
                    n += len(held[-1])
                    if n > 4_000_000:
                        yield counted()
                        n = 0
        if held:
            yield counted()

    common = docs.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    rows = common.orderBy(F.desc("c"), "g").limit(HEAVY).collect()
    return np.array([r["g"] for r in reversed(rows)], np.int64).view(np.uint64)


def largest_partner(n: Column, pos: Column) -> Column:
    """The largest size of a linked set if the shingle at ``pos`` of a set of ``n`` is the first that both share in the common order.

    Then at most ``n - pos`` shingles are common, and a link needs (DEN + NUM) * common >= NUM * (n + other).
    """
    return F.floor((n - pos) * (DEN + NUM) / NUM).cast("long") - n


def sized(df: DataFrame) -> DataFrame:
    """``n_most`` holds size and largest partner in one number, for smaller rows on their way."""
    return df.withColumn("n", F.shiftright("n_most", 32)).withColumn("most", F.col("n_most").bitwiseAND(F.lit(0xFFFFFFFF))).drop("n_most")


def with_partner(n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which members of a block may have a linked one of at most their own size or are early enough in their order for an equal one."""
    order = np.argsort(n, kind="stable")
    reach = np.maximum.accumulate(most[order])  # of all members up to a size
    up_to = np.searchsorted(n[order], most, side="right")
    return (most >= n) | ((up_to > 0) & (reach[np.maximum(up_to - 1, 0)] >= n))


def block_members(each: DataFrame, small: int) -> DataFrame:
    """What the blocks of ``each`` (``region``, ``sig``, ``n_most``) give: ``region, a, b, n_most``.

    A block of at most ``small`` members gives its pairs (a < b) whose sizes and places allow a link, with region null; of a larger
    one each member that may have a partner is a row (a, its ``n_most``) with b null. Blocks of one set give nothing. Rows
    come by region in one shuffle and are read as a stream; only the commonest shingles have long blocks, and those go another way.
    """

    def pairs_of(region: np.ndarray, sig: np.ndarray, n_most: np.ndarray) -> pa.RecordBatch:
        """Whole blocks, sorted by region and sig, without repeats."""
        n, most = n_most >> 32, n_most & 0xFFFFFFFF
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        ends = np.concatenate([starts[1:], [len(region)]])
        keep = np.ones(len(region), bool)
        for k in np.flatnonzero(ends - starts > small):
            block = slice(starts[k], ends[k])
            keep[block] = with_partner(n[block], most[block])
        region, sig, n_most, n, most = (c[keep] for c in (region, sig, n_most, n, most))
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(region)]]))
        size = np.repeat(sizes, sizes)
        few = size <= small
        a, b = [], []
        for k in range(1, min(small, int(sizes.max())) if len(sizes) else 0):
            same = few[:-k] & (region[:-k] == region[k:]) & (n[:-k] <= most[k:]) & (n[k:] <= most[:-k])
            i = np.flatnonzero(same)
            a.append(sig[i])
            b.append(sig[i + k])
        big = np.flatnonzero(~few)
        m = sum(map(len, a))
        left = np.concatenate([*a, sig[big]]) if a else sig[big]
        cols = [
            pa.array(np.concatenate([np.zeros(m, np.int64), region[big]]), mask=np.arange(m + len(big)) < m),
            pa.array(left),
            pa.array(np.concatenate([*b, np.zeros(len(big), np.int64)]), mask=np.arange(m + len(big)) >= m),
            pa.array(np.concatenate([np.zeros(m, np.int64), n_most[big]])),
        ]
        return pa.record_batch(cols, ["region", "a", "b", "n_most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([old, batch.column(c).to_numpy()]) for c, old in enumerate(rest)]
            new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            rows = [r[new] for r in rows]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last block may go on
            rest = [r[last:] for r in rows]
            if last:
                yield pairs_of(*(r[:last] for r in rows))
        if len(rest[0]):
            yield pairs_of(*rest)

    return each.repartition(shuffles(each), "region").sortWithinPartitions("region", "sig").mapInArrow(run, "region long, a long, b long, n_most long")


def row_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.xxhash64("doc_id", "text"))


def set_table(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``doc_id, row, sig, n, prefix, cells`` of each row: the set's signature and size, its first shingles in the common order, and
    the parities of its hash cells (a task gives the last two for the first row of a signature only)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        common = shared.value
        by_value = np.argsort(common)
        values = common[by_value]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sig, size, prefix, cells = [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingles(text, hashes)
                    sig.append(signature(s))
                    size.append(len(s))
                    if sig[-1] in seen or not len(s):
                        prefix.append(None)
                        cells.append(None)
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sig[-1])
                    cells.append(parities(s))
                    order = s
                    if len(values):
                        place = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        is_heavy = values[place] == s
                        if is_heavy.any():
                            order = np.concatenate([s[~is_heavy], common[np.sort(by_value[place[is_heavy]])]])
                    prefix.append(order[: prefix_length(len(s))].view(np.int64))
                cols = [some.column(0), some.column(2), pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(cells, pa.binary())]
                yield pa.record_batch(cols, ["doc_id", "row", "sig", "n", "prefix", "cells"])

    return row_key(docs).mapInArrow(run, "doc_id long, row long, sig long, n long, prefix array<long>, cells binary")


def close_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) whose cells allow a link.

    A cell whose parities differ holds an element of one set only, so such cells are at most as many as the symmetric difference, which
    in a linked pair is at most (|a| + |b|) (1 - t) / (1 + t) for threshold t. So none that is linked is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = odd_cells(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            total = batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(differ * (DEN + NUM) <= total * (DEN - NUM)))

    used = cut(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct())
    met = sets.join(broadcast_if_small(used, 200_000), "sig", "left_semi")  # of all sets only those in a pair move
    one = met.select(F.col("sig").alias("a"), F.col("cells").alias("cells_a"), F.col("n").alias("n_a"))
    two = met.select(F.col("sig").alias("b"), F.col("cells").alias("cells_b"), F.col("n").alias("n_b"))
    both = pairs.join(one, "a").join(two, "b").filter((F.col("n_a") * DEN >= F.col("n_b") * NUM) & (F.col("n_b") * DEN >= F.col("n_a") * NUM))
    return both.select("a", "b", "cells_a", "cells_b", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(run, "a long, b long")


def distances(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, distance`` of pairs, from whole sets made again from one text for each signature that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        done: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                new = {s: t for s, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if s not in done}
                done.update(new)
                items = [shingles(t, hashes).view(np.int64) for t in new.values()]
                yield pa.record_batch([pa.array(list(new), pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["sig", "items"])

    used = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "sig")
    wanted = cut(sets.select("sig", "row").join(used, "sig"))
    texts = row_key(docs).join(broadcast_if_small(wanted, 200_000), "row").select("sig", "text")
    items = texts.mapInArrow(run, "sig long, items array<long>")
    folder = cut(items)
    one = folder.select(F.col("sig").alias("a"), F.col("items").alias("items_a"))
    two = folder.select(F.col("sig").alias("b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("common")
    met = pairs.join(one, "a").join(two, "b").withColumn("common", common)
    linked = F.col("common") * DEN >= union * NUM
    return met.select("a", "b", (1 - F.col("common") / union).alias("distance"), linked.alias("linked")).distinct()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, component`` (the smallest node reachable) of the nodes of ``links`` (``a``, ``b``), by large and small stars in turn.

    Minima are aggregated and joined back, so a node with very many links is no single group.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        met = both.join(low, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()

    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = cut(links.select("a", "b").filter("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        edges = cut(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def ring_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different components within each region that sizes and places allow: ``members`` has region, sig, n, most, component, size.

    ``size`` is the region's number of members. They are dealt to slices of about ``SLICE``, and slices meet in pairs, so no task
    holds a large region; a region of one slice is not copied.
    """
    part = members.withColumn("slices", F.ceil(F.col("size") / SLICE)).withColumn("slice", F.pmod(F.xxhash64("sig"), F.col("slices")))
    # each pair of slices meets once: the lower one with itself and all above
    left = part.select("region", "slice", F.explode(F.sequence("slice", F.col("slices") - 1)).alias("other"), F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("component").alias("c_a"))
    right = part.select("region", F.col("slice").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), "slice")).alias("slice"), F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("component").alias("c_b"))
    met = left.join(right, ["region", "slice", "other"]).filter("(slice <> other or a < b) and c_a <> c_b and n_a <= most_b and n_b <= most_a")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def pivot_pairs(members: DataFrame, level: int) -> DataFrame:
    """Each member of a region with the region's pivot: region, sig, n, most, pivot.

    First the pivot is the member that has the fewest shingles before the shared one, for its size; a later level takes a random one.
    """
    place = -F.col("most") / F.col("n") if level == 0 else F.lit(0.0)
    order = F.struct(place.alias("place"), F.xxhash64("sig", F.lit(level)).alias("o"), F.col("sig").alias("s"))
    first = members.groupBy("region").agg(F.min(order).alias("p"))
    return members.join(first.select("region", F.col("p.s").alias("pivot")), "region")


def linked_rows(docs: DataFrame, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """``doc_id, row, n, component`` of each row: ``component`` is a signature, the same for all that links connect. Only rows with shingles."""
    rows = written(set_table(docs, heavy_shingles(docs)))
    firsts = rows.filter("prefix is not null")
    sets = cut(firsts.groupBy("sig").agg(F.min(F.struct("row", "n", "cells")).alias("s")).select("sig", "s.*"))
    each = firsts.select(F.posexplode("prefix").alias("pos", "region"), "sig", "n")
    n_most = F.shiftleft("n", 32) + largest_partner(F.col("n"), F.col("pos"))
    made = written(block_members(each.select("region", "sig", n_most.alias("n_most")), small))
    release(docs.sparkSession)
    direct = made.filter("b is not null").select("a", "b")
    large = sized(made.filter("b is null").select("region", F.col("a").alias("sig"), "n_most"))
    tested = pivot_pairs(large, 0).filter("sig <> pivot").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
    pairs = cut(close_enough(cut(direct.union(tested).distinct()), sets))
    found = cut(distances(pairs, docs, sets))
    links = found.filter("linked").select("a", "b")
    comps = cut(components(links))
    del pairs, direct, tested
    release(docs.sparkSession)
    before = None
    for level in range(levels + 1):
        known = large.join(comps, large["sig"] == comps["node"], "left").select("region", "sig", "n", "most", F.coalesce("component", "sig").alias("component"))
        mixed = known.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low <> high")
        open_regions = cut(known.join(mixed.select("region", "size"), "region"))
        if open_regions.isEmpty():
            break
        wide = open_regions.filter(F.col("size") > 4 * small).count()
        last = level == levels or not wide or (before is not None and wide > 0.7 * before)  # rings no longer part the members
        before = wide
        now = open_regions if last else open_regions.filter(F.col("size") <= 4 * small)
        later = None if last else open_regions.filter(F.col("size") > 4 * small)
        known_pairs = found.select("a", "b")
        wanted = ring_pairs(now)
        if not last:
            pivoted = cut(pivot_pairs(later.drop("size"), level + 1))
            wanted = wanted.union(pivoted.filter("sig <> pivot").select(F.least("sig", "pivot"), F.greatest("sig", "pivot")))
        fresh = close_enough(cut(wanted.distinct().join(known_pairs, ["a", "b"], "left_anti")), sets)
        measured = cut(distances(cut(fresh), docs, sets))
        found = cut(found.union(measured))
        if not measured.filter("linked").isEmpty():
            links = cut(links.union(measured.filter("linked").select("a", "b")))
            comps = cut(components(links))
        del fresh, measured
        release(docs.sparkSession)
        if last:
            break
        apart = F.when(F.col("sig") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("distance"))
        placed = pivoted.join(found, (F.least("sig", "pivot") == found["a"]) & (F.greatest("sig", "pivot") == found["b"]), "left")
        ring = F.floor(apart / RADIUS + 1e-9).cast("int")  # the sum keeps a distance on an edge in the outer of two rings
        # sizes or cells may rule a pivot out: then the distance is beyond the radius but unknown, and the member joins every outer ring
        ring = F.when(apart.isNull(), F.sequence(F.lit(1), F.lit(int(1 / RADIUS) + 1))).otherwise(F.array(ring, ring + 1))
        large = cut(
            placed.select("region", "sig", "n", "most", F.explode(ring).alias("ring"))
            .select(F.xxhash64("region", "ring", F.lit(level)).alias("region"), "sig", "n", "most")
            .distinct()
        )

    with_set = rows.filter("n > 0").select("doc_id", "row", "sig", "n")
    return cut(with_set.join(comps, with_set["sig"] == comps["node"], "left").select("doc_id", "row", "n", F.coalesce("component", "sig").alias("component")))


def link_documents(docs: DataFrame, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (``doc_id``, ``text``): exact components of linked texts.

    ``component_id`` is the smallest doc_id reachable by links, itself included. Equal sets are one member throughout, so copies cost
    nothing after the first pass. Null, empty and blank texts have no shingles and are linked with nothing: their component is
    their own id. Null ids get the smallest id of their component, null if there is none. Each row gives a row; extra columns are ignored.
    Shingles and sets are told apart by 64-bit hashes.
    """
    linked = linked_rows(docs, small, levels)
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    filled = linked.join(lowest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(F.col("doc_id").cast("long"))
    return filled.unionByName(blank.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """``docs`` with one row of each component: that of smallest id (null last), of rows equal in id that of smallest hash.

    Texts without words are linked with nothing and stay. Rows equal in id and text count as copies: one stays.
    """
    linked = linked_rows(docs, small, levels)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = linked.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("size")).filter("size > 1")
    met = linked.join(first, "component")
    gone = cut(met.filter(F.col("row") != F.col("first.row")).select("row").distinct())
    repeated = cut(met.filter(F.col("row") == F.col("first.row")).groupBy("row").count().filter("count > 1").select("row"))
    mark = F.xxhash64(F.col("doc_id").cast("long"), "text")
    kept = docs.join(broadcast_if_small(gone, 200_000), mark == gone["row"], "left_anti")
    if repeated.isEmpty():
        return kept
    same = broadcast_if_small(repeated, 200_000)
    once = kept.join(same, mark == repeated["row"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(same, mark == repeated["row"], "left_anti").unionByName(once)
