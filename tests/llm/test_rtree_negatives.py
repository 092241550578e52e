"""Hard negatives against brute force: ties, copies, odd rows, vectors of several lengths, small shelves; and how much the boxes leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwave.llm import rtree_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, vec string, dims string"


def brute(rows, every=50):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if lab is not None and v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (anchor, label, q) in enumerate(rows):
        if anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i, lab) for m, (i, lab, v) in enumerate(rows) if m != n and len(v) == len(q)), key=lambda s: s[:2])
        for pos, pid, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -pos <= 100 * -s[0] <= 95 * -pos][:3]
            out += [(anchor, pid, k, nid, -pos, -neg) for k, (neg, nid, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 7, "v", "d") for r in rows], SCHEMA).repartition(3)
    got = rtree_negatives.hard_negatives(rtree_negatives.relabelled(df), F.col("vec_id") % 50 == 0, **sizes)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(4)) for i in range(400)]
    same = [0.5, 0.25, 1.0, 0.0, 0.0, -0.5]
    out += [(1000 + i, same, i % 2) for i in range(300)]  # one very common vector
    out += [(2000 + i, [rng.uniform(-1, 1) for _ in range(3)], i % 3) for i in range(60)]  # another length
    out += [(3000, [], 1), (3001, [], 1), (3002, [], 2), (3050, [0.0] * 6, 5)]
    out += [(50, None, 1), (51, [None] + [0.5] * 5, 1), (52, [float("nan")] + [0.5] * 5, 1), (100, [float("inf")] + [0.5] * 5, 1), (150, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    return out + [out[0], out[0], out[7]]


@pytest.mark.parametrize("sizes", [{}, {"shelf": 64, "anchors_at_once": 3}])
def test_against_brute_force(spark, rows, sizes):
    assert mined(spark, rows, **sizes) == brute(rows)


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(3, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1), (51, [1.0], 2)]) == []


def test_boxes_leave_out_what_cannot_count():
    """Clustered rows: the best five of a cluster are found without reading most leaves."""
    rng = np.random.default_rng(3)
    v = np.concatenate([np.round(rng.normal(c, 4, (256, 4))).astype(np.int64) for c in rng.uniform(-300, 300, (16, 4))])
    ids, labels, rows = np.arange(len(v)), np.zeros(len(v), np.int64), np.arange(len(v))
    order = rtree_negatives.tile_order(labels, ids, v)
    tree = rtree_negatives.Tree(4, ids[order].tobytes(), labels.tobytes(), rows[order].tobytes(), "int64", v[order].tobytes())
    read = []

    class Counting(rtree_negatives.Want):
        def offer(self, score, vec_id):
            read.append(vec_id)
            super().offer(score, vec_id)

    want = Counting({"want": 0, "k": 5, "lo": None, "hi": None, "kth": None, "kth_id": None})
    q = v[:1]
    bounds = [rtree_negatives.intervals(q, level[0], level[1]) for level in (tree.nodes, tree.leaves)]
    held = rtree_negatives.Scores(tree, q)
    rtree_negatives.best_first(tree, 0, 0, 0, True, [want], bounds, held)
    scores = v @ q[0]
    expected = sorted((-scores[i], i) for i in range(1, len(v)))[:5]
    assert sorted((-s, -i) for s, i in want.best) == expected and len(read) < len(v) / 8 and len(held.known) < len(tree.nodes[2]) / 4


def test_scores_that_do_not_fit_a_long():
    with pytest.raises(OverflowError):
        rtree_negatives.dots(np.full((1, 4), 2**31), np.full((1, 4), 2**31))
