"""Cells of a set: their size, their bound, and pairs of a region from slices."""

import numpy as np

from barwave.llm import jaccard_join


def test_cells_take_few_bytes(spark):
    """A bit for each cell, at most two cells an element: 600 shingles take 128 bytes."""
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(604))), (2, "a few words")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_join.set_table(df, np.zeros(0, np.uint64)).collect()}
    assert got[1]["n"] == 600 and len(got[1]["cells"]) == 128 and len(got[2]["cells"]) == 8


def test_cells_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    a, b, apart = [], [], []
    for n in (1, 2, 63, 64, 65, 240, 500, 4000, 5000):
        for share in (0.0, 0.1, 0.5, 1.0):
            one = rng.integers(0, 2**63, n).astype(np.uint64)
            two = np.unique(np.concatenate([one[: n - int(share * n)], rng.integers(0, 2**63, int(share * n * 1.3)).astype(np.uint64)]))
            one = np.unique(one)
            a.append(jaccard_join.parities(one))
            b.append(jaccard_join.parities(two))
            apart.append(len(np.setxor1d(one, two)))
    got = jaccard_join.odd_cells(a, b)
    assert (got <= apart).all() and got[0] == 0 and got[-1] > 0.3 * apart[-1]
    assert len({(len(x), len(y)) for x, y in zip(a, b, strict=True) if len(x) != len(y)}) > 1  # some were folded
    assert jaccard_join.odd_cells([], []).tolist() == []


def test_ring_pairs_by_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", 4)
    rows = [(region, sig, 10, 12, sig // 3, size) for region, size in ((1, 3), (2, 23)) for sig in range(size)]
    members = spark.createDataFrame(rows, "region long, sig long, n long, most long, component long, size long")
    got = sorted((r["a"], r["b"]) for r in jaccard_join.ring_pairs(members).collect())
    assert got == sorted((a, b) for size in (3, 23) for a in range(size) for b in range(a + 1, size) if a // 3 != b // 3)
