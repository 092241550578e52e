"""Common shingles of a task: counted right, in little more than their own memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from barwave.llm import jaccard_join


def test_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 11, 12, 5000):
        parts = [rng.integers(0, 300, size).astype(np.uint64), np.full(12, 7, np.uint64), np.array([], np.uint64)]
        v, c = np.unique(np.concatenate(parts), return_counts=True)
        for least in (1, 12, 20):
            got, n = jaccard_join.often_met(list(parts), least)
            assert got.tolist() == v[c >= least].tolist() and n.tolist() == c[c >= least].tolist()
    assert [len(x) for x in jaccard_join.often_met([np.array([1], np.uint64)], 12)] == [0, 0]


def test_memory(monkeypatch):
    """A task's shingles are at no time held more than three times."""
    rng = np.random.default_rng(4)

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            raise StopIteration

    docs = Rows()
    try:
        jaccard_join.heavy_shingles(docs)
    except StopIteration:
        pass
    monkeypatch.setattr(jaccard_join, "all_shingles", lambda text, hashes: rng.integers(0, 2**63, 1_000_000).astype(np.uint64))
    tracemalloc.start()
    list(docs.run([pa.record_batch([pa.array(["x"] * 4)], ["text"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 4 * 8_000_000
