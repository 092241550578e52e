"""The search against its conditions told one by one on a small series."""

from barwave.operators import harmonic as hm
from tests.conftest import make_bars, rows, walk


def test_search_finds_the_triples_that_hold(spark):
    """A triple is wanted if each point is the nearest pivot of its kind and no bar of a leg is beyond the leg's ends."""
    bars = make_bars(spark, walk(260, seed=21, step=3.0))
    pdf = bars.orderBy("bar_index").toPandas()
    n, want = len(pdf), []
    for bull in (True, False):
        up, dn = (pdf.high, pdf.low) if bull else (-pdf.low, -pdf.high)
        for p in range(hm.MIN_PERIOD, hm.MAX_PERIOD + 1):
            places = range(p, n - p)
            highs = {j for j in places if up.iloc[j - p : j + p + 1].max() <= up[j]}
            lows = {j for j in places if dn.iloc[j - p : j + p + 1].min() >= dn[j]}
            highs, lows = highs - lows, lows - highs
            latest = lambda points, before: max((j for j in points if j < before), default=-1)
            inside = lambda first, last, peak, trough: up.iloc[first : last + 1].max() <= up[peak] and dn.iloc[first : last + 1].min() >= dn[trough]
            for c in (j for j in range(p, n - 1) if up.iloc[j - p : j + 2].max() <= up[j]):
                b = latest(lows, c - p + 1)
                a = latest(highs, b)
                x = latest(lows, a)
                if x >= max(p, c - min(500, 25 * p)) and inside(b, c, c, b) and inside(a, b - 1, a, b) and inside(x, a - 1, a, x):
                    want.append((bull, p, x, a, b, c))
    cols = ("is_bull", "period", "x_bar", "a_bar", "b_bar", "c_bar")
    assert want
    assert rows(hm.find_xabc(bars), *cols) == sorted(want)
    assert rows(hm.find_xabc(bars, block=600), *cols) == sorted(want)


def test_items_keep_their_invariants(spark):
    bars = make_bars(spark, walk(1500, seed=4, step=4.0))
    items = hm.harmonic_items(bars).toPandas()
    assert len(items)
    assert ((items.x_bar < items.a_bar) & (items.a_bar < items.b_bar) & (items.b_bar < items.c_bar) & (items.c_bar < items.d_bar)).all()
    b = bars.toPandas().set_index("bar_index")
    for r in items.itertuples():
        want = (b.low, b.high) if r.is_bull else (b.high, b.low)
        assert (r.x, r.a, r.b, r.c, r.d) == (want[0][r.x_bar], want[1][r.a_bar], want[0][r.b_bar], want[1][r.c_bar], want[0][r.d_bar])
        assert r.prz_low - 1e-9 <= r.d if r.is_bull else r.d <= r.prz_high + 1e-9
    assert not items.duplicated(["model", "is_bull", "x_bar", "a_bar", "b_bar", "c_bar"]).any()
