"""One passing and one failing pivot list per rule, in both directions."""

import random

import pytest
from pyspark.sql import functions as F

from barwave.operators import wave_setups as ws
from barwave.operators import waves as wv
from barwave.plans import setups
from tests.conftest import make_bars, walk

CASES = [
    ("IMPULSE", [100, 110, 103.5, 120, 114, 125], [0, 5, 10, 15, 20, 25], "NONE"),
    ("IMPULSE", [100, 110, 99, 120, 114, 125], [0, 5, 10, 15, 20, 25], "PRICE_BREACH"),  # W2 past the start
    ("IMPULSE", [100, 110, 103.5, 109, 106, 115], [0, 5, 10, 15, 20, 25], "PRICE_BREACH"),  # W3 not beyond W1
    ("IMPULSE", [100, 110, 103.5, 120, 109, 125], [0, 5, 10, 15, 20, 25], "PRICE_BREACH"),  # W4 inside W1
    ("IMPULSE", [100, 110, 103.5, 120, 114, 119], [0, 5, 10, 15, 20, 25], "PRICE_BREACH"),  # truncated
    ("IMPULSE", [100, 110, 103.5, 120, 114, 125], [0, 5, 10, 15, 40, 45], "TIME_WINDOW"),  # W4 four times W2
    ("IMPULSE", [100, 110, 109, 120, 114, 125], [0, 5, 10, 15, 20, 25], "RATIO_OUT_OF_RANGE"),  # W2 too shallow
    ("DIAGONAL_CONTRACTING_INITIAL", [100, 110, 103.5, 111.5, 106.5, 112.1], [0, 5, 10, 15, 20, 25], "NONE"),
    ("DIAGONAL_CONTRACTING_INITIAL", [100, 110, 103.5, 114.5, 108, 115], [0, 5, 10, 15, 20, 25], "PRICE_BREACH"),  # W3 > W1
    ("ZIGZAG", [100, 110, 104, 115], [0, 5, 10, 15], "NONE"),
    ("ZIGZAG", [100, 110, 99, 115], [0, 5, 10, 15], "PRICE_BREACH"),
    ("ZIGZAG", [100, 110, 104, 115], [0, 5, 10, 40], "TIME_WINDOW"),
    ("FLAT_EXTENDED", [100, 110, 98, 116], [0, 5, 10, 15], "NONE"),
    ("FLAT_EXTENDED", [100, 110, 101, 118], [0, 5, 10, 15], "PRICE_BREACH"),
    ("FLAT_REGULAR", [100, 110, 100.5, 111], [0, 5, 10, 15], "NONE"),
    ("FLAT_REGULAR", [100, 110, 103, 111], [0, 5, 10, 15], "PRICE_BREACH"),
    ("TRIANGLE_CONTRACTING", [100, 110, 102, 108.5, 103.5, 107], [0, 5, 10, 15, 20, 25], "NONE"),
    ("TRIANGLE_CONTRACTING", [100, 110, 102, 111, 103.5, 107], [0, 5, 10, 15, 20, 25], "PRICE_BREACH"),
]


@pytest.fixture(scope="module")
def judged(spark):
    out = {}
    for n in (3, 5):
        rows = []
        for i, (model, points, bars, _) in enumerate(CASES):
            if len(points) == n + 1:
                for mirror in (False, True):
                    p = [200.0 - v if mirror else float(v) for v in points]
                    rows.append((i, mirror, model, *p, *bars, 1.0 if p[1] > p[0] else -1.0))
        ddl = "case int, mirror boolean, model string, " + ", ".join(f"p{k} double" for k in range(n + 1)) + ", " + ", ".join(f"b{k} long" for k in range(n + 1)) + ", s double"
        df = spark.createDataFrame(rows, ddl).withColumns(wv._lengths(n))
        models = wv.FIVE if n == 5 else wv.THREE
        for r in df.withColumn("reason", F.coalesce(wv.model_case(wv.reason_text, models), F.lit("NONE"))).collect():
            out[(r["case"], r["mirror"])] = r["reason"]
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(judged, i):
    want = CASES[i][3]
    assert judged[(i, False)] == want
    assert judged[(i, True)] == want


def test_running_flat_can_never_stand(spark):
    # its two conditions on the end of C exclude each other; kept as it is
    rules = wv.PRICE_RULES["FLAT_RUNNING"][3]
    df = spark.createDataFrame([(1.0, 100.0, float(c), 10.0) for c in range(60, 160, 5)], "s double, p0 double, p3 double, w1 double")
    assert df.where(~F.expr(rules)).count() == 0


def test_diagonal_skeletons_are_chains_of_longest_waves(spark):
    """Each skeleton's waves 2 to 4 end at the highest price before the first deep pull-back, and no chain to a pivot is missed."""
    from barwave.operators import wave_setups as ws

    rng = random.Random(5)
    value, prices = 100.0, []
    for i in range(90):
        value += rng.uniform(1, 9) * (1 if i % 2 else -1)
        prices.append(round(value, 1))
    pivots = spark.createDataFrame(
        [("T", "h1", 2 * i, v, i % 2 == 1) for i, v in enumerate(prices)], "symbol string, tf string, bar_index long, value double, is_high boolean"
    )

    def longest(start, last):
        sign = 1 if start % 2 == 0 else -1
        v = [sign * p for p in prices[start : last + 1]]
        deep = [i for i in range(2, len(v)) if max(v[1:i]) - v[i] > ws.PULLBACK * (max(v[1:i]) - v[0])]
        usable = v[1 : deep[0] if deep else None]
        return start + 1 + usable.index(max(usable)) if usable else start

    def chain(one, last):
        two = longest(one, last)
        three = longest(two, last) if two < last else last
        return (one, two, three, last) if three < last and longest(three, last) == last else None

    want = set()
    for k in range(len(prices)):
        for last in range(k + 4, min(k + ws.REACH, len(prices) - 1) + 1, 2):
            one, sign = longest(k, last), 1 if k % 2 == 0 else -1
            peaks = [i for i in range(min(one - 1, last - 3), k, -1) if sign * prices[i] > max(sign * prices[k], sign * prices[i + 1])]
            found = [c for c in (chain(o, last) for o in [one, *peaks[: ws.ALTERNATIVES]]) if c]
            if found:
                want.add((k % 2 == 0, k, *found[0]))
    assert len(want) > 20
    for block in (1024, 16):
        got = {tuple(r) for r in ws.diagonal_skeletons(pivots, block=block).select("is_up", *[f"s{i}" for i in range(5)]).collect()}
        assert got == want


def test_only_registered_diagonals_go_on(spark):
    bars = make_bars(spark, walk(3000, step=4.0)).cache()
    gates = {r["gate"]: r["count"] for r in ws.diagonal_filters(setups.skeletons(bars).localCheckpoint(), bars).groupBy("gate").count().collect()}
    assert gates["SPILLS_OUT"] and gates["NOT_CONTAINED"]
    assert {r["gate"]: r["count"] for r in setups.registered(bars).groupBy("gate").count().collect()} == {"REGISTERED": gates["REGISTERED"]}
