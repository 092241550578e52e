"""Ranked nested search against full enumeration, and a case where only the second-best sub-wave stands."""

import itertools
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barwave.functions.wave_tables import COEFFICIENT, GRAMMAR, POSITION_PROBABILITY
from barwave.operators import pivots as pv
from barwave.operators import waves as wv
from barwave.session import cut
from tests.conftest import make_bars, walk

ORDER = {m: i for i, m in enumerate(wv.MODEL_ORDER, 1)}


def enumerate_readings(n_legs, splits, width, per_model):
    """Readings by (model, start, end): every product of the waves' beams is tried, then the best are kept."""
    found = defaultdict(list)
    for i in range(n_legs):
        found["SIMPLE_IMPULSE", i, i + 1] = [(1.0, None, None, (), "SIMPLE_IMPULSE", 1)]

    def key(r):
        return (-round(math.log(r[0]), 9), r[1] or "", r[3])

    def beam(rows):
        rows = sorted(rows, key=lambda r: (-round(math.log(r[0]), 9), ORDER[r[4]], r[5]))
        seen, first, rest = defaultdict(int), [], []
        for r in rows:
            seen[r[4]] += 1
            (first if seen[r[4]] <= per_model else rest).append(r)
        return first + rest[: max(0, width - len(first))]

    for span in range(3, 18, 2):
        made = defaultdict(list)
        for model, ends, bars, structural in splits:
            if ends[-1] - ends[0] != span:
                continue
            offers = []
            for (name, kids), a, b in zip(GRAMMAR[model].items(), ends, ends[1:], strict=False):
                rows = [r for k in (*kids, "SIMPLE_IMPULSE") for r in found.get((k, a, b), [])]
                offers.append([(r, POSITION_PROBABILITY.get((model, name, r[4]), COEFFICIENT[r[4]])) for r in beam(rows)])
            for way in itertools.product(*offers):
                w = way[0][0]
                if model == "DOUBLE_ZIGZAG" and w[4] == "ZIGZAG" and bars[2] - bars[1] < 0.9 * (w[2][2] - w[2][1]):
                    continue
                score = structural
                for r, prob in way:
                    score *= r[0] * prob
                path = tuple(ORDER[r[4]] * wv.READING + r[5] for r, _ in way)
                made[model, ends[0], ends[-1]].append((score, "-".join(map(str, ends)), bars, path))
        for k, rows in made.items():
            found[k] = [(*r, k[0], i) for i, r in enumerate(sorted(rows, key=key)[:width], 1)]
    return sorted((m, a, b, r[5], r[1], r[3], round(r[0], 10)) for (m, a, b), rows in found.items() for r in rows if m != "SIMPLE_IMPULSE")


def shown(nested):
    order = F.array(*[F.lit(m) for m in wv.MODEL_ORDER])
    code = F.transform("children", lambda c: (F.array_position(order, c["child"]) * wv.READING + c["child_rank"]).cast("int"))
    rows = nested.select("model", "start_seq", "end_seq", "rank", F.concat_ws("-", F.col("ends").cast("array<string>")), code, F.round("score", 10)).collect()
    return sorted((*r[:5], tuple(r[5]), r[6]) for r in rows)


@pytest.mark.parametrize(("width", "per_model"), [(20, 3), (2, 1)])
def test_against_enumeration(spark, width, per_model):
    piv = cut(pv.zigzag_pct(make_bars(spark, walk(700, seed=5, step=6.0)), 0.9))
    cands = cut(wv.wave_candidates(piv))
    splits = [(r["model"], tuple(r["ends"]), tuple(r["bars"]), r["structural"]) for r in cands.collect()]
    expected = enumerate_readings(piv.count() - 1, splits, width, per_model)
    got = shown(wv.nested_candidates(piv, cands, width=width, per_model=per_model))
    assert got == expected and any(r[3] > 1 for r in got)


@pytest.fixture(scope="module")
def by_hand(spark):
    """w over legs 0..6 read in two ways: the better has a long b, the other a b of one leg; x is short."""
    bars = [0, 10, 14, 24, 30, 40, 50, 60, 66, 80]
    piv = spark.createDataFrame([("T", "h1", b, float(100 + (i % 2) * 10 + i), i % 2 == 1, i == 9) for i, b in enumerate(bars)], "symbol string, tf string, bar_index long, value double, is_high boolean, is_last boolean")
    splits = [("ZIGZAG", (0, 1, 6, 7), 0.9), ("ZIGZAG", (0, 1, 2, 7), 0.2), ("IMPULSE", (2, 3, 4, 5, 6, 7), 0.5), ("ZIGZAG", (1, 2, 5, 6), 0.9), ("ZIGZAG", (2, 3, 4, 5), 0.9), ("DOUBLE_ZIGZAG", (0, 7, 8, 9), 0.7)]
    rows = [("T", "h1", m, e[0], e[-1], list(e), [0.0] * len(e), [bars[i] for i in e], s) for m, e, s in splits]
    rows += [("T", "h1", "FLAT_EXTENDED", 1, 6, [1, 2, 5, 6], [0.0] * 4, [bars[i] for i in (1, 2, 5, 6)], 0.8)]
    cands = spark.createDataFrame(rows, "symbol string, tf string, model string, start_seq long, end_seq long, ends array<long>, points array<double>, bars array<long>, structural double")
    return cut(piv), cut(cands)


def test_second_best_sub_wave_wins(by_hand):
    nested = cut(wv.nested_candidates(*by_hand))
    w = {r["rank"]: r["ends"] for r in nested.where("model = 'ZIGZAG' and start_seq = 0").collect()}
    assert w[1] == [0, 1, 6, 7] and [0, 1, 2, 7] in w.values()
    best = nested.where("model = 'DOUBLE_ZIGZAG'").orderBy("rank").first()
    assert best["rank"] == 1 and w[best["children"][0]["child_rank"]] == [0, 1, 2, 7]
    assert nested.where("model = 'DOUBLE_ZIGZAG'").count() == sum(e == [0, 1, 2, 7] for e in w.values())


def test_tree_and_roots(by_hand):
    nested = cut(wv.nested_candidates(*by_hand))
    tree = wv.reading_tree(nested, nested.where("model = 'DOUBLE_ZIGZAG' and rank = 1"))
    got = {tuple(r["path"]): (r["model"], r["start_seq"], r["end_seq"]) for r in tree.collect()}
    assert got[()] == ("DOUBLE_ZIGZAG", 0, 9) and got[(1,)] == ("ZIGZAG", 0, 7) and got[(1, 3)] == ("IMPULSE", 2, 7) and got[(1, 3, 5)] == ("SIMPLE_IMPULSE", 6, 7)
    assert len(got) == 1 + 3 + 3 + 5
    roots = wv.markup_roots(nested).where("start_seq = 0 and end_seq = 7").orderBy("place").collect()
    assert [r["place"] for r in roots] == list(range(1, len(roots) + 1)) and roots[0]["model"] == "ZIGZAG"
