"""Triangle setups. The SQL walks pivots one row at a time; the operators carry arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import triangles as tr
from barwave.plans.oracle import with_bars
from barwave.plans.readings import HOLDS
from barwave.plans.registry import query
from barwave.sources.ticks import bar_table

TF, BASE, MIN_BARS, MIN_SIZE = "m1", 5, 3, 0.05
SCALES = sorted({max(1, round(BASE * r)) for r in tr.LADDER})


def flips_sql(scales) -> str:
    """CTE ``fl``: finished pivots of every scale and the bars on which each is the last."""
    down, up = "r.ext * (1.0::DOUBLE - r.sc * 0.0001::DOUBLE)", "r.ext * (1.0::DOUBLE + r.sc * 0.0001::DOUBLE)"
    return f""", lz AS (SELECT symbol, tf, sc, bar_index, false AS up, low AS ext, bar_index AS ap, NULL::BIGINT AS pbar, NULL::DOUBLE AS pval
        FROM bars, (SELECT unnest({[float(s) for s in scales]}::DOUBLE[]) AS sc) WHERE bar_index = 0
      UNION ALL SELECT b.symbol, b.tf, r.sc, b.bar_index,
        CASE WHEN r.up AND b.high < r.ext AND b.low <= {down} THEN false WHEN NOT r.up AND b.low > r.ext AND b.high >= {up} THEN true ELSE r.up END,
        CASE WHEN r.up AND b.high >= r.ext THEN b.high WHEN r.up AND b.low <= {down} THEN b.low WHEN r.up THEN r.ext
             WHEN b.low <= r.ext THEN b.low WHEN b.high >= {up} THEN b.high ELSE r.ext END,
        CASE WHEN r.up AND (b.high >= r.ext OR b.low <= {down}) THEN b.bar_index WHEN r.up THEN r.ap WHEN b.low <= r.ext OR b.high >= {up} THEN b.bar_index ELSE r.ap END,
        CASE WHEN r.up AND b.high < r.ext AND b.low <= {down} THEN r.ap WHEN NOT r.up AND b.low > r.ext AND b.high >= {up} THEN r.ap END,
        CASE WHEN r.up AND b.high < r.ext AND b.low <= {down} THEN r.ext WHEN NOT r.up AND b.low > r.ext AND b.high >= {up} THEN r.ext END
      FROM lz r JOIN bars b ON b.symbol = r.symbol AND b.bar_index = r.bar_index + 1),
    fl AS MATERIALIZED (SELECT f.symbol, f.tf, f.sc, row_number() OVER k - 1 AS n, f.pbar AS b, f.pval AS v, f.bar_index AS live_from,
        coalesce(lead(f.bar_index) OVER k - 1, l.last) AS live_to
      FROM lz f JOIN (SELECT symbol, max(bar_index) AS last FROM bars GROUP BY symbol) l ON l.symbol = f.symbol WHERE f.pbar IS NOT NULL
      WINDOW k AS (PARTITION BY f.symbol, f.sc ORDER BY f.bar_index))"""


def back_sql(scales, r: float = tr.LEG_RATIO) -> str:
    """CTE ``tb``: pivots before E are met one by one; ``ph`` says which point is sought."""
    near = lambda x, of, ref: f"({of} - {x} <= {r}::DOUBLE * ({ref} - {of}))"
    d_moves, c_found = "ph = 1 AND yx > yd", f"ph = 1 AND yx <= ye AND {near('bx', 'bd', 'be')}"
    c_moves, b_found = f"ph = 2 AND yx <= yc AND {near('bx', 'bd', 'be')}", f"ph = 2 AND yx > yd AND {near('bx', 'bc', 'bd')}"
    b_moves, a_found = f"ph = 3 AND yx > yb AND {near('bx', 'bc', 'bd')}", f"ph = 3 AND yx <= yc AND {near('bx', 'bb', 'bc')}"
    a_moves, o_found = f"ph = 4 AND yx <= ya AND {near('bx', 'bb', 'bc')}", f"ph = 4 AND yx > yb AND {near('bx', 'ba', 'bb')}"
    pick = lambda name, cond: f"CASE WHEN {cond} THEN yx ELSE y{name} END AS y{name}, CASE WHEN {cond} THEN bx ELSE b{name} END AS b{name}"
    nothing = ", ".join(f"NULL::DOUBLE AS y{x}, NULL::BIGINT AS b{x}" for x in "cbao")
    return flips_sql(scales) + f""", wk AS (SELECT e.symbol, e.tf, e.sc, e.n, e.live_from, e.live_to, CASE WHEN d.v > e.v THEN 1.0 ELSE -1.0 END::DOUBLE AS s, 1 AS ph, e.n - 2 AS i, greatest(0, e.n - 98) AS floor,
        CASE WHEN d.v > e.v THEN 1 ELSE -1 END * e.v AS ye, e.b AS be, CASE WHEN d.v > e.v THEN 1 ELSE -1 END * d.v AS yd, d.b AS bd, {nothing}
        FROM fl e JOIN fl d ON d.symbol = e.symbol AND d.sc = e.sc AND d.n = e.n - 1 WHERE e.n >= 5 AND d.v <> e.v
      UNION ALL SELECT symbol, tf, sc, n, live_from, live_to, s,
        CASE WHEN ({c_found}) OR ({b_found}) OR ({a_found}) OR ({o_found}) THEN ph + 1 ELSE ph END, i - 1, floor, ye, be, {pick('d', d_moves)},
        {pick('c', f'({c_moves}) OR ({c_found})')}, {pick('b', f'({b_moves}) OR ({b_found})')}, {pick('a', f'({a_moves}) OR ({a_found})')}, {pick('o', o_found)}
        FROM (SELECT w.*, w.s * x.v AS yx, x.b AS bx FROM wk w JOIN fl x ON x.symbol = w.symbol AND x.sc = w.sc AND x.n = w.i WHERE w.i > w.floor AND w.ph < 5)),
    tb AS MATERIALIZED (SELECT symbol, tf, sc, n, live_from, live_to, s > 0 AS is_long, s * yo AS p0, s * ya AS p1, s * yb AS p2, s * yc AS p3, s * yd AS p4, s * ye AS p5,
        bo AS b0, ba AS b1, bb AS b2, bc AS b3, bd AS b4, be AS b5 FROM wk WHERE ph = 5 AND i > floor)"""


#: the reference's gates, and wide ones under which random series hold more triangles
GATES = {"": {}, "_wide": {"leg_ratio": 4.0, "max_duration": 8.0, "trend_ratio": 0.4, "min_room": 0.1}}


def setups_sql(leg_ratio: float = tr.LEG_RATIO, max_duration: float = tr.MAX_DURATION, trend_ratio: float = tr.TREND_RATIO, min_room: float = tr.MIN_ROOM) -> str:
    """CTE ``sg``: one row per signal."""
    signed = ", ".join(f"CASE WHEN p1 > p0 THEN p{i} - p0 ELSE p0 - p{i} END AS y{i}, abs(p{i} - p{i - 1}) AS w{i}" for i in range(1, 6))
    inside = " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM bars x WHERE x.symbol = m.symbol AND x.bar_index > b{i - 1} AND x.bar_index < b{i} AND (x.high > greatest(p{i - 1}, p{i}) OR x.low < least(p{i - 1}, p{i})))"
        for i in range(1, 6)
    )
    steady = " AND ".join(f"b{i} - b{i - 1} <= {max_duration} * (b{i - 1} - b{i - 2})" for i in range(2, 6))
    return back_sql(SCALES, leg_ratio) + f""", md AS (SELECT *, CASE WHEN {HOLDS['TRIANGLE_CONTRACTING']} THEN 'TRIANGLE_CONTRACTING' WHEN {HOLDS['TRIANGLE_RUNNING']} THEN 'TRIANGLE_RUNNING' END AS model FROM (SELECT *, {signed} FROM tb)),
    ok AS MATERIALIZED (SELECT * FROM md m WHERE model IS NOT NULL AND b5 - b0 >= {MIN_BARS} AND {steady} AND {inside}),
    lv AS (SELECT o.*, b.bar_index AS entry_bar, b.close AS entry,
        (SELECT CASE WHEN is_long THEN max(x.high) <= p4 ELSE min(x.low) >= p4 END FROM bars x WHERE x.symbol = o.symbol AND x.bar_index BETWEEN o.b3 AND b.bar_index) AS whole,
        (SELECT CASE WHEN is_long THEN p0 - min(x.low) ELSE max(x.high) - p0 END FROM bars x WHERE x.symbol = o.symbol AND x.bar_index BETWEEN greatest(0, 2 * o.b0 - o.b5) AND o.b0) AS advance,
        CASE WHEN is_long THEN floor(p0 * 100) / 100 ELSE ceil(p0 * 100) / 100 END AS tp,
        CASE WHEN is_long THEN floor((p1 - abs(b.close - p1) * 0.02::DOUBLE) * 100) / 100 ELSE ceil((p1 + abs(b.close - p1) * 0.02::DOUBLE) * 100) / 100 END AS sl
      FROM ok o JOIN bars b ON b.symbol = o.symbol AND b.bar_index BETWEEN o.live_from AND o.live_to),
    ft AS (SELECT * FROM lv WHERE whole AND abs(p0 - p1) / entry * 100 >= {MIN_SIZE} AND CASE WHEN is_long THEN entry < tp AND entry > sl ELSE entry > tp AND entry < sl END
        AND abs(entry - tp) / abs(tp - sl) >= {min_room} AND advance >= {trend_ratio} * abs(tp - sl) QUALIFY row_number() OVER (PARTITION BY symbol, sc, n ORDER BY entry_bar) = 1),
    sg AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY symbol, b0, b1, tp, sl ORDER BY entry_bar, sc DESC, n) = 1)"""


POINTS = ", ".join(f"b{i}" for i in range(6))


@query("g03_triangle_points", with_bars(back_sql(SCALES) + f" SELECT symbol, tf, CAST(sc AS INTEGER) AS scale, n, is_long, {POINTS} FROM tb", tf=TF, recursive=True))
def q_points(spark, sf):
    t = tr.triangles_back(tr.ladder_flips(bar_table(spark, sf, TF), SCALES))
    return t.select("symbol", "tf", F.col("scale").cast("int").alias("scale"), "n", "is_long", *[f"b{i}" for i in range(6)])


for _name, _gates in GATES.items():

    @query(
        f"g03_triangle_setups{_name}",
        with_bars(
            setups_sql(**_gates)
            + f""" SELECT concat_ws('|', symbol, tf, 'TRI', entry_bar, b0, CAST(sc AS INTEGER)) AS signal_id, symbol, tf, model, is_long, entry_bar, round(entry, 4) AS entry, round(tp, 4) AS tp, round(sl, 4) AS sl, {POINTS} FROM sg""",
            tf=TF,
            recursive=True,
        ),
    )
    def q_triangles(spark, sf, gates=_gates):
        t = tr.triangle_setups(bar_table(spark, sf, TF), BASE, min_bars=MIN_BARS, min_size_percent=MIN_SIZE, **gates)
        return t.select("signal_id", "symbol", "tf", "model", "is_long", "entry_bar", *[F.round(c, 4).alias(c) for c in ("entry", "tp", "sl")], *[f"b{i}" for i in range(6)])


# ---- running triangles -----------------------------------------------------------------------------

RUN_LADDER = (1.0, 1.618, 2.618, 4.236, 6.854)


def waves_sql(scales) -> str:
    """CTE ``ew``: where the wave that leaves pivot k stands when pivot i is the last one met; rows end before the pull-back that ends the wave."""
    return flips_sql(scales) + """, fe AS MATERIALIZED (SELECT f.*, coalesce(f.v > lead(f.v) OVER k, f.v > lag(f.v) OVER k) AS top, q.low AS lo, q.high AS hi, q.close AS close
        FROM fl f JOIN bars q ON q.symbol = f.symbol AND q.bar_index = f.live_from WINDOW k AS (PARTITION BY f.symbol, f.sc ORDER BY f.n)),
    er AS (SELECT a.symbol, a.sc, a.n AS k, a.v AS vk, CASE WHEN a.top THEN -1 ELSE 1 END AS g, b.n AS i, b.n AS ext, b.v AS vx FROM fe a JOIN fe b ON b.symbol = a.symbol AND b.sc = a.sc AND b.n = a.n + 1
      UNION ALL SELECT e.symbol, e.sc, e.k, e.vk, e.g, x.n, CASE WHEN e.g * x.v > e.g * e.vx THEN x.n ELSE e.ext END, CASE WHEN e.g * x.v > e.g * e.vx THEN x.v ELSE e.vx END
        FROM er e JOIN fe x ON x.symbol = e.symbol AND x.sc = e.sc AND x.n = e.i + 1
        WHERE x.n <= e.k + 401 AND (e.g * x.v > e.g * e.vx OR e.g * e.vx - e.g * x.v <= 0.5::DOUBLE * greatest(1e-12::DOUBLE, e.g * e.vx - e.g * e.vk))),
    wl AS MATERIALIZED (SELECT symbol, sc, k, max(i) AS last FROM er GROUP BY ALL),
    pl AS MATERIALIZED (SELECT f.*, m.last FROM fe f LEFT JOIN wl m ON m.symbol = f.symbol AND m.sc = f.sc AND m.k = f.n),
    ew AS MATERIALIZED (SELECT e.symbol, e.sc, e.k, e.i, e.ext, p.v, p.b, p.last FROM er e JOIN pl p ON p.symbol = e.symbol AND p.sc = e.sc AND p.n = e.ext)"""


def forward_sql(scales) -> str:
    """CTE ``fw``: points of every 0 and every turn at which E is born, one scale."""
    hop = lambda src, at, to: (
        f"SELECT z.*, w.ext AS {to}, w.v AS v{to}, w.b AS b{to}, least(z.n, w.last) AS l{to} FROM {src} z JOIN ew w ON w.symbol = z.symbol AND w.sc = z.sc AND w.k = z.{at} AND w.i = z.{'lo_' if at == 'o' else 'l' + at} WHERE z.{at} < z.n"
    )
    return waves_sql(scales) + f""", z0 AS MATERIALIZED (SELECT o.symbol, o.tf, o.sc, o.n AS o, o.v AS vo, o.b AS bo, least(t.n, o.last) AS lo_, t.n, CASE WHEN o.top THEN 1 ELSE -1 END AS s, CASE WHEN o.top THEN t.lo ELSE t.hi END AS ve, t.live_from AS entry_bar, t.close AS entry, t.lo, t.hi
        FROM pl o JOIN fe t ON t.symbol = o.symbol AND t.sc = o.sc AND t.n >= o.n + 4 AND (t.n - o.n) % 2 = 0 AND t.n <= o.n + 399),
    z1 AS MATERIALIZED ({hop('z0', 'o', 'a')}), z2 AS MATERIALIZED ({hop('z1', 'a', 'b')}), z3 AS MATERIALIZED (SELECT * FROM ({hop('z2', 'b', 'c')}) WHERE s * (vb - va) / (s * (vo - va)) BETWEEN {tr.B_TO_A[0]} AND {tr.B_TO_A[1]}),
    z4 AS MATERIALIZED ({hop('z3', 'c', 'd')}),
    z5 AS (SELECT * FROM z4 z WHERE s * ve >= s * va AND s * ve >= s * vc AND (d = n OR EXISTS (SELECT 1 FROM ew w WHERE w.symbol = z.symbol AND w.sc = z.sc AND w.k = z.d AND w.i = z.n AND z.s * z.ve < z.s * w.v))),
    z6 AS (SELECT z.*, (SELECT max(x.n) FROM fe x WHERE x.symbol = z.symbol AND x.sc = z.sc AND x.n > z.c AND x.n <= z.d AND z.s * x.v <= z.s * z.vb) AS cap FROM z5 z WHERE s * vd > s * vb),
    fw AS MATERIALIZED (SELECT symbol, tf, sc, o, sc AS fine, 0 AS way, s, entry_bar, entry, lo, hi, vo AS p0, va AS p1, vb AS p2, vc AS p3, vd AS p4, ve AS p5, bo AS b0, ba AS b1, bb AS b2, bc AS b3, bd AS b4, entry_bar AS b5 FROM z5 WHERE s * vd <= s * vb
      UNION ALL SELECT z.symbol, z.tf, z.sc, z.o, z.sc, 0, z.s, z.entry_bar, z.entry, z.lo, z.hi, vo, va, vb, vc, coalesce(x.v, vd), ve, bo, ba, bb, bc, coalesce(x.b, bd), z.entry_bar FROM z6 z LEFT JOIN fe x ON x.symbol = z.symbol AND x.sc = z.sc AND x.n = z.cap)"""


def across_sql(scales) -> str:
    """CTE ``xs``: 0-A-B of a coarse scale whose waves are over, C, D and E by bars up to the turns of finer scales."""
    room = f"va + {tr.B_TO_A[1]}::DOUBLE * (vo - va)"
    return forward_sql(scales) + f""", k1 AS (SELECT o.symbol, o.tf, o.sc, o.n AS o, o.v AS vo, o.b AS bo, CASE WHEN o.top THEN 1 ELSE -1 END AS s, p.ext AS a, p.v AS va, p.b AS ba, m.last AS a_last
        FROM fe o JOIN wl m ON m.symbol = o.symbol AND m.sc = o.sc AND m.k = o.n JOIN ew p ON p.symbol = o.symbol AND p.sc = o.sc AND p.k = o.n AND p.i = m.last),
    k2 AS (SELECT k.*, coalesce((SELECT min(x.n) FROM fe x WHERE x.symbol = k.symbol AND x.sc = k.sc AND x.n > k.a AND (k.s * x.v < k.s * va OR k.s * x.v > k.s * ({room}))), 1000000000) AS out_at,
        (SELECT max(n) FROM fe x WHERE x.symbol = k.symbol AND x.sc = k.sc) AS last_n FROM k1 k),
    k3 AS (SELECT k.*, p.v AS vb, p.b AS bb FROM k2 k JOIN wl m ON m.symbol = k.symbol AND m.sc = k.sc AND m.k = k.a JOIN ew p ON p.symbol = k.symbol AND p.sc = k.sc AND p.k = k.a AND p.i = m.last
        WHERE a_last < last_n AND m.last + 1 <= least(last_n, out_at - 1) AND k.s * (p.v - va) / (k.s * (vo - va)) BETWEEN {tr.B_TO_A[0]} AND {tr.B_TO_A[1]} AND k.s * p.v > k.s * vo),
    k4 AS (SELECT k.*, coalesce((SELECT min(q.bar_index) FROM bars q WHERE q.symbol = k.symbol AND q.bar_index > k.bb AND CASE WHEN k.s > 0 THEN q.high >= vb OR q.low < va ELSE q.low <= vb OR q.high > va END), 1000000000) AS end_bar FROM k3 k),
    k5 AS (SELECT k.*, t.sc AS fine, t.live_from AS e, t.lo, t.hi, t.close AS entry FROM k4 k JOIN fe t ON t.symbol = k.symbol AND t.sc < k.sc AND t.live_from > k.bb AND t.live_from <= k.bb + 1600 AND t.live_from < k.end_bar AND CASE WHEN k.s > 0 THEN t.v > t.lo ELSE t.v < t.hi END),
    k6 AS (SELECT k.*, (SELECT min({{'y': CASE WHEN k.s > 0 THEN q.low ELSE -q.high END, 'b': q.bar_index}}) FROM bars q WHERE q.symbol = k.symbol AND q.bar_index > k.bb AND q.bar_index < k.e) AS c FROM k5 k),
    k7 AS (SELECT k.*, (SELECT min({{'y': CASE WHEN k.s > 0 THEN -q.high ELSE q.low END, 'b': q.bar_index}}) FROM bars q WHERE q.symbol = k.symbol AND q.bar_index > k.c.b AND q.bar_index < k.e) AS d FROM k6 k WHERE c IS NOT NULL),
    k8 AS (SELECT k.*, (SELECT min({{'y': CASE WHEN k.s > 0 THEN q.low ELSE -q.high END, 'b': q.bar_index}}) FROM bars q WHERE q.symbol = k.symbol AND q.bar_index > k.d.b AND q.bar_index <= k.e) AS x FROM k7 k WHERE d IS NOT NULL),
    xs AS MATERIALIZED (SELECT symbol, tf, sc, o, fine, 1 AS way, s, e AS entry_bar, entry, lo, hi, vo AS p0, va AS p1, vb AS p2, s * c.y AS p3, -s * d.y AS p4, s * x.y AS p5, bo AS b0, ba AS b1, bb AS b2, c.b AS b3, d.b AS b4, e AS b5 FROM k8 WHERE x.b = e)"""


def running_sql(scales, min_bars: int, min_size: float, min_room: float = tr.MIN_ROOM, b_mult: float = 1.0, e_retrace: float = tr.E_RETRACE, max_duration: float = tr.MAX_DURATION) -> str:
    """CTE ``rs``: signals of one scale and across two."""
    y = ", ".join(f"s * p{i} AS y{i}" for i in range(6))
    steady = " AND ".join(f"(b{i - 1} <= b{i - 2} OR b{i} - b{i - 1} <= {max_duration} * (b{i - 1} - b{i - 2}))" for i in range(2, 6))
    inside = " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM bars q WHERE q.symbol = g.symbol AND q.bar_index > b{i - 1} AND q.bar_index < b{i} AND (q.high > greatest(p{i - 1}, p{i}) OR q.low < least(p{i - 1}, p{i})))"
        for i in range(1, 6)
    )
    return across_sql(scales) + f""", al AS (SELECT *, {y} FROM (SELECT * FROM fw UNION ALL SELECT * FROM xs)),
    g1 AS (SELECT * FROM al WHERE (y2 - y1) / (y0 - y1) BETWEEN {tr.B_TO_A[0]} AND {tr.B_TO_A[1]} AND y2 > y0 AND y3 <= y0 AND y3 > y1 AND y4 <= y2 AND y4 > y3 AND y5 > y1 AND y5 <= y4 AND y5 < y0 AND y4 - y5 >= {e_retrace} * (y4 - y3) AND y5 >= y3
        AND b5 - b0 >= {min_bars} AND (y0 - y1) / entry * 100 >= {min_size} AND CASE WHEN s > 0 THEN hi <= p4 ELSE lo >= p4 END AND {steady}),
    g2 AS (SELECT * FROM g1 g WHERE {inside}),
    g3 AS (SELECT g.*, CASE WHEN s > 0 THEN least(p1, p0 - {b_mult} * (y2 - y1)) ELSE greatest(p1, p0 + {b_mult} * (y2 - y1)) END AS far FROM g2 g),
    g4 AS (SELECT g.*, (SELECT max(q.bar_index) FROM bars q WHERE q.symbol = g.symbol AND q.bar_index < b0 AND CASE WHEN s > 0 THEN q.high >= p0 ELSE q.low <= p0 END) AS back,
        (SELECT max(q.bar_index) FROM bars q WHERE q.symbol = g.symbol AND q.bar_index < b0 AND CASE WHEN s > 0 THEN q.low < far ELSE q.high > far END) AS beyond FROM g3 g),
    g5 AS (SELECT *, CASE WHEN s > 0 THEN floor(p2 * 100) / 100 ELSE ceil(p2 * 100) / 100 END AS tp,
        CASE WHEN s > 0 THEN floor((p1 - abs(entry - p1) * 0.02::DOUBLE) * 100) / 100 ELSE ceil((p1 + abs(entry - p1) * 0.02::DOUBLE) * 100) / 100 END AS sl FROM g4 WHERE coalesce(beyond, -1) > coalesce(back, -1)),
    g6 AS (SELECT * FROM g5 WHERE CASE WHEN s > 0 THEN entry < tp AND entry > sl ELSE entry > tp AND entry < sl END AND abs(entry - tp) / abs(tp - sl) >= {min_room}
        QUALIFY row_number() OVER (PARTITION BY symbol, entry_bar, fine ORDER BY way, b0, sc DESC) = 1),
    rs AS (SELECT * FROM g6 QUALIFY row_number() OVER (PARTITION BY symbol, s, b0 ORDER BY entry_bar, way, sc DESC, fine DESC) = 1)"""


RUN_SCALES = sorted({max(1, round(BASE * r)) for r in RUN_LADDER})
RUN_GATES = {"": {}, "_wide": {"min_room": 0.1, "b_mult": 0.2, "e_retrace": 0.3, "max_duration": 12.0}}
PRICES = ", ".join(f"round(p{i}, 4) AS p{i}" for i in range(6))


@query(
    "g05_cross_scale_assembly",
    with_bars(across_sql(RUN_SCALES) + f" SELECT symbol, tf, CAST(sc AS INTEGER) AS scale, CAST(fine AS INTEGER) AS fine, o AS from_n, s > 0 AS is_long, {POINTS}, {PRICES} FROM xs", tf=TF, recursive=True),
)
def q_across(spark, sf):
    bars = bar_table(spark, sf, TF)
    x = tr.cross_scale(tr.cut(tr.with_turn_bar(tr.ladder_flips(bars, RUN_SCALES), bars)), bars)
    return x.select("symbol", "tf", *[F.col(c).cast("int").alias(c) for c in ("scale", "fine")], "from_n", "is_long", *[f"b{i}" for i in range(6)], *[F.round(f"p{i}", 4).alias(f"p{i}") for i in range(6)])


for _name, _gates in RUN_GATES.items():

    @query(
        f"g04_running_triangle_setups{_name}",
        with_bars(
            running_sql(RUN_SCALES, MIN_BARS, MIN_SIZE, **_gates)
            + f" SELECT concat_ws('|', symbol, tf, 'RUN', entry_bar, b0, CAST(sc AS INTEGER)) AS signal_id, symbol, tf, CAST(fine AS INTEGER) AS fine, way, s > 0 AS is_long, entry_bar, round(entry, 4) AS entry, round(tp, 4) AS tp, round(sl, 4) AS sl, {POINTS} FROM rs",
            tf=TF,
            recursive=True,
        ),
    )
    def q_running(spark, sf, gates=_gates):
        t = tr.running_triangle_setups(bar_table(spark, sf, TF), BASE, RUN_LADDER, MIN_BARS, MIN_SIZE, **gates)
        return t.select("signal_id", "symbol", "tf", F.col("fine").cast("int").alias("fine"), "way", "is_long", "entry_bar", *[F.round(c, 4).alias(c) for c in ("entry", "tp", "sl")], *[f"b{i}" for i in range(6)])
