"""Wave readings over spans of legs: splits, ranked sub-waves, ranges, tiles, trees. The SQL states every rule anew, as what must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.functions.fib import fib_range
from barwave.functions.wave_tables import COEFFICIENT, GRAMMAR, POSITION_PROBABILITY, RATIOS, START_MODELS
from barwave.operators import pivots as pv
from barwave.operators import waves as wv
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.plans.waves import DEV, fib_sql, line_sql, over_sql, time_sql
from barwave.plans.zigzags import zigzag_sql
from barwave.session import cut
from barwave.sources.ticks import bar_table

# What must hold of a finished model. y_i is how far point i lies from the start in the direction of wave 1; w_i and d_i are
# price and bars of wave i; far is the farthest point inside the corrective wave before the last.
_CLOSING = "w4 < w2 AND y4 >= y2 AND w5 < w3 AND y5 <= y3 AND y5 >= 0 AND y3 <= y1"
_DIAGONAL = "y2 >= 0 AND y3 - y1 >= 0.05::DOUBLE * w1 AND w3 < w1 AND w4 < w2 AND w5 < w3"
_SHARP = "y2 >= 0 AND y3 >= y1 AND d3 >= 0.3::DOUBLE * d1 AND d3 <= 3 * d1"
HOLDS = {
    "IMPULSE": "y2 >= 0 AND y3 >= y1 AND y4 >= y1 AND y4 >= 0 AND y5 >= y3 AND y5 >= y4 AND (w3 >= w1 OR w3 >= w5) AND d4 >= 0.3::DOUBLE * d2 AND d4 <= 3 * d2",
    "DIAGONAL_CONTRACTING_INITIAL": _DIAGONAL + " AND y5 - y3 >= 0.05::DOUBLE * w3",
    "DIAGONAL_CONTRACTING_ENDING": _DIAGONAL,
    "ZIGZAG": _SHARP + " AND y3 >= far",
    "DOUBLE_ZIGZAG": _SHARP + " AND y3 >= far",
    "TRIPLE_ZIGZAG": _SHARP + " AND y5 >= far",
    "FLAT_EXTENDED": "y2 <= 0 AND y3 >= y1 AND y3 >= 0",
    "FLAT_RUNNING": "y2 <= 0 AND -y3 >= 0.382::DOUBLE * w1 AND y3 >= 0",
    "FLAT_REGULAR": "y2 >= 0 AND w2 >= 0.9::DOUBLE * w1 AND y3 >= 0",
    "TRIANGLE_CONTRACTING": "y2 >= 0 AND w3 < w1 AND " + _CLOSING,
    "TRIANGLE_RUNNING": "y2 <= 0 AND " + _CLOSING,
}


def in_ratio(model: str) -> str:
    parts = []
    for name, leg, ref in RATIOS[model]:
        low, high = fib_range(name)
        parts.append(f"w{leg} / w{ref} BETWEEN {low!r}::DOUBLE AND {high!r}::DOUBLE")
    return " AND ".join(["w1 > 0", *parts])


def splits_sql(span: int = wv.MAX_SPAN) -> str:
    """CTE ``sp``: all splits of up to ``span`` legs that stand, with ``split``, ``ends`` and ``structural``."""
    parts = []
    for n in (3, 5):
        models = wv.FIVE if n == 5 else wv.THREE
        joins = " ".join(
            f"JOIN lp x{i} ON x{i}.symbol = x0.symbol AND x{i}.f = x{i - 1}.q AND x{i}.q - x0.q <= {span - (n - i)}" for i in range(1, n + 1)
        )
        cols = ", ".join(f"x{i}.q AS q{i}, x{i}.v AS p{i}, x{i}.b AS b{i}" for i in range(n + 1))
        signed = ", ".join(f"s * (p{i} - p0) AS y{i}, abs(p{i} - p{i - 1}) AS w{i}, b{i} - b{i - 1} AS d{i}" for i in range(1, n + 1))
        holds = " ".join(f"WHEN '{m}' THEN {HOLDS[m]} AND {in_ratio(m)}" for m in models)
        line = line_sql(models) if n == 5 else "1::DOUBLE"
        parts.append(
            f""", a{n} AS (SELECT x0.symbol, x0.tf, {cols} FROM pn x0 {joins}),
        g{n} AS (SELECT *, {signed} FROM (SELECT *, CASE WHEN p1 > p0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM a{n})),
        f{n} AS (SELECT g.*, s * ((CASE WHEN s > 0 THEN e.high ELSE e.low END) - p0) AS far FROM g{n} g JOIN ex e ON e.symbol = g.symbol AND e.f = g.q{n - 2} AND e.t = g.q{n - 1}),
        s{n} AS MATERIALIZED (SELECT symbol, tf, model, q0 AS start_seq, q{n} AS end_seq, concat_ws('-', {", ".join(f"q{i}" for i in range(n + 1))}) AS split,
          [{", ".join(f"q{i}" for i in range(n + 1))}] AS ends, b2 - b1 AS d_mid, {fib_sql(models)} * {over_sql(models)} * {time_sql(models)} * {line} AS structural
          FROM f{n}, (SELECT unnest({list(models)}) AS model) WHERE CASE model {holds} END)"""
        )
    return (
        zigzag_sql()
        + f""", pn AS MATERIALIZED (SELECT symbol, tf, row_number() OVER (PARTITION BY symbol ORDER BY bar_index, is_high DESC) - 1 AS q, value AS v, bar_index AS b FROM zz),
        ex AS MATERIALIZED (SELECT a.symbol, a.q AS f, b.q AS t, max(c.v) AS high, min(c.v) AS low FROM pn a JOIN pn b ON b.symbol = a.symbol AND b.q > a.q AND b.q - a.q <= {span}
          JOIN pn c ON c.symbol = a.symbol AND c.q BETWEEN a.q AND b.q GROUP BY ALL),
        lp AS MATERIALIZED (SELECT a.symbol, a.q AS f, b.q, b.v, b.b FROM pn a JOIN pn b ON b.symbol = a.symbol AND b.q > a.q AND (b.q - a.q) % 2 = 1 AND b.q - a.q <= {span})"""
        + "".join(parts)
        + ", sp AS MATERIALIZED (SELECT * FROM s3 UNION ALL SELECT * FROM s5)"
    )


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + ")"


def readings_sql(span: int = wv.MAX_SPAN, width: int = 20, per_model: int = 3) -> str:
    """CTE ``rd``: the best readings of every span, built wave by wave for one span length after the other."""
    order = list(wv.MODEL_ORDER)
    grammar = [
        (parent, i, child, order.index(child) + 1, float(POSITION_PROBABILITY.get((parent, key, child), COEFFICIENT[child])))
        for parent, waves in GRAMMAR.items() for i, (key, kids) in enumerate(waves.items(), 1) for child in (*kids, "SIMPLE_IMPULSE")
    ]
    out = [
        splits_sql(span)
        + f""", gr AS MATERIALIZED (SELECT * FROM {values(grammar)} AS t(model, pos, child, child_rank, prob)),
        r1 AS MATERIALIZED (SELECT symbol, tf, 'SIMPLE_IMPULSE' AS model, q AS start_seq, q + 1 AS end_seq, CAST(1 AS BIGINT) AS rank, 1::DOUBLE AS score, '' AS split, []::INT[] AS path, NULL::BIGINT AS d_mid
          FROM pn WHERE q < (SELECT max(q) FROM pn l WHERE l.symbol = pn.symbol))"""
    ]
    offers = []
    for length in range(1, span + 1, 2):
        if length > 1:
            waves = []
            for k in range(1, 6):
                before = f"sp_{length}" if k == 1 else f"m{length}_{k - 1}"
                score, path = ("structural", "[]::INT[]") if k == 1 else ("score", "path")
                held = "true" if k == 1 else f"len(ends) > {k}"
                waves.append(
                    f"""m{length}_{k} AS MATERIALIZED (SELECT b.symbol, b.tf, b.model, b.start_seq, b.end_seq, b.split, b.ends, b.d_mid, list_append(b.{path if k > 1 else 'no_path'}, o.child_rank * 1000 + o.rank)::INT[] AS path, b.{score} * (o.score * o.prob) AS score
                  FROM (SELECT *, []::INT[] AS no_path FROM {before}) b JOIN op_{length} o ON o.symbol = b.symbol AND o.parent = b.model AND o.pos = {k} AND o.start_seq = b.ends[{k}] AND o.end_seq = b.ends[{k + 1}]
                  WHERE {held} AND NOT ({k} = 1 AND b.model = 'DOUBLE_ZIGZAG' AND o.child = 'ZIGZAG' AND b.d_mid < 0.9::DOUBLE * o.d_mid)
                  QUALIFY row_number() OVER (PARTITION BY b.symbol, b.model, b.split ORDER BY -round(ln(b.{score} * (o.score * o.prob)), 9), list_append(b.{path if k > 1 else 'no_path'}, o.child_rank * 1000 + o.rank)::INT[]) <= {width})"""
                )
            union = " UNION ALL ".join(f"SELECT * FROM o{x}" for x in range(1, length - 1, 2))
            out.append(
                f"""sp_{length} AS MATERIALIZED (SELECT * FROM sp WHERE end_seq - start_seq = {length}),
            op_{length} AS MATERIALIZED ({union}), {", ".join(waves)},
            r{length} AS MATERIALIZED (SELECT symbol, tf, model, start_seq, end_seq, row_number() OVER (PARTITION BY symbol, model, start_seq, end_seq ORDER BY -round(ln(score), 9), split, path) AS rank, score, split, path, d_mid
              FROM (SELECT * FROM m{length}_3 WHERE len(ends) = 4 UNION ALL SELECT * FROM m{length}_5) QUALIFY rank <= {width})"""
            )
        offers.append(length)
        # what a wave of a parent is offered: three of each sub-model, then the best of the rest up to the width
        out.append(
            f"""o{length} AS MATERIALIZED (SELECT * EXCLUDE (nth, firsts, place) FROM (SELECT *, sum(CASE WHEN nth <= {per_model} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, parent, pos, start_seq, end_seq) AS firsts,
              row_number() OVER (PARTITION BY symbol, parent, pos, start_seq, end_seq, nth <= {per_model} ORDER BY -round(ln(score), 9), child_rank, rank) AS place
              FROM (SELECT r.symbol, r.start_seq, r.end_seq, r.rank, r.score, CASE WHEN r.model = 'ZIGZAG' THEN r.d_mid END AS d_mid, g.model AS parent, g.pos, g.child, g.child_rank, g.prob,
                  row_number() OVER (PARTITION BY r.symbol, g.model, g.pos, r.start_seq, r.end_seq, g.child ORDER BY r.rank) AS nth FROM r{length} r JOIN gr g ON g.child = r.model))
              WHERE nth <= {per_model} OR place <= {width} - firsts)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM r{x}" for x in offers[1:])
    return ", ".join(out) + f", rd AS MATERIALIZED ({union})"


def ranges_sql() -> str:
    coef = "CASE model " + " ".join(f"WHEN '{m}' THEN {COEFFICIENT[m]!r}::DOUBLE" for m in START_MODELS) + " END"
    place = f"list_position({list(wv.MODEL_ORDER)}, model)"
    return f""", rg AS MATERIALIZED (SELECT symbol, tf, start_seq, end_seq, model, score * {coef} AS score FROM rd WHERE rank = 1 AND model IN {START_MODELS}
        QUALIFY row_number() OVER (PARTITION BY symbol, start_seq, end_seq ORDER BY -round(ln(score * {coef}), 9), {place}) = 1)"""


def readings(spark, sf):
    piv = cut(pv.zigzag_pct(bar_table(spark, sf), DEV))
    return piv, cut(wv.nested_candidates(piv, cut(wv.wave_candidates(piv))))


def sql(body: str) -> str:
    return with_bars(readings_sql() + body, recursive=True)


def split_text():
    return F.concat_ws("-", F.col("ends").cast("array<string>")).alias("split")


@query("e16_wave_candidates", with_bars(splits_sql() + " SELECT symbol, tf, model, start_seq, end_seq, split, round(structural, 6) AS structural FROM sp", recursive=True))
def q_candidates(spark, sf):
    c = wv.wave_candidates(pv.zigzag_pct(bar_table(spark, sf), DEV))
    return c.select("symbol", "tf", "model", "start_seq", "end_seq", split_text(), F.round("structural", 6).alias("structural"))


@query(
    "e16_three_wave_candidates",
    with_bars(splits_sql() + f" SELECT symbol, tf, model, start_seq, end_seq, split FROM sp WHERE model IN {wv.THREE}", recursive=True),
)
def q_candidates3(spark, sf):
    c = wv.wave_candidates(pv.zigzag_pct(bar_table(spark, sf), DEV)).where(F.col("model").isin(*wv.THREE))
    return c.select("symbol", "tf", "model", "start_seq", "end_seq", split_text())


@query("e09_e18_nested_candidates", sql(" SELECT symbol, tf, model, start_seq, end_seq, rank, split, array_to_string(path, ' ') AS children, round(score, 8) AS score FROM rd"))
def q_nested(spark, sf):
    n = readings(spark, sf)[1]
    order = F.array(*[F.lit(m) for m in wv.MODEL_ORDER])
    code = F.transform("children", lambda c: (F.array_position(order, c["child"]) * wv.READING + c["child_rank"]).cast("string"))
    return n.select("symbol", "tf", "model", "start_seq", "end_seq", F.col("rank").cast("long").alias("rank"), split_text(), F.array_join(code, " ").alias("children"), F.round("score", 8).alias("score"))


@query("e19_markup_ranges", sql(ranges_sql() + " SELECT symbol, tf, start_seq, end_seq, model, round(score, 8) AS score FROM rg"))
def q_ranges(spark, sf):
    return wv.markup_ranges(readings(spark, sf)[1]).withColumn("score", F.round("score", 8))


@query(
    "e17_e19_markup_roots",
    sql(
        f""", rc AS (SELECT *, score * CASE model {" ".join(f"WHEN '{m}' THEN {COEFFICIENT[m]!r}::DOUBLE" for m in START_MODELS)} END AS root_score, list_position({list(wv.MODEL_ORDER)}, model) AS mr
          FROM rd WHERE model IN {START_MODELS}),
        rn AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_seq, end_seq, model ORDER BY rank) AS nth FROM rc),
        rf AS (SELECT *, sum(CASE WHEN nth <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, start_seq, end_seq) AS firsts,
          row_number() OVER (PARTITION BY symbol, start_seq, end_seq, nth <= 3 ORDER BY -round(ln(root_score), 9), mr, rank) AS later FROM rn)
        SELECT symbol, tf, start_seq, end_seq, model, rank, row_number() OVER (PARTITION BY symbol, start_seq, end_seq ORDER BY -round(ln(root_score), 9), mr, rank) AS place, round(root_score, 8) AS score
        FROM rf WHERE nth <= 3 OR later <= 20 - firsts"""
    ),
)
def q_roots(spark, sf):
    r = wv.markup_roots(readings(spark, sf)[1])
    return r.select("symbol", "tf", "start_seq", "end_seq", "model", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"), F.round("score", 8).alias("score"))


TILES = """, lg AS MATERIALIZED (SELECT symbol, start_seq, max(end_seq) AS end_seq, arg_max(model, end_seq) AS model, arg_max(score, end_seq) AS score FROM rg GROUP BY ALL),
    tl AS (SELECT pn.symbol, pn.tf, 0::BIGINT AS start_seq FROM pn WHERE q = 0
      UNION ALL SELECT tl.symbol, tl.tf, coalesce(lg.end_seq, tl.start_seq + 1) FROM tl LEFT JOIN lg ON lg.symbol = tl.symbol AND lg.start_seq = tl.start_seq
      WHERE tl.start_seq < (SELECT max(q) FROM pn l WHERE l.symbol = tl.symbol)),
    tr AS MATERIALIZED (SELECT tl.symbol, tl.tf, tl.start_seq, coalesce(lg.end_seq, tl.start_seq + 1) AS end_seq, lg.model IS NULL AS is_filler, coalesce(lg.model, 'SIMPLE_IMPULSE') AS model, coalesce(lg.score, 0.25::DOUBLE) AS score
      FROM tl LEFT JOIN lg ON lg.symbol = tl.symbol AND lg.start_seq = tl.start_seq WHERE tl.start_seq < (SELECT max(q) FROM pn l WHERE l.symbol = tl.symbol))"""


@query("e20_tile_series", sql(ranges_sql() + TILES + " SELECT symbol, tf, start_seq, end_seq, is_filler, model, round(score, 8) AS score FROM tr"))
def q_tiles(spark, sf):
    piv, n = readings(spark, sf)
    return wv.tile_series(wv.markup_ranges(n), piv).withColumn("score", F.round("score", 8))


@query(
    "e18_reading_tree",
    sql(
        ranges_sql()
        + TILES
        + """, tn AS (SELECT t.symbol, t.tf, t.start_seq AS root_start, t.end_seq AS root_end, ''::VARCHAR AS path, 0 AS depth, t.model, 1::BIGINT AS rank, t.start_seq, t.end_seq FROM tr t WHERE NOT t.is_filler
        UNION ALL SELECT c.symbol, c.tf, c.root_start, c.root_end, trim(c.path || ' ' || c.i), c.depth + 1,"""
        + f" {list(wv.MODEL_ORDER)}[c.way[c.i] // 1000]"
        + """, (c.way[c.i] % 1000)::BIGINT, c.cuts[c.i], c.cuts[c.i + 1] FROM (
          SELECT n.*, r.path AS way, CAST(string_split(r.split, '-') AS BIGINT[]) AS cuts, unnest(range(1, len(r.path) + 1)) AS i
          FROM tn n JOIN rd r ON r.symbol = n.symbol AND r.model = n.model AND r.start_seq = n.start_seq AND r.end_seq = n.end_seq AND r.rank = n.rank) c)
        SELECT symbol, tf, root_start, root_end, path, depth, model, start_seq, end_seq FROM tn"""
    ),
)
def q_tree(spark, sf):
    piv, n = readings(spark, sf)
    tiles = wv.tile_series(wv.markup_ranges(n), piv).where("not is_filler").select("symbol", "tf", "start_seq", "end_seq", "model").withColumn("rank", F.lit(1))
    tree = wv.reading_tree(n, cut(tiles))
    return tree.select("symbol", "tf", "root_start", "root_end", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), "depth", "model", "start_seq", "end_seq")


_SLOTS = [(m, i, float(sum(COEFFICIENT[c] for c in kids) + COEFFICIENT["SIMPLE_IMPULSE"])) for m, g in GRAMMAR.items() for i, kids in enumerate(g.values(), 1)]


@query(
    "r16_position_calibration",
    sql(
        f""", ed AS (SELECT model AS parent, i AS pos, {list(wv.MODEL_ORDER)}[path[i] // 1000] AS child FROM (SELECT model, path, unnest(range(1, len(path) + 1)) AS i FROM rd WHERE rank = 1)),
        ct AS (SELECT parent, CAST(pos AS INTEGER) AS pos, child, count(*) AS n FROM ed GROUP BY ALL),
        sh AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY parent, pos) AS share FROM ct)
        SELECT s.parent, s.pos, child, n, round(share, 6) AS share, round(share * budget, 6) AS probability FROM sh s JOIN {values(_SLOTS)} AS b(parent, pos, budget) ON b.parent = s.parent AND b.pos = s.pos"""
    ),
)
def q_calibration(spark, sf):
    return wv.position_calibration(readings(spark, sf)[1]).withColumns({c: F.round(c, 6) for c in ("share", "probability")})


@query(
    "e33_bonuses_v1",
    sql(
        f""", nm AS (SELECT *, list_transform(path, lambda c: {list(wv.MODEL_ORDER)}[c // 1000]) AS names FROM rd),
        bo AS (SELECT *, 1 + 0.5 * len(list_filter(names, lambda c: c <> 'SIMPLE_IMPULSE'))::DOUBLE / len(names) AS coverage_bonus,
          CASE WHEN (model LIKE '%ZIGZAG' OR model LIKE 'FLAT%') AND names[2] LIKE 'TRIANGLE%' THEN 2::DOUBLE ELSE 1::DOUBLE END AS triangle_bonus FROM nm)
        SELECT symbol, tf, model, start_seq, end_seq, rank, round(coverage_bonus, 6) AS coverage_bonus, triangle_bonus, round(score * coverage_bonus * triangle_bonus, 8) AS score FROM bo"""
    ),
)
def q_bonuses(spark, sf):
    b = wv.bonuses_v1(readings(spark, sf)[1])
    return b.select("symbol", "tf", "model", "start_seq", "end_seq", F.col("rank").cast("long").alias("rank"), F.round("coverage_bonus", 6).alias("coverage_bonus"), "triangle_bonus", F.round("score", 8).alias("score"))
