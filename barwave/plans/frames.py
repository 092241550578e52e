"""Queries over two frames, price profiles and refined pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import frames as fr
from barwave.operators import pivots as pv
from barwave.plans.oracle import bars_cte, with_bars
from barwave.plans.registry import query
from barwave.plans.windows import _sma
from barwave.plans.zigzags import PIVOT_ZZ_SQL, zigzag_sql
from barwave.sources.ticks import bar_table, walk_bars


def frames_sql(*tfs: str, body: str) -> str:
    return "WITH " + ", ".join(bars_cte(t, f"b_{t}") for t in tfs) + " " + body


FIRST_SQL = """, hf AS MATERIALIZED (SELECT b.symbol, b.tf, b.bar_index, any_value(b.high) AS high, any_value(b.low) AS low,
    coalesce(arg_min(l.high = b.high, l.bar_index) FILTER ((l.high = b.high) <> (l.low = b.low)), false) AS is_high_first
    FROM b_h1 b JOIN b_m30 l ON l.symbol = b.symbol AND date_trunc('hour', l.open_time) = b.open_time GROUP BY 1, 2, 3)"""


@query("w19_is_high_first", frames_sql("h1", "m30", body=FIRST_SQL + " SELECT symbol, tf, bar_index, is_high_first FROM hf"))
def q_first(spark, sf):
    return fr.is_high_first(walk_bars(spark, sf), walk_bars(spark, sf, "m30"), "h1")


@query(
    "z07_exact_extrema",
    frames_sql(
        "h1", "m30",
        body=FIRST_SQL + """ SELECT symbol, tf, bar_index, 0::INTEGER AS pos, CASE WHEN is_high_first THEN high ELSE low END AS value, is_high_first AS is_high FROM hf
        UNION ALL SELECT symbol, tf, bar_index, 1::INTEGER, CASE WHEN is_high_first THEN low ELSE high END, NOT is_high_first FROM hf""",
    ),
)
def q_exact(spark, sf):
    bars = bar_table(spark, sf)
    return fr.exact_extrema(bars, fr.is_high_first(bars, walk_bars(spark, sf, "m30"), "h1"))


def _al(tf: str) -> str:
    return (
        f", g_{tf} AS (SELECT *, coalesce({_sma(13)}, 0) AS j, coalesce({_sma(8)}, 0) AS t, coalesce({_sma(5)}, 0) AS l FROM b_{tf}),"
        f" a_{tf} AS (SELECT *, CASE WHEN l > j AND l > t THEN 1 WHEN l < j AND l < t THEN -1 ELSE 0 END AS al FROM g_{tf})"
    )


@query(
    "w16_mtf_trend",
    frames_sql(
        "h1", "m30", "h2",
        body=_al("h1") + _al("m30") + _al("h2")
        + """, k AS (SELECT m.symbol, m.tf, m.bar_index, m.al + coalesce(l.al, 0) + coalesce(h.al, h2.al, 0) AS v FROM a_h1 m
          LEFT JOIN a_m30 l ON l.symbol = m.symbol AND l.open_time = m.open_time + INTERVAL 30 MINUTE
          LEFT JOIN a_h2 h ON h.symbol = m.symbol AND h.open_time = m.open_time LEFT JOIN a_h2 h2 ON h2.symbol = m.symbol AND h2.open_time = m.open_time - INTERVAL 2 HOUR)
        SELECT symbol, tf, bar_index, CASE v WHEN 3 THEN 'BULLISH' WHEN -3 THEN 'BEARISH' ELSE 'NO_TREND' END AS trend FROM k""",
    ),
)
def q_mtf(spark, sf):
    return fr.mtf_trend(walk_bars(spark, sf, "m30"), walk_bars(spark, sf), walk_bars(spark, sf, "h2"), "m30", "h1", "h2")


@query(
    "w20_volume_profile_groups",
    with_bars(
        """, p AS (SELECT symbol, CAST(floor(close / 50) AS BIGINT) AS key, sum(volume) AS value FROM bars GROUP BY 1, 2),
        m AS (SELECT symbol, list_sort(list(value)) AS v FROM p GROUP BY symbol), q AS (SELECT p.*, value >= v[len(v) // 2 + 1] AS ok FROM p JOIN m USING (symbol)),
        s AS (SELECT *, ok AND NOT coalesce(lag(ok) OVER (PARTITION BY symbol ORDER BY key), false) AS st FROM q),
        g AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY key) AS grp FROM s)
        SELECT symbol, grp, min(key) AS from_key, max(key) AS to_key, count(*) AS entries, sum(value) AS total FROM g WHERE ok GROUP BY 1, 2"""
    ),
)
def q_profile(spark, sf):
    b = walk_bars(spark, sf)
    p = b.groupBy("symbol", F.floor(F.col("close") / 50).cast("long").alias("key")).agg(F.sum("volume").alias("value"))
    return fr.volume_profile_groups(p)


@query("z08_zigzag_volume")
def q_volume(spark, sf):
    return fr.zigzag_volume(bar_table(spark, sf))


@query("z09_refine_corridors")
def q_corridors(spark, sf):
    bars = bar_table(spark, sf)
    return fr.refine_corridors(pv.zigzag_pivots(bars, 5), bars)


@query(
    "z10_reduce_to_alternating",
    with_bars(
        """, d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_index) AS n FROM bars),
        r AS (SELECT symbol, tf, n, NULL::DOUBLE AS prev, close AS cur, bar_index AS ap, NULL::DOUBLE AS ov, NULL::BIGINT AS ob FROM d WHERE n = 1
        UNION ALL SELECT d.symbol, d.tf, d.n, CASE WHEN d.close = r.cur THEN r.prev WHEN r.prev IS NULL THEN r.cur WHEN (r.cur > r.prev) = (d.close > r.cur) THEN r.prev ELSE r.cur END,
          d.close, CASE WHEN d.close = r.cur THEN r.ap ELSE d.bar_index END,
          CASE WHEN d.close <> r.cur AND (r.prev IS NULL OR (r.cur > r.prev) <> (d.close > r.cur)) THEN r.cur END,
          CASE WHEN d.close <> r.cur AND (r.prev IS NULL OR (r.cur > r.prev) <> (d.close > r.cur)) THEN r.ap END FROM r JOIN d ON d.symbol = r.symbol AND d.n = r.n + 1)
        SELECT symbol, tf, ob AS bar_index, ov AS value FROM r WHERE ov IS NOT NULL
        UNION ALL SELECT symbol, tf, ap, cur FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS k FROM r) WHERE k = 1""",
        recursive=True,
    ),
)
def q_alternating(spark, sf):
    b = walk_bars(spark, sf).select("symbol", "tf", "bar_index", F.col("close").alias("value"))
    return pv.reduce_to_alternating(b)
