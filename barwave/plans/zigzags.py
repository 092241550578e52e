"""Pivot and zigzag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import pivots as pv
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.sources.ticks import walk_bars

DEV = 0.5


def zigzag_sql(name: str = "zz", dev: str = "0.5::DOUBLE", seed_low: bool = False) -> str:
    """Recursive percent zigzag over ``bars``; leaves the pivots in CTE ``name``."""
    seed = "low" if seed_low else "high"
    return f""", {name}_r AS (SELECT symbol, tf, bar_index, false AS up, {seed} AS ext, bar_index AS ap, NULL::BIGINT AS pbar, NULL::DOUBLE AS pval, NULL::BOOLEAN AS phigh
      FROM bars WHERE bar_index = 0
    UNION ALL SELECT b.symbol, b.tf, b.bar_index,
      CASE WHEN r.up AND b.high < r.ext AND b.low <= r.ext * (1.0::DOUBLE - {dev} * 0.01::DOUBLE) THEN false
           WHEN NOT r.up AND b.low > r.ext AND b.high >= r.ext * (1.0::DOUBLE + {dev} * 0.01::DOUBLE) THEN true ELSE r.up END,
      CASE WHEN r.up AND b.high >= r.ext THEN b.high
           WHEN r.up AND b.low <= r.ext * (1.0::DOUBLE - {dev} * 0.01::DOUBLE) THEN b.low WHEN r.up THEN r.ext
           WHEN b.low <= r.ext THEN b.low WHEN b.high >= r.ext * (1.0::DOUBLE + {dev} * 0.01::DOUBLE) THEN b.high ELSE r.ext END,
      CASE WHEN r.up AND (b.high >= r.ext OR b.low <= r.ext * (1.0::DOUBLE - {dev} * 0.01::DOUBLE)) THEN b.bar_index WHEN r.up THEN r.ap
           WHEN b.low <= r.ext OR b.high >= r.ext * (1.0::DOUBLE + {dev} * 0.01::DOUBLE) THEN b.bar_index ELSE r.ap END,
      CASE WHEN r.up AND b.high < r.ext AND b.low <= r.ext * (1.0::DOUBLE - {dev} * 0.01::DOUBLE) THEN r.ap
           WHEN NOT r.up AND b.low > r.ext AND b.high >= r.ext * (1.0::DOUBLE + {dev} * 0.01::DOUBLE) THEN r.ap END,
      CASE WHEN r.up AND b.high < r.ext AND b.low <= r.ext * (1.0::DOUBLE - {dev} * 0.01::DOUBLE) THEN r.ext
           WHEN NOT r.up AND b.low > r.ext AND b.high >= r.ext * (1.0::DOUBLE + {dev} * 0.01::DOUBLE) THEN r.ext END,
      r.up
      FROM {name}_r r JOIN bars b ON b.symbol = r.symbol AND b.bar_index = r.bar_index + 1),
    {name} AS MATERIALIZED (SELECT symbol, tf, pbar AS bar_index, pval AS value, phigh AS is_high, false AS is_last FROM {name}_r WHERE pbar IS NOT NULL
    UNION ALL SELECT symbol, tf, ap, ext, up, true FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_index DESC) AS k FROM {name}_r) WHERE k = 1)"""


def legs_sql(name: str = "legs", src: str = "zz") -> str:
    return f""", {name} AS MATERIALIZED (SELECT symbol, tf, seq, bar_index AS start_bar, value AS start_value, end_bar, end_value,
      end_value > value AS is_up, abs(end_value - value) AS length, end_bar - bar_index + 1 AS bars, open_end FROM (
      SELECT *, row_number() OVER k - 1 AS seq, lead(bar_index) OVER k AS end_bar, lead(value) OVER k AS end_value, lead(is_last) OVER k AS open_end
      FROM {src} WINDOW k AS (PARTITION BY symbol ORDER BY bar_index, is_high DESC)) WHERE end_bar IS NOT NULL)"""


def fractal_sql(p: int, name: str = "fp") -> str:
    return f""", {name}_r AS (SELECT symbol, tf, {p - 1}::BIGINT AS bar_index, 0::BIGINT AS last, false AS is_high, false AS is_low FROM bars WHERE bar_index = {2 * p}
    UNION ALL SELECT symbol, tf, bar_index, CASE WHEN gh OR gl THEN bar_index ELSE last END, gh, gl FROM (
      SELECT r.symbol, r.tf, r.bar_index + 1 AS bar_index, r.last,
        NOT bool_or(b.high > m.high) AS gh, NOT bool_or(b.low < m.low) AS gl
      FROM {name}_r r JOIN bars m ON m.symbol = r.symbol AND m.bar_index = r.bar_index + 1
        JOIN bars f ON f.symbol = r.symbol AND f.bar_index = r.bar_index + 1 + {p}
        JOIN bars b ON b.symbol = r.symbol AND b.bar_index >= greatest(r.bar_index + 1 - {p}, r.last) AND b.bar_index < r.bar_index + 1 + {p}
      GROUP BY r.symbol, r.tf, r.bar_index, r.last)),
    {name} AS MATERIALIZED (SELECT symbol, tf, bar_index, is_high, is_low FROM {name}_r WHERE is_high OR is_low)"""


@query("z01_fractal_pivots", with_bars(fractal_sql(5) + " SELECT * FROM fp", recursive=True))
def q_fractal(spark, sf):
    return pv.fractal_pivots(walk_bars(spark, sf), 5)


@query(
    "z02_fractal_pivots_pine",
    with_bars(
        """, p AS (SELECT symbol, tf, bar_index,
          max(high) OVER o <= high AND max(high) OVER n < high AS is_high, min(low) OVER o >= low AND min(low) OVER n > low AS is_low,
          bar_index >= 5 AND bar_index + 5 <= max(bar_index) OVER (PARTITION BY symbol) AS ok FROM bars
          WINDOW o AS (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
                 n AS (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
        SELECT symbol, tf, bar_index, is_high, is_low FROM p WHERE ok AND (is_high OR is_low)"""
    ),
)
def q_fractal_pine(spark, sf):
    return pv.fractal_pivots_pine(walk_bars(spark, sf), 5).select("symbol", "tf", "bar_index", "is_high", "is_low")


@query("z03_zigzag_pct", with_bars(zigzag_sql() + " SELECT * FROM zz", recursive=True))
def q_zigzag(spark, sf):
    return pv.zigzag_pct(walk_bars(spark, sf), DEV)


def _bps_sql() -> str:
    # 30 basis points as a percent zigzag whose first extremum is the first low
    return zigzag_sql("zz", "X", True).replace("(1.0::DOUBLE - X * 0.01::DOUBLE)", "(1.0::DOUBLE + 30 * -0.0001::DOUBLE)").replace(
        "(1.0::DOUBLE + X * 0.01::DOUBLE)", "(1.0::DOUBLE + 30 * 0.0001::DOUBLE)"
    )


@query("z04_zigzag_bps", with_bars(_bps_sql() + " SELECT * FROM zz", recursive=True))
def q_zigzag_bps(spark, sf):
    return pv.zigzag_bps(walk_bars(spark, sf), 30)


PIVOT_ZZ_SQL = fractal_sql(5) + """, fn AS (SELECT fp.*, b.high, b.low, row_number() OVER (PARTITION BY fp.symbol ORDER BY fp.bar_index) AS n
      FROM fp JOIN bars b USING (symbol, bar_index)),
    pz_r AS (SELECT symbol, tf, 0::BIGINT AS n, false AS up, NULL::DOUBLE AS ext, NULL::BIGINT AS ap, NULL::BIGINT AS pbar, NULL::DOUBLE AS pval, NULL::BOOLEAN AS phigh FROM fn WHERE n = 1
    UNION ALL SELECT f.symbol, f.tf, f.n,
      CASE WHEN r.up AND f.is_low THEN false WHEN NOT r.up AND f.is_high THEN true ELSE r.up END,
      CASE WHEN r.up AND f.is_low THEN f.low WHEN r.up AND f.is_high AND (r.ext IS NULL OR f.high >= r.ext) THEN f.high WHEN r.up THEN r.ext
           WHEN f.is_high THEN f.high WHEN f.is_low AND (r.ext IS NULL OR f.low <= r.ext) THEN f.low ELSE r.ext END,
      CASE WHEN r.up AND f.is_low THEN f.bar_index WHEN r.up AND f.is_high AND (r.ext IS NULL OR f.high >= r.ext) THEN f.bar_index WHEN r.up THEN r.ap
           WHEN f.is_high THEN f.bar_index WHEN f.is_low AND (r.ext IS NULL OR f.low <= r.ext) THEN f.bar_index ELSE r.ap END,
      CASE WHEN r.up AND f.is_low THEN CASE WHEN f.is_high AND f.high >= r.ext THEN f.bar_index ELSE r.ap END
           WHEN NOT r.up AND f.is_high THEN r.ap END,
      CASE WHEN r.up AND f.is_low THEN CASE WHEN f.is_high AND f.high >= r.ext THEN f.high ELSE r.ext END
           WHEN NOT r.up AND f.is_high THEN r.ext END,
      r.up FROM pz_r r JOIN fn f ON f.symbol = r.symbol AND f.n = r.n + 1),
    pz AS MATERIALIZED (SELECT symbol, tf, pbar AS bar_index, pval AS value, phigh AS is_high, false AS is_last FROM pz_r WHERE pbar IS NOT NULL
    UNION ALL SELECT symbol, tf, ap, ext, up, true FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS k FROM pz_r) WHERE k = 1 AND ap IS NOT NULL)"""


@query("z05_zigzag_pivots", with_bars(PIVOT_ZZ_SQL + " SELECT * FROM pz", recursive=True))
def q_zigzag_pivots(spark, sf):
    return pv.zigzag_pivots(walk_bars(spark, sf), 5)


@query("z12_segments", with_bars(zigzag_sql() + legs_sql() + " SELECT * FROM legs", recursive=True))
def q_segments(spark, sf):
    return pv.segments(pv.zigzag_pct(walk_bars(spark, sf), DEV))


@query(
    "z14_deviation_sweep",
    with_bars(
        "".join(zigzag_sql(f"z{i}", f"{d}::DOUBLE") for i, d in enumerate((0.25, 0.5, 1.0, 2.0)))
        + " ".join(
            f"{'UNION ALL' if i else ''} SELECT symbol, tf, {d}::DOUBLE AS dev, count(*) AS pivots FROM z{i} GROUP BY ALL"
            for i, d in enumerate((0.25, 0.5, 1.0, 2.0))
        ),
        recursive=True,
    ),
)
def q_sweep(spark, sf):
    return pv.deviation_counts(walk_bars(spark, sf), F.array(*[F.lit(d) for d in (0.25, 0.5, 1.0, 2.0)]))


@query("z14_optimal_deviation")
def q_optimal(spark, sf):
    return pv.optimal_deviation(walk_bars(spark, sf)).withColumn("deviation", F.round("deviation", 9))
