"""Candle-pattern queries and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwave.operators import candles as cd
from barwave.plans.oracle import with_bars
from barwave.plans.registry import query
from barwave.sources.ticks import walk_bars

_lags = ", ".join(
    f"lag({n}, {k}) OVER k AS {n[0]}{k + 1}"
    for k in range(10)
    for n in (("high", "low", "open", "close") if k < 4 else ("high", "low"))
)
_ext = ", ".join(
    f"max(high) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS mh{k}, "
    f"min(low) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS ml{k}"
    for k in range(2, 10)
)
LAG_SQL = f""", lg0 AS (SELECT symbol, tf, bar_index, close, {_lags}, {_ext} FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY bar_index)),
    lg AS MATERIALIZED (SELECT *, {cd.mother_offset()} AS mother FROM lg0 WHERE bar_index >= 9)"""


def patterns_sql(name: str = "pats", strength: bool = False) -> str:
    preds = cd.predicates(2)
    parts = []
    for n, (bull, *_rest) in cd.SETTINGS.items():
        bars, stop, at, limit = cd.level_texts(n)
        parts.append(
            f"SELECT symbol, tf, bar_index, close, '{n}' AS pattern, {str(bull).lower()} AS is_bull, CAST({bars} AS INTEGER) AS bars, "
            f"{stop} AS stop, CAST({at} AS BIGINT) AS stop_bar, {limit} AS limit_price FROM lg WHERE {cd.fires(n, preds, strength)}"
        )
    return LAG_SQL + f", {name} AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


@query("c29_candle_patterns", with_bars(patterns_sql() + " SELECT symbol, tf, bar_index, pattern, is_bull, bars FROM pats"))
def q_patterns(spark, sf):
    return cd.candle_patterns(walk_bars(spark, sf)).select("symbol", "tf", "bar_index", "pattern", "is_bull", "bars")


@query(
    "c29_candle_patterns_strength",
    with_bars(patterns_sql(strength=True) + " SELECT symbol, tf, bar_index, pattern, is_bull, bars FROM pats"),
)
def q_patterns_strength(spark, sf):
    return cd.candle_patterns(walk_bars(spark, sf), use_strength=True).select("symbol", "tf", "bar_index", "pattern", "is_bull", "bars")


for _names in (
    ("c01_c02_hammers", ("HAMMER", "INVERTED_HAMMER")),
    ("c03_c04_pin_bars", ("UP_PIN_BAR", "DOWN_PIN_BAR")),
    ("c05_c06_pin_bar_trios", ("UP_PIN_BAR_TRIO", "DOWN_PIN_BAR_TRIO")),
    ("c07_c08_outer_bars", ("UP_OUTER_BAR", "DOWN_OUTER_BAR")),
    ("c09_c10_outer_bodies", ("UP_OUTER_BAR_BODIES", "DOWN_OUTER_BAR_BODIES")),
    ("c11_c12_inner_bars", ("UP_INNER_BAR", "DOWN_INNER_BAR")),
    ("c13_c14_pprs", ("UP_PPR", "DOWN_PPR")),
    ("c15_c16_rails", ("UP_RAILS", "DOWN_RAILS")),
    ("c17_c18_ppr_inner", ("UP_PPR_IB", "DOWN_PPR_IB")),
    ("c19_c20_double_inner", ("UP_DOUBLE_INNER_BAR", "DOWN_DOUBLE_INNER_BAR")),
    ("c21_c22_mother_bars", ("UP_CPPR", "DOWN_CPPR")),
    ("c23_c24_dojis", ("UP_DOJI", "DOWN_DOJI")),
    ("c25_c26_piercing_cloud", ("PIECING_LINE", "DARK_CLOUD")),
    ("c27_c28_haramis", ("UP_HARAMI", "DOWN_HARAMI")),
):
    _key, _pair = _names

    @query(
        _key,
        with_bars(
            patterns_sql()
            + f" SELECT symbol, tf, bar_index, pattern, bars, stop, stop_bar FROM pats WHERE pattern IN ('{_pair[0]}', '{_pair[1]}')"
        ),
    )
    def _q(spark, sf, pair=_pair):
        return cd.candle_patterns(walk_bars(spark, sf), patterns=pair).select(
            "symbol", "tf", "bar_index", "pattern", "bars", "stop", "stop_bar"
        )


@query("c30_pattern_levels", with_bars(patterns_sql() + " SELECT symbol, tf, bar_index, pattern, stop, stop_bar, limit_price FROM pats"))
def q_levels(spark, sf):
    return cd.candle_patterns(walk_bars(spark, sf)).select("symbol", "tf", "bar_index", "pattern", "stop", "stop_bar", "limit_price")


@query(
    "c31_pine_patterns",
    with_bars(
        LAG_SQL.replace("WHERE bar_index >= 9", "WHERE bar_index >= 1")
        + " "
        + " UNION ALL ".join(
            f"SELECT symbol, tf, bar_index, '{n}' AS pattern FROM lg WHERE {t.format(m=repr(15 * 0.01))}" for n, t in cd.PINE.items()
        )
    ),
)
def q_pine(spark, sf):
    return cd.pine_patterns(walk_bars(spark, sf))


@query(
    "c32_pattern_rectangle",
    with_bars(
        patterns_sql()
        + """ SELECT p.symbol, p.tf, p.bar_index, p.pattern, min(b.low) AS rect_low, max(b.high) AS rect_high
        FROM pats p JOIN bars b ON b.symbol = p.symbol AND b.bar_index BETWEEN p.bar_index - p.bars + 1 AND p.bar_index GROUP BY 1, 2, 3, 4"""
    ),
)
def q_rect(spark, sf):
    bars = walk_bars(spark, sf)
    return cd.pattern_rectangle(cd.candle_patterns(bars), bars)


@query(
    "w11_pattern_histogram",
    with_bars(
        patterns_sql()
        + """, n AS (SELECT symbol, bar_index, sum(CASE WHEN is_bull THEN 1 ELSE -1 END) AS net FROM pats
          WHERE pattern IN ('UP_PPR', 'DOWN_PPR') GROUP BY 1, 2)
        SELECT b.symbol, b.tf, b.bar_index, CAST(sum(coalesce(net, 0)) OVER (PARTITION BY b.symbol ORDER BY b.bar_index
          ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS histogram FROM bars b LEFT JOIN n USING (symbol, bar_index)"""
    ),
)
def q_histogram(spark, sf):
    return cd.pattern_histogram(walk_bars(spark, sf))
