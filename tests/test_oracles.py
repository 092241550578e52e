"""Queries against DuckDB on the smallest tables. BARWAVE_ALL=1 checks every query."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = (
    "flagship_pattern_outcomes", "w01_sma", "w04_bollinger", "w09_supertrend", "z01_fractal_pivots", "z05_zigzag_pivots", "c29_candle_patterns",
    "c30_pattern_levels", "g12_price_action_setups", "g16_break_even_move", "g21_progressive_risk", "r04_target_stop_grid", "r08_per_model_stats",
    "m03_envelope_area", "m05_max_overlap", "m07_overlap_index", "m14_smooth_impulse", "p09_has_trade_break", "p18_fib_weight", "s01_read_bars_csv",
    "h06_harmonic_score", "h16_gartley_xa_pairs", "e03_diagonal_rules", "e11_e14_scores_5", "e16_three_wave_candidates", "t05_action_flags",
    "t07_resolve_reply", "r18_segment_features", "x02_tumbling_bars", "x04_zigzag_state",
)
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("BARWAVE_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1).copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
        elif str(df[c].dtype) not in ("bool", "boolean"):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = norm(QUERIES[name](spark, SF).toPandas())
    want = norm(duck.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
