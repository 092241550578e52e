"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from barwave.plans import load
from barwave.plans.registry import QUERIES
from barwave.session import session

HEADLINE = (
    "s17_ticks_to_bars", "w01_sma", "w05_atr", "w06_rsi", "w09_supertrend", "z03_zigzag_pct", "z05_zigzag_pivots",
    "c29_candle_patterns", "flagship_pattern_outcomes", "g14_signal_outcomes_sl_first", "r04_target_stop_grid",
    "m05_max_overlap", "m11_uniformity", "h10_harmonic_items", "h20_h21_gartley_items", "e16_wave_candidates", "t05_action_flags",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    QUERIES["w01_sma"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
