"""Fibonacci weight maps and their scores as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: (weight in percent, ratio)
FIB_MAPS: dict[str, tuple[tuple[int, float], ...]] = {
    "zigzag_c_to_a": ((5, 0.618), (60, 0.786), (75, 1.0), (85, 1.618), (90, 2.618), (95, 3.618)),
    "zigzag_z_to_w": ((5, 1.0), (25, 1.618), (50, 2.618), (80, 3.618), (90, 4.236)),
    "diagonal_3_to_1": ((5, 0.5), (15, 0.618), (20, 0.786)),
    "diagonal_correction": ((5, 0.382), (10, 0.5), (50, 0.618), (99, 0.66)),
    "diagonal_5_to_3": ((5, 0.35), (15, 0.5), (35, 0.618), (80, 0.677), (95, 0.786), (99, 0.9)),
    "impulse_3_to_1": ((5, 0.618), (10, 0.786), (15, 1.0), (80, 1.618), (90, 2.618), (97, 3.618), (99, 4.236)),
    "impulse_5_to_1": ((5, 0.382), (15, 0.618), (25, 0.786), (70, 1.0), (90, 1.618), (97, 2.618), (99, 3.618)),
    "deep_correction": ((5, 0.5), (55, 0.618), (85, 0.786), (99, 0.95)),
    "shallow_correction": ((5, 0.236), (35, 0.382), (85, 0.5)),
    "flat_extended_c_to_a": ((75, 1.618), (90, 2.618), (99, 3.618)),
    "flat_running_c_to_a": ((5, 0.5), (20, 0.618), (80, 1.0), (90, 1.272), (95, 1.618)),
    "flat_regular_c_to_a": ((70, 1.0), (90, 1.272), (99, 1.618)),
    "flat_extended_b_to_a": ((5, 0.786), (15, 1.0), (50, 1.236), (85, 1.382), (95, 1.618)),
    "flat_running_b_to_a": ((5, 0.786), (15, 1.0), (50, 1.236), (85, 1.382), (95, 1.618)),
    "flat_regular_b_to_a": ((70, 0.9), (90, 0.95), (99, 1.0)),
    "triangle_next_to_prev": ((5, 0.5), (20, 0.618), (80, 0.786), (90, 0.9), (95, 0.95)),
    "impulse_4_to_3": ((5, 0.118), (50, 0.172), (60, 0.236), (75, 0.382), (90, 0.5), (95, 0.618)),
}
DECAY, FLOOR, OVERSHOOT = 5.0, 0.001, 1.1
CORRECTION_RANGE = (0.236, 0.95)


def fib_weight(name: str, ratio: Column) -> Column:
    """Best decayed weight over the levels reached, relative to the heaviest level, at least 0.001."""
    levels = FIB_MAPS[name]
    heaviest = max(w for w, _ in levels) / 100.0
    reached = [
        F.when(ratio >= r, F.lit(w / 100.0) * F.exp(F.lit(-DECAY) * ((ratio - r) / r))).otherwise(0.0) for w, r in levels
    ]
    return F.greatest(F.lit(FLOOR), F.greatest(*reached) / heaviest)


def correction_weight(ratio: Column) -> Column:
    return F.greatest(fib_weight("deep_correction", ratio), fib_weight("shallow_correction", ratio))


def fib_range(name: str) -> tuple[float, float]:
    if name == "correction":
        return CORRECTION_RANGE[0], CORRECTION_RANGE[1] * OVERSHOOT
    levels = FIB_MAPS[name]
    return levels[0][1], levels[-1][1] * OVERSHOOT


def fib_in_range(name: str, ratio: Column) -> Column:
    lo, hi = fib_range(name)
    return (ratio >= lo) & (ratio <= hi)


def weight_of(name: str, ratio: Column) -> Column:
    return correction_weight(ratio) if name == "correction" else fib_weight(name, ratio)


def weight_text(name: str, ratio: str) -> str:
    """SQL text of ``weight_of`` for a ratio given as SQL text (one parse instead of many calls)."""
    if name == "correction":
        return f"greatest({weight_text('deep_correction', ratio)}, {weight_text('shallow_correction', ratio)})"
    levels = FIB_MAPS[name]
    heaviest = max(w for w, _ in levels) / 100.0
    reached = ", ".join(
        f"CASE WHEN {ratio} >= {r!r}D THEN {w / 100.0!r}D * exp({-DECAY!r}D * (({ratio} - {r!r}D) / {r!r}D)) ELSE 0.0D END" for w, r in levels
    )
    return f"greatest({FLOOR!r}D, greatest({reached}) / {heaviest!r}D)"
