"""Setup finders: patterns -> signals with levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwave.functions.prices import break_even_price
from barwave.operators.joins import first_hit
from barwave.operators.outcomes import slim

SL_ALLOWANCE = 0.1  # share of the stop distance added beyond a candle pattern's stop


def pattern_levels_to_signal(p: DataFrame, price: str) -> DataFrame:
    """Stop widened by the allowance, target one stop distance away."""
    gap = F.abs(F.col(price) - F.col("stop"))
    side = F.when(F.col("is_bull"), 1.0).otherwise(-1.0)
    return p.where(gap > 0).withColumns(
        {
            "entry": F.col(price),
            "tp": F.col(price) + side * gap,
            "sl": F.col("stop") - side * gap * SL_ALLOWANCE,
            "is_long": F.col("is_bull"),
        }
    )


def price_action_setups(patterns: DataFrame, bars: DataFrame, break_even_ratio: float | None = None) -> DataFrame:
    """Signals of candle patterns: at the close, or when the limit price is touched before the stop.

    ``scan_from`` is the last bar not yet examined for the outcome: a limit entry is examined on its
    own bar, an entry at the close from the next bar.  Of an up/down pair born on one bar the one
    touched first cancels the other (the upward one on a tie).
    """
    at_close = pattern_levels_to_signal(patterns.where(F.col("limit_price").isNull()), "close")
    at_close = at_close.withColumn("entry_bar", F.col("bar_index")).withColumn("scan_from", F.col("bar_index"))

    ident = ["symbol", "tf", "pat_bar", "pattern"]
    waiting = patterns.where(F.col("limit_price").isNotNull()).withColumnRenamed("bar_index", "pat_bar").drop("close")
    bull = F.col("is_bull")
    hit_limit = F.when(bull, F.col("high") >= F.col("limit_price")).otherwise(F.col("low") <= F.col("limit_price"))
    hit_stop = F.when(bull, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    bar = F.col("bar_index")
    touched = first_hit(
        waiting, slim(bars), ident, "pat_bar",
        [F.min(F.when(hit_limit, bar)).alias("_touch"), F.min(F.when(hit_stop, bar)).alias("_stop")],
        F.col("_touch").isNotNull() | F.col("_stop").isNotNull(),
    )
    far = F.lit(2**62)
    live = touched.where(F.coalesce("_touch", far) < F.coalesce("_stop", far))
    family = F.regexp_replace("pattern", "^(UP|DOWN)_", "")
    pair = Window.partitionBy("symbol", "tf", "pat_bar", family).orderBy("_touch", F.col("is_bull").desc())
    live = live.withColumn("_k", F.row_number().over(pair)).where(F.col("_k") == 1)
    live = live.withColumn("bar_index", F.col("pat_bar")).withColumn("entry_bar", F.col("_touch"))
    live = pattern_levels_to_signal(live, "limit_price").withColumn("scan_from", F.col("entry_bar") - 1)
    cols = ["symbol", "tf", "pattern", "is_long", "bar_index", "entry_bar", "scan_from", "entry", "tp", "sl"]
    out = at_close.select(*cols).unionByName(live.select(*cols))
    out = out.withColumn("signal_id", F.concat_ws("|", "symbol", "tf", F.lit("PA"), "pattern", "bar_index"))
    if break_even_ratio is not None:
        out = out.withColumn("break_even", break_even_price(F.col("tp"), F.col("sl"), break_even_ratio))
    return out.withColumnRenamed("bar_index", "pattern_bar")
