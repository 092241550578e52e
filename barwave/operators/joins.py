"""As-of and interval joins as equi-joins on time or index buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.operators.series import KEY, block_of
from barwave.session import cut


def epoch_us(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    values: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    tolerance_seconds: float | None = None,
    bucket_seconds: int = 86400,
    right_on: str | None = None,
) -> DataFrame:
    """Latest (``backward``) or next (``forward``) right row per left row; adds ``values`` and ``asof_time``.

    Rows of both sides meet in one time bucket per key; what lies in earlier buckets arrives through
    the last row of each bucket, carried over a table with one row per (key, bucket).
    """
    by = list(by)
    sign = 1 if direction == "backward" else -1
    width = bucket_seconds * 1_000_000
    payload = F.struct(F.col(right_on or on).alias("asof_time"), *[F.col(v).alias(v) for v in values])
    # on equal times a right row must come first when ties match, last when they do not
    at = (epoch_us(right_on or on) * sign).alias("_t")
    # one row per key and time: of equal times the largest payload counts
    r = right.groupBy(*by, at).agg(F.max(payload).alias("_r")).withColumn("_side", F.lit(2 if strict else 0))
    l = left.select(*by, (epoch_us(on) * sign).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    u = l.unionByName(r, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    per_bucket = u.groupBy(*by, "_b").agg(
        F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_last")
    )
    prior = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*by, "_b", F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    inside = Window.partitionBy(*by, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        u.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside))
        .where(F.col("_l").isNotNull())
        .join(carry, [*by, "_b"], "left")
        .withColumn("_hit", F.coalesce("_hit", "_carry"))
    )
    if tolerance_seconds is not None:
        gap = F.abs(epoch_us(F.col("_hit.asof_time")) * sign - F.col("_t"))
        out = out.withColumn("_hit", F.when(gap <= tolerance_seconds * 1e6, F.col("_hit")))
    return out.select("_l.*", "_hit.asof_time", *[f"_hit.{v}" for v in values])


def range_join(
    intervals: DataFrame,
    bars: DataFrame,
    start: str = "start_bar",
    end: str = "end_bar",
    keys: Sequence[str] = KEY,
    block: int = 256,
    how: str = "inner",
    index: str = "bar_index",
) -> DataFrame:
    """``intervals`` with every bar in [start, end]: one equi-join on (key, index bucket).

    An interval is sent only to the buckets it covers, so a long interval is shared out over many
    tasks and no nested-loop join is planned.
    """
    keys = list(keys)
    cut_up = intervals.withColumn(
        "_bkt", F.explode(F.sequence(block_of(start, block), block_of(end, block)))
    ).where(F.col(start) <= F.col(end))
    b = bars.withColumn("_bkt", block_of(index, block))
    joined = cut_up.join(b, [*keys, "_bkt"], how).drop("_bkt")
    return joined.where(F.col(index).between(F.col(start), F.col(end)))


def first_hit(
    candidates: DataFrame,
    bars: DataFrame,
    ident: Sequence[str],
    start: str,
    aggregates: Sequence[Column],
    resolved: Column,
    end: str | None = None,
    keys: Sequence[str] = KEY,
    horizons: Sequence[int] = (64, 1024, 16384),
) -> DataFrame:
    """Aggregate the bars after ``start`` per candidate, looking ahead in growing steps.

    Most candidates meet their bar within a short look-ahead; only those still unresolved are joined
    with a longer one, and the last step has no bound.  ``aggregates`` must be first-touch minima,
    which a longer look-ahead cannot change once ``resolved`` holds.
    """
    keys, ident = list(keys), list(ident)
    last_bar = bars.groupBy(*keys).agg(F.max("bar_index").alias("_last"))
    todo = cut(candidates.join(last_bar, keys))
    done = []
    for h in [*horizons, None]:
        stop = F.col("_last") if end is None else F.least(F.col("_last"), F.col(end))
        upto = stop if h is None else F.least(stop, F.col(start) + F.lit(h))
        span = todo.withColumn("_from", F.col(start) + 1).withColumn("_to", upto)
        hits = range_join(span, bars, "_from", "_to", keys).groupBy(*ident).agg(*aggregates)
        names = [c for c in hits.columns if c not in ident]
        step = cut(todo.join(hits, ident, "left"))
        if h is None:
            done.append(step)
            break
        complete = F.coalesce(resolved | (stop <= F.col(start) + F.lit(h)), F.lit(False))
        done.append(step.where(complete))
        todo = step.where(~complete).drop(*names)
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).drop("_last")
