"""Blocked series: how one long key is spread over many tasks.

A series is the rows of one key ordered by a dense ``bar_index``.  Nothing here gives a whole key
to one task.  A series is cut into blocks of ``BLOCK`` bars, and

* a bounded frame is evaluated per block, each block also getting the few rows its frames reach
  into (``framed``);
* a running total is a total per block, a prefix over the small block table, and a window inside
  the block (``running_sum``);
* an order-dependent recurrence is folded per block from a guessed entry state; the guess is checked
  against the exit of the block before and only the blocks that guessed wrong are folded again
  (``fold_series``), so the result equals the single sequential pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwave.session import cut

KEY = ("symbol", "tf")
BLOCK = 4096


def block_of(col: str | Column = "bar_index", block: int = BLOCK) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(block)).cast("long")


def with_bar_index(df: DataFrame, keys: Sequence[str] = KEY, time: str = "open_time") -> DataFrame:
    """Dense 0-based index by time: count per day, prefix over days, row number inside the day."""
    keys = list(keys)
    df = df.withColumn("_day", F.to_date(time))
    days = df.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_day").orderBy(time)
    return (
        df.join(days, [*keys, "_day"])
        .withColumn("bar_index", (F.col("_base") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_day", "_base")
    )


def halo(df: DataFrame, before: int, after: int = 0, order: str = "bar_index", block: int = BLOCK) -> DataFrame:
    """Send each row to its own block and to the blocks whose frames reach it.

    Adds ``_blk`` and ``_own`` (true in the row's own block).  A frame of at most ``block`` rows
    duplicates a row at most once on either side.
    """
    lo = F.greatest(block_of(F.col(order) - after, block), F.lit(0).cast("long"))
    hi = block_of(F.col(order) + before, block)
    return df.withColumn("_blk", F.explode(F.sequence(lo, hi))).withColumn(
        "_own", F.col("_blk") == block_of(order, block)
    )


def framed(
    df: DataFrame,
    before: int,
    after: int,
    *stages: Callable[[WindowSpec], dict[str, Column]],
    keys: Sequence[str] = KEY,
    order: str = "bar_index",
    block: int = BLOCK,
) -> DataFrame:
    """Add bounded-frame window columns; later stages may read the columns of earlier ones.

    ``before``/``after`` bound the rows that all stages together reach behind and ahead.
    """
    out = halo(df, before, after, order, block)
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    for stage in stages:
        out = out.withColumns(stage(w))
    return out.where("_own").drop("_blk", "_own")


def running_sum(
    df: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = KEY,
    order: str = "bar_index",
    block: int = BLOCK,
) -> DataFrame:
    """Sum from the first row of the key to the current row, inclusive; ``order`` is a dense index."""
    keys = list(keys)
    df = df.withColumn("_blk", block_of(order, block))
    totals = df.groupBy(*keys, "_blk").agg(F.sum(value).alias("_t"))
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_blk", F.sum("_t").over(prior).alias("_base"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    return (
        df.join(totals, [*keys, "_blk"])
        .withColumn(out, F.coalesce(F.col("_base"), zero) + F.coalesce(F.sum(value).over(inside), zero))
        .drop("_blk", "_base")
    )


def with_seq(df: DataFrame, keys: Sequence[str], order: str, out: str = "seq", block: int = BLOCK) -> DataFrame:
    """Dense 0-based rank by a sparse, unique integer ``order`` (a bar index), blocked like the bars."""
    keys = list(keys)
    df = df.withColumn("_blk", block_of(order, block))
    counts = df.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_blk", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    return (
        df.join(counts, [*keys, "_blk"])
        .withColumn(out, (F.col("_base") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_blk", "_base")
    )


@dataclass(frozen=True)
class Fold:
    """An ordered recurrence: ``step(state, bar_index, *inputs) -> (state, output tuple or None)``.

    The same ``step`` serves batch blocks and streaming state.  ``state`` is a flat tuple described
    by a DDL string; ``start`` is the state before the first bar.  ``warmup`` is how many bars ahead
    of its block a guess starts; it affects speed only, never the result.
    """

    inputs: tuple[str, ...]
    state: str
    output: str
    start: tuple
    step: Callable
    warmup: int = 512
    tolerance: float = 0.0


def _fields(ddl: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(ddl).fields)


_CHUNK_ROWS = "o"
_CHUNK_STATE = "s"


def _num(v):
    return None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v


def _as_state(row: Sequence, fields: list[T.StructField]) -> tuple:
    conv = {"bigint": int, "int": int, "double": float, "boolean": bool, "string": str}
    return tuple(None if _num(v) is None else conv[f.dataType.simpleString()](v) for v, f in zip(row, fields))


def _fold_block(fold: Fold, keys: list[str], order: str, block: int, given_entry: bool):
    sf, of = _fields(fold.state), _fields(fold.output)
    out_names = [f.name for f in of]
    columns = [*keys, "_blk", "_kind", order, *out_names, *[f"_e_{f.name}" for f in sf], *[f"_x_{f.name}" for f in sf]]
    entry_cols = [f"_in_{f.name}" for f in sf]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        blk = int(pdf["_blk"].iloc[0])
        key_vals = [pdf[k].iloc[0] for k in keys]
        idx = pdf[order].tolist()
        cols = [pdf[c].tolist() for c in fold.inputs]
        state = _as_state([pdf[c].iloc[0] for c in entry_cols], sf) if given_entry else fold.start
        step, begin = fold.step, blk * block
        entry, rows = None, []
        for i, *vals in zip(idx, *cols):
            if i < begin:
                state, _ = step(state, i, *vals)
                continue
            if entry is None:
                entry = state
            state, out = step(state, i, *vals)
            if out is not None:
                rows.append((*key_vals, blk, _CHUNK_ROWS, i, *out, *([None] * (2 * len(sf)))))
        if entry is not None:
            rows.append((*key_vals, blk, _CHUNK_STATE, None, *([None] * len(of)), *entry, *state))
        frame = pd.DataFrame(rows, columns=columns)
        return frame.astype({c: object for c in columns}) if len(frame) == 0 else frame

    return run, sf, of


def fold_series(
    bars: DataFrame, fold: Fold, keys: Sequence[str] = KEY, order: str = "bar_index", block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Run a recurrence over every key. Returns (outputs per bar, final state per key)."""
    keys = list(keys)
    run, sf, of = _fold_block(fold, keys, order, block, given_entry=False)
    rerun, _, _ = _fold_block(fold, keys, order, block, given_entry=True)
    key_types = {f.name: f.dataType for f in bars.schema.fields}
    schema = T.StructType(
        [T.StructField(k, key_types[k]) for k in keys]
        + [T.StructField("_blk", T.LongType()), T.StructField("_kind", T.StringType()), T.StructField(order, T.LongType())]
        + [T.StructField(f.name, f.dataType) for f in of]
        + [T.StructField(f"_e_{f.name}", f.dataType) for f in sf]
        + [T.StructField(f"_x_{f.name}", f.dataType) for f in sf]
    )
    need = bars.select(*keys, order, *[c for c in fold.inputs if c != order and c not in keys])
    spread = halo(need, min(fold.warmup, block), 0, order, block).drop("_own")
    done = cut(spread.groupBy(*keys, "_blk").applyInPandas(run, schema))

    while True:
        states = done.where(F.col("_kind") == _CHUNK_STATE)
        step_back = Window.partitionBy(*keys).orderBy("_blk")
        checked = states.withColumns({f"_in_{f.name}": F.lag(f"_x_{f.name}").over(step_back) for f in sf}).withColumn(
            "_first", F.row_number().over(step_back) == 1
        )
        same = reduce(lambda a, b: a & b, [_agrees(f, fold.tolerance) for f in sf])
        wrong = checked.where(~F.col("_first") & ~same).select(*keys, "_blk", *[f"_in_{f.name}" for f in sf])
        if wrong.isEmpty():
            break
        redo = need.withColumn("_blk", block_of(order, block)).join(wrong, [*keys, "_blk"])
        redone = redo.groupBy(*keys, "_blk").applyInPandas(rerun, schema)
        kept = done.join(wrong.select(*keys, "_blk"), [*keys, "_blk"], "left_anti")
        done = cut(kept.unionByName(redone))

    outputs = done.where(F.col("_kind") == _CHUNK_ROWS).select(*keys, order, *[f.name for f in of])
    finals = (
        done.where(F.col("_kind") == _CHUNK_STATE)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*[F.col(f"_x_{f.name}").alias(f.name) for f in sf]), "_blk").alias("_s"))
        .select(*keys, "_s.*")
    )
    return outputs, finals


def _agrees(f: T.StructField, tolerance: float) -> Column:
    e, p = F.col(f"_e_{f.name}"), F.col(f"_in_{f.name}")
    exact = e.eqNullSafe(p)
    if tolerance and isinstance(f.dataType, T.DoubleType):
        return exact | F.coalesce(F.abs(e - p) <= tolerance * F.greatest(F.abs(p), F.lit(1.0)), F.lit(False))
    return exact
