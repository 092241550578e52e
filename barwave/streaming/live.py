"""The same operators on streams: tumbling bars, carried recurrences, triggers and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barwave.operators.series import KEY, Fold, _as_state, _fields
from barwave.sources.timeframes import SPAN

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory lives in RocksDB; stateful processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def bar_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Bars as they are appended to a folder: history first, then live, under one checkpoint."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def tick_stream(spark: SparkSession, folder: str, file: str = "events.parquet") -> DataFrame:
    """Ticks from the event table: symbol = event type, price = value."""
    schema = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
    ev = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    return ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def tumbling_bars(ticks: DataFrame, tf: str, delay: str = "10 minutes") -> DataFrame:
    """Closed bars only: a window is emitted once the watermark has passed it; later ticks are dropped."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{SPAN[tf]} seconds").alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def late_bar_drop(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """A bar seen before is dropped while the watermark remembers it."""
    return bars.withWatermark("open_time", delay).dropDuplicatesWithinWatermark([*KEY, "open_time"])


class _FoldProcessor(StatefulProcessor):
    """Carries a fold's state per key; a bar not newer than the last one is ignored."""

    def __init__(self, fold: Fold, keys: Sequence[str], order: str):
        self.fold, self.order = fold, order
        # types are parsed here, where a session exists
        self.fields = _fields(fold.state)
        self.names = [*keys, order, *[f.name for f in _fields(fold.output)]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("_last", T.LongType()), *self.fields])
        self.value = handle.getValueState("fold", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, state = -1, self.fold.start
        if self.value.exists():
            last, *held = self.value.get()
            state = _as_state(held, self.fields)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        out = []
        for i, *vals in zip(pdf[self.order].tolist(), *[pdf[c].tolist() for c in self.fold.inputs]):
            if i <= last:
                continue
            last = i
            state, emitted = self.fold.step(state, i, *vals)
            if emitted is not None:
                out.append((*key, i, *emitted))
        self.value.update((last, *state))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def fold_stream(bars: DataFrame, fold: Fold, keys: Sequence[str] = KEY, order: str = "bar_index") -> DataFrame:
    """A batch recurrence on a stream: one shuffle by key into the state operator."""
    use_rocksdb(bars.sparkSession)
    types = {f.name: f.dataType for f in bars.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys] + [T.StructField(order, T.LongType())] + [T.StructField(f.name, f.dataType) for f in _fields(fold.output)]
    )
    need = bars.select(*keys, order, *[c for c in fold.inputs if c not in (*keys, order)])
    return need.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_FoldProcessor(fold, keys, order), outputStructType=schema, outputMode="Append", timeMode="None"
    )


_SIGNAL = "is_long boolean, level double, tp double, sl double, active boolean"


class _Triggers(StatefulProcessor):
    """Open signals of one symbol against its ticks; entries leave on an end, or when their TTL runs out."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "signal_id string", _SIGNAL, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "kind"], kind="stable")
        book = {k[0]: list(v) for k, v in self.open.iterator()}
        touched, out = set(), []
        for r in pdf.itertuples(index=False):
            if r.kind == 0:
                book[r.signal_id] = [bool(r.is_long), r.level, r.tp, r.sl, not bool(r.is_limit)]
                touched.add(r.signal_id)
                continue
            for sid, (long, level, tp, sl, active) in list(book.items()):
                price = r.bid if long else r.ask
                gain = (price - tp) if long else (tp - price)
                loss = (sl - price) if long else (price - sl)
                event = None
                if gain >= 0:
                    event = "TP" if active else "CANCELED"
                elif loss >= 0:
                    event = "SL" if active else "CANCELED"
                elif not active and ((level - price) if long else (price - level)) >= 0:
                    book[sid][4] = True
                    touched.add(sid)
                    out.append((key[0], sid, r.ts, "ACTIVATED", price))
                if event:
                    out.append((key[0], sid, r.ts, event, price))
                    del book[sid]
                    touched.add(sid)
        for sid in touched:
            if sid in book:
                self.open.updateValue((sid,), tuple(book[sid]))
            elif self.open.containsKey((sid,)):
                self.open.removeKey((sid,))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "signal_id", "ts", "event", "price"])

    def close(self) -> None:
        pass


def tick_triggers(signals: DataFrame, ticks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Activation, cancellation and exits of signals tick by tick: the bid for longs, the ask for shorts.

    ``signals``: symbol, ts, signal_id, is_long, level, tp, sl, is_limit. ``ticks``: symbol, ts, bid, ask.
    """
    use_rocksdb(ticks.sparkSession)
    s = signals.select("symbol", "ts", F.lit(0).alias("kind"), "signal_id", "is_long", "level", "tp", "sl", "is_limit")
    t = ticks.select("symbol", "ts", F.lit(1).alias("kind"), "bid", "ask")
    both = s.unionByName(t, allowMissingColumns=True)
    return both.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Triggers(ttl_ms), outputStructType="symbol string, signal_id string, ts timestamp, event string, price double",
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None",
    )


def message_stream(messages: DataFrame, ticks: DataFrame, stale_seconds: int = 10) -> DataFrame:
    """Messages with the ticks that come at most ``stale_seconds`` after them (both sides watermarked).

    Both sides meet by channel and time slot of that length: a message goes to its own slot and to the next one, a tick to its own.
    A key's state is thus what one slot holds, and no message is compared with all ticks of its channel. A pair lies in one slot only.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(stale_seconds * 1_000_000))
    m = messages.withWatermark("date", f"{stale_seconds} seconds")
    m = m.withColumn("_slot", F.explode(F.array(slot("date"), slot("date") + 1))).alias("m")
    t = ticks.withWatermark("ts", f"{stale_seconds} seconds")
    t = t.withColumn("_slot", slot("ts")).alias("t")
    near = F.expr(f"m.channel = t.symbol AND m._slot = t._slot AND t.ts >= m.date AND t.ts <= m.date + INTERVAL {stale_seconds} SECONDS")
    kept = [F.col(f"m.{c}") for c in messages.columns]
    ids = [F.col("t.event_id").alias("tick_id")] if "event_id" in ticks.columns else []
    return m.join(t, near).select(*kept, F.col("t.ts").alias("tick_time"), F.col("t.price"), *ids)


def append_closed_bars(bars: DataFrame, path: str, checkpoint: str):
    """Append-only file sink; the checkpoint remembers what was written."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def signal_sink(signals: DataFrame, path: str, checkpoint: str):
    """Idempotent write: one folder per batch, overwritten when a batch is replayed, ids unique inside it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["signal_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
