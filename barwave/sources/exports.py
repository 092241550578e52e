"""Reports, JSON exports and labelled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwave.operators.series import KEY

LABEL_KEY = ["ticker", "timeframe", "start_time", "end_time", "model"]


def trim_number(c: Column, digits: int) -> Column:
    """Rounded, without trailing zeros (0.25 not 0.250)."""
    text = F.format_string(f"%.{digits}f", F.round(c, digits))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def gartley_report_lines(items: DataFrame) -> DataFrame:
    """``time;model;XB;AC;BD;XD;+/-;accuracy;symbol;tf`` with decimal points."""
    n = lambda c: trim_number(F.col(c), 3)
    return items.select(
        F.concat_ws(
            ";", F.date_format("d_time", "yyyy-MM-dd'T'HH:mm:ss"), "model", n("xb"), n("ac"), n("bd"), n("xd"),
            F.when(F.col("won"), "+").otherwise("-"), F.col("accuracy").cast("int").cast("string"), *KEY,
        ).alias("value")
    )


def harmonic_report_lines(items: DataFrame) -> DataFrame:
    """``time;model;side;AB/XA;BC/AB;CD/BC;final;score;R:R;+/-;symbol;tf``."""
    n = lambda c, d=3: F.coalesce(trim_number(F.col(c), d), F.lit(""))
    return items.select(
        F.concat_ws(
            ";", F.date_format("d_time", "yyyy-MM-dd'T'HH:mm:ss"), "model", F.when(F.col("is_bull"), "bull").otherwise("bear"),
            n("ab_ratio"), n("bc_ratio"), n("cd_ratio"), n("final_ratio"), n("score", 4), n("risk_reward"),
            F.when(F.col("won"), "+").otherwise("-"), *KEY,
        ).alias("value")
    )


def write_report(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def candles_json(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """JSON candle list per window (window_id, symbol, tf, from_time, to_time); the close is the close.

    A window is one chart, so its list is bounded by what the caller asks to draw.
    """
    w = windows.select("window_id", *KEY, "from_time", "to_time")
    j = bars.join(w, list(KEY)).where(F.col("open_time").between(F.col("from_time"), F.col("to_time")))
    row = F.struct(
        F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss").alias("d"), F.col("open").alias("o"), F.col("close").alias("c"),
        F.col("high").alias("h"), F.col("low").alias("l"),
    )
    return j.groupBy("window_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("candles"))


def ingest_labels(raw: DataFrame) -> DataFrame:
    """Insert-or-ignore: the earliest received row per key; rows whose prices do not parse are skipped.

    Copies combine before the shuffle (an aggregate, not a window over the copies).
    """
    typed = raw.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("start_price", "end_price")})
    typed = typed.where(F.col("start_price").isNotNull() & F.col("end_price").isNotNull())
    rest = [c for c in raw.columns if c not in LABEL_KEY]
    order = F.struct("received_at", *[F.col(c) for c in rest if c != "received_at"])
    first = typed.groupBy(*LABEL_KEY).agg(F.min(order).alias("_r"))
    return first.select(*LABEL_KEY, *[F.col(f"_r.{c}") for c in rest])


def list_labels(labels: DataFrame, ticker: str | None = None, tf: str | None = None, model: str | None = None) -> DataFrame:
    """Optional equality filters, newest received first."""
    for column, wanted in (("ticker", ticker), ("timeframe", tf), ("model", model)):
        if wanted:
            labels = labels.where(F.col(column) == wanted)
    return labels.orderBy(F.col("received_at").desc())


def export_labels(labels: DataFrame, path: str) -> None:
    labels.orderBy("ticker", "timeframe", "start_time").write.mode("overwrite").csv(path, header=True)


def markup_json(nodes: DataFrame, levels: int = 10) -> DataFrame:
    """Nested JSON of each root from flat nodes, bottom-up: level k's children are folded into k+1's rows.

    ``nodes``: symbol, tf, node_id, parent_id, level, wave_pos, wave_name, model, score, is_up, start_time,
    start_value, start_bar, end_time, end_value, end_bar.  A node has at most five children, so no
    group grows with the data.
    """
    point = lambda p: F.struct(
        F.date_format(f"{p}_time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col(f"{p}_value").alias("value"), F.col(f"{p}_bar").alias("barIndex")
    )
    # children travel as JSON text, so every level has one row type
    body = lambda kids: F.concat(
        F.regexp_replace(
            F.to_json(
                F.struct(
                    "model", F.round("score", 6).alias("score"), F.col("is_up").alias("isUp"), F.col("wave_name").alias("waveName"),
                    point("start").alias("start"), point("end").alias("end"),
                )
            ),
            r"\}$", "",
        ),
        F.when(kids.isNotNull(), F.concat(F.lit(',"subWaves":['), kids, F.lit("]"))).otherwise(""),
        F.lit("}"),
    )
    done = None
    for level in range(0, levels + 1):
        here = nodes.where(F.col("level") == level)
        if done is not None:
            packed = done.where(F.col("parent_id").isNotNull()).groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(
                F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("wave_pos", "json"))), lambda e: e["json"])).alias("_kids")
            )
            here = here.join(packed, [*KEY, "node_id"], "left")
        else:
            here = here.withColumn("_kids", F.lit(None).cast("string"))
        ready = here.select(*KEY, "node_id", "parent_id", "wave_pos", body(F.col("_kids")).alias("json"))
        done = ready if done is None else done.unionByName(ready)
        if level == levels:
            break
    return done.where(F.col("parent_id").isNull()).select(*KEY, "node_id", "json")


MARKUP_SCHEMA = (
    "model STRING, score DOUBLE, isUp BOOLEAN, waveName STRING, start STRUCT<time: STRING, value: DOUBLE, barIndex: BIGINT>, "
    "end STRUCT<time: STRING, value: DOUBLE, barIndex: BIGINT>, subWaves ARRAY<STRING>"
)


def parse_markup_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Top level of a markup tree; sub-waves stay JSON and can be parsed with the same schema."""
    return df.withColumn("node", F.from_json(column, MARKUP_SCHEMA))
