"""Trade-message and feature queries. The feed is derived from events and the bars of the same hour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barwave.operators import features as ft
from barwave.operators import pivots as pv
from barwave.operators import trade_text as tt
from barwave.plans.movements import BASE as LEG_SQL
from barwave.plans.movements import base as leg_base
from barwave.plans.movements import sql as leg_sql
from barwave.plans.oracle import with_bars
from barwave.plans.outcomes import outcomes_sql
from barwave.plans.registry import query
from barwave.session import cut
from barwave.sources.ticks import bar_table, event_ticks

_TEMPLATES = (
    ("'GOLD BUY NOW @ ' || {p} || chr(10) || 'SL ' || {a} || chr(10) || 'TP ' || {b} || chr(10) || 'TP2 ' || {c}"),
    ("'xauusd sell ' || {p} || ' sl: ' || {b} || ' take profit ' || {a}"),
    ("'Please move SL to entry'"),
    ("'TP1 hit, well done'"),
    ("'close now'"),
    ("'buy limit gold @ ' || {p} || ' stop loss ' || {a} || ' tp ' || {b}"),
    ("'Sell EURUSD 1.2345 sl 1.2400'"),
    ("'just hold, +35 pips running, do not close '"),
    ("'SL was hit'"),
    ("'gold buy around ' || {p} || ' stoploss ' || {a}"),
)


def _case(fmt) -> str:
    f = lambda off: fmt.format(off)
    return "CASE event_id % 10 " + " ".join(
        f"WHEN {i} THEN " + t.format(p=f("close"), a=f("close - 150"), b=f("close + 150"), c=f("close + 300")) for i, t in enumerate(_TEMPLATES)
    ) + " END"


FEED_SQL = f""", feed AS MATERIALIZED (SELECT e.event_type AS channel, event_id AS id, date_trunc('second', ts) AS date, CASE WHEN event_id % 3 = 0 THEN event_id - event_id % 10 END AS reply_id,
      {_case("printf('%.2f', {0})")} AS text, close AS market FROM events e JOIN bars b ON b.symbol = e.event_type AND b.open_time = date_trunc('hour', e.ts)),
    ct AS (SELECT *, lower(text) AS t FROM feed),
    ps AS MATERIALIZED (SELECT *, regexp_matches(t, '{tt.SIGNAL}') AS has_signal, regexp_matches(t, '{tt.GOLD}') AS has_symbol, regexp_extract(t, '{tt.SIGNAL}', 1) = 'buy' AS is_long,
      TRY_CAST(nullif(replace(regexp_extract(t, '{tt.SIGNAL}', 3), ',', ''), '') AS DOUBLE) AS p0, TRY_CAST(nullif(replace(regexp_extract(t, '{tt.STOP}', 2), ',', ''), '') AS DOUBLE) AS s0,
      list_transform(regexp_extract_all(t, '{tt.TAKE}', 3), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS t0 FROM ct),
    pq AS MATERIALIZED (SELECT *, has_signal AND has_symbol AS enter, has_signal AND NOT has_symbol AS other, CASE WHEN has_signal AND has_symbol THEN coalesce(p0, market) END AS price,
      coalesce(CASE WHEN has_signal AND has_symbol THEN coalesce(p0, market) END, market) - CASE WHEN is_long THEN 10.0 ELSE -10.0 END AS dsl FROM ps),
    pr AS MATERIALIZED (SELECT *, s0 IS NOT NULL AND dsl > 0 AND abs(s0 - dsl) / dsl < 0.2 AND NOT other AS has_explicit_sl,
      CASE WHEN other THEN NULL WHEN s0 IS NOT NULL AND dsl > 0 AND abs(s0 - dsl) / dsl < 0.2 THEN s0 ELSE dsl END AS sl,
      CASE WHEN other THEN 0 ELSE (CASE WHEN enter AND is_long THEN 1 ELSE 0 END) + (CASE WHEN enter AND NOT is_long THEN 2 ELSE 0 END)
        + (CASE WHEN enter AND p0 IS NOT NULL AND regexp_matches(t, '{tt.LIMIT}') THEN 256 ELSE 0 END)
        + (CASE WHEN s0 IS NOT NULL OR (s0 IS NULL AND has_signal AND abs(market - dsl) / market < 0.2) THEN 8 ELSE 0 END) + (CASE WHEN len(t0) > 0 THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '{tt.CLOSE}') AND NOT regexp_matches(t, '{tt.HOLD}') THEN 16 ELSE 0 END)
        {' '.join(f"+ (CASE WHEN regexp_matches(t, '{p}') THEN {f} ELSE 0 END)" for f, p in tt.ACTIONS)} END AS flags FROM pq),
    op AS MATERIALIZED (SELECT *, price AS entry, coalesce(list_transform(list_sort(list_transform(t0, lambda x: [abs(x - price), x])), lambda e: e[2])[1], price + CASE WHEN is_long THEN 10 ELSE -10 END) AS tp
      FROM pr WHERE flags & 3 <> 0 AND has_explicit_sl AND flags & 256 = 0)"""


def sql(body):
    return with_bars(FEED_SQL + body)


def feed(spark, sf):
    bars = bar_table(spark, sf)
    ev = spark.read.parquet(f"{sf}/events.parquet")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    j = ev.select(F.col("event_type").alias("symbol"), "event_id", "ts", hour.alias("open_time")).join(bars.select("symbol", "open_time", "close"), ["symbol", "open_time"])
    m = j.select(
        F.col("symbol").alias("channel"), F.col("event_id").alias("id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("date"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") - F.col("event_id") % 10).alias("reply_id"),
        F.expr(_case("format_string('%.2f', {0})")).alias("text"), F.col("close").alias("market"),
    )
    return bars, m


def parsed(spark, sf):
    bars, m = feed(spark, sf)
    return bars, cut(tt.parse_messages(m))


@query("t01_clean_text", sql(" SELECT id, t AS cleaned FROM ct"))
def q_clean(spark, sf):
    return feed(spark, sf)[1].select("id", tt.clean_text(F.col("text")).alias("cleaned"))


@query("t02_entry_side_price", sql(" SELECT id, has_signal, has_symbol, is_long, price FROM pr"))
def q_side(spark, sf):
    return parsed(spark, sf)[1].select("id", "has_signal", "has_symbol", "is_long", "price")


@query("t03_stop_price", sql(" SELECT id, round(sl, 4) AS sl, has_explicit_sl FROM pr"))
def q_stop(spark, sf):
    return parsed(spark, sf)[1].select("id", F.round("sl", 4).alias("sl"), "has_explicit_sl")


@query("t04_take_profits", sql(" SELECT id, unnest(t0) AS tp FROM pr WHERE NOT other"))
def q_tps(spark, sf):
    return parsed(spark, sf)[1].select("id", F.explode("tps").alias("tp"))


@query("t05_action_flags", sql(" SELECT id, CAST(flags AS INTEGER) AS flags FROM pr"))
def q_flags(spark, sf):
    return parsed(spark, sf)[1].select("id", "flags")


@query("t06_select_tp", sql(" SELECT id, round(tp, 4) AS tp FROM op"))
def q_select(spark, sf):
    return tt.opened_signals(parsed(spark, sf)[1]).select("id", F.round("tp", 4).alias("tp"))


REPLY_SQL = """, lo AS (SELECT r.*, (SELECT arg_max(o.id, (o.date, o.id)) FROM op o WHERE o.channel = r.channel AND o.date < r.date) AS last_opened FROM pr r),
    rs AS MATERIALIZED (SELECT *, coalesce(reply_id, last_opened) AS ref_id FROM lo)"""


@query("t07_resolve_reply", sql(REPLY_SQL + " SELECT id, coalesce(ref_id, -1) AS ref_id FROM rs"))
def q_reply(spark, sf):
    _, p = parsed(spark, sf)
    return tt.resolve_reply(p, tt.opened_signals(p)).select("id", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"))


@query(
    "t08_message_order_type",
    sql(
        """, q AS (SELECT o.id, is_long, entry, b.close AS quote FROM op o ASOF LEFT JOIN bars b ON b.symbol = o.channel AND o.date >= b.open_time)
        SELECT id, coalesce(CASE WHEN is_long THEN quote > entry ELSE quote < entry END, false) AS is_limit FROM q"""
    ),
)
def q_type(spark, sf):
    bars, p = parsed(spark, sf)
    return tt.message_order_type(tt.opened_signals(p), bars).select("id", "is_limit")


@query("t09_apply_actions")
def q_actions(spark, sf):
    _, p = parsed(spark, sf)
    o = tt.opened_signals(p)
    return tt.apply_actions(tt.resolve_reply(p, o), o)


BAR_SQL = ", mb AS (SELECT o.*, b.tf, b.bar_index FROM {src} o ASOF LEFT JOIN bars b ON b.symbol = o.channel AND o.date <= b.open_time)"


@query(
    "t10_message_outcomes",
    sql(
        BAR_SQL.format(src="op")
        + """, sig AS (SELECT CAST(id AS VARCHAR) AS signal_id, channel AS symbol, tf, is_long, bar_index AS entry_bar, entry, tp, sl FROM mb WHERE bar_index IS NOT NULL)"""
        + outcomes_sql(policy="tp_first", strict=True, start="entry_bar")
        + " SELECT signal_id, outcome, coalesce(exit_bar, -1) AS exit_bar FROM oc"
    ),
)
def q_outcomes(spark, sf):
    bars, p = parsed(spark, sf)
    o = tt.message_outcomes(tt.opened_signals(p), bars)
    return o.select("signal_id", "outcome", F.coalesce("exit_bar", F.lit(-1)).cast("long").alias("exit_bar"))


@query("t11_messages_to_bars", sql(BAR_SQL.format(src="pr") + " SELECT id, coalesce(bar_index, -1) AS bar_index FROM mb"))
def q_bars(spark, sf):
    bars, p = parsed(spark, sf)
    return tt.messages_to_bars(p, bars).select("id", F.coalesce("bar_index", F.lit(-1)).cast("long").alias("bar_index"))


@query(
    "t11_due_messages",
    sql(
        """, md AS (SELECT channel, id, date FROM pr), nx AS (SELECT m.id, date, e.ts AS tick_time FROM md m ASOF JOIN events e ON e.event_type = m.channel AND m.date <= e.ts)
        SELECT id, tick_time FROM nx WHERE epoch_us(tick_time) - epoch_us(date) <= 10000000"""
    ),
)
def q_due(spark, sf):
    _, p = parsed(spark, sf)
    return tt.due_messages(p.select("channel", "id", "date"), event_ticks(spark, sf)).select("id", "tick_time")


@query(
    "t12_classify_messages",
    sql(
        " SELECT id, CASE WHEN reply_id IS NOT NULL THEN 'reply_' ELSE '' END || CASE "
        + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in tt.CLASSES)
        + " ELSE 'other' END AS category FROM feed"
    ),
)
def q_classify(spark, sf):
    return tt.classify_messages(feed(spark, sf)[1]).select("id", "category")


@query(
    "t12_conversation_flags",
    f"SELECT conv_id, turn, regexp_matches(lower(text), '{tt.CLOSE}') AS closes, regexp_matches(lower(text), '{tt.SIGNAL}') AS signals FROM conversations",
)
def q_conv(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    t = tt.clean_text(F.col("text"))
    return c.select("conv_id", "turn", t.rlike(tt.CLOSE).alias("closes"), t.rlike(tt.SIGNAL).alias("signals"))


# ---- features ----

N = 10
FEATURE_SQL = LEG_SQL + f""", fb AS (SELECT *, n + 1 AS cnt, (n + 1) // {N} AS base, (n + 1) % {N} AS extra FROM lb WHERE n + 1 >= {N} AND length > 0),
    fs AS (SELECT *, {N // 2} - extra // 2 AS first FROM fb),
    fg AS (SELECT *, CASE WHEN pos < first * base THEN pos // base WHEN pos < first * base + extra * (base + 1) THEN first + (pos - first * base) // (base + 1)
      ELSE first + extra + (pos - first * base - extra * (base + 1)) // base END AS g, least(start_value, end_value) AS lo FROM fs),
    ff AS MATERIALIZED (SELECT symbol, tf, seq, CAST(g AS INTEGER) AS g, arg_min((open - lo) / length, bar_index) AS o, arg_max((close - lo) / length, bar_index) AS c,
      max((high - lo) / length) AS h, min((low - lo) / length) AS l FROM fg GROUP BY 1, 2, 3, 4)"""


@query("r18_segment_features", with_bars(FEATURE_SQL + " SELECT symbol, tf, seq, g, round(o, 7) AS o, round(c, 7) AS c, round(h, 7) AS h, round(l, 7) AS l FROM ff", recursive=True))
def q_features(spark, sf):
    bars, legs = leg_base(spark, sf)
    f = ft.segment_features(legs, bars, N)
    return f.select(*ft.LEG, "g", *[F.round(c, 7).alias(c) for c in "ochl"])


def _labels(legs):
    return legs.select(*ft.LEG, F.col("is_up").cast("int").alias("label"), F.when(F.col("is_up"), "UP").otherwise("DOWN").alias("class"))


@query(
    "r19_feature_dataset",
    with_bars(
        FEATURE_SQL
        + " SELECT CAST(l.is_up AS INTEGER) AS label, CASE WHEN l.is_up THEN 'UP' ELSE 'DOWN' END AS class, round(max(o) FILTER (g = 0), 7) AS o1, round(max(c) FILTER (g = 0), 7) AS c1,"
        + f" round(max(h) FILTER (g = {N - 1}), 7) AS h{N}, round(max(ff.l) FILTER (g = {N - 1}), 7) AS l{N} FROM ff JOIN legs l USING (symbol, seq) GROUP BY symbol, seq, l.is_up",
        recursive=True,
    ),
)
def q_dataset(spark, sf):
    bars, legs = leg_base(spark, sf)
    d = ft.feature_dataset(_labels(legs), ft.feature_vectors(ft.segment_features(legs, bars, N)))
    return ft.wide(d, N).select("label", "class", *[F.round(c, 7).alias(c) for c in ("o1", "c1", f"h{N}", f"l{N}")])


def slope_scorer(x: np.ndarray) -> np.ndarray:
    """A plain stand-in for a model: rising or falling by the last close against the first open."""
    rise = x[:, -3] - x[:, 0]
    return np.stack([rise, -rise], axis=1)


@query("r20_score_segments")
def q_scores(spark, sf):
    bars, legs = leg_base(spark, sf)
    return ft.score_segments(ft.feature_vectors(ft.segment_features(legs, bars, N)), slope_scorer, ["UP", "DOWN"])
