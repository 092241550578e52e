"""DuckDB text shared by the oracle queries."""

from __future__ import annotations

import textwrap

from barwave.sources.timeframes import SPAN


def bars_cte(tf: str = "h1", name: str = "bars") -> str:
    """CTE list (without WITH) that builds the bar table named ``name`` from events."""
    trunc = f"to_timestamp(floor(epoch(m)/{SPAN[tf]})*{SPAN[tf]}) AT TIME ZONE 'UTC'"
    if tf in ("h1", "m1", "d1"):
        trunc = f"date_trunc('{dict(h1='hour', m1='minute', d1='day')[tf]}', m)"
    p = name
    return textwrap.dedent(f"""
    {p}_t AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS m, ts, event_id,
      CASE WHEN event_id % 2 = 0 THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END AS v FROM events),
    {p}_m AS (SELECT symbol, m, arg_min(v, (ts, event_id)) AS o, max(v) AS h, min(v) AS l, arg_max(v, (ts, event_id)) AS c,
      sum(v) AS s, count(*) AS n FROM {p}_t GROUP BY symbol, m),
    {p}_v AS (SELECT *, 50000 + coalesce(sum(s) OVER (PARTITION BY symbol ORDER BY m
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lvl FROM {p}_m),
    {p}_b AS (SELECT symbol, {trunc} AS open_time,
      arg_min(CAST(lvl + o AS DOUBLE), m) AS open, max(CAST(lvl + h AS DOUBLE)) AS high,
      min(CAST(lvl + l AS DOUBLE)) AS low, arg_max(CAST(lvl + c AS DOUBLE), m) AS close, CAST(sum(n) AS DOUBLE) AS volume
      FROM {p}_v GROUP BY 1, 2),
    {name} AS MATERIALIZED (SELECT symbol, '{tf}' AS tf,
      row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS bar_index,
      open_time, open, high, low, close, volume FROM {p}_b)""").strip()


def with_bars(body: str, tf: str = "h1", recursive: bool = False) -> str:
    """``body`` may continue the CTE list (start it with a comma) or be a plain SELECT."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + bars_cte(tf) + "\n" + textwrap.dedent(body).strip()
