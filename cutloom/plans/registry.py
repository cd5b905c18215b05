"""Named queries and the SQL that must return the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\bat\b", '"at"', sql)  # a reserved word there
        return f

    return add


# What cutloom.sources.tables does, as common table expressions of the checking SQL.
_BASE = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ord FROM lineitem),
base AS (SELECT l_orderkey AS seq_id, CAST(ord AS BIGINT) AS ord, l_partkey AS source_id, CAST(l_suppkey % 10 AS BIGINT) AS src_in, CAST(l_suppkey % 10 + l_quantity AS BIGINT) AS src_out,
  CAST(CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN 2.0 ELSE 1.0 END AS DOUBLE) AS rate FROM lines),
sized AS (SELECT *, CAST(greatest(floor((src_out - src_in) / rate), 0) AS BIGINT) AS len FROM base),
gapless AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY seq_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start0 FROM sized)"""
_LAYOUT = {"gapless": ("1", "start0"), "gappy": ("1", "start0 + ord * 3"), "tracks": ("1 + ord % 3", "CAST(floor(start0 / 2) AS BIGINT)")}


def edl(layout: str = "gappy") -> str:
    lane, start = _LAYOUT[layout]
    return f"{_BASE},\nclips AS (SELECT seq_id, ord, source_id, src_in, src_out, rate, len, CAST({start} AS BIGINT) AS start, CAST({lane} AS BIGINT) AS track, CAST({start} AS BIGINT) + len AS stop FROM gapless)"


FRAMES = "ends AS (SELECT seq_id, max(stop) AS total FROM clips GROUP BY seq_id), frames AS (SELECT seq_id, unnest(range(total)) AS n FROM ends WHERE total > 0)"
SOURCE_FRAME = "CASE WHEN c.rate = 1.0 THEN c.src_in + (n - c.start) ELSE c.src_in + CAST(floor((n - c.start) * c.rate) AS BIGINT) END"
CURVES = """
ev AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 60000000 AS frame FROM events),
curves AS (SELECT user_id AS owner_id, frame, value, CASE WHEN event_type IN ('view', 'signup') THEN 'smooth' WHEN event_type = 'error' THEN 'hold' ELSE 'linear' END AS ease
  FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, frame ORDER BY event_id DESC) = 1)"""
PACKETS = "packets AS (SELECT user_id AS source_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS t, event_type = 'purchase' AS is_key FROM events)"
CAPTIONS = "captions AS (SELECT conv_id AS seq_id, turn AS ord, CAST(turn * 2.0 AS DOUBLE) AS start, CAST(turn * 2.0 + 2.5 AS DOUBLE) AS stop, text, role FROM conversations)"
