"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; without `sql` only its rows are checked (and a test compares values)."""
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return add


def r6(column: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison; more digits where short decimal inputs would tie at six."""
    out = F.round(F.col(column) if isinstance(column, str) else column, digits)
    return out.alias(name or (column if isinstance(column, str) else None))


def R(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The same in SQL; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0e0 AS {name or expression.split('.')[-1]}"


# --- SQL forms of the derived tables ---------------------------------------------------------

PINGS = """
a AS (SELECT vec_id // 2 % 5 AS mission_id, CASE WHEN vec_id % 2 = 0 THEN 'port' ELSE 'stbd' END AS side,
  vec_id // 2 AS ping_no, vec_id,
  list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1e0) * 32767.5e0) AS INTEGER)) AS pwr,
  (vec_id // 2 * 100 + (vec_id % 2) * 7 * ((vec_id // 2) % 10)) * 1000000 AS sparse_ns,
  (vec_id * 20 + (vec_id * vec_id) % 13) * 1000000 AS dense_ns FROM embeddings),
ad AS (SELECT *, list_transform(pwr, lambda s: -80e0 + s / 65535e0 * 80e0) AS db FROM a)"""

BOTTOM = PINGS + """,
ab0 AS (SELECT *, list_max(db[1:20]) - 3e0 AS target FROM ad),
ab1 AS (SELECT *, coalesce(list_min(list_filter(range(0, 18), lambda i: list_max(db[i+1:i+3]) < target)), 8) AS settle FROM ab0),
ab2 AS (SELECT *, list_sum(db[settle+1:settle+8]) / 8e0 + 2e0 AS thr FROM ab1),
ab3 AS (SELECT *, list_min(list_filter(range(settle + 8, 63), lambda i: list_min(db[i+1:i+2]) > thr)) AS hit FROM ab2),
ab AS (SELECT *, (hit / 63e0 * 30000e0) / 1000e0 AS slant_m FROM ab3)"""

GROUND = PINGS + """,
ag0 AS (SELECT mission_id, side, ping_no, i, i / 63e0 * 30e0 AS r, db[i + 1] AS v,
  CASE WHEN side = 'port' THEN 1e0 ELSE -1e0 END AS sgn,
  ping_no * 0.05e0 AS robot_x, (ping_no % 7) * 0.1e0 AS robot_y, ping_no * 0.01e0 AS yaw
  FROM ad, (SELECT unnest(range(0, 64)) AS i)),
ag AS (SELECT *, sgn * sqrt(r * r - 25e0) AS yl FROM ag0 WHERE r > 5e0)"""

#: merged pings: one row per sample, `pos` as in the merged array; `n` is the number of samples of a ping
MERGED = GROUND + """,
m AS (SELECT mission_id, ping_no AS seq, ping_no * 0.1e0 AS t, robot_x, robot_y, yaw,
  5e0 + (ping_no % 5) * 0.1e0 AS water_depth, yl AS y, v,
  row_number() OVER (PARTITION BY ping_no ORDER BY CASE WHEN side = 'port' THEN 0 ELSE 1 END, i) - 1 AS pos FROM ag),
mp AS (SELECT mission_id, seq, any_value(t) AS t, any_value(robot_x) AS robot_x, any_value(robot_y) AS robot_y,
  any_value(yaw) AS yaw, any_value(water_depth) AS water_depth, max(abs(y)) AS range_m FROM m GROUP BY mission_id, seq)"""

STATES = """
e AS (SELECT user_id % 10 AS mission_id, event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, user_id, event_type,
  value, value * 0.1e0 AS x, (user_id % 50) * 0.5e0 AS y, (event_id % 628) * 0.01e0 AS yaw,
  CAST((event_id * 7) % 360 AS DOUBLE) AS compass_deg, 43.69e0 + value * 1e-5 AS lat, 7.30e0 + user_id * 1e-5 AS lon,
  CASE WHEN event_type <> 'error' THEN event_id // 3 END AS time_boot_ms FROM events)"""

DETECTIONS = STATES + """,
d AS (SELECT mission_id, seq, us, t, user_id AS uid, x, y,
  list_extract(['tire', 'block', 'chain', 'pipe'], CAST(seq % 4 + 1 AS INTEGER)) AS class_name, least(1e0, value / 500) AS confidence
  FROM e WHERE event_type = 'purchase')"""

SAMPLES = """
l AS (SELECT l_orderkey % 3 AS mission_id, l_partkey * 0.05e0 AS x, l_suppkey * 0.3e0 AS y, -60e0 + l_extendedprice / 2500e0 AS v,
  CAST(l_quantity AS DOUBLE) AS rng, l_orderkey AS ping_seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS sample_idx FROM lineitem)"""

NEAREST_CELLS = SAMPLES + """,
n AS (SELECT *, CAST(floor((x + 30e0) / 0.25e0) AS BIGINT) AS cx, CAST(floor((y + 30e0) / 0.25e0) AS BIGINT) AS cy FROM l)"""

#: planes by full ordering, and the splat weights, as separate steps
CELLS = NEAREST_CELLS + """,
hits AS (SELECT mission_id, cx, cy, count(*) AS count,
  arg_max(v, row(-CAST(CAST(rng AS FLOAT) AS DOUBLE), ping_seq, sample_idx)) AS closest,
  arg_max(v, row(-ping_seq, sample_idx)) AS oldest, arg_max(v, row(ping_seq, sample_idx)) AS newest
  FROM n GROUP BY mission_id, cx, cy),
g AS (SELECT *, (x + 30e0) / 0.25e0 - 0.5e0 AS gx, (y + 30e0) / 0.25e0 - 0.5e0 AS gy FROM l),
gi AS (SELECT *, floor(gx) AS ix, floor(gy) AS iy, gx - floor(gx) AS fx, gy - floor(gy) AS fy FROM g),
sp AS (SELECT mission_id, CAST(ix + dx AS BIGINT) AS cx, CAST(iy + dy AS BIGINT) AS cy, v,
  (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) AS w
  FROM gi, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)),
means AS (SELECT mission_id, cx, cy, sum(v * w) AS sum, sum(w) AS wsum FROM sp WHERE w > 1e-4 GROUP BY mission_id, cx, cy),
cells AS (SELECT mission_id, cx, cy, sum, wsum, coalesce(count, 0) AS count, closest, oldest, newest,
  CASE WHEN wsum >= 0.25e0 THEN sum / wsum END AS value FROM means LEFT JOIN hits USING (mission_id, cx, cy))"""


def with_(tables: str, body: str) -> str:
    return f"WITH {tables.strip()}\n{body}"


def recursive(tables: str, body: str) -> str:
    return f"WITH RECURSIVE {tables.strip()}\n{body}"
