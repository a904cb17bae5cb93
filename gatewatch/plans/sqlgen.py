"""SQL text for the DuckDB oracle, mirroring the Spark expressions.

The oracle is an independent restatement of each operator in plain SQL
over the same parquet tables; these helpers only generate the shared
pieces (the events adapter and the keyed-hash uniform draw).
"""

from __future__ import annotations

import math

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

LE = f"""le AS (
  SELECT event_id,
         CAST(user_id AS VARCHAR) AS user_id,
         '10.0.0.' || CAST({K} AS VARCHAR) AS ip,
         'd' || CAST({K} % 10 AS VARCHAR) AS device,
         event_type <> 'error' AS success,
         CASE WHEN event_type IN ('view', 'click') THEN 'Logon' ELSE 'Logoff' END AS activity,
         ts AS event_time,
         value AS rtt_ms,
         (user_id % 10 = 0 AND {K} < 60) AS is_attack
  FROM events)"""


def with_le(*ctes: str) -> str:
    """``WITH le AS (...), <ctes...>`` prefix."""
    return "WITH " + ",\n".join((LE,) + ctes) + "\n"


def uniform(key_sql: str, seed, stream: str | None = None) -> str:
    parts = [f"'{seed}'"] + ([f"'{stream}'"] if stream is not None else []) + [f"CAST({key_sql} AS VARCHAR)"]
    h = f"sha256(concat_ws('|', {', '.join(parts)}))"
    return f"((CAST(CAST(('0x' || substr({h}, 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


def laplace(key_sql: str, eps, seed, stream: str, sensitivity: float = 1.0) -> str:
    u = f"(0.5 - {uniform(key_sql, seed, stream)})"
    return f"(({float(sensitivity)} / {float(eps)}) * sign({u}) * ln(1.0 - 2.0 * abs({u})))"


def std_normal(key_sql: str, seed, stream: str) -> str:
    u1 = uniform(key_sql, seed, f"{stream}.1")
    u2 = uniform(key_sql, seed, f"{stream}.2")
    return f"(sqrt(-2.0 * ln({u1})) * cos({dbl(2.0 * math.pi)} * {u2}))"


def dbl(x: float) -> str:
    """A double literal parsed exactly (DuckDB reads plain decimals as DECIMAL)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def logistic(x_sql: str) -> str:
    """Bias -5 and weight 0.5 of the first feature (fixed values)."""
    return f"(1.0 / (1.0 + exp(-(-5.0 + 0.5 * ({x_sql})))))"


def stump(x_sql: str) -> str:
    """Majority of three stumps (fixed values)."""
    return (f"(CASE WHEN CAST(({x_sql}) > 9 AS INTEGER) + CAST(({x_sql}) > 25 AS INTEGER)"
            f" + CAST(({x_sql}) <= 11 AS INTEGER) >= 2 THEN 1 ELSE 0 END)")


FAILED = "c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE NOT success GROUP BY user_id)"
LOGONS = "c AS (SELECT user_id, COUNT(*) AS count FROM le WHERE activity = 'Logon' GROUP BY user_id)"


def state_cte(rel: str = "le", name: str = "st") -> str:
    """The state of the log: latest time, rows, sum of 52-bit row digests."""
    parts = ["CAST(event_id AS VARCHAR)", "user_id", "CAST(epoch_us(event_time) AS VARCHAR)", "CAST(success AS VARCHAR)", "activity"]
    h = "sha256(concat_ws('|', " + ", ".join(f"coalesce({p}, '-')" for p in parts) + "))"
    return f"""{name} AS (SELECT concat_ws('|', CAST(coalesce(MAX(epoch_us(event_time)), 0) AS VARCHAR), CAST(COUNT(*) AS VARCHAR),
          CAST(coalesce(SUM(CAST(('0x' || substr({h}, 1, 13)) AS BIGINT)), 0) AS VARCHAR)) AS gw_state FROM {rel})"""
