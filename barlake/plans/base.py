"""How queries are registered, and the tables that most of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, WindowSpec

from ..functions.core import rounded, series
from ..operators.bars import time_bars
from ..sources.ticks import ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; doubles of its result are rounded to six digits, as in its SQL."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


def hourly(spark: SparkSession, sf_dir: str, frequency: str = "1 hour") -> DataFrame:
    return time_bars(ticks(spark, sf_dir), frequency).select("symbol", "ts", "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks")


def W() -> WindowSpec:
    """Rows of a series in order; made when asked for, as it needs a session."""
    return series()


# --- SQL pieces

TICKS = """ticks AS (SELECT 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, event_id AS trade_id, ts AS "timestamp", value AS price, CAST(props->>'k' AS INTEGER) AS quantity,
  CAST(round(value * 100) AS BIGINT) * CAST(props->>'k' AS INTEGER) AS quote_cents, value * CAST(props->>'k' AS INTEGER) AS quote_quantity, event_type IN ('view', 'click') AS maker FROM events)"""


def bars_sql(interval: str = "1 hour", name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{interval}', "timestamp") AS ts, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, trade_id) AS close,
  CAST(sum(quantity) AS DOUBLE) AS volume, sum(quote_quantity) AS dollar_volume, count(*) AS num_ticks FROM ticks GROUP BY 1, 2)"""


HOURLY = f"WITH {TICKS}, {bars_sql()}"
#: The series in order, and its window of the last n rows.
BY = "OVER (PARTITION BY symbol ORDER BY ts)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    """An aggregate over n rows that all have a value."""
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


def r6(x: str, name: str) -> str:
    return f"ROUND({x}, 6) + 0.0 AS {name}"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {BY}"


def lr(x: str) -> str:
    return f"CASE WHEN {x} > 0 AND {lag(x)} > 0 THEN ln({x} / {lag(x)}) END"


def skew_pop(x: str, n: str, w: str = "") -> str:
    """Population skewness from DuckDB's corrected one."""
    return f"(skewness({x}) {w} * (({n}) - 2) / sqrt(CAST(({n}) AS DOUBLE) * (({n}) - 1)))"
