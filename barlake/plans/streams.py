"""Streaming queries: a replay of the events table, held against the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import bars as S
from .bars import _BAR, _END, T, _time_bar_sql
from .base import query, r6
from .indicators import _STEP, _ema_sql, _wilder_sql


def _ready(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    return S.read_ticks(spark, f"{sf_dir}/events.parquet")


# bars that the watermark, ten minutes behind the last tick, has passed
_FINAL = f"SELECT * FROM ({_time_bar_sql('4 hours', ', '.join([r6(c, c) for c in ('open', 'high', 'low', 'close')] + ['volume', 'num_ticks']))}) WHERE ts + INTERVAL '4 hours' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"
query("stream_timebars_K1", _FINAL)(
    lambda s, d: S.replay(S.stream_time_bars(_ready(s, d), "4 hours"), "stream_timebars").select("symbol", "ts", "open", "high", "low", "close", "volume", "num_ticks")
)
_CLOSED = f"SELECT * FROM ({_BAR}{', '.join([*[r6(c, c) for c in ('open', 'high', 'low', 'close')], 'volume', 'bar_amount', 'num_ticks'])}{_END}) WHERE bar_amount >= {T}"
query("stream_dollarbars_K2_K5", _CLOSED)(lambda s, d: S.replay(S.stream_activity_bars(_ready(s, d), T), "stream_dollarbars"))
query("stream_merged_K3", f"""WITH c AS ({_CLOSED}) SELECT symbol, CAST(bar_id // 10 AS BIGINT) AS bar_id, {r6('arg_min(open, bar_id)', 'open')}, {r6('max(high)', 'high')}, {r6('min(low)', 'low')}, {r6('arg_max(close, bar_id)', 'close')}, sum(volume) AS volume, CAST(sum(bar_amount) AS BIGINT) AS bar_amount, CAST(sum(num_ticks) AS BIGINT) AS num_ticks FROM c GROUP BY 1, 2 HAVING count(*) = 10""")(
    lambda s, d: S.replay(S.stream_merged_bars(S.stream_activity_bars(_ready(s, d), T), 10), "stream_merged")
)
_ONLINE = f"""WITH RECURSIVE k AS (SELECT symbol, bar_id, bar_id AS ts, bar_id + 1 AS rn, open, high, low, close FROM ({_CLOSED})), {_STEP}, {_ema_sql("e", "close", 14)}, {_wilder_sql("u", "g", 14, 2, "st")}, {_wilder_sql("d", "l", 14, 2, "st")}, {_wilder_sql("t", "tr", 14, 2, "st")}
  SELECT k.symbol, k.bar_id, {r6("e.v", "ema")}, {r6("CASE WHEN u.v + d.v = 0 THEN 0 ELSE 100 * u.v / (u.v + d.v) END", "rsi")}, {r6("t.v", "atr")} FROM k LEFT JOIN e USING (symbol, rn) LEFT JOIN u USING (symbol, rn) LEFT JOIN d USING (symbol, rn) LEFT JOIN t USING (symbol, rn)"""
query("stream_indicators_K4", _ONLINE)(lambda s, d: S.replay(S.stream_indicators(S.stream_activity_bars(_ready(s, d), T)), "stream_indicators"))
