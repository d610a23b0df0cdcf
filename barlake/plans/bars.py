"""Queries over ticks and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators.profile import quality_report
from ..sources import files
from ..sources.ticks import clean, daily_ticks, ticks
from .base import QUERIES, SQL, TICKS, bars_sql, div, query, r6, skew_pop


def _raw(spark, sf_dir):
    """Raw text ticks with bad numbers and odd booleans, as files have them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id") % 50
    maker = F.when(i == 1, "TRUE").when(i == 2, "0").when(i == 3, "x").when(i == 4, None).when(F.col("event_type").isin("view", "click"), "true").otherwise("False")
    return e.select(
        F.col("event_id").alias("trade_id"), F.when(i == 5, "bad").when(i == 6, "NaN").when(i == 7, "").otherwise(F.col("value").cast("string")).alias("price"),
        F.get_json_object("props", "$.k").alias("quantity"), F.when(i == 8, "Infinity").otherwise((F.col("value") * 2).cast("string")).alias("quote_quantity"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), maker.alias("is_buyer_maker"), F.lit("true").alias("is_best_match"),
    )


query("clean_ticks_P1_P10", f"""SELECT make_timestamp_ms(epoch_us(ts) // 1000) AS "timestamp", {r6('value', 'price')}, CAST(props->>'k' AS DOUBLE) AS quantity, {r6('value * 2', 'quote_quantity')},
  CASE event_id % 50 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE event_type IN ('view', 'click') END AS "isBuyerMaker", event_id AS trade_id
  FROM events WHERE event_id % 50 NOT IN (5, 6, 7, 8)""")(lambda s, d: clean(_raw(s, d)))

query("dq_checks_V3_V7", """SELECT event_id % 7 AS part, count(*) AS rows, CAST(0 AS BIGINT) AS missing_price, count(*) FILTER (WHERE event_id % 11 = 0) AS missing_quantity, CAST(0 AS BIGINT) AS missing_quote_quantity,
  count(*) FILTER (WHERE year(ts) <> 2024 OR month(ts) <> 1 + CAST(event_id % 7 = 3 AS INTEGER)) AS out_of_month, count(*) FILTER (WHERE event_id % 7 = 2 AND event_id % 13 = 0) AS missing_maker,
  count(*) FILTER (WHERE event_id % 11 = 0) + count(*) FILTER (WHERE year(ts) <> 2024 OR month(ts) <> 1 + CAST(event_id % 7 = 3 AS INTEGER)) + count(*) FILTER (WHERE event_id % 7 = 2 AND event_id % 13 = 0) = 0 AS passed
  FROM events GROUP BY 1""")(
    lambda s, d: quality_report(
        ticks(s, d).withColumns({"part": F.col("trade_id") % 7, "y": F.lit(2024), "m": F.lit(1) + (F.col("trade_id") % 7 == 3).cast("int")})
        .withColumns({"quantity": F.when(F.col("trade_id") % 11 != 0, F.col("quantity")), "isBuyerMaker": F.when(~((F.col("trade_id") % 7 == 2) & (F.col("trade_id") % 13 == 0)), F.col("isBuyerMaker"))}),
        ["part"], "y", "m",
    )
)

query("head_tail_A12", f"WITH {TICKS} (SELECT trade_id, {r6('price', 'price')} FROM ticks ORDER BY \"timestamp\", trade_id LIMIT 5) UNION (SELECT trade_id, {r6('price', 'price')} FROM ticks ORDER BY \"timestamp\" DESC, trade_id DESC LIMIT 5)")(
    lambda s, d: files.first_and_last(ticks(s, d).select("timestamp", "trade_id", "price"), ["timestamp", "trade_id"], 5).select("trade_id", "price")
)
query("resume_filter_A18", "SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1996-05-01' GROUP BY 1, 2")(
    lambda s, d: files.resume_from(daily_ticks(s, d), 1996, 5).groupBy("year", "month").agg(F.count("*").alias("n")).select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "n")
)

_REAL = "FILTER (WHERE quantity > 0)"


def _time_bar_sql(interval: str, columns: str) -> str:
    n = f"count(*) {_REAL}"
    ps, qs = skew_pop("price", "n", ""), skew_pop("quantity", "n", "")
    return f"""WITH {TICKS}, t AS (SELECT symbol, time_bucket(INTERVAL '{interval}', "timestamp") AS ts, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, trade_id) AS close,
  CAST(sum(quantity) AS DOUBLE) AS volume, sum(quote_quantity) AS dollar_volume, count(*) AS num_ticks, {n} AS n, sum(price * quantity) {_REAL} AS pq, sum(quantity) {_REAL} AS q,
  sum(quantity * CASE WHEN maker THEN -1 ELSE 1 END) {_REAL} AS qs, skewness(price) {_REAL} AS ps, kurtosis_pop(price) {_REAL} AS pk, skewness(quantity) {_REAL} AS vs, kurtosis_pop(quantity) {_REAL} AS vk,
  min(price) {_REAL} < max(price) {_REAL} AS pv, min(quantity) {_REAL} < max(quantity) {_REAL} AS qv, avg(quantity) {_REAL} AS avg_trade_size FROM ticks GROUP BY 1, 2)
  SELECT symbol, ts, {columns} FROM t"""


_OHLC = f"ts + INTERVAL '{{i}}' - INTERVAL '1 microsecond' AS close_ts, {r6('open', 'open')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('close', 'close')}, volume, {r6('dollar_volume', 'dollar_volume')}, num_ticks"
_FLOW = f"{r6(div('pq', 'q'), 'vwap')}, {r6(div('qs', 'q'), 'ofi')}, {r6('avg_trade_size', 'avg_trade_size')}"
_CORR = "(n - 2) / sqrt(CAST(n AS DOUBLE) * (n - 1))"
_MOMENTS = ", ".join([
    r6(f"CASE WHEN n > 2 AND pv THEN ps * {_CORR} END", "price_skew"), r6("CASE WHEN n > 3 AND pv THEN pk END", "price_kurtosis"),
    r6(f"CASE WHEN n > 2 AND qv THEN vs * {_CORR} END", "volume_skew"), r6("CASE WHEN n > 3 AND qv THEN vk END", "volume_kurtosis"),
])
_O = ["symbol", "ts", "close_ts", "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks"]
for _name, _freq in (("1m", "1 minute"), ("15m", "15 minutes"), ("4h", "4 hours")):
    query(f"timebar_{_name}_B11_B12", _time_bar_sql(_freq, _OHLC.replace("{i}", _freq)))(lambda s, d, f=_freq: B.time_bars(ticks(s, d), f).select(*_O))
query("timebar_vwap_ofi_B13_B17", _time_bar_sql("1 hour", _FLOW))(lambda s, d: B.time_bars(ticks(s, d), "1 hour").select("symbol", "ts", "vwap", "ofi", "avg_trade_size"))
query("timebar_moments_B15_B16", _time_bar_sql("4 hours", _MOMENTS))(lambda s, d: B.time_bars(ticks(s, d), "4 hours").select("symbol", "ts", "price_skew", "price_kurtosis", "volume_skew", "volume_kurtosis"))

_DAY = ("timestamp", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
query("timebar_drop_month_tail_Q1", f"""WITH b AS (SELECT CAST(time_bucket(INTERVAL '1 day', CAST(l_shipdate AS TIMESTAMP)) AS TIMESTAMP) AS ts, count(*) AS num_ticks, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1)
  SELECT ts, num_ticks, {r6('volume', 'volume')} FROM b QUALIFY ts < max(ts) OVER (PARTITION BY year(ts), month(ts))""")(
    lambda s, d: B.drop_month_tail(B.time_bars(daily_ticks(s, d), "1 day", _DAY)).select("ts", "num_ticks", "volume")
)

_MICRO = f"""WITH {TICKS}, s AS (SELECT *, time_bucket(INTERVAL '1 hour', "timestamp") AS b FROM ticks),
  q AS (SELECT symbol, b, quantile_cont(quote_quantity, 0.8) AS q80, quantile_cont(quote_quantity, 0.2) AS q20 FROM s GROUP BY 1, 2),
  w AS (SELECT s.*, q80, q20, abs(price - lag(price) OVER o) AS step, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER o)) / 1000.0 AS wait FROM s JOIN q USING (symbol, b) WINDOW o AS (PARTITION BY symbol, b ORDER BY "timestamp", trade_id)),
  m AS (SELECT symbol, b AS ts, count(*) AS n, avg(CASE WHEN maker THEN 0.0 ELSE 1.0 END) AS buyer, avg(quantity) AS ab, avg(quote_quantity) AS aq, avg(CASE WHEN quote_quantity > q80 THEN 1.0 ELSE 0.0 END) AS lg, avg(CASE WHEN quote_quantity < q20 THEN 1.0 ELSE 0.0 END) AS sm,
    max(price) AS high, min(price) AS low, avg(price) AS mp, sum(quote_quantity) AS vq, sum(quantity) AS vb, avg(step) AS ms, avg(wait) AS mw, sum(CASE WHEN maker THEN -quote_quantity ELSE quote_quantity END) AS net, sum(quote_quantity) AS gross FROM w GROUP BY 1, 2)
  SELECT symbol, ts, """


def _micro(columns, sql):
    return lambda name: query(name, _MICRO + sql + " FROM m")(lambda s, d: B.micro_bars(ticks(s, d), "1 hour").select("symbol", "ts", *columns))


_micro(["buyer_initiated_ratio", "avg_trade_size_base", "avg_trade_size_quote", "trades_per_minute", "volume_imbalance", "vwap"], ", ".join([r6("buyer", "buyer_initiated_ratio"), r6("ab", "avg_trade_size_base"), r6("aq", "avg_trade_size_quote"), "n AS trades_per_minute", r6(div("net", "gross"), "volume_imbalance"), r6(div("vq", "vb"), "vwap")]))("microbar_flow_B20_B24_B27")
_micro(["large_trade_ratio", "small_trade_ratio"], r6("lg", "large_trade_ratio") + ", " + r6("sm", "small_trade_ratio"))("microbar_trade_size_ratio_B22")
_micro(["price_range_norm", "avg_price_step", "avg_trade_interval_ms"], ", ".join([r6(f"CASE WHEN n > 1 THEN {div('high - low', 'mp')} ELSE 0 END", "price_range_norm"), r6("CASE WHEN n > 1 THEN ms ELSE 0 END", "avg_price_step"), r6("mw", "avg_trade_interval_ms")]))("microbar_range_step_interval_B23_B26")

query("microbar_gapfill_B28", f"""WITH {TICKS}, {bars_sql('15 minutes')}, e AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL '15 minutes')) AS ts FROM e),
  j AS (SELECT g.symbol, g.ts, open, high, low, close, volume, dollar_volume, num_ticks FROM g LEFT JOIN bars USING (symbol, ts))
  SELECT symbol, ts, {', '.join(r6(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)", c) for c in ('open', 'high', 'low', 'close'))}, coalesce(volume, 0) AS volume, {r6('coalesce(dollar_volume, 0)', 'dollar_volume')}, coalesce(num_ticks, 0) AS num_ticks FROM j""")(
    lambda s, d: B.fill_gaps(B.time_bars(ticks(s, d), "15 minutes").select("symbol", "ts", "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks"), "15 MINUTES")
)
query("microbar_merge_partials_B29", f"""WITH {TICKS}, p AS (SELECT symbol, time_bucket(INTERVAL '1 hour', "timestamp") AS ts, trade_id // 700 AS part, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, trade_id) AS close, CAST(sum(quantity) AS DOUBLE) AS volume, count(*) AS num_ticks,
  avg(CASE WHEN maker THEN 0.0 ELSE 1.0 END) AS buyer_ratio FROM ticks GROUP BY 1, 2, 3)
  SELECT symbol, ts, {r6('arg_min(open, part)', 'open')}, {r6('max(high)', 'high')}, {r6('min(low)', 'low')}, {r6('arg_max(close, part)', 'close')}, sum(volume) AS volume, CAST(sum(num_ticks) AS BIGINT) AS num_ticks, {r6('avg(buyer_ratio)', 'buyer_ratio')} FROM p GROUP BY 1, 2""")(
    lambda s, d: B.merge_partial_bars(
        ticks(s, d).groupBy("symbol", F.window("timestamp", "1 hour")["start"].cast("timestamp_ntz").alias("ts"), F.floor(F.col("trade_id") / 700).alias("part"))
        .agg(*[c for c in B.ohlcv()], F.avg((~F.col("isBuyerMaker")).cast("double")).alias("buyer_ratio")).drop("dollar_volume")
    )
)

# --- activity bars: hop from bar to bar over the running sum

T = 2_000_000
ASSIGNED = f"""RECURSIVE {TICKS},
  c AS (SELECT *, row_number() OVER o AS rn, CAST(sum(quote_cents) OVER o AS BIGINT) AS cum FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY "timestamp", trade_id)),
  ends AS (SELECT a.symbol, a.rn, min(b.rn) AS e FROM (SELECT symbol, rn, cum - quote_cents AS base FROM c) a ASOF JOIN (SELECT symbol, rn, cum FROM c) b ON a.symbol = b.symbol AND a.base + {{t}} <= b.cum GROUP BY 1, 2),
  hops AS (SELECT symbol, 1 AS s, (SELECT min(x.e) FROM ends x WHERE x.symbol = y.symbol AND x.rn = 1) AS e, CAST(0 AS BIGINT) AS bar_id FROM (SELECT DISTINCT symbol FROM c) y
    UNION ALL SELECT h.symbol, h.e + 1, x.e, h.bar_id + 1 FROM hops h JOIN c ON c.symbol = h.symbol AND c.rn = h.e + 1 LEFT JOIN ends x ON x.symbol = h.symbol AND x.rn = h.e + 1 WHERE h.e IS NOT NULL),
  a AS (SELECT c.*, h.bar_id FROM c JOIN hops h ON c.symbol = h.symbol AND c.rn >= h.s AND (h.e IS NULL OR c.rn <= h.e))"""
_BAR = f"""WITH {ASSIGNED.replace('{t}', str(T))},
  w AS (SELECT *, price - lag(price) OVER o AS step, CASE WHEN lag(price) OVER o > 0 THEN ln(price / lag(price) OVER o) END AS back FROM a WINDOW o AS (PARTITION BY symbol, bar_id ORDER BY rn)),
  z AS (SELECT symbol, bar_id, rn, CASE WHEN sign(step) <> lag(sign(step)) OVER (PARTITION BY symbol, bar_id ORDER BY rn) THEN 1 ELSE 0 END AS turn FROM w WHERE step <> 0),
  zz AS (SELECT symbol, bar_id, sum(turn) AS turns FROM z GROUP BY 1, 2),
  b AS (SELECT symbol, bar_id, min("timestamp") AS open_timestamp, max("timestamp") AS close_timestamp, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, CAST(sum(quantity) AS DOUBLE) AS volume,
    sum(quote_quantity) AS dollar_volume, count(*) AS num_ticks, CAST(sum(quote_cents) AS BIGINT) AS bar_amount, coalesce(sum(quantity) FILTER (WHERE NOT maker), 0) AS buys, coalesce(sum(quantity) FILTER (WHERE maker), 0) AS sells,
    stddev_pop(back) AS path, stddev_pop(price) AS sd, skewness(price) AS sk, kurtosis_pop(price) AS ku, coalesce(sum(CAST(step <> 0 AS INTEGER)), 0) AS changes FROM w GROUP BY 1, 2)
  SELECT b.symbol, b.bar_id, """
_END = " FROM b LEFT JOIN zz USING (symbol, bar_id)"


def _dollar(name, columns, sql):
    query(name, _BAR + sql + _END)(lambda s, d: B.activity_bars(ticks(s, d), T).select("symbol", "bar_id", *columns))


_dollar("dollarbar_ohlcv_B1_B4", ["open_timestamp", "close_timestamp", "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks", "bar_amount"], ", ".join(["open_timestamp", "close_timestamp", *[r6(c, c) for c in ("open", "high", "low", "close")], "volume", r6("dollar_volume", "dollar_volume"), "num_ticks", "bar_amount"]))
_dollar("dollarbar_imbalance_B5_B6", ["trade_imbalance", "taker_buy_sell_ratio"], r6(f"coalesce({div('buys - sells', 'buys + sells')}, 0)", "trade_imbalance") + ", " + r6("CASE WHEN sells > 0 THEN CAST(buys AS DOUBLE) / sells WHEN buys > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END", "taker_buy_sell_ratio"))
_dollar("dollarbar_path_B7_B8", ["intra_bar_tick_price_volatility", "tick_price_skewness", "tick_price_kurtosis"], ", ".join([
    r6("coalesce(path, 0)", "intra_bar_tick_price_volatility"),
    r6("CASE WHEN num_ticks > 2 AND sd >= 1e-9 THEN sk * (num_ticks - 2) / sqrt(CAST(num_ticks AS DOUBLE) * (num_ticks - 1)) ELSE 0 END", "tick_price_skewness"), r6("CASE WHEN num_ticks > 1 AND sd >= 1e-9 THEN ku ELSE 0 END", "tick_price_kurtosis"),
]))
_dollar("dollarbar_changes_B9_B10", ["num_price_changes", "num_directional_changes"], "CAST(changes AS BIGINT) AS num_price_changes, CAST(coalesce(turns, 0) AS BIGINT) AS num_directional_changes")

# --- bars of bars, over hourly bars

_SHORT = f"WITH {TICKS}, {bars_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM bars)"


def _short(spark, sf_dir):
    """Hourly bars in the form of activity bars."""
    from .base import W, hourly

    h = hourly(spark, sf_dir)
    half = (F.col("close") - F.col("open")) / (F.col("close") + F.col("open"))
    return h.select(
        "symbol", (F.row_number().over(W()) - 1).cast("long").alias("bar_id"), F.col("ts").alias("open_timestamp"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("close_timestamp"), "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks",
        half.alias("trade_imbalance"), F.when(F.col("num_ticks") % 5 != 0, F.col("num_ticks") / 3.0).alias("taker_buy_sell_ratio"), (F.abs(half) + 0.1).alias("intra_bar_tick_price_volatility"), half.alias("tick_price_skewness"), (-half).alias("tick_price_kurtosis"),
        F.col("num_ticks").alias("num_directional_changes"), F.round(F.col("dollar_volume") * 100).cast("long").alias("bar_amount"),
    )


def _count_sql(n: int, columns: str) -> str:
    return f"""{_SHORT}, g AS (SELECT *, CAST(n // {n} AS BIGINT) AS bar_id, (close - open) / (close + open) AS h, CASE WHEN num_ticks % 5 <> 0 THEN num_ticks / 3.0 END AS r, sign(close - open) AS sg FROM k),
  f AS (SELECT *, CASE WHEN sg <> 0 AND lag(sg) OVER o <> 0 AND sg <> lag(sg) OVER o THEN 1 ELSE 0 END AS flip FROM g WINDOW o AS (PARTITION BY symbol, bar_id ORDER BY ts)),
  m AS (SELECT symbol, bar_id, min(ts) AS open_timestamp, max(ts) + INTERVAL '1 hour' AS close_timestamp, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, sum(dollar_volume) AS dollar_volume, CAST(sum(num_ticks) AS BIGINT) AS num_ticks, count(*) AS constituent_bar_count,
    sum(h) AS ti, sum(h * volume) AS tiv, sqrt(sum((abs(h) + 0.1) ** 2 * dollar_volume) / nullif(sum(dollar_volume), 0)) AS pv, coalesce(sum(r * dollar_volume / (1 + r)), 0) AS b, coalesce(sum(dollar_volume / (1 + r)), 0) AS s, sum(h * dollar_volume) / nullif(sum(dollar_volume), 0) AS sk,
    CAST(sum(num_ticks) + sum(flip) AS BIGINT) AS dc FROM f GROUP BY 1, 2 HAVING count(*) = {n})
  SELECT symbol, bar_id, {columns} FROM m"""


_BASIC = ", ".join(["open_timestamp", "close_timestamp", *[r6(c, c) for c in ("open", "high", "low", "close", "volume", "dollar_volume")], "num_ticks", "constituent_bar_count", r6("epoch(close_timestamp) - epoch(open_timestamp)", "bar_duration_seconds")])
_BASIC_COLUMNS = ["open_timestamp", "close_timestamp", "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks", "constituent_bar_count", "bar_duration_seconds"]
query("bars_medium_count_B30_B31", _count_sql(10, _BASIC))(lambda s, d: B.merge_by_count(_short(s, d), 10).select("symbol", "bar_id", *_BASIC_COLUMNS))
query("bars_long_count_B30", _count_sql(160, _BASIC))(lambda s, d: B.merge_by_count(B.merge_by_count(_short(s, d), 10), 16).withColumn("constituent_bar_count", F.col("constituent_bar_count") * 10).select("symbol", "bar_id", *_BASIC_COLUMNS))
query("bars_pooled_B32_B36", _count_sql(10, ", ".join([r6("ti", "trade_imbalance"), r6(div("tiv", "volume"), "trade_imbalance_norm"), r6("pv", "intra_bar_tick_price_volatility"), r6("CASE WHEN s > 1e-9 THEN b / s WHEN b > 1e-9 THEN 1.7976931348623157e308 ELSE 1 END", "taker_buy_sell_ratio"), r6("sk", "tick_price_skewness"), "dc AS num_directional_changes"])))(
    lambda s, d: B.merge_by_count(_short(s, d), 10).select("symbol", "bar_id", "trade_imbalance", "trade_imbalance_norm", "intra_bar_tick_price_volatility", "taker_buy_sell_ratio", "tick_price_skewness", "num_directional_changes")
)
_AMOUNT = 10_000_000
query("bars_dollar_value_B30", f"""WITH RECURSIVE {_SHORT[5:]}, c AS (SELECT *, CAST(round(dollar_volume * 100) AS BIGINT) AS q FROM k),
  w AS (SELECT symbol, n, q AS total, CAST(0 AS BIGINT) AS bar_id, q >= {_AMOUNT} AS closes FROM c WHERE n = 0
    UNION ALL SELECT c.symbol, c.n, CASE WHEN w.closes THEN c.q ELSE w.total + c.q END, w.bar_id + CAST(w.closes AS INTEGER), CASE WHEN w.closes THEN c.q ELSE w.total + c.q END >= {_AMOUNT} FROM w JOIN c ON c.symbol = w.symbol AND c.n = w.n + 1)
  SELECT symbol, bar_id, {r6('sum(volume)', 'volume')}, count(*) AS constituent_bar_count, {r6('max(high)', 'high')} FROM w JOIN c USING (symbol, n) GROUP BY 1, 2 HAVING sum(q) >= {_AMOUNT}""")(
    lambda s, d: B.merge_by_amount(_short(s, d), _AMOUNT).select("symbol", "bar_id", "volume", "constituent_bar_count", "high")
)
query("tick_bars", f"WITH {TICKS}, k AS (SELECT *, CAST((row_number() OVER (PARTITION BY symbol ORDER BY \"timestamp\", trade_id) - 1) // 50 AS BIGINT) AS bar_id FROM ticks) SELECT symbol, bar_id, {r6('arg_min(price, trade_id)', 'open')}, {r6('max(price)', 'high')}, {r6('min(price)', 'low')}, {r6('arg_max(price, trade_id)', 'close')}, CAST(sum(quantity) AS DOUBLE) AS volume, {r6('sum(quote_quantity)', 'dollar_volume')}, count(*) AS num_ticks FROM k GROUP BY 1, 2")(
    lambda s, d: B.tick_bars(ticks(s, d), 50)
)
_VOL = ASSIGNED.replace("{t}", "5000").replace("sum(quote_cents)", "sum(quantity)").replace("cum - quote_cents", "cum - quantity")
query("volume_bars", f"WITH {_VOL} SELECT symbol, bar_id, CAST(sum(quantity) AS BIGINT) AS bar_amount, count(*) AS num_ticks FROM a GROUP BY 1, 2")(
    lambda s, d: B.activity_bars(ticks(s, d).withColumn("quantity", F.col("quantity").cast("long")), 5000, "quantity").select("symbol", "bar_id", "bar_amount", "num_ticks")
)
