"""Queries over joins, labels, profiles and model data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import log_return
from ..operators import finite, joins, labels, mlprep, profile
from ..sources import files
from ..sources.ticks import daily_ticks, ticks
from .base import BY, HOURLY, TICKS, W, bars_sql, div, full, hourly, lag, query, r6

KEY = ("symbol", "ts")

# --- joins


def _coarse(spark, sf_dir):
    """Four-hour bars, known from their end on; some with missing values."""
    c = hourly(spark, sf_dir, "4 hours")
    return c.select("symbol", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("known"), F.when(F.hour("ts") != 8, F.col("close")).alias("l_close"), F.col("num_ticks").alias("l_ticks"))


query("asof_multires_J1", f"""WITH {TICKS}, {bars_sql()}, {bars_sql('4 hours', 'c4')}, r AS (SELECT symbol, ts + INTERVAL '4 hours' AS known, CASE WHEN hour(ts) <> 8 THEN close END AS l_close, num_ticks AS l_ticks FROM c4)
  SELECT bars.symbol, ts, {r6('close', 'close')}, known, {r6('l_close', 'l_close')}, l_ticks FROM bars ASOF LEFT JOIN r ON bars.symbol = r.symbol AND bars.ts >= r.known""")(
    lambda s, d: joins.asof_join(hourly(s, d).select(*KEY, "close"), _coarse(s, d), "ts", right_on="known")
)
query("outer_consolidate_J2", f"""WITH {TICKS}, {bars_sql('15 minutes', 'a')}, {bars_sql('1 hour', 'b')}, {bars_sql('4 hours', 'c')}
  SELECT coalesce(a.symbol, b.symbol, c.symbol) AS symbol, coalesce(a.ts, b.ts, c.ts) AS ts, {r6('a.close', 'close_tb_15min')}, a.num_ticks AS num_ticks_tb_15min, {r6('b.close', 'close_tb_1h')}, b.num_ticks AS num_ticks_tb_1h, {r6('c.close', 'close_tb_4h')}, c.num_ticks AS num_ticks_tb_4h
  FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts FULL JOIN c ON coalesce(a.symbol, b.symbol) = c.symbol AND coalesce(a.ts, b.ts) = c.ts""")(
    lambda s, d: joins.consolidate({n: hourly(s, d, f).select(*KEY, "close", "num_ticks") for n, f in (("tb_15min", "15 minutes"), ("tb_1h", "1 hour"), ("tb_4h", "4 hours"))}, KEY)
)
query("left_label_J3", f"""WITH {TICKS}, {bars_sql()}, {bars_sql('4 hours', 'c4')}, l AS (SELECT symbol, ts, CAST(close > open AS INTEGER) AS target FROM c4) SELECT symbol, ts, {r6('close', 'close')}, target FROM bars LEFT JOIN l USING (symbol, ts)""")(
    lambda s, d: hourly(s, d).select(*KEY, "close").join(hourly(s, d, "4 hours").select(*KEY, (F.col("close") > F.col("open")).cast("int").alias("target")), list(KEY), "left")
)
query("anti_done_J8", "SELECT DISTINCT year(l_shipdate) AS year, month(l_shipdate) AS month FROM lineitem WHERE year(l_shipdate) % 2 = 1")(
    lambda s, d: files.not_done(daily_ticks(s, d).select("year", "month").distinct(), daily_ticks(s, d).where("year % 2 = 0"), ["year", "month"]).select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))
)
query("map_join_J7", "SELECT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '_db_s' WHEN '2' THEN '_db_m' WHEN '3' THEN '_db_l' END AS suffix, count(*) AS n FROM orders GROUP BY 1, 2")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority", F.try_element_at(F.create_map(*[F.lit(x) for x in ("1", "_db_s", "2", "_db_m", "3", "_db_l")]), F.substring("o_orderpriority", 1, 1)).alias("suffix")).agg(F.count("*").alias("n"))
)
query("prune_suffix_P11_P13", f"""{HOURLY} SELECT symbol, ts, {r6('open', 'open_db_s')}, {r6('close', 'close_db_m')} FROM bars""")(
    lambda s, d: joins.prefix_to_suffix(
        joins.select_matching(joins.prune(hourly(s, d).select(*KEY, F.col("open").alias("s_open"), F.col("close").alias("m_close"), F.col("high").alias("s_sma_10"), F.col("volume").alias("volume_lag_2"), "num_ticks")), prefix=("s_", "m_", "symbol"), suffix=("ts",)).drop("num_ticks"),
        {"s_": "_db_s", "m_": "_db_m"},
    )
)

# --- labels


def _label_sql(levels: str, tie: int, name: str = "label", source: str = HOURLY) -> str:
    """First bar after the row that touches a level, by a correlated search."""
    return f"""{source}, k AS (SELECT *, row_number() {BY} AS rn, {levels}),
  f AS (SELECT a.symbol, a.rn, min(b.rn) AS hit FROM k a JOIN k b ON a.symbol = b.symbol AND b.rn > a.rn AND (b.high >= a.tp OR b.low <= a.sl) GROUP BY 1, 2)
  SELECT k.symbol, k.ts, CASE WHEN h.high >= k.tp AND h.low <= k.sl THEN {tie} WHEN h.high >= k.tp THEN 1 WHEN h.low <= k.sl THEN 0 END AS {name} FROM k LEFT JOIN f USING (symbol, rn) LEFT JOIN k h ON h.symbol = f.symbol AND h.rn = f.hit"""


def _ranged(spark, sf_dir):
    bars = finite.with_returns(hourly(spark, sf_dir), W())
    return bars.withColumn("atr", finite.simple_atr(W(), 5))


_RANGED = f"{HOURLY}, t AS (SELECT *, CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr FROM bars), u AS (SELECT *, {full('avg', 'tr', 5)} AS atr FROM t)"
query("label_fixed_pct_L1", _label_sql("open * 1.5 AS tp, open * 0.75 AS sl FROM bars", 0))(lambda s, d: labels.fixed_percent(hourly(s, d), 0.5, 0.25).select(*KEY, "label"))
query("label_atr_L2_L3", _label_sql(f"lead(open) {BY} + atr * 1.5 * 2.0 AS tp, lead(open) {BY} - atr * 1.5 AS sl FROM u", 1, source=_RANGED).replace("AS tp", "* CASE WHEN atr > 0 THEN 1 END AS tp", 1).replace("AS sl", "* CASE WHEN atr > 0 THEN 1 END AS sl", 1).replace(f"lead(open) {BY} + atr * 1.5 * 2.0 *", f"(lead(open) {BY} + atr * 1.5 * 2.0) *").replace(f"lead(open) {BY} - atr * 1.5 *", f"(lead(open) {BY} - atr * 1.5) *"))(
    lambda s, d: labels.by_range(_ranged(s, d), "atr").select(*KEY, "label")
)
_DIST = "greatest(close * 0.01, atr * 1.5)"
query("label_adaptive_L4", _label_sql(f"CASE WHEN {_DIST} < close AND atr IS NOT NULL THEN close + {_DIST} * 2.0 END AS tp, CASE WHEN {_DIST} < close AND atr IS NOT NULL THEN close - {_DIST} END AS sl FROM u", 0, source=_RANGED))(
    lambda s, d: labels.adaptive(_ranged(s, d), "atr").select(*KEY, "label")
)
query("label_fixed_close_L5", _label_sql("close * 1.005 AS tp, close * 0.9975 AS sl FROM bars", 0))(lambda s, d: labels.fixed_percent(hourly(s, d), 0.005, 0.0025, column="close").select(*KEY, "label"))
query("label_horizon_L6", f"{HOURLY} SELECT symbol, ts, CAST(lead(close, 12) {BY} > close AS INTEGER) AS label FROM bars")(lambda s, d: labels.direction(hourly(s, d), 12).select(*KEY, "label"))
query("dedupe_first_L7", "SELECT CAST(l_shipdate AS TIMESTAMP) AS ts, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1")(
    lambda s, d: labels.keep_first(daily_ticks(s, d), ["timestamp"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select(F.col("timestamp").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey")
)
query("label_dist_L8", f"WITH x AS ({_label_sql('open * 1.5 AS tp, open * 0.75 AS sl FROM bars', 0)}) SELECT label, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()', 'share')} FROM x GROUP BY 1")(
    lambda s, d: profile.value_counts(labels.fixed_percent(hourly(s, d), 0.5, 0.25), "label")
)

# --- profiles

query("daily_hourly_volume_G1_G2", f"""WITH {TICKS}, dd AS (SELECT symbol, CAST("timestamp" AS DATE) AS x, sum(quote_quantity) AS v FROM ticks GROUP BY 1, 2), hh AS (SELECT symbol, date_trunc('hour', "timestamp") AS x, sum(quote_quantity) AS v FROM ticks GROUP BY 1, 2),
  a AS (SELECT symbol, avg(v) AS m, count(*) AS days FROM dd GROUP BY 1), b AS (SELECT symbol, avg(v) AS h FROM hh GROUP BY 1) SELECT symbol, {r6('m', 'mean_daily')}, days, {r6('h', 'mean_hourly')} FROM a JOIN b USING (symbol)""")(lambda s, d: profile.volume_by_day(ticks(s, d)))
query("bar_size_suggest_G3_G4", f"""WITH {TICKS}, dd AS (SELECT symbol, CAST("timestamp" AS DATE) AS x, sum(quote_quantity) AS v FROM ticks GROUP BY 1, 2), hh AS (SELECT symbol, date_trunc('hour', "timestamp") AS x, sum(quote_quantity) AS v FROM ticks GROUP BY 1, 2),
  a AS (SELECT symbol, avg(v) AS m, count(*) AS n FROM dd GROUP BY 1), b AS (SELECT symbol, avg(v) AS h FROM hh GROUP BY 1), t AS (SELECT sum(m * n) / sum(n) AS daily, avg(h) AS hourly FROM a JOIN b USING (symbol))
  SELECT CAST(k AS INTEGER) AS target_bars, {r6('daily / k', 'bar_size')}, {r6('hourly / (daily / k)', 'bars_per_hour')}, {r6('hourly * 2 / (daily / k)', 'bars_per_active_hour')} FROM t, (SELECT unnest([150, 200, 300, 400, 500, 600]) AS k)""")(
    lambda s, d: profile.suggested_sizes(profile.volume_by_day(ticks(s, d)))
)
_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
_COLS = ["o_custkey", "o_totalprice"]


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")


def _each(sql: str) -> str:
    """A SELECT over (column, value) of two columns of orders."""
    return f"WITH v AS (SELECT 'o_custkey' AS \"column\", CAST(o_custkey AS DOUBLE) AS value FROM orders UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS DOUBLE) FROM orders) {sql}"


query("describe_G5", _each(f"SELECT \"column\", count(value) AS count, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')}, {r6('max(value)', 'max')}, " + ", ".join(r6(f"quantile_cont(value, {p})", f"p{int(p * 100):02d}") for p in profile.PERCENTILES) + " FROM v GROUP BY 1"))(lambda s, d: profile.describe(_orders(s, d), _COLS))
query("value_counts_G6", f"SELECT event_type, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()', 'share')} FROM events GROUP BY 1")(lambda s, d: profile.value_counts(s.read.parquet(f"{d}/events.parquet"), "event_type"))
query("missing_G7", f"""{HOURLY}, x AS (SELECT {full('avg', 'close', 20)} AS sma_20, {lag('close')} AS close_lag_1, close FROM bars), c AS (SELECT 'sma_20' AS "column", count(*) - count(sma_20) AS missing, count(*) AS n FROM x UNION ALL SELECT 'close_lag_1', count(*) - count(close_lag_1), count(*) FROM x UNION ALL SELECT 'close', count(*) - count(close), count(*) FROM x)
  SELECT "column", missing, {r6('missing * 100.0 / n', 'percent')} FROM c WHERE missing > 0""")(
    lambda s, d: profile.missing(hourly(s, d).withColumns({"sma_20": F.when(F.count("close").over(W().rowsBetween(-19, 0)) == 20, F.avg("close").over(W().rowsBetween(-19, 0))), "close_lag_1": F.lag("close").over(W())}).select("sma_20", "close_lag_1", "close"))
)
query("univariate_G8", _each(f"SELECT \"column\", {r6('avg(value)', 'mean')}, {r6('median(value)', 'median')}, {r6('stddev_samp(value)', 'std')}, {r6('skewness(value)', 'skew')}, {r6('kurtosis(value)', 'kurtosis')}, {r6('min(value)', 'min')}, {r6('max(value)', 'max')} FROM v GROUP BY 1"))(lambda s, d: profile.univariate(_orders(s, d), _COLS))
query("histogram_G9", f"WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) AS v FROM orders), e AS (SELECT min(v) AS a, max(v) AS b FROM x) SELECT CAST(least(floor((v - a) / (b - a) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM x, e GROUP BY 1")(lambda s, d: profile.histogram(_orders(s, d), "o_totalprice", 50))
query("by_label_G10", f"SELECT quality, {r6('avg(n_chars)', 'mean')}, {r6('median(n_chars)', 'median')}, {r6('stddev_samp(n_chars)', 'std')} FROM labels JOIN documents USING (doc_id) GROUP BY 1")(
    lambda s, d: profile.by_label(s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars")
)
_FEAT = ["open", "high", "low", "close", "volume", "close_lag_1"]


def _feat(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("close_lag_1", F.lag("close").over(W())).select(*_FEAT)


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM x" for i, a in enumerate(_FEAT) for b in _FEAT[i + 1 :])
_X = f"{HOURLY}, x AS (SELECT open, high, low, close, volume, {lag('close')} AS close_lag_1 FROM bars)"
query("corr_long_G11", f"{_X}, p AS ({_PAIRS}) SELECT a, b, {r6('rho', 'rho')} FROM p")(lambda s, d: profile.correlations(_feat(s, d), _FEAT))
query("corr_target_G12", f"{_X}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"column\", corr({a}, close) AS rho FROM x" for a in _FEAT if a != "close") + f") SELECT \"column\", {r6('rho', 'rho')} FROM p")(lambda s, d: profile.target_correlations(_feat(s, d), "close", _FEAT))
query("corr_pairs_G13", f"{_X}, p AS ({_PAIRS}) SELECT a, b, {r6('rho', 'rho')} FROM p WHERE abs(rho) > 0.3")(lambda s, d: profile.strong_pairs(_feat(s, d), _FEAT, 0.3))
_OUT = f"SELECT v.\"column\", {r6('min(lower)', 'lower')}, {r6('min(upper)', 'upper')}, count(*) FILTER (WHERE value < lower) AS below, count(*) FILTER (WHERE value > upper) AS above, {r6('count(*) FILTER (WHERE value < lower OR value > upper) * 100.0 / count(value)', 'percent')} FROM v JOIN q ON v.\"column\" = q.\"column\" GROUP BY 1"


def _out(bounds: str) -> str:
    return _each("").rstrip() + f", q AS (SELECT \"column\", {bounds} FROM v GROUP BY 1) {_OUT}"


_Q1, _Q3 = "quantile_cont(value, 0.25)", "quantile_cont(value, 0.75)"
query("outliers_iqr_G14", _out(f"{_Q1} - 0.5 * ({_Q3} - {_Q1}) AS lower, {_Q3} + 0.5 * ({_Q3} - {_Q1}) AS upper"))(lambda s, d: profile.outliers_iqr(_orders(s, d), _COLS, 0.5))
query("outliers_pct_G15", _out("quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper"))(lambda s, d: profile.outliers_percentile(_orders(s, d), _COLS))
query("outliers_z_G16", _out("avg(value) - 1.5 * stddev_samp(value) AS lower, avg(value) + 1.5 * stddev_samp(value) AS upper"))(lambda s, d: profile.outliers_z(_orders(s, d), _COLS, 1.5))
query("distinct_G17", "SELECT count(DISTINCT o_orderstatus) AS n_status, count(DISTINCT o_orderpriority) AS n_priority FROM orders")(lambda s, d: _orders(s, d).agg(F.countDistinct("o_orderstatus").alias("n_status"), F.countDistinct("o_orderpriority").alias("n_priority")))
query("sample_stats_G18", f"WITH {TICKS} SELECT symbol, min(\"timestamp\") AS first_ts, max(\"timestamp\") AS last_ts, {r6('min(price)', 'low')}, {r6('max(price)', 'high')}, {r6('avg(price)', 'mean_price')}, {r6('avg(quantity)', 'mean_quantity')}, {r6('avg(CAST(maker AS INTEGER))', 'maker_ratio')}, count(*) - count(price) AS missing_prices FROM ticks GROUP BY 1")(
    lambda s, d: profile.sample_stats(ticks(s, d))
)
query("month_gaps_G19", "WITH m AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem WHERE month(l_shipdate) NOT IN (3, 7)), s AS (SELECT unnest(generate_series(CAST(min(m) AS TIMESTAMP), CAST(max(m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS x FROM m) SELECT CAST(year(x) AS INTEGER) AS year, CAST(month(x) AS INTEGER) AS month FROM s WHERE x NOT IN (SELECT CAST(m AS TIMESTAMP) FROM m)")(
    lambda s, d: profile.month_gaps(daily_ticks(s, d).where("month NOT IN (3, 7)").select("year", "month"))
)
query("union_all_G21", f"WITH {TICKS}, {bars_sql()}, {bars_sql('4 hours', 'c')} SELECT symbol, ts, {r6('close', 'close')}, num_ticks FROM bars UNION ALL SELECT symbol, ts, {r6('close', 'close')}, NULL FROM c")(
    lambda s, d: hourly(s, d).select(*KEY, "close", "num_ticks").unionByName(hourly(s, d, "4 hours").select(*KEY, "close"), allowMissingColumns=True)
)
query("intersect_G22", f"WITH {TICKS}, {bars_sql()}, {bars_sql('4 hours', 'c')} SELECT symbol, ts FROM bars INTERSECT SELECT symbol, ts FROM c")(lambda s, d: hourly(s, d).select(*KEY).intersect(hourly(s, d, "4 hours").select(*KEY)))
query("top_k_G23_G24", f"{HOURLY} SELECT symbol, ts, {r6('volume', 'volume')} FROM bars ORDER BY volume DESC, symbol, ts LIMIT 10")(lambda s, d: hourly(s, d).orderBy(F.desc("volume"), *KEY).limit(10).select(*KEY, "volume"))
query("class_weights_G25", f"SELECT toxic, count(*) AS n, {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} FROM labels WHERE toxic IS NOT NULL GROUP BY 1")(lambda s, d: profile.class_weights(s.read.parquet(f"{d}/labels.parquet"), "toxic"))

# --- model data


def _model(spark, sf_dir):
    """Hourly bars with some missing volumes, split in time over all series."""
    h = hourly(spark, sf_dir).withColumn("volume", F.when(F.col("num_ticks") % 4 != 0, F.col("volume")))
    return mlprep.chronological_split(h, order=("ts", "symbol"))


_SPLIT = f"""{HOURLY}, n AS (SELECT symbol, ts, open, high, low, close, CASE WHEN num_ticks % 4 <> 0 THEN volume END AS volume, num_ticks, row_number() OVER (ORDER BY ts, symbol) - 1 AS i, count(*) OVER () AS n FROM bars),
  c AS (SELECT *, CAST(floor(n * (1 - 0.2) + 1e-9) AS BIGINT) AS t FROM n), m AS (SELECT *, CASE WHEN i < CAST(floor(t * (1 - 0.15) + 1e-9) AS BIGINT) THEN 'train' WHEN i < t THEN 'validation' ELSE 'test' END AS split FROM c)"""
query("ffill_M3", f"{_SPLIT} SELECT symbol, ts, {r6(f'last_value(volume IGNORE NULLS) {BY}', 'volume')} FROM m")(lambda s, d: mlprep.forward_fill(_model(s, d), ["volume"]).select(*KEY, "volume"))
query("impute_median_M4", f"{_SPLIT}, f AS (SELECT median(volume) AS v FROM m WHERE split = 'train') SELECT symbol, ts, {r6('coalesce(volume, v, 0)', 'volume')} FROM m, f")(lambda s, d: mlprep.impute_median(_model(s, d), ["volume"]).select(*KEY, "volume"))
query("impute_median_all_M4", f"{_SPLIT}, f AS (SELECT median(volume) AS v FROM m) SELECT symbol, ts, {r6('coalesce(volume, v, 0)', 'volume')} FROM m, f")(lambda s, d: mlprep.impute_median(_model(s, d), ["volume"], leaky=True).select(*KEY, "volume"))
query("chrono_split_M5", f"{_SPLIT} SELECT symbol, ts, split FROM m")(lambda s, d: _model(s, d).select(*KEY, "split"))
query("clip_M6", f"{_SPLIT}, f AS (SELECT quantile_cont(close, 0.01) AS a, quantile_cont(close, 0.99) AS b FROM m WHERE split = 'train') SELECT symbol, ts, {r6('least(greatest(close, a), b)', 'close')} FROM m, f")(lambda s, d: mlprep.clip(_model(s, d), ["close"]).select(*KEY, "close"))
for _kind, _c, _w in (("standard", "avg(close)", "stddev_pop(close)"), ("minmax", "min(close)", "max(close) - min(close)"), ("robust", "median(close)", "quantile_cont(close, 0.75) - quantile_cont(close, 0.25)")):
    query(f"scale_{_kind}_M7", f"{_SPLIT}, f AS (SELECT {_c} AS c, {_w} AS w FROM m WHERE split = 'train') SELECT symbol, ts, {r6('(close - c) / CASE WHEN w > 0 THEN w ELSE 1 END', 'close')} FROM m, f")(lambda s, d, k=_kind: mlprep.scale(_model(s, d), ["close"], k).select(*KEY, "close"))
query("scale_quantile_M7")(lambda s, d: mlprep.scale_quantile(_model(s, d), "close").select(*KEY, "close"))
query("scale_quantile_normal_M7")(lambda s, d: mlprep.scale_quantile(_model(s, d), "close", normal=True).select(*KEY, "close"))
query("scale_power_M7")(lambda s, d: mlprep.scale_power(_model(s, d), "close").select(*KEY, "close"))
query("sequences_M8", f"{HOURLY}, x AS (SELECT symbol, ts, list([CAST(close AS FLOAT), CAST(volume AS FLOAT)]) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s FROM bars) SELECT symbol, ts, CAST(len(s) AS INTEGER) AS n, CAST(s[1][1] AS FLOAT) AS first_close, CAST(s[60][2] AS FLOAT) AS last_volume FROM x WHERE len(s) = 60")(
    lambda s, d: mlprep.sequences(hourly(s, d), ["close", "volume"], 60).select(*KEY, F.size("sequence").alias("n"), F.col("sequence")[0][0].alias("first_close"), F.col("sequence")[59][1].alias("last_volume"))
)
query("batches_M9", f"{HOURLY} SELECT symbol, ts, CAST((row_number() {BY} - 1) // 64 AS BIGINT) AS batch FROM bars")(lambda s, d: mlprep.batches(hourly(s, d), 64, order=("ts",)).select(*KEY, "batch"))
query("last_rows_M10", f"{HOURLY} SELECT symbol, ts FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30")(lambda s, d: mlprep.last_rows(hourly(s, d), 30).select(*KEY))
query("instance_norm_M11", f"{HOURLY} SELECT symbol, ts, {r6(f'(close - ({full('avg', 'close', 60)})) / sqrt(({full('var_pop', 'close', 60)}) + 1e-6)', 'close_normed')} FROM bars")(lambda s, d: mlprep.instance_norm(hourly(s, d), "close", 60).select(*KEY, "close_normed"))


def _scored(spark, sf_dir):
    """Scores in hundredths, so that many tie, with labels that follow them loosely."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 101 / 100.0).alias("p"), ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 101 + F.col("o_custkey") % 60 > 75).cast("int").alias("y"))


_SCORED = "WITH s AS (SELECT o_orderkey, (o_orderkey * 37 + o_custkey) % 101 / 100.0 AS p, CAST((o_orderkey * 37 + o_custkey) % 101 + o_custkey % 60 > 75 AS INTEGER) AS y FROM orders)"
_M = """c AS (SELECT t AS threshold, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, count(*) FILTER (WHERE p < t AND y = 0) AS tn FROM s, g GROUP BY 1)"""
_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7]
query("threshold_metrics_M12_M15", f"{_SCORED}, g AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7]) AS DOUBLE) AS t), {_M} SELECT {r6('threshold', 'threshold')}, {r6('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {r6('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r6('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, tp + fn AS support FROM c")(
    lambda s, d: mlprep.threshold_metrics(_scored(s, d), _THRESHOLDS)
)
query("roc_auc_M13", f"{_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s) SELECT {r6('(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))', 'auc')} FROM r")(lambda s, d: mlprep.roc_auc(_scored(s, d)))
query("best_f1_M14", f"{_SCORED}, g AS (SELECT CAST(i / 100.0 AS DOUBLE) AS t FROM range(1, 100) r(i)), {_M}, f AS (SELECT threshold, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c) SELECT {r6('threshold', 'threshold')}, {r6('f1', 'f1')} FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1")(lambda s, d: mlprep.best_threshold(_scored(s, d)))


def _calibrated(spark, sf_dir):
    """Every order, calibrated by the validation rows of the split in time."""
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    split = mlprep.chronological_split(_scored(spark, sf_dir).join(dates, "o_orderkey"), order=("o_orderdate", "o_orderkey"))
    return mlprep.isotonic(split.where("split = 'validation'"), split).select("o_orderkey", "split", "calibrated")


query("isotonic_M16")(_calibrated)
_PT = "CASE WHEN y = 1 THEN least(greatest(p, 1e-7), 1 - 1e-7) ELSE 1 - least(greatest(p, 1e-7), 1 - 1e-7) END"
query("focal_M17", f"{_SCORED}, x AS (SELECT o_orderkey, y, CAST({_PT} AS DOUBLE) AS pt FROM s) SELECT o_orderkey, {r6('-ln(pt)', 'bce')}, {r6('-CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END * (1 - pt) ** 2 * ln(pt)', 'focal')} FROM x")(lambda s, d: mlprep.losses(_scored(s, d)).select("o_orderkey", "bce", "focal"))
query("feature_kinds_M1_M2", "SELECT unnest(['s_close', 'close_tb_4h', 'm_rsi', 'l_rsi', 'market_regime_x', 'CDLDOJI']) AS name, unnest(['short', 'short', 'medium', 'long', 'regime', 'unscaled']) AS kind")(
    lambda s, d: s.createDataFrame([(n, k) for k, names in mlprep.feature_kinds(["s_close", "close_tb_4h", "m_rsi", "l_rsi", "market_regime_x", "CDLDOJI"]).items() for n in names if not (k == "unscaled" and "regime" in n)], "name string, kind string")
)
