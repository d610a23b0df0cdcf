"""Queries over files: what is written is read again, and held against the tables it came from."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators import joins, mlprep, profile
from ..sources import files
from ..sources.ticks import clean, daily_ticks, read_raw, ticks
from .analysis import _SPLIT, _model
from .base import HOURLY, TICKS, hourly, query, r6

KEY = ("symbol", "ts")


def _csv(spark, sf_dir) -> str:
    """Ticks as headerless CSV files of seven columns, some values broken."""
    path = files.scratch(spark)
    t = ticks(spark, sf_dir)
    odd = F.col("trade_id") % 50
    t.select(
        "trade_id", F.when(odd == 1, "x").when(odd == 2, "NaN").otherwise(F.col("price").cast("string")).alias("price"), F.when(odd == 3, "inf").otherwise(F.col("quantity").cast("string")).alias("quantity"), F.col("quote_quantity").cast("string").alias("quote"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias("at"), F.when(odd == 4, "?").when(F.col("isBuyerMaker"), "TRUE").otherwise("0").alias("maker"), F.lit("true").alias("best"),
    ).write.csv(path)
    return path


_CSV_SQL = f"WITH {TICKS}, good AS (SELECT *, trade_id % 50 AS odd FROM ticks WHERE trade_id % 50 NOT IN (1, 2, 3))"
_CSV_COLUMNS = f"SELECT trade_id, date_trunc('millisecond', \"timestamp\") AS ts, {r6('price', 'price')}, CAST(quantity AS DOUBLE) AS quantity, CASE WHEN odd <> 4 THEN maker END AS maker FROM good"


def _ticks_of(df):
    return df.select("trade_id", F.col("timestamp").alias("ts"), "price", "quantity", F.col("isBuyerMaker").alias("maker"))


query("raw_csv_A1_A6", f"{_CSV_SQL} {_CSV_COLUMNS}")(lambda s, d: _ticks_of(clean(read_raw(s, f"{_csv(s, d)}/part-*"))))
query("raw_csv_first_A3", f"{_CSV_SQL} {_CSV_COLUMNS} ORDER BY trade_id LIMIT 1000")(lambda s, d: _ticks_of(files.first_rows(clean(read_raw(s, _csv(s, d))), ["trade_id"], 1000)))


def _months(spark, sf_dir):
    """Daily ticks of each series and month, as a folder per month."""
    path = files.scratch(spark)
    files.write_months(daily_ticks(spark, sf_dir).select("symbol", "year", "month", "timestamp", "price", "l_orderkey"), path)
    return path


query("month_layout_A14_A16", f"SELECT 'L' AS symbol, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n, {r6('sum(l_extendedprice / l_quantity)', 'price')} FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY ALL")(
    lambda s, d: s.read.parquet(_months(s, d)).where("year = 1995").groupBy("symbol", "year", "month").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
)


def _rewritten(spark, sf_dir):
    """One month written anew, without its expensive rows; the other months stay."""
    path = files.scratch(spark)
    rows = daily_ticks(spark, sf_dir).where("year >= 1996").select("symbol", "year", "month", "price")
    files.write_months(rows, path)
    files.write_months(rows.where("year = 1996 AND month = 5 AND price < 1500"), path)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"))


query("rewritten_month_A16", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n FROM lineitem WHERE year(l_shipdate) >= 1996 AND NOT (year(l_shipdate) = 1996 AND month(l_shipdate) = 5 AND l_extendedprice / l_quantity >= 1500) GROUP BY ALL")(_rewritten)


def _month_files(spark, sf_dir):
    base = files.scratch(spark)
    bars = hourly(spark, sf_dir)
    for name in ("B_2024_02", "A_2023_11", "B_2023_12", "other"):
        bars.where("symbol = 'S1'").limit(1).write.parquet(f"{base}/{name}.parquet")
    found = files.month_files(spark, base)
    return found.select("symbol", "year", "month", F.monotonically_increasing_id().alias("place")).coalesce(1)


query("month_files_A5", "SELECT * FROM (VALUES ('A', CAST(2023 AS INTEGER), CAST(11 AS INTEGER), CAST(0 AS BIGINT)), ('B', 2023, 12, 1), ('B', 2024, 2, 2)) v(symbol, year, month, place)")(_month_files)


def _tolerant(spark, sf_dir):
    """Two files of other columns and types read as one table."""
    path = files.scratch(spark)
    h = hourly(spark, sf_dir)
    h.where("symbol = 'S0'").select("symbol", "ts", F.col("close").alias("last")).write.parquet(f"{path}/a")
    h.where("symbol = 'S1'").select("symbol", "ts", "close", F.col("volume").cast("double")).write.parquet(f"{path}/b")
    return files.read_tolerant(spark, f"{path}/*", {"symbol": "string", "ts": "timestamp_ntz", "close": "double", "volume": "double", "vwap": "double"}, {"close": ["last"]})


query("tolerant_read_A8", f"{HOURLY} SELECT symbol, ts, {r6('close', 'close')}, CASE WHEN symbol = 'S1' THEN volume END AS volume, CAST(NULL AS DOUBLE) AS vwap FROM bars WHERE symbol IN ('S0', 'S1')")(_tolerant)


def _footers(spark, sf_dir):
    expected = StructType([StructField("o_orderkey", LongType()), StructField("o_totalprice", DoubleType()), StructField("o_missing", StringType())])
    found = files.footer_report(spark, [f"{sf_dir}/orders.parquet"], expected)
    return found.select("rows", F.array_join("missing", ",").alias("missing"), F.array_contains("extra", "o_custkey").alias("has_custkey"), F.size("wrong_type").alias("wrong"))


query("footers_A11_V1_V2", "SELECT count(*) AS rows, 'o_missing' AS missing, true AS has_custkey, CAST((SELECT count(*) FROM (DESCRIBE orders) WHERE (column_name = 'o_orderkey' AND column_type <> 'BIGINT') OR (column_name = 'o_totalprice' AND column_type <> 'DOUBLE')) AS INTEGER) AS wrong FROM orders")(_footers)


def _chunked(spark, sf_dir):
    path = files.scratch(spark)
    t = ticks(spark, sf_dir).select("symbol", "trade_id", "price")
    files.write_chunks([t.where("symbol = 'S0'"), t.where("symbol = 'S1'").withColumn("price", F.col("price").cast("string")), t.where("symbol = 'S2'").drop("price")], path)
    return spark.read.parquet(path)


query("chunked_sink_A13", f"WITH {TICKS} SELECT symbol, trade_id, {r6('price', 'price')} FROM ticks WHERE symbol IN ('S0', 'S1') UNION ALL SELECT symbol, trade_id, NULL FROM ticks WHERE symbol = 'S2'")(_chunked)


def _single(spark, sf_dir):
    base = files.scratch(spark)
    bars = hourly(spark, sf_dir).select(*KEY, "close")
    files.write_single(bars, f"{base}/bars.parquet", f"{base}/aside")
    files.write_single(spark.read.parquet(f"{base}/bars.parquet").withColumn("double", F.col("close") * 2), f"{base}/bars.parquet", f"{base}/aside")
    return spark.read.parquet(f"{base}/bars.parquet")


query("single_sink_A15", f"{HOURLY} SELECT symbol, ts, {r6('close', 'close')}, {r6('close * 2', 'double')} FROM bars")(_single)


def _swapped(spark, sf_dir):
    base = files.scratch(spark)
    hourly(spark, sf_dir).select(*KEY, "close").write.parquet(f"{base}/t")
    return files.write_swapped(spark.read.parquet(f"{base}/t").where("symbol <> 'S3'"), f"{base}/t", f"{base}/aside")


query("in_place_A15", f"{HOURLY} SELECT symbol, ts, {r6('close', 'close')} FROM bars WHERE symbol <> 'S3'")(_swapped)


def _reported(spark, sf_dir):
    path = files.scratch(spark)
    files.write_report(profile.sample_stats(ticks(spark, sf_dir)).select("symbol", "low", "high", "missing_prices"), path)
    return spark.read.schema("symbol string, low double, high double, missing_prices long").json(path)


query("report_A19", f"WITH {TICKS} SELECT symbol, {r6('min(price)', 'low')}, {r6('max(price)', 'high')}, count(*) - count(price) AS missing_prices FROM ticks GROUP BY 1")(_reported)


def _listed(spark, sf_dir):
    """Columns of a list file; the list has comments, blanks, repeats and absent names."""
    path = files.scratch(spark)
    spark.createDataFrame([(x,) for x in ("# wanted", "close", "", " volume ", "close", "gone")], "value string").coalesce(1).write.text(path)
    bars, missing = mlprep.select_features(hourly(spark, sf_dir), names=files.read_names(spark, path), always=KEY)
    return bars.withColumn("missing", F.lit(",".join(missing)))


query("feature_list_A20_M1", f"{HOURLY} SELECT symbol, ts, {r6('close', 'close')}, volume, 'gone' AS missing FROM bars")(_listed)
query("feature_kinds_select_M1", f"{HOURLY} SELECT symbol, ts, {r6('open', 's_open')}, {r6('close', 'l_close')} FROM bars")(
    lambda s, d: mlprep.select_features(hourly(s, d).select(*KEY, F.col("open").alias("s_open"), F.col("high").alias("m_high"), F.col("close").alias("l_close")), kinds=["short", "long"], always=KEY)[0]
)


def _inventoried(spark, sf_dir):
    path = files.scratch(spark)
    for year, n in ((2023, 2), (2024, 1)):
        for k in range(n):
            spark.createDataFrame([("12345678",)], "value string").coalesce(1).write.text(f"{path}/T-{year}-{k}")
    spark.read.text(f"{path}/*").count()
    rows = spark.read.text(f"{path}/*", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"T-(\d{4})", 1).alias("year"), F.length("value").alias("bytes"))
    return files.extrapolated(rows.groupBy("year").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")), growth=4.0, rows_per_mb=1e6)


query("inventory_A21_G20", f"SELECT CAST(3 AS BIGINT) AS files, {r6('27 / 1e9', 'gb')}, {r6('27 / 1e9 * 4', 'gb_unpacked')}, CAST(27 AS BIGINT) AS rows")(_inventoried)

# --- rows and columns

query("rows_of_month_P9", "SELECT CAST(l_shipdate AS TIMESTAMP) AS ts, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= DATE '1995-12-01' AND l_shipdate < DATE '1996-01-01'")(
    lambda s, d: files.rows_of_month(daily_ticks(s, d), 1995, 12).select(F.col("timestamp").alias("ts"), "l_orderkey", "l_linenumber")
)
query("concat_columns_J4", f"{HOURLY}, f AS (SELECT symbol, ts, close FROM bars WHERE num_ticks > 2), v AS (SELECT symbol, ts, volume FROM bars WHERE num_ticks < 6), n AS (SELECT symbol, ts, num_ticks FROM bars WHERE symbol = 'S1') SELECT symbol, ts, {r6('close', 'close')}, volume, num_ticks FROM f FULL JOIN v USING (symbol, ts) FULL JOIN n USING (symbol, ts)")(
    lambda s, d: joins.concat_columns([hourly(s, d).where("num_ticks > 2").select(*KEY, "close"), hourly(s, d).where("num_ticks < 6").select(*KEY, "volume"), hourly(s, d).where("symbol = 'S1'").select(*KEY, "num_ticks")], KEY)
)
query("suffixed_P14", f"{HOURLY} SELECT symbol, ts, {r6('open', 'open_tb_1h')}, {r6('close', 'close_tb_1h')} FROM bars")(lambda s, d: joins.suffixed(hourly(s, d).select(*KEY, "open", "close"), "_tb_1h", KEY))
query("drop_empty_P15", f"{HOURLY} SELECT symbol, ts, {r6('close', 'close')} FROM bars")(lambda s, d: joins.drop_empty_columns(hourly(s, d).select(*KEY, "close", F.when(F.col("close") < 0, F.col("close")).alias("never"))))
query("numeric_P16", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS name")(lambda s, d: s.createDataFrame([(n,) for n in profile.numeric(s.read.parquet(f"{d}/orders.parquet")) if n in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")], "name string"))


def _stored_scaler(kind):
    def run(spark, sf_dir):
        """A scaler that was fitted, written, read again and applied."""
        rows, path = _model(spark, sf_dir), files.scratch(spark)
        mlprep.fit_scaler(rows, ["close"], kind).write.parquet(path)
        return mlprep.apply_scaler(rows, spark.read.parquet(path)).select(*KEY, "close")

    return run


for _kind, _c, _w in (("standard", "avg(close)", "stddev_pop(close)"), ("minmax", "min(close)", "max(close) - min(close)"), ("robust", "median(close)", "quantile_cont(close, 0.75) - quantile_cont(close, 0.25)")):
    query(f"stored_scaler_{_kind}_A22", f"{_SPLIT}, f AS (SELECT {_c} AS c, {_w} AS w FROM m WHERE split = 'train') SELECT symbol, ts, {r6('(close - c) / CASE WHEN w > 0 THEN w ELSE 1 END', 'close')} FROM m, f")(_stored_scaler(_kind))
query("stored_scaler_quantile_A22")(_stored_scaler("quantile"))
query("stored_scaler_power_A22")(_stored_scaler("power"))
