"""Ticks: raw and cleaned files, and the view of them over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import finite
from ..schemas import TICK_RAW


def number(c: str) -> Column:
    """A number, or NULL for text that isn't one, NaN and infinities."""
    return finite(F.col(c).try_cast("double"))


def boolean(c: str) -> Column:
    text = F.lower(F.col(c))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV files with seven columns; large files are split by Spark."""
    return spark.read.schema(TICK_RAW).csv(path, header=False)


def clean(raw: DataFrame) -> DataFrame:
    """Canonical ticks: numbers, booleans and UTC timestamps; rows without price, quantity or quote quantity go."""
    return raw.select(
        F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("timestamp"),
        number("price").alias("price"), number("quantity").alias("quantity"), number("quote_quantity").alias("quote_quantity"),
        boolean("is_buyer_maker").alias("isBuyerMaker"), F.col("trade_id").cast("long").alias("trade_id"),
    ).dropna(subset=["price", "quantity", "quote_quantity"])


def taker_side(maker: Column) -> Column:
    """+1 where the buyer took, -1 where the seller did, NULL if unknown."""
    return F.when(~maker, 1).when(maker, -1)


def from_events(events: DataFrame) -> DataFrame:
    """The tick view of the events table, four series."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.col("event_id").alias("trade_id"), F.col("ts").alias("timestamp"),
        F.col("value").alias("price"), k.alias("quantity"), (F.round(F.col("value") * 100).cast("long") * k).alias("quote_cents"),
        (F.col("value") * k).alias("quote_quantity"), F.col("event_type").isin("view", "click").alias("isBuyerMaker"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks over many months with heavy ties, from the lineitem table."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.lit("L").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("quote_quantity"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
    )
