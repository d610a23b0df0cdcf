"""Bars and indicators over streams of ticks.

The batch results are the reference: a replay of the same rows gives the same
closed bars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import time_bars
from ..sources.files import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of the events table, as they arrive."""
    from ..sources.ticks import from_events

    schema = spark.read.parquet(path).schema
    # a path of one file is read as the only match in its folder
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    single = not spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").isEmpty()
    stream = source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)
    return from_events(stream).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def stream_time_bars(ticks: DataFrame, frequency: str, late: str = "10 minutes") -> DataFrame:
    """Calendar bars; a bar is final when the watermark passes its end, and later ticks are dropped."""
    return time_bars(ticks.withWatermark("timestamp", late), frequency)


class _Closing(StatefulProcessor):
    """Keeps the open bar of a series; its fields are sums and extremes, never rows."""

    threshold = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bar", "bar_id long, open double, high double, low double, close double, volume double, amount long, ticks long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["timestamp", "trade_id"], kind="stable")
        bar = list(self.state.get()) if self.state.exists() else [0, None, None, None, None, 0.0, 0, 0]
        out = []
        for p, q, a in zip(frame["price"].tolist(), frame["quantity"].tolist(), frame["quote_cents"].tolist(), strict=True):
            bar = [bar[0], p if bar[7] == 0 else bar[1], p if bar[7] == 0 else max(bar[2], p), p if bar[7] == 0 else min(bar[3], p), p, bar[5] + q, bar[6] + a, bar[7] + 1]
            if bar[6] >= self.threshold:
                out.append((key[0], *bar))
                bar = [bar[0] + 1, None, None, None, None, 0.0, 0, 0]
        self.state.update(tuple(bar))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "open", "high", "low", "close", "volume", "bar_amount", "num_ticks"])

    def close(self) -> None:
        pass


class _Merging(StatefulProcessor):
    """Keeps the open group of bars of a series."""

    size = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", "bar_id long, open double, high double, low double, close double, volume double, amount long, ticks long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("bar_id", kind="stable")
        g = list(self.state.get()) if self.state.exists() else [0, None, None, None, None, 0.0, 0, 0, 0]
        out = []
        for b in frame.itertuples():
            first = g[8] == 0
            g = [g[0], b.open if first else g[1], b.high if first else max(g[2], b.high), b.low if first else min(g[3], b.low), b.close, g[5] + b.volume, g[6] + b.bar_amount, g[7] + b.num_ticks, g[8] + 1]
            if g[8] == self.size:
                out.append((key[0], *g[:8]))
                g = [g[0] + 1, None, None, None, None, 0.0, 0, 0, 0]
        self.state.update(tuple(g))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "open", "high", "low", "close", "volume", "bar_amount", "num_ticks"])

    def close(self) -> None:
        pass


class _Online(StatefulProcessor):
    """Exponential mean, relative strength and average range, one value at a time."""

    n = 14

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "seen long, last double, ema double, up double, down double, range double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("bar_id", kind="stable")
        seen, last, ema, up, down, mean_range = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        n, out = self.n, []
        for b in frame.itertuples():
            c = b.close
            seen += 1
            ema = ema + c / n if seen <= n else ema + 2.0 / (n + 1) * (c - ema)
            if seen > 1:
                gain, loss = max(c - last, 0.0), max(last - c, 0.0)
                tr = max(b.high - b.low, abs(b.high - last), abs(b.low - last))
                seeding = seen <= n + 1
                mix = lambda old, new: old + new / n if seeding else (old * (n - 1) + new) / n  # noqa: B023, E731
                up, down, mean_range = mix(up, gain), mix(down, loss), mix(mean_range, tr)
            last = c
            warm = seen > n
            out.append((key[0], int(b.bar_id), ema if seen >= n else None, (100 * up / (up + down) if up + down else 0.0) if warm else None, mean_range if warm else None))
        self.state.update((seen, last, ema, up, down, mean_range))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "ema", "rsi", "atr"]).astype({"ema": float, "rsi": float, "atr": float})

    def close(self) -> None:
        pass


BAR = "symbol string, bar_id long, open double, high double, low double, close double, volume double, bar_amount long, num_ticks long"


def _stateful(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy("symbol").transformWithStateInPandas(processor, schema, "append", "none")


def stream_activity_bars(ticks: DataFrame, threshold: int) -> DataFrame:
    """Bars closed by traded amount; the state of a series is its open bar."""
    p = _Closing()
    p.threshold = threshold
    return _stateful(ticks.select("symbol", "timestamp", "trade_id", "price", F.col("quantity").cast("double").alias("quantity"), "quote_cents"), p, BAR)


def stream_merged_bars(bars: DataFrame, size: int) -> DataFrame:
    """Every ``size`` bars of a stream become one."""
    p = _Merging()
    p.size = size
    return _stateful(bars, p, BAR)


def stream_indicators(bars: DataFrame, n: int = 14) -> DataFrame:
    """Exponential mean, relative strength and average range of a stream of bars."""
    p = _Online()
    p.n = n
    return _stateful(bars, p, "symbol string, bar_id long, ema double, rsi double, atr double")


def replay(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, into files of the shared folder, and return them."""
    spark, base = df.sparkSession, scratch(df.sparkSession)
    query = (
        df.writeStream.format("parquet").queryName(name).outputMode("append").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/{name}")
