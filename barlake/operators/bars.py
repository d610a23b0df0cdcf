"""Bars from ticks and from bars."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import finite, ratio
from ..functions.slices import SLICE, lookup, numbered, sliced
from ..sources.ticks import taker_side

TICK_ORDER = ("timestamp", "trade_id")


def _first(c: str, order: Sequence[str] = TICK_ORDER) -> Column:
    return F.min_by(c, F.struct(*order))


def _last(c: str, order: Sequence[str] = TICK_ORDER) -> Column:
    return F.max_by(c, F.struct(*order))


def ohlcv(order: Sequence[str] = TICK_ORDER, quote: str = "quote_quantity") -> list[Column]:
    """Open, high, low, close and sums of a group of ticks."""
    return [
        _first("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), _last("price", order).alias("close"),
        F.sum("quantity").cast("double").alias("volume"), F.sum(quote).cast("double").alias("dollar_volume"), F.count("*").alias("num_ticks"),
    ]


# --- calendar bars


def time_bars(ticks: DataFrame, frequency: str, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Bars of a calendar interval, aligned to the epoch; intervals without ticks give no bar.

    Intra-bar statistics use ticks with a positive quantity; prices use all.
    One shuffle on (symbol, interval), with partial sums before it.
    """
    real = F.col("quantity") > 0
    q = F.when(real, F.col("quantity").cast("double"))
    p = F.when(real, F.col("price"))
    side = taker_side(F.col("isBuyerMaker")) if "isBuyerMaker" in ticks.columns else F.lit(None).cast("int")
    span = F.window(F.col("timestamp"), frequency)
    n = F.col("n_real")
    return (
        ticks.groupBy("symbol", span.alias("span"))
        .agg(
            *ohlcv(order), F.sum(p * q).alias("pq"), F.sum(q).alias("q"), F.sum(q * side).alias("qs"), F.count(q).alias("n_real"),
            F.skewness(p).alias("ps"), F.kurtosis(p).alias("pk"), F.skewness(q).alias("qk_s"), F.kurtosis(q).alias("qk_k"), F.avg(q).alias("avg_trade_size"),
        )
        .select(
            "symbol", F.col("span.start").cast("timestamp_ntz").alias("ts"), (F.col("span.end").cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")).alias("close_ts"),
            "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks",
            ratio("pq", "q").alias("vwap"), ratio("qs", "q").alias("ofi"),
            F.when(n > 2, finite("ps")).alias("price_skew"), F.when(n > 3, finite("pk")).alias("price_kurtosis"),
            F.when(n > 2, finite("qk_s")).alias("volume_skew"), F.when(n > 3, finite("qk_k")).alias("volume_kurtosis"), "avg_trade_size",
        )
    )


def drop_month_tail(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Without the last bar of every month, as pipelines that never write the open bar of a file leave it."""
    last = Window.partitionBy(*keys, F.year("ts"), F.month("ts"))
    return bars.withColumn("last_ts", F.max("ts").over(last)).where("ts < last_ts").drop("last_ts")


def micro_bars(ticks: DataFrame, frequency: str) -> DataFrame:
    """Interval bars with trade-level microstructure.

    One exchange: the windows inside a bar and the grouping share its key.
    """
    ticks = ticks.withColumn("span", F.window("timestamp", frequency)["start"].cast("timestamp_ntz"))
    inside = Window.partitionBy("symbol", "span")
    order = inside.orderBy(*TICK_ORDER)
    step = F.abs(F.col("price") - F.lag("price").over(order))
    wait = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lag("timestamp").over(order).cast("timestamp"))) / 1000.0
    quote = F.col("quote_quantity")
    prepared = ticks.withColumns({
        "step": step, "wait": wait, "q80": F.percentile(quote, F.lit(0.8)).over(inside), "q20": F.percentile(quote, F.lit(0.2)).over(inside),
    })
    buys = F.when(~F.col("isBuyerMaker"), quote).otherwise(0.0)
    sells = F.when(F.col("isBuyerMaker"), quote).otherwise(0.0)
    many = F.col("trade_count") > 1
    return (
        prepared.groupBy("symbol", F.col("span").alias("ts"))
        .agg(
            _first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), _last("price").alias("close"),
            F.sum("quantity").cast("double").alias("volume_base"), F.sum(quote).alias("volume_quote"), F.count("*").alias("trade_count"),
            F.avg((~F.col("isBuyerMaker")).cast("double")).alias("buyer_initiated_ratio"),
            F.avg("quantity").alias("avg_trade_size_base"), F.avg(quote).alias("avg_trade_size_quote"),
            F.avg((quote > F.col("q80")).cast("double")).alias("large_trade_ratio"), F.avg((quote < F.col("q20")).cast("double")).alias("small_trade_ratio"),
            F.avg("price").alias("mean_price"), F.avg("step").alias("mean_step"), F.avg("wait").alias("avg_trade_interval_ms"), F.sum(buys).alias("buys"), F.sum(sells).alias("sells"),
        )
        .select(
            "symbol", "ts", "open", "high", "low", "close", "volume_base", "volume_quote", "trade_count", "buyer_initiated_ratio", "avg_trade_size_base", "avg_trade_size_quote",
            "large_trade_ratio", "small_trade_ratio", F.when(many, ratio(F.col("high") - F.col("low"), "mean_price")).otherwise(0.0).alias("price_range_norm"),
            ratio("volume_quote", "volume_base").alias("vwap"), F.col("trade_count").alias("trades_per_minute"),
            F.when(many, F.col("mean_step")).otherwise(0.0).alias("avg_price_step"), "avg_trade_interval_ms",
            ratio(F.col("buys") - F.col("sells"), F.col("buys") + F.col("sells")).alias("volume_imbalance"),
        )
    )


def fill_gaps(bars: DataFrame, frequency: str) -> DataFrame:
    """A bar for every interval between a series' first and last: prices carried on, volumes zero."""
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = spans.select("symbol", F.explode(F.expr(f"sequence(a, b, INTERVAL {frequency})")).alias("ts"))
    before = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(c, ignorenulls=True).over(before).alias(c) for c in ("open", "high", "low", "close")]
    return grid.join(bars, ["symbol", "ts"], "left").select("symbol", "ts", *carried, *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in bars.dtypes if c in ("volume", "dollar_volume", "num_ticks")])


def merge_partial_bars(parts: DataFrame, order: str = "part") -> DataFrame:
    """Bars that were cut between files, put together: first, extremes, last, sums, and means of ratios."""
    sums = [c for c in ("volume", "dollar_volume", "num_ticks") if c in parts.columns]
    means = [c for c in parts.columns if c.endswith("_ratio")]
    return parts.groupBy("symbol", "ts").agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means],
    )


# --- activity bars


class _Series:
    """Rows of one series or slice after the other, as batches stream by."""

    def __init__(self, names: Sequence[str], amount: str):
        self.names, self.amount = names, amount

    def parts(self, batch: pa.RecordBatch):
        """Key, first and last row, and amounts of each run of equal keys in a batch."""
        columns = [batch.column(batch.schema.names.index(k)) for k in self.names]
        value = np.asarray(batch.column(batch.schema.names.index(self.amount)).fill_null(0), np.int64)
        if not len(value):
            return
        new = np.zeros(len(value), bool)
        for c in columns:
            codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *starts], [*starts, len(value)], strict=True):
            yield tuple(c[a].as_py() for c in columns), a, b, value[a:b]


def closes(sums: np.ndarray, total: int, threshold: int) -> list[int]:
    """Rows at which bars close, from the running sums of amounts and what the open bar has before them."""
    out, base, at = [], -total, 0
    while at < len(sums):
        at = max(at, int(np.searchsorted(sums, base + threshold, "left")))
        if at < len(sums):
            out.append(at)
            base, at = int(sums[at]), at + 1
    return out


def exits(sums: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a slice does to an open bar: for each row that can close it first, the sum at that row, what the last bar has at the end, and the bars closed.

    Only rows before the slice's own sum reaches the threshold can be first, so
    there are about as many as a bar has rows.
    """
    first = np.arange(int(np.searchsorted(sums, threshold, "left")) + 1) if len(sums) else np.zeros(0, int)
    first = first[first < len(sums)]
    at, count = first.copy(), np.ones(len(first), np.int64)
    live = np.arange(len(first))
    while len(live):
        onward = np.maximum(np.searchsorted(sums, sums[at[live]] + threshold, "left"), at[live] + 1)
        go = onward < len(sums)
        live, onward = live[go], onward[go]
        at[live] = onward
        count[live] += 1
    return sums[first], (sums[-1] - sums[at]) if len(first) else np.zeros(0, np.int64), count


def assign_by_threshold(rows: DataFrame, amount: str, threshold: int, keys: Sequence[str], order: Sequence[str], slice_rows: int | None = None) -> DataFrame:
    """Add ``bar_id``: a bar closes with the row at which its own sum reaches ``threshold``, and the next starts at zero.

    ``amount`` is a whole number, not negative, so sums are exact.  A bar's start
    depends on where the one before ended, yet a series isn't one task's work: it
    is cut into slices, each of which says in parallel what it does to the bar
    that is open where it starts (``exits``); a walk over the slices then finds
    what is open at each start, and every slice is divided by itself.  Arrow
    batches stream through; a task holds the amounts of a slice at most.
    """
    cut, columns = sliced(rows, keys, order, slice_rows), rows.columns
    group = [*keys, SLICE]
    dealt = lambda df: df.repartition(*group).sortWithinPartitions(*group, *order)
    key_types = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)

    def effects(batches):
        reader, last, held = _Series(group, amount), None, []

        def done():
            sums = np.cumsum(np.concatenate(held))
            at, left, count = exits(sums, threshold)
            fields = [[v] for v in last] + [[int(sums[-1])], [at], [left], [count]]
            return pa.RecordBatch.from_arrays([pa.array(f, type=t) for f, t in zip(fields, [*kinds, pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3], strict=True)], names=[*group, "total", "at", "left", "bars"])

        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = kinds or [b.schema.field(k).type for k in keys]
            for key, _, _, value in reader.parts(b):
                if key != last and held:
                    yield done()
                    held = []
                last = key
                held.append(value)
        if held:
            yield done()

    def walk(batches):
        last, open_, bar = None, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != last:
                    last, open_, bar = key, 0, 0
                out.append({**{k: r[k] for k in group}, "__open": open_, "__bar": bar})
                i = int(np.searchsorted(r["at"], threshold - open_, "left"))
                if open_ + r["total"] >= threshold and i < len(r["at"]):
                    open_, bar = r["left"][i], bar + r["bars"][i]
                else:
                    open_ += r["total"]
            fields = [*[b.schema.field(k) for k in group], pa.field("__open", pa.int64()), pa.field("__bar", pa.int64())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    comma = ", " if keys else ""
    found = dealt(cut.select(*group, *[c for c in order if c not in group], amount)).mapInArrow(effects, f"{key_types}{comma}{SLICE} long, total long, at array<long>, left array<long>, bars array<long>")
    walked = (found.repartition(*keys) if keys else found.coalesce(1)).sortWithinPartitions(*group)  # a row for each slice
    starts = walked.mapInArrow(walk, f"{key_types}{comma}{SLICE} long, __open long, __bar long")

    def run(batches):
        reader, last, open_, bar = _Series(group, amount), None, 0, 0
        for b in batches:
            ids = np.zeros(b.num_rows, np.int64)
            for key, a, e, value in reader.parts(b):
                if key != last:
                    last, open_, bar = key, *(b.column(b.schema.names.index(c))[a].as_py() for c in ("__open", "__bar"))
                sums = np.cumsum(value)
                ends = np.array(closes(sums, open_, threshold), np.int64)
                ids[a:e] = bar + np.searchsorted(ends, np.arange(e - a), "left")
                bar += len(ends)
                open_ = int(sums[-1] - sums[ends[-1]]) if len(ends) else open_ + int(sums[-1])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(c)) for c in columns] + [pa.array(ids)], names=[*columns, "bar_id"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", bar_id bigint"
    return dealt(lookup(cut, starts, group)).mapInArrow(run, schema)


def activity_bars(ticks: DataFrame, threshold: int, amount: str = "quote_cents", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars closed by traded amount, with intra-bar path statistics; the last, open bar of a series is kept."""
    assigned = assign_by_threshold(ticks, amount, threshold, keys, TICK_ORDER)
    group = [*keys, "bar_id"]
    order = Window.partitionBy(*group).orderBy(*TICK_ORDER)
    step = F.col("price") - F.lag("price").over(order)
    sign = F.signum("step")
    back = F.when(F.lag("price").over(order) > 0, F.ln(F.col("price") / F.lag("price").over(order)))
    moved = Window.partitionBy(*group).orderBy(*TICK_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    walked = assigned.withColumns({"step": step, "back": back}).withColumn("sign", F.when(F.col("step") != 0, sign)).withColumn("before", F.last("sign", ignorenulls=True).over(moved))
    q = F.col("quantity").cast("double")
    buys, sells = F.sum(F.when(~F.col("isBuyerMaker"), q)), F.sum(F.when(F.col("isBuyerMaker"), q))
    known = F.count("isBuyerMaker")
    wide = (F.col("num_ticks") > 1) & (F.col("sd") >= 1e-9)
    b, s = F.coalesce("buys", F.lit(0.0)), F.coalesce("sells", F.lit(0.0))
    return (
        walked.groupBy(*group)
        .agg(
            F.min("timestamp").alias("open_timestamp"), F.max("timestamp").alias("close_timestamp"), *ohlcv(), buys.alias("buys"), sells.alias("sells"), known.alias("known"),
            F.stddev_pop("back").alias("path"), F.stddev_pop("price").alias("sd"), F.skewness("price").alias("skew"), F.kurtosis("price").alias("kurt"),
            F.sum((F.col("step") != 0).cast("long")).alias("changes"), F.sum((F.col("sign") != F.col("before")).cast("long")).alias("turns"), F.sum(amount).alias("amount"),
        )
        .select(
            *group, "open_timestamp", "close_timestamp", "open", "high", "low", "close", "volume", "dollar_volume", "num_ticks", F.col("amount").alias("bar_amount"),
            F.when(F.col("known") > 0, F.coalesce(ratio(b - s, b + s), F.lit(0.0))).alias("trade_imbalance"),
            F.when(F.col("known") > 0, F.when(s > 0, b / s).when(b > 0, float("inf")).otherwise(0.0)).alias("taker_buy_sell_ratio"),
            F.coalesce(finite("path"), F.lit(0.0)).alias("intra_bar_tick_price_volatility"),
            F.when(wide, finite("skew")).otherwise(0.0).alias("tick_price_skewness"), F.when(wide, finite("kurt")).otherwise(0.0).alias("tick_price_kurtosis"),
            F.coalesce("changes", F.lit(0)).alias("num_price_changes"), F.coalesce("turns", F.lit(0)).alias("num_directional_changes"),
        )
    )


def tick_bars(ticks: DataFrame, n: int) -> DataFrame:
    """Bars of ``n`` ticks each; the last may have fewer."""
    return numbered(ticks, ["symbol"], TICK_ORDER, "__at").withColumn("bar_id", F.floor(F.col("__at") / n)).groupBy("symbol", "bar_id").agg(*ohlcv())


# --- bars of bars


def _merged(grouped: DataFrame, group: list[str], size: int | None) -> DataFrame:
    order = ("open_timestamp", "seq")
    inside = Window.partitionBy(*group).orderBy(*order)
    sign = F.signum(F.col("close") - F.col("open"))
    marked = grouped.withColumn("flip", F.coalesce(((F.lag(sign).over(inside) != sign) & (F.lag(sign).over(inside) != 0) & (sign != 0)).cast("long"), F.lit(0)))
    dv, v = F.col("dollar_volume"), F.col("volume")
    r = finite("taker_buy_sell_ratio")
    out = marked.groupBy(*group).agg(
        F.min("open_timestamp").alias("open_timestamp"), F.max("close_timestamp").alias("close_timestamp"),
        F.min_by("open", F.struct(*order)).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.struct(*order)).alias("close"),
        F.sum(v).alias("volume"), F.sum(dv).alias("dollar_volume"), F.sum("num_ticks").alias("num_ticks"), F.count("*").alias("constituent_bar_count"),
        F.sum("trade_imbalance").alias("trade_imbalance"), ratio(F.sum(F.col("trade_imbalance") * v), F.sum(v)).alias("trade_imbalance_norm"),
        F.sqrt(ratio(F.sum(F.pow("intra_bar_tick_price_volatility", F.lit(2)) * dv), F.sum(dv))).alias("intra_bar_tick_price_volatility"),
        F.coalesce(F.sum(r * dv / (1 + r)), F.lit(0.0)).alias("b"), F.coalesce(F.sum(dv / (1 + r)), F.lit(0.0)).alias("s"),
        ratio(F.sum(F.col("tick_price_skewness") * dv), F.sum(dv)).alias("tick_price_skewness"), ratio(F.sum(F.col("tick_price_kurtosis") * dv), F.sum(dv)).alias("tick_price_kurtosis"),
        (F.sum("num_directional_changes") + F.sum("flip")).alias("num_directional_changes"),
    )
    if size:
        out = out.where(F.col("constituent_bar_count") == size)
    seconds = (F.unix_micros(F.col("close_timestamp").cast("timestamp")) - F.unix_micros(F.col("open_timestamp").cast("timestamp"))) / 1e6
    taker = F.when(F.col("s") > 1e-9, F.col("b") / F.col("s")).when(F.col("b") > 1e-9, 1.7976931348623157e308).otherwise(1.0)
    return out.withColumns({"bar_duration_seconds": seconds, "taker_buy_sell_ratio": taker}).drop("b", "s")


def merge_by_count(bars: DataFrame, n: int) -> DataFrame:
    """Every ``n`` bars in a row become one; a last group with fewer goes."""
    counted = numbered(bars, ["symbol"], ["bar_id"], "__at").withColumns({"seq": F.col("bar_id"), "bar_id": F.floor(F.col("__at") / n)}).drop("__at")
    return _merged(counted, ["symbol", "bar_id"], n)


def merge_by_amount(bars: DataFrame, threshold: int, amount: str = "bar_amount") -> DataFrame:
    """Bars in a row become one when their sum reaches ``threshold``; a last group below it goes."""
    assigned = assign_by_threshold(bars.withColumnRenamed("bar_id", "seq"), amount, threshold, ["symbol"], ["seq"])
    total = F.sum(amount).over(Window.partitionBy("symbol", "bar_id"))
    return _merged(assigned.withColumn("total", total).where(F.col("total") >= threshold).drop("total"), ["symbol", "bar_id"], None)
