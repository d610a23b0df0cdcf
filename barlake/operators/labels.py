"""Forward-looking labels: which of two barriers is hit first.

With a horizon the bars ahead are an array in a bounded frame, searched inside
the JVM.  Without one a series is cut into slices.  Each slice answers what it
can by a tree of extremes, in time in proportion to its rows times their
logarithm; rows that stay open look for the first later slice whose extremes
reach a level in a table of slices, and are then answered there.  No row meets
more than two slices, and no series is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import series
from ..functions.slices import SLICE, sliced

#: Open rows that are answered in one slice by one task.
OPEN_ROWS = 1 << 17


class Extremes:
    """Greatest highs and least lows over aligned runs of bars, each level of twice the length of the one below."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.n, size = len(high), 1
        while size < max(1, len(high)):
            size *= 2
        pad = size - len(high)
        self.highs = [np.concatenate([np.nan_to_num(high, nan=-np.inf), np.full(pad, -np.inf)])]
        self.lows = [np.concatenate([np.nan_to_num(low, nan=np.inf), np.full(pad, np.inf)])]
        while len(self.highs[-1]) > 1:
            self.highs.append(self.highs[-1].reshape(-1, 2).max(1))
            self.lows.append(self.lows[-1].reshape(-1, 2).min(1))

    def first(self, start: np.ndarray, take: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each row the first bar from ``start`` on whose high is at least ``take`` or whose low is at most ``stop``; the number of bars if none is."""
        at, level = start.astype(np.int64).copy(), np.zeros(len(start), np.int64)
        out = np.full(len(start), self.n, np.int64)
        rows = np.flatnonzero((at < self.n) & ~(np.isnan(take) | np.isnan(stop)))
        up = np.ones(len(start), bool)
        tops = len(self.highs)
        while len(rows):
            k, a = level[rows], at[rows] >> level[rows]
            hit = np.zeros(len(rows), bool)
            for lv in np.unique(k).tolist():
                here = np.flatnonzero(k == lv)
                r = rows[here]
                hit[here] = (self.highs[lv][a[here]] >= take[r]) | (self.lows[lv][a[here]] <= stop[r])
            found = rows[hit & (k == 0)]
            out[found] = at[found]
            down = rows[hit & (k > 0)]  # it is in this run: look into its first half
            up[down] = False
            level[down] -= 1
            clear = rows[~hit]
            at[clear] += 1 << level[clear]
            # at the end of a run that is aligned to a longer one, go on with that
            rise = clear[up[clear] & (level[clear] + 1 < tops) & ((at[clear] >> level[clear]) % 2 == 0)]
            level[rise] += 1
            rows = np.concatenate([down, clear[at[clear] < self.n]])
        return out


def _search(bars: DataFrame, w, high: str, low: str, reach: int) -> DataFrame:
    ahead = F.collect_list(F.struct(F.col(high).alias("h"), F.col(low).alias("l"))).over(w.rowsBetween(1, reach))
    first = F.try_element_at(F.filter(ahead, lambda x: (x["h"] >= F.col("__tp")) | (x["l"] <= F.col("__sl"))), F.lit(1))
    return bars.withColumn("__hit", first)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


def _answers(tree: Extremes, found: np.ndarray, high: np.ndarray, low: np.ndarray, take: np.ndarray, stop: np.ndarray, tie: int) -> pa.Array:
    """Labels of rows whose first bar is ``found``; null where there is none."""
    there = found < tree.n
    h, lo = high[np.where(there, found, 0)], low[np.where(there, found, 0)]
    up, down = h >= take, lo <= stop
    label = np.where(up & down, tie, np.where(up, 1, 0)).astype(np.int32)
    return pa.array(label, pa.int32(), mask=~there)


def _unbounded(levels: DataFrame, keys: Sequence[str], order: Sequence[str], high: str, low: str, tie: int, name: str, rows: int | None) -> DataFrame:
    """Labels without a horizon; ``levels`` has ``__tp`` and ``__sl``."""
    cut = sliced(levels, keys, order, rows)
    columns = cut.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)

    def within(table):
        table = table.sort_by([(c, "ascending") for c in order]).combine_chunks()
        high_, low_, take, stop = (_numbers(table, c) for c in (high, low, "__tp", "__sl"))
        tree = Extremes(high_, low_)
        found = tree.first(np.arange(len(high_)) + 1, take, stop)
        return table.append_column(name, _answers(tree, found, high_, low_, take, stop, tie))

    own = cut.groupBy(*keys, SLICE).applyInArrow(within, schema + f", `{name}` int")
    ends = cut.groupBy(*keys, SLICE).agg(F.max(high).cast("double").alias("__high"), F.min(low).cast("double").alias("__low"))
    if ends.groupBy(*keys).count().where("count > 1").isEmpty():
        return own.drop(SLICE)
    table = ends.orderBy(SLICE).toArrow().to_pandas()  # a row for each SLICE_ROWS rows
    trees = {k if isinstance(k, tuple) else (k,): (g[SLICE].to_numpy(), Extremes(g["__high"].to_numpy(float), g["__low"].to_numpy(float))) for k, g in (table.groupby(list(keys), dropna=False) if keys else [((), table)])}
    sent = levels.sparkSession.sparkContext.broadcast({tuple(None if x != x else x for x in k): v for k, v in trees.items()})
    open_ = F.col(name).isNull() & F.col("__tp").isNotNull() & F.col("__sl").isNotNull()

    def onward(batches):
        for b in batches:
            series_ = list(zip(*[b.column(b.schema.names.index(k)).to_pylist() for k in keys], strict=True)) if keys else [()] * b.num_rows
            here, take, stop = (np.asarray(b.column(b.schema.names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in (SLICE, "__tp", "__sl"))
            target = np.full(b.num_rows, -2, np.int64)
            for key in set(series_):
                mine = np.array([i for i, x in enumerate(series_) if x == key])
                numbers, tree = sent.value[key]
                at = tree.first(np.searchsorted(numbers, here[mine], "right"), take[mine], stop[mine])
                target[mine[at < tree.n]] = numbers[at[at < tree.n]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(target)], names=[*b.schema.names, "__target"])

    waiting = own.where(open_).drop(name).mapInArrow(onward, schema + ", __target long")
    never = waiting.where("__target = -2").drop("__target", SLICE).withColumn(name, F.lit(None).cast("int"))
    asks = waiting.where("__target > -2")
    salts = asks.groupBy(*keys, "__target").agg(F.ceil(F.count("*") / OPEN_ROWS).cast("int").alias("__salts"))
    asks = asks.withColumn("__whole", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(1 << 30)))
    asked = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in keys] + [F.col("a.__target") == F.col("b.__target")]
    asking = asks.alias("a").join(salts.alias("b"), asked).select(*[F.col(f"a.`{c}`") for c in (*columns, "__target")], F.pmod("__whole", "__salts").cast("int").alias("__salt"), F.lit(True).alias("__asks"))
    at = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in keys] + [F.col(f"a.{SLICE}") == F.col("b.__target")]
    there = cut.alias("a").join(salts.alias("b"), at).select(*[F.col(f"a.`{c}`") for c in columns], F.col("b.__target").alias("__target"), F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"), F.lit(False).alias("__asks"))

    def later(table):
        asks_ = table.column("__asks")
        bars = table.filter(pc.invert(asks_)).sort_by([(c, "ascending") for c in order]).combine_chunks()
        mine = table.filter(asks_).combine_chunks()
        high_, low_ = _numbers(bars, high), _numbers(bars, low)
        take, stop = _numbers(mine, "__tp"), _numbers(mine, "__sl")
        tree = Extremes(high_, low_)
        found = tree.first(np.zeros(len(take), np.int64), take, stop)
        return mine.select([c for c in columns if c != SLICE]).append_column(name, _answers(tree, found, high_, low_, take, stop, tie))

    resolved = asking.unionByName(there).groupBy(*keys, "__target", "__salt").applyInArrow(later, ", ".join(f"`{c}` {t}" for c, t in cut.dtypes if c != SLICE) + f", `{name}` int")
    return own.where(~open_).drop(SLICE).unionByName(never).unionByName(resolved)


def first_hit_label(
    bars: DataFrame, *, entry: Column, take: Column, stop: Column, tie: int, horizon: int | None = None, slice_rows: int | None = None,
    high: str = "high", low: str = "low", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), name: str = "label",
) -> DataFrame:
    """Add ``name``: 1 if ``take`` is reached first in the bars after the row, 0 if ``stop`` is, NULL if neither or a level is missing.

    ``entry``, ``take`` and ``stop`` are prices; a bar that touches both gives
    ``tie``.  The order must tell the rows of a series apart.
    """
    levels = bars.withColumns({"__entry": entry}).withColumns({"__tp": take, "__sl": stop})
    levels = levels.withColumns({c: F.when(F.col("__entry").isNotNull(), F.col(c).cast("double")) for c in ("__tp", "__sl")})
    if horizon is None:
        return _unbounded(levels.drop("__entry"), keys, order, high, low, tie, name, slice_rows).drop("__tp", "__sl")
    up, down = F.col("__hit.h") >= F.col("__tp"), F.col("__hit.l") <= F.col("__sl")
    label = F.when(up & down, tie).when(up, 1).when(down, 0)
    return _search(levels, series(keys, order), high, low, horizon).withColumn(name, label).drop("__entry", "__tp", "__sl", "__hit")


def fixed_percent(bars: DataFrame, take: float, stop: float, *, column: str = "open", tie: int = 0, **options) -> DataFrame:
    """Barriers at fixed shares of the entry price."""
    e = F.col("__entry")
    return first_hit_label(bars, entry=F.col(column), take=e * (1 + take), stop=e * (1 - stop), tie=tie, **options)


def by_range(bars: DataFrame, atr: str, *, multiple: float = 1.5, reward: float = 2.0, tie: int = 1, **options) -> DataFrame:
    """Entry at the next open; the stop is a multiple of the average range away and the target ``reward`` times as far; NULL without a positive range."""
    w = series(options.get("keys", ("symbol",)), options.get("order", ("ts",)))
    distance = F.col(atr) * multiple
    entry = F.when(F.col(atr) > 0, F.lead("open").over(w))
    return first_hit_label(bars, entry=entry, take=F.col("__entry") + distance * reward, stop=F.col("__entry") - distance, tie=tie, **options)


def adaptive(bars: DataFrame, atr: str, *, least: float = 0.01, multiple: float = 1.5, reward: float = 2.0, tie: int = 0, **options) -> DataFrame:
    """Entry at the close; the stop is the larger of a share of it and a multiple of the average range; NULL if that exceeds the price."""
    distance = F.greatest(F.col("close") * least, F.col(atr) * multiple)
    entry = F.when((distance < F.col("close")) & F.col(atr).isNotNull(), F.col("close"))
    return first_hit_label(bars, entry=entry, take=F.col("close") + distance * reward, stop=F.col("close") - distance, tie=tie, **options)


def direction(bars: DataFrame, h: int, *, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """1 if the close ``h`` bars on is higher, else 0; NULL at the end."""
    ahead = F.lead("close", h).over(series(keys, order))
    return bars.withColumn("label", (ahead > F.col("close")).cast("int"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; Spark limits groups before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
