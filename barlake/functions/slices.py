"""Long series in parallel: slices of a series by its first order column, and what runs on from slice to slice.

A window over a whole series is one task's work.  A slice is a range of the
first order column of about ``SLICE_ROWS`` rows where rows are spread evenly;
rows with equal values lie in one slice, and nulls in front of all.  A number
per slice is carried over a table of slices, which has a row for each
``SLICE_ROWS`` rows, and the rows of a slice are worked on by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 18
#: Rows of a lookup table that may be broadcast.
BROADCAST_ROWS = 200_000
SLICE = "__slice"


def number_of(df: DataFrame, column: str) -> Column:
    """A number that grows with the column."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join with a table of one row per key (null keys are equal), broadcast only if it was counted to be small."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = table.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__key_{k}`")) for k in keys]
    side = F.broadcast(named) if small else named
    joined = df.join(side, same) if keys else df.crossJoin(side)  # without keys the table has one row
    return joined.drop(*[f"__key_{k}" for k in keys])


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add ``__slice``: 0, 1, ... along each series."""
    x = number_of(df, order[0])
    ends = df.groupBy(*keys).agg(F.min(x).alias("__a"), F.max(x).alias("__b"), F.ceil(F.count("*") / (rows or SLICE_ROWS)).alias("__n"))
    at = F.floor((x - F.col("__a")) / (F.col("__b") - F.col("__a")) * F.col("__n"))
    place = F.when(F.col("__b") > F.col("__a"), F.least(at, F.col("__n") - 1)).otherwise(0)
    return lookup(df, ends, keys).withColumn(SLICE, F.when(x.isNull(), -1).otherwise(F.coalesce(place, F.lit(0))).cast("long")).drop("__a", "__b", "__n")


def carried(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier slices of the series; ``df`` has slices."""
    per_slice = df.groupBy(*keys, SLICE).agg(F.sum(value).alias("__v"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    table = per_slice.select(*keys, SLICE, F.coalesce(F.sum("__v").over(before), F.lit(0)).alias(name))
    return lookup(df, table, [*keys, SLICE])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Add ``name``: the number of a row in its series, from 0."""
    placed = carried(sliced(df, keys, order, rows), keys, F.lit(1), "__before")
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return placed.withColumn(name, F.col("__before") + F.row_number().over(w) - 1).drop("__before", SLICE)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, rows: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the series before this one."""
    placed = carried(sliced(df, keys, order, rows), keys, value, "__before")
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("__before", SLICE)
