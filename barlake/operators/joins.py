"""Joins of time series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, *, right_on: str | None = None, keys: Sequence[str] = ("symbol",), suffix: str = "") -> DataFrame:
    """Each left row with the last right row at or before it; NULLs where there is none.

    Both sides are united and sorted once per series, and the right rows are
    carried forward as one struct, so a right row whose values are NULL isn't
    passed over.  One exchange, no growth with the distance of matches.
    """
    right_on = right_on or on
    payload = [c for c in right.columns if c not in keys]
    united = left.select(*keys, F.col(on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*payload)).dtypes[0][1]).alias("__r")).unionByName(
        right.select(*keys, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).dtypes[0][1]).alias("__l"), F.struct(*payload).alias("__r"))
    )
    before = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = united.withColumn("__r", F.last("__r", ignorenulls=True).over(before)).where("__side = 1")
    return carried.select("__l.*", *[F.col(f"__r.`{c}`").alias(c + suffix) for c in payload])


def suffixed(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
    """All columns but ``keep`` get a suffix, in one projection."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else c + suffix) for c in df.columns])


def prefix_to_suffix(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``s_x`` becomes ``x_db_s`` and so on."""
    def name(c: str) -> str:
        return next((c[len(p):] + s for p, s in prefixes.items() if c.startswith(p)), c)

    return df.select(*[F.col(f"`{c}`").alias(name(c)) for c in df.columns])


def consolidate(inputs: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of all inputs on ``keys``; an input's columns get its name as suffix.  Repeated keys multiply."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), [suffixed(df, f"_{n}", keys) for n, df in inputs.items()])


def concat_columns(inputs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables of one series side by side on their keys, all keys of any; columns keep their names, which must differ."""
    names = [c for df in inputs for c in df.columns if c not in keys]
    if len(set(names)) < len(names):
        raise ValueError("columns repeat")
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), inputs)


def select_matching(df: DataFrame, *, prefix: Sequence[str] = (), suffix: Sequence[str] = (), contains: Sequence[str] = ()) -> DataFrame:
    """Columns whose names match; repeated names once."""
    named = [c for c in dict.fromkeys(df.columns) if c.startswith(tuple(prefix) or ("\0",)) or c.endswith(tuple(suffix) or ("\0",)) or any(x in c for x in contains)]
    return df.select(*[F.col(f"`{c}`") for c in named])


# Columns that correlation analysis found redundant.
REDUNDANT = [
    "s_wick_vs_range", "m_wick_vs_range", "l_wick_vs_range", "s_bbands_middle_20", "m_bbands_middle_20", "l_bbands_middle_20",
    "s_sma_10", "m_sma_10", "l_sma_10", "s_sma_20", "m_sma_20", "l_sma_20", "s_volatility_log_returns_20", "m_volatility_log_returns_20", "l_volatility_log_returns_20",
    "s_roc_10", "m_roc_10", "l_roc_10", "volume_lag_2", "volume_lag_3", "s_price_change_pct", "m_price_change_pct", "l_price_change_pct",
    "s_macd", "m_macd", "l_macd", "s_macdsignal", "m_macdsignal", "l_macdsignal",
]


def prune(df: DataFrame, names: Sequence[str] = REDUNDANT) -> DataFrame:
    """Without the named columns; absent names are no error."""
    return df.drop(*names)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value; the schema then depends on the data."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])
