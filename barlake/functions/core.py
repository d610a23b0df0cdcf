"""Missing values, windows and moments.

NULL is the only missing value: NaN and infinities never leave an operator, a
division by zero is NULL, and flags of a missing comparison are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS, ORDER = ("symbol",), ("ts",)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    """Rows of one series in their full order."""
    return Window.partitionBy(*keys).orderBy(*order)


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def full(agg: Callable[[Column], Column], c: str | Column, n: int, w: WindowSpec) -> Column:
    """An aggregate of the last ``n`` rows, where all of them have a value."""
    c = col(c)
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def log_return(c: str | Column, w: WindowSpec) -> Column:
    c = col(c)
    before = F.lag(c).over(w)
    return F.when((c > 0) & (before > 0), F.ln(c / before))


def sample_skew(c: Column, n: Column | int, agg=lambda x: x) -> Column:
    """Bias-corrected skewness from the population value."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 2, agg(F.skewness(c)) * F.sqrt(n * (n - 1.0)) / (n - 2))


def sample_kurtosis(c: Column, n: Column | int, agg=lambda x: x) -> Column:
    """Bias-corrected excess kurtosis from the population value."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 3, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * agg(F.kurtosis(c)) + 6))


def rounded(df, digits: int = 6, skip: Sequence[str] = ()):
    """Doubles rounded, for results that are compared."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`") for n, t in df.dtypes])
