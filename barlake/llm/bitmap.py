"""Bitmaps of fixed size that say which keys a table may hold.

A bitmap lets a scan drop rows before a shuffle that an exact join behind it
would drop anyway.  It never drops a row that it shouldn't; with many keys it
drops fewer.  Its size doesn't grow with the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB.
BITS = 1 << 26
_ROW = 32768


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap_rows(keys: DataFrame, key: str) -> DataFrame:
    """At most BITS / 32768 rows: ``__row`` and its 4 KB of ``__bits``."""
    slot = _slot(F.col(key))
    return keys.select((slot / _ROW).cast("int").alias("__row"), (slot % _ROW).alias("__at")).groupBy("__row").agg(F.expr("bitmap_construct_agg(__at)").alias("__bits"))


def maybe_in(df: DataFrame, key: str, rows: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose key the bitmap has; with ``inside=False`` those whose key it lacks, and null keys."""
    slot = _slot(F.col(key))
    marked = df.withColumns({"__row": (slot / _ROW).cast("int"), "__at": (slot % _ROW).cast("int")}).join(F.broadcast(rows), "__row", "left")  # 8 MB at most
    byte = F.conv(F.hex(F.expr("substring(__bits, __at div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.col("__bits").isNotNull() & (F.expr("shiftright(__byte, __at % 8)").bitwiseAND(F.lit(1)) == 1) & F.col(key).isNotNull(), F.lit(False))
    return marked.withColumn("__byte", byte).where(hit if inside else ~hit).select(*[F.col(f"`{c}`") for c in df.columns])


def bitmap_array(values: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes for use in Python: ``BITS`` / 8 bytes, sent to the driver in rows of 4 KB."""
    slot = F.pmod(F.col(column), F.lit(BITS))
    rows = values.select((slot / _ROW).cast("int").alias("__row"), (slot % _ROW).alias("__at")).groupBy("__row").agg(F.expr("bitmap_construct_agg(__at)").alias("__bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():  # 2048 at most
        out[r["__row"] * _ROW // 8 : (r["__row"] + 1) * _ROW // 8] = np.frombuffer(r["__bits"], np.uint8)
    return out


def in_array(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) hashes the bitmap has."""
    slot = (values & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
