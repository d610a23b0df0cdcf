"""Sharding by histogram sort, with DataFrame operations only.

Rows are sorted by (hash of the text, hash of the id), so equal texts lie
together, and the sorted order is cut into shards of near equal bytes.  The
cuts are found without sorting: each round counts the exact bytes between
evenly spaced probes inside every bracket that still holds an open cut, and
replaces the bracket by the probe interval that holds the cut's target.  A cut
is settled once a probe lies within the tolerance of its target, so a group of
equal texts is only cut if it is larger than the tolerance, and then by the
second key.  Rows are exchanged once, when the cuts are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, stash

#: Rows of the histogram that a round may return to the driver.
PROBES = 8192
#: Keys are unsigned 63-bit numbers, so differences of two never overflow.
KEY_END = 1 << 63
#: Rows that one task numbers within a shard.
ROWS_PER_TASK = 200_000


def _key(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _histogram(keys: DataFrame, brackets: list[tuple[int, int]], probes: int, on: str) -> dict[tuple[int, int], list]:
    """Bytes, least and greatest key between the probes of each bracket [low, high); brackets don't overlap."""
    lows, widths, ends = [], [], []
    for low, high in brackets:
        lows.append(low)
        ends.append(high - 1)
        widths.append(max(1, -(-(high - low) // probes)))
    at = F.size(F.filter(_longs(lows), lambda x: x <= F.col(on)))
    rows = (
        keys.withColumn("__at", at)
        .where(F.col("__at") > 0)
        .withColumns({"__low": F.element_at(_longs(lows), F.col("__at")), "__width": F.element_at(_longs(widths), F.col("__at")), "__last": F.element_at(_longs(ends), F.col("__at"))})
        .where(F.col(on) <= F.col("__last"))
        .withColumn("__cell", F.expr(f"({on} - __low) div __width"))
        .groupBy("__at", "__cell")
        .agg(F.sum("__size").alias("bytes"), F.min(on).alias("least"), F.max(on).alias("most"))
        .collect()
    )
    found: dict[tuple[int, int], list] = {b: [] for b in brackets}
    for r in rows:
        found[brackets[r["__at"] - 1]].append((r["__cell"], r["bytes"], r["least"], r["most"]))
    return {b: sorted(cells) for b, cells in found.items()}


def _settle(keys: DataFrame, on: str, goals: dict[int, float], low: int, high: int, below: int, tolerance: float):
    """Cuts on one key: {goal: (cut, bytes below it)}, or (key, bytes below it, None) for a goal inside one key's rows.

    The cut is the least key of the upper side.  ``below`` are the bytes below ``low``.
    """
    open_ = {g: (low, high, below) for g in goals}
    cuts: dict[int, tuple[int, int]] = {}
    inside: dict[int, tuple[int, int]] = {}
    while open_:
        brackets = sorted({(a, b) for a, b, _ in open_.values()})
        cells = _histogram(keys, brackets, max(2, PROBES // len(brackets)), on)
        for g, (a, b, base) in list(open_.items()):
            del open_[g]
            edge, total, hit = a, base, None
            for _, size, least, most in cells[a, b]:
                if total + size > goals[g]:
                    hit = (least, most, total, size)
                    break
                total, edge = total + size, most + 1
            if hit is None:
                cuts[g] = (edge, total)
                continue
            least, most, start, size = hit
            options = [(abs(start - goals[g]), least, start), (abs(start + size - goals[g]), most + 1, start + size)]
            off, cut, at = min(options)
            if off <= tolerance:
                cuts[g] = (cut, at)
            elif least == most:
                inside[g] = (least, start)
            else:
                open_[g] = (least, most + 1, start)
    return cuts, inside


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The least (``__k``, ``__d``) of shards 1 to ``shards`` - 1.  ``tolerance`` is a share of a shard's mean bytes."""
    total = keys.agg(F.sum("__size")).first()[0] or 0
    goals = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    cuts, inside = _settle(keys, "__k", goals, 0, KEY_END, 0, slack)
    found = {g: (cut, 0) for g, (cut, _) in cuts.items()}
    for k in sorted({k for k, _ in inside.values()}):
        own = {g: goals[g] for g, (key, _) in inside.items() if key == k}
        start = next(s for key, s in inside.values() if key == k)
        rows = keys.where(F.col("__k") == F.lit(k).cast("long"))
        near, single = _settle(rows, "__d", own, 0, KEY_END, start, slack)
        for g in own:  # rows equal in both keys stay together
            found[g] = (k, near[g][0]) if g in near else (k, single[g][0])
    return [found[i] for i in range(1, shards)]


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = 0.002
) -> DataFrame:
    """Add ``shard_size``, ``shard`` and ``shard_slot`` to every row of ``docs`` and place the rows by shard.

    Sizes are UTF-8 bytes of the text plus ``overhead``; a null text has none.
    Shards differ from the mean by little more than ``tolerance`` of it, or by
    half of the largest row where that is more.  Equal texts share a shard
    unless their group is larger than the tolerance.  Slots are gapless from 0
    in every shard.  Null ids are one id.  Rows equal in text and id can't be
    told apart and always share a shard.  An empty table stays empty; with
    fewer rows than shards some shards stay empty.  Columns of these names in
    the input are replaced, and columns starting with ``__`` are reserved.
    """
    text = F.col(text_col)
    keyed = docs.withColumns({
        "shard_size": (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long"),
        "__k": _key(text),
        "__d": _key(F.col(id_col)),
    })
    keys = stash(keyed.select("__k", "__d", F.col("shard_size").alias("__size")))
    n = keys.count()
    cuts = splitters(keys, shards, tolerance) if n else []
    if not cuts:
        shard = F.lit(0)
    else:
        edges = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(d).cast("long").alias("d")) for k, d in cuts])
        shard = F.size(F.filter(edges, lambda e: e <= F.struct(F.col("__k").alias("k"), F.col("__d").alias("d"))))
    tasks = max(1, -(-n // (shards * ROWS_PER_TASK)))
    part = F.pmod(F.col("__d"), F.lit(tasks)).cast("int")
    order = Window.partitionBy("shard", "__part").orderBy("__k", "__d", F.col(id_col))
    placed = keyed.withColumns({"shard": shard, "__part": part})
    numbered = placed.withColumn("__row", F.row_number().over(order) - 1)
    if tasks > 1:
        sizes = keys.select(shard.alias("shard"), part.alias("__part")).groupBy("shard", "__part").count()
        earlier = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("shard", "__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__first"))
        numbered = lookup_join(numbered, starts, ["shard", "__part"])
    else:
        numbered = numbered.withColumn("__first", F.lit(0))
    return numbered.withColumn("shard_slot", (F.col("__row") + F.col("__first")).cast("long")).drop("__k", "__d", "__part", "__row", "__first")
