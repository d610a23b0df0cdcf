"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Within a source the documents are
range-sorted by that key: the key's leading digits name a range, and one window
per (source, range) sorts inside it.  A prefix sum over the ranges' token
counts plus the running sum inside a range gives each document the interval of
its source's tokens that it occupies.  A source takes its whole content as many
times as its budget allows and then the leading part of the sorted order, cut
at the exact token.

No window holds a whole source: a source with a third of all rows is spread
over its ranges like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stash, word_count

#: Ranges of the hash key per source: 16 ** HEX_DIGITS.
HEX_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets of the sources.

    ``sizes`` has ``__source`` and ``__total``, one row per source.  Sources
    sorted by code point (null last) take ``weights`` in turn and share the sum
    of all totals by weight; no target exceeds ``max_epochs`` times its source's
    total, and what is cut off goes to the others by weight.

    With sources in order of cap/weight, the level of those before a source
    being full is (all - their caps) / (weights from it on); the final level
    is the largest of these.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__n", F.row_number().over(by_name) - 1)
    weighed = ranked.select(
        "__source", "__total",
        F.element_at(listed, (F.col("__n") % len(weights) + 1).cast("int")).alias("__weight"),
        (F.col("__total") * max_epochs).alias("__cap"),
    )
    before = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("__total").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / (
        F.sum("__weight").over(whole) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    return (
        weighed.withColumn("__level", level)
        .withColumn("__level", F.max("__level").over(whole))
        .select(
            "__source", "__total",
            F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__weight")).alias("__target"),
        )
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """Add ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_taken`` to every row of ``docs``.

    ``mix_taken`` counts the tokens the mixture takes of the row: whole epochs
    times its size, and in the last epoch what lies before the cut.  A row's
    size is its number of words unless ``size`` is given.

    Null texts and empty texts have size 0 and give nothing.  Null sources form
    one source.  Null ids share one random key.  Rows equal in id and size are
    interchangeable.  An empty table stays empty.  Columns of these names in
    the input are replaced, and columns starting with ``__`` are reserved.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    sized = docs.withColumns({
        "mix_size": (word_count(F.col(text_col)) if size is None else size),
        "__source": F.col(source_col),
        "__key": key,
    }).withColumn("__range", F.conv(F.substring("__key", 1, HEX_DIGITS), 16, 10).cast("int"))

    ranges = stash(sized.groupBy("__source", "__range").agg(F.sum("mix_size").alias("__in_range")))
    totals = ranges.groupBy("__source").agg(F.sum("__in_range").alias("__total"))
    targets = source_targets(totals, weights, max_epochs)
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__in_range").over(earlier), F.lit(0)))
    budget = F.least(F.floor(F.col("t.__target") + 1e-6), F.col("t.__total") * max_epochs)
    plan = (
        starts.alias("s")
        .join(targets.alias("t"), F.col("s.__source").eqNullSafe(F.col("t.__source")))
        .select(
            F.col("s.__source").alias("__source_p"), F.col("s.__range").alias("__range_p"), "s.__start",
            "t.__total", "t.__target", budget.alias("__budget"),
        )
    )
    small = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = sized.join(
        F.broadcast(plan) if small else plan,
        F.col("__source").eqNullSafe(F.col("__source_p")) & (F.col("__range") == F.col("__range_p")),
    )
    inside = Window.partitionBy("__source", "__range").orderBy("__key", F.col(id_col), "mix_size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    end = F.col("__start") + F.sum("mix_size").over(inside)
    epochs = F.when(F.col("__total") > 0, F.expr("__budget div __total")).otherwise(F.lit(0))
    rest = F.col("__budget") - F.col("__epochs") * F.col("__total")
    part = F.greatest(F.lit(0), F.least(F.col("mix_size"), rest - (F.col("__end") - F.col("mix_size"))))
    return (
        placed.withColumns({"__end": end, "__epochs": epochs.cast("long")})
        .withColumns({
            "mix_source_size": F.col("__total"),
            "mix_target": F.col("__target"),
            "mix_taken": (F.col("__epochs") * F.col("mix_size") + part).cast("long"),
        })
        .drop("__source", "__key", "__range", "__source_p", "__range_p", "__start", "__total", "__target", "__budget", "__end", "__epochs")
    )


def mixed_rows(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each epoch that takes it.

    A row of which the last epoch takes a part keeps that many leading words.
    Rows that the mixture doesn't take go.
    """
    taken = mix(docs, text_col=text_col, **options).where(F.col("mix_taken") > 0)
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int"))))
    left = F.col("mix_taken") - (F.col("__copy") - 1) * F.col("mix_size")
    words = F.split(F.regexp_replace(F.col(text_col), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    text = F.when(left >= F.col("mix_size"), F.col(text_col)).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.greatest(left, F.lit(0)).cast("int")), " ")
    )
    return copies.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
