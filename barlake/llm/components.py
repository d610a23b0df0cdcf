"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of ``links`` (``a``, ``b``: long): the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by doubling, and contracts the links to those ends; what is left
    shrinks by half at least.  No group is gathered: minima are aggregated, and
    the joins have one row per node on one side.  Links with a null end and
    links of a node with itself say nothing.  The result is a stashed table.
    """
    spark = links.sparkSession
    ends = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    edges = stash(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        hooks = stash(both.groupBy("node").agg(F.min("near").alias("to")).select("node", F.least("node", "to").alias("to"), F.lit(True).alias("__moved")))
        while True:
            further = hooks.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = stash(hooks.select("node", "to").join(further, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("__moved")))
            discard(hooks)
            hooks = jumped
            if hooks.where("__moved").isEmpty():
                break
        if labels is None:
            labels = stash(hooks.select("node", F.col("to").alias("component")))
        else:
            onward = hooks.select(F.col("node").alias("component"), "to")
            further = stash(labels.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            discard(labels)
            labels = further
        a_end = hooks.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b_end = hooks.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = stash(
            edges.join(a_end, "a").join(b_end, "b").where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
        discard(edges, hooks)
        edges = left
    discard(edges)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
