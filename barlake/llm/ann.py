"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns the unit vectors twice by fast pseudo-rotations (random signs
and a Hadamard transform, three times) and takes the nearest signed axis each
time; a bucket is such a pair of axes.  A query probes every bucket whose two
coordinates of the query add up to ``reach`` at least, so the nearest buckets.

How many tables there are and how far a probe reaches is measured, whatever the
size, the dimensions and the shape of the data: the true neighbours of a
bounded sample of queries are found by one exact scan, and of each number of
tables the reach that finds ``RECALL`` of them is priced in comparisons and
copies.  The cheapest is taken.  One table whose every bucket is probed is
an exact search, so vectors that hashing can't tell apart cost a scan, not
their neighbours.

Queries that find fewer rows than they are owed are compared with all rows.

A block holds a range of buckets of a table, at most ``MEMBERS`` candidates and
``QUERIES`` queries, however large a bucket, and returns the best of its own.
Distances are Euclidean, exact, on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, discard, stash
from .vectors import common_size, matrix, packed, unit, usable

#: Queries whose true neighbours are found for the measurement, and candidates on which bucket sizes are estimated.
SAMPLE, SIZE_SAMPLE = 96, 4096
#: Share of the sample's true neighbours that must be found.
RECALL = 0.95
#: Numbers of tables to choose from, so copies of a vector whatever the size, and what a copy costs in comparisons.
TABLES, COPY = (1, 8), 1
MEMBERS, QUERIES = 4096, 1024
#: Rows of a batch that leaves the hashing.
OUT_ROWS = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of unit vectors, padded to a power of two."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def coordinates(x: np.ndarray, table: int, second: bool) -> np.ndarray:
    """Coordinates along the signed axes of one of a table's two rotations; the largest is the nearest axis."""
    x = rotated(x, 2 * table + second)
    return np.concatenate([x, -x], 1)


def closeness(queries: np.ndarray, others: np.ndarray, table: int) -> np.ndarray:
    """For each query and each other vector: how near the other's bucket is to the query, as the sum of the query's two coordinates."""
    a, b = (coordinates(queries, table, s) for s in (False, True))
    return a[:, coordinates(others, table, False).argmax(1)] + b[:, coordinates(others, table, True).argmax(1)]


def best_of(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of ``x`` for each query, ties to smaller ids: (query row, id, distance).

    ``allowed`` gives for a range of queries which of ``x`` to compare.
    """
    rows, found, far = [], [], []
    squares = (x * x).sum(1)
    for i in range(0, len(queries), 256):
        part = queries[i : i + 256]
        rough = squares - 2 * part @ x.T + (part * part).sum(1)[:, None]
        if allowed is not None:
            rough[~allowed(slice(i, i + len(part)))] = np.inf
        if len(x) > k:
            # rounding can swap neighbours in the rough values: all within it of the k-th are compared exactly
            kth = np.partition(rough, k - 1, 1)[:, k - 1]
            slack = 1e-9 * (np.abs(np.where(np.isinf(kth), 0, kth)) + (part * part).sum(1) + squares.max())
            r, c = np.nonzero((rough <= (kth + slack)[:, None]) & (rough < np.inf))
        else:
            r, c = np.nonzero(rough < np.inf)
        d = np.sqrt(((part[r] - x[c]) ** 2).sum(1))
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        rows.append(r[keep] + i)
        found.append(ids[c[keep]])
        far.append(d[keep])
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(found or [np.zeros(0, int)]), np.concatenate(far or [np.zeros(0)])


def chosen(queries: np.ndarray, neighbours: list[np.ndarray], others: np.ndarray, n: int, asked: int) -> tuple[int, float, float]:
    """Number of tables, reach of a probe and comparisons per query to be expected.

    ``neighbours`` are the true neighbours of each of the sample's ``queries``,
    ``others`` a sample of the ``n`` candidates, ``asked`` the number of queries.
    """
    queries = unit(queries)
    owner = np.repeat(np.arange(len(queries)), [len(x) for x in neighbours])
    if not len(owner):
        return 1, -np.inf, float(n)
    near = unit(np.concatenate(neighbours))
    others = unit(others)
    found = np.full(len(owner), -np.inf)
    spread: list[np.ndarray] = []
    best = None
    for t in range(max(TABLES)):
        found = np.maximum(found, closeness(queries, near, t)[owner, np.arange(len(owner))])
        spread.append(np.sort(closeness(queries, others, t).reshape(-1)))
        if t + 1 in TABLES:
            reach = float(np.quantile(found, 1 - RECALL, method="lower")) - 1e-9
            compared = n * sum(1 - np.searchsorted(x, reach) / len(x) for x in spread)
            cost = compared + COPY * (t + 1) * n / max(1, asked)
            if best is None or cost < best[0]:
                best = cost, t + 1, reach, compared
    return best[1:]


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (``t``, ``bucket``, ``id``, ``v``, ``axis``, ``asks``) by block: every query of a bucket meets every candidate of it once."""
    sizes = placed.groupBy("t", "bucket").agg(
        F.ceil(F.count_if(~F.col("asks")) / MEMBERS).cast("int").alias("m_parts"), F.ceil(F.count_if("asks") / QUERIES).cast("int").alias("q_parts")
    ).where("m_parts > 0 AND q_parts > 0")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    own = F.when(F.col("asks"), F.col("q_parts")).otherwise(F.col("m_parts"))
    others = F.when(F.col("asks"), F.col("m_parts")).otherwise(F.col("q_parts"))
    return (
        placed.join(sizes, ["t", "bucket"])
        .withColumns({"own": own, "others": others})
        .withColumns({"mine": spread("own", 3), "other": F.explode(F.sequence(F.lit(0), F.col("others") - 1))})
        .select("t", "bucket", F.when(F.col("asks"), F.col("other")).otherwise(F.col("mine")).alias("m"), F.when(F.col("asks"), F.col("mine")).otherwise(F.col("other")).alias("w"), "id", "v", "axis", "asks")
    )


def neighbours(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """The ``k`` nearest rows found for each row for which ``is_query`` (a column) holds: ``query_id``, ``rank``, ``id``, ``score``.

    Vectors that are null, zero, hold null or non-finite components, or have
    another number of components than most take no part, and neither do null
    ids.  Equal vectors are searched once; of a group of equal candidates the
    ``k`` + 1 smallest ids can be among the nearest.  With fewer candidates all
    are returned.  A query isn't its own neighbour; rows that repeat an id with
    an equal vector are one candidate.  An empty table, or one without queries,
    gives no rows.  Ties go to smaller ids.  Other columns are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    size = common_size(rows, "v")
    rows = rows.where(F.size("v") == size)
    spark = rows.sparkSession
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    first = Window.partitionBy("v").orderBy("id")
    candidates = stash(
        rows.select("id", "v").distinct().withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).select("id", "v", F.lit(False).alias("asks"))
    )
    asked = rows.where("asks").select("id", "v").distinct()
    reps = stash(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v", F.lit(True).alias("asks")))
    n, n_asked = candidates.count(), reps.count()
    tables, reach, groups = _plan(candidates, reps, n, n_asked, size, k)
    axes = 2 << max(0, int(size - 1).bit_length())

    def hashed(batches):
        for b in batches:
            x = unit(matrix(b.column("v"), size))
            asks = np.asarray(b.column("asks").to_numpy(zero_copy_only=False), bool)
            queries, others = np.flatnonzero(asks), np.flatnonzero(~asks)
            for t in range(tables):
                parts = []
                if len(others):
                    axis = coordinates(x[others], t, True).argmax(1)
                    parts.append((others, coordinates(x[others], t, False).argmax(1) * groups + axis * groups // axes, axis))
                for i in range(0, len(queries), 256):
                    some = queries[i : i + 256]
                    # a group of buckets is visited if its nearest bucket is within reach
                    best = coordinates(x[some], t, True).reshape(len(some), groups, -1).max(2)
                    at, bucket = np.nonzero((coordinates(x[some], t, False)[:, :, None] + best[:, None, :] >= reach).reshape(len(some), -1))
                    parts.append((some[at], bucket, np.full(len(at), -1)))
                for at, bucket, axis in parts:
                    for i in range(0, len(at), OUT_ROWS):
                        take = pa.array(at[i : i + OUT_ROWS])
                        yield pa.RecordBatch.from_arrays(
                            [*[b.column(c).take(take) for c in ("id", "v", "asks")], pa.array(np.full(len(take), t), pa.int32()), pa.array(bucket[i : i + OUT_ROWS], pa.int64()), pa.array(axis[i : i + OUT_ROWS], pa.int32())],
                            names=["id", "v", "asks", "t", "bucket", "axis"],
                        )

    def block(key, table):
        t, first_axis = key[0].as_py(), key[1].as_py() // groups
        table = table.combine_chunks()
        asks = np.asarray(table.column("asks").to_numpy(), bool)
        ids, x = np.asarray(table.column("id")), matrix(table.column("v").combine_chunks(), size)
        allowed = None
        if t >= 0:
            axis, turned = np.asarray(table.column("axis"))[~asks], unit(x[asks])
            ours, second = coordinates(turned, t, False)[:, first_axis], coordinates(turned, t, True)
            allowed = lambda part: ours[part, None] + second[part][:, axis] >= reach
        r, found, far = best_of(x[asks], ids[~asks], x[~asks], k + 1, allowed)
        return pa.table({"q": pa.array(ids[asks][r], pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(far, pa.float64())})

    def searched(placed):
        best = _blocks(placed).groupBy("t", "bucket", "m", "w").applyInArrow(block, "q long, id long, score double").groupBy("q", "id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("q").orderBy("score", "id")
        return best.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1).drop("__n")

    kind = candidates.schema["v"].dataType.simpleString()
    everything = candidates.unionByName(reps)
    placed = batched(everything).mapInArrow(hashed, f"id long, v {kind}, asks boolean, t int, bucket long, axis int")  # hashed twice, for the sizes and for the blocks: writing it down would take more
    top = stash(searched(placed))
    counted = top.groupBy(F.col("q").alias("id")).agg(F.count("*").alias("__n"))
    short = stash(reps.join(counted, "id", "left").where(F.coalesce("__n", F.lit(0)) < min(k + 1, n)).select("id", "v", "asks"))
    if not short.isEmpty():
        # in blocks against all rows
        whole = short.unionByName(candidates).withColumns({"t": F.lit(-1), "bucket": F.lit(0).cast("long"), "axis": F.lit(-1)})
        first_top = top
        top = stash(first_top.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(searched(whole)))
        discard(first_top)
    discard(candidates, short)
    answers = asked.withColumnRenamed("id", "query_id").join(reps.select("v", F.col("id").alias("q")), "v").drop("v").join(top, "q").where("id != query_id")
    ranked = Window.partitionBy("query_id").orderBy("score", "id")
    return answers.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _sample(df: DataFrame, n: int, limit: int, salt: int) -> DataFrame:
    """About ``limit`` rows by a hash of the id, all if there are no more."""
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(limit / n * (1 << 30)))


def _plan(candidates: DataFrame, reps: DataFrame, n: int, n_asked: int, size: int, k: int) -> tuple[int, float, int]:
    """Tables, reach, and into how many groups the second axis is divided, so that a group of buckets has about ``MEMBERS`` candidates."""
    got = _sample(reps, n_asked, SAMPLE, 5).select("id", "v").toArrow()
    ids, x = np.asarray(got.column("id"), np.int64), matrix(got.column("v").combine_chunks(), size)

    def scan(batches):
        for b in batches:
            own, y = np.asarray(b.column("id"), np.int64), matrix(b.column("v"), size)
            r, found, far = best_of(x, own, y, k + 1)
            at = {i: p for p, i in enumerate(own.tolist())}
            yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(found, pa.int64()), pa.array(far, pa.float64()), packed(y[[at[i] for i in found.tolist()]])], names=["q", "id", "score", "v"])

    order = Window.partitionBy("q").orderBy("score", "id")
    nearest = batched(candidates.select("id", "v")).mapInArrow(scan, "q long, id long, score double, v array<double>").where("q != id")
    nearest = nearest.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).toArrow()  # SAMPLE * k rows
    owner, y = np.asarray(nearest.column("q"), np.int64), matrix(nearest.column("v").combine_chunks(), size) if nearest.num_rows else np.zeros((0, size))
    others = _sample(candidates, n, SIZE_SAMPLE, 6).select("v").toArrow()
    z = matrix(others.column("v").combine_chunks(), size) if others.num_rows else x
    tables, reach, _ = chosen(x, [y[owner == i] for i in ids.tolist()], z, n, n_asked) if len(ids) else (1, -np.inf, 0.0)
    axes, groups = 2 << max(0, int(size - 1).bit_length()), 1
    while groups < axes and n > MEMBERS * axes * groups:
        groups *= 2
    return tables, reach, groups
