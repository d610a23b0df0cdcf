"""Near-duplicate vectors by product quantisation.

Equal vectors are one class.  Centres fitted on a bounded sample divide the
unit vectors into coarse inverted lists, and the residual to its centre is
stored as one code byte per subspace, along with the exact length of what the
code leaves out.  In a list a vector's asymmetric distance to a code comes from
table lookups; since the code's error is known, a pair is passed over only if
the triangle inequality rules it out, and all others are compared exactly in
double precision.

No link is lost by probing.  Two unit vectors x and y that link are at most
r = sqrt(2 - 2 least) apart.  If a and b are the centres nearest to each, then
x.(a - b) >= 0 >= y.(a - b), and the two differ by at most r |a - b|; so one of
them is within half of that of the plane between the lists.  A vector therefore
probes each list c with x.a - x.c <= r |a - c| / 2, and of every pair one end
probes the other's list.  Where only one does, the link counts for both there.

A block holds at most ``MEMBERS`` members of a list and a share of its
visitors, however large the list, and returns sums and a spanning forest of its
links, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, discard, stash
from .components import connected_components
from .vectors import common_size, kmeans, matrix, nearest, unit, usable

#: Classes that the centres and codes are fitted on, at most.
FIT_ROWS = 20_000
#: Lists for each square root of the number of vectors, and the most lists.
LISTS_PER_ROOT, LISTS = 0.5, 16_384
#: Fitting rows for each list; more than ``FIT_ROWS`` are read where there are so many lists.
ROWS_PER_LIST = 8
SUBSPACES, CODES = 16, 256
MEMBERS, VISITORS = 1024, 4096


class Quantiser:
    """Coarse centres (of length 1) and the code books of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        sample = unit(sample)
        self.centres = unit(kmeans(sample, lists, 8, rng) + 1e-12)
        residual = sample - self.centres[self.home(sample)]
        self.bounds = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        gaps = np.sqrt(np.maximum(2 - 2 * self.centres @ self.centres.T, 0))
        self.gaps = gaps.astype(np.float32)
        self.books = [kmeans(residual[:, a:b], CODES, 6, rng) for a, b in zip(self.bounds, self.bounds[1:])]

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, 1)

    def probed(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Each row's own list, and which lists it probes: all in which a vector within ``reach`` can be that doesn't probe this one's."""
        near = x @ self.centres.T
        home = near.argmax(1)
        return home, near.max(1, keepdims=True) - near <= reach / 2 * self.gaps[home] + 1e-5

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code bytes, and the length of what they leave out."""
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(zip(self.bounds, self.bounds[1:]), self.books)], 1)
        left = sum(((residual[:, a:b] - book[codes[:, m]]) ** 2).sum(1) for m, ((a, b), book) in enumerate(zip(zip(self.bounds, self.bounds[1:]), self.books)))
        return codes.astype(np.uint8), np.sqrt(left)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of residuals to coded residuals, by table lookups."""
        total = np.zeros((len(residual), len(codes)), np.float32)
        for m, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            book = self.books[m]
            part = residual[:, a:b]
            lookup = ((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T).astype(np.float32)
            total += lookup[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def forest(rows: np.ndarray, cols: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the bipartite links (``rows`` sorted) connect, at most one per node: (id, smaller id)."""
    a, b = row_ids.copy(), col_ids.copy()
    if len(rows):
        used, first = np.unique(rows, return_index=True)
        while True:
            before = a.copy(), b.copy()
            a[used] = np.minimum(a[used], np.minimum.reduceat(b[cols], first))
            np.minimum.at(b, cols, a[rows])
            if (a == before[0]).all() and (b == before[1]).all():
                break
    ids, to = np.concatenate([row_ids, col_ids]), np.concatenate([a, b])
    return ids[to < ids], to[to < ids]


def compare(q: Quantiser, at: int, visitors: np.ndarray, members: np.ndarray, codes: np.ndarray, errors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (visitor, member), sorted by visitor, whose cosine is at least ``least``."""
    reach = np.sqrt(2 - 2 * least) + 1e-5
    vu, mu = unit(visitors), unit(members)
    rows, cols = [], []
    for i in range(0, len(vu), 512):
        part = vu[i : i + 512]
        near = q.distances(part - q.centres[at], codes) <= (errors + reach)[None, :]
        r, c = np.nonzero(near)
        if len(r) > near.size // 20:
            keep = (part @ mu.T)[r, c] >= least
        else:
            keep = np.concatenate([np.einsum("ij,ij->i", part[r[j : j + 65536]], mu[c[j : j + 65536]]) >= least for j in range(0, len(r), 65536)] or [np.zeros(0, bool)])
        rows.append(r[keep] + i)
        cols.append(c[keep])
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95
) -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``n_links``, ``component_id``, ``kept``.

    Two rows link if the cosine of their vectors is at least ``least``.  Equal
    vectors always do.  Vectors that are null, zero, hold a null or non-finite
    component, or have another number of components than most, link with
    nothing and are their own component.  Null ids take no part in links
    either.  Rows that repeat an id are counted each.  An empty table stays
    empty.  Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fit = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    size = common_size(fit, "v")
    fit = fit.where(F.size("v") == size)
    classes = stash(fit.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    own = F.struct(F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not n:
        return rows.select("id", own["n_links"].alias("n_links"), own["component_id"].alias("component_id"), F.lit(True).alias("kept"))

    lists = max(1, min(LISTS, round(LISTS_PER_ROOT * n**0.5)))
    share = min(1.0, max(FIT_ROWS, ROWS_PER_LIST * lists) / n)
    chosen = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).orderBy("rep") if share < 1 else classes.orderBy("rep")
    sample = matrix(chosen.select("v").toArrow().column("v").combine_chunks(), size)
    q = spark.sparkContext.broadcast(Quantiser(sample if len(sample) else np.eye(size), lists))
    reach = float(np.sqrt(2 - 2 * least))

    def placed(batches):
        for b in batches:
            x = unit(matrix(b.column("v"), size))
            home, probed = q.value.probed(x, reach)
            at, lists = np.nonzero(probed)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(x)))]).astype(np.int32)
            codes, errors = q.value.codes(x - q.value.centres[home])
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("copies"), b.column("v"), pa.array(home, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(lists, pa.int32())),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.float64())],
                names=["rep", "copies", "v", "home", "probes", "code", "error"],
            )

    kind = classes.schema["v"].dataType.simpleString()
    indexed = stash(batched(classes.select("rep", "copies", "v")).mapInArrow(placed, f"rep long, copies long, v {kind}, home int, probes array<int>, code binary, error double"))
    members = indexed.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m_parts"))
    visits = indexed.select("rep", "copies", "home", "v", F.explode("probes").alias("list"))
    visitors = visits.groupBy("list").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("v_parts"))
    sizes = stash(members.join(visitors, "list"))
    parts = F.broadcast(sizes)  # at most LISTS rows
    spread = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = (
        indexed.withColumn("list", F.col("home")).join(parts, "list")
        .select("list", spread("m_parts", 1).alias("m"), whole("v_parts").alias("w"), "rep", "copies", "home", "v", "probes", "code", "error")
        .unionByName(
            visits.join(parts, "list").select("list", whole("m_parts").alias("m"), spread("v_parts", 2).alias("w"), "rep", "copies", "home", "v", F.lit(None).cast("array<int>").alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
        )
    )

    def block(key, table):
        at = key[0].as_py()
        table = table.combine_chunks()
        is_member = np.asarray(table.column("code").is_valid())
        ids, copies, home = (np.asarray(table.column(c)) for c in ("rep", "copies", "home"))
        x = matrix(table.column("v").combine_chunks(), size)
        inside = table.filter(pa.array(is_member))
        codes = np.frombuffer(b"".join(inside.column("code").to_pylist()), np.uint8).reshape(inside.num_rows, -1)
        mine, theirs = ids[is_member], ids[~is_member]
        r, c = compare(q.value, at, x[~is_member], x[is_member], codes, np.asarray(inside.column("error")), least)
        other = theirs[r] != mine[c]
        r, c = r[other], c[other]
        # a member that doesn't probe its visitor's list doesn't find this link there
        probes = inside.column("probes").combine_chunks()
        counts = np.diff(np.asarray(probes.offsets))
        lists = len(q.value.centres)
        visited = np.repeat(np.arange(len(mine)), counts) * lists + np.asarray(probes.flatten())  # sorted
        asks = c * lists + home[~is_member][r]
        back = visited[np.minimum(np.searchsorted(visited, asks), len(visited) - 1)] == asks if len(visited) else np.zeros(0, bool)
        for_visitor = np.bincount(r, copies[is_member][c], len(theirs)).astype(np.int64)
        for_member = np.bincount(c[~back], copies[~is_member][r[~back]], len(mine)).astype(np.int64)
        a, b = forest(r, c, theirs, mine)
        nodes, n_found = np.concatenate([theirs, mine]), np.concatenate([for_visitor, for_member])
        nodes, n_found = nodes[n_found > 0], n_found[n_found > 0]
        k = len(nodes)
        return pa.table({
            "a": pa.array(np.concatenate([nodes, a]), pa.int64()),
            "b": pa.array([None] * k + b.tolist(), pa.int64()),
            "n": pa.array(np.concatenate([n_found, np.zeros(len(a), np.int64)]), pa.int64()),
        })

    found = stash(blocks.groupBy("list", "m", "w").applyInArrow(block, "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    done = stash(
        classes.join(counts, "rep", "left").join(components, "rep", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    discard(indexed, sizes, found)
    takes_part = usable(F.col("v")) & F.col("id").isNotNull() & (F.size("v") == size)
    linked = rows.where(takes_part).join(done, "v").select("id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("id", own["n_links"].alias("n_links"), own["component_id"].alias("component_id"))
    return linked.unionByName(alone).select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
