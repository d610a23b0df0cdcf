"""N-gram Jaccard join with a count-vector R-tree.

A text is its set of distinct word shingles.  Equal sets are one class.  The
hashes of a set fall into ``GROUPS`` groups, and the counts per group are a
point; the overlap of two sets is at most the sum of their points' coordinate
minima.  Points are packed into R-trees, whose nodes carry the greatest and
least coordinates of what lies below, so the same sum bounds whole nodes.  What
the bound leaves over is verified on the texts.

One tree over all points would send every search through most of a cluster:
with dozens of coordinates the boxes of unrelated texts overlap.  The trees'
roots are therefore shingles.  Sets with a Jaccard similarity of t share one of
their first n - ceil(t n) + 1 shingles in any fixed order (the order here: rare
before frequent), and each such shingle that several classes have is the root
of a tree.  Three rounds keep large groups of copies linear: the first verifies
each class against the most typical class of its trees, which joins nearly all
of a group; the second searches for the nearest point of another component, one
for each point; the third for all pairs that are still in different components.
No pair within the threshold is passed over.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap_rows, maybe_in
from .common import BROADCAST_ROWS, batched, discard, stash
from .components import connected_components
from .shingles import joined, shingle_sets, slices

GROUPS, MOST_GROUPS = 256, 4096
SHINGLE = 5
#: Jaccard similarity as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Buckets in which shingles are counted for the order, and how many of the fullest move to its end.
COUNTERS, HEAVY = 1 << 22, 1 << 18
#: Points of a tree that one task searches, and of a leaf.
TILE, LEAF = 2048, 16
#: Trees by which a point says which of its trees returns a pair.
LOWEST = 8
#: Texts that a task compares among themselves.
FAMILY = 500


def class_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    low = xxhash.xxh3_128_intdigest(s.tobytes())
    signed = np.array([low & (1 << 64) - 1, low >> 64], np.uint64).astype(np.int64)
    return int(signed[0]), int(signed[1])


#: A count that a byte can't hold: it bounds nothing.
UNKNOWN = 255


def groups_of(n: int) -> int:
    """Groups of a point: more for larger sets, in powers of four, so that chance overlaps stay few in each."""
    g = GROUPS
    while g * 4 <= MOST_GROUPS and n > 2 * g:
        g *= 4
    return g


def point(s: np.ndarray, g: int = GROUPS) -> np.ndarray:
    """Counts per group, a byte each."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % g, minlength=g), UNKNOWN).astype(np.uint8)


def folded(x: bytes, groups: int) -> np.ndarray:
    """A point with its groups added up to ``groups``: the hashes are taken modulo powers of two."""
    v = np.frombuffer(x, np.uint8).astype(np.int32)
    v[v == UNKNOWN] = 1 << 22
    return v if len(v) == groups else v.reshape(-1, groups).sum(0, dtype=np.int32)


def points_of(column: pa.Array) -> np.ndarray:
    """Points of ``GROUPS`` groups as rows of numbers."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    x[x == UNKNOWN] = 1 << 22
    return x


def prefix(s: np.ndarray, weight: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of which two similar sets share one: the first in the order (weight of the bucket, hash)."""
    keep = len(s) - -(-num * len(s) // den) + 1
    w = weight[(s % np.uint64(COUNTERS)).astype(np.int64)]
    return s[np.lexsort((s, w))[:keep]] if w.any() else s[:keep]


def _similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether ``common`` shared shingles of sets of ``a`` and ``b`` are enough."""
    return den * common >= num * (a + b - common)


class RTree:
    """Points packed by size: leaves of ``LEAF`` points under boxes.  The boxes of a small tree are its root's children."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.lexsort((points.argmax(1), sizes))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(sizes), LEAF)]
        self.high = np.array([points[x].max(0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.most = np.array([sizes[x].max() for x in self.leaves])

    def search(self, i: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that the bound can't tell from similar ones to point ``i``, and the most that each can share with it."""
        q, n = self.points[i], self.sizes[i]
        fits = (den * np.minimum(n, self.most) >= num * n) & (den * n >= num * self.least)
        fits &= _similar(np.minimum(np.minimum(q, self.high).sum(1), n), n, self.least, num, den)
        found = [self.leaves[k] for k in np.flatnonzero(fits)]
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        near = np.concatenate(found)
        most = np.minimum(np.minimum(q, self.points[near]).sum(1), np.minimum(n, self.sizes[near]))
        fits = _similar(most, n, self.sizes[near], num, den)
        return near[fits], most[fits]


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document: id, number of shingles, class key, point; and per task the full buckets of the shingle counters."""

    def run(batches):
        counter = np.zeros(COUNTERS, np.int32)
        for whole in batches:
            for b in slices(whole):
                sets = shingle_sets(b.column("text"), shingle)
                at, times = np.unique((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), return_counts=True)
                counter[at] += times.astype(np.int32)
                low, high = zip(*map(class_key, sets), strict=True)
                empty = pa.nulls(len(sets), pa.int64())
                n, points = [len(s) for s in sets], [point(s).tobytes() for s in sets]
                fine = [point(s, groups_of(len(s))).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), empty, empty], names=names)
        mean = counter.mean()
        full = np.flatnonzero(counter > mean + 4 * math.sqrt(mean) + 2)
        empty = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(len(full), pa.binary()), pa.nulls(len(full), pa.binary()), pa.array(full, pa.int64()), pa.array(counter[full], pa.int64())], names=names)

    names = ["id", "n", "low", "high", "point", "fine", "bucket", "count"]
    return stash(batched(docs).mapInArrow(run, "id long, n long, low long, high long, point binary, fine binary, bucket long, count long"))


def _possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (with sizes ``na``, ``nb`` and points ``pa``, ``pb``) that the sum of coordinate minima doesn't rule out."""

    def run(batches):
        for b in batches:
            most = []
            for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True):
                g = min(len(x), len(y))
                most.append(int(np.minimum(folded(x, g), folded(y, g)).sum()))
            na, nb = (np.asarray(b.column(c)) for c in ("na", "nb"))
            shared = np.minimum(np.array(most, np.int64), np.minimum(na, nb))
            yield b.select(["a", "b", "ka", "kb"]).filter(pa.array(_similar(shared, na, nb, num, den), pa.bool_()))

    return pairs.select("a", "b", "ka", "kb", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long, ka long, kb long")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links among ``pairs`` (``a``, ``b``: ids, ``ka``, ``kb``: class keys) that connect what all their links connect.

    Only texts of ids that occur in ``pairs`` are sent: a bitmap drops nearly all
    others where they are read.  Texts that pairs connect form a family, whose
    texts go together once, not once for each pair; a family of more than
    ``FAMILY`` texts goes in tiles, and small ones share a task.
    """
    families = connected_components(pairs)
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    bins = max(1, -(-families.count() // FAMILY))
    small = -1 - F.pmod(F.xxhash64("component"), F.lit(bins))
    member = stash(families.join(sizes, "component").select(
        F.col("node").alias("id"), F.when(F.col("size") > FAMILY // 4, F.col("component")).otherwise(small).alias("family"),
        F.when(F.col("size") > FAMILY, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / FAMILY))).otherwise(0).cast("int").alias("tile"),
    ))
    placed = stash(
        pairs.join(member.select(F.col("id").alias("a"), "family", F.col("tile").alias("x")), "a").join(member.select(F.col("id").alias("b"), F.col("tile").alias("y")), "b")
        .select("family", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b", "ka", "kb")
    )
    block = ["family", "i", "j"]
    wanted = stash(placed.select(*block, F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ka").alias("key")), F.struct(F.col("b").alias("id"), F.col("kb").alias("key")))).alias("x")).select(*block, "x.*").distinct())
    texts = maybe_in(docs, "id", bitmap_rows(families, "node"))
    none = F.lit(None).cast("long")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed_texts = texts.join(F.broadcast(wanted), "id") if few else wanted.join(texts, "id")
    rows = placed_texts.select(*block, F.col("id").alias("a"), none.alias("b"), F.col("key").alias("ka"), none.alias("kb"), "text").unionByName(placed.select(*block, "a", "b", "ka", "kb", F.lit(None).cast("string").alias("text")))

    def compare(table):
        is_pair = table.column("b").is_valid().combine_chunks()
        there = table.filter(pc.invert(is_pair)).combine_chunks()
        sets: dict[int, np.ndarray] = {}
        if there.num_rows:
            for part in slices(there.to_batches()[0]):
                for key, found in zip(part.column("ka").to_pylist(), shingle_sets(part.column("text"), shingle), strict=True):
                    if class_key(found)[0] == key:  # an id may have several texts: only that of the class counts
                        sets[key] = found
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for a, b, ka, kb in zip(*[table.filter(is_pair).column(c).to_pylist() for c in ("a", "b", "ka", "kb")], strict=True):
            x, y = sets.get(ka), sets.get(kb)
            if x is not None and y is not None and find(a) != find(b):  # what is connected already needs no further link
                common = len(np.intersect1d(x, y, assume_unique=True))
                if _similar(np.int64(common), len(x), len(y), num, den):
                    root[find(a)] = find(b)
                    out.append((a, b))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = stash(rows.groupBy(*block).applyInArrow(compare, "a long, b long"))
    discard(families, member, placed, wanted)
    return links


def _tree_pairs(trees: DataFrame, named: DataFrame, parts: DataFrame, every: bool, num: int, den: int) -> DataFrame:
    """Pairs of one tree (``trees``: token, key, head), of different parts, that the bound leaves over: the best of each point, or ``every`` one.

    All pairs with a tree's head were tried.  Small trees share a task, and a
    large one is searched in tiles.
    """
    part_of = named.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", "point", F.coalesce("component", "rep").alias("part"))
    placed = trees.join(part_of.select("key", "part"), "key")
    spans = placed.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("size"))
    chosen = stash(trees.join(spans.where("least < most").select("token", "size"), "token"))
    lowest = chosen.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LOWEST).alias("lowest"))
    bins = max(1, -(-chosen.count() // TILE))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    spread = (
        chosen.join(part_of, "key").join(lowest, "key")
        .withColumns({"tiles": tiles, "large": F.col("size") > TILE // 8})
        .withColumns({"tile": tile, "other": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "bin": F.when(F.col("large"), F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(bins)))})
        .select("large", "bin", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "token", "key", "rep", "n", "point", "part", "lowest", (F.col("key") == F.col("head")).alias("is_head"))
    )

    def search(table):
        table = table.sort_by("token").combine_chunks()
        tokens, n, part, rep, key = (np.asarray(table.column(c)) for c in ("token", "n", "part", "rep", "key"))
        is_head = np.asarray(table.column("is_head").to_numpy(), bool)
        points = points_of(table.column("point"))
        lists = table.column("lowest").to_pylist()
        out = set()
        ends = np.flatnonzero(np.diff(tokens, append=tokens[-1:] + 1)) + 1 if len(tokens) else []
        start = 0
        for end in np.asarray(ends).tolist():
            at, token, start = slice(start, end), int(tokens[start]), end
            own, names = part[at], {}
            for x in own.tolist():
                names[x] = names.get(x, 0) + 1
            if len(names) < 2:
                continue
            # of a pair of different parts, one is outside of the tree's main part
            asking = np.flatnonzero(~is_head[at] & (own != max(names, key=names.get)))
            tree = RTree(n[at], points[at])
            first = at.start
            for i in asking.tolist():
                near, most = tree.search(i, num, den)
                other = (own[near] != own[i]) & ~is_head[at][near]
                near, most = near[other], most[other]
                if not len(near):
                    continue
                if not every:
                    near = near[[int(np.argmax(most / (n[at][i] + n[at][near] - most)))]]
                low = set(lists[first + i])
                for k in near.tolist():
                    # a pair is found in each tree that both are in: the lowest of them returns it, if known
                    common = low.intersection(lists[first + k])
                    if every and common and min(common) != token:
                        continue
                    a, b = (first + i, first + k) if rep[first + i] > rep[first + k] else (first + k, first + i)
                    out.add((int(rep[a]), int(rep[b]), int(key[a]), int(key[b])))
        columns = zip(*sorted(out), strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "ka", "kb"])

    found = stash(spread.groupBy("large", "bin", "i", "j").applyInArrow(search, "a long, b long, ka long, kb long").distinct())
    discard(chosen)
    return found


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = (NUMERATOR, DENOMINATOR)
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``component_id``.

    Two documents link if the Jaccard similarity of their shingle sets is at
    least ``similarity`` (a fraction).  A component is named by the smallest id
    that its links reach.  Texts with fewer words than a shingle are one
    shingle; null texts and texts without words have none and link with
    nothing.  Null ids link with nothing and have no component.  Rows that
    repeat an id are documents of that name each.  An empty table stays empty.
    Other columns are left out.  Shingles are told apart by 64-bit hashes.
    """
    num, den = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    everything = _profiles(texts, shingle)
    profiles = everything.where("n IS NOT NULL").drop("bucket", "count")
    full = everything.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count"))
    heavy = np.zeros(COUNTERS, np.int32)
    for r in full.orderBy(F.desc("count"), "bucket").limit(HEAVY).collect():
        heavy[r["bucket"]] = r["count"]
    weight = docs.sparkSession.sparkContext.broadcast(heavy)  # 16 MB
    classes = stash(
        profiles.where("n > 0 AND id IS NOT NULL").groupBy("low", "high").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("fine").alias("fine"))
    )

    def roots(batches):
        for whole in batches:
            for b in slices(whole):
                sets = [s for s in shingle_sets(b.column("text"), shingle) if len(s)]
                own = [prefix(s, weight.value, num, den) for s in sets]
                keys = [np.full(len(o), class_key(s)[0], np.int64) for o, s in zip(own, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([joined(own), joined(keys)], names=["token", "key"])

    # the smallest and the largest class of a root: equal where a single class has it
    rooted = texts.where("id IS NOT NULL").mapInArrow(roots, "token long, key long")
    spans = rooted.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    shared = stash(spans.select("token"))
    several = bitmap_rows(shared, "token")
    postings = stash(maybe_in(rooted, "token", several).distinct().join(shared, "token"))
    named = classes.select(F.col("low").alias("key"), "rep", "n", "point", "fine")

    # roots of two classes are pairs; of trees with the same points one is enough
    sets = stash(postings.groupBy("token").agg(F.count("*").alias("size"), F.min("key").alias("key"), F.max("key").alias("head"), F.bit_xor(F.xxhash64("key")).alias("points")))
    single = sets.where("size > 2").groupBy("points", "size").agg(F.min("token").alias("token")).select("token", F.col("size").alias("points"))
    planted = stash(postings.select("token", "key").join(single, "token"))
    # the class whose trees are the largest is nearest to the text that the others were made from
    typical = planted.groupBy("key").agg(F.avg("points").alias("shared"))
    heads = planted.join(typical, "key").groupBy("token").agg(F.max(F.struct("shared", "key"))["key"].alias("head"))
    trees = stash(planted.select("token", "key").join(heads, "token"))
    stars = trees.where("key != head").select("key", "head").union(sets.where("size = 2").select("key", "head")).distinct()
    a = named.select(F.col("key").alias("ka"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("fine").alias("pa"))
    b = named.select(F.col("key").alias("kb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("pb"))
    in_reach = (F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    star_pairs = stash(_possible(stars.select(F.col("key").alias("ka"), F.col("head").alias("kb")).join(a, "ka").join(b, "kb").where(in_reach), num, den))
    discard(shared, postings, sets, planted)
    links = _verified(star_pairs, texts, shingle, num, den)
    tried, written = star_pairs, [star_pairs, trees]
    for every in (False, True):
        parts = connected_components(links)
        pairs = _tree_pairs(trees, named, parts, every, num, den)
        found = pairs.join(named.select(F.col("key").alias("ka"), F.col("n").alias("na"), F.col("fine").alias("pa")), "ka").join(named.select(F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("fine").alias("pb")), "kb")
        fresh = stash(_possible(found, num, den).join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti"))
        more = _verified(fresh, texts, shingle, num, den)
        both = stash(links.unionByName(more))
        discard(parts, pairs, links, more)
        links, tried = both, tried.unionByName(fresh)
        written.append(fresh)
    discard(*written)
    final = connected_components(links)
    discard(links)
    final = final.select(F.col("node").alias("rep"), "component")
    named_classes = classes.join(final, "rep", "left").select("low", "high", F.coalesce("component", "rep").alias("component"))
    alone = (F.col("n") == 0) | F.col("id").isNull()
    linked = profiles.where(~alone).join(named_classes, ["low", "high"]).select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return linked.unionByName(profiles.where(alone).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
