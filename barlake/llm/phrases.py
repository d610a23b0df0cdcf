"""Removal of repeated passages with phrase automata.

A window is a run of ``WINDOW`` words.  A window repeats if its words also
start in a document with a smaller id, and every word that a repeating window
covers goes.

Recurring passages are confirmed in steps that each send little:

1. Every window has an anchor, the smallest hash of its runs of ``ANCHOR``
   words.  Equal windows have equal anchors and neighbours mostly share one, so
   the anchors are a fraction of the windows.  Those that occur in one text
   only are settled.
2. The recurring anchors become a bitmap of fixed size.  Windows whose anchor
   isn't in it are dropped where the text is read.
3. Windows of the anchors that the most documents share are counted with
   partial sums, so no key gathers rows.  The ones confirmed become phrases,
   compiled into sharded Aho-Corasick automata through which every task streams
   all its documents.
4. The other windows, of passages that few documents share, find their smallest
   id by one exchange.  Automata over all of them would grow with the corpus.

Equal texts are settled by the smallest id among them beforehand, so
groups of copies don't enter the later steps.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .bitmap import bitmap_array, bitmap_rows, in_array, maybe_in
from .common import batched, discard, extended, stash
from .shingles import hashed_words, run_starts, runs, slices, sliding_min

WINDOW, ANCHOR = 13, 5
#: Texts in which an anchor is frequent, and frequent anchors at most.
FREQUENT, FREQUENT_ANCHORS = 50, 100_000
#: Phrases in all automata and in one.  Others are found by the exchange.
PHRASES, PHRASES_PER_SHARD = 20_000, 20_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; null has none."""
    return (text or "").encode().split()


class Windows:
    """The windows of all texts of a column: hash, anchor, and the bounds of each text among them."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        words, bounds = hashed_words(texts)
        at, self.ends = run_starts(bounds, window)
        self.hashes = runs(words, window)[at].view(np.int64)
        span = window - anchor + 1
        short = runs(words, anchor)
        self.anchors = sliding_min(short, span)[at] if len(at) else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.ends))

    def of(self, text: int) -> np.ndarray:
        return self.hashes[self.ends[text] : self.ends[text + 1]]


class Automata:
    """Sharded automata over phrases; each phrase gives the smallest id that has it."""

    def __init__(self, phrases: list[tuple[bytes, int]]):
        import ahocorasick

        self.shards = []
        for i in range(0, len(phrases), PHRASES_PER_SHARD):
            shard = ahocorasick.Automaton()
            for phrase, owner in phrases[i : i + PHRASES_PER_SHARD]:
                # words are separated by one space and enclosed in spaces, so only whole words match
                shard.add_word(" " + phrase.decode() + " ", owner)
            shard.make_automaton()
            self.shards.append(shard)

    def covered(self, words: list[bytes], doc_id: int, window: int) -> list[int]:
        """Starts (word numbers) of the phrases in a document whose smallest id is below its own."""
        if not self.shards or len(words) < window:
            return []
        text = " " + b" ".join(words).decode() + " "
        ends = [end for shard in self.shards for end, owner in shard.iter(text) if owner < doc_id]
        if not ends:
            return []
        # the space behind word k (from 0) is at this position
        at = np.cumsum([len(w.decode()) + 1 for w in words])
        return (np.searchsorted(at, np.array(ends)) - window + 1).tolist()


#: The automata that this process compiled last, and for what.
_compiled: tuple[str, Automata | None] = ("", None)


def automata_of(name: str, phrases: list[tuple[bytes, int]]) -> Automata:
    """The automata of ``phrases``, compiled once per process."""
    global _compiled
    if _compiled[0] != name:
        _compiled = (name, Automata(phrases))
    return _compiled[1]


def _keep(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Words outside of all windows that start there."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:n] == 0


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) to every row of ``docs``.

    A null text has no words.  Texts with fewer words than a window stay whole.
    A window that repeats within its own document only, or only in rows with
    the same id, stays.  Null ids neither own windows nor lose words.  An empty
    table stays empty.  Columns of these names in the input are replaced, and
    columns starting with ``__`` are reserved.  Windows of few documents, and
    texts, are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))

    def anchors(batches):
        for whole in batches:
            for b in slices(whole):
                w = Windows(b.column("text"), window, anchor)
                # neighbours mostly share their anchor
                new = np.ones(len(w.anchors), bool)
                new[1:] = (w.anchors[1:] != w.anchors[:-1]) | (w.owner[1:] != w.owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(w.anchors[new].view(np.int64)), b.column("key").take(pa.array(w.owner[new]))], names=["anchor", "key"])

    used = batched(texts.where("id IS NOT NULL"))
    spans = used.mapInArrow(anchors, "anchor long, key long").groupBy("anchor").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    recurring = stash(spans.where("first < last").select("anchor", "n"))
    seen = spark.sparkContext.broadcast(bitmap_array(recurring, "anchor"))  # 8 MB
    top = recurring.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "anchor").limit(FREQUENT_ANCHORS)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["anchor"] for r in top.select("anchor").collect()], np.int64)))

    discard(recurring)

    def is_in(sorted_values, values):
        if not len(sorted_values):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
        return sorted_values[at] == values

    def frequent_windows(batches):
        for whole in batches:
            for b in slices(whole):
                w = Windows(b.column("text"), window, anchor)
                hit = np.flatnonzero(is_in(frequent.value, w.anchors.view(np.int64)))
                phrases, last, words = [], -1, []
                for k, text in zip(hit.tolist(), w.owner[hit].tolist(), strict=True):
                    if text != last:
                        last, words = text, words_of(b.column("text")[text].as_py())
                    start = k - int(w.ends[text])
                    phrases.append(b" ".join(words[start : start + window]))
                ids = b.column("id").take(pa.array(w.owner[hit]))
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes[hit]), ids, pa.array(phrases, pa.binary())], names=["window", "id", "phrase"])

    confirmed = (
        used.mapInArrow(frequent_windows, "window long, id long, phrase binary")
        .groupBy("window", "phrase").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"))
        .where("owner < last")
    )
    rows = confirmed.orderBy(F.desc("n"), "window", "phrase").limit(PHRASES).select("window", "phrase", "owner").toArrow()
    phrases = spark.sparkContext.broadcast(list(zip(rows.column("phrase").to_pylist(), rows.column("owner").to_pylist(), strict=True)))
    name = uuid.uuid4().hex
    by_automaton = spark.sparkContext.broadcast(np.unique(rows.column("window").to_numpy()))

    def other_windows(batches):
        least: dict[int, int] = {}
        for whole in batches:
            for b in slices(whole):
                w = Windows(b.column("text"), window, anchor)
                ids = np.asarray(b.column("id"))
                first = np.ones(len(ids), bool)
                if len(least) > 200_000:
                    least.clear()
                for k, (key, i) in enumerate(zip(b.column("key").to_pylist(), ids.tolist(), strict=True)):
                    # an equal text with a smaller id owns all windows of this one
                    if least.get(key, i + 1) <= i:
                        first[k] = False
                    else:
                        least[key] = i
                keep = in_array(seen.value, w.anchors) & first[w.owner]
                keep[keep] = ~is_in(by_automaton.value, w.hashes[keep])
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes[keep]), pa.array(ids[w.owner[keep]])], names=["window", "id"])

    same = Window.partitionBy("window")
    repeats = (
        used.mapInArrow(other_windows, "window long, id long")
        .withColumn("owner", F.min("id").over(same)).where("id > owner")
        .groupBy("id").agg(F.collect_list("window").alias("windows"))
    )

    copies = used.select("id", "key")
    owners = copies.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copied = copies.join(owners, "key").where("id > first").select("id", "key")
    marks = stash(
        repeats.select("id", "windows", F.lit(None).cast("long").alias("key"))
        .unionByName(copied.select("id", F.lit(None).cast("array<long>").alias("windows"), "key"))
        .groupBy("id").agg(F.flatten(F.collect_list("windows")).alias("windows"), F.collect_set("key").alias("keys"))
    )

    def finish(batches):
        automata = automata_of(name, phrases.value)
        for whole in batches:
            for b in slices(whole):
                column = dict(zip(b.schema.names, b.columns, strict=True))
                marks_here = (column["__windows"].is_valid().to_numpy(zero_copy_only=False) | column["__keys"].is_valid().to_numpy(zero_copy_only=False)).any()
                w = Windows(column["__text"], window, anchor) if marks_here or automata.shards else None
                # a text without any anchor of the phrases can't hold one: the automata needn't read it
                with_anchor = np.zeros(b.num_rows, bool)
                if w is not None:
                    with_anchor[w.owner[is_in(frequent.value, w.anchors.view(np.int64))]] = True
                n_words, n_removed, kept_text = [], [], []
                marked = zip(column["__id"].to_pylist(), column["__text"], column["__key"].to_pylist(), column["__windows"], column["__keys"], strict=True)
                for k, (i, t, key, repeated, same_text) in enumerate(marked):
                    words = words_of(t.as_py())
                    n = len(words)
                    keep = np.ones(n, bool)
                    if n >= window and i is not None:
                        if same_text.is_valid and key in same_text.as_py():
                            keep[:] = False
                        else:
                            starts = automata.covered(words, i, window) if with_anchor[k] else []
                            if repeated.is_valid and len(repeated.values):
                                starts += np.flatnonzero(np.isin(w.of(k), np.asarray(repeated.values))).tolist()
                            if starts:
                                keep = _keep(n, np.array(starts), window)
                    n_words.append(n)
                    n_removed.append(int(n - keep.sum()))
                    kept_text.append(b" ".join(words if keep.all() else [x for x, stays in zip(words, keep.tolist(), strict=True) if stays]).decode())
                yield pa.RecordBatch.from_arrays([*[column[c] for c in passed], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string())], names=[*passed, *added])

    # documents without a mark aren't exchanged: a bitmap of the marked ids tells them apart where they are read
    added = ["n_words", "n_removed", "kept_text"]
    passed = [c for c in docs.columns if c.lower() not in added]
    base = docs.withColumns({"__id": F.col(id_col).cast("long"), "__text": F.col(text_col), "__key": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    marked_ids = bitmap_rows(marks, "id")
    none = F.lit(None).cast("array<long>")
    unmarked = maybe_in(base, "__id", marked_ids, inside=False).withColumns({"__windows": none, "__keys": none})
    marked = maybe_in(base, "__id", marked_ids).join(marks.select(F.col("id").alias("__id"), F.col("windows").alias("__windows"), F.col("keys").alias("__keys")), "__id", "left")
    columns = [F.col(f"`{c}`") for c in (*passed, "__id", "__text", "__key", "__windows", "__keys")]
    schema = extended(docs.select(*[F.col(f"`{c}`") for c in passed]), n_words=LongType(), n_removed=LongType(), kept_text=StringType())
    return unmarked.select(*columns).unionByName(marked.select(*columns)).mapInArrow(finish, schema)
