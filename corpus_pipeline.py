"""A training-data pipeline over ``documents``: five stages, each a table in and a table out.

``run`` writes every stage's result to the shared folder and reads it back, so
a stage's work isn't repeated by the next one's scans and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.bitmap import bitmap_rows, maybe_in
from barlake.llm.bpe import encode
from barlake.llm.common import WORD, discard, stash, table
from barlake.llm.jaccard import jaccard_components
from barlake.llm.mixing import mixed_rows
from barlake.llm.phrases import remove_repeats
from barlake.llm.quality import fit_quality, score_quality
from barlake.llm.queries import vocabulary

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.7

#: No stage but the mixing could be written in SQL, and that one follows three that can't.
ORACLE_SQL = None


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that an operator would replace under other names, and how to turn them back."""
    own = {c: f"own {c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(own), {b: a for a, b in own.items()}


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject, unchanged.  The model is fitted on the labelled ones.

    Null and empty texts get the score of a text without words; equal rows stay
    or go together, other columns pass through, and an empty table stays empty.
    """
    model = fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, score_col="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, unchanged.

    Rows are told apart by a 63-bit hash of id and text: rows with the same id
    and text are copies, another text of the same id is a document of its own,
    and null ids are the largest.  Texts without words are copies of nothing
    and stay.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").bitwiseAND(F.lit((1 << 63) - 1))
    keyed = docs.withColumn("__key", F.when(F.col("text").rlike(WORD), row))
    again = stash(keyed.where("__key IS NOT NULL").groupBy("__key").count().where("count > 1").select("__key"))
    marks = bitmap_rows(again, "__key")
    # of equal rows only those that the bitmap has are exchanged
    first = Window.partitionBy("__key").orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])
    one = maybe_in(keyed, "__key", marks).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    rows = stash(maybe_in(keyed, "__key", marks, inside=False).unionByName(one))
    discard(again)
    groups = jaccard_components(rows.select("__key", "text"), id_col="__key")
    others = stash(groups.where("id != component_id").select(F.col("id").alias("__key"), "component_id"))
    linked = others.unionByName(others.select(F.col("component_id").alias("__key"), "component_id").distinct())
    names = maybe_in(rows.select("__key", "doc_id"), "__key", bitmap_rows(linked, "__key"))
    members = stash(names.join(linked, "__key"))
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__key"))["__key"].alias("kept"))
    gone = stash(members.join(kept, "component_id").where("__key != kept").select("__key"))
    discard(others, members)
    marks = bitmap_rows(gone, "__key")
    # only documents that the bitmap of the dropped rows has are exchanged for the exact join
    left = maybe_in(rows, "__key", marks, inside=False).unionByName(maybe_in(rows, "__key", marks).join(gone, "__key", "left_anti").select(*_columns(rows)))
    return left.select(*_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has; texts without such passages stay as they are.

    Rows with null ids or texts stay as they are, rows of one id take nothing
    from each other, other columns but ``n_chars`` pass through, and an empty
    table stays empty.
    """
    renamed, back = _aside(docs, ["n_words", "n_removed", "kept_text"])
    cut = remove_repeats(renamed)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    done = cut.withColumn("text", text).drop("n_words", "n_removed", "kept_text")
    return _with_length(done.withColumnsRenamed(back)).select(*_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a row for each epoch that takes a document.

    Texts without words are taken by none.  Null sources are a source, null ids
    documents like others, repeated rows are taken each, other columns but
    ``n_chars`` pass through, and an empty table stays empty.
    """
    renamed, back = _aside(docs, ["mix_size", "mix_source_size", "mix_target", "mix_taken"])
    return _with_length(mixed_rows(renamed).withColumnsRenamed(back)).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row of the mixture; null and empty texts have none, and an empty table stays empty."""
    coded = encode(docs.select("doc_id", "source", "text"), vocabulary(), keep_text=False)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = stash(stage(spark, before, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
