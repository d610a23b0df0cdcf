"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The white space that separates words, as Java's regular expressions take it.
SPACES = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20

#: A lookup table of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where it is unset and Spark runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        holder = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = holder.get() if holder.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="barlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def batched(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to send rows to Python by bytes: long texts would else make batches of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors.

    Tables lie in a folder of the application's name.  Those that nothing reads
    any more are dropped by ``discard``; the rest can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete the tables of ``stashed`` frames.  Only for what nothing reads any more: what was made of them must be written down."""
    for df in stashed:
        path = getattr(df, "_stash_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``df`` with a ``table`` that has one row per key.

    The table is broadcast only after its rows were counted and are at most
    ``BROADCAST_ROWS``; a larger one goes through a shuffled join, whose skewed
    partitions adaptive execution splits.
    """
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(table) if small else table, keys, how)


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def extended(df: DataFrame, **more) -> StructType:
    """The schema of ``df`` with more fields; that of ``df`` stays as it is."""
    return StructType([*df.schema.fields, *[StructField(k, t) for k, t in more.items()]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_labels(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """A deterministic sample of about ``limit`` labelled rows at most, by a hash of the id; held-out rows never enter.

    Rows whose id or label is null are left out; of several labels of one id the largest counts.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("__label"))
    )
    n = usable.count()
    if n > limit:
        share = int(limit / n * (1 << 20))
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    return usable
