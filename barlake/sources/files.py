"""Files: archives, layouts, reports and reruns."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import TICK_RAW

#: Text read from an archive member at a time.
CHUNK = 1 << 20


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first ``.csv`` member of each archive; unreadable archives give none.

    An archive can't be split, so each is one task's work; lines leave it in chunks.
    """
    names = TICK_RAW.fieldNames()

    def lines(frames):
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    member = next(m for m in archive.namelist() if m.endswith(".csv"))
                    with archive.open(member) as f:
                        for chunk in pd.read_csv(f, header=None, names=names, dtype=str, chunksize=100_000, keep_default_na=False):
                            yield chunk.assign(file=name)
                except (zipfile.BadZipFile, StopIteration):
                    continue

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    text = found.mapInPandas(lines, ", ".join(f"{n} string" for n in names) + ", file string")
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TICK_RAW], "file")


def first_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows in an order, by top-k."""
    return df.orderBy(*order).limit(k)


def month_files(spark: SparkSession, path: str, pattern: str = r"([A-Za-z0-9]+)_(\d{4})_(\d{2})\.parquet") -> DataFrame:
    """Monthly files under a folder: ``symbol``, ``year``, ``month`` of the name, and ``path``, in that order; other files are left out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = listed.select(*[F.regexp_extract("path", pattern, k).alias(n) for k, n in ((1, "symbol"), (2, "year"), (3, "month"))], F.regexp_extract("path", f"^(.*{pattern})", 1).alias("path"))
    found = named.where("symbol != ''").select("symbol", F.col("year").cast("int"), F.col("month").cast("int"), "path").distinct()
    return found.orderBy("symbol", "year", "month")


def footer_report(spark: SparkSession, paths: list[str], expected: StructType) -> DataFrame:
    """For each Parquet file or folder its rows, and the columns that are missing, extra or of another type, from its footers."""
    want = {f.name: f.dataType.simpleString() for f in expected}
    rows = []
    for path in paths:  # one listing of months; footers only
        df = spark.read.parquet(path)
        have = dict(df.dtypes)
        rows.append((path, df.count(), [n for n in want if n not in have], [n for n in have if n not in want], [n for n in want if n in have and have[n] != want[n]]))
    return spark.createDataFrame(rows, "path string, rows long, missing array<string>, extra array<string>, wrong_type array<string>")


def write_chunks(chunks: Iterable[DataFrame], path: str) -> None:
    """Append table after table; the first one's columns and types hold for all, absent columns are NULL."""
    schema = None
    for chunk in chunks:
        if schema is None:
            schema = chunk.schema
        fitted = chunk.select(*[(F.col(f"`{f.name}`") if f.name in chunk.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        fitted.write.mode("overwrite" if schema is chunk.schema else "append").parquet(path)


def write_single(df: DataFrame, path: str, aside: str) -> None:
    """One Parquet file of that name, for tables that one task can write; an old one is replaced."""
    df.coalesce(1).write.mode("overwrite").parquet(aside)
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(aside)) if s.getPath().getName().startswith("part-"))
    fs.delete(to, True)
    if not fs.rename(part, to):
        raise OSError(f"can't move {part} to {path}")
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)


def scratch(spark: SparkSession) -> str:
    """A new folder for files between steps: under the folder that all executors share, or a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="barlake-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def month_of_file(df: DataFrame, pattern: str = r"([A-Za-z0-9]+)_(\d{4})_(\d{2})\.parquet") -> DataFrame:
    """Add symbol, year and month that a file's name holds."""
    name = F.input_file_name()
    return df.withColumns({
        "symbol": F.regexp_extract(name, pattern, 1), "year": F.regexp_extract(name, pattern, 2).try_cast("int"), "month": F.regexp_extract(name, pattern, 3).try_cast("int"),
    })


def read_tolerant(spark: SparkSession, path: str, wanted: dict[str, str], aliases: dict[str, list[str]]) -> DataFrame:
    """The wanted columns (name: type) of files whose schemas differ; other names count as given, absent columns are NULL."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    there = set(df.columns)

    def pick(name, kind):
        found = [F.col(c) for c in (name, *aliases.get(name, [])) if c in there]
        return (F.coalesce(*found) if found else F.lit(None)).cast(kind).alias(name)

    return df.select(*[pick(n, k) for n, k in wanted.items()])


def write_months(df: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "year", "month")) -> None:
    """One folder per series and month; rewriting some leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_swapped(df: DataFrame, path: str, aside: str) -> DataFrame:
    """Overwrite files that ``df`` is read from: written aside first, then in place."""
    df.write.mode("overwrite").parquet(aside)
    df.sparkSession.read.parquet(aside).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among the finished ones."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_from(df: DataFrame, year: int, month: int) -> DataFrame:
    """Partitions from a month on; prunes folders."""
    return df.where((F.col("year") > year) | ((F.col("year") == year) & (F.col("month") >= month)))


def rows_of_month(df: DataFrame, year: int, month: int, order: str = "timestamp") -> DataFrame:
    """Rows from the first instant of a month to the last before the next one; what lies in front or behind is left out."""
    first = F.make_timestamp_ntz(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return df.where((F.col(order) >= first) & (F.col(order) < F.add_months(first.cast("date"), 1).cast("timestamp_ntz")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per year in the file names."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"(\d{4})[^/]*$", 1).alias("year")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def extrapolated(found: DataFrame, growth: float = 4.0, rows_per_mb: float = 0.0) -> DataFrame:
    """Totals of an inventory with sizes after unpacking and an estimate of rows."""
    total = found.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return total.select("files", (F.col("bytes") / 1e9).alias("gb"), (F.col("bytes") / 1e9 * growth).alias("gb_unpacked"), (F.col("bytes") / 1e6 * rows_per_mb).cast("long").alias("rows"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a list file, one a line; blank lines and comments go."""
    rows = spark.read.text(path).select(F.trim("value").alias("name")).where("name != '' AND NOT startswith(name, '#')")
    return [r["name"] for r in rows.collect()]


def first_and_last(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first and last ``k`` rows in an order, by top-k, not by a sort of everything."""
    first = df.orderBy(*order).limit(k)
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(k)
    return first.union(last).distinct()
