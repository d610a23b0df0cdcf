"""Profiles, outliers, correlations and volume statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import finite, ratio, sample_kurtosis, sample_skew

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def numeric(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``value``: one row per column and row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")


#: Values up to which Spark's percentile, which holds the distinct ones in a task, is used; beyond, ranks are narrowed down.
EXACT_ROWS = 5_000_000
#: Bins of a narrowing pass.
BINS = 1024


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], exact_rows: int | None = None) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, linear between ranks, by partial sums only.

    Each rank has a bracket of values.  A pass counts the bracket's values in
    ``BINS`` bins and goes on with the one that holds the rank, until its values
    are equal: a few scans whatever the rows, with at most ``BINS`` rows for each
    rank to the driver.  Missing values and NaN don't count.
    """
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    ends = df.agg(*[f(value(c)).alias(f"{i}{n}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    n = {c: ends[f"{i}n"] for i, c in enumerate(columns)}
    if max(n.values(), default=0) <= (EXACT_ROWS if exact_rows is None else exact_rows):
        row = df.agg(*[F.percentile(value(c), F.array(*[F.lit(float(p)) for p in shares])).alias(f"{i}") for i, c in enumerate(columns)]).first()
        return {c: list(row[f"{i}"]) if row[f"{i}"] else [None] * len(shares) for i, c in enumerate(columns)}
    # rank: column, least and greatest value that it can have, values below
    open_, found = {}, {}
    for i, c in enumerate(columns):
        for p in shares:
            for k in {math.floor(p * (n[c] - 1) + 1e-9), math.ceil(p * (n[c] - 1) - 1e-9)} if n[c] else ():
                open_[c, k] = (ends[f"{i}a"], ends[f"{i}b"], 0)
    while True:
        found |= {r: a for r, (a, b, _) in open_.items() if a == b}
        open_ = {r: v for r, v in open_.items() if r not in found}
        if not open_:
            break
        ranks = sorted(open_)
        at = {c: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(open_[r][0])).alias("a"), F.lit(float(open_[r][1])).alias("b")) for t, r in enumerate(ranks) if r[0] == c]) for c in dict.fromkeys(c for c, _ in ranks)}
        each = df.select(F.explode(F.array(*[F.struct(value(c).alias("v"), r.cast("array<struct<t:int,a:double,b:double>>").alias("r")) for c, r in at.items()])).alias("x")).select("x.*")
        hit = each.select("v", F.explode(F.filter("r", lambda r: (r["a"] <= F.col("v")) & (F.col("v") <= r["b"]))).alias("r"))
        place = F.least(F.floor((F.col("v") - F.col("r.a")) / (F.col("r.b") - F.col("r.a")) * BINS), F.lit(BINS - 1))
        counts = hit.groupBy(F.col("r.t").alias("t"), place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for t, r in enumerate(ranks):
            below = open_[r][2]
            for x in sorted((x for x in counts if x["t"] == t), key=lambda x: x["bin"]):
                if r[1] < below + x["n"]:
                    open_[r] = (x["a"], x["b"], below)
                    break
                below += x["n"]

    def between(c, p):
        pos = p * (n[c] - 1)
        low, high = found[c, math.floor(pos + 1e-9)], found[c, math.ceil(pos - 1e-9)]
        return low + (high - low) * max(0.0, pos - math.floor(pos + 1e-9))

    return {c: [between(c, p) if n[c] else None for p in shares] for c in columns}


def _named(columns: Sequence[str], values: dict[str, list[float | None]], at: int) -> Column:
    """A column's value by its name."""
    out = F.lit(None).cast("double")
    for c in columns:
        out = F.when(F.col("column") == c, F.lit(values[c][at]).cast("double")).otherwise(out)
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles per column."""
    q = quantiles(df, columns, PERCENTILES)
    out = _long(df, columns).groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.withColumns({f"p{int(p * 100):02d}": _named(columns, q, i) for i, p in enumerate(PERCENTILES)})


def univariate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    n = F.count("value")
    v = F.col("value")
    middle = quantiles(df, columns, [0.5])
    return _long(df, columns).groupBy("column").agg(
        F.avg(v).alias("mean"), F.first(_named(columns, middle, 0)).alias("median"), F.stddev_samp(v).alias("std"), finite(sample_skew(v, n)).alias("skew"), finite(sample_kurtosis(v, n)).alias("kurtosis"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of every value, NULL included."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__rows"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__rows")).drop("__rows")


def missing(df: DataFrame) -> DataFrame:
    """Missing values per column that has any, in one pass."""
    one = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = one.select("__rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])).alias("x"))
    return long.select("x.column", "x.missing", ratio(F.col("x.missing") * 100, "__rows").alias("percent")).where("missing > 0")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal bin between the extremes; the last bin holds the maximum."""
    x = F.col(column)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(F.when(F.col("hi") > F.col("lo"), at), F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row is broadcast


def by_label(df: DataFrame, label: str, column: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.stddev_samp(column).alias("std"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair over the rows that have both, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    listed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), finite(F.col(f"`{i}`")).alias("rho")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*listed)).alias("x")).select("x.*")


def target_correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns if c != target])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("rho")) for c in one.columns])).alias("x")).select("x.*")


def strong_pairs(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    return correlations(df, columns).where(F.abs("rho") > least)


BOUNDS = "column string, lower double, upper double"


def _outliers(df: DataFrame, columns: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Counts outside of each column's bounds (one row per column, broadcast)."""
    v = F.col("value")
    return (
        _long(df, columns).join(F.broadcast(bounds), "column").groupBy("column").agg(
            F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.count_if(v < F.col("lower")).alias("below"), F.count_if(v > F.col("upper")).alias("above"),
            ratio(F.count_if((v < F.col("lower")) | (v > F.col("upper"))) * 100, F.count(v)).alias("percent"),
        )
    )


def outliers_iqr(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    q = quantiles(df, columns, [0.25, 0.75])
    rows = [(c, None if a is None else a - k * (b - a), None if a is None else b + k * (b - a)) for c, (a, b) in q.items()]
    return _outliers(df, columns, df.sparkSession.createDataFrame(rows, BOUNDS))


def outliers_percentile(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    q = quantiles(df, columns, [low, high])
    return _outliers(df, columns, df.sparkSession.createDataFrame([(c, *v) for c, v in q.items()], BOUNDS))


def outliers_z(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    m = _long(df, columns).groupBy("column").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return _outliers(df, columns, m.select("column", (F.col("m") - z * F.col("s")).alias("lower"), (F.col("m") + z * F.col("s")).alias("upper")))


def _sum(c: Column) -> Column:
    """A sum of amounts that doesn't depend on the order of rows, exact to nine digits."""
    return F.sum(c.try_cast("decimal(38,9)")).cast("double")


def volume_by_day(ticks: DataFrame, amount: str = "quote_quantity", day: str = "timestamp") -> DataFrame:
    """Per series: mean daily amount, days, and mean hourly amount."""
    t = F.col(day)
    daily = ticks.groupBy("symbol", F.to_date(t).alias("d")).agg(_sum(F.col(amount)).alias("x")).groupBy("symbol").agg(ratio(_sum(F.col("x")), F.count("x")).alias("mean_daily"), F.count("*").alias("days"))
    hourly = ticks.groupBy("symbol", F.date_trunc("hour", t).alias("h")).agg(_sum(F.col(amount)).alias("x")).groupBy("symbol").agg(ratio(_sum(F.col("x")), F.count("x")).alias("mean_hourly"))
    return daily.join(hourly, "symbol")


def suggested_sizes(volumes: DataFrame, targets: Sequence[int] = (150, 200, 300, 400, 500, 600)) -> DataFrame:
    """Bar sizes that give a number of bars a day, from the day-weighted mean over all series."""
    total = volumes.agg(ratio(_sum(F.col("mean_daily") * F.col("days")), F.sum("days")).alias("daily"), ratio(_sum(F.col("mean_hourly")), F.count("mean_hourly")).alias("hourly"))
    each = total.withColumn("target_bars", F.explode(F.array(*[F.lit(t) for t in targets])))
    return each.select("target_bars", (F.col("daily") / F.col("target_bars")).alias("bar_size"), ratio("hourly", F.col("daily") / F.col("target_bars")).alias("bars_per_hour"), ratio(F.col("hourly") * 2, F.col("daily") / F.col("target_bars")).alias("bars_per_active_hour"))


def sample_stats(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean_price"), F.avg("quantity").alias("mean_quantity"),
        F.avg(F.col("isBuyerMaker").cast("double")).alias("maker_ratio"), F.count_if(F.col("price").isNull()).alias("missing_prices"),
    )


def month_gaps(months: DataFrame) -> DataFrame:
    """Months (``year``, ``month``) between the first and the last that are absent."""
    there = months.select(F.make_date("year", "month", F.lit(1)).alias("m")).distinct()
    span = there.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("m"))
    return span.join(there, "m", "left_anti").select(F.year("m").alias("year"), F.month("m").alias("month"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def quality_report(ticks: DataFrame, keys: Sequence[str], expected_year: str | None = None, expected_month: str | None = None) -> DataFrame:
    """Checks per group: rows, missing values, timestamps out of their month, missing booleans, and whether all passed."""
    out = F.lit(0) if expected_year is None else F.count_if((F.year("timestamp") != F.col(expected_year)) | (F.month("timestamp") != F.col(expected_month)))
    checks = ticks.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("price", "quantity", "quote_quantity")],
        out.cast("long").alias("out_of_month"), F.count_if(F.col("isBuyerMaker").isNull()).alias("missing_maker"),
    )
    bad = F.col("missing_price") + F.col("missing_quantity") + F.col("missing_quote_quantity") + F.col("out_of_month") + F.col("missing_maker")
    return checks.withColumn("passed", (F.col("rows") > 0) & (bad == 0))


def schema_report(df: DataFrame, expected) -> dict[str, list[str]]:
    """Names that are missing, extra (a warning only) or of another type."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in expected}
    return {"missing": [n for n in want if n not in have], "extra": [n for n in have if n not in want], "wrong_type": [n for n in want if n in have and have[n] != want[n]]}
