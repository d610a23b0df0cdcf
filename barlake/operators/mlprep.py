"""Model data: imputation, splits, scaling, sequences and scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ratio, series
from ..functions.slices import lookup, numbered, running_sum
from .profile import quantiles

SPLIT = "split"


def forward_fill(df: DataFrame, columns: Sequence[str], *, keys=("symbol",), order=("ts",)) -> DataFrame:
    before = series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def chronological_split(df: DataFrame, *, order: Sequence[str], test: float = 0.2, validation: float = 0.15, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``split``: the last share of rows is the test, the last share of the rest the validation; whole numbers are cut down."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    n, at = F.col("__n"), F.col("__at")
    first_test = F.floor(n * (1 - test) + 1e-9)
    first_validation = F.floor(first_test * (1 - validation) + 1e-9)
    placed = lookup(numbered(df, keys, order, "__at"), counts, keys)
    return placed.withColumn(SPLIT, F.when(at < first_validation, "train").when(at < first_test, "validation").otherwise("test")).drop("__at", "__n")


def _fitted(df: DataFrame, columns: Sequence[str], statistics: dict[str, callable], leaky: bool) -> DataFrame:
    """One row of statistics of the training rows (all rows if ``leaky``), by which every row is joined."""
    rows = df if leaky else df.where(F.col(SPLIT) == "train")
    return rows.agg(*[f(F.col(c).cast("double")).alias(f"__{s}_{c}") for c in columns for s, f in statistics.items()])


def _apply(df: DataFrame, fitted: DataFrame, change: dict[str, Column]) -> DataFrame:
    return df.crossJoin(F.broadcast(fitted)).withColumns(change).select(*df.columns)  # one row


def impute_median(df: DataFrame, columns: Sequence[str], *, leaky: bool = False) -> DataFrame:
    """Missing values become the median, 0 without one."""
    middle = quantiles(df if leaky else df.where(F.col(SPLIT) == "train"), columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0]).cast("double"), F.lit(0.0)) for c in columns})


def clip(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    ends = quantiles(df.where(F.col(SPLIT) == "train"), columns, [low, high])
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(a).cast("double")), F.lit(b).cast("double"))) for c, (a, b) in ends.items()})


def scale(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """``standard`` (population deviation), ``minmax``, ``robust`` (median and quartiles), ``none``; a zero scale counts as 1."""
    centre, width = scalers(kind)
    fitted = _fitted(df, columns, {"c": centre, "w": width}, False)
    return _apply(df, fitted, {c: (F.col(c) - F.col(f"__c_{c}")) / F.when(F.col(f"__w_{c}") > 0, F.col(f"__w_{c}")).otherwise(1.0) for c in columns})


def scalers(kind: str) -> tuple:
    """Aggregates of the centre and of the width of a linear scaler."""
    kinds = {
        "standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        "robust": (F.median, lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))), "none": (lambda c: F.lit(0.0), lambda c: F.lit(1.0)),
    }
    if kind not in kinds:
        raise KeyError(f"unknown scaler {kind!r}")
    return kinds[kind]


#: Training quantiles that the quantile scaler keeps; their number doesn't grow with the input.
QUANTILES = 1000


def scale_quantile(df: DataFrame, column: str, *, normal: bool = False) -> DataFrame:
    """Position among the training rows' quantiles, 0 to 1, linear between them; or the normal quantile of it."""
    points = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    fitted = df.where(F.col(SPLIT) == "train").agg(F.percentile(F.col(column).cast("double"), points).alias("__q"))
    row = fitted.first()
    marks = np.array(row["__q"] if row and row["__q"] else [0.0])
    return df.withColumn(column, quantile_position(F.col(column).cast("double"), marks, normal))


def quantile_position(value: Column, marks: np.ndarray, normal: bool) -> Column:
    """Where a value lies among marks, from 0 to 1."""

    @F.pandas_udf("double")
    def position(x: pd.Series) -> pd.Series:
        grid = np.linspace(0, 1, len(marks)) if len(marks) > 1 else np.array([0.0])
        # the mean of both directions puts repeated values in the middle of their quantiles
        p = (np.interp(x, marks, grid) - np.interp(-x, -marks[::-1], -grid[::-1])) / 2
        if normal:
            inverse = NormalDist().inv_cdf
            return pd.Series([inverse(min(max(v, 1e-7), 1 - 1e-7)) if v == v else None for v in p])
        return pd.Series(p)

    return position(value)


def yeo_johnson(x: Column, power: float) -> Column:
    """The power transform for any sign."""
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


#: Powers that the power scaler tries.
POWERS = tuple(i / 10 for i in range(-20, 41))


def scale_power(df: DataFrame, column: str, powers: Sequence[float] = POWERS) -> DataFrame:
    """Power transform with the most likely of the given powers on the training rows, then standardised."""
    best = likeliest_power(df.where(F.col(SPLIT) == "train"), column, powers)
    return scale(df.withColumn(column, yeo_johnson(F.col(column).cast("double"), best)), [column])


def likeliest_power(train: DataFrame, column: str, powers: Sequence[float] = POWERS) -> float:
    x = F.col(column).cast("double")
    row = train.agg(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), F.count(x).alias("n"), *[F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(powers)]).first()

    def likelihood(i):
        v = row[f"v{i}"]
        return -row["n"] / 2 * math.log(v) + (powers[i] - 1) * row["s"] if v and v > 0 and math.isfinite(v) else -math.inf

    return powers[max(range(len(powers)), key=likelihood)]


def sequences(df: DataFrame, features: Sequence[str], length: int, *, label: str | None = None, keys=("symbol",), order=("ts",)) -> DataFrame:
    """Windows of ``length`` rows as nested arrays with the last row's label; shorter ones go."""
    w = series(keys, order)
    frame = F.collect_list(F.array(*[F.col(c).cast("float") for c in features])).over(w.rowsBetween(-(length - 1), 0))
    out = df.withColumn("sequence", frame).where(F.size("sequence") == length)
    return out.select(*keys, *order, "sequence", *([label] if label else []))


def batches(df: DataFrame, size: int, *, order: Sequence[str], shuffle_seed: int | None = None, keys=("symbol",)) -> DataFrame:
    """Add ``batch``: rows numbered within their series, in order or in a seeded order."""
    by = order if shuffle_seed is None else [F.xxhash64(F.lit(shuffle_seed), *order), *order]
    if shuffle_seed is not None:
        df, by = df.withColumn("__by", by[0]), ["__by", *order]
    return numbered(df, keys, by, "batch").withColumn("batch", F.floor(F.col("batch") / size)).drop("__by")


def last_rows(df: DataFrame, n: int, *, keys=("symbol",), order=("ts",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def instance_norm(df: DataFrame, column: str, length: int, *, keys=("symbol",), order=("ts",)) -> DataFrame:
    """Each value against the mean and population variance of its own sequence."""
    frame = series(keys, order).rowsBetween(-(length - 1), 0)
    full = F.count(column).over(frame) == length
    return df.withColumn(f"{column}_normed", F.when(full, (F.col(column) - F.avg(column).over(frame)) / F.sqrt(F.var_pop(column).over(frame) + 1e-6)))


def _counts(scored: DataFrame, thresholds: Sequence[float], y: str, p: str) -> DataFrame:
    """Confusion counts at every threshold: scores are counted per threshold step first, so rows aren't multiplied."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = F.size(F.filter(marks, lambda t: t <= F.col(p)))
    steps = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(passed.alias("k"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    each = steps.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))))
    hit = F.col("k") >= F.col("i")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("i").agg(total(hit & (F.col("y") == 1)).alias("tp"), total(hit & (F.col("y") == 0)).alias("fp"), total(~hit & (F.col("y") == 1)).alias("fn"), total(~hit & (F.col("y") == 0)).alias("tn")).withColumn("threshold", F.element_at(marks, F.col("i"))).drop("i")


def threshold_metrics(scored: DataFrame, thresholds: Sequence[float], y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, precision, recall and F1 at each (ascending) threshold; 0 where a division has no denominator."""
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _counts(scored, thresholds, y, p).select(
        "threshold", zero(tp + tn, tp + fp + fn + tn).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"),
    )


def best_threshold(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The threshold from 0.01 to 0.99 with the largest F1, the first of several."""
    m = threshold_metrics(scored, [i / 100 for i in range(1, 100)], y, p)
    return m.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve by mean ranks; ties are counted per distinct score, so the sorted side is the scores, not the rows."""
    by_score = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    return running_sum(by_score, [], ["p"], F.col("neg"), "below").agg(ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def losses(scored: DataFrame, gamma: float = 2.0, alpha: float = 0.25, y: str = "y", p: str = "p") -> DataFrame:
    """Cross-entropy and focal loss per row."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    pt = F.when(F.col(y) == 1, q).otherwise(1 - q)
    a = F.when(F.col(y) == 1, alpha).otherwise(1 - alpha)
    return scored.withColumns({"bce": -F.ln(pt), "focal": -a * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt)})


def isotonic(fit: DataFrame, apply: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Calibrated scores: a monotone fit on one table applied to another, within 0 and 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    v = VectorAssembler(inputCols=[p], outputCol="__f")
    model = IsotonicRegression(featuresCol="__f", labelCol=y, predictionCol="calibrated").fit(v.transform(fit.select(F.col(y).cast("double").alias(y), p)))
    return model.transform(v.transform(apply)).drop("__f").withColumn("calibrated", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))


#: What a fitted scaler keeps of a column, by kind.
FITTED = "column string, kind string, numbers array<double>"


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """Parameters of a scaler from the training rows, a row per column: centre and width, or training quantiles, or power, centre and width.

    The table can be written and read again, and applied to other data.
    """
    rows = df.where(F.col(SPLIT) == "train")
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    if kind == "quantile":
        points = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
        numbers = {c: F.percentile(v, points) for c, v in x.items()}
    elif kind == "power":
        best = {c: likeliest_power(rows, c) for c in columns}
        moved = {c: yeo_johnson(v, best[c]) for c, v in x.items()}
        numbers = {c: F.array(F.lit(best[c]), F.avg(v), F.stddev_pop(v)) for c, v in moved.items()}
    else:
        centre, width = scalers(kind)
        numbers = {c: F.array(centre(v).cast("double"), width(v).cast("double")) for c, v in x.items()}
    one = rows.agg(*[v.alias(f"{i}") for i, v in enumerate(numbers.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(f"`{i}`").alias("numbers")) for i, c in enumerate(numbers)])).alias("x")).select("x.*")


def apply_scaler(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Scale the columns that ``fitted`` names; a column without training values, or a zero width, isn't changed in scale."""
    change = {}
    for r in fitted.collect():  # a row per column
        c, n = F.col(f"`{r['column']}`").cast("double"), r["numbers"]
        if r["kind"] == "quantile":
            change[r["column"]] = quantile_position(c, np.array(n or [0.0]), False)
            continue
        if r["kind"] == "power":
            c, n = yeo_johnson(c, n[0]), n[1:]
        centre, width = (v if v is not None else d for v, d in zip(n, (0.0, 1.0), strict=True))
        change[r["column"]] = (c - centre) / (width if width > 0 else 1.0)
    return df.withColumns(change)


def select_features(df: DataFrame, *, names: Sequence[str] | None = None, kinds: Sequence[str] | None = None, always: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The columns of a list, or of the given kinds (``feature_kinds``), besides those that always stay; and the names that are missing.

    A list without any column that is there is an error, as are unknown kinds.
    """
    if (names is None) == (kinds is None):
        raise ValueError("give either names or kinds")
    grouped = feature_kinds([c for c in df.columns if c not in always])
    if kinds is not None:
        if unknown := [k for k in kinds if k not in grouped]:
            raise KeyError(f"unknown kinds {unknown}")
        names = [c for k in kinds for c in grouped[k]]
    wanted = list(dict.fromkeys(names))
    there = [c for c in wanted if c in df.columns and c not in always]
    if not there:
        raise ValueError("no column of the list is there")
    return df.select(*[F.col(f"`{c}`") for c in (*always, *there)]), [c for c in wanted if c not in df.columns]


def feature_kinds(columns: Sequence[str]) -> dict[str, list[str]]:
    """Names by resolution, and those that scaling leaves alone."""
    out: dict[str, list[str]] = {"short": [], "medium": [], "long": [], "regime": [], "unscaled": []}
    for c in dict.fromkeys(columns):
        if c.lower().startswith("cdl") or c.startswith(("is_stoch_", "market_regime_")) or "divergence" in c:
            out["unscaled"].append(c)
        if "regime" in c:
            out["regime"].append(c)
        elif c.startswith("s_") or "_tb_" in c:
            out["short"].append(c)
        elif c.startswith("m_"):
            out["medium"].append(c)
        elif c.startswith("l_"):
            out["long"].append(c)
    return out
