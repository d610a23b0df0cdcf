"""Indicators with a finite window, as window expressions.

Every column is NULL until its window is full; windows restart with the series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.config import indicator
from ..functions.core import finite, flag, full, log_return, ratio, sample_kurtosis, sample_skew

O, H, L, C, V = "open", "high", "low", "close", "volume"


@indicator("logs")
def logs(w: WindowSpec, columns=("volume", "dollar_volume")) -> dict[str, Column]:
    return {f"{c}_log": F.log1p(F.col(c)) for c in columns}


@indicator("log_return")
def log_returns(w: WindowSpec, columns=("close", "high", "low")) -> dict[str, Column]:
    return {f"log_return_{c}": log_return(c, w) for c in columns}


@indicator("price_ratios")
def price_ratios(w: WindowSpec) -> dict[str, Column]:
    span, body = F.col(H) - F.col(L), F.abs(F.col(O) - F.col(C))
    return {
        "price_change_pct": ratio(F.col(C) - F.col(O), O), "high_low_pct": ratio(span, L),
        "wick_vs_range": F.when(span > 0, (span - body) / span).otherwise(0.0), "body_vs_range": F.when(span > 0, body / span).otherwise(0.0),
        "close_vs_high_pct": ratio(F.col(C) - F.col(H), H), "close_vs_low_pct": ratio(F.col(C) - F.col(L), L),
    }


@indicator("relative")
def relative(w: WindowSpec, atr: int = 14) -> dict[str, Column]:
    a = simple_atr(w, atr) + 1e-9
    oc, hl = F.col(C) - F.col(O), F.col(H) - F.col(L)
    s5, s20 = full(F.avg, V, 5, w), full(F.avg, V, 20, w)
    return {
        "vwap_bar": ratio("dollar_volume", V), "close_open_diff": oc, "high_low_diff": hl, "close_open_diff_atr": oc / a, "high_low_diff_atr": hl / a,
        "volume_oscillator": ratio(s5 - s20, s20) * 100,
    }


@indicator("sma")
def sma(w: WindowSpec, n: int, column: str = C) -> dict[str, Column]:
    return {f"sma_{n}" if column == C else f"{column}_sma_{n}": full(F.avg, column, n, w)}


@indicator("bbands")
def bbands(w: WindowSpec, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = full(F.avg, C, n, w), full(F.stddev_pop, C, n, w)
    up, low = mid + k * sd, mid - k * sd
    return {f"bb_upper_{n}": up, f"bb_middle_{n}": mid, f"bb_lower_{n}": low, f"bb_width_{n}": ratio(up - low, mid), f"bb_percent_b_{n}": ratio(F.col(C) - low, up - low)}


@indicator("stddev")
def stddev(w: WindowSpec, n: int, base: Column | None = None) -> dict[str, Column]:
    return {f"stddev_{n}": full(F.stddev_pop, "lr", n, w), f"volatility_{n}": full(F.stddev_samp, "lr", n, w), f"volatility_hl_{n}": full(F.stddev_samp, "hl", n, w)}


@indicator("cci")
def cci(w: WindowSpec, n: int = 20) -> dict[str, Column]:
    tp = (F.col(H) + F.col(L) + F.col(C)) / 3.0
    mid = full(F.avg, tp, n, w)
    frame = F.collect_list(tp).over(w.rowsBetween(-(n - 1), 0))
    spread = F.aggregate(frame, F.lit(0.0), lambda acc, x: acc + F.abs(x - mid)) / n
    return {f"cci_{n}": ratio(tp - mid, 0.015 * spread)}


@indicator("roc")
def roc(w: WindowSpec, n: int = 10) -> dict[str, Column]:
    return {f"roc_{n}": (ratio(C, F.lag(C, n).over(w)) - 1) * 100}


@indicator("willr")
def willr(w: WindowSpec, n: int = 14) -> dict[str, Column]:
    top, low = full(F.max, H, n, w), full(F.min, L, n, w)
    return {f"willr_{n}": ratio(top - F.col(C), top - low) * -100}


@indicator("lags")
def lags(w: WindowSpec, columns=(C, V), ks=(1, 2, 3)) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in ks}


@indicator("rolling")
def rolling(w: WindowSpec, n: int, column: str = C, stats=("mean", "std", "min", "max", "skew", "kurt")) -> dict[str, Column]:
    frame = w.rowsBetween(-(n - 1), 0)
    made = {
        "mean": lambda: full(F.avg, column, n, w), "std": lambda: full(F.stddev_samp, column, n, w), "min": lambda: full(F.min, column, n, w), "max": lambda: full(F.max, column, n, w),
        "skew": lambda: F.when(F.count(column).over(frame) == n, finite(sample_skew(F.col(column), n, lambda x: x.over(frame)))),
        "kurt": lambda: F.when(F.count(column).over(frame) == n, finite(sample_kurtosis(F.col(column), n, lambda x: x.over(frame)))),
    }
    unknown = set(stats) - set(made)
    if unknown:
        raise KeyError(f"unknown statistics {sorted(unknown)}")
    return {f"{column}_{s}_{n}": made[s]() for s in stats}


@indicator("calendar")
def calendar(w: WindowSpec, column: str = "ts") -> dict[str, Column]:
    t = F.col(column)
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)

    def wave(name, value, period):
        angle = 2 * math.pi * value / period
        return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}

    return {
        "hour": hour, "dayofweek": dow, "day": F.dayofmonth(t), "week": F.weekofyear(t), "month": month, "is_weekend": (dow >= 5).cast("int"),
        **wave("hour", hour, 24.0), **wave("dow", dow, 7.0), **wave("month", month, 12.0),
    }


def true_range(w: WindowSpec) -> Column:
    before = F.lag(C).over(w)
    return F.when(before.isNotNull(), F.greatest(F.col(H) - F.col(L), F.abs(F.col(H) - before), F.abs(F.col(L) - before)))


def simple_atr(w: WindowSpec, n: int) -> Column:
    """Mean of the true ranges of the last ``n`` bars, where all are known; the true range is a column ``tr``."""
    return full(F.avg, "tr", n, w)


# --- indicators over other window columns take two projections


def with_returns(bars: DataFrame, w: WindowSpec) -> DataFrame:
    hl = F.when((F.col(L) > 1e-9) & (F.col(H) > 0), F.ln(F.col(H) / F.col(L)))
    return bars.withColumns({"lr": log_return(C, w), "hl": hl, "tr": true_range(w)})


def mfi(bars: DataFrame, w: WindowSpec, n: int = 14) -> DataFrame:
    """Money flow index: volume-weighted rises and falls of the typical price over ``n`` changes."""
    tp = (F.col(H) + F.col(L) + F.col(C)) / 3.0
    step = tp - F.lag(tp).over(w)
    flow = tp * F.col(V)
    moved = bars.withColumns({"up_flow": F.when(step > 0, flow).when(step.isNotNull(), 0.0), "down_flow": F.when(step < 0, flow).when(step.isNotNull(), 0.0)})
    up, down = full(F.sum, "up_flow", n, w), full(F.sum, "down_flow", n, w)
    return moved.withColumn(f"mfi_{n}", ratio(up, up + down) * 100).drop("up_flow", "down_flow")


def stochastic(bars: DataFrame, w: WindowSpec, fast: int = 14, slow: int = 3, signal: int = 3) -> DataFrame:
    """Slow %K and %D with simple means, and their zone flags."""
    low, top = full(F.min, L, fast, w), full(F.max, H, fast, w)
    raw = bars.withColumn("raw_k", ratio(F.col(C) - low, top - low) * 100)
    k = raw.withColumn("stoch_k", full(F.avg, "raw_k", slow, w))
    d = k.withColumn("stoch_d", full(F.avg, "stoch_k", signal, w)).drop("raw_k")
    return d.withColumns({"is_stoch_os_20": flag(F.col("stoch_k") < 20), "is_stoch_ob_80": flag(F.col("stoch_k") > 80)})


def ultimate(bars: DataFrame, w: WindowSpec, n1: int = 7, n2: int = 14, n3: int = 28) -> DataFrame:
    before = F.lag(C).over(w)
    floor = F.least(F.col(L), before)
    base = bars.withColumns({"bp": F.when(before.isNotNull(), F.col(C) - floor), "rng": F.when(before.isNotNull(), F.greatest(F.col(H), before) - floor)})
    a, b, c = (ratio(full(F.sum, "bp", n, w), full(F.sum, "rng", n, w)) for n in (n1, n2, n3))
    return base.withColumn("ultosc", 100 * (4 * a + 2 * b + c) / 7).drop("bp", "rng")


def obv(bars: DataFrame, w: WindowSpec) -> DataFrame:
    """On-balance volume from the first bar's volume on."""
    step = F.col(C) - F.lag(C).over(w)
    signed = F.when(step.isNull(), F.col(V)).otherwise(F.signum(step) * F.col(V))
    from pyspark.sql import Window

    return bars.withColumn("signed", signed).withColumn("obv", F.sum("signed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("signed")


def simple_rsi(bars: DataFrame, w: WindowSpec, n: int = 14) -> DataFrame:
    """Relative strength from plain means of the last ``n`` gains and losses."""
    step = F.col(C) - F.lag(C).over(w)
    moved = bars.withColumns({"gain": F.greatest(step, F.lit(0.0)), "loss": F.greatest(-step, F.lit(0.0))})
    moved = moved.withColumns({"gain": F.when(step.isNotNull(), F.col("gain")), "loss": F.when(step.isNotNull(), F.col("loss"))})
    up, down = full(F.avg, "gain", n, w), full(F.avg, "loss", n, w)
    return moved.withColumn(f"rsi_simple_{n}", ratio(up, up + down) * 100).drop("gain", "loss")


def regimes(bars: DataFrame) -> DataFrame:
    """Trend states of ``ema_fast`` against ``ema_slow`` and ``adx``; missing comparisons are 0."""
    up, down, strong = F.col("ema_fast") > F.col("ema_slow"), F.col("ema_fast") < F.col("ema_slow"), F.col("adx") > 25
    return bars.withColumns({
        "regime_strong_up": flag(up & strong), "regime_weak_up": flag(up & ~strong), "regime_strong_down": flag(down & strong), "regime_weak_down": flag(down & ~strong), "regime_ranging": flag(~strong),
    })
