"""Indicators with infinite memory.

Each value depends on the one before, so a window can't express them.  One
grouped pass per series computes all that are asked for; series (and months,
where a pipeline restarts there) run in parallel.  Formulas follow the published
definitions: means of the first rows as seeds, Wilder's smoothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ema(x: np.ndarray, n: int, start: int = 0, seed_rows: int | None = None) -> np.ndarray:
    """Exponential mean with the mean of the ``n`` rows up to row ``start + n - 1`` as seed."""
    out = np.full(len(x), np.nan)
    first = start + n - 1
    if first >= len(x):
        return out
    a = 2.0 / (n + 1)
    out[first] = value = x[start : first + 1].mean()
    for i in range(first + 1, len(x)):
        value += a * (x[i] - value)
        out[i] = value
    return out


def macd(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram; both means start together at row ``slow - 1``, output starts at ``slow + signal - 2``."""
    line = ema(x, fast, slow - fast) - ema(x, slow)
    mark = np.full(len(x), np.nan)
    if len(x) >= slow + signal - 1:
        mark[slow - 1 :] = ema(line[slow - 1 :], signal)
    line = np.where(np.isnan(mark), np.nan, line)
    return line, mark, line - mark


def wilder(x: np.ndarray, n: int, first: int) -> np.ndarray:
    """Wilder's mean of ``x[first:]``, seeded with the mean of its first ``n`` values."""
    out = np.full(len(x), np.nan)
    at = first + n - 1
    if at >= len(x):
        return out
    out[at] = value = x[first : at + 1].mean()
    for i in range(at + 1, len(x)):
        value = (value * (n - 1) + x[i]) / n
        out[i] = value
    return out


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(b != 0, a / b, np.nan)


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    step = np.diff(close, prepend=np.nan)
    up, down = wilder(np.maximum(step, 0), n, 1), wilder(np.maximum(-step, 0), n, 1)
    return 100 * np.where((up + down) == 0, 0.0, _divide(up, up + down)) + 0 * up


def ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def atr(high, low, close, n: int) -> np.ndarray:
    return wilder(ranges(high, low, close), n, 1)


def directional(high, low, close, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX."""
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = wilder(np.where((up > down) & (up > 0), up, 0.0), n, 1)
    minus = wilder(np.where((down > up) & (down > 0), down, 0.0), n, 1)
    tr = wilder(ranges(high, low, close), n, 1)
    pdi, mdi = 100 * _divide(plus, tr), 100 * _divide(minus, tr)
    dx = 100 * _divide(np.abs(pdi - mdi), pdi + mdi)
    return pdi, mdi, wilder(np.where(np.isnan(dx), 0.0, dx), n, n)


def hilbert(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Instantaneous trend line, sine and lead sine from the dominant cycle of a Hilbert transform; 63 rows of warm-up."""
    n = len(x)
    trend, sine, lead = (np.full(n, np.nan) for _ in range(3))
    smooth, detrended, q1, i1, ji, jq, i2, q2, re, im, period, smooth_period = (np.zeros(n) for _ in range(12))

    def transform(v, i, p):
        return (0.0962 * v[i] + 0.5769 * v[i - 2] - 0.5769 * v[i - 4] - 0.0962 * v[i - 6]) * (0.075 * p + 0.54)

    lines = np.zeros(n)
    for i in range(6, n):
        smooth[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
        p = period[i - 1]
        detrended[i] = transform(smooth, i, p)
        q1[i], i1[i] = transform(detrended, i, p), detrended[i - 3]
        ji[i], jq[i] = transform(i1, i, p), transform(q1, i, p)
        i2[i] = 0.2 * (i1[i] - jq[i]) + 0.8 * i2[i - 1]
        q2[i] = 0.2 * (q1[i] + ji[i]) + 0.8 * q2[i - 1]
        re[i] = 0.2 * (i2[i] * i2[i - 1] + q2[i] * q2[i - 1]) + 0.8 * re[i - 1]
        im[i] = 0.2 * (i2[i] * q2[i - 1] - q2[i] * i2[i - 1]) + 0.8 * im[i - 1]
        cycle = 2 * np.pi / np.arctan(im[i] / re[i]) if re[i] and im[i] else p
        cycle = min(max(cycle, 0.67 * p), 1.5 * p) if p else cycle
        period[i] = 0.2 * min(max(cycle, 6.0), 50.0) + 0.8 * p
        smooth_period[i] = 0.33 * period[i] + 0.67 * smooth_period[i - 1]
        span = int(smooth_period[i] + 0.5)
        if span < 1 or i < span:
            continue
        lines[i] = x[i - span + 1 : i + 1].mean()
        k = np.arange(span)
        angle = 2 * np.pi * k / span
        a, b = (np.sin(angle) * smooth[i - k]).sum(), (np.cos(angle) * smooth[i - k]).sum()
        phase = np.degrees(np.arctan2(a, b)) + 90 + (360 / smooth_period[i] if smooth_period[i] else 0)
        if i >= 63:
            trend[i] = (4 * lines[i] + 3 * lines[i - 1] + 2 * lines[i - 2] + lines[i - 3]) / 10
            sine[i], lead[i] = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
    return trend, sine, lead


def _columns(frame: pd.DataFrame, spec: dict) -> dict[str, np.ndarray]:
    h, low, c = (frame[k].to_numpy(float) for k in ("high", "low", "close"))
    out: dict[str, np.ndarray] = {}
    for kind, value in spec.items():
        if kind == "ema":
            out |= {f"ema_{n}": ema(c, n) for n in value}
        elif kind == "macd":
            out |= dict(zip(("macd", "macd_signal", "macd_hist"), macd(c, *value), strict=True))
        elif kind == "rsi":
            out |= {f"rsi_{n}": rsi(c, n) for n in value}
        elif kind == "atr":
            out |= {f"atr_{n}": atr(h, low, c, n) for n in value}
        elif kind == "natr":
            out |= {f"natr_{n}": 100 * _divide(atr(h, low, c, n), c) for n in value}
        elif kind == "adx":
            for n in value:
                out |= dict(zip((f"plus_di_{n}", f"minus_di_{n}", f"adx_{n}"), directional(h, low, c, n), strict=True))
        elif kind == "hilbert":
            out |= dict(zip(("ht_trendline", "ht_sine", "ht_leadsine"), hilbert(c), strict=True))
        else:
            raise KeyError(f"unknown recursive indicator {kind!r}")
    return out


def recursive(bars: DataFrame, spec: dict, *, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """Add the indicators of ``spec``, such as ``{"ema": [10], "macd": (12, 26, 9), "adx": [14]}``; NULL during warm-up."""
    probe = pd.DataFrame({c: [1.0, 2.0] for c in ("high", "low", "close")})
    names = list(_columns(probe, spec))
    schema = ", ".join(f"`{n}` {t}" for n, t in bars.dtypes) + "".join(f", `{n}` double" for n in names)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        made = _columns(frame, spec)
        return frame.assign(**{n: pd.Series(np.where(np.isfinite(v), v, np.nan), frame.index) for n, v in made.items()})

    from pyspark.sql import functions as F

    out = bars.groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def zones(bars: DataFrame, column: str) -> DataFrame:
    """Overbought, oversold and neutral flags of a relative strength."""
    from pyspark.sql import functions as F

    from ..functions.core import flag

    x = F.col(column)
    return bars.withColumns({f"{column}_ob": flag(x > 70), f"{column}_os": flag(x < 30), f"{column}_neutral": flag((x >= 30) & (x <= 70))})
