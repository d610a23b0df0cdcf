"""Peaks, divergences and volume profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .recursive import rsi


def prominence(x: np.ndarray, at: int) -> float:
    """Height of a peak above the higher of the two lowest points between it and higher ground."""
    left = at
    low_left = x[at]
    while left > 0 and x[left - 1] <= x[at]:
        left -= 1
        low_left = min(low_left, x[left])
    right = at
    low_right = x[at]
    while right < len(x) - 1 and x[right + 1] <= x[at]:
        right += 1
        low_right = min(low_right, x[right])
    return float(x[at] - max(low_left, low_right))


def find_peaks(x: np.ndarray, distance: int = 1, least: float = 0.0) -> np.ndarray:
    """Rows above both neighbours (the middle of a flat top), the higher one first wherever two are nearer than ``distance``, of at least that prominence."""
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            end = i
            while end < len(x) - 1 and x[end + 1] == x[i]:
                end += 1
            if end < len(x) - 1 and x[end + 1] < x[i]:
                found.append((i + end) // 2)
            i = end + 1
        else:
            i += 1
    keep: list[int] = []
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if all(abs(p - k) >= distance for k in keep):
            keep.append(p)
    return np.array([p for p in sorted(keep) if prominence(x, p) >= least], int)


def diverging(price: np.ndarray, mark: np.ndarray, peaks: np.ndarray, mark_peaks: np.ndarray, reach: int) -> list[int]:
    """Peaks for which an earlier peak at most ``reach`` bars back has a lower price and a higher mark.

    The marks are those of the indicator's peaks nearest to the two (the earlier
    of two as near), which must differ and each be less than half of ``reach`` away.
    """
    if not len(mark_peaks):
        return []
    near = np.array([mark_peaks[np.argmin(np.abs(mark_peaks - p))] for p in peaks], int)
    aligned = np.abs(near - peaks) < reach / 2
    out = []
    for i in range(1, len(peaks)):
        j = np.arange(np.searchsorted(peaks, peaks[i] - reach), i)
        if aligned[i] and ((price[peaks[j]] < price[peaks[i]]) & aligned[j] & (near[j] != near[i]) & (mark[near[j]] > mark[near[i]])).any():
            out.append(int(peaks[i]))
    return out


def divergences(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), order: str = "ts", n: int = 14, distance: int = 5, share: float = 0.005, mark_least: float = 1.0, reach: int = 30) -> DataFrame:
    """Add ``is_high_peak``, ``is_low_peak``, ``bearish_divergence`` and ``bullish_divergence`` (0/1).

    Price peaks have a prominence of ``share`` of the mean price at least, those
    of the indicator (relative strength of ``n`` bars) of ``mark_least``.
        A peak is known only after the bars behind it: these flags look ahead.
    """
    names = ["is_high_peak", "is_low_peak", "bearish_divergence", "bullish_divergence"]
    schema = ", ".join(f"`{c}` {t}" for c, t in bars.dtypes) + "".join(f", {c} int" for c in names)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        high, low, mark = frame["high"].to_numpy(float), frame["low"].to_numpy(float), rsi(frame["close"].to_numpy(float), n)
        flags = {c: np.zeros(len(frame), np.int32) for c in names}
        tops, bottoms = find_peaks(high, distance, share * high.mean()), find_peaks(-low, distance, share * low.mean())
        flags["is_high_peak"][tops], flags["is_low_peak"][bottoms] = 1, 1
        flags["bearish_divergence"][diverging(high, mark, tops, find_peaks(mark, distance, mark_least), reach)] = 1
        flags["bullish_divergence"][diverging(-low, -mark, bottoms, find_peaks(-mark, distance, mark_least), reach)] = 1
        return frame.assign(**flags)

    return bars.groupBy(*keys).applyInPandas(run, schema)


def profile(low: np.ndarray, high: np.ndarray, volume: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of equal bins from the least low to the greatest high, and volume per bin; a bar's volume is spread evenly over its range.

    Bins that every bar covers hold the same volume up to the last bits, more of
    them than rounding to nine digits removes.  Edges, shares and sums therefore
    take the steps of the SQL one by one, the sums from the newest bar back, so
    the same bin is the fullest in both.
    """
    a, b = low.min(), high.max()
    if b <= a:
        return np.array([a, b]), np.array([volume.sum()])
    low, high, volume = low[::-1], high[::-1], volume[::-1]
    edges = a + (b - a) * np.arange(bins + 1) / bins
    flat = high <= low
    shared = np.maximum(np.minimum(high[:, None], edges[1:]) - np.maximum(low[:, None], edges[:-1]), 0)
    weight = np.divide(shared, (high - low)[:, None], out=np.zeros_like(shared), where=~flat[:, None])
    own = np.minimum(((low - a) / (b - a) * bins).astype(int), bins - 1)
    weight[flat, own[flat]] = 1.0
    # a running sum adds bar by bar, which neither a product of matrices nor a plain sum promises
    return edges, _half_up(np.cumsum(volume[:, None] * weight, axis=0)[-1], 9)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Non-negative numbers rounded, halves upward as in SQL."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


def value_area(edges: np.ndarray, volume: np.ndarray, outward: bool, share: float = 0.7) -> tuple[float, float, float]:
    """Middle of the fullest bin, and lower and upper end of the value area: grown outward from it, or the fullest bins."""
    if volume.sum() <= 0:
        return (np.nan,) * 3
    poc, goal = int(np.argmax(volume)), share * volume.sum()
    if outward:
        a = b = poc
        total = volume[poc]
        while total < goal:
            down, up = (volume[a - 1] if a > 0 else 0.0), (volume[b + 1] if b < len(volume) - 1 else 0.0)
            if up == down == 0:  # empty on both sides: the area ends here
                break
            if up >= down:
                b += 1
                total += up
            if down >= up:  # of equal neighbours both are taken
                a -= 1
                total += down
    else:
        order = np.argsort(-volume, kind="stable")
        n = int(np.searchsorted(np.cumsum(volume[order]), goal)) + 1
        a, b = int(order[:n].min()), int(order[:n].max())
    return float((edges[poc] + edges[poc + 1]) / 2), float(edges[a]), float(edges[b + 1])


def volume_profile(bars: DataFrame, n: int, bins: int, *, outward: bool = True, least: int | None = None, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """Add ``vp_poc``, ``vp_val`` and ``vp_vah`` of the last ``n`` bars, from ``least`` bars on (``n`` unless given)."""
    least = n if least is None else least
    names = [f"vp_{x}_{n}w_{bins}b" for x in ("poc", "val", "vah")]
    schema = ", ".join(f"`{c}` {t}" for c, t in bars.dtypes) + "".join(f", {c} double" for c in names)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        low, high, volume = (frame[c].to_numpy(float) for c in ("low", "high", "volume"))
        out = np.full((len(frame), 3), np.nan)
        for i in range(least - 1, len(frame)):
            a = max(0, i - n + 1)
            out[i] = value_area(*profile(low[a : i + 1], high[a : i + 1], volume[a : i + 1], bins), outward)
        return frame.assign(**{c: out[:, k] for k, c in enumerate(names)})

    from pyspark.sql import functions as F

    return bars.groupBy(*keys).applyInPandas(run, schema).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
