"""Season and trend by loess (Cleveland and others, 1990), robust against outliers, of one series in numpy.

A local line through the q nearest points, weighted by tricube distance, is a weighted mean of the values; as the places are the same
in every round, distances are found once and only the robustness weights change.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def odd(x: float) -> int:
    """The least odd number that is not below x."""
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


@lru_cache(maxsize=64)
def near(n: int, q: int, before: int, behind: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, n) tricube weights and signed distances of points 0..n-1 from the places -before..n-1+behind."""
    at, x = np.arange(-before, n + behind), np.arange(n)
    off = x[None, :] - at[:, None]
    # The window of q points that lies about each place, pushed inside at the ends.
    left = np.clip(at - (q - 1) // 2, 0, max(n - q, 0))
    right = np.minimum(left + q - 1, n - 1)
    h = np.maximum(at - left, right - at).astype(float) + (q - n) // 2 * (q > n)
    r = np.abs(off) / np.maximum(h, 1e-12)[:, None]
    inside = (x[None, :] >= left[:, None]) & (x[None, :] <= right[:, None])
    w = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - r**3) ** 3, 0.0)) * inside
    return w, off


def loess(y: np.ndarray, q: int, robust: np.ndarray | None = None, before: int = 0, behind: int = 0) -> np.ndarray:
    """Local lines at every point, and so many places before and behind."""
    n = len(y)
    w, off = near(n, q, before, behind)
    w = w if robust is None else w * robust
    total = w.sum(1)
    fine = total > 0
    w = w / np.where(fine, total, 1)[:, None]
    mean = (w * off).sum(1)
    spread = (w * off * off).sum(1) - mean * mean
    out = w @ y
    # Too narrow a spread gives the weighted mean.
    tilt = np.sqrt(np.maximum(spread, 0)) > 0.001 * (n - 1)
    slope = ((w * off) @ y - mean * out) / np.where(tilt, spread, 1)
    out = np.where(tilt, out - slope * mean, out)
    places = np.clip(np.arange(-before, n + behind), 0, n - 1)
    return np.where(fine, out, y[places])


def moving(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.ones(n) / n, "valid")


def decompose(y: np.ndarray, season: int, smooth: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and rest of a series without gaps of two seasons at least; outer rounds weigh points down by their rest."""
    n = len(y)
    if season < 2 or n < 2 * season:
        raise ValueError("two whole seasons are needed")
    of_trend, low = odd(1.5 * season / (1 - 1.5 / smooth)), odd(season + 1)
    trend, seasonal, robust = np.zeros(n), np.zeros(n), None
    for k in range(outer + 1):
        for _ in range(inner):
            free = y - trend
            cycle = np.zeros(n + 2 * season)
            for phase in range(season):
                own = None if robust is None else robust[phase::season]
                cycle[phase::season] = loess(free[phase::season], smooth, own, 1, 1)
            level = loess(moving(moving(moving(cycle, season), season), 3), low)
            seasonal = cycle[season : season + n] - level
            trend = loess(y - seasonal, of_trend, robust)
        rest = np.abs(y - trend - seasonal)
        h = 6 * np.median(rest)
        if k == outer or h <= 0:
            break
        r = rest / h
        robust = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - r * r) ** 2, 0.0))
    return trend, seasonal, y - trend - seasonal
