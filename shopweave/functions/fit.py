"""Small numpy models of one series; Spark deals the series, each fit sees one.

The seasonal model is (1 - a B)(1 - b B^s)(w - m) = (1 + theta B) e, where w is y or its differences, which have no m; a and
theta may be left out. It is fitted by conditional least squares over a grid that is then refined; a full likelihood would
give close, not equal, parameters.
"""

from __future__ import annotations

from itertools import product

import numpy as np

from shopweave.functions import stl

LIMIT = 0.98


def interpolate(values: np.ndarray) -> np.ndarray:
    """Gaps between known values along lines; gaps at the ends are cut off."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return values[:0]
    inside = np.arange(known[0], known[-1] + 1)
    return np.interp(inside, known, values[known])


def residuals(w: np.ndarray, season: int, a: float, b: float, theta: float = 0.0, p: int = 1, constant: bool = True) -> tuple[np.ndarray, float]:
    """e and the constant c = (1 - a)(1 - b) m that makes their mean nought (without theta); before the first e stands nought."""
    at = np.arange(season + p, len(w))
    u = w[at] - b * w[at - season]
    if p:
        u = u - a * w[at - 1] + a * b * w[at - season - 1]
    c = float(u.mean()) if constant else 0.0
    e = u - c
    if theta:
        last = 0.0
        for t in range(len(e)):
            last = e[t] = e[t] - theta * last
    return e, c


def fit_seasonal(values: np.ndarray, season: int, p: int = 1, d: int = 0, q: int = 0) -> dict | None:
    """a, b, theta, constant, last residual, error variance and scale of a series without gaps; None if it is too short.

    p, d and q are 0 or 1; a constant stands with d = 0 only.
    """
    scale = float(np.mean(np.abs(values))) or 1.0
    w = np.diff(values / scale, n=d)
    if len(w) < season + 4:
        return None
    free = [i for i, used in enumerate((p, 1, q)) if used]

    def whole(x: tuple[float, ...]) -> list[float]:
        out = [0.0] * 3
        for i, v in zip(free, x, strict=True):
            out[i] = v
        return out

    def cost(x: tuple[float, ...]) -> float:
        return float(np.square(residuals(w, season, *whole(x), p, d == 0)[0]).sum())

    best = min(product(np.linspace(-0.9, 0.9, 7), repeat=len(free)), key=cost)
    step = 0.15
    while step > 1e-4:
        near = [tuple(float(np.clip(v + i * step, -LIMIT, LIMIT)) for v, i in zip(best, move, strict=True)) for move in product((-1, 0, 1), repeat=len(free))]
        new = min(near, key=cost)
        if cost(new) < cost(best) - 1e-15:
            best = new
        else:
            step /= 2
    a, b, theta = whole(best)
    e, c = residuals(w, season, a, b, theta, p, d == 0)
    return {"a": a, "b": b, "theta": theta, "d": d, "c": c, "last": float(e[-1]), "variance": float(np.square(e).sum() / max(1, len(e) - len(free) - (d == 0))), "scale": scale}


def forecast_seasonal(values: np.ndarray, season: int, fit: dict, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and their standard errors."""
    y = values / fit["scale"]
    w = list(np.diff(y, n=fit["d"]))
    a, b, theta = fit["a"], fit["b"], fit["theta"]
    psi = np.zeros(steps)
    for k in range(steps):
        w.append(fit["c"] + a * w[-1] + b * w[-season] - a * b * w[-season - 1] + (theta * fit["last"] if k == 0 else 0.0))
        psi[k] = 1.0 if k == 0 else a * psi[k - 1] + (b * psi[k - season] if k >= season else 0) - (a * b * psi[k - season - 1] if k > season else 0) + (theta if k == 1 else 0.0)
    ahead = np.array(w[-steps:])
    if fit["d"]:
        ahead, psi = y[-1] + np.cumsum(ahead), np.cumsum(psi)
    se = np.sqrt(fit["variance"] * np.cumsum(psi**2))
    return ahead * fit["scale"], se * fit["scale"]


def decompose(values: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Trend, season and rest by robust loess; two whole seasons are needed."""
    return stl.decompose(values, season) if len(values) >= 2 * season else None


def seasonal_strength(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """How much of what the trend leaves is season, from nought to one."""
    _, seasonal, rest = parts
    whole = float(np.var(seasonal + rest))
    return min(1.0, max(0.0, 1 - float(np.var(rest)) / whole)) if whole > 1e-12 else 0.0


def repetition(values: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray], season: int) -> float:
    """Correlation of the values, less their trend, with those of a season before."""
    rest = values - parts[0]
    before, after = rest[:-season], rest[season:]
    return float(np.corrcoef(before, after)[0, 1]) if min(before.std(), after.std()) > 1e-12 else 0.0


def cycle(values: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None, season: int) -> tuple[float, float] | None:
    """Period and share of the strongest frequency that no calendar explains, of the values less season and straight line.

    Periods from 4 to a third of the series count, but those within a fifth of the season; three seasons, 24 values at least, are needed.
    """
    n = len(values)
    if parts is None or n < max(24, 3 * season):
        return None
    t = np.arange(n) - (n - 1) / 2
    slope = float(t @ values) / float(t @ t)
    rest = values - parts[1] - values.mean() - slope * t
    if rest.std() <= 1e-8:
        return None
    power = np.abs(np.fft.rfft(rest))[1:] ** 2
    period = n / np.arange(1, len(power) + 1)
    due = np.flatnonzero((period >= 4) & (period <= n / 3) & (np.abs(period - season) > 0.2 * season))
    if not len(due) or not power.sum():
        return None
    k = due[power[due].argmax()]
    return float(period[k]), float(power[k] / power.sum())


def trend(values: np.ndarray) -> tuple[float, float, float]:
    """Slope, r squared and two-sided p of a straight line."""
    n = len(values)
    t = np.arange(n) - (n - 1) / 2
    slope = float((t @ values) / (t @ t))
    total = float(np.square(values - values.mean()).sum())
    r2 = min(1.0, slope**2 * float(t @ t) / total) if total else 0.0
    if r2 >= 1 or n < 3:
        return slope, r2, 0.0 if r2 >= 1 else 1.0
    # P(|T| > t) with n - 2 degrees of freedom is I_x((n - 2) / 2, 1 / 2) at x = 1 - r2.
    return slope, r2, incomplete_beta((n - 2) / 2, 0.5, 1 - r2)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by integrating u^(a-1)(1-u)^(b-1) after u = 1 - s^2, which is smooth for b = 1/2."""
    from math import lgamma

    if b != 0.5:
        raise ValueError("only for b = 1/2")
    s = np.linspace(np.sqrt(1 - x), 1, 4001)
    f = (1 - s**2).clip(0) ** (a - 1) if a != 1 else np.ones_like(s)
    area = float(((f[:-1] + f[1:]) / 2 * np.diff(s)).sum()) * 2
    return min(1.0, area * float(np.exp(lgamma(a + b) - lgamma(a) - lgamma(b))))
