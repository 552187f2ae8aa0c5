"""The seasonal model (1 - a B)(1 - b B^s)(y - m) = e fitted to many series at once.

With four lagged copies of a series, less their means, the squared error is a quadratic form in (1, -a, -b, ab), so a fit needs one
pass over a series (its 4 x 4 matrix of products) and no pass for a guess of a and b: for each b the best a is closed form, and b is
searched over a grid that is then refined. Series of one length are one array; nothing loops over time but the forecast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT = 0.98
#: From nought outwards, so that series that tell nothing of b get none.
GRID = np.array(sorted(np.linspace(-LIMIT, LIMIT, 99), key=abs))
#: Fewer residuals than this tell nothing of a season.
LEAST = 4


@dataclass
class Fits:
    """Parameters of k series, a row each; usable is false where a series is too short."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    variance: np.ndarray
    usable: np.ndarray


def lagged(values: np.ndarray, season: int) -> np.ndarray:
    """(k, 4, m): y(t), y(t - 1), y(t - s), y(t - s - 1) of k series."""
    n = values.shape[1]
    return np.stack([values[:, season + 1 - lag : n - lag] for lag in (0, 1, season, season + 1)], axis=1)


def error(g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squared error at each b (k, j) and the a that gives it, from products g (k, 4, 4)."""
    at = lambda i, j: g[:, i, j][:, None]
    own = at(0, 0) - 2 * b * at(0, 2) + b * b * at(2, 2)
    cross = at(0, 1) - b * (at(0, 3) + at(1, 2)) + b * b * at(2, 3)
    before = at(1, 1) - 2 * b * at(1, 3) + b * b * at(3, 3)
    a = np.clip(np.divide(cross, before, out=np.zeros_like(cross), where=before > 1e-12), -LIMIT, LIMIT)
    return own - 2 * a * cross + a * a * before, a


def searched(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and the squared error of each series."""
    grid, step = np.broadcast_to(GRID, (len(g), len(GRID))), GRID.max() / 49
    for _ in range(5):
        cost, a = error(g, grid)
        # A flat error must not drift away from nought by rounding.
        best = (cost > cost.min(1, keepdims=True) + 1e-12 * np.abs(g[:, 0, 0])[:, None]).argmin(1)
        rows = np.arange(len(g))
        b, out = grid[rows, best], (a[rows, best], cost[rows, best])
        step /= 5
        grid = np.clip(b[:, None] + step * np.array([0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5]), -LIMIT, LIMIT)
    return out[0], b, np.maximum(out[1], 0)


def fit(values: np.ndarray, season: int) -> Fits:
    """Fits of k series of one length without gaps (k, n), already scaled; with too few seasons b is nought, y(t - 1) alone explaining y(t)."""
    k, n = values.shape
    m = n - season - 1
    if m >= LEAST:
        x = lagged(values, season)
        mean = x.mean(2)
        x = x - mean[:, :, None]
        a, b, cost = searched(np.einsum("kim,kjm->kij", x, x))
        c = mean[:, 0] - b * mean[:, 2] - a * (mean[:, 1] - b * mean[:, 3])
        return Fits(a, b, c, cost / max(1, m - 3), np.ones(k, bool))
    if n < 3:
        return Fits(*(np.zeros(k) for _ in range(4)), np.zeros(k, bool))
    now, before = values[:, 1:], values[:, :-1]
    u, w = now - now.mean(1, keepdims=True), before - before.mean(1, keepdims=True)
    square = (w * w).sum(1)
    a = np.clip(np.divide((u * w).sum(1), square, out=np.zeros(k), where=square > 1e-12), -LIMIT, LIMIT)
    e = u - a[:, None] * w
    return Fits(a, np.zeros(k), now.mean(1) - a * before.mean(1), (e * e).sum(1) / max(1, n - 3), np.ones(k, bool))


def ahead(values: np.ndarray, fits: Fits, season: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and their standard errors (k, steps)."""
    k, n = values.shape
    y = np.concatenate([values, np.zeros((k, steps))], axis=1)
    psi = np.zeros((k, steps))
    for t in range(steps):
        at = n + t
        y[:, at] = fits.c + fits.a * y[:, at - 1]
        psi[:, t] = 1.0 if t == 0 else fits.a * psi[:, t - 1]
        if at - season - 1 >= 0:
            y[:, at] += fits.b * (y[:, at - season] - fits.a * y[:, at - season - 1])
        if t >= season:
            psi[:, t] += fits.b * (psi[:, t - season] - (fits.a * psi[:, t - season - 1] if t > season else 0))
    return y[:, n:], np.sqrt(fits.variance[:, None] * np.cumsum(psi * psi, axis=1))


def inner(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A series from its first known value to its last, gaps along lines, and how many unknown values stand behind it."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return values[:0], len(values)
    at = np.arange(known[0], known[-1] + 1)
    return np.interp(at, known, values[known]), len(values) - 1 - int(known[-1])


def same(*numbers: np.ndarray):
    """The rows of each different combination of these numbers, which are none of them negative."""
    if not len(numbers[0]):
        return
    key = np.ravel_multi_index(numbers, [int(n.max()) + 1 for n in numbers])
    order = np.argsort(key, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(key[order])) + 1)


def ahead_of(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, season: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each series flat[start : start + length] (nan: unknown) predictions behind its last bucket, known or not, their standard errors
    (k, steps), and whether it could be fitted (k).

    Values are divided by their mean, or by one where that is more; predictions are never below nought.
    """
    k = len(starts)
    mean, se, fine = np.full((k, steps), np.nan), np.full((k, steps), np.nan), np.zeros(k, bool)
    known = ~np.isnan(flat)
    places, before = np.flatnonzero(known), np.append(0, np.cumsum(known))
    seen = np.flatnonzero(before[starts + lengths] > before[starts])
    first, last = places[before[starts[seen]]], places[before[(starts + lengths)[seen]] - 1]
    size, over = last - first + 1, (starts + lengths)[seen] - 1 - last
    gaps = before[last + 1] - before[first] < size
    unit = np.empty(len(seen))
    for own in same(lengths[seen]):
        y = np.abs(flat[starts[seen[own]][:, None] + np.arange(lengths[seen[own[0]]])])
        unit[own] = np.maximum(np.where(np.isnan(y), 0, y).sum(1) / (~np.isnan(y)).sum(1), 1.0)
    for own in same(size, over):
        n, behind = int(size[own[0]]), int(over[own[0]])
        if n < 3:
            continue
        y = flat[first[own][:, None] + np.arange(n)]
        for i in np.flatnonzero(gaps[own]).tolist():
            y[i] = inner(y[i])[0]
        scale = unit[own][:, None]
        found = fit(y / scale, season)
        m, s = ahead(y / scale, found, season, behind + steps)
        m, s = m[:, behind:], s[:, behind:]
        rows = seen[own]
        fine[rows] = found.usable & np.isfinite(m).all(1) & np.isfinite(s).all(1)
        mean[rows], se[rows] = np.maximum(m * scale, 0.0), s * scale
    return mean, se, fine


def forecasts(series: list[np.ndarray], season: int, steps: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """As ahead_of, for each series (predictions, standard errors), or None where it cannot be fitted."""
    bounds = np.append(0, np.cumsum([len(s) for s in series])).astype(np.int64)
    mean, se, fine = ahead_of(np.concatenate([np.zeros(0), *series]), bounds[:-1], np.diff(bounds), season, steps)
    return [(m, s) if f else None for m, s, f in zip(mean, se, fine, strict=True)]
