"""Comparators of one series: exponential level, damped trend, and ridge regression on six features, each one step ahead.

Given its rates, a smoothed series is a straight function of its first state, so the best first state is closed form (least squares),
and only the rates are searched: over a grid, all its points in one pass over time, then over finer grids about the best point.
"""

from __future__ import annotations

import calendar
from datetime import date
from itertools import product

import numpy as np

#: Bounds of the rates: level in (0, 1), trend below the level's, damping.
RATE, DAMPING = (1e-4, 0.9999), (0.8, 0.995)


def run(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared error and next value at each point (alpha, beta, phi) with the best first level and, where beta is given, first trend."""
    k, free = len(alpha), 1 if not beta.any() else 2
    # State as a + b l0 + c b0: parts are constant, coefficient of the first level, coefficient of the first trend.
    level, slope = np.zeros((k, 3)), np.zeros((k, 3))
    level[:, 1] = 1
    slope[:, 2] = 1 if free == 2 else 0
    g, target = np.zeros((k, free, free)), np.zeros((k, free))
    square = np.zeros(k)
    a, b, p = alpha[:, None], beta[:, None], phi[:, None]
    for value in y:
        guess = level + p * slope
        e = -guess
        e[:, 0] += value
        x = e[:, 1 : 1 + free]
        g += x[:, :, None] * x[:, None, :]
        target += x * e[:, :1]
        square += e[:, 0] ** 2
        new = guess + a * e
        slope = b * (new - level) + (1 - b) * p * slope
        level = new
    first = -np.linalg.solve(g + 1e-12 * np.trace(g, axis1=1, axis2=2)[:, None, None] * np.eye(free), target[:, :, None])[:, :, 0]
    cost = square + 2 * (first * target).sum(1) + np.einsum("ki,kij,kj->k", first, g, first)
    after = level + p * slope
    return cost, after[:, 0] + (after[:, 1 : 1 + free] * first).sum(1)




def searched(y: np.ndarray, axes: list[tuple[float, float]], rates, points: int, rounds: int = 6) -> float:
    """The next value at the point of least error; rates turns a point of the axes into (alpha, beta, phi)."""
    spans, best = list(axes), None
    for _ in range(rounds):
        grid = np.array(list(product(*[np.linspace(lo, hi, points) for lo, hi in spans])))
        cost, value = run(y, *rates(grid))
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (float(cost[k]), float(value[k]), grid[k])
        steps = [(hi - lo) / (points - 1) for lo, hi in spans]
        spans = [(max(lo, c - s), min(hi, c + s)) for (lo, hi), c, s in zip(axes, best[2], steps, strict=True)]
    return best[1]


def level(values: np.ndarray) -> float:
    """Simple exponential smoothing: its last level."""
    scale = max(float(values.mean()), 1.0)
    none = lambda g: (g[:, 0], np.zeros(len(g)), np.zeros(len(g)))
    return searched(values / scale, [RATE], none, 41) * scale


def damped(values: np.ndarray) -> float:
    """A trend that is damped: level and trend one step ahead; the trend's rate is a share of the level's."""
    scale = max(float(values.mean()), 1.0)
    rates = lambda g: (g[:, 0], g[:, 0] * g[:, 1], g[:, 2])
    return searched(values / scale, [RATE, RATE, DAMPING], rates, 9) * scale


def features(history: np.ndarray, target: date) -> list[float]:
    """Last value, mean of three, last change, the month on a circle, its days."""
    phase = 2 * np.pi * target.month / 12
    return [history[-1], float(history[-3:].mean()), history[-1] - history[-2], float(np.sin(phase)), float(np.cos(phase)), calendar.monthrange(target.year, target.month)[1]]


def ridge(values: np.ndarray, months: list[date], penalty: float) -> float:
    """Ridge regression on standardised features: values of months[:-1], the last month being predicted."""
    x = np.array([features(values[:i], months[i]) for i in range(3, len(values))])
    y = values[3:]
    centre, spread = x.mean(0), x.std(0)
    spread[spread < 1e-8] = 1.0
    z = (x - centre) / spread
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return float(y.mean() + (np.array(features(values, months[-1])) - centre) / spread @ w)
