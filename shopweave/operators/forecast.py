"""Forecasts of many series in parallel: an Arrow batch of series, or a group of one series and one model."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.functions import batchfit, fit, smooth
from shopweave.operators.hierarchy import arrays, ineligible

MODELS = ("seasonal_12", "seasonal_6", "seasonal_4", "level", "damped", "ridge_10", "ridge_100")
#: Configurations by name: p, d, q, season, and the least training length of the earliest origin.
MONTHLY_SARIMA = {f"sarima_{p}{d}{q}_100_12": (p, d, q, 12, 18) for p, d, q in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 1, 1))}
WEEKLY_SARIMA = {f"weekly_sarima_{p}{d}{q}_100_52": (p, d, q, 52, 104) for p, d, q in ((0, 1, 0), (1, 0, 0), (0, 1, 1))}
SARIMA = MONTHLY_SARIMA | WEEKLY_SARIMA


def one_step(values: np.ndarray, model: str, months: list[date] | None = None) -> float | None:
    """The next value by a model, from these values alone; months are those of the values and the next one, which the ridge models need."""
    if model in SARIMA:
        p, d, q, season, least = SARIMA[model]
        found = fit.fit_seasonal(values, season, p, d, q) if len(values) >= least else None
        return None if found is None else max(0.0, float(fit.forecast_seasonal(values, season, found, 1)[0][0]))
    if model.startswith("seasonal"):
        got = batchfit.forecasts([values], int(model.split("_")[1]), 1)[0]
        return None if got is None else float(got[0][0])
    if len(values) < 12 or (values < 0).any():
        return None
    value = smooth.level(values) if model == "level" else smooth.damped(values) if model == "damped" else smooth.ridge(values, months, float(model.split("_")[1]))
    return max(0.0, value)


def ordered(s: pd.DataFrame) -> np.ndarray:
    return s.sort_values("bucket")["value"].to_numpy(float)


def paths(rows: DataFrame, key: str, season: int, steps: int, refused: Callable[[np.ndarray], str | None], status: str) -> DataFrame:
    """(key, status, step, predicted, lower, upper) by the seasonal model, of rows on a full calendar (key, bucket, value).

    A series is one row, an Arrow batch of them is fitted together; bounds hold 90 % under the model's own errors.
    """

    def run(batches):
        for batch in batches:
            names, series = batch.column(0).to_pylist(), [np.array(v, float) for v in batch.column(1).to_pylist()]
            why = [refused(v) for v in series]
            found = iter(batchfit.forecasts([v for v, w in zip(series, why, strict=True) if w is None], season, steps))
            out = []
            for name, w in zip(names, why, strict=True):
                got = next(found) if w is None else None
                if got is None:
                    out.append((name, w or "fit_failed", 0, None, None, None))
                    continue
                y, wide = got[0], 1.645 * got[1]
                out += [(name, status, i + 1, float(v), max(0.0, float(v - d)), float(v + d)) for i, (v, d) in enumerate(zip(y, wide, strict=True))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "status", "step", "predicted", "lower", "upper"])

    schema = f"{key} string, status string, step int, predicted double, lower double, upper double"
    return arrays(rows, key).select(key, "values").mapInArrow(run, schema)


def seasonal_forecast(rows: DataFrame, key: str, season: int, steps: int) -> DataFrame:
    """At least max(24, 2 seasons) known values that make up 60 % of the calendar; otherwise insufficient_history, no fallback."""
    return paths(rows, key, season, steps, lambda values: "insufficient_history" if ineligible(values, season) else None, "available")


def projection(rows: DataFrame, key: str, season: int, steps: int) -> DataFrame:
    """For series of more than one season but less than two: the same fit, marked provisional; no accuracy is claimed."""
    return paths(rows, key, season, steps, lambda values: None if season < len(batchfit.inner(values)[0]) < 2 * season else "not_provisional", "provisional")


def walk_forward(rows: DataFrame, key: str, models: tuple[str, ...] = MODELS, origins: int = 18) -> DataFrame:
    """(key, model, back, actual, predicted): each model's one-step prediction of the last `origins` buckets from the buckets before.

    A group is a series and a model, its origins are slices of it. A SARIMA configuration gives nothing at all for series that are
    too short for its earliest origin, so that all origins or none are compared.
    """
    each = rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(k: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("bucket")
        known = s[s["value"].notna().cummax() & s["value"].notna()[::-1].cummax()[::-1]]
        values, months, out = fit.interpolate(known["value"].to_numpy(float)), list(known["bucket"]), []
        for back in range(1, origins + 1):
            n = len(values) - back
            least = SARIMA[k[1]][-1] + origins - back if k[1] in SARIMA else 6
            guess = one_step(values[:n], k[1], months[: n + 1]) if n >= least else None
            if guess is not None:
                out.append((k[0], k[1], back, float(values[n]), float(guess)))
        return pd.DataFrame(out, columns=[key, "model", "back", "actual", "predicted"])

    return each.groupBy(key, "model").applyInPandas(run, f"{key} string, model string, back int, actual double, predicted double")


def select_model(predictions: DataFrame, key: str, test: int = 12) -> DataFrame:
    """The model with the least validation WAPE (then by name) and its test WAPE; test buckets never choose."""
    part = F.when(F.col("back") <= test, "test").otherwise("validation")
    error = F.sum(F.abs(F.col("predicted") - F.col("actual"))) * 100 / F.sum(F.abs("actual"))
    scores = predictions.withColumn("part", part).groupBy(key, "model", "part").agg(F.round(error, 4).alias("wape"))
    best = scores.filter("part = 'validation'").groupBy(key).agg(F.min(F.struct("wape", "model")).alias("b"))
    tested = scores.filter("part = 'test'").select(key, "model", F.col("wape").alias("test_wape"))
    return best.select(key, F.col("b.model").alias("model"), F.col("b.wape").alias("validation_wape")).join(tested, [key, "model"], "left")


def trends(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, slope, r2, p, has_trend) of each series, an Arrow batch of them at a time; null where it is too short or has unknown buckets."""

    def run(batches):
        for batch in batches:
            out = []
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.array(values, float)
                inner, _ = batchfit.inner(y)
                if len(inner) < 3 or len(inner) > np.count_nonzero(~np.isnan(y)):
                    out.append((name, len(inner), None, None, None, None))
                    continue
                out.append((name, len(inner), *trend_of(inner)))
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "n", "slope", "r2", "p", "has_trend"])

    return arrays(rows, key).select(key, "values").mapInArrow(run, f"{key} string, n int, slope double, r2 double, p double, has_trend boolean")


def trend_of(values: np.ndarray) -> tuple[float, float, float, bool]:
    """Slope, r squared, p, and whether p is .05 at most and the line changes by a fifth of the mean at least."""
    slope, r2, p = fit.trend(values)
    mean = float(values.mean())
    change = abs(slope) * (len(values) - 1) / mean if mean > 0 else 0.0
    return slope, r2, p, bool(p <= 0.05 and change >= 0.2)


def shape(rows: DataFrame, key: str, season: int) -> DataFrame:
    """Trend, seasonality and cycle of each series, with flags; null where it is too short or has unknown buckets inside."""

    def run(k: tuple, s: pd.DataFrame) -> pd.DataFrame:
        raw = ordered(s)
        values = fit.interpolate(raw)
        if len(values) < 3 or len(values) > np.count_nonzero(~np.isnan(raw)):
            return pd.DataFrame([(k[0], len(values)) + (None,) * 8], columns=columns)
        parts = fit.decompose(values, season) if values.std() > 1e-12 else None
        strength, again = (None, None) if parts is None else (fit.seasonal_strength(parts), fit.repetition(values, parts, season))
        period, share = fit.cycle(values, parts, season) or (None, None)
        seasonal = None if strength is None else strength >= 0.6 and again >= 0.3
        cyclic = None if share is None else share >= 0.5
        return pd.DataFrame([(k[0], len(values), *trend_of(values), strength, seasonal, period, cyclic)], columns=columns)

    columns = [key, "n", "slope", "r2", "p", "has_trend", "strength", "is_seasonal", "period", "has_cycle"]
    return rows.groupBy(key).applyInPandas(run, f"{key} string, n int, slope double, r2 double, p double, has_trend boolean, strength double, is_seasonal boolean, period double, has_cycle boolean")


def components(rows: DataFrame, key: str, season: int) -> DataFrame:
    """(key, bucket, trend, seasonal, rest) of series with two whole cycles."""

    def run(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("bucket")
        s = s[s["value"].notna().cummax() & s["value"].notna()[::-1].cummax()[::-1]]
        parts = fit.decompose(fit.interpolate(s["value"].to_numpy(float)), season)
        if parts is None:
            return pd.DataFrame({key: [], "bucket": [], "trend": [], "seasonal": [], "rest": []})
        return pd.DataFrame({key: s[key], "bucket": s["bucket"], "trend": parts[0], "seasonal": parts[1], "rest": parts[2]})

    return rows.select(key, "bucket", "value").groupBy(key).applyInPandas(run, f"{key} string, bucket date, trend double, seasonal double, rest double")


def path_of(method: str, training: np.ndarray, season: int, steps: int) -> np.ndarray | None:
    """A path of several steps by a method, or None where it cannot train."""
    if method == "sarima":
        got = None if ineligible(training, season) else batchfit.forecasts([training], season, steps)[0]
        return None if got is None else got[0]
    values, over = batchfit.inner(training)
    if len(values) < max(12, season):
        return None
    if method == "level":
        return np.full(steps, max(0.0, smooth.level(values)))
    at = len(values) + over + np.arange(steps)
    return np.maximum(values[at - season * ((at - len(values)) // season + 1)], 0.0)


def gap_matched(rows: DataFrame, key: str, season: int, horizon: int, gap: int, methods: tuple[str, ...] = ("sarima", "level", "last_season")) -> DataFrame:
    """(key, method, status, reason, validation_mae, test_mae, tested, selected): methods compared over two blocks that do not overlap.

    A block is as long as gap and horizon; only distances past the gap are scored, and 80 % of those, two at least, have to be known in
    each block. The least validation error selects, in order of methods where equal, before the later block is looked at: nothing in it
    changes the choice.
    """
    columns = [key, "method", "status", "reason", "validation_mae", "test_mae", "tested", "selected"]

    def error(raw: np.ndarray, cut: int, method: str) -> tuple[float, int] | None:
        path, actual = path_of(method, raw[:cut], season, horizon + gap), raw[cut + gap : cut + gap + horizon]
        known = ~np.isnan(actual)
        return None if path is None else (round(float(np.abs(path[gap:] - actual)[known].mean()), 4), int(known.sum()))

    def run(k: tuple, s: pd.DataFrame) -> pd.DataFrame:
        raw, span = ordered(s), horizon + gap
        first, second = len(raw) - 2 * span, len(raw) - span
        short = "too short for two blocks" if first < 1 else None
        if not short and min((~np.isnan(raw[c + gap : c + span])).sum() for c in (first, second)) < max(2, math.ceil(0.8 * horizon)):
            short = "too few known buckets in a block"
        if short:
            return pd.DataFrame([(k[0], m, "insufficient_history", short, None, None, None, False) for m in methods], columns=columns)
        validated = {m: e for m in methods if (e := error(raw, first, m))}
        chosen = min(validated, key=lambda m: (validated[m][0], methods.index(m))) if validated else None
        out = []
        for m in methods:
            tested = error(raw, second, m) if m in validated else None
            status = "ineligible" if m not in validated else "evaluated" if tested else "test_fit_failed"
            out.append((k[0], m, status, None if m in validated else "cannot train before the first block", validated.get(m, (None,))[0], tested and tested[0], tested and tested[1], m == chosen))
        return pd.DataFrame(out, columns=columns).astype({"validation_mae": float, "test_mae": float, "tested": "Int64"})

    return rows.groupBy(key).applyInPandas(run, f"{key} string, method string, status string, reason string, validation_mae double, test_mae double, tested int, selected boolean")


def whole_path(steps: DataFrame, key: str, n: int) -> DataFrame:
    """Paths of n steps, withheld as a whole if any value is missing or negative."""
    fine = steps.groupBy(key).agg((F.count("predicted") == n).alias("full"), F.bool_and(F.col("predicted") >= 0).alias("fine"))
    return steps.join(fine.filter("full and fine").select(key), key, "left_semi")
