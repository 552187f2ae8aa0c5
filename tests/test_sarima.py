"""The eight SARIMA configurations of sarima_select: parameters found again, gates, and the registered query."""

import datetime as dt
import os

import numpy as np
import pytest

from shopweave.functions import fit
from shopweave.operators import forecast
from shopweave.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def simulated(n, season, p, d, q, a=0.5, b=0.6, theta=0.4, seed=2):
    """A series of (1 - a B)(1 - b B^s) w = c + (1 + theta B) e, w its d-th differences."""
    rng = np.random.default_rng(seed)
    a, theta, c = a * p, theta * q, 0.0 if d else 10.0
    w, last = [25.0 * (1 - d)] * (season + 1), 0.0
    for _ in range(n + 5 * season):
        e = rng.normal(0, 1)
        w.append(c + a * w[-1] + b * w[-season] - a * b * w[-season - 1] + e + theta * last)
        last = e
    w = np.array(w[-n:])
    return 1000 + np.cumsum(w) if d else w


@pytest.mark.parametrize("name", forecast.SARIMA)
def test_parameters_are_found_again(name):
    p, d, q, season, _ = forecast.SARIMA[name]
    values = simulated(1500, season, p, d, q)
    found = fit.fit_seasonal(values, season, p, d, q)
    assert abs(found["a"] - 0.5 * p) < 0.1 and abs(found["b"] - 0.6) < 0.1 and abs(found["theta"] - 0.4 * q) < 0.1
    ahead, se = fit.forecast_seasonal(values, season, found, 2)
    w = np.diff(values / found["scale"], n=d)
    a, b = found["a"], found["b"]
    step = found["c"] + a * w[-1] + b * w[-season] - a * b * w[-season - 1] + found["theta"] * found["last"]
    assert abs(ahead[0] - (step * found["scale"] + (values[-1] if d else 0))) < 1e-6
    assert abs(se[1] / se[0] - np.sqrt(1 + (a + found["theta"] + d) ** 2)) < 1e-9


def test_gates(spark):
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(36)]
    rows = [(k, m, float(v)) for k, n in (("long", 36), ("short", 35)) for m, v in zip(months[:n], simulated(n, 12, 1, 0, 0), strict=True)]
    df = spark.createDataFrame(rows, "k string, bucket date, value double")
    got = {(r.k, r.model): r["count"] for r in forecast.walk_forward(df, "k", tuple(forecast.MONTHLY_SARIMA)).groupBy("k", "model").count().collect()}
    assert got == {("long", m): 18 for m in forecast.MONTHLY_SARIMA}
    mondays = [dt.date(2018, 1, 1) + dt.timedelta(7 * i) for i in range(130)]
    rows = [(k, m, float(v)) for k, n in (("long", 130), ("short", 129)) for m, v in zip(mondays[:n], simulated(n, 52, 1, 0, 0), strict=True)]
    found = forecast.walk_forward(spark.createDataFrame(rows, df.schema), "k", tuple(forecast.WEEKLY_SARIMA), 26)
    assert {(r.k, r.model): r["count"] for r in found.groupBy("k", "model").count().collect()} == {("long", m): 26 for m in forecast.WEEKLY_SARIMA}
    weeks = simulated(104, 52, 1, 0, 0)
    for m in forecast.WEEKLY_SARIMA:
        assert forecast.one_step(weeks, m) is not None and forecast.one_step(weeks[1:], m) is None


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
def test_query_chooses_among_the_listed(spark):
    rows = registry.queries()["sarima_select"](spark, DIR).collect()
    assert "monthly" in {r.period for r in rows}  # the weeks of the smallest tables have gaps
    assert all(r.model in (forecast.MONTHLY_SARIMA if r.period == "monthly" else forecast.WEEKLY_SARIMA) for r in rows)
