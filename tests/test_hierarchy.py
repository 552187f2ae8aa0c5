"""Snapshots, item facts, item forecasts and what they sum to, in literal cases."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopweave.functions import batchfit, fit
from shopweave.operators import hierarchy, ledger
from shopweave.sources.scratch import written

WEEKLY, MONTHLY, DAILY = (hierarchy.PERIODS[p] for p in ("weekly", "monthly", "daily"))
DAY = dt.date(2025, 12, 10)
RECEIPT = "id long, customer_id long, customer_name string, source_label string, explicit_segment string, amount decimal(20,2), voided boolean, reference string"
LINE = "receipt_id long, line int, product_id long, decision string, amount decimal(20,2), entered_amount decimal(20,2), entered_quantity decimal(10,2)"


def taken(spark, receipts, lines):
    """Snapshot rows of receipts (id, customer, name, label, segment, amount) and lines (receipt, line, product, decision, amount, quantity)."""
    money = lambda x: None if x is None else Decimal(str(x))
    r = spark.createDataFrame([(*x[:5], money(x[5]), *(x[6:] or (False, "S:1"))) for x in receipts], RECEIPT).withColumn("day", F.lit(DAY))
    rows = [(a, n, p, d, money(v if v is not None else 0), money(v), money(q)) for a, n, p, d, v, q in lines]
    return ledger.snapshot(r, spark.createDataFrame(rows, LINE), "2026-01-01"), spark.createDataFrame(rows, LINE)


def test_snapshot_rules(spark):
    sixty_forty = lambda i: [(i, 1, 1, "dairy", 60, 1), (i, 2, 2, "non_dairy", 40, 1)]
    receipts = [
        (1, 5, "Ann", "", "feeding", 100), (2, 5, "Ann", None, None, 100), (3, None, None, "  Corner   Feeding ", None, 100), (4, None, None, "", None, 100), (5, 5, "Ann", "", None, 100),
        (6, 5, "Ann", "", None, 100), (7, 5, "Ann", "", None, 100), (8, 5, "Ann", "", None, 100), (9, 5, "Ann", "", "regular", 100), (10, 5, "Ann", "", None, 9, True, "S:1"), (11, 5, "Ann", "", None, 9, False, "2026:000001"),
    ]
    lines = [x for i in (1, 2, 3, 4) for x in sixty_forty(i)]
    lines += [(5, 1, 1, "dairy", 0, 1), (6, 1, 2, "non_dairy", 50, 1), (7, 1, 3, "review", 50, 1), (7, 2, 1, "dairy", 50, 1), (9, 1, 2, "non_dairy", 50, 1), *sixty_forty(10), *sixty_forty(11)]
    got = {r.sale_id: (r.customer_key, r.customer_name, r.segment, float(r.revenue)) for r in taken(spark, receipts, lines)[0].collect()}
    assert got == {
        1: ("customer:5", "Ann", "feeding", 100.0),  # a stated segment is not shared
        2: ("customer:5", "Ann", "regular", 60.0),
        3: ("label:corner feeding", "Corner   Feeding", "feeding", 60.0),
        4: ("walk-in", "Walk-in", "regular", 60.0),
        5: ("customer:5", "Ann", "unclassified", 100.0),  # gross of nought
        7: ("customer:5", "Ann", "unclassified", 100.0),
        8: ("customer:5", "Ann", "unclassified", 100.0),  # no line
        9: ("customer:5", "Ann", "regular", 100.0),
    }


def facts_of(spark, receipts, lines):
    sales, rows = taken(spark, receipts, lines)
    return {(r.segment, r.product_id): (r.quantity, r.revenue, r.lines, r.unknown_quantity, r.unknown_revenue) for r in ledger.item_facts(ledger.dairy_lines(rows, sales, "line"), sales).collect()}


def test_item_facts(spark):
    regular = lambda i, amount: (i, 5, "Ann", "", "regular", amount)
    one = facts_of(spark, [regular(1, 90)], [(1, 1, 1, "dairy", 100, 1), (1, 2, 2, "dairy", 50, 1), (1, 3, 3, "non_dairy", 50, 1)])
    assert one == {("regular", 1): (1.0, 60.0, 1, 0, 0), ("regular", 2): (1.0, 30.0, 1, 0, 0)}
    small = facts_of(spark, [regular(1, "0.02")], [(1, k, k, "dairy", 1, 1) for k in range(10)])
    assert sorted(v[1] for v in small.values()) == [0.0] * 8 + [0.01] * 2
    unpriced = facts_of(spark, [regular(1, 90)], [(1, 1, 1, "dairy", None, 1), (1, 2, 2, "dairy", 5, 1)])
    assert unpriced == {("regular", 1): (1.0, None, 1, 0, 1), ("regular", 2): (1.0, None, 1, 0, 1), ("regular", ledger.UNALLOCATED): (None, 90.0, 1, 1, 0)}
    negative = facts_of(spark, [regular(1, 90)], [(1, 1, 1, "dairy", -5, 0)])
    assert negative == {("regular", 1): (None, None, 1, 1, 1), ("regular", ledger.UNALLOCATED): (None, 90.0, 1, 1, 0)}
    none = facts_of(spark, [regular(1, 90), (2, 5, "Ann", "", "unclassified", 70)], [(1, 1, 1, "non_dairy", 5, 1), (2, 1, 1, "dairy", 5, 1)])
    assert none == {("regular", ledger.UNALLOCATED): (None, 90.0, 1, 1, 0)}


# Batched fits


def test_fits_are_as_good_as_a_search_over_a_grid():
    r = np.random.default_rng(8)
    for n, season in ((40, 12), (80, 12), (130, 52)):
        y = r.uniform(0, 100, (5, n))
        found = batchfit.fit(y, season)
        for k in range(5):
            old = fit.fit_seasonal(y[k], season)
            cost = lambda a, b, k=k: np.square(fit.residuals(y[k], season, a, b)[0]).sum()
            assert cost(found.a[k], found.b[k]) <= cost(old["a"], old["b"]) * (1 + 1e-6)
            e, c = fit.residuals(y[k], season, found.a[k], found.b[k])
            assert abs(c - found.c[k]) < 1e-9 and abs(found.variance[k] - np.square(e).sum() / max(1, len(e) - 3)) < 1e-6


def test_forecasts_go_through_unknown_ends():
    y = np.array([10.0 + k % 12 for k in range(60)])
    whole = batchfit.forecasts([y], 12, 8)[0][0]
    cut = np.concatenate([[np.nan] * 2, y, [np.nan] * 3])
    assert np.allclose(batchfit.forecasts([cut], 12, 5)[0][0], whole[3:])
    assert np.allclose(whole, 10.0 + np.arange(60, 68) % 12, atol=0.3)
    assert np.allclose(batchfit.forecasts([np.full(40, 7.0)], 12, 3)[0][0], 7.0)
    assert batchfit.forecasts([np.array([np.nan] * 5), np.array([1.0, 2.0])], 12, 3) == [None, None]


def outcome(values, period, n=12, active=True):
    return hierarchy.fit_all([np.array([np.nan if v is None else v for v in values], float)], [active], [n], period)[0]


def test_item_gates():
    assert outcome([10.0] * 60, MONTHLY, active=False)["status"] == "inactive_item"
    for values in ([None], [0.0], [6.0, None, 0.0, 3.0], [10.0] * 5):
        r = outcome(values, DAILY)
        assert (r["status"], r["reason"], r["supported"], r["test"]) == ("insufficient_history", hierarchy.FEW, 0, []) and r["predicted"] == [None] * 12
    assert outcome([10.0] * 12, MONTHLY)["reason"].endswith(hierarchy.NO_SEASON)
    r = outcome([10.0] * 13, MONTHLY)
    assert (r["status"], r["provisional"], r["accuracy_status"], r["lower"]) == ("provisional", 1, "unvalidated_short_history", [None] * 12) and r["predicted"] == [10.0] * 12
    # 35 months leave 23 before the validation block, 36 leave 24.
    assert (outcome([10.0] * 35, MONTHLY)["status"], outcome([10.0] * 36, MONTHLY)["status"]) == ("provisional", "available")
    # Less than 60 % known.
    sparse = [10.0 if k % 2 else None for k in range(80)]
    assert outcome(sparse, MONTHLY)["status"] == "provisional"
    late = [10.0] * 48 + [None] * 4 + [10.0] * 8
    assert outcome(late, MONTHLY)["reason"] == hierarchy.NO_SCORE and outcome(late, MONTHLY)["status"] == "provisional"


def test_bounds_end_with_the_horizon():
    weeks = [float(v) for v in [*range(1, 53)] * 2 + [*range(1, 13)]]
    r = outcome(weeks, WEEKLY, 60)
    assert r["status"] == "available" and len(r["predicted"]) == 60 and r["predicted"][44] is not None
    assert r["lower"][7] is not None and r["lower"][8:] == [None] * 52 and r["upper"][8:] == [None] * 52
    assert len(r["test"]) == 8 and [t["back"] for t in r["test"]] == [8, 7, 6, 5, 4, 3, 2, 1]


def test_test_values_change_errors_alone():
    rng = np.random.default_rng(2)
    values = rng.uniform(5, 15, 60).tolist()
    a, b = outcome(values, MONTHLY), outcome(values[:52] + [v * 9 for v in values[52:]], MONTHLY)
    assert a["validation_mae"] == b["validation_mae"] and a["mae"] != b["mae"]
    assert [t["predicted"] for t in a["test"]] == [t["predicted"] for t in b["test"]]
    known = [t for t in outcome([None if k == 55 else v for k, v in enumerate(values)], MONTHLY)["test"]]
    assert [t["back"] for t in known] == [8, 7, 6, 4, 3, 2, 1]
    assert outcome([None if k == 55 else v for k, v in enumerate(values)], MONTHLY)["lower"] == [None] * 12  # seven errors are too few


# Series and sums


def weeks(n, first=dt.date(2022, 1, 3)):
    return [first + dt.timedelta(weeks=i) for i in range(n)]


def sold_of(spark, rows):
    """Cells of facts (day, segment, product, quantity, revenue)."""
    facts = [(d, s, p, q, v, 1, int(q is None), int(v is None)) for d, s, p, q, v in rows]
    schema = "day date, segment string, product_id long, quantity double, revenue double, lines long, unknown_quantity long, unknown_revenue long"
    return written(hierarchy.cells(spark.createDataFrame(facts, schema), WEEKLY, "segment", "product_id"))


PRODUCTS = "product_id long, category string, unit string, active boolean"


def test_cutoff_and_training_start(spark):
    days = weeks(20)
    rows = [(d, "regular", 1, 10.0, 80.0) for d in days if d != days[5]]
    dates = hierarchy.calendar(sold_of(spark, [*rows, (days[-1] + dt.timedelta(6), "regular", 1, 1.0, 8.0)]), WEEKLY, "2022-06-15")
    assert (dates.cutoff, dates.run_start, dates.projection_start, dates.targets) == (days[-1] + dt.timedelta(7), days[6], dt.date(2022, 6, 13), 11)
    # The last week is not over, and a later sale in a week that is not over does not make it so.
    late = dt.date(2022, 11, 4)
    dates = hierarchy.calendar(sold_of(spark, [*rows, (late, "regular", 1, 99.0, 8.0)]), WEEKLY, "2022-11-05")
    assert (dates.cutoff, dates.projection_start) == (days[-1] + dt.timedelta(7), dt.date(2022, 10, 31))
    assert hierarchy.calendar(sold_of(spark, rows).filter("false"), WEEKLY, "2022-06-15").cutoff == dt.date(2022, 6, 13)


def test_unknown_is_not_nought(spark):
    days = weeks(8)
    rows = [(d, "regular", 1, 10.0, 80.0) for d in days] + [(days[1], "feeding", 2, 4.0, 8.0), (days[3], "feeding", 2, None, None), (days[4], "feeding", 2, 1.0, None), (days[2], "feeding", 3, None, 5.0)]
    rows += [(days[-1] + dt.timedelta(6), "regular", 1, 0.0, 0.0)]
    sold = sold_of(spark, rows)
    dates = hierarchy.calendar(sold, WEEKLY, "2022-03-01")
    got = {}
    for r in hierarchy.item_series(sold, dates, WEEKLY).collect():
        got.setdefault((r.product_id, r.metric), {})[days.index(r.bucket)] = r.value
    assert got[2, "quantity"] == {1: 4.0, 2: 0.0, 3: None, 4: 1.0, 5: 0.0, 6: 0.0, 7: 0.0}
    assert got[2, "revenue"] == {1: 8.0, 2: 0.0, 3: None, 4: None, 5: 0.0, 6: 0.0, 7: 0.0}
    assert (3, "quantity") not in got and got[3, "revenue"][2] == 5.0
    products = spark.createDataFrame([(1, "Milk", "unit", True), (2, "Milk", "unit", True), (3, "Milk", "L", True)], PRODUCTS)
    units = {}
    for r in hierarchy.unit_series(sold, products, dates, WEEKLY).collect():
        units.setdefault((r.segment, r.scope, r.unit), {})[days.index(r.bucket)] = r.value
    assert units["feeding", "overall", "unit"] == got[2, "quantity"] == units["feeding", "category", "unit"]
    assert units["feeding", "overall", "L"] == {2: None, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}


PART = "segment string, product_id long, metric string, category string, unit string, status string, supported int, provisional int, total int, step int, bucket date, value double"


def parts(spark, rows):
    """Item rows of two steps from (segment, product, category, unit, status, value)."""
    one = {"available": (1, 0), "provisional": (1, 1)}
    out = [(s, p, m, c, u, st, *one.get(st, (0, 0)), 1, k, dt.date(2026, k, 1), v) for s, p, c, u, st, v in rows for m in ("quantity", "revenue") for k in (1, 2)]
    return spark.createDataFrame(out, PART)


def test_sums_keep_units_apart_and_count_series(spark):
    rows = [("regular", 1, "Milk", "unit", "available", 10.0), ("feeding", 1, "Milk", "unit", "available", 10.0), ("regular", 3, "Milk", "unit", "insufficient_history", None), ("regular", 2, "Milk", "L", "provisional", 5.0), ("feeding", 4, "Cheese", "L", "inactive_item", None)]
    got = {(r.view, r.level, r.metric, r.unit, r.category, r.product_id): r for r in hierarchy.rolled_up(parts(spark, rows)).filter("step = 1").collect()}
    at = lambda *k: (lambda r: (r.value, r.supported, r.provisional, r.total, r.status, r.accuracy_status))(got[k])
    assert at("combined", "overall", "quantity", "unit", None, None) == (20.0, 2, 0, 3, "partial", None)
    assert at("combined", "overall", "quantity", "L", None, None) == (5.0, 1, 1, 2, "partial", "unvalidated_short_history")
    assert at("regular", "category", "quantity", "L", "Milk", None) == (5.0, 1, 1, 1, "provisional", "unvalidated_short_history")
    assert at("feeding", "category", "quantity", "L", "Cheese", None) == (None, 0, 0, 1, "insufficient_history", "unvalidated_short_history")
    assert at("combined", "overall", "revenue", "", None, None) == (25.0, 3, 1, 5, "partial", "mixed_validated_and_unvalidated")
    assert at("combined", "item", "quantity", "unit", "Milk", 1)[:5] == (20.0, 2, 0, 2, "available")
    assert at("combined", "item", "quantity", "L", "Cheese", 4)[4] == "inactive_item"
    assert all(r.lower is None and r.upper is None for r in got.values())


def test_aggregates_fill_what_no_item_estimates(spark):
    rows = [("regular", 1, "Milk", "unit", "available", 7.0), ("feeding", 1, "Milk", "unit", "insufficient_history", None), ("feeding", 2, "Milk", "unit", "insufficient_history", None)]
    nodes = written(hierarchy.rolled_up(parts(spark, rows)))
    spare = [(s, scope, c, u, "provisional", 1, 1, 1, k, dt.date(2026, k, 1), 10.0) for s in ("regular", "feeding") for scope, c in (("overall", ""), ("category", "Milk")) for u in ("unit", "L") for k in (1, 2) if not (s == "regular" and u == "L")]
    aggregates = spark.createDataFrame(spare, "segment string, scope string, category string, unit string, status string, supported int, provisional int, total int, step int, bucket date, value double")
    got = {(r.view, r.level, r.unit): (r.value, r.supported, r.total, r.status, r.basis) for r in hierarchy.filled(nodes, aggregates, written).filter("step = 2").collect()}
    assert got == {
        ("regular", "overall", "unit"): (7.0, 1, 1, "available", "items"), ("regular", "category", "unit"): (7.0, 1, 1, "available", "items"),
        ("feeding", "overall", "unit"): (10.0, 1, 1, "provisional", "overall_quantity"), ("feeding", "category", "unit"): (10.0, 1, 1, "provisional", "category_quantity"),
        ("feeding", "overall", "L"): (10.0, 1, 1, "provisional", "overall_quantity"), ("feeding", "category", "L"): (10.0, 1, 1, "provisional", "category_quantity"),
        ("combined", "overall", "unit"): (17.0, 2, 2, "provisional", "segment_totals"), ("combined", "category", "unit"): (17.0, 2, 2, "provisional", "segment_totals"),
        ("combined", "overall", "L"): (10.0, 1, 1, "provisional", "segment_totals"), ("combined", "category", "L"): (10.0, 1, 1, "provisional", "segment_totals"),
    }
    # Where items estimate everything, nothing is filled.
    whole = written(hierarchy.rolled_up(parts(spark, [(s, 1, "Milk", "unit", "available", 7.0) for s in ("regular", "feeding")])))
    assert {r.basis for r in hierarchy.filled(whole, aggregates.filter("unit = 'unit'"), written).collect()} == {"items"}


@pytest.fixture(scope="module")
def shop_of_weeks(spark):
    """200 weeks of two products in both segments, ten of each a week for 80, and one that sold in five weeks only."""
    days = weeks(200)
    rows = [(d, s, p, 10.0, 80.0) for d in days for s in ("regular", "feeding") for p in (1, 2)] + [(d, "regular", 3, 1.0, 1000.0) for d in days[195:]]
    rows += [(days[-1] + dt.timedelta(6), "regular", 1, 0.0, 0.0)]
    products = spark.createDataFrame([(1, "Milk", "unit", True), (2, "Milk", "L", True), (3, "Milk", "unit", True)], PRODUCTS)
    sold = sold_of(spark, rows)
    return sold, products, hierarchy.calendar(sold, WEEKLY, "2025-11-10")


def test_whole_hierarchy(shop_of_weeks):
    sold, products, dates = shop_of_weeks
    got = {(r.view, r.level, r.metric, r.unit, r.category, r.product_id): r for r in hierarchy.hierarchy(sold, products, dates, WEEKLY, written).filter("step = 1").collect()}
    overall = lambda view, metric, unit="": got[view, "overall", metric, unit, None if metric == "revenue" else "", None]
    assert (overall("combined", "quantity", "unit").value, overall("combined", "quantity", "L").value) == (20.0, 20.0)
    sparse = overall("combined", "quantity", "unit")
    assert (sparse.status, sparse.supported, sparse.total) == ("partial", 2, 3)
    assert got["regular", "item", "revenue", "", "Milk", 3].status == "insufficient_history"
    # Overall revenue follows the segments' own series, in which the sparse item counts.
    feeding, regular, both = (overall(v, "revenue") for v in ("feeding", "regular", "combined"))
    assert feeding.value == 160.0 and regular.value > 160.0 and round(regular.value + feeding.value, 2) == both.value
    assert (regular.basis, both.basis) == ("segment_revenue", "segment_totals")


def test_errors_of_sums(shop_of_weeks):
    sold, products, dates = shop_of_weeks
    found = hierarchy.item_forecasts(hierarchy.item_series(sold, dates, WEEKLY), products, dates, WEEKLY)
    got = {(r.view, r.level, r.metric, r.unit): (r.tested, r.mae) for r in hierarchy.tested(found, dates, products, WEEKLY).collect()}
    assert got["combined", "overall", "quantity", "L"] == (8, 0.0) and got["regular", "category", "revenue", ""] == (8, 0.0)


def test_fits_are_made_together():
    """No series is gone through by itself: the calls of Python code for each are few."""
    import sys

    r = np.random.default_rng(1)
    series = [np.round(r.gamma(2, 20, 53), 2) for _ in range(1000)]

    def calls(run):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "call"

        sys.setprofile(count)
        run()
        sys.setprofile(None)
        return n

    assert calls(lambda: batchfit.forecasts(series, 12, 12)) < 2 * len(series)
    bounds = np.append(0, np.cumsum([53] * 1000))
    assert calls(lambda: hierarchy.fit_columns(np.concatenate(series), bounds, np.ones(1000, bool), np.full(1000, 12), MONTHLY)) < 10 * len(series)


def test_series_in_one_row(spark):
    """Without a row for each bucket they are the same: gaps, unknown buckets, and cells before the unbroken run."""
    r = np.random.default_rng(2)
    days = [dt.date(2020, 1, 6) + dt.timedelta(7 * k) for k in range(120) if k != 15]
    rows = [(d, s, p, None if r.random() < 0.1 else float(r.integers(1, 9)), None if r.random() < 0.1 else 5.5) for d in days for s in ("regular", "feeding") for p in range(12) if r.random() < 0.03 * (p + 1)]
    rows += [(d, "regular", 99, 1.0, 1.0) for d in days]
    schema = "day date, segment string, product_id long, quantity double, revenue double"
    facts = spark.createDataFrame(rows, schema).selectExpr("*", "int(quantity is null) as unknown_quantity", "int(revenue is null) as unknown_revenue")
    for name in ("weekly", "monthly", "daily"):
        period = hierarchy.PERIODS[name]
        sold = hierarchy.cells(facts, period, "segment", "product_id")
        dates = hierarchy.calendar(sold, period, "2022-06-30")
        want = hierarchy.arrays(hierarchy.item_series(sold, dates, period), *hierarchy.ITEM)
        got = hierarchy.item_arrays(sold, dates, period).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert got.count() > 40


def test_sums_of_items_are_hashed(spark):
    """A text among the sums would have all rows of all steps put in order."""
    schema = "segment string, product_id long, metric string, category string, unit string, status string, supported int, provisional int, total int, step int, bucket date, value double"
    rows = [("regular", p, "quantity", "Milk", "unit", s, int(s == "available"), 0, 1, 1, dt.date(2024, 1, 1), 1.0) for p, s in enumerate(hierarchy.STATUSES)]
    nodes = hierarchy.rolled_up(spark.createDataFrame(rows, schema))
    assert "SortAggregate" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert {r.product_id: r.status for r in nodes.filter("level = 'item' and view = 'regular'").collect()} == dict(enumerate(hierarchy.STATUSES))
