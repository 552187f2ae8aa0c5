"""Literal cases with known answers."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopweave.functions import fit, smooth, stl
from shopweave.functions.columns import growth, month_index, program_group
from shopweave.operators import forecast, ingest, inventory, ledger, sales, series


def d(text):
    return dt.date.fromisoformat(text)


def jan(day):
    return dt.date(2024, 1, day)


@pytest.fixture(scope="module")
def stock(spark):
    """Three batches, sales, a voided one with a return, two adjustments."""
    products = spark.createDataFrame([(1, True)], "product_id long, active boolean")
    batches = spark.createDataFrame(
        [(1, 1, jan(1), 100, 80), (2, 1, jan(11), 20, 18), (3, 1, jan(21), 50, 50)], "batch_id long, product_id long, received date, initial int, remaining int"
    ).selectExpr("*", "date'2030-01-01' as expiry", "'available' as status", "false as reference_only").withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("initial", "remaining")})
    receipts = spark.createDataFrame(
        [(1, jan(5), False, None, "outlet sales"), (2, jan(10), True, None, "outlet sales"), (3, jan(20), False, None, "outlet sales"), (4, jan(13), False, 7, "School")],
        "id long, moved_day date, voided boolean, customer_id long, label string",
    )
    lines = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 1, 10), (3, 1, 1, 7), (4, 1, 2, 2)], "receipt_id long, product_id long, batch_id long, quantity int").withColumn("quantity", F.col("quantity").cast("decimal(10,2)"))
    returns = spark.createDataFrame([(2, 1, 1, 3, jan(25))], "receipt_id long, batch_id long, product_id long, quantity int, day date").withColumn("quantity", F.col("quantity").cast("decimal(12,2)"))
    adjustments = spark.createDataFrame([(1, "damage", 2, jan(12), 1), (1, "correction", -1, jan(22), 2)], "batch_id long, kind string, quantity int, day date, id long").withColumn("quantity", F.col("quantity").cast("decimal(12,2)"))
    moves = inventory.movements(receipts, lines, batches, adjustments, returns, "2024-02-01")
    return products, batches, moves, receipts, lines, returns


def test_ledger_over_a_range(stock):
    products, batches, moves, receipts, lines, returns = stock
    r = inventory.ledger(products, batches, moves, "2024-01-10", "2024-01-15", "2024-02-01").first()
    assert (r.beginning, r.received, r.total, r.outlet, r.allocations, r.adjustments, r.ending) == (95, 20, 115, 10, 2, 2, 101)
    sold = inventory.allocations(inventory.sale_movements(receipts, lines, returns), "2024-01-10", "2024-01-15")
    assert {(x.buyer, x.quantity) for x in sold.collect()} == {("outlet", 10.0), ("c:7", 2.0)}


def test_return_day(stock):
    products, batches, moves, *_ = stock
    r = inventory.ledger(products, batches, moves, "2024-01-25", "2024-01-25", "2024-02-01").first()
    assert (r.adjustments, r.outlet, r.ending - r.beginning) == (-3, 0, 3)


def test_ledgers_of_adjoining_ranges_meet(stock):
    products, batches, moves, *_ = stock
    for cut in (4, 9, 12, 20, 25):
        a = inventory.ledger(products, batches, moves, "2024-01-01", str(jan(cut)), "2024-02-01").first()
        b = inventory.ledger(products, batches, moves, str(jan(cut + 1)), "2024-01-31", "2024-02-01").first()
        assert a.ending == b.beginning


def allocate(spark, net, weights):
    rows = [(1, k, w, net) for k, w in enumerate(weights)]
    out = ledger.allocated(spark.createDataFrame(rows, "receipt_id long, line int, weight long, net_cents long"), "line")
    return [r.cents for r in out.orderBy("line").collect()]


def test_largest_remainder(spark):
    assert allocate(spark, 9000, [10000, 5000]) == [6000, 3000]
    cents = allocate(spark, 2, [7] * 10)
    assert sum(cents) == 2 and min(cents) >= 0 and cents == [1, 1] + [0] * 8
    assert allocate(spark, 100, [0, 0]) == [None, None]
    rng = np.random.default_rng(1)
    for _ in range(3):
        weights = [int(w) for w in rng.integers(1, 1000, 7)]
        assert sum(allocate(spark, 12345, weights)) == 12345


@pytest.mark.parametrize(
    ("given", "filled"),
    [([4, None, 10], [4, 7, 10]), ([4, None, None, 10], [4, 6, 8, 10]), ([None, 4, None, 0, None, 10, None], [None, 4, 2, 0, 5, 10, None])],
)
def test_interpolation(spark, given, filled):
    rows = [("k", dt.date(2024, 1 + i, 1), None if v is None else float(v)) for i, v in enumerate(given)]
    out = series.interpolated(spark.createDataFrame(rows, "k string, bucket date, value double"), "k").orderBy("bucket").collect()
    assert [r.filled for r in out] == filled


def metrics(spark, pairs):
    return series.error_metrics(spark.createDataFrame([("k", float(a), float(p)) for a, p in pairs], "k string, actual double, predicted double"), "k").first()


def test_error_metrics(spark):
    m = metrics(spark, [(100, 90), (100, 110)])
    assert (m.bias, m.wape, m.rmse, m.max_error) == (0, 10, 10, 10)
    m = metrics(spark, [(0, 10)])
    assert (m.wape, m.mae, m.mape, m.zero_actuals) == (None, 10, None, 1)


def test_skill(spark):
    def rows(m, b):
        return spark.createDataFrame([("k", d("2024-01-01"), "model", 100.0, 100.0 + m), ("k", d("2024-01-01"), "base", 100.0, 100.0 + b)], "k string, bucket date, method string, actual double, predicted double")

    assert series.skill(rows(10, 20), "model", "base", "k").first().skill == 50
    assert series.skill(rows(20, 10), "model", "base", "k").first().skill == -100
    assert series.skill(rows(20, 0), "model", "base", "k").first().skill is None


def test_policy_split(spark):
    rows = [(1, "dairy", Decimal(200), Decimal(25)), (1, "non_dairy", Decimal(50), Decimal(25)), (2, "dairy", None, Decimal(0)), (2, "review", Decimal(3), Decimal(0))]
    got = {r.receipt_id: (r.kept, r.excluded, r.held) for r in ingest.policy_split(spark.createDataFrame(rows, "receipt_id long, decision string, amount decimal(20,2), discount decimal(20,2)")).collect()}
    assert got == {1: (180.0, 45.0, False), 2: (0.0, 3.0, True)}


def test_program_groups(spark):
    labels = ["feeding DEPED - second batch", "Rizal  feeding (north)", "depedx milk", "Féeding DSWD 2", None, "Milk, LAS  PIÑAS - Rizal st.", "LGU milk"]
    got = [r.g for r in spark.createDataFrame([(x,) for x in labels], "x string").select(program_group(F.col("x")).alias("g")).collect()]
    assert got == ["DepEd", "Rizal", "Unspecified feeding program", "DSWD", "Unspecified feeding program", "Las Piñas", "Unspecified feeding program"]


def test_tickets(spark):
    rows = [
        ("w", "s", 4, "1/2/24", "A", "SI03744", "p", "1", "1", "100", "", ""), ("w", "s", 5, "", "", "SI03744", "q", "1", "1", "150", "", "=SUM(G4:G5)"),
        ("w", "s", 6, "", "", "", "p", "1", "1", "80", "", "=G6"), ("w", "s", 7, "1/3/24", "", "", "p", "1", "1", "200", "", ""), ("w", "s", 8, "", "", "", "q", "1", "1", "100", "", ""),
    ]
    got = ingest.ticketize(spark.createDataFrame(rows, ingest.SHEET)).orderBy("ticket_row").collect()
    assert [(r.ticket_row, r.amount, r.lines) for r in got] == [(4, 250.0, 2), (6, 80.0, 1), (7, 300.0, 2)]


def test_tickets_of_odd_rows(spark):
    cells = [
        ("", "", "", "early", "1", "1", "5", "", ""), ("1/2/24", "", "", "", "", "", "", "", ""), ("", "B", "", "p", "0", "9", "9", "", ""), ("", "", "S1", "p", "2", "1.5", "", "", ""),
        ("", "", "S1", "q", "1", "", "", "", ""), ("", "", "", "Discoun t", "", "", "-0.50", "7", ""), ("", "", "", "r", "1", "1", "2", "", "=sum($G$8:G11)"), ("", "", "", "s", "1", "1", "3", "", "=G12"),
        ("1/2/24", "", "", "t", "1", "1", "4", "", "=SUM(G12:G13)"), ("", "", "S1", "u", "1", "1", "6", "", "=G14"), ("1/3/24", "", "", "", "", "", "", "", ""), ("", "", "S1", "v", "1", "1", "8", "", ""),
        (" total", "", "", "all", "", "", "99", "", ""), ("", "C", None, "w", "1", None, None, None, None), ("", None, "", "x", "1", "", "70", "70", ""),
    ]
    got = ingest.ticketize(spark.createDataFrame([("w", "s", i + 5, *c) for i, c in enumerate(cells)], ingest.SHEET)).orderBy("ticket_row").collect()
    day = [None, d("2024-01-02"), d("2024-01-02"), d("2024-01-02"), d("2024-01-02"), d("2024-01-03"), d("2024-01-03")]
    assert [(r.ticket_row, r.lines, r.amount, r.discount, r.separate, r.closed) for r in got] == [
        (5, 1, 5.0, 0.0, False, False), (7, 0, 0.0, 0.0, False, False), (8, 3, 7.0, -0.5, False, True), (12, 2, 7.0, 0.0, True, True), (14, 1, 6.0, 0.0, False, False), (16, 1, 8.0, 0.0, False, False), (18, 2, 70.0, 0.0, False, False),
    ]
    assert [r.day for r in got] == day
    assert ingest.ticketize(spark.createDataFrame([], ingest.SHEET)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_tickets_do_not_depend_on_blocks(spark, monkeypatch, block):
    r = random.Random(block)
    rows = []
    for sheet in ("a", "b"):
        for i in range(4, 150):
            total = r.choice(["", "", f"=G{i}", f"=SUM(G{max(4, i - r.randint(0, 2))}:G{i})"])
            rows.append(("w", sheet, i, r.choice(["", "", "", "1/2/24", "1/3/24", "x"]), r.choice(["", "", "", "", "A"]), r.choice(["", "", "S1", "S2"]), r.choice(["p", "p", "q", "discount", ""]), r.choice(["1", "1", "2", "0"]), r.choice(["", "3"]), r.choice(["", "10", "-1"]), r.choice(["", "12"]), total))
    sheets = spark.createDataFrame(rows, ingest.SHEET).repartition(3)
    # Whole sheets, each as one segment, against segments found by blocks.
    cells = ingest._cells(sheets).withColumn("holds", F.last("day", True).over(Window.partitionBy("sheet").orderBy("row"))).withColumn("segment", F.lit(0)).filter("customer <> '' or invoice <> '' or sold")
    names = "workbook sheet segment row holds day customer invoice sold discount counts priced cents worth reported sums_from own_total".split()
    whole = cells.select(*names).repartition(1).sortWithinPartitions("sheet", "row").mapInArrow(ingest._fold, ingest.TICKETS)
    monkeypatch.setattr(ingest, "BLOCK", block)
    key = lambda t: tuple(map(str, t))
    got = sorted(map(key, ingest.ticketize(sheets).collect()))
    assert len(got) > 100 and got == sorted(map(key, whole.collect()))


@pytest.mark.parametrize("block", [3, 100_000])
def test_invoices_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ledger, "BLOCK", block)
    r = random.Random(4)
    waiting = [(i, r.choice([2023, 2024])) for i in r.sample(range(500), 60)]
    taken = [(2023, n) for n in r.sample(range(1, 60), 25)] + [(2024, 12), (2024, 12), (2025, 1)]
    got = ledger.invoice_assign(spark.createDataFrame(waiting, "id long, year int").repartition(3), spark.createDataFrame(taken, "year int, number long"), spark.createDataFrame([(2024, 9)], "year int, seed long"))
    want = {}
    for year, seed in ((2023, 0), (2024, 9)):
        free = (n for n in range(seed + 1, 10_000) if (year, n) not in taken)
        want |= dict(zip(sorted(i for i, y in waiting if y == year), free))  # noqa: B905
    assert {x.id: int(x.invoice[2:]) for x in got.collect()} == want


def test_contiguous_run_and_unknown_months(spark):
    start = 2023 * 12
    months = [dt.date((start + i) // 12, (start + i) % 12 + 1, 1) for i in range(42)]
    rows = [("k", m, 1.0) for i, m in enumerate(months) if i != 17]
    df = spark.createDataFrame(rows, "k string, bucket date, value double")
    assert series.latest_run(df, month_index("bucket"), "k").count() == 24
    assert series.benchmark_select(series.latest_run(df, month_index("bucket"), "k"), "k").first().status == "insufficient_history"
    changes = {r.bucket for r in series.year_over_year(df, "k").collect()}
    assert d("2024-06-01") not in changes and d("2025-06-01") not in changes
    whole = spark.createDataFrame([("k", m, 0.0 if i == 17 else 1.0) for i, m in enumerate(months)], df.schema)
    assert series.latest_run(whole, month_index("bucket"), "k").count() == 42
    assert {r.bucket: r.change for r in series.year_over_year(whole, "k").collect()}[d("2024-06-01")] == -100


def test_test_months_never_choose(spark):
    rng = np.random.default_rng(3)
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(40)]
    values = rng.uniform(50, 150, 40).tolist()
    df = lambda v: spark.createDataFrame([("k", m, float(x)) for m, x in zip(months, v, strict=True)], "k string, bucket date, value double")
    a = series.benchmark_select(df(values), "k").first()
    b = series.benchmark_select(df(values[:28] + [v * 9 for v in values[28:]]), "k").first()
    assert (a.method, a.validation_wape) == (b.method, b.validation_wape) and a.test_wape != b.test_wape


def test_seasonal_model_finds_its_parameters():
    rng = np.random.default_rng(8)
    y = [100.0] * 13
    for _ in range(600):
        y.append(10 + 0.5 * y[-1] + 0.6 * y[-12] - 0.3 * y[-13] + rng.normal(0, 3))
    values = np.array(y[13:])
    found = fit.fit_seasonal(values, 12)
    assert abs(found["a"] - 0.5) < 0.1 and abs(found["b"] - 0.6) < 0.1
    ahead, se = fit.forecast_seasonal(values, 12, found, 3)
    want = (found["c"] + found["a"] * values[-1] / found["scale"] + found["b"] * values[-12] / found["scale"] - found["a"] * found["b"] * values[-13] / found["scale"]) * found["scale"]
    assert abs(ahead[0] - want) < 1e-6 and (np.diff(se) >= 0).all()


def test_trend_p_value():
    for t, freedom, p in ((2.228139, 10, 0.05), (3.169273, 10, 0.01), (2.055529, 26, 0.05)):  # quantiles of Student's t
        assert abs(fit.incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)) - p) < 1e-4
    slope, r2, p = fit.trend(np.arange(10.0))
    assert (round(slope, 9), round(r2, 9)) == (1, 1) and p == 0


def test_growth(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (15.0, 10.0)], "a double, b double").select(growth(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.g for r in rows] == [None, 100.0, 50.0]


def test_customer_totals(spark):
    amounts = [("10.10", False, 1), ("10.10", False, 1), ("0.20", False, 1), ("5.25", False, 1), ("14.35", False, 1), ("999", True, 1), ("100", False, 2), ("200", False, None)]
    receipts = spark.createDataFrame([(i, Decimal(a), v, c, d("2024-01-01")) for i, (a, v, c) in enumerate(amounts)], "id long, amount decimal(20,2), voided boolean, customer_id long, day date")
    got = {r.customer_id: (r.receipts, r.lifetime) for r in sales.customer_totals(spark.createDataFrame([(1,), (2,), (3,)], "customer_id long"), receipts).collect()}
    assert got == {1: (5, 40.0), 2: (1, 100.0), 3: (0, 0.0)}


def test_refused_demands_take_nothing(spark):
    demands = spark.createDataFrame([(1, 1, 6.0), (2, 1, 20.0), (3, 1, 3.0)], "demand_id long, product_id long, wanted double")
    batches = spark.createDataFrame([(10, 1, d("2024-02-01"), 5.0), (11, 1, d("2024-01-01"), 5.0)], "batch_id long, product_id long, expiry date, supply double")
    got = [(r.demand_id, r.batch_id, r.quantity, r.accepted) for r in inventory.fefo_fold(demands, batches).orderBy("demand_id", F.desc("batch_id")).collect()]
    assert got == [(1, 11, 5.0, True), (1, 10, 1.0, True), (2, None, 0.0, False), (3, 10, 3.0, True)]


def test_folds_never_overdraw(spark):
    rng = np.random.default_rng(9)
    wanted, supply = rng.integers(1, 900, 60) / 100, rng.integers(0, 3000, 12) / 100
    demands = spark.createDataFrame([(i, i % 2, float(w)) for i, w in enumerate(wanted)], "demand_id long, product_id long, wanted double")
    batches = spark.createDataFrame([(i, i % 2, d("2024-01-01") + dt.timedelta(int(rng.integers(0, 5))), float(s)) for i, s in enumerate(supply)], "batch_id long, product_id long, expiry date, supply double")
    rows, order = inventory.fefo_fold(demands, batches).collect(), {r.batch_id: (r.expiry, r.batch_id) for r in batches.collect()}
    for product in (0, 1):
        left = {i: round(float(s) * 100) for i, s in enumerate(supply) if i % 2 == product}
        for i in range(product, 60, 2):
            own = sorted((r for r in rows if r.demand_id == i and r.accepted), key=lambda r: order[r.batch_id])
            want = round(float(wanted[i]) * 100)
            assert bool(own) == (want <= sum(left.values()))
            for r in own:
                first = min((order[b], b) for b, n in left.items() if n > 0)[1]
                assert r.batch_id == first and round(r.quantity * 100) <= left[first]
                left[first] -= round(r.quantity * 100)
            assert not own or sum(round(r.quantity * 100) for r in own) == want
    enough = spark.createDataFrame([(i, i % 2, d("2024-01-01") + dt.timedelta(i), Decimal(200)) for i in range(4)], "batch_id long, product_id long, expiry date, supply decimal(12,2)")
    exact = demands.withColumn("wanted", F.col("wanted").cast("decimal(12,2)"))
    a = {(r.demand_id, r.batch_id): round(r.quantity, 2) for r in inventory.fefo_shares(exact, enough).collect()}
    assert a == {(r.demand_id, r.batch_id): round(r.quantity, 2) for r in inventory.fefo_fold(exact, enough).collect()}


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert ledger.append_once(rows, f"{tmp_path}/t", "id") == 2
    assert ledger.append_once(spark.createDataFrame([(2, "changed"), (3, "c")], rows.schema), f"{tmp_path}/t", "id") == 1
    assert {(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_fingerprint_knows_rows_not_order(spark):
    rows = [(i, f"v{i}", float(i)) for i in range(50)]
    a = spark.createDataFrame(rows, "id long, v string, x double")
    b = spark.createDataFrame(rows[::-1], a.schema).repartition(5)
    c = spark.createDataFrame(rows[:-1] + [(49, "other", 49.0)], a.schema)
    assert ledger.fingerprint(a).first() == ledger.fingerprint(b).first() != ledger.fingerprint(c).first()
    assert ledger.fingerprint(a, without=("v",)).first() == ledger.fingerprint(c, without=("v",)).first()


def test_walk_forward_sees_only_the_past(spark):
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(40)]
    values = np.random.default_rng(5).uniform(50, 150, 40)
    df = lambda v: spark.createDataFrame([("k", m, float(x)) for m, x in zip(months, v, strict=True)], "k string, bucket date, value double")
    run = lambda v: {(r.model, r.back): r.predicted for r in forecast.walk_forward(df(v), "k", ("level", "seasonal_4", "ridge_10", "damped"), 6).collect()}
    changed = values.copy()
    changed[-3:] *= 7
    a, b = run(values), run(changed)
    assert all(a[k] == b[k] for k in a if k[1] >= 3) and any(a[k] != b[k] for k in a)


def test_cycle_and_repetition():
    """A wave of 18 months beside a season of 12 is a cycle; a wave of 12 is a season; a series under three seasons has no cycle."""
    t = np.arange(72)
    cycle = lambda y: fit.cycle(y, fit.decompose(y, 12), 12)
    wave, season = np.sin(2 * np.pi * t / 18), np.tile([5, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 9.0], 6)
    period, share = cycle(100 + t + 10 * wave)
    assert abs(period - 18) < 1e-9 and share > 0.5
    y = 100 + t + season
    parts = fit.decompose(y, 12)
    assert fit.repetition(y, parts, 12) > 0.9 and fit.seasonal_strength(parts) > 0.9
    found = cycle(100 + 10 * np.sin(2 * np.pi * t / 12))
    assert found is None or abs(found[0] - 12) > 2.4
    assert cycle(wave[:35]) is None and fit.decompose(wave[:20], 12) is None


def test_loess_season_is_robust():
    """A straight trend and a fixed season come back whole, whatever one outlier does; the outlier stays in the rest."""
    t = np.arange(72)
    season, line = 10 * np.sin(2 * np.pi * t / 12), 100 + 0.5 * t
    for k in (0, 30, 71):
        y = line + season
        y[k] += 200
        trend, seasonal, rest = stl.decompose(y, 12)
        assert np.abs(seasonal - season).max() < 1e-3 and np.abs(trend - line).max() < 1e-3 and abs(rest[k] - 200) < 1e-3
    assert fit.seasonal_strength(stl.decompose(line + season, 12)) > 0.999
    noise = np.random.default_rng(4).normal(0, 5, 72)
    trend, seasonal, rest = stl.decompose(line + season + noise, 12)
    assert np.allclose(trend + seasonal + rest, line + season + noise) and 0.7 < fit.seasonal_strength((trend, seasonal, rest)) < 0.99
    # One window of all points is an ordinary line; a constant has no season.
    y = np.array([1.0, 3.0, 2.0, 5.0])
    assert abs(stl.loess(np.arange(9.0), 5) - np.arange(9)).max() < 1e-9 and abs(stl.loess(np.arange(9.0), 5, None, 1, 1)[[0, -1]] - [-1, 9]).max() < 1e-9
    assert stl.odd(12.5) == 13 and stl.odd(14) == 15 and np.ptp(stl.decompose(np.full(30, 4.0), 12)[1]) < 1e-9 and len(y) == 4


def smoothed(y, alpha, beta, phi, level, trend):
    cost = 0.0
    for v in y:
        guess = level + phi * trend
        cost += (v - guess) ** 2
        new = guess + alpha * (v - guess)
        trend = beta * (new - level) + (1 - beta) * phi * trend
        level = new
    return cost, level + phi * trend


def test_smoothing_finds_the_best_first_state():
    rng = np.random.default_rng(1)
    y = 50 + np.cumsum(rng.normal(0.5, 3, 50))
    for alpha, beta, phi in ((0.3, 0.0, 0.0), (0.3, 0.1, 0.9), (0.8, 0.4, 0.98)):
        cost, value = (x[0] for x in smooth.run(y, *(np.array([v]) for v in (alpha, beta, phi))))
        near = [smoothed(y, alpha, beta, phi, y[0] + a, b if beta else 0.0)[0] for a in np.linspace(-9, 9, 61) for b in np.linspace(-4, 4, 61)]
        assert cost <= min(near) + 1e-6 and cost > 0.9 * min(near)
    best = min(smoothed(y, a, 0.0, 0.0, level, 0.0) for a in np.linspace(0.01, 0.99, 99) for level in np.linspace(30, 70, 81))
    assert abs(smooth.level(y) - best[1]) < 0.5
    assert abs(smooth.damped(np.arange(10.0, 50.0)) - 50) < 0.1 and abs(smooth.damped(np.full(20, 5.0)) - 5) < 1e-6 and abs(smooth.level(np.full(20, 5.0)) - 5) < 1e-9


def test_ridge_is_the_closed_form():
    months = [dt.date(2022 + i // 12, i % 12 + 1, 1) for i in range(31)]
    y = np.random.default_rng(6).uniform(50, 150, 30)
    for penalty in (10.0, 100.0):
        x = np.array([smooth.features(y[:i], months[i]) for i in range(3, 31)])
        z = (x - x[:-1].mean(0)) / x[:-1].std(0)
        target = y[3:]
        # The penalised error has no slope at the weights.
        w = np.linalg.lstsq(np.vstack([z[:-1], np.sqrt(penalty) * np.eye(6)]), np.concatenate([target - target.mean(), np.zeros(6)]), rcond=None)[0]
        assert abs(smooth.ridge(y, months, penalty) - (target.mean() + z[-1] @ w)) < 1e-8
    assert smooth.features(np.array([1.0, 2.0, 6.0]), dt.date(2024, 2, 1))[:3] == [6.0, 3.0, 4.0] and smooth.features(y, dt.date(2024, 2, 1))[5] == 29


def test_later_block_never_chooses(spark):
    months = [dt.date(2018 + i // 12, i % 12 + 1, 1) for i in range(60)]
    values = np.random.default_rng(7).uniform(50, 150, 60)
    table = lambda v: spark.createDataFrame([("k", m, None if x is None else float(x)) for m, x in zip(months, v, strict=True)], "k string, bucket date, value double")
    run = lambda v: {r.method: r for r in forecast.gap_matched(table(v), "k", 12, 6, 2).collect()}
    a, changed = run(values), run([*values[:52], *(9 * values[52:])])
    assert {m: (r.validation_mae, r.selected) for m, r in a.items()} == {m: (r.validation_mae, r.selected) for m, r in changed.items()}
    assert all(a[m].test_mae != changed[m].test_mae for m in a) and sum(r.selected for r in a.values()) == 1
    first = values[:44]
    assert a["last_season"].validation_mae == round(float(np.abs(values[46:52] - first[34:40]).mean()), 4)
    # Unknown buckets in the gap do not count; two of six behind it are too many.
    gap = [None if i in (52, 53) else v for i, v in enumerate(values)]
    assert run(gap)["last_season"].status == "evaluated" and run(gap)["last_season"].tested == 6
    assert {r.status for r in run([None if i in (55, 57) else v for i, v in enumerate(values)]).values()} == {"insufficient_history"}
    assert {r.reason for r in forecast.gap_matched(table(values).limit(16), "k", 12, 6, 2).collect()} == {"too short for two blocks"}


def test_shape_refuses_gaps(spark):
    rows = [("a", dt.date(2020 + i // 12, i % 12 + 1, 1), None if i == 20 else float(i)) for i in range(40)] + [("b", dt.date(2020 + i // 12, i % 12 + 1, 1), float(i)) for i in range(40)]
    got = {r.k: r for r in forecast.shape(spark.createDataFrame(rows, "k string, bucket date, value double"), "k", 12).collect()}
    assert got["a"].has_trend is None and got["b"].has_trend is True


def test_invoices_in_any_case(spark):
    """A number held as " si0043" seeds the year and is not given out again; SI45 is not the text SI0045."""
    day = lambda d: (dt.datetime(2024, 1, d), dt.date(2024, 1, d))
    rows = [(1, " SI0042 ", *day(1)), (2, "Si0041", *day(9)), (3, " si0043", *day(2)), (4, "SI45", *day(3)), (5, "x", *day(10))]
    receipts = spark.createDataFrame(rows, "id long, invoice string, created_at timestamp, day date")
    seeds, taken = ledger.invoice_seed(receipts), ledger.invoice_taken(receipts)
    assert [tuple(r) for r in seeds.collect()] == [(2024, 41)]
    assert sorted(r.number for r in taken.collect()) == [41, 42, 43]
    waiting = spark.createDataFrame([(7, 2024), (8, 2024)], "id long, year int")
    assert sorted((r.id, r.invoice) for r in ledger.invoice_assign(waiting, taken, seeds).collect()) == [(7, "SI0044"), (8, "SI0045")]


def test_demand_needs_a_complete_calendar(spark):
    rows = [(k, i, None if (k, i) == ("gap", 5) else v) for k, v in (("gap", 4.0), ("full", 4.0)) for i in range(14)]
    rows += [("rare", i, 6.0 if i % 2 else 0.0) for i in range(14)]
    got = {r.k: (r["class"], r.adi) for r in series.demand_class(spark.createDataFrame(rows, "k string, bucket int, value double"), "k").collect()}
    assert got == {"gap": ("insufficient", None), "full": ("stable", 1.0), "rare": ("intermittent", 2.0)}


def test_adjustments_and_returns_of_old_batches(spark):
    day = lambda d: dt.date(2024, 1, d)
    batches = [(1, Decimal(10), Decimal(5), "available", day(10), day(1)), (2, Decimal(10), Decimal(5), "available", day(30), day(2)), (3, Decimal(9), Decimal(0), "depleted", day(30), day(2))]
    b = spark.createDataFrame(batches, "batch_id long, initial decimal(12,2), remaining decimal(12,2), status string, expiry date, received date")
    moves = [(1, 1, "correction", 1, 12), (2, 1, "spoilage", 2, 12), (3, 1, "expired", 3, 13), (4, 1, "expired", 1, 14), (5, 2, "damage", 0, 3), (6, 2, "correction", 0, 3), (7, 2, "damage", 5, 4), (8, 2, "correction", -2, 5), (9, 3, "damage", 1, 3), (10, 2, "damage", 1, 1)]
    a = spark.createDataFrame([(i, k, kind, Decimal(q), day(d)) for i, k, kind, q, d in moves], "id long, batch_id long, kind string, quantity decimal(12,2), day date")
    got = {r.id: (r.accepted, r.left, r.status) for r in inventory.adjustment_replay(a, b).collect()}
    assert got == {
        1: (False, 5.0, "available"), 2: (True, 3.0, "available"), 3: (True, 0.0, "disposed"), 4: (False, 0.0, "disposed"), 10: (False, 5.0, "available"), 5: (False, 5.0, "available"),
        6: (True, 5.0, "available"), 7: (True, 0.0, "depleted"), 8: (True, 2.0, "available"), 9: (False, 0.0, "depleted"),
    }
    lines = spark.createDataFrame([(1, 1, Decimal(2)), (2, 2, Decimal(2))], "line_id long, batch_id long, quantity decimal(12,2)")
    assert {r.line_id: r.returned for r in inventory.void_returns(lines, b, "2024-01-20").collect()} == {1: 0.0, 2: 2.0}


def test_quality_gate(spark):
    months = [dt.date(2023 + i // 12, i % 12 + 1, 1) for i in range(14)]
    entries = [(k, m, 100.0, 100.0 + off, 100.0 + 6) for k, off in (("good", 5), ("bad", 9), ("gap", 5)) for m in months if not (k == "gap" and m == months[8])]
    runs = [(k, months[-1], True, 5.0, 6.0) for k in ("good", "bad", "gap", "none")]
    covered = [(k, m) for k in ("good", "bad", "gap") for m in months]
    got = series.quality_gate(
        spark.createDataFrame(runs, "k string, trained_through date, trained boolean, error double, baseline_error double"),
        spark.createDataFrame(entries, "k string, bucket date, actual double, predicted double, baseline double"), spark.createDataFrame(covered, "k string, bucket date"), "2024-03-01", "k",
    )
    assert {r.k: r.reasons for r in got.collect()} == {"good": "", "bad": "error,baseline", "gap": "few_prospective_months", "none": "coverage,few_prospective_months"}


def test_freshness(spark):
    rows = spark.createDataFrame([("a", d("2024-02-26")), ("b", d("2024-02-12")), ("c", None)], "k string, bucket date")
    got = {r.k: (r.missing, r.state) for r in series.freshness(rows, "2024-03-06", "week", "k").collect()}
    assert got == {"a": (0, "current"), "b": (2, "stale"), "c": (None, "unavailable"), "combined": (None, "stale")}
    assert series.freshness(rows.filter("k = 'a'"), "2024-03-06", "week", "k").filter("k = 'combined'").first().state == "current"
    assert series.freshness(rows.filter("false"), "2024-03-06", "week", "k").first().state == "unavailable"


def test_issued_asof_falls_back_by_view(spark):
    rows = [(1, "regular", 5.0), (1, "feeding", 2.0), (1, "combined", 9.0), (2, "regular", 6.0)]
    df = spark.createDataFrame([(r, d("2024-03-01"), v, x, d("2024-02-01") + dt.timedelta(days=r)) for r, v, x in rows], "run_id long, target date, view string, value double, issued date")
    assert [tuple(r) for r in series.issued_asof(df).collect()] == [(d("2024-03-01"), None, 6.0, 2.0, None)]


def test_names(spark):
    one = lambda column, texts: [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(column(F.col("x"))).collect()]
    aliases, groups = {"corner shop": "Corner"}, {"mainst": "Main Street"}
    got = one(lambda c: ingest.canonical_customer(c, aliases, groups), ["  Corner  SHOP. ", "Main - St.", "outlet sales (north)", "WALK IN no 4", "Lee / walk-in", "(Cancelled)", "Lee (si12) - ", None])
    assert got == ["Corner", "Main Street", "Outlet Sales", "Walk-in", "Lee", None, "Lee", None]
    got = one(lambda c: ingest.canonical_product(c, {"bigmilk": "Milk L"}, {"old": "New"}), ["Big (Milk)", " tm200 ", "pdx 13", "OLD", "Cara 200ml", None])
    assert got == ["Milk L", "TM200", "PDX 13", "New", "Cara 200ml", None]
    assert one(ingest.category_of, ["Raw milk 2L", "WC", "Ube cheese", "Kesong cheese", "Choco pie", "soap"]) == [
        "Milk & Dairy Drinks", "Cheese & Cultured Dairy", "Milk & Dairy Drinks", "Cheese & Cultured Dairy", "Snacks & Desserts", "Other Products"
    ]


def test_customer_merge_reasons(spark):
    rows = [(1, "a", "1", None, None), (2, "A", "2", None, ""), (3, "b", None, None, None), (4, "b ", None, None, None), (5, "c", None, "x@y", None), (6, "c", None, "X@y ", None), (7, "d", None, None, None), (8, "D", None, None, None)]
    df = spark.createDataFrame(rows, "customer_id long, name string, phone string, email string, address string")
    got = {r.key: (r.keeper, r.decision, r.conflicts) for r in ingest.customer_merge_plan(df).collect()}
    assert got == {"a": (1, "conflicting_contact", "phone"), "b": (3, "unconfirmed", ""), "c": (5, "merge", ""), "d": (7, "unconfirmed", "")}
    assert ingest.customer_merge_plan(df, reviewed=("b",)).filter("key = 'b'").first().decision == "merge"


def test_customer_names_are_read_once(spark):
    """Long expressions that name each other do not multiply, customers are not copied for each contact that is counted."""
    df = spark.createDataFrame([], "customer_id long, name string, phone string, email string, address string")
    plan = ingest.customer_merge_plan(df, ("b",), {"x": "y"}, {"z": "w"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("cancelled") <= 4
