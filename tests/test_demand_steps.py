"""The steps of item demand that must not grow faster than their input, and give the same however rows are dealt."""

import datetime as dt

from pyspark.sql import functions as F

from shopweave.operators import hierarchy, series

DAY = dt.date(2024, 1, 1)
DATES = hierarchy.Dates(dt.date(2024, 7, 1), dt.date(2024, 2, 1), dt.date(2024, 7, 1), 12)


def test_variation_does_not_depend_on_the_order_of_rows(spark):
    """Folded in order of buckets, to the last digit. The code before F6 passes this too: it differed only at ties of six decimals."""
    values = [0.1, 7.3, 1e6, 2.7, 0.3, 5.9, 3.1, 8.8, 1.1, 4.4, 6.6, 9.9, 2.2]
    rows = [(k, (DAY + dt.timedelta(31 * i)).replace(day=1), v) for k in range(50) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, bucket date, value double")
    kinds = [df.repartition(n).orderBy(F.rand(n)) for n in (1, 3, 7)]
    found = [{(r.cv2, r["class"]) for r in series.demand_class(d, "k").collect()} for d in kinds]
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def test_dense_series_need_no_join_with_the_calendar(spark):
    rows = [("regular", 1, dt.date(2024, 1, 1), 1.0, 0), ("regular", 1, dt.date(2024, 4, 1), 3.0, 0), ("regular", 2, dt.date(2024, 5, 1), 2.0, 1), ("regular", 2, dt.date(2024, 6, 1), 5.0, 0), ("regular", 3, dt.date(2024, 6, 1), None, 1), ("regular", 4, dt.date(2024, 7, 1), 1.0, 0)]
    values = spark.createDataFrame(rows, "segment string, product_id long, bucket date, value double, unknown int")
    out = hierarchy.dense(values, DATES, values.filter("month(bucket) <> 3"), hierarchy.PERIODS["monthly"], "segment", "product_id")
    got = sorted((r.product_id, r.bucket.month, r.value) for r in out.collect())
    # January lies before the run; no sale at all is known of March and February; product 3 is never known, product 4 is sold after the cutoff.
    assert [g[:2] for g in got] == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 5), (2, 6)]
    assert [g[2] for g in got] == [None, None, 3.0, 0.0, 0.0, None, 5.0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the covered buckets, a few rows that are broadcast


def test_sums_up_the_catalog_do_not_expand_items(spark):
    rows = [(s, p, "quantity", c, "L", "available", 1, 0, 1, 1, DAY, v) for s, p, c, v in (("regular", 1, "a", 1.5), ("feeding", 1, "a", 2.0), ("regular", 2, "b", None))]
    parts = spark.createDataFrame(rows, "segment string, product_id long, metric string, category string, unit string, status string, supported int, provisional int, total int, step int, bucket date, value double")
    out = hierarchy.rolled_up(parts)
    got = {(r.view, r.level, r.category, r.product_id): (r.value, r.total) for r in out.collect()}
    assert got == {
        ("regular", "item", "a", 1): (1.5, 1), ("feeding", "item", "a", 1): (2.0, 1), ("combined", "item", "a", 1): (3.5, 2), ("regular", "item", "b", 2): (None, 1), ("combined", "item", "b", 2): (None, 1),
        ("regular", "category", "a", None): (1.5, 1), ("feeding", "category", "a", None): (2.0, 1), ("combined", "category", "a", None): (3.5, 2), ("regular", "category", "b", None): (None, 1), ("combined", "category", "b", None): (None, 1),
        ("regular", "overall", None, None): (1.5, 2), ("feeding", "overall", None, None): (2.0, 1), ("combined", "overall", None, None): (3.5, 3),
    }
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sums_above_the_items_do_not_make_the_items(spark):
    parts = spark.createDataFrame([("regular", 1, "quantity", "a", "L", "available", 1, 0, 1, 1, DAY, 1.5)], "segment string, product_id long, metric string, category string, unit string, status string, supported int, provisional int, total int, step int, bucket date, value double")
    out = hierarchy.rolled_up(parts).filter("level <> 'item'")
    assert out.count() == 4
    assert "min(status" not in out._jdf.queryExecution().optimizedPlan().toString()
