"""Queries without SQL run over whole tables, not over ids that some filter picks."""

import os

import pytest
from pyspark.sql import functions as F

from shopweave.operators.sales import decided
from shopweave.plans import registry
from shopweave.plans.hierarchy import Demand, items
from shopweave.plans.ingest import sheet_rows
from shopweave.plans.inventory import _cancelled
from shopweave.plans.ledger import snap
from shopweave.sources.shop import Shop

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def sold(s):
    """Dairy products of which a quantity was sold on any classified sale before the cutoff, by segment."""
    kept = snap(s).filter("segment in ('regular', 'feeding')").filter(F.col("day") < F.lit(Demand(s).dates.cutoff)).select(F.col("sale_id").alias("receipt_id"), "segment")
    lines = decided(s.lines, s.products).filter("decision = 'dairy' and entered_quantity > 0").join(kept, "receipt_id")
    return {(r.segment, r.product_id) for r in lines.select("segment", "product_id").distinct().collect()}


@pytest.fixture(scope="module")
def plain(spark):
    return items(Shop(spark, DIR)).persist()


def test_item_series_hold_every_product_sold(spark, plain):
    quantities = plain.filter("metric = 'quantity'").select("segment", "product_id").distinct().collect()
    assert {(r.segment, r.product_id) for r in quantities} == sold(Shop(spark, DIR))


def test_item_models_hold_every_series(spark, plain):
    names = {(r.segment, r.product_id, r.metric) for r in plain.select("segment", "product_id", "metric").distinct().collect()}
    found = registry.queries()["item_forecast"](spark, DIR).select("segment", "product_id", "metric").distinct().collect()
    assert {tuple(r) for r in found} == names and {n[0] for n in names} == {"regular", "feeding"}
    for name in ("trend_flag", "sarima_forecast"):
        found = {r.item for r in registry.queries()[name](spark, DIR).select("item").distinct().collect()}
        assert found == {f"{s}:{p}" for s, p, m in names if m == "revenue"}


def test_adjustments_reach_both_segments(spark, plain):
    before = {(r.segment, r.product_id, r.bucket): r.value for r in plain.filter("metric = 'revenue' and value is not null").collect()}
    changed = {(r.segment, r.product_id) for r in registry.queries()["expert_adjust"](spark, DIR).collect() if r.value != before[r.segment, r.product_id, r.bucket]}
    assert {s for s, _ in changed} == {"regular", "feeding"} and len(changed) > 100


def test_sheets_hold_every_line(spark):
    s = Shop(spark, DIR)
    rows = sheet_rows(s)
    assert rows.count() == s.lines.count()
    assert rows.filter("c0 <> ''").count() == s.lines.select("receipt_id").distinct().filter("receipt_id % 6 <> 1").count()
    assert registry.queries()["ticketize_rows"](spark, DIR).agg(F.sum("lines")).first()[0] == s.lines.count()


def test_cancelled_lines_are_those_of_voided_receipts(spark):
    s = Shop(spark, DIR)
    voided = {r.id for r in s.receipts.filter("voided").collect()}
    assert {r.r for r in _cancelled(s).select(F.expr("line_id div 10").alias("r")).collect()} == {r.receipt_id for r in s.lines.collect() if r.receipt_id in voided}
