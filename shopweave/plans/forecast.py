"""Queries that fit models: rows and tests stand for SQL, which cannot express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopweave.operators import forecast as op
from shopweave.operators import series
from shopweave.plans.hierarchy import items
from shopweave.plans.ledger import snap
from shopweave.plans.series import monthly


def _segments(s):
    return series.on_calendar(monthly(s), "1 month", "segment")


def _weeks(s):
    return series.weekly_run(snap(s).select("segment", "day", F.col("revenue").cast("double").alias("value")), "segment")


def _sarima(s):
    """Monthly: 12 test and 6 validation origins; weekly: 13 and 13."""
    months = op.select_model(op.walk_forward(_segments(s), "segment", tuple(op.MONTHLY_SARIMA), 18), "segment")
    weeks = op.select_model(op.walk_forward(_weeks(s), "segment", tuple(op.WEEKLY_SARIMA), 26), "segment", 13)
    return months.withColumn("period", F.lit("monthly")).union(weeks.withColumn("period", F.lit("weekly")))


def _items(s):
    """Revenue of every item by month, the item being named by segment and product."""
    return items(s).filter("metric = 'revenue'").select(F.concat_ws(":", "segment", "product_id").alias("item"), "bucket", "value")


def _lately(s):
    """The segments' series as if sales had begun with 1998."""
    return _segments(s).filter("bucket >= date '1998-01-01'")


def _outlook(s):
    """Twelve months and 52 weeks ahead."""
    months = op.whole_path(op.seasonal_forecast(_segments(s), "segment", 12, 12), "segment", 12).withColumn("period", F.lit("monthly"))
    return months.unionByName(op.whole_path(op.seasonal_forecast(_weeks(s), "segment", 52, 52), "segment", 52).withColumn("period", F.lit("weekly")))


QUERIES = {
    "trend_flag": (lambda s: op.trends(_items(s), "item"), None),
    "seasonal_strength": (lambda s: op.shape(_segments(s), "segment", 12).select("segment", "strength", "is_seasonal"), None),
    "cycle_flag": (lambda s: op.shape(_segments(s), "segment", 12).select("segment", "period", "has_cycle"), None),
    "seasonal_decompose": (lambda s: op.components(_segments(s), "segment", 12), None),
    "sarima_forecast": (lambda s: op.seasonal_forecast(_items(s), "item", 12, 6), None),
    "sarima_select": (_sarima, None),
    "comparators": (lambda s: op.select_model(op.walk_forward(_segments(s), "segment", ("level", "damped", "ridge_10", "ridge_100")), "segment"), None),
    "short_history_projection": (lambda s: op.projection(_lately(s), "segment", 12, 6), None),
    "seasonal_outlook": (_outlook, None),
    "gap_matched_eval": (lambda s: op.gap_matched(_segments(s), "segment", 12, 6, 2), None),
}
