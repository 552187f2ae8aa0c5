"""Queries of item demand and the catalog above it, by month; SQL makes the plain forecast of last year's month, the model has none."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopweave.operators import hierarchy as op
from shopweave.operators import series
from shopweave.plans.ledger import AS_OF, FACTS, facts
from shopweave.plans.prelude import sql
from shopweave.sources.scratch import written
from shopweave.sources.shop import Shop

MONTHLY = op.PERIODS["monthly"]
WINDOW = 36
DATES = f"""{FACTS}, sold AS (SELECT segment, product_id, date_trunc('month', day)::DATE AS bucket, max(day) AS last_day, sum(quantity) AS quantity, sum(unknown_quantity) AS unknown_quantity,
        sum(revenue) AS revenue, sum(unknown_revenue) AS unknown_revenue FROM item_fact GROUP BY 1, 2, 3),
    limits AS (SELECT CASE WHEN last_day(max(last_day)) = max(last_day) THEN (date_trunc('month', max(last_day)) + INTERVAL 1 MONTH)::DATE ELSE date_trunc('month', max(last_day))::DATE END AS lim FROM sold),
    closed AS (SELECT DISTINCT bucket FROM sold, limits WHERE bucket + INTERVAL 1 MONTH <= lim),
    islands AS (SELECT bucket, date_diff('month', DATE '1970-01-01', bucket) - row_number() OVER (ORDER BY bucket) AS island FROM closed),
    dates AS (SELECT (max(bucket) + INTERVAL 1 MONTH)::DATE AS cutoff, min(bucket) AS run_start FROM islands WHERE island = (SELECT max(island) FROM islands))"""


def dense_sql(keys: str, source: str, name: str) -> str:
    """A series of `source` (keys, bucket, value, unknown) as dense() makes it."""
    return f"""{name}_known AS (SELECT s.* FROM {source} s, dates WHERE bucket < cutoff),
    {name}_span AS (SELECT {keys}, greatest(min(bucket), any_value(run_start)) AS lo, any_value(cutoff) AS cutoff FROM {name}_known, dates GROUP BY {keys} HAVING count(value) > 0),
    {name}_cal AS (SELECT {keys}, unnest(generate_series(lo, cutoff - INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS bucket FROM {name}_span),
    {name} AS (SELECT {keys}, bucket, CASE WHEN unknown > 0 THEN NULL WHEN value IS NOT NULL THEN round(value, 2) WHEN unknown IS NULL AND bucket IN (SELECT bucket FROM sold) THEN 0.0 END AS value
        FROM {name}_cal LEFT JOIN {name}_known USING ({keys}, bucket))"""


def last_year_sql(keys: str, source: str, name: str, active: bool) -> str:
    live = "coalesce((SELECT any_value(p.active) FROM product p WHERE p.product_id = s.product_id), true)" if active else "true"
    same = " AND ".join(f"b.{k} = t.{k}" for k in keys.split(", "))
    return f"""{name}_size AS (SELECT {keys}, count(value) AS known, count(*) FILTER (value > 0) AS positive, count(*) AS n FROM {source} GROUP BY {keys}),
    {name}_state AS (SELECT *, CASE WHEN NOT {live} THEN 'inactive_item' WHEN positive < 6 THEN 'insufficient_history' WHEN known >= 24 THEN 'available'
        WHEN n > 12 THEN 'provisional' ELSE 'insufficient_history' END AS status FROM {name}_size s),
    {name} AS (SELECT {', '.join('t.' + k for k in keys.split(', '))}, t.status, (t.status IN ('available', 'provisional'))::INTEGER AS supported, (t.status = 'provisional')::INTEGER AS provisional,
        1 AS total, k::INTEGER AS step, (cutoff + INTERVAL (k - 1) MONTH)::DATE AS bucket, CASE WHEN t.status IN ('available', 'provisional') THEN b.value END AS value
        FROM {name}_state t CROSS JOIN dates CROSS JOIN range(1, 13) r(k) LEFT JOIN {source} b ON {same} AND b.bucket + INTERVAL 1 YEAR = cutoff + INTERVAL (k - 1) MONTH)"""


JUDGED = """CASE WHEN supported = 0 THEN 'insufficient_history' WHEN supported < total THEN 'partial' WHEN provisional > 0 THEN 'provisional' ELSE 'available' END"""
ITEMS = f"""{DATES}, item_long AS (SELECT segment, product_id, 'quantity' AS metric, bucket, quantity AS value, unknown_quantity AS unknown FROM sold
        UNION ALL SELECT segment, product_id, 'revenue', bucket, revenue, unknown_revenue FROM sold),
    {dense_sql('segment, product_id, metric', 'item_long', 'items')}"""
NODES = f"""{ITEMS}, {last_year_sql('segment, product_id, metric', 'items', 'issued', True)},
    named AS (SELECT v.view, i.* EXCLUDE (segment), round(i.value, 2)::DECIMAL(24,2) AS cents, CASE WHEN metric = 'quantity' THEN coalesce(p.unit, '') ELSE '' END AS unit, coalesce(p.category, 'unallocated') AS category
        FROM issued i LEFT JOIN product p USING (product_id) CROSS JOIN (VALUES (true), (false)) own(own) CROSS JOIN LATERAL (SELECT CASE WHEN own THEN i.segment ELSE 'combined' END AS view) v),
    summed AS (SELECT view, metric, unit, category, product_id, step, bucket, grouping(category, product_id) AS lvl, sum(cents)::DOUBLE AS value, sum(supported) AS supported, sum(provisional) AS provisional,
        sum(total) AS total, min(status) AS own FROM named
        GROUP BY GROUPING SETS ((view, metric, unit, step, bucket), (view, metric, unit, category, step, bucket), (view, metric, unit, category, product_id, step, bucket))),
    nodes AS (SELECT view, CASE lvl WHEN 3 THEN 'overall' WHEN 1 THEN 'category' ELSE 'item' END AS level, metric, unit, category, product_id, step, bucket, value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper,
        supported::BIGINT AS supported, provisional::BIGINT AS provisional, total::BIGINT AS total, CASE WHEN lvl = 0 AND total = 1 THEN own ELSE {JUDGED} END AS status,
        CASE WHEN provisional = supported THEN 'unvalidated_short_history' WHEN provisional > 0 THEN 'mixed_validated_and_unvalidated' END AS accuracy_status FROM summed)"""
UNITS = f"""unit_long AS (SELECT segment, CASE WHEN grouping(p.category) = 0 THEN 'category' ELSE 'overall' END AS scope, CASE WHEN grouping(p.category) = 0 THEN p.category ELSE '' END AS category, p.unit, bucket,
        coalesce(sum(quantity), 0) AS value, sum(unknown_quantity) AS unknown FROM sold JOIN product p USING (product_id) GROUP BY GROUPING SETS ((segment, p.category, p.unit, bucket), (segment, p.unit, bucket))),
    {dense_sql('segment, scope, category, unit', 'unit_long', 'units')}"""
FILLED = f"""{NODES}, {UNITS}, {last_year_sql('segment, scope, category, unit', 'units', 'spare_all', False)},
    ours AS (SELECT view, level, coalesce(category, '') AS category, unit, step, bucket, value, supported, provisional, total, status, 'items' AS basis FROM nodes WHERE metric = 'quantity' AND level <> 'item'),
    has AS (SELECT view, level, category, unit FROM ours WHERE view <> 'combined' GROUP BY ALL HAVING bool_or(value IS NOT NULL)),
    spare AS (SELECT segment AS view, scope AS level, category, unit, step, bucket, value, supported::BIGINT AS supported, provisional::BIGINT AS provisional, total::BIGINT AS total, status, scope || '_quantity' AS basis
        FROM spare_all WHERE (segment, scope, category, unit) NOT IN (SELECT (view, level, category, unit) FROM has)),
    whole AS (SELECT * FROM ours WHERE view <> 'combined' AND (view, level, category, unit) NOT IN (SELECT (view, level, category, unit) FROM spare) UNION ALL SELECT * FROM spare),
    useful AS (SELECT * FROM whole WHERE (level, category) IN (SELECT (level, category) FROM spare)
        AND (view, level, category, unit) IN (SELECT (view, level, category, unit) FROM whole GROUP BY view, level, category, unit HAVING count(value) > 0)),
    added AS (SELECT level, category, unit, step, bucket, sum(round(value, 2)::DECIMAL(24,2))::DOUBLE AS value, sum(supported)::BIGINT AS supported, sum(provisional)::BIGINT AS provisional, sum(total)::BIGINT AS total FROM useful GROUP BY ALL),
    again AS (SELECT 'combined' AS view, level, category, unit, step, bucket, value, supported, provisional, total, {JUDGED} AS status, 'segment_totals' AS basis FROM added),
    filled AS (SELECT * FROM whole UNION ALL SELECT * FROM again
        UNION ALL SELECT * FROM ours WHERE view = 'combined' AND (level, category, unit) NOT IN (SELECT (level, category, unit) FROM again))"""


class Demand:
    """What the monthly queries of a shop share: cells by segment and product, written once, and the dates they give."""

    def __init__(self, s: Shop):
        self.products = s.products
        self.sold = written(op.cells(facts(s), MONTHLY, "segment", "product_id"))
        self.dates = op.calendar(self.sold, MONTHLY, AS_OF)

    @property
    def items(self):
        return op.item_series(self.sold, self.dates, MONTHLY)

    @property
    def units(self):
        return op.unit_series(self.sold, self.products, self.dates, MONTHLY)

    @property
    def nodes(self):
        """Sums of item forecasts that SQL can make too."""
        rows = op.last_year(self.items, self.dates, self.products.select("product_id", "active"), *op.ITEM)
        named = rows.join(self.products.select("product_id", "category", "unit"), "product_id", "left")
        return op.rolled_up(named.withColumns({"category": F.coalesce("category", F.lit("unallocated")), "unit": F.coalesce("unit", F.lit(""))}))


def items(s: Shop):
    """Quantity and revenue of every item by month."""
    return Demand(s).items


def _filled(s: Shop):
    d = Demand(s)
    # Items' own nodes are not filled; without them their sums are not made.
    return op.filled(written(d.nodes.filter("level <> 'item'")), op.last_year(d.units, d.dates, None, *op.UNIT), written)


def _scope(s: Shop):
    d = Demand(s)
    return op.scope_series(d.sold, d.products, d.dates, MONTHLY, "category", "quantity", window=WINDOW)


def _item_forecast(s: Shop):
    d = Demand(s)
    found = op.estimated(op.item_arrays(d.sold, d.dates, MONTHLY), d.products, d.dates, MONTHLY)
    rows = op.steps(found, d.dates, MONTHLY, *op.ITEM, "known_periods", "nonzero_periods", "interpolated_periods", "mae", "wape", "bias")
    # What is kept of a long projection: the first horizon, and from three buckets before the present one.
    early = F.col("bucket") < MONTHLY.after(F.lit(d.dates.cutoff), MONTHLY.horizon)
    return rows.filter(early | (F.col("bucket") >= MONTHLY.after(F.lit(d.dates.projection_start), -3)))


def _hierarchy(s: Shop):
    d = Demand(s)
    return op.hierarchy(d.sold, d.products, d.dates, MONTHLY, written)


def _adjusted(s: Shop):
    """Revenue by month as the baseline; every line is a revision of its product's month, its receipt's number telling the segment."""
    paths = items(s).filter("metric = 'revenue' and value is not null").select("segment", "product_id", "bucket", "value")
    changes = s.lines.selectExpr(
        "if(receipt_id % 5 = 0, 'feeding', 'regular') as segment", "product_id", "trunc(shipped, 'month') as bucket", "receipt_id * 10 + line as version",
        "element_at(array('absolute', 'delta', 'percent'), cast(receipt_id % 3 + 1 as int)) as kind", "cast(quantity as double) - 25 as amount",
    )
    return series.expert_adjusted(paths, changes, "segment", "product_id", "bucket")


QUERIES = {
    "bucket_item_series": (items, sql(f", {ITEMS} SELECT * FROM items")),
    "demand_class": (
        lambda s: series.demand_class(items(s), *op.ITEM),
        sql(f""", {ITEMS}, e AS (SELECT segment, product_id, metric, count(*) AS buckets, count(value) AS observed, count(CASE WHEN value > 0 THEN 1 END) AS positive,
                avg(CASE WHEN value > 0 THEN value END) AS mean, stddev_pop(CASE WHEN value > 0 THEN value END) AS sd FROM items GROUP BY 1, 2, 3),
            c AS (SELECT *, buckets / positive AS adi, (sd / mean) * (sd / mean) AS cv2, observed = buckets AND buckets >= 12 AND positive >= 4 AS enough FROM e)
            SELECT segment, product_id, metric, observed, positive, CASE WHEN enough THEN round(adi, 6) END AS adi, CASE WHEN enough THEN round(cv2, 6) END AS cv2,
                CASE WHEN NOT enough THEN 'insufficient' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'stable' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS class FROM c"""),
    ),
    "segment_unit_series": (lambda s: Demand(s).units, sql(f", {DATES}, {UNITS} SELECT * FROM units")),
    "rollup_hierarchy": (lambda s: Demand(s).nodes, sql(f", {NODES} SELECT * FROM nodes")),
    "fill_aggregate": (_filled, sql(f", {FILLED} SELECT * FROM filled")),
    "scope_series": (
        _scope,
        sql(f""", {DATES}, scope_long AS (SELECT p.category || ' / ' || p.unit AS scope_id, bucket, sum(quantity) AS value, sum(unknown_quantity) AS unknown FROM sold JOIN product p USING (product_id) GROUP BY 1, 2),
            {dense_sql('scope_id', 'scope_long', 'scopes')} SELECT scope_id, bucket, value FROM scopes, dates WHERE bucket >= cutoff - INTERVAL {WINDOW} MONTH"""),
    ),
    "catalog_with_unsold": (
        lambda s: s.products.select("category").distinct().join(facts(s).join(s.products.select("product_id", "category"), "product_id").groupBy("category").agg(F.sum("revenue").alias("v"), F.countDistinct("product_id").alias("items")), "category", "left").select("category", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("revenue"), F.coalesce("items", F.lit(0)).alias("items")),
        sql(f", {FACTS} SELECT c.category, round(coalesce(sum(f.revenue), 0), 2) AS revenue, count(DISTINCT f.product_id) AS items FROM product c LEFT JOIN item_fact f USING (product_id) GROUP BY 1"),
    ),
    "expert_adjust": (
        _adjusted,
        sql(f""", {ITEMS}, c AS (SELECT CASE WHEN receipt_id % 5 = 0 THEN 'feeding' ELSE 'regular' END AS segment, product_id, date_trunc('month', shipped)::DATE AS bucket,
                arg_max((['absolute', 'delta', 'percent'][receipt_id % 3 + 1], quantity::DOUBLE - 25), (receipt_id * 10 + line, quantity)) AS c FROM line GROUP BY 1, 2, 3),
            n AS (SELECT i.*, CASE c[1] WHEN 'absolute' THEN c[2] WHEN 'delta' THEN value + c[2] WHEN 'percent' THEN value * (100 + c[2]) / 100 ELSE value END AS new
                FROM items i LEFT JOIN c USING (segment, product_id, bucket) WHERE metric = 'revenue' AND value IS NOT NULL)
            SELECT segment, product_id, bucket, greatest(round(new::DECIMAL(24,6), 2), 0)::DOUBLE AS value FROM n"""),
    ),
    "item_forecast": (_item_forecast, None),
    "hierarchy_forecast": (_hierarchy, None),
}
