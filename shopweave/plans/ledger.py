"""Queries of the sales ledger, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopweave.operators import ledger as op
from shopweave.operators import sales
from shopweave.plans.prelude import sql
from shopweave.plans.sales import money
from shopweave.sources.scratch import shared_dir
from shopweave.sources.shop import Shop

AS_OF = "1999-06-30"
DEMO = "regexp_matches(reference, '^2026:[0-9]{6}$')"
SNAPSHOT = f"""decided AS (SELECT l.receipt_id, l.amount, coalesce(p.decision, 'review') AS decision FROM line l LEFT JOIN product p USING (product_id)),
    by_receipt AS (SELECT receipt_id AS id, coalesce(sum(amount) FILTER (decision = 'dairy'), 0) AS dairy, sum(amount) AS gross, bool_and(decision = 'non_dairy') AS none_kept,
        bool_or(decision = 'review') AS review FROM decided GROUP BY 1),
    eligible AS (SELECT *, trim(coalesce(source_label, '')) AS own_label FROM receipt WHERE NOT voided AND day < DATE '{AS_OF}' AND NOT {DEMO}),
    snap AS (SELECT e.id AS sale_id, e.day,
        CASE WHEN customer_id IS NOT NULL THEN 'customer:' || customer_id WHEN own_label <> '' THEN 'label:' || regexp_replace(lower(own_label), '\\s+', ' ', 'g') ELSE 'walk-in' END AS customer_key,
        CASE WHEN own_label <> '' THEN own_label WHEN customer_name IS NOT NULL THEN customer_name ELSE 'Walk-in' END AS customer_name,
        CASE WHEN explicit_segment IS NOT NULL THEN explicit_segment WHEN gross IS NULL OR review OR gross <= 0 THEN 'unclassified'
            WHEN contains(lower(CASE WHEN own_label <> '' THEN own_label ELSE coalesce(customer_name, 'Walk-in') END), 'feedin') THEN 'feeding' ELSE 'regular' END AS segment,
        CASE WHEN explicit_segment IS NOT NULL OR gross IS NULL OR review OR gross <= 0 THEN amount ELSE
            (((2 * (amount * 100)::HUGEINT * (dairy * 100)::HUGEINT + (gross * 100)::HUGEINT) // (2 * (gross * 100)::HUGEINT))::DECIMAL(20,0) / 100)::DECIMAL(20,2) END AS revenue
        FROM eligible e LEFT JOIN by_receipt b USING (id) WHERE explicit_segment IS NOT NULL OR NOT coalesce(none_kept, false))"""
FACTS = f"""{SNAPSHOT}, kept AS (SELECT sale_id, day, segment, (revenue * 100)::BIGINT AS net_cents FROM snap WHERE segment IN ('regular', 'feeding')),
    dairy AS (SELECT l.receipt_id, l.line, l.product_id, l.l_suppkey, l.l_extendedprice, l.shipped, k.day, k.segment, k.net_cents, CASE WHEN l.entered_quantity > 0 THEN l.entered_quantity END AS quantity,
        CASE WHEN l.entered_amount >= 0 THEN (l.entered_amount * 100)::BIGINT END AS worth FROM line l JOIN product p USING (product_id) JOIN kept k ON k.sale_id = l.receipt_id WHERE p.decision = 'dairy'),
    grossed AS (SELECT *, CASE WHEN count(worth) OVER w = count(*) OVER w THEN sum(worth) OVER w END AS gross FROM dairy WINDOW w AS (PARTITION BY receipt_id)),
    floored AS (SELECT *, CASE WHEN gross > 0 THEN net_cents::HUGEINT * worth // gross END AS base, CASE WHEN gross > 0 THEN net_cents::HUGEINT * worth % gross END AS rest FROM grossed),
    dairy_line AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY receipt_id ORDER BY rest DESC NULLS LAST, line, product_id, l_suppkey, l_extendedprice, shipped)
        <= net_cents - sum(base) OVER (PARTITION BY receipt_id) THEN 1 ELSE 0 END AS cents FROM floored),
    item_fact AS (SELECT day, segment, product_id, sum(quantity)::DOUBLE AS quantity, sum(cents)::DOUBLE / 100 AS revenue, count(*) AS lines, count(*) - count(quantity) AS unknown_quantity, count(*) - count(cents) AS unknown_revenue
        FROM dairy_line GROUP BY 1, 2, 3
        UNION ALL SELECT day, segment, -1, NULL, sum(net_cents)::DOUBLE / 100, count(*), count(*), 0 FROM kept WHERE sale_id NOT IN (SELECT receipt_id FROM dairy_line WHERE cents IS NOT NULL) GROUP BY 1, 2)"""
ALLOCATED = """weighted AS (SELECT l.receipt_id, l.line, l.product_id, l.l_suppkey, l.l_extendedprice, l.shipped, l.quantity, r.day, r.segment,
        CASE WHEN l.receipt_id % 9 = 0 THEN 0 ELSE (l.amount * 100)::BIGINT END AS weight, (r.amount * 100)::BIGINT AS net_cents FROM line l JOIN receipt r ON r.id = l.receipt_id WHERE NOT r.voided),
    based AS (SELECT *, sum(weight) OVER w AS weights, CASE WHEN sum(weight) OVER w > 0 THEN net_cents::HUGEINT * weight // sum(weight) OVER w END AS base,
        CASE WHEN sum(weight) OVER w > 0 THEN net_cents::HUGEINT * weight % sum(weight) OVER w END AS rest FROM weighted WINDOW w AS (PARTITION BY receipt_id)),
    shared AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY receipt_id ORDER BY rest DESC NULLS LAST, line, product_id, l_suppkey, l_extendedprice, shipped)
        <= net_cents - sum(base) OVER (PARTITION BY receipt_id) THEN 1 ELSE 0 END AS cents FROM based)"""


def snap(s: Shop):
    return op.snapshot(s.receipts, sales.decided(s.lines, s.products), AS_OF)


def allocated(s: Shop):
    receipts = s.receipts.filter("not voided").select(F.col("id").alias("receipt_id"), "day", "segment", F.expr("cast(amount * 100 as bigint)").alias("net_cents"))
    lines = s.lines.join(receipts, "receipt_id").withColumn("weight", F.expr("if(receipt_id % 9 = 0, 0L, cast(amount * 100 as bigint))"))
    return op.allocated(lines, "line", "product_id", "l_suppkey", "l_extendedprice", "shipped")


def facts(s: Shop):
    sold = snap(s)
    return op.item_facts(op.dairy_lines(sales.decided(s.lines, s.products), sold), sold)


def _closure(s: Shop):
    return op.year_closure(s.receipts, s.lines, s.products, s.batches, s.customers, 1996, 1997)


def _invoices(s: Shop):
    waiting = s.receipts.filter("id % 17 = 0").select("id", F.year("day").alias("year"))
    return op.invoice_assign(waiting, op.invoice_taken(s.receipts.filter("id % 17 <> 0")), op.invoice_seed(s.receipts.filter("id % 17 <> 0")))


def _export(s: Shop):
    """Two whole years and all they refer to, written, and the manifest held against the files."""
    tables, folder = _closure(s), shared_dir(s.spark)
    return op.verified_export(op.export_years(tables, folder), tables, folder)


def _appended(s: Shop):
    """Every fifth submission is stored first, then all are offered; what the table holds in the end."""
    folder, rows = shared_dir(s.spark), s.submissions.select("user_id", "request_id", "event_id")
    op.append_once(rows.filter("event_id % 5 = 0"), folder, "user_id", "request_id")
    op.append_once(rows, folder, "user_id", "request_id")
    return s.spark.read.parquet(folder).select("user_id", "request_id", "event_id")


def _report_file(s: Shop):
    """The yearly report as a JSON document, written and read back."""
    folder, report = shared_dir(s.spark), sales.revenue_by(s.receipts.filter("not voided"), "yearly").withColumn("bucket", F.col("bucket").cast("string"))
    document = op.report_document(report, "yearly", "1999-06-30")
    document.write.json(folder)
    back = s.spark.read.schema(document.schema).json(folder)
    return back.select("type", "generated_at", F.size("data").cast("long").alias("n"), F.expr("aggregate(data, 0D, (a, r) -> a + r.total)").alias("total"))


QUERIES = {
    "sales_snapshot": (
        lambda s: snap(s).withColumn("revenue", F.col("revenue").cast("double")),
        sql(f", {SNAPSHOT} SELECT sale_id, day, customer_key, customer_name, segment, revenue::DOUBLE AS revenue FROM snap"),
    ),
    "multi_cutoff_snapshots": (
        lambda s: op.at_cutoffs(snap(s), ["1995-06-01", "1996-01-01", "1997-06-15", "1999-01-01"]),
        sql(f""", {SNAPSHOT} SELECT c.cutoff, count(sale_id) AS sales, {money('sum(revenue)')} AS revenue
            FROM (VALUES (DATE '1995-06-01'), (DATE '1996-01-01'), (DATE '1997-06-15'), (DATE '1999-01-01')) c(cutoff) LEFT JOIN snap ON day < cutoff GROUP BY 1"""),
    ),
    "net_allocation": (
        lambda s: allocated(s).select("receipt_id", "line", "product_id", F.col("cents").cast("long").alias("cents")),
        sql(f", {ALLOCATED} SELECT receipt_id, line, product_id, cents::BIGINT AS cents FROM shared"),
    ),
    "item_facts": (facts, sql(f", {FACTS} SELECT * FROM item_fact")),
    "segment_monthly": (
        lambda s: op.segment_monthly(snap(s)),
        sql(f", {SNAPSHOT} SELECT date_trunc('month', day)::DATE AS month, segment, {money('sum(revenue)')} AS revenue, count(*) AS receipts, count(DISTINCT day) AS days FROM snap GROUP BY 1, 2"),
    ),
    "customer_profile": (
        lambda s: op.customer_profile(snap(s)),
        sql(f""", {SNAPSHOT}, own AS (SELECT * FROM snap WHERE customer_key <> 'walk-in' AND segment = 'regular'), days AS (SELECT DISTINCT customer_key, day FROM own),
            whole AS (SELECT max(day) AS through, sum(revenue) FILTER (segment = 'regular')::DOUBLE AS total FROM snap),
            g AS (SELECT customer_key, day - lag(day) OVER (PARTITION BY customer_key ORDER BY day) AS gap FROM days),
            gs AS (SELECT customer_key, count(*) AS purchase_days, quantile_cont(gap::DOUBLE, 0.5) AS median_gap, count(gap) AS n_gaps, avg(gap) AS mean_gap, stddev_pop(gap) AS sd_gap FROM g GROUP BY 1),
            e AS (SELECT customer_key, count(*) AS receipts, count(DISTINCT date_trunc('month', day)) AS active_months, min(day) AS first_day, max(day) AS last_day,
                {money('sum(revenue)')} AS revenue, quantile_cont(revenue::DOUBLE, 0.5) AS median_receipt FROM own GROUP BY 1)
            SELECT customer_key, receipts, purchase_days, active_months, first_day, last_day, (through - last_day)::INTEGER AS days_since_last, revenue, round(revenue * 100 / total, 4) AS revenue_share, median_receipt, median_gap,
                CASE WHEN n_gaps >= 3 AND mean_gap > 0 THEN round(sd_gap / mean_gap, 6) END AS gap_cv,
                CASE WHEN n_gaps > 0 THEN (through - last_day) > greatest(30.0, 3 * median_gap) END AS lapsed FROM e JOIN gs USING (customer_key), whole"""),
    ),
    "customer_gaps": (
        lambda s: op.customer_gaps(snap(s)),
        sql(f""", {SNAPSHOT}, days AS (SELECT DISTINCT customer_key, day FROM snap WHERE customer_key <> 'walk-in' AND segment = 'regular'),
            g AS (SELECT customer_key, day, (day - lag(day) OVER (PARTITION BY customer_key ORDER BY day))::INTEGER AS gap FROM days) SELECT * FROM g WHERE gap IS NOT NULL"""),
    ),
    "calendar_effects": (
        lambda s: op.calendar_effects(snap(s)),
        sql(f""", {SNAPSHOT}, keys AS (SELECT 'weekday' AS kind, k::INTEGER AS k FROM range(1, 8) t(k) UNION ALL SELECT 'band', k::INTEGER FROM range(1, 6) t(k)),
            cut AS (SELECT 'weekday' AS kind, isodow(day)::INTEGER AS k, revenue FROM snap WHERE segment = 'regular'
                UNION ALL SELECT 'band', least((dayofmonth(day) - 1) // 7 + 1, 5)::INTEGER, revenue FROM snap WHERE segment = 'regular')
            SELECT kind, k, {money('sum(revenue)')} AS revenue, count(revenue) AS receipts FROM keys LEFT JOIN cut USING (kind, k) GROUP BY 1, 2"""),
    ),
    "data_quality": (
        lambda s: op.data_quality(s.receipts, snap(s), AS_OF),
        sql(f""", {SNAPSHOT}, b AS (SELECT count(CASE WHEN {DEMO} THEN 1 END) AS excluded_demo, count(*) AS receipts FROM receipt WHERE NOT voided AND day < DATE '{AS_OF}'),
            k AS (SELECT count(*) AS sales, count(CASE WHEN segment = 'unclassified' THEN 1 END) AS unclassified, count(CASE WHEN segment = 'feeding' THEN 1 END) AS feeding,
                count(CASE WHEN revenue < 0 THEN 1 END) AS negative, count(CASE WHEN segment = 'regular' AND NOT starts_with(customer_key, 'customer:') THEN 1 END) AS unlinked, (DATE '{AS_OF}' - max(day))::INTEGER AS age_days FROM snap)
            SELECT *, receipts - excluded_demo - sales AS excluded_non_dairy FROM b, k"""),
    ),
    "invoice_seed": (
        lambda s: op.invoice_seed(s.receipts),
        sql("""SELECT year(day)::INTEGER AS year, substr(arg_max(trim(invoice), (created_at, id)), 3)::BIGINT AS seed FROM receipt WHERE regexp_full_match(trim(invoice), '[Ss][Ii][0-9]+') GROUP BY 1"""),
    ),
    "invoice_assign": (
        _invoices,
        sql(r""", held AS (SELECT *, upper(trim(invoice)) AS si FROM receipt WHERE id % 17 <> 0 AND regexp_full_match(trim(invoice), '[Ss][Ii][0-9]+')),
            taken AS (SELECT DISTINCT year(day) AS year, si FROM held),
            seeds AS (SELECT year(day) AS year, substr(arg_max(si, (created_at, id)), 3)::BIGINT AS seed FROM held GROUP BY 1),
            w AS (SELECT id, year(day) AS year, row_number() OVER (PARTITION BY year(day) ORDER BY id) AS k FROM receipt WHERE id % 17 = 0),
            f AS (SELECT s.year, n.number, row_number() OVER (PARTITION BY s.year ORDER BY n.number) AS k FROM seeds s, range(1, 5000 + (SELECT count(*) FROM receipt)) n(number)
                WHERE n.number > s.seed AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.year = s.year AND t.si = 'SI' || CASE WHEN n.number < 10000 THEN lpad(n.number::VARCHAR, 4, '0') ELSE n.number::VARCHAR END))
            SELECT id, year::INTEGER AS year, 'SI' || CASE WHEN number < 10000 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END AS invoice FROM w JOIN f USING (year, k)"""),
    ),
    "invoice_duplicates": (
        lambda s: op.invoice_duplicates(s.receipts),
        sql("SELECT year(day)::INTEGER AS year, upper(trim(invoice)) AS number, count(*) AS receipts, min(id) AS first_id FROM receipt WHERE invoice_source <> 'automatic' GROUP BY 1, 2 HAVING count(*) > 1"),
    ),
    "submission_conflicts": (
        lambda s: op.submission_conflicts(s.submissions),
        sql(""", f AS (SELECT user_id, request_id, arg_min((event_id, endpoint, payload), (ts, event_id)) AS f FROM submission GROUP BY 1, 2)
            SELECT event_id, user_id, request_id, CASE WHEN event_id = f[1] THEN 'new' WHEN endpoint = f[2] AND payload = f[3] THEN 'replay' ELSE 'conflict' END AS verdict
            FROM submission JOIN f USING (user_id, request_id)"""),
    ),
    "table_fingerprint": (lambda s: op.fingerprint(s.receipts, without=("created_at",)), None),
    "series_signature": (lambda s: op.signatures(facts(s), "segment", "product_id"), None),
    "namespace_remove": (
        lambda s: op.without_demo(s.lines, s.receipts, "receipt_id").groupBy("product_id").agg(F.count("*").alias("rows"), op.money(F.sum("amount")).alias("revenue")),
        sql(f"SELECT product_id, count(*) AS rows, {money('sum(amount)')} AS revenue FROM line WHERE receipt_id NOT IN (SELECT id FROM receipt WHERE {DEMO}) GROUP BY 1"),
    ),
    "reference_closure": (
        lambda s: op.manifest(_closure(s)),
        sql(f""", kept AS (SELECT * FROM receipt WHERE year(day) BETWEEN 1996 AND 1997 AND NOT {DEMO}), own AS (SELECT * FROM line WHERE receipt_id IN (SELECT id FROM kept))
            SELECT 'receipt' AS table_name, count(*) AS rows FROM kept UNION ALL SELECT 'line', count(*) FROM own
            UNION ALL SELECT 'product', count(*) FROM product WHERE product_id IN (SELECT product_id FROM own)
            UNION ALL SELECT 'batch', count(*) FROM batch WHERE batch_id IN (SELECT batch_id FROM own)
            UNION ALL SELECT 'customer', count(*) FROM client WHERE customer_id IN (SELECT customer_id FROM kept)"""),
    ),
    "sink_year_export": (
        _export,
        sql(f""", kept AS (SELECT * FROM receipt WHERE year(day) BETWEEN 1996 AND 1997 AND NOT {DEMO}), own AS (SELECT * FROM line WHERE receipt_id IN (SELECT id FROM kept)), counted AS (
            SELECT 'receipt' AS table_name, count(*) AS rows FROM kept UNION ALL SELECT 'line', count(*) FROM own
            UNION ALL SELECT 'product', count(*) FROM product WHERE product_id IN (SELECT product_id FROM own)
            UNION ALL SELECT 'batch', count(*) FROM batch WHERE batch_id IN (SELECT batch_id FROM own)
            UNION ALL SELECT 'customer', count(*) FROM client WHERE customer_id IN (SELECT customer_id FROM kept)) SELECT table_name, rows, true AS verified FROM counted"""),
    ),
    "sink_append_once": (
        _appended,
        sql("""SELECT user_id, request_id, coalesce(min(event_id) FILTER (event_id % 5 = 0), min(event_id)) AS event_id FROM submission GROUP BY 1, 2"""),
    ),
    "sink_report_json": (
        _report_file,
        sql("""SELECT 'yearly' AS type, '1999-06-30' AS generated_at, count(*) AS n, sum(t ORDER BY y) AS total
            FROM (SELECT year(day) AS y, sum(amount)::DOUBLE AS t FROM receipt WHERE NOT voided GROUP BY 1)"""),
    ),
}
