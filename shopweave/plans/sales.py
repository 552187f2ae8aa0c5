"""Queries of the sales reports over the shop's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopweave.functions.columns import product_label
from shopweave.operators import sales as op
from shopweave.plans.prelude import sql
from shopweave.sources.shop import Shop

START, END, BEFORE_START, BEFORE_END = "1998-03-01", "1998-03-31", "1998-02-01", "1998-02-28"
WIDE_START, WIDE_END, AS_OF = "1997-01-15", "1998-06-20", "1999-06-30"
HIDDEN = ("ECONOMY",)

PERIOD = f"period AS (SELECT * FROM receipt WHERE NOT voided AND day BETWEEN DATE '{START}' AND DATE '{END}')"
WIDE = f"period AS (SELECT * FROM receipt WHERE NOT voided AND day BETWEEN DATE '{WIDE_START}' AND DATE '{WIDE_END}')"
SOLD = """sold AS (SELECT l.*, p.day, p.method, coalesce(l.snap_name, d.name) AS name, d.variant, d.category, d.unit
    FROM line l JOIN period p ON p.id = l.receipt_id LEFT JOIN product d USING (product_id))"""
LABEL = "CASE WHEN coalesce(variant, '') = '' THEN name ELSE name || ' · ' || variant END"


def money(x: str) -> str:
    return f"coalesce({x}, 0)::DOUBLE"


def growth(now: str, before: str) -> str:
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {now} = 0 THEN NULL ELSE 100.0 END ELSE round(({now} - {before}) * 100.0 / {before}, 2) END"


def _period(s: Shop):
    return op.in_period(s.receipts, START, END)


def _wide(s: Shop):
    return op.in_period(s.receipts, WIDE_START, WIDE_END)


def _sold(s: Shop, receipts=None):
    return op.sold_lines(receipts if receipts is not None else _wide(s), s.lines, s.products)


def _compare(start, end, bs, be) -> str:
    return sql(f""", sums AS (SELECT
        {money(f"sum(CASE WHEN day BETWEEN DATE '{start}' AND DATE '{end}' THEN amount END)")} AS revenue,
        {money(f"sum(CASE WHEN day BETWEEN DATE '{bs}' AND DATE '{be}' THEN amount END)")} AS revenue_before,
        count(CASE WHEN day BETWEEN DATE '{start}' AND DATE '{end}' THEN 1 END) AS receipts,
        count(CASE WHEN day BETWEEN DATE '{bs}' AND DATE '{be}' THEN 1 END) AS receipts_before FROM receipt WHERE NOT voided)
        SELECT *, {growth('revenue', 'revenue_before')} AS revenue_growth, {growth('receipts', 'receipts_before')} AS receipts_growth FROM sums""")


def _revenue(period: str, cut: str):
    run = lambda s: op.revenue_by(_wide(s), period)
    return run, sql(f", {WIDE} SELECT {cut} AS bucket, {money('sum(amount)')} AS total FROM period GROUP BY 1")


def _report(start: str, end: str, before_start: str, before_end: str):
    run = lambda s: op.period_report(s.receipts, s.lines, s.products, start, end, before_start, before_end)
    period = f"period AS (SELECT * FROM receipt WHERE NOT voided AND day BETWEEN DATE '{start}' AND DATE '{end}')"
    return run, sql(f""", {period}, {SOLD}, days AS (SELECT d::DATE AS bucket FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) g(d)),
        before AS (SELECT {money('sum(amount)')} AS previous, count(*)::DOUBLE AS n FROM receipt WHERE NOT voided AND day BETWEEN DATE '{before_start}' AND DATE '{before_end}'),
        whole AS (SELECT {money('sum(amount)')} AS revenue, count(*)::DOUBLE AS n FROM period)
        SELECT 'total' AS section, 'revenue' AS label, revenue, n AS quantity FROM whole
        UNION ALL SELECT 'total', 'previous', previous, n FROM before
        UNION ALL SELECT 'total', 'growth_percent', {growth('revenue', 'previous')}, NULL FROM whole CROSS JOIN before
        UNION ALL SELECT 'total', 'average_ticket', CASE WHEN n = 0 THEN 0.0 ELSE round(revenue / n, 2) END, NULL FROM whole
        UNION ALL SELECT 'total', 'gross', {money('sum(amount)')}, {money('sum(quantity)')} FROM sold
        UNION ALL SELECT 'payment', method, {money('sum(amount)')}, count(*)::DOUBLE FROM period GROUP BY method
        UNION ALL SELECT 'category', category, {money('sum(amount)')}, {money('sum(quantity)')} FROM sold GROUP BY category
        UNION ALL SELECT 'family', name, {money('sum(amount)')}, {money('sum(quantity)')} FROM sold GROUP BY name
        UNION ALL SELECT 'product', {LABEL}, {money('sum(amount)')}, {money('sum(quantity)')} FROM sold GROUP BY 2
        UNION ALL SELECT 'week', greatest(date_trunc('week', day)::DATE, DATE '{start}')::VARCHAR, {money('sum(amount)')}, count(*)::DOUBLE FROM period GROUP BY 2
        UNION ALL SELECT 'day', bucket::VARCHAR, {money('sum(amount)')}, NULL FROM days LEFT JOIN period ON day = bucket GROUP BY bucket""")


QUERIES = {
    "src_ledger": (
        lambda s: s.receipts.filter(f"not voided and day < date '{AS_OF}'").select("id", "day", "customer_id", "customer_name", "reference", "segment", "label", F.col("amount").cast("double").alias("amount")),
        sql(f"SELECT id, day, customer_id, customer_name, reference, segment, label, amount::DOUBLE AS amount FROM receipt WHERE NOT voided AND day < DATE '{AS_OF}'"),
    ),
    "eff_line_revenue": (
        lambda s: s.lines.select("receipt_id", "line", "product_id", F.col("quantity").cast("double").alias("quantity"), F.col("amount").cast("double").alias("amount")),
        sql("SELECT receipt_id, line, product_id, quantity::DOUBLE AS quantity, amount::DOUBLE AS amount FROM line"),
    ),
    "snapshot_attrs": (
        lambda s: op.with_attributes(s.lines, s.products).groupBy("name", "variant", "category").agg(F.count("*").alias("rows"), op.money(F.sum("amount")).alias("revenue")),
        sql(f"""SELECT coalesce(snap_name, name) AS name, variant, category, count(*) AS rows, {money('sum(amount)')} AS revenue
            FROM line LEFT JOIN product USING (product_id) GROUP BY 1, 2, 3"""),
    ),
    "product_label": (lambda s: s.products.select("product_id", product_label().alias("label")), sql(f"SELECT product_id, {LABEL} AS label FROM product")),
    "period_filter": (lambda s: _period(s).select("id", "day", F.col("amount").cast("double").alias("amount")), sql(f", {PERIOD} SELECT id, day, amount::DOUBLE AS amount FROM period")),
    "history_filter": (
        lambda s: op.search_history(s.receipts, WIDE_START, WIDE_END, "SI00", ("cash", "online"), ("paid", "pending")).select("id", "day", "invoice", "customer_name"),
        sql(f"""SELECT id, day, invoice, customer_name FROM receipt WHERE NOT voided AND day BETWEEN DATE '{WIDE_START}' AND DATE '{WIDE_END}'
            AND method IN ('cash', 'online') AND status IN ('paid', 'pending')
            AND (contains(lower(invoice), 'si00') OR coalesce(contains(lower(customer_name), 'si00'), false) OR contains(lower(reference), 'si00'))"""),
    ),
    "history_order_date": (
        lambda s: op.order_dates(s.lines.groupBy(F.col("receipt_id").alias("order_id")).agg(F.min("shipped").alias("ordered")), s.receipts.filter("id % 3 = 0")),
        sql("""SELECT l.receipt_id AS order_id, coalesce(any_value(r.day), min(l.shipped)) AS day FROM line l
            LEFT JOIN (SELECT * FROM receipt WHERE id % 3 = 0) r ON r.id = l.receipt_id GROUP BY 1"""),
    ),
    "transaction_flags": (
        lambda s: op.flags(s.receipts),
        sql("""SELECT id, day, encoded_later AS is_manually_encoded, NOT voided AND status <> 'paid' AND NOT starts_with(reference, '2026:') AS can_update_payment,
            CASE WHEN NOT starts_with(reference, '2026:') THEN handled_by END AS cashier FROM receipt"""),
    ),
    "visible_receipts": (
        lambda s: op.visible(s.receipts, s.lines, s.products, 3, HIDDEN).select("id", "day"),
        sql("""SELECT id, day FROM receipt r WHERE handled_by = 3 AND NOT EXISTS
            (SELECT 1 FROM line l JOIN product p USING (product_id) WHERE l.receipt_id = r.id AND p.category = 'ECONOMY')"""),
    ),
    "visible_orders": (
        lambda s: op.visible(op.visible(s.receipts, s.lines.filter("subtotal is null"), s.products, 2, HIDDEN), s.lines.filter("subtotal is not null"), s.products, 2, ("PROMO",)).select("id", "status"),
        sql("""SELECT id, status FROM receipt r WHERE handled_by = 2
            AND NOT EXISTS (SELECT 1 FROM line l JOIN product p USING (product_id) WHERE l.receipt_id = r.id AND l.subtotal IS NULL AND p.category = 'ECONOMY')
            AND NOT EXISTS (SELECT 1 FROM line l JOIN product p USING (product_id) WHERE l.receipt_id = r.id AND l.subtotal IS NOT NULL AND p.category = 'PROMO')"""),
    ),
    "policy_lookup": (
        lambda s: op.decided(s.lines, s.products).groupBy("decision").agg(F.count("*").alias("rows"), op.money(F.sum("amount")).alias("revenue")),
        sql(f"SELECT coalesce(decision, 'review') AS decision, count(*) AS rows, {money('sum(amount)')} AS revenue FROM line LEFT JOIN product USING (product_id) GROUP BY 1"),
    ),
    "revenue_by_period": _revenue("monthly", "date_trunc('month', day)::DATE"),
    "revenue_daily": _revenue("daily", "day"),
    "revenue_weekly": _revenue("weekly", "date_trunc('week', day)::DATE"),
    "revenue_yearly": _revenue("yearly", "date_trunc('year', day)::DATE"),
    "best_sellers": (
        lambda s: op.best_sellers(_sold(s), 10),
        sql(f""", {WIDE}, {SOLD} SELECT product_id, name, variant, {money('sum(quantity)')} AS quantity FROM sold GROUP BY 1, 2, 3
            ORDER BY sum(quantity) DESC, product_id, name, variant LIMIT 10"""),
    ),
    "sales_by_category": (
        lambda s: op.by_category(_sold(s)),
        sql(f""", {WIDE}, {SOLD}, sums AS (SELECT category, sum(quantity) AS q FROM sold GROUP BY 1)
            SELECT category, {money('q')} AS quantity, round(q::DOUBLE * 100 / (SELECT sum(q)::DOUBLE FROM sums), 1) AS percent FROM sums"""),
    ),
    "sales_summary": (lambda s: op.summary(_period(s)), sql(f", {PERIOD} SELECT {money('sum(amount)')} AS revenue, count(*) AS receipts FROM period")),
    "growth_vs_previous": (lambda s: op.compared(s.receipts, START, END, "1998-01-29", BEFORE_END), _compare(START, END, "1998-01-29", BEFORE_END)),
    "month_to_date_compare": (lambda s: op.compared(s.receipts, START, "1998-03-17", BEFORE_START, "1998-02-17"), _compare(START, "1998-03-17", BEFORE_START, "1998-02-17")),
    "sales_drivers": (
        lambda s: op.drivers(_wide(s), s.lines),
        sql(f""", {WIDE} SELECT (SELECT {money('sum(l.amount)')} FROM line l WHERE l.receipt_id IN (SELECT id FROM period)) AS gross,
            {money('sum(amount)')} AS net, round(sum(amount)::DOUBLE / count(*), 2) AS average_ticket, count(*) AS receipts FROM period"""),
    ),
    "payment_mix": (lambda s: op.payment_mix(_wide(s)), sql(f", {WIDE} SELECT method, count(*) AS receipts, {money('sum(amount)')} AS revenue FROM period GROUP BY 1")),
    "category_mix": (lambda s: op.mix(_sold(s), "category"), sql(f", {WIDE}, {SOLD} SELECT category, {money('sum(amount)')} AS gross, {money('sum(quantity)')} AS quantity FROM sold GROUP BY 1")),
    "family_mix": (lambda s: op.mix(_sold(s), "name"), sql(f", {WIDE}, {SOLD} SELECT name, {money('sum(amount)')} AS gross, {money('sum(quantity)')} AS quantity FROM sold GROUP BY 1")),
    "product_breakdown": (
        lambda s: op.product_breakdown(_sold(s)),
        sql(f", {WIDE}, {SOLD} SELECT {LABEL} AS label, {money('sum(amount)')} AS revenue, {money('sum(quantity)')} AS quantity FROM sold GROUP BY 1"),
    ),
    "daily_breakdown": (
        lambda s: op.daily_breakdown(_wide(s), WIDE_START, WIDE_END),
        sql(f""", {WIDE}, days AS (SELECT d::DATE AS bucket FROM generate_series(DATE '{WIDE_START}', DATE '{WIDE_END}', INTERVAL 1 DAY) g(d))
            SELECT bucket, {money('sum(amount)')} AS revenue, count(id) AS receipts FROM days LEFT JOIN period ON day = bucket GROUP BY 1"""),
    ),
    "weekly_breakdown": (
        lambda s: op.weekly_breakdown(_wide(s), WIDE_START, WIDE_END),
        sql(f""", {WIDE} SELECT greatest(date_trunc('week', day)::DATE, DATE '{WIDE_START}') AS week_start,
            least(date_trunc('week', day)::DATE + 6, DATE '{WIDE_END}') AS week_end, {money('sum(amount)')} AS revenue, count(*) AS receipts FROM period GROUP BY 1, 2"""),
    ),
    "history_summary": (
        lambda s: op.history_summary(_wide(s)),
        sql(f""", {WIDE} SELECT count(*) AS receipts, {money('sum(amount)')} AS revenue, """
            + ", ".join(f"count(CASE WHEN status = '{x}' THEN 1 END) AS {x}_count, {money(f"sum(CASE WHEN status = '{x}' THEN amount END)")} AS {x}_amount" for x in ("paid", "pending", "unknown")) + " FROM period"),
    ),
    "order_summary": (
        lambda s: op.order_summary(s.receipts),
        sql(f"""SELECT count(*) AS orders, count(CASE WHEN NOT voided THEN 1 END) AS fulfilled, count(CASE WHEN voided THEN 1 END) AS cancelled,
            count(CASE WHEN NOT voided AND status = 'pending' THEN 1 END) AS pending_payment, {money('sum(CASE WHEN NOT voided THEN amount END)')} AS active_revenue FROM receipt"""),
    ),
    "customer_totals": (
        lambda s: op.customer_totals(s.customers, s.receipts),
        sql(f"""SELECT c.customer_id, count(r.id) AS receipts, max(r.day) AS last_sale, {money('sum(r.amount)')} AS lifetime
            FROM client c LEFT JOIN receipt r ON r.customer_id = c.customer_id AND NOT r.voided GROUP BY 1"""),
    ),
    "customer_accounts": (
        lambda s: op.customer_accounts(_wide(s)),
        sql(f""", {WIDE} SELECT customer_id, max(customer_name) AS name, count(*) AS purchases, {money('sum(amount)')} AS spent,
            {money("sum(CASE WHEN status = 'paid' THEN amount END)")} AS paid, {money("sum(CASE WHEN status = 'pending' THEN amount END)")} AS pending,
            {money("sum(CASE WHEN status = 'unknown' THEN amount END)")} AS unknown, count(CASE WHEN status = 'pending' THEN 1 END) AS pending_count,
            max(day) AS last_purchase FROM period WHERE customer_id IS NOT NULL GROUP BY 1"""),
    ),
    "customer_month_grid": (
        lambda s: op.customer_month_grid(_wide(s), WIDE_START, WIDE_END),
        sql(f""", {WIDE}, months AS (SELECT m::DATE AS month FROM generate_series(date_trunc('month', DATE '{WIDE_START}'), DATE '{WIDE_END}', INTERVAL 1 MONTH) g(m)),
            who AS (SELECT DISTINCT customer_id FROM period WHERE customer_id IS NOT NULL)
            SELECT w.customer_id, m.month, least(last_day(m.month), DATE '{WIDE_END}') AS month_end, {money('sum(p.amount)')} AS spent
            FROM who w CROSS JOIN months m LEFT JOIN period p ON p.customer_id = w.customer_id AND date_trunc('month', p.day)::DATE = m.month GROUP BY 1, 2, 3"""),
    ),
    "customer_kpis": (
        lambda s: op.customer_kpis(_wide(s), WIDE_END),
        sql(f""", {WIDE}, each AS (SELECT customer_id, count(*) AS n, sum(amount) AS s, max(day) AS last_day, bool_or(status = 'pending') AS pending
            FROM period WHERE customer_id IS NOT NULL GROUP BY 1)
            SELECT count(*) AS customers, count(CASE WHEN n >= 2 THEN 1 END) AS repeat_customers, count(CASE WHEN pending THEN 1 END) AS pending_customers,
            count(CASE WHEN last_day > DATE '{WIDE_END}' - 90 THEN 1 END) AS active_customers, round(sum(s)::DOUBLE / count(*), 2) AS average_lifetime,
            (SELECT {money('sum(amount)')} FROM period WHERE customer_id IS NULL) AS unassigned_revenue FROM each"""),
    ),
    "report_cube": (
        lambda s: op.report_cube(_sold(s)),
        sql(f""", {WIDE}, {SOLD}, cut AS (SELECT *, date_trunc('month', day)::DATE AS month FROM sold)
            SELECT method, category, month, grouping(method, category, month)::BIGINT AS level, sum(amount)::DOUBLE AS gross, sum(quantity)::DOUBLE AS quantity, count(*) AS rows
            FROM cut GROUP BY GROUPING SETS ((method), (category), (method, category), (month), ())"""),
    ),
    "demo_exclusion": (lambda s: op.demo_split(s.receipts), sql("SELECT regexp_matches(reference, '^2026:[0-9]{6}$') AS demo, count(*) AS receipts FROM receipt GROUP BY 1")),
    "recent_orders": (lambda s: op.recent_orders(s.receipts, 2).select("id", "day"), sql("SELECT id, day FROM receipt WHERE NOT voided ORDER BY created_at DESC, id DESC LIMIT 2")),
    "top_customers": (
        lambda s: op.top_customers(op.customer_accounts(_wide(s)), 20),
        sql(f""", {WIDE} SELECT customer_id, max(customer_name) AS name, {money('sum(amount)')} AS spent FROM period WHERE customer_id IS NOT NULL
            GROUP BY 1 ORDER BY spent DESC, name, customer_id LIMIT 20"""),
    ),
    "history_page": (
        lambda s: op.history_page(s.receipts, 3, 50).select("id", F.col("amount").cast("double").alias("amount")),
        sql("SELECT id, amount::DOUBLE AS amount FROM receipt ORDER BY amount DESC NULLS LAST, id LIMIT 50 OFFSET 100"),
    ),
    "daily_report": _report("1998-03-17", "1998-03-17", "1998-03-16", "1998-03-16"),
    "weekly_report": _report("1998-03-16", "1998-03-22", "1998-03-09", "1998-03-15"),
    "monthly_report": _report(START, END, BEFORE_START, BEFORE_END),
}
