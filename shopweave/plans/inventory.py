"""Queries of stock and movements, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopweave.operators import inventory as op
from shopweave.plans.prelude import sql
from shopweave.plans.sales import money

AS_OF, START, END = "1999-06-30", "1999-02-01", "1999-04-30"
DATE = f"DATE '{AS_OF}'"
#: The day on which receipts are cancelled.
VOIDED_ON = "1996-06-30"
SELLABLE = f"status = 'available' AND expiry >= {DATE} AND received <= {DATE} AND NOT reference_only"
AVAILABLE = f"stocked AS (SELECT p.product_id, p.active, {money('sum(b.remaining)')} AS stock FROM product p LEFT JOIN (SELECT * FROM batch WHERE {SELLABLE}) b USING (product_id) GROUP BY 1, 2)"
EXPIRED = f"remaining > 0 AND received <= {DATE} AND NOT reference_only AND (status = 'expired' OR (status = 'available' AND expiry < {DATE}))"
EXPIRING = f"status = 'available' AND remaining > 0 AND NOT reference_only AND expiry BETWEEN {DATE} AND {DATE} + 7"
HEALTH = f"""live AS (SELECT * FROM batch WHERE remaining > 0 AND received <= {DATE} AND NOT reference_only AND status = 'available'),
    summed AS (SELECT p.product_id, {money(f"sum(CASE WHEN b.expiry >= {DATE} THEN b.remaining END)")} AS stock, min(CASE WHEN b.expiry >= {DATE} THEN b.expiry END) AS next_expiry FROM product p LEFT JOIN live b USING (product_id) WHERE p.active GROUP BY 1),
    health AS (SELECT product_id, stock, next_expiry, CASE WHEN stock <= 0 THEN 'no_stock'
        WHEN next_expiry <= {DATE} + 7 THEN 'expiring_soon' ELSE 'healthy' END AS status, stock <= 20 AS low FROM summed)"""
BUYER = "CASE WHEN customer_id IS NOT NULL THEN 'c:' || customer_id WHEN lower(trim(label)) <> 'outlet sales' THEN 'l:' || label ELSE 'outlet' END"
SALES = f"""gone AS (SELECT l.product_id, l.batch_id, r.moved_day AS day, {BUYER} AS buyer, l.quantity FROM line l JOIN receipt r ON r.id = l.receipt_id
    WHERE NOT r.voided OR r.id IN (SELECT receipt_id FROM stock_return))"""
MOVES = f"""{SALES}, own AS (SELECT * FROM batch WHERE NOT reference_only AND received <= {DATE}),
    moves AS (
        SELECT o.product_id, g.day, 'sale' AS kind, g.buyer, -g.quantity::DECIMAL(20,2) AS change FROM gone g JOIN own o USING (batch_id)
        UNION ALL SELECT o.product_id, a.day, 'adjustment', NULL, -a.quantity::DECIMAL(20,2) FROM adjustment a JOIN own o USING (batch_id)
        UNION ALL SELECT o.product_id, r.day, 'return', NULL, r.quantity::DECIMAL(20,2) FROM stock_return r JOIN own o USING (batch_id)
        UNION ALL SELECT product_id, received, 'received', NULL, initial::DECIMAL(20,2) FROM own)"""


def _in(test: str) -> str:
    return f"coalesce(sum(CASE WHEN day BETWEEN DATE '{START}' AND DATE '{END}' AND {test} THEN change END), 0)"


LEDGER = f"""{MOVES}, now AS (SELECT product_id, sum(remaining) AS now FROM own GROUP BY 1),
    sums AS (SELECT product_id, coalesce(sum(CASE WHEN day > DATE '{END}' THEN change END), 0) AS later, {_in("kind = 'received'")} AS received,
        -{_in("kind = 'sale' AND buyer = 'outlet'")} AS outlet, -{_in("kind = 'sale' AND buyer <> 'outlet'")} AS allocations,
        -{_in("kind IN ('adjustment', 'return')")} AS adjustments FROM moves GROUP BY 1),
    ended AS (SELECT p.product_id, coalesce(now, 0) - coalesce(later, 0) AS ending, coalesce(received, 0) AS received, coalesce(outlet, 0) AS outlet,
        coalesce(allocations, 0) AS allocations, coalesce(adjustments, 0) AS adjustments FROM product p LEFT JOIN now USING (product_id) LEFT JOIN sums USING (product_id) WHERE active)"""


def _moves(s, as_of=AS_OF):
    return op.movements(s.receipts, s.lines, s.batches, s.adjustments, s.returns, as_of)


def _sales(s):
    return op.sale_movements(s.receipts, s.lines, s.returns)


def _demands(s):
    """A demand for each product and month of sales; its batches' initial stock is always enough."""
    d = s.lines.groupBy("product_id", F.trunc("shipped", "month").alias("m")).agg(F.sum("quantity").alias("wanted"))
    return d.select(F.expr("product_id * 100000 + year(m) * 12 + month(m)").alias("demand_id"), "product_id", "wanted")


def _pieces(s):
    rows = s.lines.select(F.expr("receipt_id * 100000 + product_id").alias("line_id"), "line", "l_suppkey", "quantity")
    return rows.withColumn("price", F.expr("cast(line_id % 97 as decimal(10,3)) * 0.125").cast("decimal(10,3)"))


def _cancelled(s):
    lines = s.lines.join(s.receipts.filter("voided").select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi")
    return lines.select(F.expr("receipt_id * 10 + line").alias("line_id"), "batch_id", "quantity").groupBy("line_id", "batch_id").agg(F.sum("quantity").alias("quantity"))


#: Each batch's state after each of its adjustments; each product's stock after each of its demands: one after the other.
REPLAY = "WITH RECURSIVE" + sql("""
    , dealt AS MATERIALIZED (SELECT a.batch_id, a.id, a.kind, a.quantity AS q, a.day, b.initial, b.expiry, b.received, row_number() OVER (PARTITION BY a.batch_id ORDER BY a.day, a.id, a.kind, a.quantity) AS k
        FROM adjustment a JOIN batch b ON b.batch_id = a.batch_id),
    state AS (SELECT batch_id, 0::BIGINT AS k, NULL::BIGINT AS id, '' AS kind, 0::DECIMAL(12,2) AS q, FALSE AS fine, remaining AS rest, status FROM batch WHERE batch_id IN (SELECT batch_id FROM dealt)
        UNION ALL SELECT batch_id, k, id, kind, q, fine, CASE WHEN fine THEN rest - q ELSE rest END::DECIMAL(12,2),
            CASE WHEN NOT fine THEN status WHEN rest - q <= 0 THEN CASE WHEN kind IN ('expired', 'spoilage') THEN 'disposed' ELSE 'depleted' END WHEN kind = 'correction' AND status = 'depleted' THEN 'available' ELSE status END
        FROM (SELECT d.*, rest, status, status <> 'disposed' AND (d.kind IN ('expired', 'spoilage') OR status <> 'expired' AND d.expiry >= d.day) AND d.received <= d.day
                AND (d.q > 0 OR d.kind = 'correction') AND d.q <= rest AND rest - d.q <= d.initial AS fine FROM state s JOIN dealt d ON d.batch_id = s.batch_id AND d.k = s.k + 1))
    SELECT batch_id, id, kind, q::DOUBLE AS quantity, fine AS accepted, rest::DOUBLE AS "left", status FROM state WHERE k > 0""")[4:]
REFUSALS = "WITH RECURSIVE" + sql("""
    , d AS (SELECT product_id * 100000 + year(shipped) * 12 + month(shipped) AS demand_id, product_id, sum(quantity) AS wanted FROM line GROUP BY 1, 2),
    asked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY demand_id) AS k FROM d),
    supply AS MATERIALIZED (SELECT product_id, batch_id, remaining AS n, sum(remaining) OVER (PARTITION BY product_id ORDER BY expiry, batch_id) AS b_end FROM batch WHERE remaining > 0),
    state AS (SELECT product_id, 0::BIGINT AS k, NULL::BIGINT AS demand_id, 0::DECIMAL(28,2) AS wanted, FALSE AS fine, coalesce((SELECT sum(n) FROM supply u WHERE u.product_id = p.product_id), 0)::DECIMAL(28,2) AS rest
            FROM (SELECT DISTINCT product_id FROM asked) p
        UNION ALL SELECT a.product_id, a.k, a.demand_id, a.wanted::DECIMAL(28,2), a.wanted <= rest, CASE WHEN a.wanted <= rest THEN rest - a.wanted ELSE rest END::DECIMAL(28,2)
        FROM state s JOIN asked a ON a.product_id = s.product_id AND a.k = s.k + 1),
    taken AS (SELECT *, sum(wanted) OVER (PARTITION BY product_id ORDER BY demand_id) AS d_end FROM state WHERE fine)
    SELECT demand_id, t.product_id, batch_id, (least(d_end, b_end) - greatest(d_end - wanted, b_end - n))::DOUBLE AS quantity, TRUE AS accepted FROM taken t JOIN supply u ON u.product_id = t.product_id
        WHERE d_end - wanted < b_end AND b_end - n < d_end
    UNION ALL SELECT demand_id, product_id, NULL, 0, FALSE FROM state WHERE k > 0 AND NOT fine""")[4:]


QUERIES = {
    "expired_stock": (
        lambda s: op.expired(s.batches, AS_OF).select("batch_id", "product_id", "expiry", F.col("remaining").cast("double").alias("remaining")),
        sql(f"SELECT batch_id, product_id, expiry, remaining::DOUBLE AS remaining FROM batch WHERE {EXPIRED}"),
    ),
    "expiring_stock": (
        lambda s: op.expiring(s.batches, AS_OF).select("batch_id", "product_id", "expiry", "label"),
        sql(f"SELECT batch_id, product_id, expiry, CASE WHEN expiry <= {DATE} + 3 THEN 'critical' ELSE 'near_expiry' END AS label FROM batch WHERE {EXPIRING}"),
    ),
    "adjustment_history": (
        lambda s: op.adjustment_history(s.adjustments, ("damage", "theft"), START, END).select("batch_id", "kind", "day", F.col("quantity").cast("double").alias("quantity")),
        sql(f"SELECT batch_id, kind, day, quantity::DOUBLE AS quantity FROM adjustment WHERE kind IN ('damage', 'theft') AND day BETWEEN DATE '{START}' AND DATE '{END}'"),
    ),
    "available_stock": (lambda s: op.available(s.products, s.batches, AS_OF), sql(f", {AVAILABLE} SELECT product_id, stock FROM stocked")),
    "low_stock": (lambda s: op.low_stock(s.products, s.batches, AS_OF), sql(f", {AVAILABLE} SELECT product_id, stock FROM stocked WHERE active AND stock <= 20")),
    "stock_health": (lambda s: op.stock_health(s.products, s.batches, AS_OF), sql(f", {HEALTH} SELECT * FROM health")),
    "stock_status_counts": (
        lambda s: op.status_counts(op.stock_health(s.products, s.batches, AS_OF), s.products, s.batches, AS_OF),
        sql(f""", {HEALTH} SELECT 'products' AS kind, k.status, count(h.product_id) AS n FROM (VALUES ('no_stock'), ('expired'), ('expiring_soon'), ('healthy')) k(status) LEFT JOIN health h USING (status) GROUP BY 2
            UNION ALL SELECT 'products', 'low', count(*) FROM health WHERE low UNION ALL SELECT 'products', 'all', count(*) FROM product WHERE active
            UNION ALL SELECT 'batches', 'expired', count(*) FROM batch WHERE {EXPIRED} UNION ALL SELECT 'batches', 'expiring_soon', count(*) FROM batch WHERE {EXPIRING} AND received <= {DATE}"""),
    ),
    "movement_union": (
        lambda s: _moves(s).groupBy("kind", "day").agg(F.count("*").alias("rows"), op.money(F.sum("change")).alias("change")),
        sql(f", {MOVES} SELECT kind, day, count(*) AS rows, {money('sum(change)')} AS change FROM moves GROUP BY 1, 2"),
    ),
    "inventory_ledger_range": (
        lambda s: op.ledger(s.products, s.batches, _moves(s, END), START, END, END),
        sql(f""", {LEDGER.replace(f"received <= {DATE}", f"received <= DATE '{END}'")} SELECT product_id, (ending + outlet + allocations + adjustments - received)::DOUBLE AS beginning, received::DOUBLE AS received,
            (ending + outlet + allocations + adjustments)::DOUBLE AS total, outlet::DOUBLE AS outlet, allocations::DOUBLE AS allocations,
            adjustments::DOUBLE AS adjustments, ending::DOUBLE AS ending FROM ended"""),
    ),
    "inventory_ledger_today": (
        lambda s: op.ledger(s.products, s.batches, _moves(s), AS_OF, "9999-12-31", AS_OF),
        sql(f""", {LEDGER.replace(f"DATE '{START}'", DATE).replace(f"DATE '{END}'", "DATE '9999-12-31'")}
            SELECT product_id, (ending + outlet + allocations + adjustments - received)::DOUBLE AS beginning, received::DOUBLE AS received,
            (ending + outlet + allocations + adjustments)::DOUBLE AS total, outlet::DOUBLE AS outlet, allocations::DOUBLE AS allocations,
            adjustments::DOUBLE AS adjustments, ending::DOUBLE AS ending FROM ended"""),
    ),
    "ledger_allocations": (
        lambda s: op.allocations(_sales(s), START, END),
        sql(f", {SALES} SELECT product_id, buyer, {money('sum(quantity)')} AS quantity FROM gone WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2"),
    ),
    "ledger_columns": (
        lambda s: op.ledger_columns(_sales(s), s.receipts, START, END),
        sql(f""", {SALES}, named AS (SELECT {BUYER} AS buyer, min(coalesce(customer_name, label)) AS name FROM receipt GROUP BY 1)
            SELECT DISTINCT buyer, name, lower(name) AS sort_name FROM gone JOIN named USING (buyer) WHERE buyer <> 'outlet' AND day BETWEEN DATE '{START}' AND DATE '{END}'"""),
    ),
    "ledger_remarks": (
        lambda s: op.remarks(s.adjustments, s.returns, s.batches, "1998-01-01", "1998-06-30").withColumn("mode", F.lit("range")).union(op.remarks(s.adjustments, s.returns, s.batches, "1997-06-30", "1997-06-30", True).withColumn("mode", F.lit("day"))),
        sql(rf""", spans AS (SELECT * FROM (VALUES ('range', DATE '1998-01-01', DATE '1998-06-30'), ('day', DATE '1997-06-30', DATE '1997-06-30')) v(mode, lo, hi)),
            own AS (SELECT mode, lo, hi, b.* FROM batch b JOIN spans ON received <= hi WHERE NOT reference_only),
            texts AS (SELECT o.mode, o.product_id, 1 AS k, a.day, regexp_replace(a.quantity::DECIMAL(20,2)::VARCHAR, '\.?0+$', '') || ' ' || a.kind AS r FROM adjustment a JOIN own o ON o.batch_id = a.batch_id AND a.day BETWEEN lo AND hi
                UNION ALL SELECT o.mode, o.product_id, 2, a.day, regexp_replace(a.quantity::DECIMAL(20,2)::VARCHAR, '\.?0+$', '') || ' returned from cancelled sale' FROM stock_return a JOIN own o ON o.batch_id = a.batch_id AND a.day BETWEEN lo AND hi WHERE a.quantity > 0
                UNION ALL SELECT mode, product_id, 0, expiry, regexp_replace(remaining::DECIMAL(20,2)::VARCHAR, '\.?0+$', '') || ' ' || CASE WHEN status IN ('expired', 'disposed') THEN status ELSE 'expired' END || ' on hand'
                FROM own WHERE mode = 'day' AND remaining > 0 AND (status IN ('expired', 'disposed') OR expiry < hi))
            SELECT mode, product_id, string_agg(r, '; ' ORDER BY k, day, r) AS remarks FROM texts GROUP BY 1, 2"""),
    ),
    "fefo_allocate": (
        lambda s: op.fefo_shares(_demands(s), s.batches.withColumn("supply", F.col("initial"))),
        sql(""", d AS (SELECT product_id * 100000 + year(shipped) * 12 + month(shipped) AS demand_id, product_id, sum(quantity) AS wanted FROM line GROUP BY 1, 2),
            de AS (SELECT *, sum(wanted) OVER (PARTITION BY product_id ORDER BY demand_id) AS d_end FROM d),
            be AS (SELECT *, sum(initial) OVER (PARTITION BY product_id ORDER BY expiry, batch_id) AS b_end FROM batch)
            SELECT demand_id, product_id, batch_id, (least(d_end, b_end) - greatest(d_end - wanted, b_end - initial))::DOUBLE AS quantity
            FROM de JOIN be USING (product_id) WHERE d_end - wanted < b_end AND b_end - initial < d_end"""),
    ),
    "fefo_refusals": (lambda s: op.fefo_fold(_demands(s), s.batches.withColumn("supply", F.col("remaining"))), REFUSALS),
    "fefo_line_amounts": (
        lambda s: op.line_amounts(_pieces(s), "line", "l_suppkey", "quantity").select("line_id", "line", "amount"),
        sql(""", pieces AS (SELECT receipt_id * 100000 + product_id AS line_id, line, l_suppkey, quantity FROM line),
            upto AS (SELECT *, ((((sum(quantity) OVER (PARTITION BY line_id ORDER BY line, l_suppkey, quantity ROWS UNBOUNDED PRECEDING)
                )::BIGINT * (line_id % 97) * 125 + 5) // 10) / 100)::DECIMAL(20,2) AS u FROM pieces)
            SELECT line_id, line, (u - coalesce(lag(u) OVER (PARTITION BY line_id ORDER BY line, l_suppkey, quantity), 0))::DOUBLE AS amount FROM upto"""),
    ),
    "adjustment_replay": (lambda s: op.adjustment_replay(s.adjustments, s.batches), REPLAY),
    "void_returns": (
        lambda s: op.void_returns(_cancelled(s), s.batches.withColumn("initial", F.col("remaining") + 30), VOIDED_ON),
        sql(f""", c AS (SELECT receipt_id * 10 + line AS line_id, batch_id, sum(quantity) AS quantity FROM line WHERE receipt_id IN (SELECT id FROM receipt WHERE voided) GROUP BY 1, 2),
            u AS (SELECT c.*, CASE WHEN status IN ('expired', 'disposed') OR expiry < DATE '{VOIDED_ON}' THEN 0 ELSE 30 END AS room,
                sum(c.quantity) OVER (PARTITION BY c.batch_id ORDER BY line_id) AS upto FROM c JOIN batch USING (batch_id))
            SELECT line_id, batch_id, (least(room, upto) - least(room, upto - quantity))::DOUBLE AS returned FROM u"""),
    ),
    "live_alerts": (
        lambda s: op.alerts(s.receipts, s.products, s.batches, AS_OF),
        sql(f""", {AVAILABLE}, low AS (SELECT count(*) AS n, sum(('0x' || substr(md5(product_id || '|' || stock::DECIMAL(20,2)), 1, 15))::BIGINT) AS s FROM stocked WHERE active AND stock <= 20)
            SELECT 'low-stock-products' AS key, 'warning' AS kind, n || ' products below minimum stock' AS title, sha256(n || '|' || s || '|20') AS revision FROM low WHERE n > 0
            UNION ALL SELECT 'expiry-product-' || batch_id, 'danger', 'expired', sha256(batch_id || '|' || expiry || '|expired') FROM batch WHERE {EXPIRED}
            UNION ALL SELECT 'expiry-product-' || batch_id, 'danger', 'expiring', sha256(batch_id || '|' || expiry || '|' || CASE WHEN expiry <= {DATE} + 3 THEN 'critical' ELSE 'near_expiry' END) FROM batch WHERE {EXPIRING}
            UNION ALL (SELECT 'fulfilled-' || id, 'success', 'order ' || id, sha256(id || '|' || status || '|' || amount || '|' || day) FROM receipt WHERE NOT voided ORDER BY created_at DESC, id DESC LIMIT 2)"""),
    ),
    "alert_ack": (
        lambda s: op.acknowledged(
            op.expiring(s.batches, AS_OF).select(F.col("batch_id").cast("string").alias("key"), F.col("label").alias("revision")),
            s.batches.filter("batch_id % 3 = 0").select(F.lit(1).alias("user_id"), F.col("batch_id").cast("string").alias("key"), F.lit("critical").alias("revision"), F.lit(True).alias("dismissed")),
        ).select("key", "revision", "unread", F.coalesce("dismissed", F.lit(False)).alias("dismissed")),
        sql(f""", live AS (SELECT batch_id, CASE WHEN expiry <= {DATE} + 3 THEN 'critical' ELSE 'near_expiry' END AS revision FROM batch WHERE {EXPIRING})
            SELECT batch_id::VARCHAR AS key, revision, NOT (batch_id % 3 = 0 AND revision = 'critical') AS unread, batch_id % 3 = 0 AND revision = 'critical' AS dismissed FROM live"""),
    ),
    "batch_numbers": (
        lambda s: op.batch_numbers(s.batches.join(s.products.select("product_id", "category"), "product_id").withColumn("prefix", F.upper(F.substring("category", 1, 3))), "received", "batch_id").select("batch_id", "number"),
        sql(""", n AS (SELECT batch_id, upper(substr(category, 1, 3)) AS prefix, strftime(received, '%y%m') AS ym,
                row_number() OVER (PARTITION BY upper(substr(category, 1, 3)), strftime(received, '%y%m') ORDER BY received, batch_id) AS k FROM batch JOIN product USING (product_id))
            SELECT batch_id, prefix || '-' || ym || '-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS number FROM n"""),
    ),
}
