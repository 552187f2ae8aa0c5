"""The shop's tables of sources/shop.py as DuckDB SQL, put before each query of the oracle."""

from __future__ import annotations

TABLES = {
    "receipt": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer_id,
        o_orderdate AS created_at, o_orderdate::DATE AS day,
        (CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 3 DAY ELSE o_orderdate END)::DATE AS moved_day,
        o_orderkey % 4 = 1 AS encoded_later,
        (round(o_totalprice * 100)::BIGINT::DECIMAL(20,0) / 100)::DECIMAL(20,2) AS amount, o_orderkey % 20 = 3 AS voided,
        CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS status,
        CASE o_custkey % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'online' ELSE 'unknown' END AS method, o_orderkey % 7 AS handled_by,
        CASE WHEN o_orderkey % 50 = 7 THEN '2026:' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') ELSE 'S:' || o_orderkey END AS reference,
        CASE WHEN o_orderkey % 13 = 0 THEN ' si' ELSE 'SI' END || lpad(((o_orderkey * 7) % 5000)::VARCHAR, 4, '0') AS invoice,
        CASE WHEN o_orderkey % 4 = 0 THEN 'automatic' ELSE 'paper' END AS invoice_source,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE c_name END AS customer_name,
        CASE WHEN o_orderkey % 97 = 0 THEN 'unclassified' WHEN o_orderkey % 10 = 0 THEN 'regular'
            WHEN c_mktsegment = 'MACHINERY' THEN 'feeding' ELSE 'regular' END AS segment,
        CASE WHEN o_orderkey % 10 = 0 THEN 'outlet sales' WHEN c_mktsegment <> 'MACHINERY' THEN c_name
            ELSE ['feeding deped - second batch', 'Rizal  feeding (north)', 'depedx milk', 'Féeding DSWD'][o_custkey % 4 + 1] END AS label,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE segment END AS explicit_segment,
        CASE WHEN o_orderkey % 8 = 4 THEN ' ' || label || ' ' WHEN o_orderkey % 10 = 0 AND o_orderkey % 3 = 0 THEN 'Stall  ' || (o_orderkey % 7) ELSE '' END AS source_label
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "line": """SELECT l_orderkey AS receipt_id, l_linenumber AS line, l_partkey AS product_id, l_suppkey,
        l_partkey * 1000 + l_suppkey % 1000 AS batch_id, l_quantity::DECIMAL(10,2) AS quantity,
        (floor((2 * round(l_extendedprice * 100) + l_quantity) / (2 * l_quantity))::BIGINT::DECIMAL(20,0) / 100)::DECIMAL(10,2) AS price,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE (round(l_extendedprice * 100)::BIGINT::DECIMAL(20,0) / 100)::DECIMAL(20,2) END AS subtotal,
        CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'part ' || (l_partkey % 50) END AS snap_name, l_shipdate::DATE AS shipped, l_extendedprice,
        coalesce(subtotal, (l_quantity::DECIMAL(10,0) * price)::DECIMAL(20,2))::DECIMAL(20,2) AS amount,
        CASE WHEN l_linenumber <> 1 THEN amount WHEN l_orderkey % 45 = 9 THEN NULL WHEN l_orderkey % 45 = 18 THEN -amount ELSE amount END AS entered_amount,
        CASE WHEN l_linenumber = 1 AND l_orderkey % 45 = 27 THEN 0::DECIMAL(10,2) ELSE l_quantity::DECIMAL(10,2) END AS entered_quantity FROM lineitem""",
    "product": """SELECT p_partkey AS product_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS variant, p_type AS category,
        CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'unit' END AS unit, p_partkey % 25 <> 0 AS active, p_size AS size,
        CASE p_partkey % 10 WHEN 1 THEN 'non_dairy' WHEN 2 THEN NULL ELSE 'dairy' END AS decision FROM part""",
    "batch": """SELECT l_partkey * 1000 + l_suppkey % 1000 AS batch_id, l_partkey AS product_id, min(l_shipdate)::DATE - 30 AS received,
        min(l_shipdate)::DATE - 30 + (10 + any_value(p_size) * 60) AS expiry, (sum(l_quantity) + 50)::DECIMAL(12,2) AS initial,
        (CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 0 ELSE 50 END)::DECIMAL(12,2) AS remaining,
        CASE (l_partkey + l_suppkey) % 17 WHEN 0 THEN 'expired' WHEN 1 THEN 'disposed' ELSE 'available' END AS status, l_suppkey % 31 = 0 AS reference_only
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, l_suppkey""",
    "adjustment": """SELECT l_partkey * 1000 + l_suppkey % 1000 AS batch_id,
        ['correction', 'damage', 'spoilage', 'free_taste', 'expired', 'theft', 'sample', 'other'][l_linenumber % 8 + 1] AS kind,
        (CASE WHEN l_linenumber % 3 = 0 THEN -l_quantity ELSE l_quantity END)::DECIMAL(12,2) AS quantity, l_shipdate::DATE + 5 AS day, l_orderkey AS id
        FROM lineitem WHERE l_orderkey % 11 = 0""",
    "stock_return": """SELECT receipt_id, batch_id, product_id, floor(quantity / 2)::DECIMAL(12,2) AS quantity, day + 10 AS day
        FROM line JOIN receipt ON id = receipt_id WHERE voided AND receipt_id % 40 = 3""",
    "client": "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation, c_mktsegment AS market, c_acctbal AS balance FROM customer",
    "submission": """SELECT event_id, user_id, event_id % 700 AS request_id, event_type AS endpoint, floor(value / 100)::BIGINT AS payload, ts, value FROM events""",
}


def sql(query: str) -> str:
    """query after the tables; it may begin with further CTEs as `name AS (...), ... SELECT`, marked by a leading comma."""
    ctes = ", ".join(f"{name} AS ({body})" for name, body in TABLES.items())
    query = query.strip()
    return f"WITH {ctes}{query}" if query.startswith(",") else f"WITH {ctes} {query}"
