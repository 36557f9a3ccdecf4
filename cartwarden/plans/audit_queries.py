"""Read models, outbox views and audits: each a Spark SQL query over adapter frames, beside its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters as A

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def _tables(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    made = {"ev": A.events, "payments": A.payments, "deliveries": A.deliveries, "refunds": A.refunds}
    return {n: made[n](spark, sf_dir) if n in made else A.table(spark, sf_dir, n) for n in names.split()}


def _register(name: str, tables: str, spark_sql: str, duck_sql: str, doc: str) -> None:
    """A query that Spark runs as SQL over the named frames."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **_tables(spark, sf_dir, tables))

    query.__name__, query.__doc__ = name, doc
    QUERIES[name] = query
    ORACLE_SQL[name] = duck_sql if duck_sql.lstrip().upper().startswith("SELECT") and not any(t in duck_sql for t in (" ev", "payments", "deliveries", " refunds ")) else f"WITH {A.ORACLE}{duck_sql}"


def _same(name: str, tables: str, sql: str, doc: str) -> None:
    """A query whose text both engines read; frames are written as {name}."""
    duck = sql
    for t in tables.split():
        duck = duck.replace("{" + t + "}", t)
    _register(name, tables, sql, " " + duck if any(t in ("ev", "payments", "deliveries", "refunds") for t in tables.split()) else duck, doc)


_same("run_rollup", "ev", """
SELECT event_type AS run_id, count(*) AS processed, sum(CASE WHEN value < 250 THEN 1 ELSE 0 END) AS approved, sum(CASE WHEN value >= 250 AND value < 400 THEN 1 ELSE 0 END) AS review,
  sum(CASE WHEN value >= 400 THEN 1 ELSE 0 END) AS blocked, count(DISTINCT user_id) AS customers FROM {ev} GROUP BY event_type""", "Per run (event type): processed rows and decisions by value.")

_same("run_summary", "ev", """
SELECT event_type AS run_id, min(at_us) AS started_at, max(at_us) AS ended_at, count(*) AS generated, round(count(*) / (nullif(max(at_us) - min(at_us), 0) / 1000000.0), 6) AS effective_rate
FROM {ev} GROUP BY event_type""", "Per run: span and effective rate; null rate for a run of one instant.")

_same("run_page", "orders", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""", "The third page of 50 orders, newest first.")

_same("overview_run", "orders", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'active' ELSE 'completed' END AS scope FROM {orders}
ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey LIMIT 1""", "The newest active order, else the newest other one.")

_same("alert_list", "payments", """
SELECT payment_id, customer_id, amount FROM {payments} WHERE amount >= 400 ORDER BY at_us DESC, payment_id LIMIT 25""", "The 25 newest large payments.")

_same("journey_summary", "ev", """
SELECT count(DISTINCT user_id) AS customers, count(*) AS events, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS paid, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS commerce_value, round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE), 3) AS mean_events
FROM {ev}""", "Journeys in one row: customers, events, payments, value.")

_same("row_counts", "region nation customer supplier part orders lineitem events", """
SELECT 'region' AS name, count(*) AS n FROM {region} UNION ALL SELECT 'nation', count(*) FROM {nation} UNION ALL SELECT 'customer', count(*) FROM {customer} UNION ALL SELECT 'supplier', count(*) FROM {supplier}
UNION ALL SELECT 'part', count(*) FROM {part} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'events', count(*) FROM {events}""", "Rows of each table.")

_same("orphan_audit", "orders customer lineitem part supplier nation region", """
SELECT 'orders.customer' AS edge, count(*) AS orphans FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL
UNION ALL SELECT 'lineitem.orders', count(*) FROM {lineitem} l LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL
UNION ALL SELECT 'lineitem.part', count(*) FROM {lineitem} l LEFT JOIN {part} p ON p.p_partkey = l.l_partkey WHERE p.p_partkey IS NULL
UNION ALL SELECT 'lineitem.supplier', count(*) FROM {lineitem} l LEFT JOIN {supplier} s ON s.s_suppkey = l.l_suppkey WHERE s.s_suppkey IS NULL
UNION ALL SELECT 'orders.lines', count(*) FROM {orders} o LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL
UNION ALL SELECT 'nation.region', count(*) FROM {nation} n LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey IS NULL""", "Orphans of each foreign key.")

_same("constraint_audit", "orders lineitem customer", """
SELECT 'order total is positive' AS rule, count(*) AS broken FROM {orders} WHERE NOT coalesce(o_totalprice > 0, FALSE)
UNION ALL SELECT 'order status is known', count(*) FROM {orders} WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('P', 'O', 'F')
UNION ALL SELECT 'line discount is a share', count(*) FROM {lineitem} WHERE NOT coalesce(l_discount BETWEEN 0 AND 1, FALSE)
UNION ALL SELECT 'line quantity is positive', count(*) FROM {lineitem} WHERE NOT coalesce(l_quantity > 0, FALSE)
UNION ALL SELECT 'line key is unique', count(*) FROM (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x
UNION ALL SELECT 'balance is set', count(*) FROM {customer} WHERE c_acctbal IS NULL""", "Rows that break each check constraint.")

_same("order_line_reconciliation", "orders lineitem", """
SELECT o_orderstatus, count(*) AS orders, sum(CASE WHEN lines IS NULL THEN 1 ELSE 0 END) AS without_lines, sum(CASE WHEN lines = total THEN 1 ELSE 0 END) AS equal,
  CAST(sum(coalesce(lines, 0)) AS DECIMAL(28,2)) AS line_total, CAST(sum(total) AS DECIMAL(28,2)) AS order_total
FROM (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM {orders}) o
LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS lines FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
GROUP BY o_orderstatus""", "Order totals against the sums of their lines.")

_same("customer_payment_lookup", "customer orders", """
SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DECIMAL(28,2)) AS spent, max(o_orderdate) AS last_order
FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""", "Customers with their orders, if any.")

_same("refund_balance", "orders refunds", """
SELECT o_orderkey AS order_id, coalesce(n, 0) AS refunds, CAST(CAST(o_totalprice AS DECIMAL(18,2)) - coalesce(total, 0) AS DECIMAL(28,2)) AS balance FROM {orders}
LEFT JOIN (SELECT order_id, count(*) AS n, sum(amount) AS total FROM {refunds} GROUP BY order_id) r ON order_id = o_orderkey""", "What each order has left after its refunds, summed up before the join.")

_same("outbox_status", "ev", """
SELECT CASE WHEN k < 60 THEN 'PUBLISHED' WHEN k < 90 THEN 'PENDING' WHEN k < 95 THEN 'PUBLISHING' ELSE 'FAILED' END AS status, count(*) AS n, max(at_us) - min(at_us) AS span FROM {ev} GROUP BY 1""", "Outbox rows by status.")

_same("outbox_claims", "ev", """
SELECT event_id, k + 1 AS attempts, 'PUBLISHING' AS status FROM {ev} WHERE k >= 60 AND k < 90 ORDER BY at_us, event_id LIMIT 20""", "The 20 oldest pending rows, claimed.")

_same("outbox_failures", "ev", """
SELECT event_id, k % 12 AS attempts, CASE WHEN k % 12 >= 10 THEN 'FAILED' ELSE 'PENDING' END AS status,
  CASE WHEN k % 12 >= 10 THEN NULL ELSE least(CAST(30 AS DOUBLE), CAST(0.5 AS DOUBLE) * power(CAST(2 AS DOUBLE), greatest(k % 12, 1) - 1)) END AS delay_seconds FROM {ev} WHERE event_type = 'error'""", "Publication failures: given up after ten attempts, else delayed by capped doubling.")

_register("status_transitions", "orders", """
WITH s AS (SELECT o_custkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM {orders})
SELECT s.before, s.o_orderstatus AS after, count(*) AS n FROM s LEFT ANTI JOIN (SELECT * FROM VALUES ('P', 'O'), ('O', 'F'), ('P', 'F') AS t(a, b)) ok ON ok.a = s.before AND ok.b = s.o_orderstatus
WHERE s.before IS NOT NULL AND s.before <> s.o_orderstatus GROUP BY 1, 2""", """
SELECT before, after, count(*) AS n FROM (SELECT o_orderstatus AS after, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) s
WHERE before IS NOT NULL AND before <> after AND (before || after) NOT IN ('PO', 'OF', 'PF') GROUP BY 1, 2""", "Status changes along a customer's orders that the allowed edges don't have.")

_register("customer_state", "ev", """
SELECT user_id, count_if(event_type = 'view') AS views, count_if(event_type = 'click') AS adds, count_if(event_type = 'purchase') AS paid, count_if(event_type = 'error') AS failed,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS spend, max(at_us) AS last_at,
  concat_ws(',', transform(slice(reverse(array_sort(collect_list(CASE WHEN event_type = 'view' THEN struct(at_us, event_id, k) END))), 1, 10), x -> cast(x.k AS STRING))) AS last_views
FROM {ev} GROUP BY user_id""", """
SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS adds, count(*) FILTER (event_type = 'purchase') AS paid, count(*) FILTER (event_type = 'error') AS failed,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS DECIMAL(28,2)) AS spend, max(at_us) AS last_at,
  coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY at_us DESC, event_id DESC) FILTER (event_type = 'view' AND n <= 10), '') AS last_views
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY at_us DESC, event_id DESC) AS n FROM ev) e GROUP BY user_id""", "Per customer: activity counts, spend and the ten products viewed last.")


def abandoned_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose last cart add (click) has no later purchase."""
    e = A.events(spark, sf_dir)
    adds = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("at_us").alias("added_at"))
    paid = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("at_us").alias("paid_at"))
    return adds.join(paid, (F.col("u") == F.col("user_id")) & (F.col("paid_at") > F.col("added_at")), "left_anti")


QUERIES["abandoned_carts"] = abandoned_carts
ORACLE_SQL["abandoned_carts"] = f"WITH {A.ORACLE}, a AS (SELECT user_id, max(at_us) AS added_at FROM ev WHERE event_type = 'click' GROUP BY 1) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.user_id = a.user_id AND p.event_type = 'purchase' AND p.at_us > a.added_at)"
