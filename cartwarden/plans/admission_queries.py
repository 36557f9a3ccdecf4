"""Sessions, views, carts, orders and payments in order of arrival, judged by what came before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import admission
from ..sources import adapters as A


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup events register their customer."""
    return A.table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("customer_id"), F.col("event_id").alias("seq"))


def _in_session(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a type with their session: eight a customer, by k."""
    e = A.events(spark, sf_dir).where(F.col("event_type") == kind)
    return e.select((F.col("user_id") * 8 + F.col("k") % 8).alias("session_id"), F.col("user_id").alias("customer_id"), F.col("event_id").alias("seq"), (F.col("k") % 16).alias("device"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admit_sessions(_in_session(spark, sf_dir, "click"), _customers(spark, sf_dir), ["device"])


def session_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """click events open sessions; of a session's first and later ones, and those before their customer's signup, the outcome."""
    return _sessions(spark, sf_dir).select("seq", "session_id", "customer_id", "outcome")


def view_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view events need their customer and a registered session before them."""
    opened = _sessions(spark, sf_dir).where("outcome = 'registered'").select("session_id", "seq")
    return admission.admit_views(_in_session(spark, sf_dir, "view"), _customers(spark, sf_dir), opened).select("seq", "session_id", "outcome")


#: Lines that a partition of carts holds, about.
LINES = 200_000


def _by_cart(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by cart to as many partitions as its lines need: all sides alike, so that they meet without another
    shuffle, and a task's memory doesn't grow with the input."""
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), A.table(spark, sf_dir, "lineitem").count() // LINES + 1)
    return A.table(spark, sf_dir, name).repartition(spread, key)


def _adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as adds to their order's cart; every tenth place, so that checkouts and orders fit between."""
    place = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return _by_cart(spark, sf_dir, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("product_id"), (10 * F.row_number().over(place)).alias("seq"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast(A.MONEY).alias("unit_price"),
    )


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkout of each order after one to three adds; orders that aren't in status P close the cart two places later."""
    o = _by_cart(spark, sf_dir, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("cart_id"), "o_orderstatus", (10 * (1 + F.col("o_orderkey") % 3) + 5).cast("int").alias("seq"), (F.col("o_orderkey") % 5 * 10).cast(admission.MONEY).alias("discount")
    )
    checkout = o.select("cart_id", "seq", F.lit("checkout").alias("kind"), "discount")
    return checkout.unionByName(o.where("o_orderstatus <> 'P'").select("cart_id", (F.col("seq") + 2).alias("seq"), F.lit("order").alias("kind"), "discount"))


def cart_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and status of every cart as of each of its adds, its checkout and its order."""
    return admission.cart_states(_adds(spark, sf_dir), _marks(spark, sf_dir))


def order_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders claim the plain sum of the lines before the checkout: wrong where a product was replaced, and a cent off for every seventh; every eleventh comes twice."""
    adds, checkouts = _adds(spark, sf_dir), _marks(spark, sf_dir).where("kind = 'checkout'")
    o = _by_cart(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("cart_id"), F.col("o_custkey").alias("customer_id"), F.lit("EUR").alias("currency"))
    places = checkouts.select("cart_id", F.col("seq").alias("checkout_seq"), "discount")
    sums = adds.join(places, "cart_id").where("seq < checkout_seq").groupBy("cart_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("sum"), F.sum("quantity").alias("item_count"))
    claimed = o.join(places, "cart_id").join(sums, "cart_id", "left").select(
        F.col("cart_id").alias("order_id"), "cart_id", F.explode(F.when(F.col("cart_id") % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"), "checkout_seq",
        "customer_id", "currency", (F.coalesce("sum", F.lit(0)) + F.when(F.col("cart_id") % 7 == 0, 0.01).otherwise(0).cast(A.MONEY)).cast(admission.MONEY).alias("subtotal"),
        "discount", F.coalesce("item_count", F.lit(0)).alias("item_count"),
    )
    orders = claimed.withColumn("seq", F.col("checkout_seq") + F.col("copy")).withColumn("total", (F.col("subtotal") - F.col("discount")).cast(admission.MONEY)).drop("copy", "checkout_seq")
    return admission.admit_orders(orders, adds, checkouts, o).select("order_id", "seq", "subtotal", "total", "item_count", "outcome")


def _order_payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a payment of each: every 19th before its order, every 13th customer's of another amount, every eleventh twice."""
    o = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") * 10).alias("seq"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast(A.MONEY).alias("total"), F.lit("EUR").alias("currency"), "o_orderstatus"
    )
    late = F.when(F.col("order_id") % 19 == 0, F.col("seq") - 3).otherwise(F.col("seq") + 3)
    paid = o.select(
        F.col("order_id").alias("payment_id"), "order_id", late.alias("seq"), "customer_id", (F.col("total") + F.when(F.col("customer_id") % 13 == 0, 1).otherwise(0)).cast(A.MONEY).alias("amount"), "currency",
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
    )
    again = paid.where("payment_id % 11 = 0").withColumn("seq", F.col("seq") + 1)
    return o.drop("o_orderstatus"), paid.unionByName(again)


def payment_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments against the order that they name."""
    orders, payments = _order_payments(spark, sf_dir)
    return admission.admit_payments(payments, orders).select("payment_id", "seq", "amount", "status", "outcome")


def paid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an admitted completed payment has made the order a paid one."""
    orders, payments = _order_payments(spark, sf_dir)
    return admission.paid_orders(orders, admission.admit_payments(payments, orders))


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the customer's orders of the last 30 days, itself included, 500 at most."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return admission.recent_count(o, "o_custkey", "o_orderdate", 30, 500, "recent_orders").select("o_orderkey", "recent_orders")


QUERIES = {f.__name__: f for f in (session_admission, view_admission, cart_states, order_admission, payment_admission, paid_orders, recent_orders)}

_SESSIONS = f"""{A.ORACLE},
born AS (SELECT user_id, min(event_id) AS born FROM events WHERE event_type = 'signup' GROUP BY 1),
clicks AS (SELECT e.event_id AS seq, e.user_id * 8 + k % 8 AS session_id, e.user_id AS customer_id, k % 16 AS device, coalesce(born < event_id, FALSE) AS known FROM ev e LEFT JOIN born USING (user_id) WHERE event_type = 'click'),
sessions AS (
  SELECT c.*, CASE WHEN NOT known THEN 'missing_customer' WHEN row_number() OVER w = 1 THEN 'registered' WHEN device = first_value(device) OVER w THEN 'repeated' ELSE 'conflict' END AS outcome
  FROM clicks c WINDOW w AS (PARTITION BY session_id, known ORDER BY seq)
)"""
_ADDS = """
l AS (
  SELECT l_orderkey AS cart_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) * CAST(l_extendedprice AS DECIMAL(18,2)) AS t,
    10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM lineitem
),
c AS (SELECT o_orderkey AS cart_id, o_custkey, o_orderstatus, 10 * (1 + o_orderkey % 3) + 5 AS place, o_orderkey % 5 * 10 AS discount FROM orders)"""
_PAID = """
p AS (
  SELECT o_orderkey AS payment_id, o_orderkey * 10 + CASE WHEN o_orderkey % 19 = 0 THEN -3 ELSE 3 END + n AS seq, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 19 = 0 THEN 'missing_order' WHEN o_custkey % 13 = 0 THEN 'contradicted' WHEN n = 1 THEN 'conflict' ELSE 'admitted' END AS outcome
  FROM orders, (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR o_orderkey % 11 = 0
)"""

ORACLE_SQL = {
    "session_admission": f"WITH {_SESSIONS} SELECT seq, session_id, customer_id, outcome FROM sessions",
    "view_admission": f"""WITH {_SESSIONS}, opened AS (SELECT session_id, seq AS opened FROM sessions WHERE outcome = 'registered')
 SELECT e.event_id AS seq, e.user_id * 8 + k % 8 AS session_id, CASE WHEN born IS NULL OR born >= event_id THEN 'missing_customer' WHEN opened IS NULL OR opened >= event_id THEN 'missing_session' ELSE 'recorded' END AS outcome
 FROM ev e LEFT JOIN born USING (user_id) LEFT JOIN opened o ON o.session_id = e.user_id * 8 + k % 8 WHERE event_type = 'view'""",
    "cart_states": f"""WITH {_ADDS},
 e AS (SELECT cart_id, seq, 'add' AS kind FROM l UNION ALL SELECT cart_id, place, 'checkout' FROM c UNION ALL SELECT cart_id, place + 2, 'order' FROM c WHERE o_orderstatus <> 'P'),
 v AS (SELECT e.cart_id, e.seq, e.kind, l.product_id, arg_max(l.t, l.seq) AS t, arg_max(l.q, l.seq) AS q FROM e LEFT JOIN l ON l.cart_id = e.cart_id AND l.seq <= e.seq GROUP BY ALL),
 s AS (SELECT cart_id, seq, kind, count(product_id) AS lines, coalesce(sum(t), 0) AS subtotal, coalesce(sum(q), 0) AS items FROM v GROUP BY ALL)
 SELECT s.cart_id, CAST(s.seq AS INT) AS seq, kind, lines, CAST(subtotal AS DECIMAL(28,2)) AS subtotal, CAST(items AS BIGINT) AS item_count, CAST(CASE WHEN s.seq >= c.place THEN discount ELSE 0 END AS DECIMAL(28,2)) AS discount,
  CAST(subtotal - CASE WHEN s.seq >= c.place THEN discount ELSE 0 END AS DECIMAL(28,2)) AS total,
  CASE WHEN s.seq >= c.place + 2 AND o_orderstatus <> 'P' THEN 'ordered' WHEN s.seq >= c.place THEN 'checkout_started' ELSE 'active' END AS status FROM s LEFT JOIN c USING (cart_id)""",
    "order_admission": f"""WITH {_ADDS},
 b AS (SELECT c.cart_id, sum(t) AS plain, sum(q) AS items FROM c JOIN l ON l.cart_id = c.cart_id AND l.seq < c.place GROUP BY 1),
 v AS (SELECT cart_id, sum(t) AS subtotal, sum(q) AS items FROM (SELECT c.cart_id, product_id, arg_max(t, seq) AS t, arg_max(q, seq) AS q FROM c JOIN l ON l.cart_id = c.cart_id AND l.seq < c.place GROUP BY 1, 2) x GROUP BY 1),
 d AS (SELECT c.*, coalesce(plain, 0) + CASE WHEN c.cart_id % 7 = 0 THEN CAST(0.01 AS DECIMAL(18,2)) ELSE 0 END AS claim, coalesce(b.items, 0) AS items, v.subtotal, v.items AS true_items, n FROM c LEFT JOIN b USING (cart_id) LEFT JOIN v USING (cart_id), (SELECT unnest([1, 2]) AS n) WHERE n = 1 OR c.cart_id % 11 = 0)
 SELECT cart_id AS order_id, CAST(place + n AS INT) AS seq, CAST(claim AS DECIMAL(28,2)) AS subtotal, CAST(claim - discount AS DECIMAL(28,2)) AS total, CAST(items AS BIGINT) AS item_count,
  CASE WHEN subtotal IS NULL THEN 'missing_cart' WHEN claim <> subtotal OR items <> true_items THEN 'contradicted' WHEN n = 2 THEN 'conflict' ELSE 'admitted' END AS outcome FROM d""",
    "payment_admission": f"WITH {_PAID} SELECT payment_id, seq, amount, status, outcome FROM p",
    "paid_orders": f"WITH {_PAID} SELECT o_orderkey AS order_id, CASE WHEN EXISTS (SELECT 1 FROM p WHERE payment_id = o_orderkey AND outcome = 'admitted' AND status = 'completed') THEN 'paid' ELSE 'pending' END AS status FROM orders",
    "recent_orders": "SELECT o.o_orderkey, least((SELECT count(*) FROM orders h WHERE h.o_custkey = o.o_custkey AND h.o_orderdate <= o.o_orderdate AND h.o_orderdate >= o.o_orderdate - INTERVAL 30 DAY), 500) AS recent_orders FROM orders o",
}
