"""Payments judged by what had arrived before them: newest rows of two orders, waiting children, the ledger's accesses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrivals as R
from ..operators import fraud, parking
from ..sources import adapters as A
from . import fraud_queries

CFG = fraud.EVENTS_CONFIG
#: The same with so small a bound that the given customers exceed it.
FEW = replace(CFG, newest=3, history_days=60)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments, views and signups (sessions) in order of event_id as they arrived; every twentieth tells of a day earlier.

    Payments of k below 90 are in USD, others in EUR.
    """
    paid = A.payments(spark, sf_dir).select(
        "customer_id", F.col("payment_id").alias("id"), F.lit("payment").alias("kind"), "at_us", "status", (F.col("amount") * 100).cast("long").alias("cents"), "device", "country", "home", F.col("failure_reason").alias("reason"),
    )
    currency = A.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("k") < 90, "USD").otherwise("EUR").alias("currency"))
    other = A.events(spark, sf_dir).where(F.col("event_type").isin("signup", "view")).select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "session").otherwise("view").alias("kind"), "at_us"
    )
    rows = paid.join(currency, "id").unionByName(other, allowMissingColumns=True)
    text = {c: F.col(c).cast("string") for c in ("device", "country", "home")}
    at = F.when(F.col("id") % 20 == 0, F.col("at_us") - 86_400_000_000).otherwise(F.col("at_us"))
    return rows.withColumns(text).withColumn("at_us", at).withColumn("seq", F.col("id")).select(*R.COLUMNS)


def _shown(features: DataFrame) -> DataFrame:
    listed = {c: F.concat_ws(",", c) for c in ("known_devices", "known_countries")}
    return features.withColumns(listed).drop("seq", "device", "country", "home")


def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature row of each payment: newest 500 of its history by arrival and by time, currency's average, known sets."""
    return _shown(R.arrival_features(arrivals(spark, sf_dir), CFG))


def history_features_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the newest 3 and blocks of 4 rows, so that most customers exceed both."""
    return _shown(R.arrival_features(arrivals(spark, sf_dir), FEW, block_rows=4))


def arrival_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments scored by the ten rules' payment part on what had arrived."""
    scored = fraud.evaluate(R.arrival_features(arrivals(spark, sf_dir), CFG), fraud.payment_rules(CFG), CFG)
    return scored.select("payment_id", "customer_id", "score", "decision", "severity", "matched_rules", "reason_codes")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, their orders and these orders' lines, arriving in an order of their own within five seconds."""
    customers, orders, lines = (A.table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    part = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"))
    own = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").distinct()
    row = lambda kind, journey, id_, at, *parents: [F.col(journey).cast("string").alias("journey"), F.lit(kind).alias("kind"), id_.alias("id"), at.cast("long").alias("arrived_ms"), F.array(*parents).cast("array<struct<kind:string,id:string>>").alias("parents")]
    return (
        customers.select(*row("customer", "c_custkey", F.col("c_custkey").cast("string"), F.col("c_custkey") * 7919 % 5000))
        .unionByName(orders.select(*row("order", "o_custkey", F.col("o_orderkey").cast("string"), F.col("o_orderkey") * 104_729 % 5000, part("customer", "o_custkey"))))
        .unionByName(lines.join(own, "l_orderkey").select(*row("line", "o_custkey", F.concat_ws("-", "l_orderkey", "l_linenumber"), (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7919) % 5000, part("order", "l_orderkey"), part("customer", "o_custkey"))))
    )


def dependency_parking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, order and line with its attempt and outcome when children may come before their parents."""
    return parking.park(entities(spark, sf_dir), ["customer", "order", "line"]).drop("journey")


QUERIES = {f.__name__: f for f in (history_features, history_features_bounded, arrival_decisions, dependency_parking)}


def _features_sql(newest: int, days: int) -> str:
    """Correlated by join and rank: every pair of rows that may count, then the newest of each payment."""
    day = 86_400_000_000
    ranked = "row_number() OVER (PARTITION BY p.payment_id ORDER BY h.t DESC, h.payment_id)"
    return f"""
{A.ORACLE},
p AS (
  SELECT y.payment_id, y.customer_id, y.status, y.amount, CAST(y.device AS VARCHAR) AS device, CAST(y.country AS VARCHAR) AS country, CAST(y.home AS VARCHAR) AS home, y.failure_reason,
    CASE WHEN y.payment_id % 20 = 0 THEN y.at_us - {day} ELSE y.at_us END AS t, CASE WHEN e.k < 90 THEN 'USD' ELSE 'EUR' END AS currency
  FROM payments y JOIN ev e ON e.event_id = y.payment_id WHERE y.customer_id IS NOT NULL
),
others AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 20 = 0 THEN at_us - {day} ELSE at_us END AS t FROM ev WHERE event_type IN ('signup', 'view')),
recent AS (
  SELECT p.payment_id, p.t AS mine, h.t, h.status, h.device, h.country, h.failure_reason, {ranked} AS n
  FROM p JOIN p h ON h.customer_id = p.customer_id AND h.payment_id <= p.payment_id AND h.t BETWEEN p.t - {days * day} AND p.t
),
prior AS (
  SELECT p.payment_id, p.currency AS mine, h.status, h.device, h.country, h.amount, h.currency, {ranked} AS n
  FROM p JOIN p h ON h.customer_id = p.customer_id AND h.payment_id <= p.payment_id AND h.t < p.t
),
lately AS (
  SELECT payment_id, count(*) FILTER (t >= mine - {day}) AS attempts, count(*) FILTER (status = 'failed' AND t >= mine - {day}) AS failures,
    count(DISTINCT failure_reason) FILTER (status = 'failed' AND t >= mine - {day}) AS failure_reasons, count(DISTINCT device) FILTER (t >= mine - {day}) AS devices, count(DISTINCT country) FILTER (t >= mine - {2 * day}) AS countries
  FROM recent WHERE n <= {newest} GROUP BY payment_id
),
before AS (
  SELECT payment_id, count(*) FILTER (status = 'completed') AS successes, count(*) FILTER (status = 'failed') AS prior_failures, sum(amount) FILTER (status = 'completed') AS spend,
    count(*) FILTER (status = 'completed' AND currency = mine) AS currency_successes, sum(amount) FILTER (status = 'completed' AND currency = mine) AS currency_spend,
    string_agg(DISTINCT device, ',' ORDER BY device) FILTER (status = 'completed') AS known_devices, string_agg(DISTINCT country, ',' ORDER BY country) FILTER (status = 'completed') AS known_countries
  FROM prior WHERE n <= {newest} GROUP BY payment_id
),
sessioned AS (SELECT p.*, (SELECT max(s.t) FROM others s WHERE s.event_type = 'signup' AND s.user_id = p.customer_id AND s.event_id <= p.payment_id AND s.t <= p.t) AS session_at FROM p),
shaped AS (
  SELECT s.payment_id, s.customer_id, s.t AS at_us, s.status, s.amount, s.country, s.home, l.attempts, l.failures, CAST(l.failure_reasons AS INT) AS failure_reasons, CAST(l.devices AS INT) AS devices, CAST(l.countries AS INT) AS countries,
    coalesce(b.successes, 0) AS successes, coalesce(b.prior_failures, 0) AS prior_failures, CAST(b.spend AS DECIMAL(28,2)) AS spend, coalesce(b.currency_successes, 0) AS currency_successes, CAST(b.currency_spend AS DECIMAL(28,2)) AS currency_spend,
    coalesce(b.known_devices, '') AS known_devices, coalesce(b.known_countries, '') AS known_countries,
    (SELECT least({newest}, count(*)) FROM others v WHERE v.event_type = 'view' AND v.user_id = s.customer_id AND v.event_id <= s.payment_id AND v.t <= s.t AND v.t >= coalesce(s.session_at, s.t - {days * day})) AS views,
    (s.t - s.session_at) // 1000000 AS checkout_seconds, s.currency,
    coalesce(b.known_devices <> '' AND NOT list_contains(string_split(b.known_devices, ','), s.device), FALSE) AS is_new_device, coalesce(s.country <> s.home, FALSE) AS country_mismatch
  FROM sessioned s JOIN lately l USING (payment_id) LEFT JOIN before b USING (payment_id)
)"""


_COLUMNS = "payment_id, customer_id, at_us, status, amount, currency, attempts, failures, failure_reasons, devices, countries, successes, prior_failures, spend, currency_successes, currency_spend, known_devices, known_countries, views, checkout_seconds, is_new_device, country_mismatch"
_RULES = "matched AS" + fraud_queries._FEATURES.partition("matched AS")[2]

_JUDGED = "CASE WHEN came <= arrived_ms THEN 1 WHEN came <= arrived_ms + 500 THEN 2 WHEN came <= arrived_ms + 1500 THEN 3 END"

ORACLE_SQL = {
    "dependency_parking": f"""
WITH c AS (SELECT c_custkey, CAST(c_custkey AS BIGINT) * 7919 % 5000 AS arrived_ms FROM customer),
o AS (
  SELECT *, {_JUDGED} AS tried FROM (
    SELECT o_orderkey, o_custkey, CAST(o_orderkey AS BIGINT) * 104729 % 5000 AS arrived_ms, (SELECT min(c.arrived_ms) FROM c WHERE c_custkey = o_custkey) AS came FROM orders) x
),
oa AS (SELECT o_orderkey, o_custkey, min(arrived_ms + [0, 500, 1500][tried]) AS came FROM o WHERE tried IS NOT NULL GROUP BY ALL),
l AS (
  SELECT *, greatest(order_at, customer_at) AS later, CASE WHEN order_at IS NOT NULL AND customer_at IS NOT NULL THEN greatest(order_at, customer_at) END AS came FROM (
    SELECT l_orderkey, l_linenumber, k.o_custkey, (CAST(l_orderkey AS BIGINT) * 31 + CAST(l_linenumber AS BIGINT) * 7919) % 5000 AS arrived_ms, oa.came AS order_at, (SELECT min(c.arrived_ms) FROM c WHERE c_custkey = k.o_custkey) AS customer_at
    FROM lineitem JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) k ON k.o_orderkey = l_orderkey LEFT JOIN oa ON oa.o_orderkey = k.o_orderkey AND oa.o_custkey = k.o_custkey) x
),
lj AS (SELECT *, {_JUDGED} AS tried FROM l),
everything AS (
  SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, arrived_ms, 1 AS tried, NULL AS missing FROM c
  UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), arrived_ms, tried, CASE WHEN tried IS NULL THEN 'customer:' || o_custkey END FROM o
  UNION ALL SELECT 'line', l_orderkey || '-' || l_linenumber, arrived_ms, tried, CASE WHEN tried IS NULL THEN CASE WHEN customer_at IS NULL OR customer_at > arrived_ms + 1500 THEN 'customer:' || o_custkey ELSE 'order:' || l_orderkey END END FROM lj
)
SELECT kind, id, arrived_ms, CAST(coalesce(tried, 3) AS INT) AS attempt, CASE WHEN tried IS NULL THEN 'dead_letter' ELSE 'admitted' END AS outcome, arrived_ms + [0, 500, 1500][coalesce(tried, 3)] AS decided_ms, missing FROM everything
""",
    "history_features": f"WITH {_features_sql(500, 30)} SELECT {_COLUMNS} FROM shaped",
    "history_features_bounded": f"WITH {_features_sql(3, 60)} SELECT {_COLUMNS} FROM shaped",
    "arrival_decisions": f"WITH {_features_sql(500, 30)}, ready AS (FROM shaped), {_RULES} SELECT payment_id, customer_id, score, decision, severity, matched_rules, reason_codes FROM final",
}
