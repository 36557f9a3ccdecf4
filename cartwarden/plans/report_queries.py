"""Reports over deliveries and payments: latency, lag, repeats, invariants, verification, outbox rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_json, uuid5
from ..operators import records as R
from ..sources import adapters as A
from . import audit_queries, fraud_queries
from .outbox_queries import _uuid5_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _same(name: str, tables: str, sql: str, doc: str) -> None:
    before = set(audit_queries.QUERIES)
    audit_queries._same(name, tables, sql, doc)
    for new in set(audit_queries.QUERIES) - before:
        QUERIES[new], ORACLE_SQL[new] = audit_queries.QUERIES.pop(new), audit_queries.ORACLE_SQL.pop(new)


_same("processing_latency", "deliveries", """
SELECT event_type, count(*) AS matched, CAST(max(lag_ms) AS BIGINT) AS longest, CAST(min(lag_ms) AS BIGINT) AS shortest, round(avg(lag_ms), 6) AS mean_ms FROM (
  SELECT event_type, event_id, max(at_us + k * 1000) / 1000 - min(at_us) / 1000 AS lag_ms FROM {deliveries} GROUP BY event_type, event_id HAVING count(*) > 0) x GROUP BY event_type""", "From the first publication of an event to its last processing.")

_same("lag_slope", "ev", """
SELECT event_type, round((max_by(k, at_us) - min_by(k, at_us)) / greatest((max(at_us) - min(at_us)) / 1000000.0, 0.001), 9) AS slope, count(*) AS samples FROM {ev} GROUP BY event_type""", "Change of the sampled lag a second, from its first to its last sample.")


def lag_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean of the second half of the samples exceeds the first's by a tenth; samples are numbered hour by hour."""
    samples = A.events(spark, sf_dir).select("event_type", "k", "at_us", "event_id")
    sizes = samples.groupBy("event_type").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    placed = R.numbered(samples, "event_type", ["at_us", "event_id"], F.floor(F.col("at_us") / 3_600_000_000), "place").join(sizes, "event_type")
    first, second = (F.avg(F.when(side, F.col("k"))) for side in (F.col("place") < F.col("half"), F.col("place") >= F.col("half")))
    found = placed.groupBy("event_type").agg(first.alias("a"), second.alias("b"))
    return found.select("event_type", F.round("a", 6).alias("first_half"), F.round("b", 6).alias("second_half"), (F.col("b") > 1.1 * F.col("a")).alias("growing"))


QUERIES["lag_growing"] = lag_growing
ORACLE_SQL["lag_growing"] = f"""WITH {A.ORACLE}, n AS (SELECT event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY at_us, event_id) AS n, count(*) OVER (PARTITION BY event_type) // 2 AS half FROM ev),
 m AS (SELECT event_type, avg(k) FILTER (n <= half) AS a, avg(k) FILTER (n > half) AS b FROM n GROUP BY event_type) SELECT event_type, round(a, 6) AS first_half, round(b, 6) AS second_half, b > 1.1 * a AS growing FROM m"""

_same("handler_latency", "ev", """
SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 'eligible' ELSE 'other' END AS class, count(*) AS types, round(avg(mean_k), 6) AS mean_k
FROM (SELECT event_type, avg(k) AS mean_k FROM {ev} GROUP BY event_type) t GROUP BY 1""", "Mean over event types of their mean duration, for those that are scored and the others.")

_same("resource_peaks", "ev", """
SELECT user_id % 7 AS service, max(k) AS peak_cpu, round(max(value), 6) AS peak_memory FROM {ev} GROUP BY 1""", "The highest samples of each service.")

_same("duplicate_effects", "deliveries orders lineitem", """
SELECT 'deliveries' AS name, count(*) AS n, count(DISTINCT event_id) AS ids, count(*) - count(DISTINCT event_id) AS repeats FROM {deliveries}
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey) FROM {orders}
UNION ALL SELECT 'lines', count(*), count(DISTINCT l_orderkey * 1000 + l_linenumber), count(*) - count(DISTINCT l_orderkey * 1000 + l_linenumber) FROM {lineitem}""", "Rows and distinct ids of what should be unique.")

_same("invariant_report", "orders payments deliveries", """
SELECT 'orders are unique' AS rule, count(*) - count(DISTINCT o_orderkey) AS observed, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END AS result FROM {orders}
UNION ALL SELECT 'payments are positive', sum(CASE WHEN amount > 0 THEN 0 ELSE 1 END), CASE WHEN sum(CASE WHEN amount > 0 THEN 0 ELSE 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END FROM {payments}
UNION ALL SELECT 'deliveries are unique', count(*) - count(DISTINCT event_id), CASE WHEN count(*) = count(DISTINCT event_id) THEN 'PASS' ELSE 'FAIL' END FROM {deliveries}""", "Named checks with what was observed.")

_same("fraud_table_status", "payments ev", """
SELECT (SELECT count(*) FROM {payments}) AS evaluations, (SELECT count(*) FROM {payments} WHERE amount >= 400) AS open_alerts, (SELECT count(*) FROM {ev} WHERE k >= 60 AND k < 90) AS pending, (SELECT count(*) FROM {ev} WHERE k < 60) AS published""", "Evaluations, alerts and outbox rows in one row.")

_same("verification_row", "deliveries", """
SELECT count(DISTINCT event_id) AS events, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) AS purchases, count(DISTINCT CASE WHEN copy = 1 THEN event_id END) AS redelivered, min(CASE WHEN amount >= 400 THEN event_id END) AS first_large FROM {deliveries}""", "Distinct counts that a repeated delivery can't change.")

_same("freshness", "ev", """
SELECT event_type, max(at_us) AS last_at, (SELECT max(at_us) FROM {ev}) - max(at_us) AS behind FROM {ev} GROUP BY event_type""", "How far each type's last event lies behind the newest of all.")

_same("generated_vs_processed", "ev deliveries", """
SELECT g.event_type, g.n AS generated, p.n AS processed, p.n - g.n AS mismatch, round(p.n / greatest(p.span / 1000000.0, 0.001), 9) AS per_second
FROM (SELECT event_type, count(*) AS n FROM {ev} GROUP BY event_type) g LEFT JOIN (SELECT event_type, count(*) AS n, max(at_us) - min(at_us) AS span FROM {deliveries} GROUP BY event_type) p ON p.event_type = g.event_type""", "Events against deliveries.")

_same("statement_classes", "part", """
SELECT CASE WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%copper%' THEN 'copper' WHEN lower(trim(p_type)) = '' THEN 'empty' ELSE 'other' END AS class, count(*) AS n FROM {part} GROUP BY 1""", "Free text in a bounded set of classes.")

_same("repeat_aggregate", "orders", """
SELECT o_orderpriority AS metric, min(total) AS lowest, max(total) AS highest, count(*) AS repeats FROM (
  SELECT o_orderpriority, o_custkey % 5 AS repeat_no, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM {orders} GROUP BY 1, 2) x GROUP BY o_orderpriority""", "A metric over repeats: least, most and how many.")


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each partition beyond the committed frontier."""
    d = A.deliveries(spark, sf_dir)
    ends = d.groupBy("partition").agg((F.max("offset") + 1).alias("log_end"))
    return ends.join(R.commit_frontier(d.where("k <> 99")), "partition").select("partition", "log_end", "next_offset", (F.col("log_end") - F.col("next_offset")).alias("lag"))


def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in consecutive 12-hour bins from the first, empty bins as zero."""
    d = A.deliveries(spark, sf_dir)
    start = d.agg(F.min("at_us").alias("t0"), F.max("at_us").alias("t1"))
    width = 43_200_000_000
    bins = start.select("t0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / width))).alias("bin"))
    counts = d.join(F.broadcast(start.select("t0"))).groupBy(F.floor((F.col("at_us") - F.col("t0")) / width).alias("bin")).agg(F.count("*").alias("n"))  # one row is joined
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


NAMESPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox row for each alert: deterministic ids, canonical payload and its hash."""
    a = fraud_queries.fraud_alerts(spark, sf_dir)
    payload = canonical_json(alert_id=F.col("alert_id"), customer_id=F.col("customer_id"), decision=F.col("decision"), fraud_score=F.col("score"), reasons=F.col("reason_codes"))
    return a.withColumn("alert_id", uuid5(NAMESPACE, F.concat(F.lit("alert:"), F.col("payment_id").cast("string")))).withColumn("payload", payload).select(
        "payment_id", "alert_id", "payload", F.sha2("payload", 256).alias("payload_hash"), F.lit("PENDING").alias("status")
    )


QUERIES |= {f.__name__: f for f in (consumer_lag, fixed_bins, alert_outbox)}
ORACLE_SQL["alert_outbox"] = f"""WITH {fraud_queries._FEATURES}, a AS (SELECT *, {_uuid5_sql(NAMESPACE, "'alert:' || payment_id")} AS alert_id FROM final WHERE decision <> 'APPROVE'),
 p AS (SELECT payment_id, alert_id, '{{"alert_id":"' || alert_id || '","customer_id":' || customer_id || ',"decision":"' || decision || '","fraud_score":' || score || ',"reasons":"' || reason_codes || '"}}' AS payload FROM a)
 SELECT payment_id, alert_id, payload, sha256(payload) AS payload_hash, 'PENDING' AS status FROM p"""
ORACLE_SQL["consumer_lag"] = f"WITH {A.ORACLE}, t AS (SELECT part, off, lead(off) OVER (PARTITION BY part ORDER BY off) AS next FROM deliveries WHERE k <> 99), f AS (SELECT part, min(off) FILTER (next IS NULL OR next > off + 1) + 1 AS next_offset FROM t GROUP BY part), e AS (SELECT part, max(off) + 1 AS log_end FROM deliveries GROUP BY part) SELECT part AS partition, log_end, next_offset, log_end - next_offset AS lag FROM e JOIN f USING (part)"
ORACLE_SQL["fixed_bins"] = f"WITH {A.ORACLE}, s AS (SELECT min(at_us) AS t0, max(at_us) AS t1 FROM deliveries), b AS (SELECT unnest(range(0, (t1 - t0) // 43200000000 + 1)) AS bin FROM s) SELECT b.bin, count(d.event_id) AS n FROM b CROSS JOIN s LEFT JOIN deliveries d ON (d.at_us - s.t0) // 43200000000 = b.bin GROUP BY 1"

_same("outbox_recovery", "ev", """
SELECT event_type, sum(CASE WHEN at_us < (SELECT max(at_us) FROM {ev}) - 30000000 THEN 1 ELSE 0 END) AS recovered, count(*) AS claimed FROM {ev} WHERE k >= 90 AND k < 95 GROUP BY event_type""", "Claims older than 30 s at the time of the newest event, which go back to pending.")

_same("outbox_completeness", "payments ev", """
SELECT p.status, count(*) AS alerts, sum(CASE WHEN e.event_id IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN e.k >= 90 THEN 1 ELSE 0 END) AS stuck,
  round(sum(CASE WHEN e.k < 60 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS published_share
FROM {payments} p LEFT JOIN (SELECT event_id, k FROM {ev} WHERE k <> 13) e ON e.event_id = p.payment_id WHERE p.amount >= 250 GROUP BY p.status""", "Large payments against their outbox rows: missing, stuck and published.")

_same("payment_order_match", "orders refunds", """
SELECT r.order_id, r.seq, r.amount <> CAST(o.o_totalprice AS DECIMAL(18,2)) AS mismatched, CASE WHEN r.amount <> CAST(o.o_totalprice AS DECIMAL(18,2)) THEN 100 ELSE 0 END AS score,
  CASE WHEN r.amount <> CAST(o.o_totalprice AS DECIMAL(18,2)) THEN 'BLOCK' ELSE 'APPROVE' END AS decision
FROM {refunds} r JOIN {orders} o ON o.o_orderkey = r.order_id""", "Refund amounts against their order's total: any difference scores 100.")

_same("checkout_reconciliation", "orders lineitem", """
SELECT o_orderstatus, count(*) AS orders, sum(CASE WHEN c.cart IS NULL THEN 1 ELSE 0 END) AS missing_cart, sum(CASE WHEN c.subtotal <> CAST(o_totalprice AS DECIMAL(18,2)) THEN 1 ELSE 0 END) AS contradicted,
  sum(CASE WHEN c.discount <= c.subtotal THEN 1 ELSE 0 END) AS sound_discounts
FROM {orders} LEFT JOIN (SELECT l_orderkey AS cart, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal, sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,2))) AS discount FROM {lineitem} GROUP BY l_orderkey) c ON c.cart = o_orderkey
GROUP BY o_orderstatus""", "Orders against the cart they came from: missing, contradicted, and discounts within the subtotal.")

_same("evaluation_list", "payments", """
SELECT payment_id, customer_id, status, amount FROM {payments} ORDER BY at_us DESC, payment_id LIMIT 100""", "The 100 newest evaluated payments.")

_same("run_timeline", "orders", """
SELECT o_orderkey, o_orderdate, 'created' AS entry FROM {orders} WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, o_orderdate, o_orderstatus FROM {orders} WHERE o_custkey % 10 = 0
ORDER BY 2 DESC, 1, 3 LIMIT 100""", "Creation and status rows, the last hundred.")

_same("health_rollup", "ev", """
SELECT user_id % 5 AS component, CASE WHEN max(CASE WHEN event_type = 'error' AND k >= 98 THEN 1 ELSE 0 END) = 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM {ev} GROUP BY 1""", "A component is degraded if any of its samples is unhealthy.")

_same("queue_wait", "ev", """
SELECT event_type, count(*) AS n, round(avg(k - 10), 6) AS mean_wait, max(k - 10) AS longest FROM {ev} WHERE k - 10 >= 0 GROUP BY event_type""", "Waits before processing; negative ones are dropped.")

_same("utilisation", "ev", """
SELECT core, round(avg(busy), 6) AS mean_busy, max(busy) AS max_busy, count(*) AS ticks FROM (
  SELECT user_id % 8 AS core, k - lag(k) OVER (PARTITION BY user_id % 8 ORDER BY at_us, event_id) AS busy FROM {ev}) t WHERE busy >= 0 GROUP BY core""", "Per core: what its counter grew by between ticks, falls left out.")

_same("table_deltas", "ev", """
SELECT b.user_id, b.n AS before_n, a.n AS after_n, a.n - b.n AS delta FROM (SELECT user_id, count(*) AS n FROM {ev} WHERE k < 50 GROUP BY user_id) b JOIN (SELECT user_id, count(*) AS n FROM {ev} GROUP BY user_id) a ON a.user_id = b.user_id""", "Counters after less before, by key.")

_same("sustainability", "ev", """
SELECT user_id % 6 AS rate, min(share) >= 0.15 AND max(slope) < 0.5 AS sustainable, count(*) AS repeats FROM (
  SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS share, (max_by(k, at_us) - min_by(k, at_us)) / CAST(100 AS DOUBLE) AS slope FROM {ev} GROUP BY user_id) r GROUP BY 1""", "A rate holds if every repeat injected enough and none kept growing.")

_same("outage_recovery", "ev", """
SELECT x.event_type, max(x.peak) AS peak, min(CASE WHEN x.at_us > x.peak_at AND x.k <= x.base + 2 THEN x.at_us END) - max(x.peak_at) AS recovery_us FROM (
  SELECT e.event_type, e.k, e.at_us, p.peak, p.base, p.peak_at FROM {ev} e JOIN (SELECT event_type, max(k) AS peak, min(k) AS base, min(CASE WHEN k = 99 THEN at_us END) AS peak_at FROM {ev} GROUP BY event_type) p ON p.event_type = e.event_type) x GROUP BY x.event_type""", "The peak of the lag and how long it took to come back to the base.")
