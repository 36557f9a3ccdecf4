"""Fraud features, rules, decisions, alerts and refunds over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, fraud
from ..sources import adapters as A

CFG = fraud.EVENTS_CONFIG


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.payment_features(A.payments(spark, sf_dir), A.events(spark, sf_dir), CFG)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.evaluate(_features(spark, sf_dir), fraud.payment_rules(CFG), CFG)


def fraud_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return f.select(
        "payment_id", "customer_id", "status", "attempts", "failures", "failure_reasons", "devices", "countries", "successes", "prior_failures", "spend", "views", "checkout_seconds",
        F.concat_ws(",", F.transform("known_devices", lambda d: d.cast("string"))).alias("known_devices"), "is_new_device", "country_mismatch",
    )


def fraud_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("payment_id", "customer_id", "score", "decision", "severity", "matched_rules", "reason_codes")


def fraud_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _evaluated(spark, sf_dir).select(F.explode("results").alias("r"))
        .groupBy(F.col("r.rule_id").alias("rule_id"))
        .agg(F.count_if("r.matched").alias("matched"), F.sum("r.score").alias("total_score"), F.count("*").alias("evaluations"))
    )


def fraud_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.alerts(_evaluated(spark, sf_dir))


def fraud_customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).groupBy("customer_id").agg(
        F.count("*").alias("evaluations"), F.count_if(F.col("decision") == "APPROVE").alias("approved"), F.count_if(F.col("decision") == "REVIEW").alias("review"),
        F.count_if(F.col("decision") == "BLOCK").alias("blocked"), F.max("score").alias("max_score"),
    )


def refund_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.admit_refunds(A.refunds(spark, sf_dir), A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast(A.MONEY).alias("paid")))


def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.order_status(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast(A.MONEY).alias("paid")), refund_admission(spark, sf_dir))


def refund_abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    return entities.refund_frequency(A.refunds(spark, sf_dir).join(orders, "order_id"), days=180, least=3)


def _refund_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast(A.MONEY).alias("paid"), F.col("o_orderdate").alias("paid_at"))
    return fraud.refund_features(A.refunds(spark, sf_dir), orders, CFG)


def refund_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds with their features, scored by the rules of refunds."""
    scored = fraud.evaluate(_refund_rows(spark, sf_dir), fraud.refund_rules(CFG), CFG)
    return scored.select("order_id", "seq", "refundable", "since_payment", "recent_refunds", "amount_matches_order", "score", "decision", "severity", "matched_rules", "reason_codes")


def rule_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations and matches of each rule by event type, payments and refunds in one frame: a rule leaves other types out."""
    payments = _features(spark, sf_dir).withColumn("event_type", F.when(F.col("status") == "failed", "payment_failed").otherwise("payment_completed"))
    rows = payments.unionByName(_refund_rows(spark, sf_dir).drop("customer_id").withColumn("event_type", F.lit("refund_requested")), allowMissingColumns=True)
    wanted = {n: r for n, r in (fraud.payment_rules(CFG) | fraud.refund_rules(CFG)).items() if n not in ("high_amount", "payment_amount_mismatch")}
    found = fraud.evaluate(rows, fraud.gated(wanted), CFG).select("event_type", F.explode("results").alias("r"))
    return found.groupBy("event_type", F.col("r.rule_id").alias("rule_id")).agg(F.count("*").alias("evaluations"), F.count_if("r.matched").alias("matched"))


def rule_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule results above what their rule may score."""
    return fraud.over_limit(_evaluated(spark, sf_dir))


def evaluation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments whose evaluation differs from the one stored when payments of 50 points or more are blocked."""
    stored, stricter = _evaluated(spark, sf_dir), replace(CFG, block=50)
    return fraud.evaluation_conflicts(stored, fraud.evaluate(_features(spark, sf_dir), fraud.payment_rules(stricter), stricter), "payment_id")


def cart_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("product_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("position"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast(A.MONEY).alias("unit_price"),
    )
    return entities.cart_timeline(lines).groupBy("cart_id").agg(F.max_by("subtotal", "seq").cast("decimal(28,2)").alias("subtotal"), F.max("subtotal").cast("decimal(28,2)").alias("peak"), F.count("*").alias("adds"))


QUERIES = {f.__name__: f for f in (fraud_features, fraud_decisions, fraud_rule_counts, fraud_alerts, fraud_customer_rollup, refund_admission, order_status, refund_abuse, refund_decisions, rule_gating, rule_limits, evaluation_conflicts, cart_totals)}

_FEATURES = f"""
{A.ORACLE},
timeline AS (
  SELECT payment_id, customer_id, status, amount, device, country, home, failure_reason, at_us, 'payment' AS kind FROM payments
  UNION ALL
  SELECT event_id, user_id, NULL, NULL, NULL, NULL, NULL, NULL, at_us, CASE WHEN event_type = 'signup' THEN 'session' ELSE 'view' END FROM ev WHERE event_type IN ('signup', 'view')
),
features AS (
  SELECT p.*,
    (SELECT count(*) FROM payments h WHERE h.customer_id = p.customer_id AND h.at_us BETWEEN p.at_us - 86400000000 AND p.at_us) AS attempts,
    (SELECT count(*) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'failed' AND h.at_us BETWEEN p.at_us - 86400000000 AND p.at_us) AS failures,
    (SELECT count(DISTINCT failure_reason) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'failed' AND h.at_us BETWEEN p.at_us - 86400000000 AND p.at_us) AS failure_reasons,
    (SELECT count(DISTINCT device) FROM payments h WHERE h.customer_id = p.customer_id AND h.at_us BETWEEN p.at_us - 86400000000 AND p.at_us) AS devices,
    (SELECT count(DISTINCT country) FROM payments h WHERE h.customer_id = p.customer_id AND h.at_us BETWEEN p.at_us - 172800000000 AND p.at_us) AS countries,
    (SELECT count(*) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'completed' AND h.at_us < p.at_us) AS successes,
    (SELECT count(*) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'failed' AND h.at_us < p.at_us) AS prior_failures,
    (SELECT CAST(sum(amount) AS DECIMAL(28,2)) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'completed' AND h.at_us < p.at_us) AS spend,
    coalesce((SELECT string_agg(DISTINCT CAST(device AS VARCHAR), ',' ORDER BY CAST(device AS VARCHAR)) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'completed' AND h.at_us < p.at_us), '') AS known_devices,
    (SELECT count(*) FROM payments h WHERE h.customer_id = p.customer_id AND h.status = 'completed' AND h.at_us < p.at_us AND h.device = p.device) AS same_device,
    (SELECT max(at_us) FROM timeline s WHERE s.customer_id = p.customer_id AND s.kind = 'session' AND s.at_us <= p.at_us) AS session_at
  FROM payments p
),
shaped AS (
  SELECT f.*,
    (SELECT count(*) FROM timeline v WHERE v.customer_id = f.customer_id AND v.kind = 'view' AND v.at_us <= f.at_us AND (f.session_at IS NULL OR v.at_us > f.session_at)) AS views,
    CAST(greatest(0, (f.at_us - f.session_at) // 1000000) AS BIGINT) AS checkout_seconds_raw,
    coalesce(f.successes > 0 AND f.same_device = 0, FALSE) AS is_new_device,
    coalesce(f.country <> f.home, FALSE) AS country_mismatch
  FROM features f
),
ready AS (SELECT *, CASE WHEN session_at IS NULL THEN 0 ELSE checkout_seconds_raw END AS checkout_seconds FROM shaped),
matched AS (
  SELECT *,
    coalesce(amount >= 150, FALSE) AS large,
    coalesce(spend > 0 AND amount * successes >= 3 * spend, FALSE) AS deviates,
    attempts >= 3 AS velocity, failures >= 3 AS burst, successes >= 2 AND is_new_device AS device_rule, countries > 1 AS many,
    coalesce(checkout_seconds <= 86400, FALSE) AS rapid
  FROM ready
),
ruled AS (
  SELECT *,
    (CAST(successes > 0 AS INT) + CAST(is_new_device AS INT) + CAST(country_mismatch AS INT) + CAST(rapid AS INT) + CAST(deviates AS INT)) >= 4 AS takeover,
    views >= 2 AND rapid AS bot
  FROM matched
),
rules AS (
  SELECT payment_id, customer_id, 1 AS n, 'high_amount' AS rule_id, 'HIGH_AMOUNT' AS code, large OR deviates AS hit, 25 * CAST(large AS INT) + 20 * CAST(deviates AS INT) AS points, CASE WHEN deviates THEN 3 ELSE 2 END AS level FROM ruled
  UNION ALL SELECT payment_id, customer_id, 2, 'payment_velocity', 'PAYMENT_VELOCITY', velocity, 20, 2 FROM ruled
  UNION ALL SELECT payment_id, customer_id, 3, 'failed_payment_burst', 'FAILED_PAYMENT_BURST', burst, 25, 3 FROM ruled
  UNION ALL SELECT payment_id, customer_id, 4, 'new_device', 'NEW_DEVICE', device_rule, 15, 2 FROM ruled
  UNION ALL SELECT payment_id, customer_id, 5, 'country_mismatch', 'COUNTRY_MISMATCH', country_mismatch OR many, 10 * CAST(country_mismatch AS INT) + 10 * CAST(many AS INT), CASE WHEN many THEN 3 ELSE 2 END FROM ruled
  UNION ALL SELECT payment_id, customer_id, 6, 'rapid_checkout', 'RAPID_CHECKOUT', rapid, 15, 2 FROM ruled
  UNION ALL SELECT payment_id, customer_id, 7, 'account_takeover_composite', 'ACCOUNT_TAKEOVER_PATTERN', takeover, 60, 4 FROM ruled
  UNION ALL SELECT payment_id, customer_id, 8, 'bot_checkout', 'BOT_CHECKOUT_PATTERN', bot, 30, 2 FROM ruled
),
scored AS (
  SELECT payment_id, customer_id, CAST(least(100, sum(CASE WHEN hit THEN points ELSE 0 END)) AS INT) AS score, CAST(count(*) FILTER (hit) AS INT) AS matched_rules,
    coalesce(string_agg(code, ',' ORDER BY n) FILTER (hit), '') AS reason_codes, coalesce(max(level) FILTER (hit), 1) AS worst
  FROM rules GROUP BY payment_id, customer_id
),
decided AS (SELECT *, CASE WHEN score >= 60 THEN 'BLOCK' WHEN score >= 30 THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM scored),
final AS (
  SELECT *, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(worst, CASE decision WHEN 'BLOCK' THEN 3 WHEN 'REVIEW' THEN 2 ELSE 1 END)] AS severity FROM decided
)
"""

_REFUNDS = f"""
{A.ORACLE},
refund_rows AS (
  SELECT r.order_id, r.seq, r.amount, r.requested_at, o.o_custkey AS customer_id, CAST(o.o_totalprice AS DECIMAL(18,2)) AS paid, o.o_orderdate AS paid_at,
    (SELECT sum(amount) FROM refunds b WHERE b.order_id = r.order_id AND b.seq <= r.seq) AS refunded
  FROM refunds r LEFT JOIN orders o ON o.o_orderkey = r.order_id
),
refund_shaped AS (
  SELECT *, CAST(paid - refunded AS DECIMAL(28,2)) AS refundable, greatest(0, CAST(epoch(CAST(requested_at AS TIMESTAMP)) AS BIGINT) - CAST(epoch(CAST(paid_at AS TIMESTAMP)) AS BIGINT)) AS since_payment,
    (SELECT count(*) FROM refund_rows h WHERE h.customer_id = r.customer_id AND h.requested_at <= r.requested_at AND h.requested_at >= r.requested_at - INTERVAL 180 DAY) AS recent_refunds,
    coalesce(amount = paid, TRUE) AS amount_matches_order
  FROM refund_rows r
),
refund_scores AS (
  SELECT *, CAST(least(100, 35 * CAST(abuse AS INT) + 100 * CAST(NOT amount_matches_order AS INT)) AS INT) AS score FROM (
    SELECT *, coalesce(recent_refunds >= 3 OR (since_payment <= 2592000 AND refundable > 0 AND amount >= 0.9 * refundable AND recent_refunds >= 2), FALSE) AS abuse FROM refund_shaped) x
)
"""

_FOLD = f"""RECURSIVE {A.ORACLE},
paid_orders AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS paid FROM orders),
fold AS (
  SELECT r.order_id, r.seq, r.amount, o.paid, coalesce(r.amount <= o.paid, FALSE) AS admitted, CAST(CASE WHEN r.amount <= o.paid THEN r.amount ELSE 0 END AS DECIMAL(28,2)) AS total
  FROM refunds r LEFT JOIN paid_orders o ON o.o_orderkey = r.order_id WHERE r.seq = 1
  UNION ALL
  SELECT r.order_id, r.seq, r.amount, f.paid, coalesce(f.total + r.amount <= f.paid, FALSE), CAST(CASE WHEN f.total + r.amount <= f.paid THEN f.total + r.amount ELSE f.total END AS DECIMAL(28,2))
  FROM fold f JOIN refunds r ON r.order_id = f.order_id AND r.seq = f.seq + 1
)"""

ORACLE_SQL = {
    "refund_admission": f"WITH {_FOLD} SELECT order_id, CAST(seq AS INT) AS seq, amount, admitted FROM fold",
    "order_status": f"""WITH {_FOLD}, t AS (SELECT order_id, max(total) AS total FROM fold GROUP BY order_id)
 SELECT o_orderkey AS order_id, CAST(coalesce(total, 0) AS DECIMAL(28,2)) AS refunded, CASE WHEN coalesce(total, 0) = 0 THEN 'paid' WHEN total = paid THEN 'refunded' ELSE 'partially_refunded' END AS status FROM paid_orders LEFT JOIN t ON order_id = o_orderkey""",
    "fraud_features": f"WITH {_FEATURES} SELECT payment_id, customer_id, status, attempts, failures, CAST(failure_reasons AS INT) AS failure_reasons, CAST(devices AS INT) AS devices, CAST(countries AS INT) AS countries, successes, prior_failures, spend, views, checkout_seconds, known_devices, is_new_device, country_mismatch FROM ready",
    "fraud_decisions": f"WITH {_FEATURES} SELECT payment_id, customer_id, score, decision, severity, matched_rules, reason_codes FROM final",
    "fraud_rule_counts": f"WITH {_FEATURES} SELECT rule_id, count(*) FILTER (hit) AS matched, CAST(sum(CASE WHEN hit THEN points ELSE 0 END) AS BIGINT) AS total_score, count(*) AS evaluations FROM rules GROUP BY rule_id",
    "fraud_alerts": f"WITH {_FEATURES} SELECT payment_id, customer_id, score, decision, severity, reason_codes, 'OPEN' AS status FROM final WHERE decision <> 'APPROVE'",
    "fraud_customer_rollup": f"WITH {_FEATURES} SELECT customer_id, count(*) AS evaluations, count(*) FILTER (decision = 'APPROVE') AS approved, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'BLOCK') AS blocked, max(score) AS max_score FROM final GROUP BY customer_id",
    "refund_decisions": f"WITH {_REFUNDS} SELECT order_id, seq, refundable, since_payment, recent_refunds, amount_matches_order, score, CASE WHEN score >= 60 THEN 'BLOCK' WHEN score >= 30 THEN 'REVIEW' ELSE 'APPROVE' END AS decision, CASE WHEN NOT amount_matches_order THEN 'CRITICAL' WHEN abuse THEN 'HIGH' ELSE 'LOW' END AS severity, CAST(CAST(abuse AS INT) + CAST(NOT amount_matches_order AS INT) AS INT) AS matched_rules, concat_ws(',', CASE WHEN abuse THEN 'REFUND_ABUSE_PATTERN' END, CASE WHEN NOT amount_matches_order THEN 'PAYMENT_AMOUNT_MISMATCH' END) AS reason_codes FROM refund_scores",
    "rule_gating": f"WITH {_FEATURES}, {_REFUNDS.partition('refund_rows AS')[1]}{_REFUNDS.partition('refund_rows AS')[2]} SELECT CASE p.status WHEN 'failed' THEN 'payment_failed' ELSE 'payment_completed' END AS event_type, rule_id, count(*) AS evaluations, count(*) FILTER (hit) AS matched FROM rules JOIN payments p USING (payment_id) WHERE rule_id <> 'high_amount' GROUP BY ALL UNION ALL SELECT 'refund_requested', 'refund_abuse', count(*), count(*) FILTER (abuse) FROM refund_scores HAVING count(*) > 0",
    "rule_limits": f"WITH {_FEATURES} SELECT rule_id, count(*) AS n FROM rules WHERE hit AND points > CASE rule_id WHEN 'high_amount' THEN 100 WHEN 'account_takeover_composite' THEN 60 WHEN 'bot_checkout' THEN 30 WHEN 'failed_payment_burst' THEN 25 WHEN 'payment_velocity' THEN 20 WHEN 'country_mismatch' THEN 20 ELSE 15 END GROUP BY rule_id",
    "evaluation_conflicts": f"WITH {_FEATURES} SELECT payment_id, decision AS stored_decision, 'BLOCK' AS decision FROM final WHERE score BETWEEN 50 AND 59",
    "refund_abuse": """
WITH r AS (SELECT o_custkey AS customer_id, l_shipdate AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
c AS (SELECT customer_id, t, (SELECT count(*) FROM r h WHERE h.customer_id = r.customer_id AND h.t <= r.t AND h.t >= r.t - INTERVAL 180 DAY) AS recent FROM r)
SELECT customer_id, count(*) AS refunds, max(recent) AS most_recent, count(*) FILTER (recent >= 3) AS abusive FROM c GROUP BY customer_id
""",
    "cart_totals": """
WITH l AS (
  SELECT l_orderkey AS cart_id, l_partkey AS product_id, CAST(l_quantity AS INT) * CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM lineitem
),
d AS (SELECT *, total - coalesce(lag(total) OVER (PARTITION BY cart_id, product_id ORDER BY seq), 0) AS delta FROM l),
s AS (SELECT cart_id, seq, sum(delta) OVER (PARTITION BY cart_id ORDER BY seq) AS subtotal FROM d)
SELECT cart_id, CAST(max_by(subtotal, seq) AS DECIMAL(28,2)) AS subtotal, CAST(max(subtotal) AS DECIMAL(28,2)) AS peak, count(*) AS adds FROM s GROUP BY cart_id
""",
}
