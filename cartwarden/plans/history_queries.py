"""As-of queries over the events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..operators import history as H
from ..operators import contract as C
from ..sources import adapters as A
from . import record_queries


def _late_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments in order of event_id as they arrived; every twentieth tells of a time a day earlier."""
    p = A.payments(spark, sf_dir).withColumn("seq", F.col("payment_id"))
    return p.withColumn("at_us", F.when(F.col("payment_id") % 20 == 0, F.col("at_us") - 86_400_000_000).otherwise(F.col("at_us")))


def arrival_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity, failures and countries of the day before each payment, of what had arrived by then."""
    p = _late_payments(spark, sf_dir)
    triggers = p.select(F.col("payment_id").alias("trigger_id"), "customer_id", "seq", "at_us")
    wanted = {"attempts": F.count("*"), "failures": F.count_if(F.col("h_status") == "failed"), "countries": F.count_distinct("h_country"), "reasons": F.count_distinct("h_failure_reason")}
    return H.windowed_history(triggers, p.select("customer_id", "seq", "at_us", "status", "country", "failure_reason"), 86_400, wanted).select("trigger_id", *wanted)


def session_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session that each purchase's customer was in: the last signup at or before it."""
    e = A.events(spark, sf_dir).withColumnRenamed("user_id", "customer_id")
    sessions = e.where("event_type = 'signup'").select("customer_id", "at_us", F.col("event_id").alias("session_id"), F.col("k").alias("session_k"))
    purchases = e.where("event_type = 'purchase'").select("event_id", "customer_id", "at_us")
    return H.as_of_state(purchases, sessions, "customer_id", "at_us", ["session_id", "session_k"]).select("event_id", "session_id", "session_k")


def scoped_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the orders that stay when the orders in status P go."""
    scope = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return H.without_scope(A.table(spark, sf_dir, "lineitem"), scope, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup events as registrations of their customer: the first wins, later ones repeat or contradict its k modulo 4."""
    e = A.events(spark, sf_dir).where("event_type = 'signup'").withColumn("persona", F.col("k") % 4)
    return H.first_registration(e, "user_id", ["at_us", "event_id"], ["persona"]).groupBy("user_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("registered", "repeated", "conflict")])


def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose event_type header is payment_completed, per partition."""
    value = F.element_at(F.filter("headers", lambda h: h["key"] == "event_type"), 1)["value"].cast("string")
    return record_queries.raw_records(spark, sf_dir).where(value == "payment_completed").groupBy("partition").agg(F.count("*").alias("records"), F.min("offset").alias("first_offset"))


def dead_letter_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category: the bad records, their dead letters, those with all required fields, and those whose value survives base64."""
    found = kept(record_queries._classified(spark, sf_dir).where("category is not null"), "bad")  # read by both counts
    bad = found.groupBy("category").agg(F.count("*").alias("bad"))
    letters = C.incomplete_letters(C.dead_letters(found, failed_at=F.col("timestamp"))).groupBy(F.col("error_category").alias("category")).agg(
        F.count("*").alias("letters"), F.count_if(F.size("missing") == 0).alias("complete"), F.count_if(F.unbase64("original_value_base64").cast("string").rlike(r"\A\[?\{")).alias("readable")
    )
    return bad.join(letters, "category", "left")


QUERIES = {f.__name__: f for f in (arrival_features, session_as_of, scoped_delete, registrations, header_filter, dead_letter_completeness)}
_KIND = record_queries._CATEGORY

ORACLE_SQL = {
    "arrival_features": f"""WITH {A.ORACLE}, p AS (SELECT payment_id, customer_id, status, country, failure_reason, CASE WHEN payment_id % 20 = 0 THEN at_us - 86400000000 ELSE at_us END AS t FROM payments)
 SELECT p.payment_id AS trigger_id, count(*) AS attempts, count(*) FILTER (h.status = 'failed') AS failures, count(DISTINCT h.country) AS countries, count(DISTINCT h.failure_reason) AS reasons
 FROM p JOIN p h ON h.customer_id = p.customer_id AND h.payment_id <= p.payment_id AND h.t <= p.t AND h.t >= p.t - 86400000000 GROUP BY 1""",
    "session_as_of": f"""WITH {A.ORACLE}, s AS (SELECT user_id, at_us, event_id AS session_id, k AS session_k FROM ev WHERE event_type = 'signup')
 SELECT e.event_id, s.session_id, s.session_k FROM (SELECT * FROM ev WHERE event_type = 'purchase') e ASOF LEFT JOIN s ON s.user_id = e.user_id AND e.at_us >= s.at_us""",
    "scoped_delete": "SELECT l_returnflag, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "registrations": f"""WITH {A.ORACLE}, r AS (SELECT user_id, k % 4 AS persona, row_number() OVER w AS n, first_value(k % 4) OVER w AS first FROM ev WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
 SELECT user_id, count(*) FILTER (n = 1) AS registered, count(*) FILTER (n > 1 AND persona = first) AS repeated, count(*) FILTER (n > 1 AND persona <> first) AS conflict FROM r GROUP BY 1""",
    "header_filter": f"WITH {A.ORACLE} SELECT part AS partition, count(*) AS records, min(off) AS first_offset FROM deliveries WHERE copy = 0 AND event_id % 10 = 6 AND event_id % 41 NOT IN (7, 19) GROUP BY 1",
    "dead_letter_completeness": f"SELECT {_KIND} AS category, count(*) AS bad, count(*) AS letters, count(*) AS complete, count(*) FILTER (event_id % 41 <> 1) AS readable FROM events WHERE {_KIND} IS NOT NULL GROUP BY 1",
}
