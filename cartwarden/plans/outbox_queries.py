"""The alerts' outbox through a round of publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerting, outbox
from ..sources import adapters as A
from . import fraud_queries
from .record_queries import _uid


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as claimed outbox rows; every 23rd payload names another event."""
    a = fraud_queries._evaluated(spark, sf_dir).where("decision <> 'APPROVE'")
    named = (F.col("payment_id") + F.when(F.col("payment_id") % 23 == 0, 1).otherwise(0)).cast("string")
    rows = a.select(
        F.col("payment_id").alias("outbox_id"), F.col("payment_id").cast("string").alias("event_id"), F.to_json(F.struct(named.alias("event_id"), "decision", "score")).alias("payload"), F.col("at_us").alias("created_us"),
        F.lit("PUBLISHING").alias("status"), (1 + F.col("payment_id") % 11).cast("int").alias("attempts"), F.col("at_us").alias("claimed_us"), F.col("at_us").alias("available_us"),
    )
    return outbox.checked_identity(rows)


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _claimed(spark, sf_dir)
    results = rows.where("outbox_id % 4 <> 0").select("outbox_id", (F.col("created_us") + 1_000_000).alias("at_us"), F.when(F.col("outbox_id") % 4 == 3, F.repeat(F.lit("broker "), 100)).alias("error"))
    return outbox.after_publication(rows, results)


def outbox_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows whose payload is another event's."""
    return _claimed(spark, sf_dir).where("not sound").select("outbox_id", F.get_json_object("payload", "$.event_id").alias("named"))


def outbox_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed rows after their results: published, waiting for a retry, failed or still claimed."""
    p = _published(spark, sf_dir)
    return p.select("outbox_id", "status", "attempts", F.length("last_error").alias("error_chars"), "claimed_us", "available_us")


def outbox_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits, and whether the oldest of it is less than a day old at the time of the newest event."""
    return outbox.health(_published(spark, sf_dir), A.table(spark, sf_dir, "events").agg(F.max(A.micros("ts"))), 86_400)


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(evaluation rows, alert messages) of the scored payments."""
    scored = fraud_queries._evaluated(spark, sf_dir)
    rows = alerting.evaluation_rows(scored, _uid(8, F.col("payment_id")), F.timestamp_micros("at_us"))
    return rows, alerting.alert_messages(rows, _uid(1, F.col("customer_id")), F.lit(None).cast("string"), _uid(11, F.col("payment_id")))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation row for each payment, with its deterministic id."""
    rows = _messages(spark, sf_dir)[0]
    return rows.select("evaluation_id", "source_event_id", "payment_id", "score", "decision", "severity", "matched_rule_count", F.size("results").alias("results"), "engine_version", "ruleset_version")


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message of each alert: ids, key, headers and canonical payload."""
    shown = F.concat_ws(";", F.transform("headers", lambda h: F.concat_ws("=", h["key"], h["value"].cast("string"))))
    return _messages(spark, sf_dir)[1].select("outbox_id", "alert_id", "event_id", "source_event_id", "decision", "key", shown.alias("headers"), "payload")


QUERIES = {f.__name__: f for f in (outbox_identity, outbox_results, outbox_health, evaluation_rows, alert_messages)}

_ROWS = f"""{fraud_queries._FEATURES},
rows_ AS (
  SELECT f.payment_id AS id, p.at_us AS t, 1 + f.payment_id % 11 AS tries, f.payment_id % 23 = 0 AS wrong, f.payment_id % 4 AS r FROM final f JOIN payments p USING (payment_id) WHERE decision <> 'APPROVE'
),
told AS (
  SELECT *, CASE WHEN r = 0 THEN 'PUBLISHING' WHEN r < 3 AND NOT wrong THEN 'PUBLISHED' WHEN tries >= 10 THEN 'FAILED' ELSE 'PENDING' END AS status FROM rows_
)"""



def _uuid5_sql(namespace: object, text: str) -> str:
    """SQL for the fifth version's id of a text."""
    h = f"sha1(from_hex('{namespace.hex}') || encode({text}))"
    digit = f"(strpos('0123456789abcdef', substr({h}, 17, 1)) - 1)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', {digit} % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


_uid_sql = lambda n, number: f"'{n:08x}-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0')"
_MESSAGES = f"""{fraud_queries._FEATURES},
evaluated AS (
  SELECT f.*, p.at_us, {_uid_sql(8, 'f.payment_id')} AS source_event_id FROM final f JOIN payments p USING (payment_id)
),
rows_ AS (SELECT *, {_uuid5_sql(alerting.EVALUATIONS, f"source_event_id || ':{alerting.RULESET}'")} AS evaluation_id FROM evaluated),
alerted AS (SELECT *, {_uuid5_sql(alerting.ALERTS, 'evaluation_id')} AS alert_id FROM rows_ WHERE decision <> 'APPROVE'),
sent AS (
  SELECT *, {_uuid5_sql(alerting.ALERT_EVENTS, 'alert_id')} AS event_id, {_uid_sql(1, 'customer_id')} AS customer, {_uid_sql(11, 'payment_id')} AS correlation,
    strftime(make_timestamp(at_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN at_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(at_us % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS t,
    CASE WHEN reason_codes = '' THEN '["{alerting.NO_REASON}"]' ELSE '["' || replace(reason_codes, ',', '","') || '"]' END AS reasons
  FROM alerted
)"""

ORACLE_SQL = {
    "evaluation_rows": f"WITH {_MESSAGES} SELECT evaluation_id, source_event_id, payment_id, score, decision, severity, matched_rules AS matched_rule_count, 8::INT AS results, '{alerting.ENGINE}' AS engine_version, '{alerting.RULESET}' AS ruleset_version FROM rows_",
    "alert_messages": f"""WITH {_MESSAGES} SELECT {_uuid5_sql(alerting.OUTBOX, 'event_id')} AS outbox_id, alert_id, event_id, source_event_id, decision, customer AS key,
  'event_id=' || event_id || ';event_type=fraud_alert_created;event_version=1;correlation_id=' || correlation || ';source=fraud-engine;content_type=application/json;causation_id=' || source_event_id AS headers,
  '{{"correlation_id":"' || correlation || '","event_id":"' || event_id || '","event_time":"' || t || '","event_type":"fraud_alert_created","event_version":1,"payload":{{"alert_id":"' || alert_id || '","created_at":"' || t || '","customer_id":"' || customer
    || '","decision":"' || decision || '","event_id":"' || source_event_id || '","fraud_score":"' || score || '","order_id":null,"reasons":' || reasons || '}},"produced_at":"' || t || '","source":"fraud-engine"}}' AS payload FROM sent""",
    "outbox_identity": f"WITH {_ROWS} SELECT id AS outbox_id, CAST(id + 1 AS VARCHAR) AS named FROM rows_ WHERE wrong",
    "outbox_results": f"""WITH {_ROWS} SELECT id AS outbox_id, status, CAST(tries AS INT) AS attempts, CAST(CASE WHEN status IN ('PENDING', 'FAILED') THEN CASE WHEN wrong THEN 24 ELSE 512 END END AS INT) AS error_chars,
  CASE status WHEN 'PUBLISHING' THEN t END AS claimed_us, CASE status WHEN 'PENDING' THEN t + 1000000 + CASE WHEN tries > 6 THEN 30000000 ELSE 500000 * (1 << (tries - 1)::INT) END ELSE t END AS available_us FROM told""",
    "outbox_health": f"""WITH {_ROWS}, h AS (SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'PUBLISHING') AS publishing, count(*) FILTER (status = 'FAILED') AS failed, min(t) FILTER (status = 'PENDING') AS oldest FROM told),
  n AS (SELECT max(at_us) AS now FROM ev) SELECT pending, publishing, failed, coalesce((now - oldest) // 1000000, 0) AS oldest_age, coalesce((now - oldest) // 1000000, 0) <= 86400 AS healthy FROM h, n""",
}
