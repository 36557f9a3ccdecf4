"""From a score to a message: evaluation rows, alert events with their envelope, outbox rows. All ids follow from the event's."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_json, uuid5
from . import contract as C
from .fraud import RULES

#: The namespaces of ids, and what stands in for reasons where none is named.
EVALUATIONS = uuid.UUID("af5fe7db-8df2-4e57-b506-39fc223b6e9c")
ALERTS = uuid.UUID("8738db40-333e-491a-a20d-4658782dfc44")
ALERT_EVENTS = uuid.UUID("8b3f028f-d1cb-465c-a662-ebfdcfb74d38")
OUTBOX = uuid.UUID("dc27cc58-f4b8-4849-9417-490923fc7ae2")
NO_REASON = "DECISION_THRESHOLD"
ENGINE, RULESET = "1.0.0", "2026-08"


def evaluation_rows(scored: DataFrame, event_id: Column, evaluated_at: Column, engine: str = ENGINE, ruleset: str = RULESET) -> DataFrame:
    """scored (fraud.evaluate) with evaluation_id, source_event_id, matched_rule_count, evaluated_at and the versions.

    One event has one evaluation id for a ruleset, however often it is scored. A result above what its rule may score is
    an error of configuration: the row that holds one fails the job. A null event has no row.
    """
    limit = F.create_map(*(F.lit(x) for name, (_, most) in RULES.items() for x in (name, most)))
    above = F.filter("results", lambda r: r["score"] > F.coalesce(F.element_at(limit, r["rule_id"]), F.lit(100)))
    sound = F.when(F.size(above) > 0, F.raise_error(F.concat(F.lit("rule above its maximum: "), F.get(above, 0)["rule_id"])).cast("int")).otherwise(F.size(F.filter("results", lambda r: r["matched"])))
    return scored.withColumns({
        "source_event_id": event_id, "evaluation_id": uuid5(EVALUATIONS, F.concat_ws(":", event_id, F.lit(ruleset))), "matched_rule_count": sound, "evaluated_at": evaluated_at,
        "engine_version": F.lit(engine), "ruleset_version": F.lit(ruleset),
    }).where(F.col("source_event_id").isNotNull())


def alert_messages(evaluations: DataFrame, customer_id: Column, order_id: Column, correlation_id: Column) -> DataFrame:
    """A message for each evaluation that isn't approved: alert_id, event_id, outbox_id, key, headers, payload (canonical JSON).

    The key is the customer, else the correlation. Reasons
    are those of the matched rules in their order, or ``DECISION_THRESHOLD``. The headers are those that every event
    has, and ``causation_id``: the event that was scored.
    """
    bad = evaluations.where("decision <> 'APPROVE'").withColumns({"__customer": customer_id, "__order": order_id, "__correlation": correlation_id})
    alert = uuid5(ALERTS, F.col("evaluation_id"))
    known = bad.withColumn("alert_id", alert).withColumn("event_id", uuid5(ALERT_EVENTS, F.col("alert_id"))).withColumn("outbox_id", uuid5(OUTBOX, F.col("event_id")))
    at = F.to_utc_timestamp("evaluated_at", F.current_timezone())
    time = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("Z"))
    matched = F.transform(F.filter("results", lambda r: r["matched"]), lambda r: r["reason_code"])
    reasons = F.when(F.size(matched) > 0, matched).otherwise(F.array(F.lit(NO_REASON)))
    payload = {
        "alert_id": F.col("alert_id"), "event_id": F.col("source_event_id"), "customer_id": F.col("__customer"), "order_id": F.col("__order"), "fraud_score": F.col("score").cast("string"), "decision": F.col("decision"),
        "reasons": reasons, "created_at": time,
    }
    event = {
        "event_id": F.col("event_id"), "event_type": F.lit("fraud_alert_created"), "event_version": F.lit(1), "event_time": time, "produced_at": time, "source": F.lit("fraud-engine"), "correlation_id": F.col("__correlation"),
    }
    nested = F.struct(*(payload[k].alias(k) for k in sorted(payload)))
    causation = F.array(F.struct(F.lit("causation_id").alias("key"), F.encode("source_event_id", "UTF-8").alias("value")))
    return known.select(
        "outbox_id", "alert_id", "event_id", "source_event_id", "decision", F.coalesce("__customer", "__correlation").alias("key"), F.concat(C.message_headers(event), causation).alias("headers"),
        canonical_json(**event, payload=nested).alias("payload"), "evaluated_at",
    )
