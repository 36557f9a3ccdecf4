"""Alert messages: fields, errors of configuration, and a stream that publishes each alert once, replays included."""

from __future__ import annotations

import json
import shutil
import uuid

import pytest
from pyspark.sql import functions as F
from test_arrivals import make

from cartwarden.operators import alerting, fraud
from cartwarden.operators import arrivals as R
from cartwarden.streaming import alerts, keyed

CFG = fraud.FraudConfig(high_amount=400, velocity_count=2, velocity_seconds=4000, failure_count=2, failure_seconds=9000, history_days=1, newest=7, review=20, block=45)
RESULT = "array<struct<rule_id string, reason_code string, matched boolean, score int, severity string>>"


def scored(spark, rows):
    return spark.createDataFrame(rows, f"id string, results {RESULT}, score int, decision string, at timestamp").withColumns({c: F.lit("x") for c in ("payload", "key", "order_id")})


def test_messages_of_awkward_evaluations(spark):
    hit, miss = ("new_device", "NEW_DEVICE", True, 15, "MEDIUM"), ("rapid_checkout", "RAPID_CHECKOUT", False, 0, "LOW")
    at = "timestamp'2024-05-01 10:00:00.25'"
    df = scored(spark, [("a", [hit, miss], 15, "REVIEW", None), ("b", [miss], 0, "BLOCK", None), ("b", [miss], 0, "BLOCK", None), ("c", [], 0, "APPROVE", None), (None, [hit], 15, "BLOCK", None)]).withColumn("at", F.expr(at))
    rows = alerting.evaluation_rows(df, F.col("id"), F.col("at"))
    assert rows.count() == 4
    found = alerting.alert_messages(rows, F.when(F.col("id") == "a", "customer"), F.lit(None).cast("string"), F.lit("run")).orderBy("source_event_id").collect()
    assert [r.source_event_id for r in found] == ["a", "b", "b"] and found[1].event_id == found[2].event_id and [r.key for r in found] == ["customer", "run", "run"]
    body = json.loads(found[0].payload)
    evaluation = uuid.uuid5(alerting.EVALUATIONS, f"a:{alerting.RULESET}")
    alert = uuid.uuid5(alerting.ALERTS, str(evaluation))
    assert body["payload"] == {"alert_id": str(alert), "created_at": "2024-05-01T10:00:00.250000Z", "customer_id": "customer", "decision": "REVIEW", "event_id": "a", "fraud_score": "15", "order_id": None, "reasons": ["NEW_DEVICE"]}
    assert body["event_id"] == str(uuid.uuid5(alerting.ALERT_EVENTS, str(alert))) and found[0].outbox_id == str(uuid.uuid5(alerting.OUTBOX, body["event_id"]))
    assert list(body) == sorted(body) and json.loads(found[1].payload)["payload"]["reasons"] == ["DECISION_THRESHOLD"]
    assert {h["key"]: bytes(h["value"]).decode() for h in found[0].headers}["causation_id"] == "a"
    assert alerting.evaluation_rows(df.limit(0), F.col("id"), F.col("at")).count() == 0


def test_a_rule_above_its_maximum_is_an_error(spark):
    df = scored(spark, [("a", [("new_device", "NEW_DEVICE", True, 16, "MEDIUM")], 16, "APPROVE", None)])
    with pytest.raises(Exception, match="rule above its maximum: new_device"):
        alerting.evaluation_rows(df, F.col("id"), F.col("at")).collect()


def test_every_alert_is_published_once(spark, tmp_path):
    keyed.with_rocksdb(spark)
    rows = [(*r[:3], i, *r[4:]) for i, r in enumerate(make(240, 4, 3))]
    df = spark.createDataFrame(rows, R.ARRIVAL).withColumn("arrived", F.timestamp_seconds(F.col("seq") * 10 + 1_000))
    event = F.concat(F.lit("event-"), F.col("payment_id").cast("string"))

    def run():
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        query = alerts.publish(stream, f"{tmp_path}/outbox", alerts.to_folder(f"{tmp_path}/topic"), f"{tmp_path}/checkpoint", event, F.lit("run"), CFG, lateness_days=30)
        query.awaitTermination()

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, part in enumerate(("seq < 120", "seq >= 120")):
            df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            run()
        batch = fraud.evaluate(R.arrival_features(df, CFG), fraud.payment_rules(CFG), CFG)
        expected = {f"event-{r.payment_id}": r.decision for r in batch.where("decision <> 'APPROVE'").collect()}
        read = lambda: sorted((r.source_event_id, r.decision) for r in spark.read.parquet(f"{tmp_path}/topic/*").collect())
        assert read() == sorted(expected.items()) and len(expected) > 10
        # the last batch's commit is lost after its publication: it runs again
        last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
        for name in (str(last), f".{last}.crc"):
            (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
        shutil.rmtree(tmp_path / "topic" / f"batch-{last}", ignore_errors=True)
        run()
        assert read() == sorted(expected.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
