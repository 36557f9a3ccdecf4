"""Entity tables of a batch are seen together or not at all."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cartwarden.operators import contract as C
from cartwarden.operators import entity_tables as E
from cartwarden.plans import record_queries
from cartwarden.streaming import entity_sinks as S

SCHEMA = "id long"


def test_a_crash_between_tables_shows_neither(spark, tmp_path):
    root, one, two = str(tmp_path), spark.range(3).toDF("id"), spark.range(5).toDF("id")
    read = lambda name: sorted((r.batch_id, r.id) for r in S.read_together(spark, root, name, SCHEMA).collect())
    assert read("a") == [] and S.rows_written(spark, root).count() == 0
    S.write_together({"a": one, "b": two}, root, 0)
    broken = two.withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        S.write_together({"a": one, "b": broken}, root, 1)
    assert read("a") == [(0, i) for i in range(3)] and read("b") == [(0, i) for i in range(5)]
    S.write_together({"a": one, "b": two}, root, 1)  # the batch again
    S.write_together({"a": one.limit(1), "b": two.limit(0)}, root, 0)  # and an earlier one, with other rows
    assert read("a") == [(0, 0), (1, 0), (1, 1), (1, 2)] and read("b") == [(1, i) for i in range(5)]
    assert sorted(map(tuple, S.rows_written(spark, root).collect())) == [(0, "a", 1), (0, "b", 0), (1, "a", 3), (1, "b", 5)]


def test_entity_tables_of_awkward_bodies(spark):
    body = lambda **payload: json.dumps({"payload": payload})
    rows = [
        ("e1", "payment_completed", body(payment_id="p", amount="1.50", completed_at="2024-01-01T00:00:00Z", currency="EUR")), ("e2", "payment_failed", body(payment_id="q", amount="1.23456", failed_at="never")),
        ("e3", "fraud_alert_created", body(reasons=["a", "b"], fraud_score="55.5")), ("e4", "order_created", None), ("e5", None, body()), ("e6", "added_to_cart", body(quantity="many")),
    ]
    df = spark.createDataFrame(rows, "event_id string, event_type string, body string").withColumn("status", F.lit("x"))
    pay = {r.source_event_id: r for r in E.entity_table(df, "payments").collect()}
    assert str(pay["e1"].amount) == "1.5000" and pay["e1"].status == "completed" and pay["e1"].attempted_at is not None and pay["e2"].amount is None and pay["e2"].attempted_at is None
    assert E.entity_table(df, "external_alerts").first().reasons == ["a", "b"] and E.entity_table(df, "orders").count() == 0 and E.entity_table(df, "cart_items").first().quantity is None
    with pytest.raises(ValueError):
        E.entity_table(df, "nothing")


def test_tables_of_the_records(spark):
    raw = record_queries.raw_records(spark, "/root/testdata/sf0.001").limit(300)
    known = C.with_canonical(C.classify(raw).where("category is null").select(*raw.columns)).cache()
    assert sum(E.entity_table(known, n).count() for n in E.names()) == known.count()
    assert E.entity_table(known, "orders").where("total_amount is null or created_at is null or item_count is null").count() == 0


def test_one_of_equal_rows_is_registered(spark):
    from cartwarden.operators.history import first_registration

    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", 3, None), (None, 1, "x")], "k string, t int, who string")
    found = sorted((r.k, r.t, r.who or "", r.outcome) for r in first_registration(df, "k", ["t"], ["who"]).collect())
    assert found == [("a", 1, "x", "registered"), ("a", 1, "x", "repeated"), ("a", 1, "y", "conflict"), ("a", 2, "x", "repeated"), ("b", 3, "", "registered")]
