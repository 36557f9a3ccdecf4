"""The state machine of runs against a fold, its repairs, and counts along a manifest that repeated rows can't multiply."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartwarden.operators import runs as R

REQUESTS = "run_id string, at_us long, request_id long, target string"
STATUSES = ("PENDING", "STARTING", "RUNNING", "STOP_REQUESTED", "STOPPED", "COMPLETED", "FAILED", "PAUSED", None)


def folded(rows: set) -> dict:
    found, state = {}, {}
    for run, at, number, target in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or "")):
        before = state.get(run, R.START)
        moved = target in R.EDGES.get(before, ())
        state[run] = target if moved else before
        found[run, at, number, target] = (before, "moved" if moved else "same" if target == before else "illegal", state[run])
    return {"rows": found, "state": state}


def test_transitions_equal_a_fold(spark):
    r = random.Random(4)
    rows = [(f"r{r.randint(0, 30)}", r.randint(0, 40), r.randint(0, 5), r.choice(STATUSES)) for _ in range(400)]
    rows += [("hot", r.randint(0, 10**6), i, r.choice(["PAUSED", "STARTING", "PENDING", "RUNNING"] if i else ["STARTING"])) for i in range(3000)]  # a run with most of the rows
    odd = [(None, 1, 1, "STARTING"), ("x", None, 1, "STARTING"), ("x", 1, None, "STARTING"), ("lone", 1, 1, None), *rows[:20]]
    df = spark.createDataFrame(rows + odd, REQUESTS).repartition(4).withColumn("before", F.lit("clash")).withColumn("moves", F.lit(1))
    expected = folded({*rows, ("lone", 1, 1, None)})
    got = R.transitions(df).collect()
    assert {(x.run_id, x.at_us, x.request_id, x.target): (x.before, x.verdict, x.after) for x in got} == expected["rows"] and len(got) == len(expected["rows"])
    moved = R.moves(R.sound_requests(df))
    mended = R.repaired(moved, spark.createDataFrame([(10**7,)], "t long")).collect()
    assert {x.run_id: (x.before, x.after, x.at_us, x.category) for x in mended} == {k: (s, R.REPAIRS[s], 10**7, "api_restart") for k, s in expected["state"].items() if s in R.REPAIRS}
    status = {x.run_id: x.status for x in R.spans(moved, R.repaired(moved, spark.createDataFrame([(10**7,)], "t long"))).collect()}
    assert status == {k: R.REPAIRS.get(s, s) for k, s in expected["state"].items()}


def test_spans_and_the_longest_path(spark):
    rows = [("a", 5, 1, "STARTING"), ("a", 7, 2, "RUNNING"), ("a", 8, 3, "STOP_REQUESTED"), ("a", 11, 4, "STOPPED"), ("b", 1, 1, "STARTING"), ("b", 3, 2, "RUNNING"), ("c", 2, 1, "RUNNING")]
    moved = R.moves(R.sound_requests(spark.createDataFrame(rows, REQUESTS)))
    found = {x.run_id: (x.status, x.started_us, x.ended_us) for x in R.spans(moved, R.repaired(moved, spark.createDataFrame([(20,)], "t long"))).collect()}
    assert found == {"a": ("STOPPED", 7, 11), "b": ("FAILED", 3, 20), "c": ("PENDING", None, None)}
    assert R.longest_path() == 4
    with pytest.raises(ValueError):
        R.longest_path({"PENDING": ("OPEN",), "OPEN": ("PENDING",)})
    assert R.transitions(spark.createDataFrame([], REQUESTS)).count() == 0


def test_manifest_counts_once(spark):
    manifest = [("r1", 1, "paid"), ("r1", 1, "paid"), ("r1", 1, "zzz"), ("r1", 2, "paid"), ("r1", 3, "view"), ("r2", 1, "paid"), ("r2", 9, None), (None, 1, "paid"), ("r2", None, "paid")]
    ledger = [(1, "paid"), (1, "paid"), (2, "view"), (9, "odd"), (None, "paid")]
    evaluations = [(1, "BLOCK"), (1, "BLOCK"), (2, "APPROVE"), (None, "BLOCK")]
    alerts, outbox = [(1, 100), (1, 100)], [(100, "PUBLISHED"), (100, "PUBLISHED"), (7, "PENDING"), (None, "PENDING")]
    make = spark.createDataFrame
    sides = [make(ledger, "event_id long, event_type string"), make(evaluations, "source_event_id long, decision string"), make(alerts, "source_event_id long, alert_id long"), make(outbox, "alert_id long, status string")]
    counts = R.reached(make(manifest, "run_id string, event_id long, expected_event_type string"), *sides)
    found = {x.run_id: tuple(x)[1:] for x in counts.collect()}
    names = ["generated", "processed", "mismatched", "evaluations", "approved", "review", "blocked", "alerts", "pending", "published"]
    assert counts.columns == ["run_id", *names]
    assert found == {"r1": (3, 2, 1, 2, 1, 0, 1, 1, 0, 1), "r2": (2, 2, 1, 1, 0, 0, 1, 1, 0, 1)}
    spans = make([("r1", "STOPPED", 0, 2_000_000), ("r3", "FAILED", None, 5), ("r2", "STOPPED", 5, 5)], "run_id string, status string, started_us long, ended_us long")
    told = {x.run_id: (x.generated, x.duration_s, x.effective_rate) for x in R.summary(spans, counts).collect()}
    assert told == {"r1": (3, 2.0, 1.5), "r2": (2, 0.0, None), "r3": (0, None, None)}
    nothing = [s.limit(0) for s in sides]
    assert {tuple(x)[1:] for x in R.reached(make(manifest, "run_id string, event_id long, expected_event_type string"), *nothing).collect()} == {(3, *[0] * 9), (2, *[0] * 9)}
