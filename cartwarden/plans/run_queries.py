"""Runs of six hours of events: requests of status, repairs after a restart, and what each run's manifest reached.

A manifest lists the events of its six hours; every thirteenth is in the next run's too, every seventh twice, once with another
type. Signups ask for a status by k; every hundredth product number stays unprocessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..operators import records, runs
from ..sources import adapters as A
from . import fraud_queries, outbox_queries

SPAN = 21_600_000_000
ASKED = ("PENDING", "STARTING", "RUNNING", "STOP_REQUESTED", "STOPPED", "COMPLETED", "FAILED", "PAUSED")


def _run() -> Column:
    return F.floor(F.col("at_us") / SPAN)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.get(F.array(*map(F.lit, ASKED)), F.col("k") % len(ASKED))
    return A.events(spark, sf_dir).where("event_type = 'signup'").select(_run().alias("run_id"), "at_us", F.col("event_id").alias("request_id"), target.alias("target"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir).select(_run().alias("run_id"), "event_id", "event_type")
    more = F.array(F.struct(F.lit(0).alias("later"), F.lit("").alias("mark")), F.when(F.col("event_id") % 13 == 0, F.struct(F.lit(1).alias("later"), F.lit("").alias("mark"))), F.when(F.col("event_id") % 7 == 0, F.struct(F.lit(0).alias("later"), F.lit("+").alias("mark"))))
    listed = e.withColumn("x", F.explode(F.filter(more, lambda x: x.isNotNull())))
    return listed.select((F.col("run_id") + F.col("x.later")).alias("run_id"), "event_id", F.concat("x.mark", "event_type").alias("expected_event_type"))


def _restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").agg(F.max(A.micros("ts")) + 1_000_000)


def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request of a run with its verdict, and the rows that repair the runs which a restart found underway."""
    asked = requests(spark, sf_dir)
    mended = runs.repaired(runs.moves(runs.sound_requests(asked)), _restart(spark, sf_dir))
    added = mended.select("run_id", "at_us", F.lit(None).cast("long").alias("request_id"), F.col("after").alias("target"), "before", F.lit("repaired").alias("verdict"), "after")
    return runs.transitions(asked).unionByName(added)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run: status after repairs, span, and counts along manifest, ledger, evaluations, alerts and outbox."""
    moved = kept(runs.moves(runs.sound_requests(requests(spark, sf_dir))), "moves")  # a row a run, read twice
    spans = runs.spans(moved, runs.repaired(moved, _restart(spark, sf_dir)))
    ledger = records.delivery_outcomes(A.deliveries(spark, sf_dir)).where("outcome = 'processed' AND k <> 97").select("event_id", "event_type")
    scored = fraud_queries._evaluated(spark, sf_dir).select(F.col("payment_id").alias("source_event_id"), "decision")
    alerts = scored.where("decision <> 'APPROVE'").select("source_event_id", F.col("source_event_id").alias("alert_id"))
    outbox = outbox_queries._published(spark, sf_dir).select(F.col("outbox_id").alias("alert_id"), "status")
    return runs.summary(spans, runs.reached(manifest(spark, sf_dir), ledger, scored, alerts, outbox)).withColumns({c: F.round(c, 6) for c in ("duration_s", "effective_rate")})


QUERIES = {f.__name__: f for f in (run_transitions, run_report)}

_EDGE_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in runs.EDGES.items() for b in bs)
_TARGET_SQL = "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ASKED)) + " END"
_FOLD = f"""{outbox_queries._ROWS},
edges AS (SELECT * FROM (VALUES {_EDGE_SQL}) e(a, b)),
asked AS (SELECT at_us // {SPAN} AS run_id, at_us, event_id AS request_id, {_TARGET_SQL} AS target, row_number() OVER (PARTITION BY at_us // {SPAN} ORDER BY at_us, event_id) AS seq FROM ev WHERE event_type = 'signup'),
folded AS (
  SELECT run_id, at_us, request_id, target, seq, 'PENDING' AS before, CASE WHEN target = 'STARTING' THEN target ELSE 'PENDING' END AS after FROM asked WHERE seq = 1
  UNION ALL SELECT q.run_id, q.at_us, q.request_id, q.target, q.seq, f.after, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE a = f.after AND b = q.target) THEN q.target ELSE f.after END FROM folded f JOIN asked q ON q.run_id = f.run_id AND q.seq = f.seq + 1
),
finals AS (SELECT run_id, arg_max(after, seq) AS status, min(at_us) FILTER (before <> after AND after = 'RUNNING') AS started_us, min(at_us) FILTER (before <> after AND after IN ('STOPPED', 'COMPLETED', 'FAILED')) AS ended_us FROM folded GROUP BY 1),
restart AS (SELECT max(at_us) + 1000000 AS now_us FROM ev)"""
_AFTER = "CASE WHEN status = 'STOP_REQUESTED' THEN 'STOPPED' ELSE 'FAILED' END"
ORACLE_SQL = {
    "run_transitions": f"""WITH RECURSIVE {_FOLD} SELECT run_id, at_us, request_id, target, before, CASE WHEN before <> after THEN 'moved' WHEN target = before THEN 'same' ELSE 'illegal' END AS verdict, after FROM folded
 UNION ALL SELECT run_id, now_us, NULL, {_AFTER}, status, 'repaired', {_AFTER} FROM finals, restart WHERE status IN ('STARTING', 'RUNNING', 'STOP_REQUESTED')""",
    "run_report": f"""WITH RECURSIVE {_FOLD}, listed AS (
  SELECT run_id, event_id, min(kind) AS kind FROM (
   SELECT at_us // {SPAN} AS run_id, event_id, event_type AS kind FROM ev UNION ALL SELECT at_us // {SPAN} + 1, event_id, event_type FROM ev WHERE event_id % 13 = 0 UNION ALL SELECT at_us // {SPAN}, event_id, '+' || event_type FROM ev WHERE event_id % 7 = 0) x GROUP BY 1, 2),
 c AS (
  SELECT l.run_id, count(*) AS generated, count(e.event_id) AS processed, count(*) FILTER (e.event_type <> l.kind) AS mismatched, count(f.payment_id) AS evaluations, count(*) FILTER (f.decision = 'APPROVE') AS approved, count(*) FILTER (f.decision = 'REVIEW') AS review,
   count(*) FILTER (f.decision = 'BLOCK') AS blocked, count(t.id) AS alerts, count(*) FILTER (t.status = 'PENDING') AS pending, count(*) FILTER (t.status = 'PUBLISHED') AS published
  FROM listed l LEFT JOIN (SELECT * FROM ev WHERE k <> 97) e ON e.event_id = l.event_id LEFT JOIN final f ON f.payment_id = l.event_id LEFT JOIN told t ON t.id = l.event_id GROUP BY 1),
 r AS (SELECT run_id, CASE WHEN status IN ('STARTING', 'RUNNING', 'STOP_REQUESTED') THEN {_AFTER} ELSE status END AS status, started_us, coalesce(ended_us, CASE WHEN status IN ('STARTING', 'RUNNING', 'STOP_REQUESTED') THEN now_us END) AS ended_us FROM finals, restart)
 SELECT r.*, {', '.join(f'coalesce({n}, 0) AS {n}' for n in 'generated processed mismatched evaluations approved review blocked alerts pending published'.split())}, round((ended_us - started_us) / 1e6, 6) AS duration_s,
  round(generated / nullif((ended_us - started_us) / 1e6, 0), 6) AS effective_rate FROM r LEFT JOIN c USING (run_id)""",
}
