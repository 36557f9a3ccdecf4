"""Runs: their state machine with repairs, and what a run's manifest reached along ledger, evaluations, alerts and outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The status a run starts with, the allowed edges, and what a restart makes of runs that it finds underway.
START = "PENDING"
EDGES = {"PENDING": ("STARTING",), "STARTING": ("RUNNING", "FAILED"), "RUNNING": ("COMPLETED", "STOP_REQUESTED", "FAILED"), "STOP_REQUESTED": ("STOPPED", "FAILED")}
REPAIRS = {"STARTING": "FAILED", "RUNNING": "FAILED", "STOP_REQUESTED": "STOPPED"}
ABANDONED = "api_restart"
_MOVES = "array<struct<at_us:bigint,request_id:bigint,target:string>>"


def longest_path(edges: dict[str, tuple[str, ...]] = EDGES, start: str = START) -> int:
    """How often a run can move; a status machine with a cycle is an error."""

    def steps(status: str, above: tuple[str, ...]) -> int:
        if status in above:
            raise ValueError(f"statuses come back to {status}")
        return max((1 + steps(s, (*above, status)) for s in edges.get(status, ())), default=0)

    return steps(start, ())


def _allowed(before: Column, target: Column) -> Column:
    found = F.lit(False)
    for status, targets in EDGES.items():
        found |= (before == status) & target.isin(*targets)
    return F.coalesce(found, F.lit(False))


def moves(requests: DataFrame) -> DataFrame:
    """requests(run_id, at_us, request_id, target) -> (run_id, moves): the requests that changed a run's status, in order.

    The edges have no cycle, so a run moves a few times however many requests it has: each round takes, for every run,
    the first request after its last move that an edge allows. A round is an aggregate of minima, so no run is sorted
    or gathered.
    """
    order = F.struct("at_us", "request_id", "target")
    found = requests.groupBy("run_id").agg(F.lit(None).cast(_MOVES).alias("moves")).withColumn("moves", F.array().cast(_MOVES))
    for _ in range(longest_path()):
        last = F.get("moves", F.size("moves") - 1)
        fits = _allowed(F.coalesce(last["target"], F.lit(START)), F.col("target")) & (last.isNull() | (order > last))
        step = requests.join(found, "run_id").where(fits).groupBy("run_id").agg(F.min(order).cast(_MOVES[6:-1]).alias("step"))
        found = found.join(step, "run_id", "left").select("run_id", F.when(F.col("step").isNull(), F.col("moves")).otherwise(F.concat("moves", F.array("step"))).alias("moves"))
    return found


def sound_requests(requests: DataFrame) -> DataFrame:
    """Requests with a run, a time and an id; rows that repeat throughout count once."""
    rows = requests.select("run_id", F.col("at_us").cast("long").alias("at_us"), F.col("request_id").cast("long").alias("request_id"), "target")
    return rows.where("run_id IS NOT NULL AND at_us IS NOT NULL AND request_id IS NOT NULL").distinct()


def transitions(requests: DataFrame) -> DataFrame:
    """Every sound request judged by (at_us, request_id, target): with before, verdict and after.

    ``moved``: an allowed edge. ``same``: the run has that status. ``illegal``: anything else, unknown and null targets
    too; the run stays as it is, so later requests are judged against the status it has, not the one asked for.
    """
    rows = sound_requests(requests)
    order = F.struct("at_us", "request_id", "target")
    judged = rows.join(moves(rows), "run_id")
    earlier = F.filter("moves", lambda m: m < order)
    before = F.coalesce(F.get(earlier, F.size(earlier) - 1)["target"], F.lit(START))
    verdict = F.when(F.exists("moves", lambda m: m == order), "moved").when(F.col("target") == F.col("before"), "same").otherwise("illegal")
    told = judged.withColumn("before", before).withColumn("verdict", verdict)
    return told.select(*rows.columns, "before", "verdict", F.when(F.col("verdict") == "moved", F.col("target")).otherwise(F.col("before")).alias("after"))


def repaired(run_moves: DataFrame, restarted_us: DataFrame) -> DataFrame:
    """(run_id, at_us, before, after, category) for each run that a restart found underway. restarted_us: one row and column."""
    last = F.get("moves", F.size("moves") - 1)["target"]
    after = F.coalesce(*[F.when(F.col("before") == s, F.lit(t)) for s, t in REPAIRS.items()])
    rows = run_moves.select("run_id", last.alias("before")).withColumn("after", after).where("after IS NOT NULL")
    return rows.join(F.broadcast(restarted_us.toDF("at_us"))).select("run_id", "at_us", "before", "after", F.lit(ABANDONED).alias("category"))  # one row is joined


def spans(run_moves: DataFrame, repairs: DataFrame) -> DataFrame:
    """(run_id, status, started_us, ended_us) after the repairs: started when RUNNING, ended when a final status came."""
    at = lambda *names: F.get(F.filter("moves", lambda m: m["target"].isin(*names)), 0)["at_us"]
    final = [s for s in {t for ts in EDGES.values() for t in ts} if s not in EDGES]
    mended = run_moves.join(repairs.select("run_id", F.col("at_us").alias("mended_us"), F.col("after").alias("mended")), "run_id", "left")
    last = F.coalesce(F.get("moves", F.size("moves") - 1)["target"], F.lit(START))
    return mended.select("run_id", F.coalesce("mended", last).alias("status"), at("RUNNING").alias("started_us"), F.coalesce(at(*sorted(final)), "mended_us").alias("ended_us"))


def reached(manifest: DataFrame, ledger: DataFrame, evaluations: DataFrame, alerts: DataFrame, outbox: DataFrame) -> DataFrame:
    """How far each run's events came: (run_id, generated, processed, mismatched, evaluations, approved, review, blocked, alerts, pending, published).

    manifest(run_id, event_id, expected_event_type): a pair listed again counts once, with the least type. ledger(event_id,
    event_type), evaluations(source_event_id, decision), alerts(source_event_id, alert_id), outbox(alert_id, status) are
    cut to one row a key (the least) before the joins, so that repeated rows can't multiply counts. mismatched: processed
    as another type than expected, null types included. Rows without run or event are left out; a run whose events got
    nowhere has zeros.
    """
    one = lambda df, key, *rest: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*rest)).alias("v"))
    listed = manifest.where("run_id IS NOT NULL AND event_id IS NOT NULL").groupBy("run_id", F.col("event_id").alias("key")).agg(F.min("expected_event_type").alias("expected"))
    sent = one(outbox, "alert_id", "status").select(F.col("key").alias("alert_id"), F.col("v.status").alias("status"), F.lit(1).alias("sent"))
    alarmed = one(alerts, "source_event_id", "alert_id").select("key", F.col("v.alert_id").alias("alert_id"), F.lit(1).alias("alarmed")).join(sent, "alert_id", "left").drop("alert_id")
    chain = (
        listed.join(one(ledger, "event_id", "event_type").select("key", F.col("v.event_type").alias("kind"), F.lit(1).alias("done")), "key", "left")
        .join(one(evaluations, "source_event_id", "decision").select("key", F.col("v.decision").alias("decision"), F.lit(1).alias("judged")), "key", "left").join(alarmed, "key", "left")
    )
    other = F.col("done").isNotNull() & ~F.col("kind").eqNullSafe(F.col("expected"))
    return chain.groupBy("run_id").agg(
        F.count("*").alias("generated"), F.count("done").alias("processed"), F.count_if(other).alias("mismatched"), F.count("judged").alias("evaluations"),
        *[F.count_if(F.col("decision") == d).alias(n) for d, n in (("APPROVE", "approved"), ("REVIEW", "review"), ("BLOCK", "blocked"))], F.count("alarmed").alias("alerts"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "PUBLISHED")],
    )


def summary(run_spans: DataFrame, counts: DataFrame) -> DataFrame:
    """Each run's span with its counts (zeros without a manifest), duration in seconds and effective rate (null without a duration)."""
    names = [c for c in counts.columns if c != "run_id"]
    seconds = (F.col("ended_us") - F.col("started_us")) / 1_000_000
    joined = run_spans.join(counts, "run_id", "left").select(*run_spans.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in names], seconds.alias("duration_s"))
    return joined.withColumn("effective_rate", F.when(F.col("duration_s") > 0, F.col("generated") / F.col("duration_s")))
