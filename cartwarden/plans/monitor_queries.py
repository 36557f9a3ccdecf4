"""Metrics of deliveries and of the alerts' outbox as labelled series, read by selectors and judged by the alert rules.

40 minutes of the given events count as a second, so that rules of minutes meet sparse events. A delivery is handled
k / 45 s after it arrives, one of k = 99 20 s later still; an alert is published (payment_id mod 11) * 4 s after its
payment. Events of three types are probes of a job, and purchases of the database: they fail below k = 60.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.shared import kept
from ..operators import metrics as M
from ..operators import records as R
from ..sources import adapters as A
from . import fraud_queries

SPEED, STEP = 2_400, 10_000_000
BOUNDS = ("0.5", "1", "2", "2.5", "5", "+Inf")
JOBS = {"view": "event-processor", "signup": "postgres-exporter", "click": "redis-exporter"}


def _cell(column: str) -> Column:
    return F.ceil(F.col(column) / STEP)


def _sample(metric: str, labels: dict[str, Column], at: Column, value: Column) -> list[Column]:
    made = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), v.cast("string")))) if labels else F.create_map()
    return [F.lit(metric).alias("metric"), made.cast("map<string,string>").alias("labels"), at.cast("long").alias("at_us"), value.cast("double").alias("value")]


def _counter(metric: str, rows: DataFrame, labels: list[str], at: str) -> DataFrame:
    """Running counts by labels, sampled at the end of each tick with rows: the window sees ticks, not rows."""
    counts = rows.groupBy(*labels, _cell(at).alias("cell")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*labels).orderBy("cell"))
    return counts.withColumn("total", total).select(*_sample(metric, {c: F.col(c) for c in labels}, F.col("cell") * STEP, F.col("total")))


def _waiting(rows: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each tick at which a row waits: from its start until before its end."""
    return rows.withColumn("first", _cell(start)).withColumn("last", _cell(end) - 1).where("first <= last").withColumn("tick", F.explode(F.sequence("first", "last")))


def _ticks(rows: DataFrame, at: str) -> DataFrame:
    return rows.agg(F.min(_cell(at)).alias("a"), F.max(_cell(at)).alias("b")).select(F.explode(F.sequence("a", "b")).alias("tick"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, labels, at_us, value) of the eight metrics that the rules read."""
    e = A.events(spark, sf_dir).withColumn("t", F.floor(F.col("at_us") / SPEED)).withColumn("ok", F.when(F.col("k") < 60, 0).otherwise(1))
    job = F.create_map(*(F.lit(x) for kv in JOBS.items() for x in kv))
    up = e.where(F.col("event_type").isin(*JOBS)).select(*_sample("up", {"job": F.element_at(job, F.col("event_type")), "instance": F.col("user_id") % 3}, F.col("t"), F.col("ok")))
    database = e.where("event_type = 'purchase'").select(*_sample("database_healthy", {}, F.col("t"), F.col("ok")))
    late = F.floor(F.col("k") * 1_000_000 / 45) + F.when(F.col("k") == 99, 20_000_000).otherwise(0)
    d = R.delivery_outcomes(A.deliveries(spark, sf_dir)).withColumn("t", F.floor(F.col("at_us") / SPEED)).withColumn("late", late).withColumn("done", F.col("t") + F.col("late")).withColumnRenamed("outcome", "result")
    d = kept(d.select("partition", "offset", "t", "late", "done", "result"), "outcomes")  # read six times
    results = _counter("deliveries_total", d, ["partition", "result"], "done")
    within = F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: F.when(b == "+Inf", True).otherwise(F.col("late") <= b.try_cast("double") * 1_000_000))
    handled = _counter("handling_seconds_bucket", d.withColumn("le", F.explode(within)), ["le"], "done")
    ends = d.groupBy("partition", _cell("t").alias("tick")).agg((F.max("offset") + 1).alias("end"))
    open_ = _waiting(d, "t", "done").groupBy("partition", "tick").agg(F.min("offset").alias("first_open"))
    grid = _ticks(d, "t").join(F.broadcast(d.select("partition").distinct()))  # as many rows as the topic has partitions
    seen = grid.join(ends, ["partition", "tick"], "left").join(open_, ["partition", "tick"], "left")
    log_end = F.max("end").over(W.partitionBy("partition").orderBy("tick"))
    lag = seen.withColumn("log_end", log_end).where("log_end IS NOT NULL").select(*_sample("consumer_lag", {"partition": F.col("partition")}, F.col("tick") * STEP, F.col("log_end") - F.coalesce("first_open", "log_end")))
    alerts = fraud_queries._evaluated(spark, sf_dir).where("decision <> 'APPROVE'").select("payment_id", F.floor(F.col("at_us") / SPEED).alias("t")).withColumn("sent", F.col("t") + F.col("payment_id") % 11 * 4_000_000)
    alerts = alerts.withColumn("result", F.when(F.col("payment_id") % 331 == 0, "kafka_error").when(F.col("payment_id") % 337 == 1, "failed").otherwise("published"))
    alerts = kept(alerts.select("t", "sent", "result"), "alerts")  # read four times, and each would judge all payments
    waits = _waiting(alerts, "t", "sent").groupBy("tick").agg(F.count("*").alias("n"), F.max(F.col("tick") * STEP - F.col("t")).alias("oldest"))
    outbox = kept(_ticks(alerts, "sent").join(waits, "tick", "left"), "outbox")  # a row a tick, read twice
    pending = outbox.select(*_sample("outbox_pending", {}, F.col("tick") * STEP, F.coalesce("n", F.lit(0))))
    oldest = outbox.select(*_sample("outbox_oldest_seconds", {}, F.col("tick") * STEP, F.coalesce("oldest", F.lit(0)) / 1_000_000))
    found = up
    for part in (database, results, handled, lag, pending, oldest, _counter("publications_total", alerts, ["result"], "sent")):
        found = found.unionByName(part)
    return found


SERIES = {
    "repeats": M.Expression(M.Selector("deliveries_total", like={"result": "duplicate|dlq"}), "rate", by=("result",)),
    "unprocessed": M.Expression(M.Selector("deliveries_total", unequal={"result": "processed"}, unlike={"partition": "[12]"}), "rate", over="max"),
    "instances": M.Expression(M.Selector("up"), over="count", by=("job",)),
    "up_share": M.Expression(M.Selector("up", unequal={"instance": "0"}), over="avg", by=("job",)),
}


def labelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by selectors of every kind, grouped by labels, and the number of jobs with instances (a count of counts)."""
    values = M.evaluated(samples(spark, sf_dir), SERIES, STEP)
    jobs = M.folded(values.where("name = 'instances'"), "count").withColumn("name", F.lit("jobs"))
    return values.unionByName(jobs).select("name", M.shown(F.col("group")).alias("labels"), (F.col("tick") * STEP).alias("tick_us"), F.round("value", 6).alias("value"))


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the eight alert rules."""
    spans = M.alert_spans(M.rule_states(samples(spark, sf_dir), M.RULES, STEP), M.RULES, STEP)
    return spans.withColumn("peak", F.round("peak", 6))


QUERIES = {f.__name__: f for f in (labelled_series, alert_rules)}

_LE = " UNION ALL ".join(f"SELECT '{b}' AS le, {'1e18' if b == '+Inf' else f'{b} * 1e6'} AS most" for b in BOUNDS)
_SAMPLES = f"""{fraud_queries._FEATURES},
d AS (
  SELECT part, off, at_us // {SPEED} AS t, CAST(k * 1000000 // 45 AS BIGINT) + CASE WHEN k = 99 THEN 20000000 ELSE 0 END AS late, CASE WHEN copy = 0 THEN 'processed' WHEN event_id % 100 = 0 THEN 'dlq' ELSE 'duplicate' END AS result
  FROM deliveries
),
al AS (
  SELECT f.payment_id AS id, p.at_us // {SPEED} AS t, p.at_us // {SPEED} + f.payment_id % 11 * 4000000 AS sent, CASE WHEN f.payment_id % 331 = 0 THEN 'kafka_error' WHEN f.payment_id % 337 = 1 THEN 'failed' ELSE 'published' END AS result
  FROM final f JOIN payments p USING (payment_id) WHERE decision <> 'APPROVE'
),
span AS (SELECT min(t) AS a, max(t) AS b FROM d),
dt AS (SELECT unnest(range(CAST(ceil(a / {STEP}.0) AS BIGINT), CAST(ceil(b / {STEP}.0) AS BIGINT) + 1)) AS tick FROM span),
at_ AS (SELECT unnest(range(CAST(ceil(min(sent) / {STEP}.0) AS BIGINT), CAST(ceil(max(sent) / {STEP}.0) AS BIGINT) + 1)) AS tick FROM al),
ends AS (SELECT part, tick, max(off) + 1 AS log_end, min(off) FILTER (t + late > tick * {STEP}) AS first_open FROM dt JOIN d ON d.t <= tick * {STEP} GROUP BY 1, 2),
box AS (SELECT tick, count(id) AS n, coalesce(max(tick * {STEP} - t), 0) / 1e6 AS oldest FROM at_ LEFT JOIN al ON t <= tick * {STEP} AND sent > tick * {STEP} GROUP BY 1),
les AS ({_LE}),
smp AS (
  SELECT 'up' AS metric, 'instance=' || (user_id % 3) || ',job=' || j.job AS series, j.job AS a, CAST(user_id % 3 AS VARCHAR) AS b, at_us // {SPEED} AS us, CASE WHEN k < 60 THEN 0.0::DOUBLE ELSE 1 END AS value
  FROM ev JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in JOBS.items())}) j(kind, job) ON kind = event_type
  UNION ALL SELECT 'database_healthy', '', '', '', at_us // {SPEED}, CASE WHEN k < 60 THEN 0 ELSE 1 END FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT 'deliveries_total', part || result, result, CAST(part AS VARCHAR), cell * {STEP}, sum(n) OVER (PARTITION BY part, result ORDER BY cell) FROM (SELECT part, result, CAST(ceil((t + late) / {STEP}.0) AS BIGINT) AS cell, count(*) AS n FROM d GROUP BY ALL)
  UNION ALL SELECT 'handling', le, le, '', cell * {STEP}, sum(n) OVER (PARTITION BY le ORDER BY cell) FROM (SELECT le, CAST(ceil((t + late) / {STEP}.0) AS BIGINT) AS cell, count(*) AS n FROM d JOIN les ON late <= most GROUP BY ALL)
  UNION ALL SELECT 'publications', result, result, '', cell * {STEP}, sum(n) OVER (PARTITION BY result ORDER BY cell) FROM (SELECT result, CAST(ceil(sent / {STEP}.0) AS BIGINT) AS cell, count(*) AS n FROM al GROUP BY ALL)
  UNION ALL SELECT 'lag', CAST(part AS VARCHAR), '', '', tick * {STEP}, log_end - coalesce(first_open, log_end) FROM ends
  UNION ALL SELECT 'pending', '', '', '', tick * {STEP}, n FROM box
  UNION ALL SELECT 'oldest', '', '', '', tick * {STEP}, oldest FROM box
),
ticks AS (SELECT unnest(range(CAST(ceil(min(us) / {STEP}.0) AS BIGINT), CAST(ceil(max(us) / {STEP}.0) AS BIGINT) + 1)) AS tick FROM smp),
g AS (
  SELECT metric, series, a, b, tick, arg_max(value, us * 2 + CAST(value > 0 AS INT)) AS value
  FROM smp JOIN ticks ON us > tick * {STEP} - 300000000 AND us <= tick * {STEP} WHERE metric IN ('up', 'database_healthy', 'lag', 'pending', 'oldest') GROUP BY ALL
),
inc AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY metric, series ORDER BY us), 0) AS grown FROM smp WHERE metric IN ('deliveries_total', 'handling', 'publications')),
r AS (SELECT metric, series, a, b, tick, sum(grown) AS grown FROM inc JOIN ticks ON us > tick * {STEP} - 300000000 AND us <= tick * {STEP} GROUP BY ALL),
buckets AS (SELECT tick, {', '.join(f"sum(grown) FILTER (a = '{b}') AS c{i}" for i, b in enumerate(BOUNDS))} FROM r WHERE metric = 'handling' GROUP BY 1),
p95 AS (
  SELECT tick, CASE {' '.join(f"WHEN c{i} >= 0.95 * c5 THEN {BOUNDS[i - 1] if i else 0} + ({b} - {BOUNDS[i - 1] if i else 0}) * (0.95 * c5 - {f'c{i - 1}' if i else 0}) / (c{i} - {f'c{i - 1}' if i else 0})" for i, b in enumerate(BOUNDS[:-1]))} ELSE 5 END AS value
  FROM buckets WHERE c5 > 0
)"""
_RULES = f"""{_SAMPLES},
cond AS (
  SELECT CASE a WHEN 'event-processor' THEN 'ProcessorDown' WHEN 'redis-exporter' THEN 'RedisUnavailable' ELSE 'DatabaseUnavailable' END AS rule, series AS labels, tick, value FROM g WHERE metric = 'up' AND value = 0
  UNION ALL SELECT 'DatabaseUnavailable', '', tick, value FROM g WHERE metric = 'database_healthy' AND value = 0
  UNION ALL SELECT 'HighConsumerLag', '', tick, sum(value) FROM g WHERE metric = 'lag' GROUP BY tick HAVING sum(value) > 100
  UNION ALL SELECT 'FraudOutboxBacklog', '', tick, CASE WHEN p.value > 20 THEN p.value ELSE o.value END FROM (SELECT * FROM g WHERE metric = 'pending') p JOIN (SELECT * FROM g WHERE metric = 'oldest') o USING (tick) WHERE p.value > 20 OR o.value > 120
  UNION ALL SELECT 'HighDLQRate', '', tick, sum(grown) / 300 FROM r WHERE metric = 'deliveries_total' AND a = 'dlq' GROUP BY tick HAVING sum(grown) / 300 > 0.1
  UNION ALL SELECT 'OutboxPublicationFailures', '', tick, sum(grown) / 300 FROM r WHERE metric = 'publications' AND a <> 'published' GROUP BY tick HAVING sum(grown) > 0
  UNION ALL SELECT 'HighProcessingLatency', '', tick, value FROM p95 WHERE value > 2
),
island AS (SELECT *, tick - row_number() OVER (PARTITION BY rule, labels ORDER BY tick) AS island FROM cond),
found AS (SELECT rule, labels, min(tick) AS a, max(tick) AS b, count(*) AS ticks, max(value) AS peak FROM island GROUP BY rule, labels, island),
told AS (SELECT *, rule IN ('HighConsumerLag', 'FraudOutboxBacklog', 'HighProcessingLatency') AS slow, rule IN ('ProcessorDown', 'DatabaseUnavailable', 'RedisUnavailable') AS grave FROM found)"""

ORACLE_SQL = {
    "labelled_series": f"""WITH {_SAMPLES.replace("FROM smp)", "FROM smp WHERE metric = 'up' OR metric = 'deliveries_total' AND a <> 'processed')", 1)}, v AS (
  SELECT 'repeats' AS name, 'result=' || a AS labels, tick, sum(grown) / 300 AS value FROM r WHERE metric = 'deliveries_total' AND a IN ('duplicate', 'dlq') GROUP BY ALL
  UNION ALL SELECT 'unprocessed', '', tick, max(grown) / 300 FROM r WHERE metric = 'deliveries_total' AND a <> 'processed' AND b = '0' GROUP BY ALL
  UNION ALL SELECT 'instances', 'job=' || a, tick, count(*) FROM g WHERE metric = 'up' GROUP BY ALL
  UNION ALL SELECT 'up_share', 'job=' || a, tick, avg(value) FROM g WHERE metric = 'up' AND b <> '0' GROUP BY ALL
  UNION ALL SELECT 'jobs', '', tick, count(DISTINCT a) FROM g WHERE metric = 'up' GROUP BY ALL)
 SELECT name, labels, tick * {STEP} AS tick_us, round(CAST(value AS DOUBLE), 6) AS value FROM v""",
    "alert_rules": f"""WITH {_RULES} SELECT rule, CASE WHEN grave THEN 'critical' ELSE 'warning' END AS severity, labels, a * {STEP} AS pending_us, CASE WHEN a + CASE WHEN slow THEN 12 ELSE 6 END <= b THEN (a + CASE WHEN slow THEN 12 ELSE 6 END) * {STEP} END AS firing_us,
 b * {STEP} AS last_us, ticks, round(CAST(peak AS DOUBLE), 6) AS peak FROM told""",
}
