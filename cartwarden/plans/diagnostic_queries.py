"""Repeats of measurements as JSON of unlike shape, summaries of samples, recovery of the lag, phases of transactions.

Repeats are made of the orders: one text for each priority and customer number mod 20, of which some lack a field, hold
words for numbers, or are cut off. Samples are the events; a stage's time is the value of events of one type and k mod 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..sources import adapters as A
from ..sources import artifacts
from . import monitor_queries

PATHS = {"total": "$.summary.total", "orders": "$.summary.orders", "urgent": "$.flags.urgent", "nowhere": "$.summary.total.deeper"}
STAGES = (*D.SINGLE.values(), *D.WRITES)


def artifact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 20).alias("r")).agg(F.sum(F.col("o_totalprice").cast(A.MONEY)).cast("string").alias("total"), F.count("*").alias("n"))
    quoted = F.when(F.col("r") == 4, F.concat(F.lit('"'), F.col("total"), F.lit('"'))).otherwise(F.col("total"))
    orders = F.when(F.col("r") == 3, F.lit("")).otherwise(F.concat(F.lit(',"orders":'), F.col("n").cast("string")))
    text = F.concat(F.lit('{"summary":{"total":'), quoted, orders, F.lit('},"flags":{"urgent":'), (F.col("n") % 2 == 0).cast("string"), F.when(F.col("r") == 9, F.lit("")).otherwise(F.lit("}}")))
    return o.select(F.concat(F.lit("runs/"), F.substring("o_orderpriority", 1, 1), F.lit("/load_run"), F.col("r").cast("string"), F.when(F.col("r") == 8, F.lit(".txt")).otherwise(F.lit(".json"))).alias("path"), text.alias("text"))


def artifact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by phase and state."""
    return artifacts.parsed(artifact_texts(spark, sf_dir)).groupBy(F.coalesce("phase", F.lit("")).alias("phase"), "state").agg(F.count("*").alias("n"))


def artifact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, least and most of each metric over the repeats that have it."""
    found = artifacts.repeat_statistics(artifacts.metrics(artifacts.parsed(artifact_texts(spark, sf_dir)), PATHS))
    return found.select("phase", "prefix", "metric", "n", *[F.round(c, 4).alias(c) for c in ("median", "lowest", "highest")])


def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's samples under load: gauges, sums and peaks of two maps of counts, growth a second."""
    e = A.events(spark, sf_dir).select(
        "event_type", "at_us", "event_id", (F.col("at_us") / 1_000_000).alias("t"), (F.col("k") % 5).alias("active"), (F.col("k") % 7).alias("waiting"), "k",
        F.create_map(F.concat(F.lit("a"), (F.col("k") % 3).cast("string")), F.col("k"), F.concat(F.lit("b"), (F.col("k") % 4).cast("string")), F.lit(1)).alias("waits"),
        F.when(F.col("k") % 2 == 0, F.create_map(F.concat(F.lit("mode"), (F.col("k") % 6).cast("string")), F.col("k") % 11)).alias("locks"),
    )
    s = D.series_summary(e, "event_type", ["at_us", "event_id"], "t", "active", ["active", "waiting"], totals=["waits"], peaks=["locks"], counters=["event_id", "k"])
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",")
    return s.withColumns({"waits_totals": flat("waits_totals"), "locks_peaks": flat("locks_peaks"), "active_avg": F.round("active_avg", 6), "waiting_avg": F.round("waiting_avg", 6), "per_second": F.round("per_second", 6)})


def lag_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the consumer's lag came back to its first value after its peak, by partition (times in seconds of the metrics)."""
    lag = monitor_queries.samples(spark, sf_dir).where("metric = 'consumer_lag'").select(F.element_at("labels", F.lit("partition")).alias("partition"), (F.col("at_us") / 1_000_000).alias("at"), "value")
    return D.recovery(lag, "partition", "at", "value").withColumn("drain_rate", F.round("drain_rate", 6))


def phase_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a transaction by day from the stages' averages; the total is eight times the mean of all."""
    e = A.events(spark, sf_dir).where("event_type = 'view'").select(F.floor(F.col("at_us") / 86_400_000_000).alias("day"), "k", "value")
    stage = F.get(F.array(*map(F.lit, STAGES)), F.col("k") % len(STAGES))
    averages = e.groupBy("day", stage.alias("stage")).agg(F.avg("value").alias("avg_ms"))
    total = e.groupBy("day").agg((8 * F.avg("value")).alias("avg_ms")).select("day", F.lit("transaction_total").alias("stage"), "avg_ms")
    found = D.phase_groups(averages.unionByName(total), "day")
    return found.select("day", *[F.round(c, 6).alias(c) for c in found.columns if c != "day"])


QUERIES = {f.__name__: f for f in (artifact_states, artifact_repeats, sample_summary, lag_recovery, phase_breakdown)}

_TEXTS = "o AS (SELECT substr(o_orderpriority, 1, 1) AS phase, o_custkey % 20 AS r, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n FROM orders GROUP BY ALL)"
_AVG = lambda *stages: " + ".join(f"coalesce(avg(value) FILTER (k % 7 = {STAGES.index(s)}), 0)" for s in stages)
_ONE = lambda s: f"avg(value) FILTER (k % 7 = {STAGES.index(s)})"
ORACLE_SQL = {
    "artifact_states": f"WITH {_TEXTS} SELECT CASE WHEN r = 8 THEN '' ELSE phase END AS phase, CASE r WHEN 8 THEN 'unnamed' WHEN 9 THEN 'malformed' ELSE 'ok' END AS state, count(*) AS n FROM o GROUP BY ALL",
    "artifact_repeats": f"""WITH {_TEXTS}, v AS (SELECT phase, 'total' AS metric, CAST(total AS DOUBLE) AS value FROM o WHERE r NOT IN (4, 8, 9) UNION ALL SELECT phase, 'orders', n FROM o WHERE r NOT IN (3, 8, 9) UNION ALL SELECT phase, 'urgent', CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END FROM o WHERE r NOT IN (8, 9))
 SELECT phase, 'load' AS prefix, metric, count(*) AS n, round(median(value), 4) AS median, round(min(value), 4) AS lowest, round(max(value), 4) AS highest FROM v GROUP BY ALL""",
    "sample_summary": f"""WITH {A.ORACLE}, s AS (SELECT * FROM ev WHERE k % 5 > 0), w AS (SELECT event_type, string_agg(name || '=' || n, ',' ORDER BY n DESC, name) AS waits_totals FROM (SELECT event_type, name, sum(n) AS n FROM (SELECT event_type, 'a' || (k % 3) AS name, k AS n FROM s UNION ALL SELECT event_type, 'b' || (k % 4), 1 FROM s) x GROUP BY ALL) y GROUP BY 1),
 l AS (SELECT event_type, string_agg(name || '=' || n, ',' ORDER BY n DESC, name) AS locks_peaks FROM (SELECT event_type, 'mode' || (k % 6) AS name, max(k % 11) AS n FROM s WHERE k % 2 = 0 GROUP BY ALL) y GROUP BY 1),
 ends AS (SELECT event_type, count(*) AS considered_count, round(avg(k % 5), 6) AS active_avg, max(k % 5) AS active_max, round(avg(k % 7), 6) AS waiting_avg, max(k % 7) AS waiting_max,
  arg_max(event_id + k, (at_us, event_id)) - arg_min(event_id + k, (at_us, event_id)) AS grown, (max(at_us) - min(at_us)) / 1e6 AS seconds FROM s GROUP BY 1)
 SELECT e.event_type, count(*) AS sample_count, considered_count, active_avg, active_max, waiting_avg, waiting_max, round(grown / seconds, 6) AS per_second, waits_totals, locks_peaks FROM ev e JOIN ends USING (event_type) JOIN w USING (event_type) JOIN l USING (event_type) GROUP BY ALL""",
    "lag_recovery": f"""WITH {monitor_queries._SAMPLES}, q AS (SELECT series AS partition, us / 1e6 AS t, value FROM smp WHERE metric = 'lag'),
 b AS (SELECT partition, arg_min(value, t) AS baseline, max(value) AS peak FROM q GROUP BY 1), tops AS (SELECT b.*, min(t) AS peak_at FROM b JOIN q ON q.partition = b.partition AND q.value = b.peak GROUP BY ALL),
 back AS (SELECT tops.*, min(t) FILTER (t > peak_at AND value <= baseline + 2) AS recovered_at FROM tops JOIN q USING (partition) GROUP BY ALL)
 SELECT *, round((peak - baseline) / (recovered_at - peak_at), 6) AS drain_rate FROM back""",
    "phase_breakdown": f"""WITH {A.ORACLE} SELECT at_us // 86400000000 AS day, {', '.join(f'round({_ONE(s)}, 6) AS {n}' for n, s in D.SINGLE.items())}, CASE WHEN count(*) FILTER (k % 7 IN ({', '.join(str(STAGES.index(x)) for x in D.WRITES)})) > 0 THEN round({_AVG(*D.WRITES)}, 6) END AS write_phase_ms, round(8 * avg(value), 6) AS transaction_total_ms,
 round(8 * avg(value) - ({_AVG(*STAGES)}), 6) AS unattributed_ms FROM ev WHERE event_type = 'view' GROUP BY 1""",
}
