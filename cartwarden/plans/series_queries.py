"""Time-series metrics over the events as facts. A rate is a count over its window's seconds; there is no extrapolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.order_statistics import percentiles
from ..sources import adapters as A


def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second of each type in 6-hour windows every hour."""
    e = A.table(spark, sf_dir, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.unix_seconds("w.start").alias("window_start"), "event_type", "n", F.round(F.col("n") / 21_600, 6).alias("rate")
    )


def hourly_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir)
    return e.groupBy(F.floor(F.col("at_us") / 3_600_000_000).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(A.MONEY)).cast("decimal(28,2)").alias("total"))


def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increase of a sampled counter (k) of each customer; a fall is a reset, after which the value is the increase."""
    before = F.lag("k").over(W.partitionBy("user_id").orderBy("at_us", "event_id"))
    grown = F.when(before.isNull(), 0).when(F.col("k") < before, F.col("k")).otherwise(F.col("k") - before)
    return A.events(spark, sf_dir).withColumn("grown", grown).groupBy("user_id").agg(F.sum("grown").alias("increase"), F.count("*").alias("samples"))


#: Upper bounds of the buckets of value.
BOUNDS = (10, 25, 50, 100, 250, 500)


def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50, p95 and p99 of value for each type from cumulative buckets, linear within the bucket that holds the rank."""
    e = A.table(spark, sf_dir, "events")
    counts = e.groupBy("event_type").agg(F.array(*[F.count_if(F.col("value") <= b) for b in BOUNDS]).alias("cumulative"), F.count("*").alias("n"))
    bounds = F.array(*[F.lit(float(b)) for b in BOUNDS])

    def level(q: float):
        rank = F.lit(q) * F.col("n")
        i = F.size(F.filter("cumulative", lambda c: c < rank))  # buckets below the rank
        low = F.when(i == 0, 0.0).otherwise(F.get(bounds, i - 1))
        below = F.when(i == 0, 0).otherwise(F.get("cumulative", i - 1))
        return F.when(i == len(BOUNDS), float(BOUNDS[-1])).otherwise(low + (F.get(bounds, i) - low) * (rank - below) / (F.get("cumulative", i) - below))

    return counts.select("event_type", *[F.round(level(q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > BOUNDS[-1], BOUNDS[-1] * 2).otherwise(F.least(*[F.when(F.col("value") <= b, b) for b in BOUNDS])).alias("le"))
    return e.groupBy("event_type", "le").agg(F.count("*").alias("n")).withColumn("cumulative", F.sum("n").over(W.partitionBy("event_type").orderBy("le")))


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir)
    return e.groupBy(F.floor(F.col("at_us") / 86_400_000_000).alias("day")).agg(
        F.round(F.count_if(F.col("event_type") == "error") / F.greatest(F.count_if(F.col("event_type").isin("error", "purchase")), F.lit(1)), 6).alias("ratio"), F.round(F.avg("k"), 6).alias("mean_k")
    )


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most active customers of each day."""
    daily = A.events(spark, sf_dir).groupBy(F.floor(F.col("at_us") / 86_400_000_000).alias("day"), "user_id").agg(F.count("*").alias("n"))
    return daily.withColumn("place", F.row_number().over(W.partitionBy("day").orderBy(F.desc("n"), "user_id"))).where("place <= 10")


def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir)
    last = e.groupBy("user_id", "event_type").agg(F.max_by("k", F.struct("at_us", "event_id")).alias("last_k"))
    return last.groupBy("event_type").agg(F.sum("last_k").alias("total"), F.max("last_k").alias("highest"), F.min("last_k").alias("lowest"), F.count("*").alias("series"))


def alert_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three hours or more with at least two errors in each hour."""
    hours = A.events(spark, sf_dir).where("event_type = 'error'").groupBy(F.floor(F.col("at_us") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n")).where("n >= 2")
    # one row an hour of the span: bounded by time, not by events
    runs = hours.withColumn("island", F.col("hour") - F.row_number().over(W.partitionBy(F.lit(0)).orderBy("hour")))
    return runs.groupBy("island").agg(F.min("hour").alias("start_hour"), F.max("hour").alias("end_hour"), F.sum("n").alias("errors")).where("end_hour - start_hour >= 2").drop("island")


def zero_filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each day of the span and each type, zero where there was nothing."""
    e = A.events(spark, sf_dir).withColumn("day", F.floor(F.col("at_us") / 86_400_000_000))
    counts = e.where("k < 30").groupBy("day", "event_type").agg(F.count("*").alias("n"))
    ticks = e.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.array_sort(F.collect_set("event_type")).alias("kinds")).select(F.explode(F.sequence("a", "b")).alias("day"), "kinds")
    return ticks.select("day", F.explode("kinds").alias("event_type")).join(counts, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of value for each type."""
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value")
    found = percentiles(rows, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select(F.col("key").alias("event_type"), "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at rank round(p (n - 1)), halves to even, of each type."""
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value")
    found = percentiles(rows, {"p50": 0.5, "p95": 0.95}, nearest=True)
    return found.select(F.col("key").alias("event_type"), *[F.round(c, 6).alias(c) for c in ("p50", "p95")])


def customer_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles of every customer's values and over all, intervals narrowed to 20 rows."""
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "value")
    found = percentiles(e.unionByName(e.withColumn("key", F.lit("all"))), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, few=20)
    return found.select(F.col("key").alias("customer"), "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def arrival_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir)
    gap = F.col("at_us") - F.lag("at_us").over(W.partitionBy("user_id").orderBy("at_us", "event_id"))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("longest"), F.min("gap").alias("shortest"), F.count("gap").alias("gaps"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / F.greatest((F.max("at_us") - F.min("at_us")) / 1e6, F.lit(0.001)), 9).alias("per_second"))


QUERIES = {
    f.__name__: f
    for f in (
        sliding_rate, hourly_increase, counter_delta, histogram_quantile, value_histogram, error_ratio, top_customers, gauge_last, alert_periods, zero_filled_days, latency_table, nearest_rank, customer_percentiles, arrival_gaps, throughput,
    )
}

_EV = f"WITH {A.ORACLE}"
_CUMULATIVE = ", ".join(f"count(*) FILTER (value <= {b}) AS c{i}" for i, b in enumerate(BOUNDS))


def _quantile_sql(q: float) -> str:
    cases, low, below = "", 0, "0"
    for i, b in enumerate(BOUNDS):
        cases += f" WHEN c{i} >= {q} * n THEN {low}.0 + ({b}.0 - {low}.0) * ({q} * n - {below}) / (c{i} - {below})"
        low, below = b, f"c{i}"
    return f"round(CAST(CASE{cases} ELSE {BOUNDS[-1]}.0 END AS DOUBLE), 6) AS p{round(q * 100)}"


ORACLE_SQL = {
    "sliding_rate": f"{_EV}, w AS (SELECT *, unnest(range(6)) AS back FROM ev) SELECT (at_us // 3600000000 - back) * 3600 AS window_start, event_type, count(*) AS n, round(count(*) / 21600.0, 6) AS rate FROM w GROUP BY 1, 2",
    "hourly_increase": f"{_EV} SELECT at_us // 3600000000 AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM ev GROUP BY 1, 2",
    "counter_delta": f"{_EV}, g AS (SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS b FROM ev) SELECT user_id, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN k < b THEN k ELSE k - b END) AS BIGINT) AS increase, count(*) AS samples FROM g GROUP BY 1",
    "histogram_quantile": f"SELECT event_type, {', '.join(map(_quantile_sql, (0.5, 0.95, 0.99)))} FROM (SELECT event_type, count(*) AS n, {_CUMULATIVE} FROM events GROUP BY 1) t",
    "value_histogram": f"WITH b AS (SELECT event_type, CAST(CASE {' '.join(f'WHEN value <= {b} THEN {b}' for b in BOUNDS)} ELSE {BOUNDS[-1] * 2} END AS INT) AS le, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY le) AS BIGINT) AS cumulative FROM b",
    "error_ratio": f"{_EV} SELECT at_us // 86400000000 AS day, round(count(*) FILTER (event_type = 'error') / CAST(greatest(count(*) FILTER (event_type IN ('error', 'purchase')), 1) AS DOUBLE), 6) AS ratio, round(avg(k), 6) AS mean_k FROM ev GROUP BY 1",
    "top_customers": f"{_EV}, d AS (SELECT at_us // 86400000000 AS day, user_id, count(*) AS n FROM ev GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS INT) AS place FROM d) x WHERE place <= 10",
    "gauge_last": f"{_EV}, l AS (SELECT event_type, k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY at_us DESC, event_id DESC) AS r FROM ev) SELECT event_type, CAST(sum(k) AS BIGINT) AS total, max(k) AS highest, min(k) AS lowest, count(*) AS series FROM l WHERE r = 1 GROUP BY 1",
    "alert_periods": f"{_EV}, h AS (SELECT at_us // 3600000000 AS hour, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, hour - row_number() OVER (ORDER BY hour) AS island FROM h) SELECT min(hour) AS start_hour, max(hour) AS end_hour, CAST(sum(n) AS BIGINT) AS errors FROM r GROUP BY island HAVING max(hour) - min(hour) >= 2",
    "zero_filled_days": f"{_EV}, s AS (SELECT min(at_us // 86400000000) AS a, max(at_us // 86400000000) AS b FROM ev), d AS (SELECT unnest(range(a, b + 1)) AS day FROM s), t AS (SELECT DISTINCT event_type FROM ev) SELECT d.day, t.event_type, count(e.event_id) AS n FROM d CROSS JOIN t LEFT JOIN ev e ON e.at_us // 86400000000 = d.day AND e.event_type = t.event_type AND e.k < 30 GROUP BY 1, 2",
    "latency_table": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "customer_percentiles": "WITH k AS (SELECT CAST(user_id AS VARCHAR) AS customer, value FROM events UNION ALL SELECT 'all', value FROM events) SELECT customer, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM k GROUP BY 1",
    "nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(max(value) FILTER (i = round_even(0.5 * (n - 1), 0)), 6) AS p50, round(max(value) FILTER (i = round_even(0.95 * (n - 1), 0)), 6) AS p95 FROM r GROUP BY 1",
    "arrival_gaps": f"{_EV}, g AS (SELECT user_id, at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS gap FROM ev) SELECT user_id, max(gap) AS longest, min(gap) AS shortest, count(gap) AS gaps FROM g GROUP BY 1",
    "throughput": f"{_EV} SELECT event_type, count(*) AS n, round(count(*) / greatest((max(at_us) - min(at_us)) / 1000000.0, 0.001), 9) AS per_second FROM ev GROUP BY 1",
}
