"""Commerce frames as projections of the given tables. Money is decimal(18,2); time order is in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.records import numbered

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k (the number in props), at_us (microseconds), home (the customer's nation) and the record's place."""
    raw = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int")).withColumn("at_us", micros("ts"))
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("home"))
    return raw.join(home, "user_id", "left")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purchase events as completed and error events as failed payments."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.col("event_id").alias("payment_id"),
        F.col("user_id").alias("customer_id"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"),
        F.col("value").cast(MONEY).alias("amount"),
        (F.col("k") % 4).alias("device"),
        F.when(F.col("k") < 80, F.col("home")).otherwise(F.col("k") % 25).alias("country"),
        "home",
        F.when(F.col("event_type") == "error", F.concat(F.lit("reason-"), (F.col("k") % 3).cast("string"))).alias("failure_reason"),
        "at_us",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an event, a second one for every tenth, of other content for every hundredth.

    partition = user_id mod 3; offset counts within the partition by (at_us, event_id, copy), hour by hour, so that no
    task sorts a partition.
    """
    e = events(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = (F.col("copy") == 1) & (F.col("event_id") % 100 == 0)
    e = e.withColumn("amount", F.col("value").cast(MONEY)).withColumn("amount", F.when(changed, F.col("amount") + 1).otherwise(F.col("amount")).cast(MONEY))
    content = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("amount").cast("string"))
    placed = numbered(e.withColumn("partition", (F.col("user_id") % 3).cast("int")), "partition", ["at_us", "event_id", "copy"], F.floor(F.col("at_us") / 3_600_000_000), "offset")
    return placed.select("event_id", "user_id", "event_type", "copy", "partition", "offset", "at_us", "k", "amount", F.sha2(content, 256).alias("content_hash"))


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as refund requests of their order."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    place = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return l.select(
        F.col("l_orderkey").alias("order_id"), F.row_number().over(place).alias("seq"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_shipdate").alias("requested_at")
    )


#: The same frames for DuckDB, as common table expressions.
ORACLE = r"""
ev AS (
  SELECT e.*, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k, epoch_us(e.ts) AS at_us, c.c_nationkey AS home
  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
),
payments AS (
  SELECT event_id AS payment_id, user_id AS customer_id, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status,
    CAST(value AS DECIMAL(18,2)) AS amount, k % 4 AS device, CASE WHEN k < 80 THEN home ELSE k % 25 END AS country, home,
    CASE WHEN event_type = 'error' THEN 'reason-' || CAST(k % 3 AS VARCHAR) END AS failure_reason, at_us
  FROM ev WHERE event_type IN ('purchase', 'error')
),
copies AS (
  SELECT *, 0 AS copy FROM ev UNION ALL SELECT *, 1 AS copy FROM ev WHERE event_id % 10 = 0
),
deliveries AS (
  SELECT event_id, user_id, event_type, copy, CAST(user_id % 3 AS INT) AS part,
    row_number() OVER (PARTITION BY user_id % 3 ORDER BY at_us, event_id, copy) - 1 AS off, at_us, k,
    CAST(CASE WHEN copy = 1 AND event_id % 100 = 0 THEN CAST(value AS DECIMAL(18,2)) + 1 ELSE CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount
  FROM copies
),
refunds AS (
  SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate AS requested_at
  FROM lineitem WHERE l_returnflag = 'R'
)
"""
