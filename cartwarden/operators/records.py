"""Record handling: first-delivery dedup with content conflicts, commit frontier and batches, lateness, retry schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .contract import classify, dead_letters

__all__ = ["classify", "commit_batches", "commit_frontier", "dead_letters", "delivery_outcomes", "late_records", "numbered", "retry_schedule"]

#: Offsets that a bucket of a partition spans; windows see one bucket, the buckets' sums are added.
SPAN = 65_536


def numbered(rows: DataFrame, key: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """rows with name: 0, 1, ... within each key along ``order``, in two levels, so that a key isn't one task's work.

    bucket must not fall along the order. Rows are numbered within (key, bucket), and the sizes of the buckets before,
    a small table, are added. Ties in the order are numbered in any order.
    """
    dealt = rows.withColumn("__bucket", bucket)
    sizes = dealt.groupBy(key, "__bucket").agg(F.count("*").alias("__size"))
    before = W.partitionBy(key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(key, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    inside = dealt.withColumn("__place", F.row_number().over(W.partitionBy(key, "__bucket").orderBy(*order)) - 1)
    return inside.join(base, [key, "__bucket"]).withColumn(name, (F.col("__base") + F.col("__place")).cast("long")).drop("__bucket", "__place", "__base")


def delivery_outcomes(deliveries: DataFrame) -> DataFrame:
    """deliveries(event_id, partition, offset, content_hash, ...) with outcome, every row kept.

    A place is (partition, offset), with the topic before it where there is one. The first delivery of an event_id in
    order of places is processed; a later one of the same content is a
    duplicate, one of other content goes to the dead letters. Where two events have one place, only the
    least event_id may have it: the others' rows go to the dead letters, as do rows without an event_id. Of rows that
    repeat event_id and place one is the delivery, the others are duplicates or conflicts by their content. The first
    hash travels as an aggregate, so that an id delivered very often meets in no single task but for exact repeats.
    """
    place = [*(["topic"] if "topic" in deliveries.columns else []), "partition", "offset"]
    owner = deliveries.groupBy(*place).agg(F.min("event_id").alias("__owner"))
    held = deliveries.join(owner, place, "left")
    mine = F.col("event_id").isNotNull() & (F.col("__owner").isNull() | (F.col("event_id") == F.col("__owner")))
    first = held.where(mine).groupBy("event_id").agg(F.min(F.struct(*place, "content_hash")).alias("__first"))
    joined = held.withColumn("__mine", F.coalesce(mine, F.lit(False))).join(first, "event_id", "left")
    same = F.coalesce(F.col("content_hash") == F.col("__first.content_hash"), F.lit(False))
    at_place = F.row_number().over(W.partitionBy("event_id", *place).orderBy("content_hash"))
    at_first = F.struct(*place) == F.struct(*[F.col(f"__first.{c}") for c in place])
    outcome = F.when(~F.col("__mine"), "dlq").when(at_first & (F.col("__place") == 1), "processed").when(same, "duplicate").otherwise("dlq")
    return joined.withColumn("__place", at_place).withColumn("outcome", outcome).select(*deliveries.columns, "outcome")


def commit_frontier(terminal: DataFrame, span: int = SPAN) -> DataFrame:
    """terminal(partition, offset) -> (partition, next_offset, highest): the end of the first run without a gap.

    Each bucket of ``span`` offsets is looked at by itself, then the buckets' ends along the partition.
    """
    rows = terminal.select("partition", "offset").distinct().withColumn("bucket", F.floor(F.col("offset") / span))
    after = F.lead("offset").over(W.partitionBy("partition", "bucket").orderBy("offset"))
    buckets = (
        rows.withColumn("ends", F.when(after.isNull() | (after > F.col("offset") + 1), F.col("offset")))
        .groupBy("partition", "bucket").agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.min("ends").alias("ends"))
    )
    next_low = F.lead("low").over(W.partitionBy("partition").orderBy("bucket"))
    stops = (F.col("ends") < F.col("high")) | F.col("next_low").isNull() | (F.col("next_low") > F.col("high") + 1)
    return buckets.withColumn("next_low", next_low).groupBy("partition").agg(F.min(F.when(stops, F.col("ends") + 1)).alias("next_offset"), F.max("high").alias("highest"))


def commit_batches(terminal: DataFrame, size: int = 50, span: int = SPAN) -> DataFrame:
    """Flushes of ``size`` records in offset order: (partition, batch, records, first_offset, last_offset)."""
    placed = numbered(terminal.select("partition", "offset"), "partition", ["offset"], F.floor(F.col("offset") / span), "place")
    return placed.withColumn("batch", F.floor(F.col("place") / size)).groupBy("partition", "batch").agg(
        F.count("*").alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


def late_records(deliveries: DataFrame) -> DataFrame:
    """Deliveries whose event time lies below an earlier arrival's of the same customer, or that repeat an event_id."""
    before = F.max("at_us").over(W.partitionBy("user_id").orderBy("partition", "offset").rowsBetween(W.unboundedPreceding, -1))
    repeat = F.row_number().over(W.partitionBy("event_id").orderBy("partition", "offset")) > 1
    return deliveries.withColumn("late", F.coalesce(F.col("at_us") < before, F.lit(False))).withColumn("repeated", repeat)


def retry_schedule(failures: DataFrame, initial: float = 0.5, factor: float = 2.0, cap: float = 30.0) -> DataFrame:
    """failures(..., attempt) with delay_seconds: capped exponential backoff."""
    return failures.withColumn("delay_seconds", F.least(F.lit(cap), F.lit(initial) * F.pow(F.lit(factor), F.col("attempt") - 1)))
