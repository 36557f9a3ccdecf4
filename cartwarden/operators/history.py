"""As-of lookups: history by arrival and event time, latest state of a keyed entity at a position, scoped deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def windowed_history(triggers: DataFrame, history: DataFrame, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """For each trigger the aggregates over history rows of its customer that had arrived (seq <= its own) and whose time
    lies in [at - seconds, at].

    triggers(trigger_id, customer_id, seq, at_us); history(customer_id, seq, at_us, ...), whose columns the aggregates
    name with the prefix ``h_``. Both sides meet by customer and time bucket of the window's width, a trigger in two
    buckets, so a pair of rows meets only if their times are within two widths.
    """
    width = seconds * 1_000_000
    bucket = F.floor(F.col("at_us") / width)
    own = triggers.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    past = history.select(*[F.col(c).alias(f"h_{c}") for c in history.columns]).withColumn("bucket", F.floor(F.col("h_at_us") / width))
    met = own.join(past, (own["customer_id"] == past["h_customer_id"]) & (own["bucket"] == past["bucket"])).where(
        (F.col("h_seq") <= F.col("seq")) & (F.col("h_at_us") <= F.col("at_us")) & (F.col("h_at_us") >= F.col("at_us") - width)
    )
    found = met.groupBy("trigger_id").agg(*[a.alias(n) for n, a in aggregates.items()])
    return triggers.join(found, "trigger_id", "left").fillna(0, list(aggregates))


def as_of_state(events: DataFrame, states: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """events with the last values of ``columns`` among the states of the same key at or before their order."""
    timeline = events.withColumn("__event", F.lit(True)).unionByName(states.select(key, order, *columns).withColumn("__event", F.lit(False)), allowMissingColumns=True)
    before = W.partitionBy(key).orderBy(order, F.col("__event").asc()).rowsBetween(W.unboundedPreceding, 0)
    state = F.last(F.when(~F.col("__event"), F.struct(*columns)), ignorenulls=True).over(before)
    return timeline.withColumn("__state", state).where("__event").select(*events.columns, *[F.col(f"__state.{c}").alias(c) for c in columns])


def without_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """rows but those whose key is in the scope; rows with a null key stay."""
    return rows.join(scope.select(key).distinct(), key, "left_anti")


def first_registration(rows: DataFrame, key: str, order: list[str], identity: list[str]) -> DataFrame:
    """rows with outcome: the first row of a key is registered, a later one is repeated if its identity agrees, else conflict.

    Of rows that are equal in order and identity one is registered, the others are repeated. Rows without a key are left
    out. Only the first row's fields are joined back, and only rows that tie with it are numbered.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *identity)).alias("__first"))
    joined = rows.join(first, key)
    own = F.struct(*order).eqNullSafe(F.struct(*[F.col(f"__first.{c}") for c in order]))
    agrees = F.struct(*identity).eqNullSafe(F.struct(*[F.col(f"__first.{c}") for c in identity]))
    place = F.row_number().over(W.partitionBy(key, *order, *identity).orderBy(F.lit(0)))
    judged = joined.withColumn("__place", place)
    return judged.withColumn("outcome", F.when(own & agrees & (F.col("__place") == 1), "registered").when(agrees, "repeated").otherwise("conflict")).drop("__first", "__place")
