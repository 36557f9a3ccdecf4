"""Outbox rows after a round of publication: identity check, results with retry times, health of what waits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts after which a row has failed, first wait and longest wait in microseconds, characters of a kept error.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, ERROR_CHARS = 10, 500_000, 30_000_000, 512


def checked_identity(rows: DataFrame) -> DataFrame:
    """rows(event_id string, payload json, ...) with sound: the payload's event_id is the row's; nulls and malformed payloads aren't."""
    return rows.withColumn("sound", F.coalesce(F.get_json_object("payload", "$.event_id") == F.col("event_id"), F.lit(False)))


def after_publication(rows: DataFrame, results: DataFrame) -> DataFrame:
    """rows(outbox_id, status, attempts, claimed_us, available_us, sound) after results(outbox_id, at_us, error), one a row.

    A claimed (PUBLISHING) row with a result and no error is PUBLISHED; with an error, or an unsound payload, it waits
    as PENDING for half a second, doubled by each attempt, 30 s at most, or has FAILED at ten attempts; either way its
    claim is cleared. Rows that aren't claimed or have no result stay as they are.
    """
    told = results.select("outbox_id", F.col("at_us").alias("__at"), F.col("error").alias("__error"), F.lit(True).alias("__told"))
    done = F.col("__told").isNotNull() & (F.col("status") == "PUBLISHING")
    error = F.when(~F.col("sound"), "payload of another event").otherwise(F.substring("__error", 1, ERROR_CHARS))
    waits = F.least(F.lit(LONGEST_WAIT), (FIRST_WAIT * F.pow(F.lit(2.0), F.least(F.col("attempts"), F.lit(ATTEMPTS)) - 1)).cast("long"))
    status = F.when(F.col("last_error").isNull(), "PUBLISHED").when(F.col("attempts") >= ATTEMPTS, "FAILED").otherwise("PENDING")
    judged = rows.join(told, "outbox_id", "left").withColumn("last_error", F.when(done, error)).withColumn("__done", done)
    return judged.select(
        *[c for c in rows.columns if c not in ("status", "claimed_us", "available_us")], "last_error",
        F.when(F.col("__done"), status).otherwise(F.col("status")).alias("status"), F.when(~F.col("__done"), F.col("claimed_us")).alias("claimed_us"),
        F.when(F.col("__done") & (status == "PENDING"), F.col("__at") + waits).otherwise(F.col("available_us")).alias("available_us"),
    )


def health(rows: DataFrame, now_us: DataFrame, stale_seconds: int) -> DataFrame:
    """One row: pending, publishing, failed, oldest_age (seconds of the oldest pending row, 0 if none) and healthy.

    rows(status, created_us, ...); now_us has one row and column. healthy: the age is at most stale_seconds.
    """
    counted = rows.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "PUBLISHING", "FAILED")], F.min(F.when(F.col("status") == "PENDING", F.col("created_us"))).alias("__oldest"))
    age = F.coalesce(F.floor((F.col("__now") - F.col("__oldest")) / 1_000_000), F.lit(0))
    return counted.join(F.broadcast(now_us.toDF("__now"))).select("pending", "publishing", "failed", age.alias("oldest_age"), (age <= stale_seconds).alias("healthy"))  # one row is joined
