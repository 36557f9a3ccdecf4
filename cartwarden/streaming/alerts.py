"""From payments to published alerts in one stream: history, score, message, outbox, confirmed publication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerting, fraud, outbox
from .keyed import customer_features


def messages(features: DataFrame, event_id: Column, correlation_id: Column, cfg: fraud.FraudConfig) -> DataFrame:
    """A stream of feature rows -> the messages of their alerts, each event_id once, whatever is delivered again."""
    scored = fraud.evaluate(features, fraud.payment_rules(cfg), cfg)
    rows = alerting.evaluation_rows(scored, event_id, F.timestamp_micros("at_us"))
    sent = alerting.alert_messages(rows, F.col("customer_id").cast("string"), F.lit(None).cast("string"), correlation_id)
    return sent.dropDuplicates(["event_id"])


def publish(arrivals: DataFrame, outbox_path: str, publisher: Callable[[DataFrame, str], None], checkpoint: str, event_id: Column, correlation_id: Column, cfg: fraud.FraudConfig = fraud.FraudConfig(), **history) -> StreamingQuery:
    """Runs what is available of ``arrivals`` (keyed.customer_features): outbox rows by batch, then their publication.

    ``publisher`` gets a batch's sound rows and a name that is the batch's own; it writes them so that the same name
    replaces what it wrote before (a folder, a transaction). The outbox rows are read back from what was written, so a
    batch that is run again sends the same messages under the same name: every alert once. Rows whose payload is another
    event's aren't sent and stay FAILED.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{outbox_path}/batch_id={batch_id}"
        rows = outbox.checked_identity(batch).withColumn("status", F.when(F.col("sound"), "PUBLISHED").otherwise("FAILED"))
        rows.write.mode("overwrite").parquet(path)
        publisher(spark.read.schema(rows.schema).parquet(path).where("sound").drop("sound", "status"), f"batch-{batch_id}")

    sent = messages(customer_features(arrivals, cfg, **history), event_id, correlation_id, cfg)
    return sent.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_folder(root: str) -> Callable[[DataFrame, str], None]:
    """A publisher that writes each batch's messages to a folder of its own."""
    return lambda rows, name: rows.write.mode("overwrite").parquet(f"{root}/{name}")
