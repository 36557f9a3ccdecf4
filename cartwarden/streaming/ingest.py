"""Records as a stream: their sources, and windowed counts with a watermark. ``ledger.ingest`` takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
])

def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet files with raw records, as a stream."""
    return spark.readStream.schema(RECORD).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same columns from Kafka; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", True)
        .option("kafka.isolation.level", "read_committed").load().select(*[f.name for f in RECORD])
    )


def windowed_counts(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Records of each event type in tumbling windows; rows later than the watermark are left out."""
    kind = F.get_json_object(F.col("value").cast("string"), "$.event_type")
    return stream.withColumn("event_type", kind).withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "event_type").agg(F.count("*").alias("n"))
