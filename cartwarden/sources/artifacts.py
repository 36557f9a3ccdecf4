"""JSON files of unlike shape, one a repeat of a measurement, read as variants and addressed by path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order_statistics import percentiles

#: Where a repeat's file lies: phase/prefix_run3.json.
NAME = r"([^/]+)/([^/]+)_run(\d+)\.json$"
_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def scan(spark: SparkSession, files: str) -> DataFrame:
    """The files that a glob names, each whole, parsed (see ``parsed``)."""
    return parsed(spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def parsed(rows: DataFrame) -> DataFrame:
    """rows(path, text) -> (path, phase, prefix, repeat_no, body variant, state).

    state: ``ok``, ``malformed`` (no JSON: body is null, and the file is reported, not lost) or ``unnamed`` (its path is
    not a repeat's). An empty or null text is malformed.
    """
    part = lambda i: F.nullif(F.regexp_extract("path", NAME, i), F.lit(""))
    told = rows.select("path", part(1).alias("phase"), part(2).alias("prefix"), part(3).cast("long").alias("repeat_no"), F.try_parse_json("text").alias("body"))
    return told.withColumn("state", F.when(F.col("repeat_no").isNull(), "unnamed").when(F.col("body").isNull(), "malformed").otherwise("ok"))


def number_at(path: str) -> Column:
    """The number at a path of body, booleans as 1 and 0; null where there is none or something else, numerals in quotes too."""
    found = F.try_variant_get("body", path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind.rlike(_NUMBERS), F.try_variant_get("body", path, "double")).when(kind == "BOOLEAN", F.try_variant_get("body", path, "boolean").cast("double"))


def metrics(files: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """(phase, prefix, repeat_no, metric, value) of each named path that holds a number, in one pass over the files."""
    found = F.array(*[F.struct(F.lit(name).alias("metric"), number_at(path).alias("value")) for name, path in paths.items()])
    rows = files.where("state = 'ok'").select("phase", "prefix", "repeat_no", F.explode(found).alias("m"))
    return rows.select("phase", "prefix", "repeat_no", "m.metric", "m.value").where("value IS NOT NULL")


def repeat_statistics(values: DataFrame) -> DataFrame:
    """(phase, prefix, metric, n, median, lowest, highest) over the repeats; a metric that no repeat has gives no row."""
    keyed = values.select(F.struct("phase", "prefix", "metric").alias("key"), "value")
    return percentiles(keyed, {"median": 0.5, "lowest": 0.0, "highest": 1.0}).select("key.phase", "key.prefix", "key.metric", "n", "median", "lowest", "highest")
