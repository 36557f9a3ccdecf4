"""Tables of one batch that become visible together: written under an attempt's name, then named by one manifest.

A reader sees the attempts that manifests name. Until a batch's manifest stands none of its tables has a row of it; a
batch that runs again writes a new attempt, and its manifest replaces the old one. Counts of rows are the manifest's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, attempt string, rows long, batch_id long"


def write_together(tables: dict[str, DataFrame], root: str, batch_id: int) -> None:
    """Writes all tables of a batch, then its manifest. Whatever fails before the manifest leaves nothing to be seen."""
    attempt, counts = uuid.uuid4().hex, []
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        path = f"{root}/{name}/batch_id={batch_id}/attempt={attempt}"
        rows.write.parquet(path)
        counts.append((name, attempt, spark.read.schema(rows.schema).parquet(path).count()))
    manifest = spark.createDataFrame(counts, MANIFEST.rpartition(",")[0])
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/batch_id={batch_id}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(table, attempt, rows, batch_id) of all batches that are there; no rows before the first."""
    try:
        found = spark.read.schema(MANIFEST).option("basePath", f"{root}/_manifest").parquet(f"{root}/_manifest/batch_id=*")
    except Exception as missing:  # Spark has no other way to ask whether a path is there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)
    return found


def read_together(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's rows of the batches whose manifests stand, with batch_id; only these attempts' files are read."""
    seen = manifest(spark, root).where(F.col("table") == name).select("batch_id", "attempt")
    try:
        rows = spark.read.schema(f"{schema}, batch_id long, attempt string").parquet(f"{root}/{name}")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], f"{schema}, batch_id long, attempt string")
    return rows.join(seen, ["batch_id", "attempt"], "left_semi").drop("attempt")


def rows_written(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, table, rows) as the manifests have them."""
    return manifest(spark, root).select("batch_id", "table", "rows")
