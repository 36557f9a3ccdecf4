"""Intermediates that a driver loop reads again: Parquet in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame as a table in spark.checkpoint.dir: computed once, and still there when executors are lost.

    ``by`` names columns of few values: a reader of one value reads its folder only.
    Where a local session has no such folder one of this machine is taken; on a cluster that is an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
