"""From raw documents to packed sequences, in five stages; each works on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwarden.llm import decontaminate, line_chunks, packing, quality_fm, simhash
from cartwarden.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorisation machine scores at 0.7 or more (null and empty texts: as it scores them)."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated chunks of lines out of the texts; every document stays, n_chars follows the text."""
    cut = line_chunks.dedup_lines(docs)
    return cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.drop_near_dups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a passage of a benchmark item.

    Rows are told apart by a 64-bit hash of doc_id and text, so that a clean row stays where another text of its doc_id
    goes; rows that repeat throughout go together, and a null doc_id is an id like any other.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__row")).distinct()
    dirty = written(found, "contaminated")
    return docs.withColumn("__key", key).join(dirty, F.col("__key") == F.col("__row"), "left_anti").drop("__key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_dups), ("decontamination", benchmark), ("packing", pack)]

#: The classifier is fitted by gradient steps and texts are tokenised, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
