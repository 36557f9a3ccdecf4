"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, html_text, line_chunks, packing, quality_fm, simhash, suffixes, token_files, url_rules, vector_graph, whitening
from .common import scratch, table


def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "token-files")
    token_files.write_token_files(docs, root, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = token_files.read_token_files(spark, root, token_files.document_keys(docs))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dup_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 of two turns whose texts look like the template's marks, read back from their segments."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    looks = spark.createDataFrame([(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], given.schema)
    return chat.digests(chat.format_conversations(given.unionByName(looks)))


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fitted vectors of embeddings on up to 32 components; vectors that are null or hold null or non-finite entries are left out."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned under both tokenizers; null and empty texts have zeros."""
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tag_paths, op2_packing, op3_vector_graph, op4_quality_fm, op5_seed_alignment, op6_sparse_suffixes, op7_token_files, op8_line_chunks, op9_url_rules, op10_simhash_bktree, op11_chat_segments, op12_jacobi_davidson, op13_pair_bitmaps, pipeline)
}

ORACLE_SQL: dict[str, str] = {"op8_line_chunks": line_chunks.ORACLE, "op11_chat_segments": chat.ORACLE}
