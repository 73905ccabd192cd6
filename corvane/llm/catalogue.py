"""Queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, doc_pairs, handwritten, leakage, pieces, truncation
from corvane.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.foreign_files(read_table(spark, folder, "code_chunk")).select("repo", "file_path").distinct()


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many files of each repository aren't hand-written, and why."""
    files = handwritten.foreign_files(read_table(spark, folder, "code_chunk"))
    return files.groupBy("repo", "reason").agg(F.count(F.lit(1)).alias("n_files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pairs(spark, folder).select("chunk_no", "method_name").distinct()


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return doc_pairs.function_doc_pairs(read_table(spark, folder, "code_chunk"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(read_table(spark, folder, "code_chunk"), read_table(spark, folder, "chunk_limit"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).select("chunk_no").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from their pieces, one row for each version of a chunk."""
    chunks = read_table(spark, folder, "code_chunk").select(F.struct("chunk_no", F.md5("source").alias("h")).alias("version"), "source", "chunk_type")
    named = chunks.withColumn("version", F.to_json("version"))
    made = pieces.rebuilt(pieces.split_oversized(named, read_table(spark, folder, "chunk_limit"), "version", keep_limit=True), key="version")
    return made.select(F.get_json_object("version", "$.chunk_no").cast("bigint").alias("chunk_no"), "n_chars", "text_hash", "fits")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(read_table(spark, folder, "documents"))


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_item"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_passages(spark, folder)).select("item_id", "doc_id")


def p7_removed(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.remove_leaks(read_table(spark, folder, "documents"), _passages(spark, folder))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each item leaked into."""
    return leakage.leaks(_passages(spark, folder)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest").alias("longest"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(read_table(spark, folder, "documents")).select("doc_id").distinct()


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_report(read_table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_rebuilt": p4_rebuilt,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_removed": p7_removed,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_report": p8_report,
}

_OVER = """
WITH one AS (SELECT lower(trim(chunk_type, ' ' || chr(9) || chr(10) || chr(13))) AS t, min(max_chars) AS most FROM chunk_limit GROUP BY 1)
SELECT DISTINCT {} FROM code_chunk c LEFT JOIN one ON one.t = lower(trim(c.chunk_type, ' ' || chr(9) || chr(10) || chr(13)))
WHERE length(source) > coalesce(most, (SELECT most FROM one WHERE t = '*'))"""

ORACLE = {
    "p4_found": _OVER.format("chunk_no"),
    "p4_rebuilt": _OVER.format("chunk_no, length(source) AS n_chars, md5(source) AS text_hash, true AS fits"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
