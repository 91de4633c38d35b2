"""Queries of the corpus operators over the whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordograph.llm import learned_partitions, licences, line_chunks, mixing, ngram_join, packing, pii, quality, spotsigs, substrings
from ordograph.llm.common import table

#: Target shares of op7's sources: their shares of all tokens to this power, which lifts small sources.
OP7_EXPONENT = 0.7


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.private_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), exponent=OP7_EXPONENT)


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's join: the class and links of each document by the likeness of fingerprints."""
    return spotsigs.document_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (
        op1_learned_partitions, op2_ngram_join, op3_temperature_mixing, op4_licences, op5_private_data, op6_recompression,
        op7_mixture_packing, op8_line_chunks, op9_quality, op10_spotsigs, pipeline, spotsigs_classes,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_licences": licences.oracle(), "op6_recompression": substrings.ORACLE, "op8_line_chunks": line_chunks.ORACLE, "op10_spotsigs": spotsigs.ORACLE, "spotsigs_classes": spotsigs.CLASSES_ORACLE}
