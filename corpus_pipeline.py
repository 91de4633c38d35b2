"""From raw documents to packed sequences, in five stages; each but the last returns the columns of documents.

A document that the classifier rejects goes; repeated line chunks go from the texts left; of each class of near
duplicates one document stays; sources are mixed so that none is used more than MOST_REPEATS times as often as another
and each document is used at least once; what results is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordograph.llm import line_chunks, mixing, ngram_join, packing, quality
from ordograph.llm.common import table, written

MOST_REPEATS = 1.25


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier accepts; it is fitted on the texts of labelled documents."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; texts lose the chunks of lines that an earlier document has, n_chars follows."""
    kept = line_chunks.without_repeats(docs)
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once or more often; see mixing.mixed_order."""
    return mixing.mixed(docs, entropy_share=1.0, most_repeats=MOST_REPEATS, keep_all=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training a classifier, Jaccard clusters and a tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
