"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import near_dedup, packing, quality_cnn, quality_rules, suffix_dedup
from millrace.llm.common import drop, held_out, shared_dir, table
from millrace.llm.queries import tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are extreme for their language and source, go."""
    return quality_rules.keep(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on labelled ones outside the evaluation fold, finds poor go."""
    return quality_cnn.keep(docs, quality_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out())))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dedup.keep(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice are cut out of the texts; every document stays."""
    return suffix_dedup.remove(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, place and sequence."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL: classifier, forest and packing have no plain SQL form. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared folder and read again. A stage's folder goes when the
    next one is written; the last one is what the result reads."""
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if last:
            drop(spark, last)
        last = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
