"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, mixing, near_dedup, packing, phrases, quality_cnn, quality_rules, sharding, suffix_dedup, warc, whitening
from .common import held_out, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from the rows outside the evaluation fold, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    fold = held_out().alias("held_out")
    out = langid.predict(docs, model)
    return out.select("doc_id", fold, "lang_pred", "score", "rejected")


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality_cnn.classify(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(spark, sf_dir)


def op6_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_extendible_sharding, op3_best_fit_packing, op4_quality_classifier, op5_warc_revisits,
    op6_shifted_curves, op7_suffix_dedup, op8_quality_rules, op9_minhash_forest, op10_bpe_codec,
    op11_phrase_collocations, op12_exact_whitening, op13_budget_mixing,
)
}
ORACLE_SQL: dict[str, str] = {"op2_extendible_sharding": sharding.oracle_sql(), "op5_warc_revisits": warc.oracle_sql(), "op11_phrase_collocations": phrases.oracle_sql(), "op13_budget_mixing": mixing.oracle_sql()}
