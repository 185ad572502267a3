"""Versioned reference tables: rows from approvals, version bumps, and upserts in which approvals outrank automatic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalized_names, semver

COLUMNS = ("sku_id", "canonical_name", "source", "effective_from", "version")
SOURCES = {"APPROVED": "approved_seed", "AUTO": "auto_ref"}


def next_version(seed: DataFrame) -> DataFrame:
    """One row: the highest version with its minor number raised; v0.1 for an empty table."""
    top = seed.agg(F.max(semver(F.col("version"))).alias("v"))
    return top.select(F.when(F.col("v").isNull(), "v0.1").otherwise(F.concat(F.lit("v"), F.col("v.major"), F.lit("."), F.col("v.minor") + 1)).alias("version"))


def rows_from_approvals(approved: DataFrame, effective_from: str, version: str) -> DataFrame:
    """Seed rows of the decisions APPROVED and AUTO. Raises if a needed column is missing, or a key or name is empty."""
    df = approved.toDF(*normalized_names(approved.columns))
    if lost := {"sku_id", "final_sku_name", "decision"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(lost)}")
    decision = F.upper(F.trim("decision"))
    source = F.when(decision == "APPROVED", SOURCES["APPROVED"]).when(decision == "AUTO", SOURCES["AUTO"])
    rows = df.select("sku_id", F.trim("final_sku_name").alias("canonical_name"), source.alias("source"), F.lit(effective_from).alias("effective_from"), F.lit(version).alias("version")).where("source is not null")
    bad = rows.where("sku_id is null or trim(sku_id) = '' or canonical_name is null or canonical_name = ''")
    if not bad.isEmpty():
        raise ValueError("approved rows need a sku_id and a name")
    return rows


def priority(source: Column) -> Column:
    return F.when(source == SOURCES["APPROVED"], 2).when(source == SOURCES["AUTO"], 1).otherwise(0)


def upsert(existing: DataFrame, new: DataFrame, key: str = "sku_id", rank: Column | None = None) -> DataFrame:
    """One row per key: the new row unless the existing one outranks it. One shuffle, with partial aggregation."""
    order = F.struct((priority(F.col("source")) if rank is None else rank).alias("p"), F.col("_new"))
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*existing.columns)


def merged(existing: DataFrame, approved: DataFrame, effective_from: str, version: str | None = None) -> DataFrame:
    """The seed with the rows of the approvals, under `version` or else the next one. Raises if the outcome is not sound."""
    version = version or next_version(existing).first()[0]
    out = upsert(existing.select(*COLUMNS), rows_from_approvals(approved, effective_from, version))
    if not check_seed(out).isEmpty():
        raise ValueError("the merged seed has repeated or empty keys, or empty names")
    return out


def check_seed(seed: DataFrame) -> DataFrame:
    """Keys that repeat or are empty, and names that are empty: none in a sound table."""
    n = seed.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("canonical_name").isNull() | (F.trim("canonical_name") == "")).alias("unnamed"))
    return n.where("n > 1 or unnamed > 0 or sku_id is null or trim(sku_id) = ''")
