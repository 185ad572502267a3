"""Data-quality flags of order lines and their routing into three disjoint tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME_CUTOFF = 0.8
FLAGS = ("flag_missing_in_seed", "flag_name_mismatch", "flag_vendor_mismatch")


def missing_in_seed(lines: DataFrame, seed: DataFrame, key: str = "sku_id", uid: str = "line_uid") -> DataFrame:
    """Ids of lines whose key is not in the seed; a null key never is."""
    return lines.join(seed.select(key).distinct(), key, "left_anti").select(uid).distinct()


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN on a non-null list: rows with a null key fall out too."""
    return df.where(F.col(key).isNotNull()).join(other.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def flag_lines(lines: DataFrame, seed: DataFrame, scores: DataFrame | None = None, name_cutoff: float = NAME_CUTOFF) -> DataFrame:
    """Lines with their flags. scores: line_uid, fuzz_score, matched_vendor_id, matched_vendor_name, vendor_fuzz_score and
    what else is to come along; None if the lines have these columns already. Known keys are marked on the seed
    side of one left join, so lines are joined once with either table."""
    known = seed.select("sku_id").distinct().withColumn("_known", F.lit(True))
    df = lines.join(known, "sku_id", "left")
    df = df if scores is None else df.join(scores, "line_uid", "left")
    no_vendor = F.col("matched_vendor_id").isNull() | (F.col("matched_vendor_id") == "")
    missing = F.col("_known").isNull()
    name = F.coalesce(F.col("fuzz_score") < name_cutoff, F.lit(False))
    issues = missing | name | (~_blank(F.col("vendor_brand")) & no_vendor)
    return df.withColumns({"flag_missing_in_seed": missing, "flag_name_mismatch": name, "flag_vendor_mismatch": no_vendor, "has_quality_issues": issues}).drop("_known")


def _set(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def is_nonproduct() -> Column:
    return _set("non_product_hint") & F.col("sku_id").isNull()


def route(flagged: DataFrame) -> dict[str, DataFrame]:
    """valid: no flag. nonproduct: hinted lines without a key. exceptions: flagged others, with their main reason.
    The three are disjoint, and together all lines unless an unflagged one is a hinted one without a key, which
    cannot be: a missing key is a flag."""
    any_flag = _set(FLAGS[0]) | _set(FLAGS[1]) | _set(FLAGS[2])
    reason = F.when(_set(FLAGS[0]), "SKU_NOT_IN_SEED").when(_set(FLAGS[1]), "NAME_MISMATCH").when(_set(FLAGS[2]), "VENDOR_MISMATCH").otherwise("OTHER")
    return {
        "valid": flagged.where(~any_flag),
        "nonproduct": flagged.where(is_nonproduct()).withColumn("line_type", F.lit("NON_PRODUCT")),
        "exceptions": flagged.where(any_flag & ~is_nonproduct()).withColumn("exception_type", reason),
    }
