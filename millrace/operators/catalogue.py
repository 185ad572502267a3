"""Versioned catalogues of products, and lines that name none of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import similarity

#: Days between versions.
STEP_DAYS = 30


def versions(items: DataFrame, key: str, order: Sequence[str], first_day: str, last_day: str, step_days: int = STEP_DAYS) -> DataFrame:
    """items with version (from 1 per key, in `order`), is_active (the latest only), created_date and updated_date.

    A version that was followed is superseded one step after the one before it; the latest of several was created a step
    for each version before it. A single version lasts from `first_day` to `last_day`."""
    w = Window.partitionBy(key)
    df = items.withColumns({"version": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w)})
    latest = F.col("version") == F.col("_n")
    day = lambda k: F.date_add(F.lit(first_day).cast("date"), k * step_days)
    created = F.when(latest, day(F.col("version") - 1)).otherwise(F.lit(first_day).cast("date"))
    return df.withColumns({"is_active": latest, "created_date": created, "updated_date": F.when(latest, F.lit(last_day).cast("date")).otherwise(day(F.col("version")))}).drop("_n")


def conflicts(items: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, fields (names of those that have several values) for keys whose items disagree; null is a value."""
    # least and greatest value tell as much as a count of distinct ones, which would take a copy of each row per field
    differ = lambda c: (F.min(c) != F.max(c)) | (F.count(c).between(1, F.count(F.lit(1)) - 1))
    several = [F.when(F.coalesce(differ(c), F.lit(False)), F.lit(c)) for c in fields]
    return items.groupBy(key).agg(F.array_compact(F.array(*several)).alias("fields")).where(F.size("fields") > 0)


def canonical_brands(items: DataFrame, column: str, brands: Sequence[str], abbreviations: dict[str, str], cutoff: float = 75.0) -> DataFrame:
    """items with `column` replaced: an abbreviation by its brand, else the brand most similar by ratio from `cutoff` on (the
    first of equals), else as it is. Only distinct names are scored; the brands are a short list."""
    short = F.create_map(*[F.lit(x) for p in abbreviations.items() for x in p]) if abbreviations else F.create_map().cast("map<string,string>")
    names = items.select(F.col(column).alias("_b")).distinct().where("_b is not null and _b <> ''")
    scored = names.select("_b", F.posexplode(F.array(*[F.lit(b) for b in brands])).alias("_i", "_c")).withColumn("_s", similarity("ratio", F.col("_b"), F.col("_c")))
    best = scored.groupBy("_b").agg(F.max(F.struct("_s", -F.col("_i"), "_c")).alias("_m"))
    found = best.select("_b", F.coalesce(short[F.col("_b")], F.when(F.col("_b").isin(*brands), F.col("_b")), F.when(F.col("_m._s") >= cutoff, F.col("_m._c")), F.col("_b")).alias("_to"))
    out = items.join(found, items[column] == found["_b"], "left").withColumn(column, F.coalesce("_to", F.lit("")))
    return out.select(*items.columns)


def orphans(lines: DataFrame, products: DataFrame, key: str = "sku_id") -> DataFrame:
    """Distinct keys of lines that no product has; null and empty keys are none."""
    named = lines.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
    return named.join(products.select(key), key, "left_anti")


def without_orphans(lines: DataFrame, products: DataFrame, key: str = "sku_id") -> DataFrame:
    """Lines that name a product or none; an empty key becomes null."""
    known = products.select(F.col(key).alias("_k")).distinct()
    cleaned = lines.withColumn(key, F.when(F.col(key) != "", F.col(key)))
    out = cleaned.join(known, cleaned[key] == known["_k"], "left")
    return out.where(F.col(key).isNull() | F.col("_k").isNotNull()).select(*lines.columns)
