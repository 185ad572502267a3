"""The whole batch pipeline from raw files to star schema, as one DAG of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.similarity import similarity
from millrace.held import held
from millrace.functions.text import charge_hint, clean_text, joined, normalize_text
from millrace.operators.gapfill import daily_rates
from millrace.operators.matching import best_match
from millrace.operators.quality import flag_lines, route
from millrace.plans import star
from millrace.sources import readers, writers


@dataclass
class Inputs:
    """Where the raw files are: patterns for orders, single files or folders else."""

    orders: str
    vendors: str
    cost_centres: str
    rates: str
    seed: str


def bronze(spark: SparkSession, at: Inputs) -> dict[str, DataFrame]:
    return {
        "raw_orders": readers.json_arrays(spark, at.orders, schemas.ORDERS),
        "raw_vendor_master": readers.csv(spark, at.vendors, schemas.VENDORS),
        "raw_cost_centres": readers.csv(spark, at.cost_centres, schemas.COST_CENTRES),
        "raw_exchange_rates": readers.csv(spark, at.rates, schemas.RATES),
    }


def stage_orders(raw: DataFrame) -> DataFrame:
    """Cleaned, typed order lines; values that do not parse become null."""
    return raw.select(
        "order_id", "line_number", "sku_id", F.col("item_description").alias("item_description_original"), clean_text(F.col("item_description")).alias("item_description_cleaned"),
        F.col("quantity").try_cast("double").alias("quantity"), F.col("unit_price").try_cast("double").alias("unit_price"), "currency", F.col("brand").alias("vendor_brand"), "cost_centre_id", "country_code",
        "requisitioner", "approval_status", "delivery_date", F.col("order_date").try_cast("date").alias("order_date"), F.col("order_timestamp").try_cast("timestamp_ntz").alias("created_timestamp"),
        F.col("filename").alias("source_filename"), charge_hint(F.col("item_description")).alias("non_product_hint"), F.xxhash64(joined("order_id", "line_number", "sku_id", "filename")).alias("line_uid"))


def fuzzy_scores(lines: DataFrame, seed: DataFrame, vendors: DataFrame) -> DataFrame:
    """Scores of seeded lines. Only distinct (description, name) and brand values are scored; lines get them by joins."""
    seeded = lines.select("line_uid", "sku_id", F.col("item_description_cleaned").alias("order_description"), F.col("vendor_brand").alias("vendor_brand_original")).join(seed.select("sku_id", F.col("canonical_name").alias("seed_name")), "sku_id")
    pairs = seeded.select("order_description", "seed_name").distinct()
    pairs = pairs.withColumn("fuzz_score", similarity("partial_token_ratio", normalize_text(F.col("order_description")), normalize_text(F.col("seed_name"))) / 100)
    p = pairs.select(F.col("order_description").alias("_d"), F.col("seed_name").alias("_s"), "fuzz_score")
    scored = seeded.join(p, seeded["order_description"].eqNullSafe(p["_d"]) & seeded["seed_name"].eqNullSafe(p["_s"])).drop("_d", "_s")
    matches = best_match(seeded, "vendor_brand_original", vendors, "vendor_id", "vendor_name").withColumnRenamed("vendor_brand_original", "_b")
    return scored.join(matches, scored["vendor_brand_original"].eqNullSafe(matches["_b"]), "left").drop("_b", "sku_id").dropDuplicates(["line_uid"])


def build(spark: SparkSession, at: Inputs, first_day: str, last_day: str) -> dict[str, dict[str, DataFrame]]:
    """Every table of every layer, lazily but for the scores, which are computed once. Dates bound the calendar."""
    raw = bronze(spark, at)
    seed = readers.seed(spark, at.seed)
    orders = stage_orders(raw["raw_orders"])
    scores = held(fuzzy_scores(orders, seed, raw["raw_vendor_master"]))  # every routed table reads them
    rates = daily_rates(raw["raw_exchange_rates"])
    flagged = flag_lines(orders, seed, scores.withColumnsRenamed({"order_description": "compared_order_desc", "seed_name": "compared_seed_name"}))
    routed = route(flagged)
    dims = {
        "dim_date": star.dim_date(rates, first_day, last_day),
        "dim_cost_centre": star.dim_cost_centre(raw["raw_cost_centres"]),
        "dim_vendor": star.dim_vendor(raw["raw_vendor_master"], ("payment_terms", "tax_id", "city", "vendor_type", "preferred_currency", "credit_limit", "street_address", "postal_code", "contact_email", "contact_phone")),
        "dim_product": star.dim_product(seed, routed["valid"]),
    }
    facts = {
        "fct_order_line": star.fct_order_line(routed["valid"], *dims.values()),
        "fct_data_quality": star.fct_data_quality(routed["exceptions"], *dims.values()),
        "fct_price_variance": star.fct_price_variance(routed["valid"], *dims.values()),
    }
    return {
        "bronze": raw,
        "seeds": {"ref_sku_names": seed},
        "staging": {"stg_orders": orders, "stg_orders_fuzz_scores": scores, "stg_orders_with_flags": flagged, "stg_exchange_rates": rates},
        "silver": {"silver_cost_centres": raw["raw_cost_centres"], "silver_vendor_master": raw["raw_vendor_master"], "silver_exchange_rates": rates, **{f"silver_orders_{k}": v for k, v in routed.items()}},
        "gold": dims | facts,
    }


def run(spark: SparkSession, at: Inputs, first_day: str, last_day: str, prefix: str = "dev", exports: str | None = None, loaded_at: str | None = None) -> dict[str, dict[str, DataFrame]]:
    """Materializes all layers as tables, staging as views, and exports CSV if a folder is given: layers, and the staged orders.
    With `loaded_at`, dimensions (but the calendar) and facts carry it as audit columns."""
    writers.create_schemas(spark, prefix)
    layers = build(spark, at, first_day, last_day)
    if loaded_at:
        gold = layers["gold"]
        for name in gold:
            if name != "dim_date":
                gold[name] = star.with_audit(gold[name], loaded_at, ("created_at", "updated_at") if name.startswith("dim_") else ("created_at",))
    for layer, tables in layers.items():
        for name, df in tables.items():
            tables[name] = writers.view(df, name) if layer == "staging" else writers.materialize(df, layer, name, prefix)
        if exports and layer in ("bronze", "silver", "gold"):
            writers.export_layer(tables, layer, exports)
        if exports and layer == "staging":
            writers.export_staged(tables["stg_orders"], exports)
    return layers
