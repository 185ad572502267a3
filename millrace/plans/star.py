"""Dimensions and facts of the order-line star schema, as functions of cleaned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions.text import first_rule, surrogate_key
from millrace.operators.gapfill import date_spine
from millrace.operators.quality import not_in

#: Label rules, first match wins.
CATEGORIES = (
    ("Keyboards", ("keyboard", "kb")), ("Monitors", ("monitor", "display", "screen")), ("Webcams", ("webcam", "camera", "cam")),
    ("Headsets", ("headset", "headphone", "earphone", "earbuds")), ("Cables", ("cable", "cord", "wire")), ("Adapters", ("adapter", "adaptor", "converter")),
    ("Storage", ("drive", "storage", "tb", "gb")), ("Input Devices", ("mouse", "trackpad")), ("Audio", ("speaker", "audio")), ("Connectivity", ("usb", "connector")),
)
SUBCATEGORIES = (
    ("Wireless", ("wireless",)), ("Wired", ("wired",)), ("USB-C", ("usb-c", "usb c")), ("HDMI", ("hdmi",)), ("4K/UHD", ("4k", "uhd")),
    ("Compact", ("compact", "mini")), ("External", ("external",)), ("Mechanical", ("mechanical", "mech")),
)
BRANDS = (
    ("ConnectPro", ("connectpro",)), ("ViewMaster", ("viewmaster",)), ("DataVault", ("datavault",)), ("TechCorp", ("techcorp",)), ("OfficeSupply Co", ("officesupply",)),
)
VENDOR_CATEGORIES = (
    ("Technology", ("tech", "solutions")), ("Office Supplies", ("office", "supply")), ("Electronics", ("electronics", "computer")), ("Connectivity", ("connect",)),
    ("Display Equipment", ("view", "display")), ("Data & Storage", ("data", "storage")),
)
VENDOR_TIERS = (("Preferred", ("au", "australia")),)
COUNTRIES = {"AU": ("Australia", "APAC"), "US": ("United States", "Americas")}
DEFAULT_RATE = 1.5
CV_CUTOFF, RANGE_CUTOFF = 0.20, 0.50


def _country(c: Column, place: int, default: str) -> Column:
    out = F
    for code, names in COUNTRIES.items():
        out = out.when(c == code, F.lit(names[place]))
    return out.otherwise(F.lit(default))


def with_audit(df: DataFrame, loaded_at: str, columns: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """When the table was built, in each of `columns`; an argument, so that a run can be repeated. Dimensions have created_at and
    updated_at, facts created_at."""
    return df.withColumns({c: F.lit(loaded_at).cast("timestamp") for c in columns})


def dim_date(rates: DataFrame, first: str, last: str, default_rate: float = DEFAULT_RATE) -> DataFrame:
    """rates: date, exchange_rate of the base pair."""
    days = date_spine(rates.sparkSession, first, last, "d").select(*[c.alias(n) for n, c in dates.attributes(F.col("d")).items()])
    return days.join(rates.select(F.col("date").alias("_d"), "exchange_rate"), F.col("date_actual") == F.col("_d"), "left").withColumn("usd_to_aud", F.coalesce("exchange_rate", F.lit(default_rate))).drop("_d", "exchange_rate")


def dim_cost_centre(centres: DataFrame) -> DataFrame:
    code = F.col("country_code")
    return centres.select(surrogate_key("cost_centre_id").alias("cost_centre_key"), "cost_centre_id", "cost_centre_name", "country_code", _country(code, 0, "Unknown").alias("country_name"), _country(code, 1, "Other").alias("region"), F.lit(True).alias("is_active"))


def dim_vendor(vendors: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    name = F.col("vendor_name")
    return vendors.select(surrogate_key("vendor_id").alias("vendor_key"), "vendor_id", "vendor_name", first_rule(name, VENDOR_CATEGORIES, "General").alias("vendor_category"), first_rule(name, VENDOR_TIERS, "Standard").alias("vendor_tier"), "country_code", *extra, F.lit(True).alias("is_active"))


def dim_product(seed: DataFrame, valid: DataFrame) -> DataFrame:
    """Seeded products, and those that valid lines hold besides."""
    seeded = seed.select("sku_id", "canonical_name", F.col("source").alias("source_type"), F.lit(True).alias("from_seed"))
    found = not_in(valid.select("sku_id", F.col("item_description_cleaned").alias("canonical_name")), seed, "sku_id").distinct()
    every = seeded.unionByName(found.select("sku_id", "canonical_name", F.lit("auto_discovered").alias("source_type"), F.lit(False).alias("from_seed")))
    name = F.col("canonical_name")
    return every.select(
        surrogate_key("sku_id").alias("product_key"), "sku_id", "canonical_name", "source_type", first_rule(name, CATEGORIES, "Other").alias("product_category"),
        first_rule(name, SUBCATEGORIES, "Standard").alias("product_subcategory"), first_rule(name, BRANDS, "Generic").alias("product_brand"), "from_seed", (F.col("source_type") == "approved_seed").alias("is_approved"), F.lit(True).alias("is_active"))


def _dated(df: DataFrame, dates_: DataFrame, column: str, **names: str) -> DataFrame:
    """Attaches columns of the date dimension by day; names: new column = its column. A calendar has a row a day."""
    d = dates_.select(F.col("date_actual").alias("_day"), *[F.col(c).alias(n) for n, c in names.items()])
    return df.join(F.broadcast(d), F.col(column) == F.col("_day"), "left").drop("_day")


def with_keys(df: DataFrame, dates_: DataFrame, centres: DataFrame, vendors: DataFrame, products: DataFrame, vendor: str = "matched_vendor_id") -> DataFrame:
    """Surrogate keys by left joins. Whether a dimension is broadcast is left to its measured size. Products come before vendors, since
    flagged lines lie by product."""
    df = _dated(df, dates_, "order_date", date_key="date_key", usd_to_aud="usd_to_aud")
    df = df.join(centres.select("cost_centre_id", "cost_centre_key"), "cost_centre_id", "left")
    df = df.join(products.select("sku_id", "product_key"), "sku_id", "left")
    return df.join(vendors.select(F.col("vendor_id").cast("string").alias("_v"), "vendor_key"), F.col(vendor).cast("string") == F.col("_v"), "left").drop("_v")


def fct_order_line(valid: DataFrame, dates_: DataFrame, centres: DataFrame, vendors: DataFrame, products: DataFrame) -> DataFrame:
    df = _dated(with_keys(valid, dates_, centres, vendors, products), dates_, "delivery_date", delivery_date_key="date_key")
    total, rate, cur = F.col("quantity") * F.col("unit_price"), F.col("usd_to_aud"), F.col("currency")
    return df.select(
        surrogate_key("order_id", "line_number").alias("order_line_key"), "date_key", "delivery_date_key", "cost_centre_key", "vendor_key", "product_key",
        F.when(cur == "USD", 1).when(cur == "AUD", 2).otherwise(0).alias("currency_key"), "quantity", "unit_price", total.alias("line_total_amount"),
        F.when(cur == "USD", total * rate).when(cur == "AUD", total).alias("line_total_aud"), F.when(cur == "USD", total).when(cur == "AUD", F.try_divide(total, rate)).alias("line_total_usd"),
        "order_id", "line_number", "requisitioner", "approval_status", "source_filename", "line_uid", cur.alias("original_currency"))


def fct_data_quality(exceptions: DataFrame, dates_: DataFrame, centres: DataFrame, vendors: DataFrame, products: DataFrame) -> DataFrame:
    """Exceptions with a known day and cost centre."""
    df = with_keys(exceptions, dates_, centres, vendors, products).where("date_key is not null and cost_centre_key is not null")
    return df.select(
        surrogate_key("order_id", "line_number", "exception_type").alias("data_quality_key"), "date_key", "cost_centre_key", "vendor_key", "product_key", F.lit(1).alias("exception_count"),
        F.coalesce("fuzz_score", F.lit(0.0)).alias("fuzz_score"), F.coalesce("vendor_fuzz_score", F.lit(0.0)).alias("vendor_fuzz_score"), "exception_type",
        "flag_missing_in_seed", "flag_name_mismatch", "flag_vendor_mismatch", "order_id", "line_number", "vendor_brand_original", "matched_vendor_name",
        "item_description_original", "item_description_cleaned", "line_uid")


def fct_price_variance(valid: DataFrame, dates_: DataFrame, centres: DataFrame, vendors: DataFrame, products: DataFrame, cv: float = CV_CUTOFF, spread: float = RANGE_CUTOFF) -> DataFrame:
    """Product, vendor, cost centre and day with significantly varying prices in USD. Lines are aggregated before any
    dimension is joined but the calendar, whose rate converts them."""
    lines = _dated(valid.where("matched_vendor_id is not null and unit_price > 0 and quantity > 0"), dates_, "order_date", rate="usd_to_aud")
    usd = F.when(F.col("currency") == "USD", F.col("unit_price")).when(F.col("currency") == "AUD", F.try_divide("unit_price", "rate"))
    keys = ["sku_id", "matched_vendor_id", "cost_centre_id", "order_date"]
    daily = lines.withColumn("usd", usd).where("usd is not null").groupBy(*keys).agg(
        F.avg("usd").alias("avg_unit_price"), F.min("usd").alias("min_unit_price"), F.max("usd").alias("max_unit_price"), F.count(F.lit(1)).alias("order_count"),
        F.sum("quantity").alias("total_quantity"), F.var_samp("usd").alias("price_variance"), F.stddev_samp("usd").alias("price_stddev"))
    lo, hi, mean, dev = F.col("min_unit_price"), F.col("max_unit_price"), F.col("avg_unit_price"), F.col("price_stddev")
    daily = daily.withColumns({
        "price_range_ratio": F.when((hi > 0) & (lo > 0), F.try_divide(hi - lo, lo)).otherwise(0.0),
        "coefficient_of_variation": F.when((mean > 0) & (dev > 0), F.try_divide(dev, mean)).otherwise(0.0),
        "has_significant_variance": F.coalesce(F.try_divide(dev, mean) > cv, F.lit(False)) | F.coalesce(F.try_divide(hi - lo, lo) > spread, F.lit(False)),
    }).where("has_significant_variance")
    df = with_keys(daily, dates_, centres, vendors, products).where("date_key is not null and product_key is not null and vendor_key is not null and cost_centre_key is not null")
    return df.select(surrogate_key("sku_id", "matched_vendor_id", "cost_centre_id", "order_date").alias("price_variance_key"), "date_key", "product_key", "vendor_key", "cost_centre_key", "avg_unit_price", "min_unit_price", "max_unit_price", "price_variance", "price_stddev", "order_count", "total_quantity", "price_range_ratio", "coefficient_of_variation", "has_significant_variance", F.col("order_date").alias("analysis_date"))
