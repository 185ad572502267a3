"""Seven business questions over the star schema. Each takes the tables by name and a date that stands for today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.held import held
from millrace.operators.ranks import numbered

Tables = dict[str, DataFrame]


def _since(as_of: str, months: int) -> Column:
    return F.col("date_actual") >= F.add_months(F.lit(as_of).cast("date"), -months)


def _part(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(a, b), digits)


def _joined(t: Tables, fact: str, *dims: str, when: Column | None = None) -> DataFrame:
    """A fact with its dimensions by inner joins; rows without a key fall out. The filter on days prunes first. Where fact and calendar both
    carry the month that the facts are partitioned by (see `warehouse`), they meet on it, too, which prunes partitions."""
    keys = {"dim_date": "date_key", "dim_cost_centre": "cost_centre_key", "dim_vendor": "vendor_key", "dim_product": "product_key"}
    df = t[fact]
    for d in dims:
        dim = t[d]
        if d == "dim_date":
            dim = F.broadcast(dim.where(when) if when is not None else dim)  # a row a day
        month = d == "dim_date" and "month_key" in df.columns and "month_key" in dim.columns
        df = df.join(dim, [keys[d], "month_key"] if month else keys[d])
    return df


def spend(t: Tables, as_of: str, k: int = 20) -> DataFrame:
    """Largest spend of the last three months by cost centre, vendor, product category and quarter."""
    df = _joined(t, "fct_order_line", "dim_date", "dim_cost_centre", "dim_vendor", "dim_product", when=_since(as_of, 3))
    sums = df.groupBy("cost_centre_name", "vendor_name", "vendor_category", "product_category", "quarter", "year").agg(
        F.sum("line_total_aud").alias("total_spend_aud"), F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("order_line_count"))
    out = sums.withColumn("avg_cost_per_unit", _part(F.col("total_spend_aud"), F.col("total_quantity"))).withColumn("total_spend_aud", F.round("total_spend_aud", 2))
    order = [F.desc_nulls_last("total_spend_aud"), "cost_centre_name", "vendor_name", "product_category", "quarter", "year"]
    return out.orderBy(*order).limit(k).select("cost_centre_name", "vendor_name", "product_category", "total_spend_aud", "total_quantity", "order_line_count", "avg_cost_per_unit")


def data_quality(t: Tables, as_of: str) -> DataFrame:
    """Exceptions of the last six months by cost centre, type and month, against the cost centre's valid lines."""
    flags = {"missing_in_seed_count": "flag_missing_in_seed", "name_mismatch_count": "flag_name_mismatch", "vendor_mismatch_count": "flag_vendor_mismatch"}
    found = _joined(t, "fct_data_quality", "dim_date", "dim_cost_centre", when=_since(as_of, 6)).groupBy("cost_centre_name", "exception_type", "month_name", "year").agg(
        F.count(F.lit(1)).alias("exception_count"), F.round(F.avg("fuzz_score"), 2).alias("avg_fuzz_score"), *[F.count_if(F.col(c)).alias(n) for n, c in flags.items()])
    lines = _joined(t, "fct_order_line", "dim_cost_centre", "dim_date", when=_since(as_of, 6)).groupBy("cost_centre_name").agg(F.count(F.lit(1)).alias("total_order_lines"))
    out = found.join(lines, "cost_centre_name", "left")
    rate = _part(F.col("exception_count") * 100.0, F.col("total_order_lines"))
    return out.select("cost_centre_name", "exception_type", "exception_count", "avg_fuzz_score", *flags, rate.alias("exception_rate_percent")).orderBy(F.desc("exception_count"))


def price_variance(t: Tables, as_of: str, k: int = 25) -> DataFrame:
    """Products whose prices vary most: possible savings of the last twelve months."""
    df = _joined(t, "fct_price_variance", "dim_date", "dim_product", "dim_vendor", "dim_cost_centre", when=_since(as_of, 12)).where("order_count >= 2 and price_stddev > 0.5 * avg_unit_price")
    out = df.select(
        "sku_id", "canonical_name", "product_category", "vendor_name", "cost_centre_name", "month_name", "year", *[F.round(c, 4).alias(c) for c in ("avg_unit_price", "min_unit_price", "max_unit_price", "price_stddev")],
        "order_count", "total_quantity", F.round(F.try_divide(F.col("max_unit_price") - F.col("min_unit_price"), F.col("avg_unit_price")) * 100, 2).alias("price_volatility_percent"),
        F.round((F.col("avg_unit_price") - F.col("min_unit_price")) * F.col("total_quantity"), 2).alias("potential_savings_aud"))
    return out.orderBy(F.desc_nulls_last("potential_savings_aud"), F.desc_nulls_last("price_volatility_percent"), "sku_id", "vendor_name", "cost_centre_name").limit(k)


def regions(t: Tables, as_of: str) -> DataFrame:
    """Spend and order structure of the last twelve months by country, region and vendor category."""
    centres = t["dim_cost_centre"].withColumnRenamed("country_code", "cc_country")
    df = _joined(t, "fct_order_line", "dim_date", "dim_vendor", "dim_product", when=_since(as_of, 12)).join(centres, "cost_centre_key")
    fine = df.groupBy("cc_country", "region", "cost_centre_name", "quarter", "year", "vendor_category").agg(
        F.countDistinct("order_id").alias("orders"), F.count(F.lit(1)).alias("lines"), F.sum("line_total_aud").alias("aud"), F.avg("line_total_aud").alias("line_aud"),
        F.countDistinct("vendor_id").alias("vendors"), F.countDistinct("sku_id").alias("products"))
    return fine.groupBy(F.col("cc_country").alias("country_code"), "region", "vendor_category").agg(
        F.round(F.sum("aud"), 2).alias("region_total_spend_aud"), F.round(F.avg("line_aud"), 2).alias("avg_line_value_aud"), F.sum("orders").alias("total_orders"), F.sum("lines").alias("total_line_items"),
        _part(F.sum("aud"), F.sum("orders")).alias("avg_order_value"), _part(F.sum("lines"), F.sum("orders")).alias("avg_lines_per_order"),
        F.round(F.avg("vendors"), 4).alias("avg_vendors_per_cc"), F.round(F.avg("products"), 4).alias("avg_products_per_cc")).orderBy("country_code", F.desc("region_total_spend_aud"), "region", "vendor_category")


def seasons(t: Tables, as_of: str) -> DataFrame:
    """Monthly spend by category and brand against the category's mean: z-score and deviation in percent."""
    recent = F.col("year") >= F.year(F.lit(as_of).cast("date")) - 2
    monthly = _joined(t, "fct_order_line", "dim_date", "dim_product", when=recent).groupBy("month", "quarter", "product_category", "product_brand").agg(
        F.sum("line_total_aud").alias("monthly_spend_aud"), F.sum("quantity").alias("monthly_quantity"), F.countDistinct("order_id").alias("monthly_orders"))
    w = Window.partitionBy("product_category")  # a row per month, category and brand is left
    out = monthly.withColumns({"m": F.avg("monthly_spend_aud").over(w), "s": F.stddev_samp("monthly_spend_aud").over(w)})
    x = F.col("monthly_spend_aud")
    return out.select("month", "quarter", "product_category", "product_brand", F.round(x, 2).alias("monthly_spend_aud"), "monthly_quantity", "monthly_orders", _part(x - F.col("m"), F.col("s")).alias("spend_seasonality_zscore"), F.round((F.try_divide(x, F.col("m")) - 1) * 100, 2).alias("spend_variance_from_avg_percent")).orderBy("product_category", "month")


def vendors(t: Tables, as_of: str) -> DataFrame:
    """Vendor scorecard of the last twelve months. Ranks break ties by vendor_key; they are taken over one row a vendor, which are held."""
    df = _joined(t, "fct_order_line", "dim_date", "dim_vendor", "dim_product", when=_since(as_of, 12)).join(t["dim_cost_centre"].select("cost_centre_key", "cost_centre_id"), "cost_centre_key")
    perf = df.groupBy("vendor_key", "vendor_name", "vendor_category", "vendor_tier", F.col("country_code").alias("vendor_country")).agg(
        F.countDistinct("order_id").alias("total_orders"), F.round(F.sum("line_total_aud"), 2).alias("total_spend_aud"), F.avg("line_total_aud").alias("mean_line"),
        F.countDistinct("sku_id").alias("unique_products_supplied"), F.countDistinct("cost_centre_id").alias("cost_centres_served"))
    issues = _joined(t, "fct_data_quality", "dim_date", when=_since(as_of, 12)).groupBy("vendor_key").agg(F.count(F.lit(1)).alias("n"))
    scored = held(perf.join(issues, "vendor_key", "left").withColumn("data_quality_issues", F.coalesce("n", F.lit(0)).cast("long")).drop("n"))
    by = lambda *o: [*o, F.col("vendor_key")]
    ranked = numbered(scored, {
        "spend_rank": by(F.desc("total_spend_aud")), "volume_rank": by(F.desc("total_orders")), "diversity_rank": by(F.desc("unique_products_supplied")),
        "quality_rank": by(F.asc("data_quality_issues"), F.desc("total_spend_aud"))})
    whole = F.broadcast(scored.agg(F.sum("total_spend_aud").alias("whole")))  # one row
    ranked = ranked.crossJoin(whole).withColumn("spend_concentration_percent", F.round(F.try_divide("total_spend_aud", "whole") * 100, 2))
    c = F.col
    label = F.when((c("spend_rank") <= 2) & (c("quality_rank") <= 3), "Strategic Partner").when((c("spend_rank") <= 3) & (c("diversity_rank") <= 2), "Key Supplier")
    label = label.when((c("total_orders") >= 50) & (c("data_quality_issues") <= 5), "Reliable Supplier").when((c("spend_concentration_percent") < 1) & (c("total_orders") < 10), "Consolidation Candidate").otherwise("Standard Supplier")
    return ranked.select("vendor_name", "vendor_category", "vendor_tier", "vendor_country", "total_spend_aud", "total_orders", "unique_products_supplied", "cost_centres_served", "data_quality_issues", "spend_rank", "volume_rank", "diversity_rank", "quality_rank", "spend_concentration_percent", F.round("mean_line", 2).alias("avg_line_value_aud"), _part(c("total_spend_aud"), c("total_orders")).alias("avg_order_value_aud"), label.alias("vendor_classification")).orderBy("spend_rank")


def executive(t: Tables, as_of: str) -> DataFrame:
    """Key figures of the current month, the one before and the year, with exceptions of the current month. One scan of the facts:
    each line counts for the periods that its day is in."""
    today = F.lit(as_of).cast("date")
    month = F.trunc(today, "month")
    day = F.col("date_actual")
    periods = F.array_compact(F.array(
        F.when(F.trunc(day, "month") == month, "Current Month"), F.when((day >= F.add_months(month, -1)) & (day < month), "Previous Month"), F.when(F.year(day) == F.year(today), "Year to Date")))
    near = (day >= F.add_months(month, -1)) | (F.year(day) == F.year(today))
    df = _joined(t, "fct_order_line", "dim_date", "dim_vendor", "dim_product", when=near & (day < F.add_months(F.trunc(today, "year"), 12)))
    sums = df.withColumn("period_name", F.explode(periods)).groupBy("period_name").agg(
        F.sum("line_total_aud").alias("aud"), F.countDistinct("order_id").alias("total_orders"), F.count(F.lit(1)).alias("total_line_items"), F.countDistinct("vendor_id").alias("active_vendors"),
        F.countDistinct("sku_id").alias("unique_products"), F.avg("line_total_aud").alias("line"))
    names = df.sparkSession.createDataFrame([("Current Month",), ("Previous Month",), ("Year to Date",)], "period_name string")
    quality = _joined(t, "fct_data_quality", "dim_date", when=F.trunc(day, "month") == month).agg(F.count(F.lit(1)).alias("total_exceptions"), F.round(F.avg("fuzz_score"), 2).alias("avg_data_quality_score"))
    out = names.join(sums, "period_name", "left").na.fill(0, ["total_orders", "total_line_items", "active_vendors", "unique_products"]).crossJoin(F.broadcast(quality))  # one row
    before = F.lag("aud").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("period_name")))
    growth = F.when(F.col("period_name") == "Current Month", F.round(F.try_divide(F.col("aud") - before, before) * 100, 2))
    return out.select("period_name", F.round("aud", 2).alias("total_spend_aud"), "total_orders", "total_line_items", "active_vendors", "unique_products", F.round("line", 2).alias("avg_line_value"), "total_exceptions", "avg_data_quality_score", growth.alias("mom_spend_growth_percent")).orderBy("period_name")


QUESTIONS = {"spend": spend, "data_quality": data_quality, "price_variance": price_variance, "regions": regions, "seasons": seasons, "vendors": vendors, "executive": executive}
