"""Procurement tables made out of the TPC-H-like ones, so that every plan runs at any scale; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import charge_hint, clean_text
from millrace.operators.gapfill import daily_rates
from millrace.operators.quality import flag_lines, route
from millrace.plans import star

AS_OF, FIRST_DAY, LAST_DAY = "2001-07-15", "1995-01-01", "2001-12-31"
VENDOR_WORDS = ("Tech Solutions", "Office Supply", "Computer Electronics", "Connect", "View Display", "Data Storage", "Trading Australia")
PRODUCT_WORDS = ("keyboard", "monitor 4k", "webcam", "headset wireless", "cable usb-c", "adapter", "drive 1tb", "mouse", "speaker", "connector", "ring", "hdmi mini")


class Frames(dict):
    """The tables below a folder, each looked up when it is first asked for: a plan with several uses of a table reads its files' list and
    schema once. Made anew for each plan, so that a table that has changed since is seen."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


class Share(Frames):
    """The tables below a folder, with the orders of one share of `shares` and their lines: an order is in one share by its key."""

    def __init__(self, spark: SparkSession, sf_dir: str, share: int, shares: int):
        super().__init__(spark, sf_dir)
        self.share, self.shares = share, shares

    def __missing__(self, name: str) -> DataFrame:
        df, key = super().__missing__(name), {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        if key:
            df = self[name] = df.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.shares)) == self.share)
        return df


Place = str | Frames


def frames(spark: SparkSession, d: Place) -> Frames:
    return d if isinstance(d, Frames) else Frames(spark, d)


def table(spark: SparkSession, d: Place, name: str) -> DataFrame:
    return frames(spark, d)[name]


def _pick(words: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))


def vendors(spark: SparkSession, d: Place) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    name = F.concat("s_name", F.lit(" "), _pick(VENDOR_WORDS, k))
    code = F.when(F.col("s_nationkey") % 3 == 0, "AU").when(F.col("s_nationkey") % 3 == 1, "US").otherwise("XX")
    return s.select(k.cast("string").alias("vendor_id"), name.alias("vendor_name"), code.alias("country_code"), F.col("s_acctbal").alias("credit_limit"))


def cost_centres(spark: SparkSession, d: Place) -> DataFrame:
    n = F.col("n_nationkey")
    code = F.when(n % 3 == 0, "AU").when(n % 3 == 1, "US").otherwise("XX")
    return table(spark, d, "nation").select(F.concat(F.lit("CC_"), n).alias("cost_centre_id"), F.col("n_name").alias("cost_centre_name"), code.alias("country_code"))


def products(spark: SparkSession, d: Place) -> DataFrame:
    """Products with their texts cleaned and scored: once per product, not once per line."""
    k = F.col("p_partkey")
    df = table(spark, d, "part").select(k, F.concat("p_name", F.lit(" "), _pick(PRODUCT_WORDS, k)).alias("product_name"), "p_type")
    text = F.concat("product_name", F.when(k % 80 == 0, " Delivery Fee").otherwise(""))
    df = df.select("*", text.alias("item_description_original"), clean_text(text).alias("item_description_cleaned"), charge_hint(text).alias("non_product_hint"), F.lower(F.when(k % 17 == 0, F.col("p_type")).otherwise(F.col("product_name"))).alias("known"))
    clean, known = F.col("item_description_cleaned"), F.col("known")
    return df.withColumn("similarity", F.round(1 - F.levenshtein(clean, known) / F.greatest(F.length(clean), F.length(known)), 6))


def seed(spark: SparkSession, d: Place) -> DataFrame:
    """Nine in ten products; some with a name that does not match."""
    k = F.col("p_partkey")
    return products(spark, d).where(k % 10 != 0).select(
        k.cast("string").alias("sku_id"), F.col("known").alias("canonical_name"),
        F.when(k % 3 == 0, "auto_ref").otherwise("approved_seed").alias("source"), F.lit("2025-01-01").alias("effective_from"), F.lit("v0.1").alias("version"))


def raw_rates(spark: SparkSession, d: Place) -> DataFrame:
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    step = F.col("n") % 50
    direct = days.where(F.dayofyear("date") % 3 == 0).select("date", F.lit("USD").alias("from_currency"), F.lit("AUD").alias("to_currency"), (1.25 + step / 64.0).alias("exchange_rate"))
    inverse = days.where(F.dayofyear("date") % 5 == 0).select("date", F.lit("AUD").alias("from_currency"), F.lit("USD").alias("to_currency"), (0.5 + step / 128.0).alias("exchange_rate"))
    return direct.unionByName(inverse)


def order_lines(spark: SparkSession, d: Place) -> DataFrame:
    """Cleaned lines with scores. Fact tables meet on their keys; a line's day, product and vendor come along. Customers meet orders,
    which are fewer than lines, and products come last, so that lines do not carry their texts through other exchanges."""
    d = frames(spark, d)
    line, part, s = table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), s == F.col("s_suppkey")).join(products(spark, d), part == F.col("p_partkey"))
    sku = F.when(part % 40 != 0, part.cast("string"))
    brand = F.when(s % 33 != 0, F.col("s_name"))
    seeded = (part % 10 != 0) & sku.isNotNull()
    score = F.when(seeded, F.col("similarity"))
    matched = seeded & brand.isNotNull() & (F.col("s_acctbal") > 0)
    return df.select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_number"), sku.alias("sku_id"), "item_description_original", "item_description_cleaned",
        F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"), F.when(F.col("c_nationkey") % 2 == 0, "AUD").otherwise("USD").alias("currency"), brand.alias("vendor_brand"),
        F.concat(F.lit("CC_"), "c_nationkey").alias("cost_centre_id"), F.concat(F.lit("user"), "o_custkey").alias("requisitioner"), F.col("o_orderstatus").alias("approval_status"),
        F.col("l_shipdate").cast("date").alias("delivery_date"), F.col("o_orderdate").cast("date").alias("order_date"), F.concat(F.lit("orders_"), "c_nationkey", F.lit(".json")).alias("source_filename"),
        "non_product_hint", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_nationkey").alias("line_uid"), score.alias("fuzz_score"), brand.alias("vendor_brand_original"),
        F.when(matched, s.cast("string")).alias("matched_vendor_id"), F.when(matched, F.col("s_name")).alias("matched_vendor_name"), F.when(seeded, F.when(matched, 1.0).otherwise(0.0)).alias("vendor_fuzz_score"))


def flagged(spark: SparkSession, d: Place) -> DataFrame:
    d = frames(spark, d)
    return flag_lines(order_lines(spark, d), seed(spark, d))


def rates(spark: SparkSession, d: Place) -> DataFrame:
    return daily_rates(raw_rates(spark, d))


def variance_lines(valid: DataFrame) -> DataFrame:
    """Valid lines at a grain coarse enough for prices to repeat: few products, vendors and cost centres, by month."""
    return valid.withColumns({
        "sku_id": (F.col("sku_id").cast("long") % 30 + 1).cast("string"), "matched_vendor_id": (F.col("matched_vendor_id").cast("long") % 3 + 1).cast("string"),
        "cost_centre_id": F.concat(F.lit("CC_"), F.substring_index("cost_centre_id", "_", -1).cast("int") % 5), "order_date": F.trunc("order_date", "month")})


class Tables(dict):
    """Dimensions, routed lines and facts by name, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, d: Place):
        super().__init__()
        self.spark, self.d = spark, frames(spark, d)

    def __missing__(self, name: str) -> DataFrame:
        spark, d = self.spark, self.d
        dims = lambda: (self["dim_date"], self["dim_cost_centre"], self["dim_vendor"], self["dim_product"])
        if name in ("valid", "nonproduct", "exceptions"):
            self.update(route(flagged(spark, d)))
            return self[name]
        make = {
            "dim_date": lambda: star.dim_date(rates(spark, d), FIRST_DAY, LAST_DAY),
            "dim_cost_centre": lambda: star.dim_cost_centre(cost_centres(spark, d)),
            "dim_vendor": lambda: star.dim_vendor(vendors(spark, d)),
            "dim_product": lambda: star.dim_product(seed(spark, d), self["valid"]),
            "fct_order_line": lambda: star.fct_order_line(self["valid"], *dims()),
            "fct_data_quality": lambda: star.fct_data_quality(self["exceptions"], *dims()),
            "fct_price_variance": lambda: star.fct_price_variance(variance_lines(self["valid"]), *dims()),
        }
        self[name] = make[name]()
        return self[name]


def tables(spark: SparkSession, d: Place) -> Tables:
    return Tables(spark, d)


def _case(col: str, rules: tuple, default: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f"lower({col}) LIKE '%{w}%'" for w in words)} THEN '{label}'" for label, words in rules)
    return f"CASE {arms} ELSE '{default}' END"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def base_sql() -> dict[str, str]:
    """Common table expressions by name, each on those before it."""
    from millrace.functions.text import CHARGE_WORDS

    code = "CASE {0} % 3 WHEN 0 THEN 'AU' WHEN 1 THEN 'US' ELSE 'XX' END"
    hint = " OR ".join(f"lower(item_description_original) LIKE '%{w}%'" for w in CHARGE_WORDS)
    return {
        "vendors": f"SELECT CAST(s_suppkey AS VARCHAR) AS vendor_id, s_name || ' ' || {_list(VENDOR_WORDS)}[s_suppkey % {len(VENDOR_WORDS)} + 1] AS vendor_name, {code.format('s_nationkey')} AS country_code FROM supplier",
        "centres": f"SELECT 'CC_' || n_nationkey AS cost_centre_id, n_name AS cost_centre_name, {code.format('n_nationkey')} AS country_code FROM nation",
        "products": f"SELECT p_partkey, p_name || ' ' || {_list(PRODUCT_WORDS)}[p_partkey % {len(PRODUCT_WORDS)} + 1] AS product_name, p_type FROM part",
        "seed": """SELECT CAST(p_partkey AS VARCHAR) AS sku_id, lower(CASE WHEN p_partkey % 17 = 0 THEN p_type ELSE product_name END) AS canonical_name,
            CASE WHEN p_partkey % 3 = 0 THEN 'auto_ref' ELSE 'approved_seed' END AS source, '2025-01-01' AS effective_from, 'v0.1' AS version FROM products WHERE p_partkey % 10 <> 0""",
        "days": "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1",
        "raw_rates": """SELECT date, 'USD' AS from_currency, 'AUD' AS to_currency, 1.25::DOUBLE + (n % 50) / 64.0::DOUBLE AS exchange_rate FROM days WHERE dayofyear(date) % 3 = 0
            UNION ALL SELECT date, 'AUD', 'USD', 0.5::DOUBLE + (n % 50) / 128.0::DOUBLE FROM days WHERE dayofyear(date) % 5 = 0""",
        "both_rates": """SELECT date, exchange_rate, 'SOURCE' AS rate_source FROM raw_rates WHERE from_currency = 'USD'
            UNION ALL SELECT date, 1.0::DOUBLE / exchange_rate, 'CALCULATED' FROM raw_rates WHERE from_currency = 'AUD' AND exchange_rate > 0""",
        "best_rates": "SELECT date, exchange_rate, rate_source FROM both_rates QUALIFY row_number() OVER (PARTITION BY date ORDER BY CASE rate_source WHEN 'SOURCE' THEN 1 ELSE 2 END) = 1",
        "grid": "SELECT CAST(unnest(generate_series((SELECT min(date) FROM best_rates), (SELECT max(date) FROM best_rates), INTERVAL 1 DAY)) AS DATE) AS date",
        "near": """SELECT grid.date, exchange_rate AS v, rate_source AS s, last_value(exchange_rate IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN exchange_rate IS NOT NULL THEN grid.date END IGNORE NULLS) OVER b AS pd,
            first_value(exchange_rate IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN exchange_rate IS NOT NULL THEN grid.date END IGNORE NULLS) OVER a AS nd
            FROM grid LEFT JOIN best_rates ON grid.date = best_rates.date WINDOW b AS (ORDER BY grid.date ROWS UNBOUNDED PRECEDING), a AS (ORDER BY grid.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        "rates": """SELECT date, coalesce(v, pv + (nv - pv) * ((date - pd) / (nd - pd))) AS exchange_rate, coalesce(s, 'INTERPOLATED') AS rate_source FROM near""",
        "lines0": """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS BIGINT) AS line_number, CASE WHEN l_partkey % 40 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS sku_id,
            product_name || CASE WHEN l_partkey % 80 = 0 THEN ' Delivery Fee' ELSE '' END AS item_description_original, l_quantity AS quantity, l_extendedprice / nullif(l_quantity, 0) AS unit_price,
            CASE WHEN c_nationkey % 2 = 0 THEN 'AUD' ELSE 'USD' END AS currency, CASE WHEN l_suppkey % 33 <> 0 THEN s_name END AS vendor_brand, 'CC_' || c_nationkey AS cost_centre_id, 'user' || o_custkey AS requisitioner,
            o_orderstatus AS approval_status, CAST(l_shipdate AS DATE) AS delivery_date, CAST(o_orderdate AS DATE) AS order_date, 'orders_' || c_nationkey || '.json' AS source_filename,
            l_partkey % 10 <> 0 AS seeded, lower(CASE WHEN l_partkey % 17 = 0 THEN p_type ELSE product_name END) AS known, s_acctbal, CAST(l_suppkey AS VARCHAR) AS vendor, s_name
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN products ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
        "lines1": "SELECT *, lower(trim(item_description_original)) AS item_description_cleaned FROM lines0",
        "flagged": f"""SELECT *, ({hint}) AS non_product_hint, CASE WHEN seeded THEN round(1 - levenshtein(item_description_cleaned, known) / greatest(length(item_description_cleaned), length(known)), 6) END AS fuzz_score,
            vendor_brand AS vendor_brand_original, CASE WHEN seeded AND vendor_brand IS NOT NULL AND s_acctbal > 0 THEN vendor END AS matched_vendor_id, CASE WHEN seeded AND vendor_brand IS NOT NULL AND s_acctbal > 0 THEN s_name END AS matched_vendor_name,
            CASE WHEN seeded THEN CASE WHEN vendor_brand IS NOT NULL AND s_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS vendor_fuzz_score,
            sku_id IS NULL OR NOT seeded AS flag_missing_in_seed, coalesce(fuzz_score < 0.8, false) AS flag_name_mismatch, matched_vendor_id IS NULL AS flag_vendor_mismatch,
            flag_missing_in_seed OR flag_name_mismatch OR (vendor_brand IS NOT NULL AND matched_vendor_id IS NULL) AS has_quality_issues FROM lines1""",
        "valid": "SELECT * FROM flagged WHERE NOT flag_missing_in_seed AND NOT flag_name_mismatch AND NOT flag_vendor_mismatch",
        "nonproduct": "SELECT * FROM flagged WHERE non_product_hint AND sku_id IS NULL",
        "exceptions": """SELECT *, CASE WHEN flag_missing_in_seed THEN 'SKU_NOT_IN_SEED' WHEN flag_name_mismatch THEN 'NAME_MISMATCH' ELSE 'VENDOR_MISMATCH' END AS exception_type FROM flagged
            WHERE (flag_missing_in_seed OR flag_name_mismatch OR flag_vendor_mismatch) AND NOT (non_product_hint AND sku_id IS NULL)""",
        "dim_date": f"""SELECT d AS date_actual, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS date_key, CAST(year(d) AS BIGINT) AS year, CAST(quarter(d) AS BIGINT) AS quarter, CAST(month(d) AS BIGINT) AS month,
            CAST(week(d) AS BIGINT) AS week, CAST(day(d) AS BIGINT) AS day_of_month, CAST(dayofweek(d) AS BIGINT) AS day_of_week, dayname(d) AS day_name, monthname(d) AS month_name, dayofweek(d) IN (0, 6) AS is_weekend,
            CAST(year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, CAST(CASE WHEN month(d) IN (7, 8, 9) THEN 1 WHEN month(d) >= 10 THEN 2 WHEN month(d) <= 3 THEN 3 ELSE 4 END AS INTEGER) AS fiscal_quarter,
            strftime(d, '%m-%d') IN ('01-01', '12-25', '01-26', '04-25') AS is_holiday, coalesce(exchange_rate, 1.5::DOUBLE) AS usd_to_aud
            FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN rates ON d = rates.date""",
        "dim_cost_centre": "SELECT md5(cost_centre_id) AS cost_centre_key, *, CASE country_code WHEN 'AU' THEN 'Australia' WHEN 'US' THEN 'United States' ELSE 'Unknown' END AS country_name, CASE country_code WHEN 'AU' THEN 'APAC' WHEN 'US' THEN 'Americas' ELSE 'Other' END AS region, true AS is_active FROM centres",
        "dim_vendor": f"SELECT md5(vendor_id) AS vendor_key, vendor_id, vendor_name, {_case('vendor_name', star.VENDOR_CATEGORIES, 'General')} AS vendor_category, {_case('vendor_name', star.VENDOR_TIERS, 'Standard')} AS vendor_tier, country_code, true AS is_active FROM vendors",
        "all_products": """SELECT sku_id, canonical_name, source AS source_type, true AS from_seed FROM seed
            UNION ALL SELECT DISTINCT sku_id, item_description_cleaned, 'auto_discovered', false FROM valid WHERE sku_id NOT IN (SELECT sku_id FROM seed)""",
        "dim_product": f"SELECT md5(sku_id) AS product_key, sku_id, canonical_name, source_type, {_case('canonical_name', star.CATEGORIES, 'Other')} AS product_category, {_case('canonical_name', star.SUBCATEGORIES, 'Standard')} AS product_subcategory, {_case('canonical_name', star.BRANDS, 'Generic')} AS product_brand, from_seed, source_type = 'approved_seed' AS is_approved, true AS is_active FROM all_products",
        "fct_order_line": """SELECT md5(order_id || '|' || line_number) AS order_line_key, a.date_key, b.date_key AS delivery_date_key, cost_centre_key, vendor_key, product_key, CASE currency WHEN 'USD' THEN 1 WHEN 'AUD' THEN 2 ELSE 0 END AS currency_key,
            quantity, unit_price, quantity * unit_price AS line_total_amount, CASE currency WHEN 'USD' THEN quantity * unit_price * a.usd_to_aud WHEN 'AUD' THEN quantity * unit_price END AS line_total_aud,
            CASE currency WHEN 'USD' THEN quantity * unit_price WHEN 'AUD' THEN quantity * unit_price / a.usd_to_aud END AS line_total_usd, order_id, line_number, requisitioner, approval_status, source_filename, currency AS original_currency
            FROM valid v LEFT JOIN dim_date a ON v.order_date = a.date_actual LEFT JOIN dim_date b ON v.delivery_date = b.date_actual LEFT JOIN dim_cost_centre USING (cost_centre_id) LEFT JOIN dim_vendor ON vendor_id = matched_vendor_id LEFT JOIN dim_product p ON p.sku_id = v.sku_id""",
        "fct_data_quality": """SELECT md5(order_id || '|' || line_number || '|' || exception_type) AS data_quality_key, date_key, cost_centre_key, vendor_key, product_key, 1 AS exception_count, coalesce(fuzz_score, 0::DOUBLE) AS fuzz_score,
            coalesce(vendor_fuzz_score, 0::DOUBLE) AS vendor_fuzz_score, exception_type, flag_missing_in_seed, flag_name_mismatch, flag_vendor_mismatch, order_id, line_number, vendor_brand_original, matched_vendor_name, item_description_original, item_description_cleaned
            FROM exceptions e JOIN dim_date ON order_date = date_actual JOIN dim_cost_centre USING (cost_centre_id) LEFT JOIN dim_vendor ON vendor_id = matched_vendor_id LEFT JOIN dim_product p ON p.sku_id = e.sku_id""",
        "vlines": """SELECT * REPLACE (CAST(CAST(sku_id AS BIGINT) % 30 + 1 AS VARCHAR) AS sku_id, CAST(CAST(matched_vendor_id AS BIGINT) % 3 + 1 AS VARCHAR) AS matched_vendor_id,
            'CC_' || (CAST(split_part(cost_centre_id, '_', 2) AS INTEGER) % 5) AS cost_centre_id, CAST(date_trunc('month', order_date) AS DATE) AS order_date) FROM valid""",
        "daily": """SELECT v.sku_id, matched_vendor_id, cost_centre_id, order_date, avg(usd) AS avg_unit_price, min(usd) AS min_unit_price, max(usd) AS max_unit_price, count(*) AS order_count, sum(quantity) AS total_quantity,
            var_samp(usd) AS price_variance, stddev_samp(usd) AS price_stddev FROM (SELECT *, CASE currency WHEN 'USD' THEN unit_price WHEN 'AUD' THEN unit_price / usd_to_aud END AS usd FROM vlines LEFT JOIN dim_date ON order_date = date_actual
            WHERE matched_vendor_id IS NOT NULL AND unit_price > 0 AND quantity > 0) v WHERE usd IS NOT NULL GROUP BY ALL""",
        "fct_price_variance": """SELECT md5(d.sku_id || '|' || matched_vendor_id || '|' || cost_centre_id || '|' || order_date) AS price_variance_key, date_key, product_key, vendor_key, cost_centre_key, avg_unit_price, min_unit_price, max_unit_price,
            price_variance, price_stddev, order_count, total_quantity, CASE WHEN max_unit_price > 0 AND min_unit_price > 0 THEN (max_unit_price - min_unit_price) / min_unit_price ELSE 0 END AS price_range_ratio,
            CASE WHEN avg_unit_price > 0 AND price_stddev > 0 THEN price_stddev / avg_unit_price ELSE 0 END AS coefficient_of_variation, true AS has_significant_variance, order_date AS analysis_date
            FROM daily d JOIN dim_date ON order_date = date_actual JOIN dim_cost_centre USING (cost_centre_id) JOIN dim_vendor ON vendor_id = matched_vendor_id JOIN dim_product p ON p.sku_id = d.sku_id
            WHERE coalesce(price_stddev / nullif(avg_unit_price, 0) > 0.2, false) OR coalesce((max_unit_price - min_unit_price) / nullif(min_unit_price, 0) > 0.5, false)""",
    }


def with_base(sql: str) -> str:
    """`sql` with the expressions that it needs before it."""
    import re

    parts = base_sql()
    needed: set[str] = set()
    stack = [sql]
    while stack:
        text = stack.pop()
        for name in parts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                stack.append(parts[name])
    return "WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in parts if n in needed) + "\n" + sql
