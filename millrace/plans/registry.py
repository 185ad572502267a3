"""All queries of the library over the TPC-H-like tables by name, and the same queries in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.similarity import similarity
from millrace.held import held, shared_dir
from millrace.operators import catalogue, checks, contracts, curation, edits, gapfill, matching, quality, reports, scan, seed
from millrace.plans import questions, standin, warehouse
from millrace.plans.standin import AS_OF, table, with_base
from millrace.sources import sniff, versioned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = with_base(sql) if base else sql
        return f

    return add


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---- dimensions and facts -------------------------------------------------------------------------------------------

for _name, _digits in {"dim_date": {"usd_to_aud": 6}, "dim_cost_centre": {}, "dim_vendor": {}, "dim_product": {}}.items():

    def _dim(spark: SparkSession, d: str, n: str = _name, digits: dict = _digits) -> DataFrame:
        df = standin.tables(spark, d)[n]
        return df.withColumns({c: F.round(c, k) for c, k in digits.items()}) if digits else df

    query(f"SELECT * REPLACE (round(usd_to_aud, 6) AS usd_to_aud) FROM {_name}" if _digits else f"SELECT * FROM {_name}", name=_name)(_dim)


@query("SELECT * FROM fct_order_line")
def fct_order_line(spark: SparkSession, d: str) -> DataFrame:
    return standin.tables(spark, d)["fct_order_line"].drop("line_uid")


@query("SELECT * FROM fct_data_quality")
def fct_data_quality(spark: SparkSession, d: str) -> DataFrame:
    return standin.tables(spark, d)["fct_data_quality"].drop("line_uid")


_PRICES = ("avg_unit_price", "min_unit_price", "max_unit_price", "price_stddev", "price_range_ratio", "coefficient_of_variation")


@query(f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _PRICES)}, round(price_variance, 3) AS price_variance) FROM fct_price_variance")
def fct_price_variance(spark: SparkSession, d: str) -> DataFrame:
    """To a millionth: prices have two decimals, and sums of doubles differ in the last places with their order."""
    return _rounded(_rounded(standin.tables(spark, d)["fct_price_variance"], 6, *_PRICES), 3, "price_variance")


# ---- rates ----------------------------------------------------------------------------------------------------------


@query("SELECT date, 'USD' AS from_currency, 'AUD' AS to_currency, round(exchange_rate, 8) AS exchange_rate, rate_source FROM rates")
def fx_gapfill_linear(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(standin.rates(spark, d), 8, "exchange_rate")


@query("SELECT date, round(exchange_rate, 8) AS exchange_rate, rate_source FROM best_rates")
def fx_dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("rate_source") == "SOURCE", 1).otherwise(2)
    return _rounded(gapfill.prefer(gapfill.pair_rates(standin.raw_rates(spark, d)), ["date"], [first]), 8, "exchange_rate")


@query("SELECT date, round(exchange_rate, 8) AS exchange_rate, rate_source FROM both_rates")
def fx_inverse_union(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(gapfill.pair_rates(standin.raw_rates(spark, d)), 8, "exchange_rate")


@query("SELECT date FROM grid")
def date_spine(spark: SparkSession, d: str) -> DataFrame:
    return gapfill.spine_of(gapfill.pair_rates(standin.raw_rates(spark, d)))


@query(
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, round(avg(value), 9) AS value FROM events GROUP BY ALL),
    k AS (SELECT event_type, min(date) AS lo, max(date) AS hi FROM d GROUP BY 1), g AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM k)
    SELECT event_type, date, round(value, 9) AS value, CASE WHEN value IS NULL THEN 'INTERPOLATED' ELSE 'SOURCE' END AS rate_source FROM g LEFT JOIN d USING (event_type, date)""",
    base=False,
)
def gapfill_by_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of all events per event type, on one calendar each."""
    days = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(F.round(F.avg("value"), 9).alias("value"))
    full = gapfill.fill_gaps(days.withColumn("rate_source", F.lit("SOURCE")), value="value", keys=("event_type",))
    return full.select("event_type", "date", F.when(F.col("rate_source") == "SOURCE", F.round("value", 9)).alias("value"), "rate_source")


@query(
    """WITH s AS (SELECT event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN value END AS v FROM events), o AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS pt,
    first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS nt FROM s WINDOW b AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), a AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL OR pt = nt THEN pv ELSE pv + (nv - pv) * ((epoch_us(ts) - epoch_us(pt))::DOUBLE / (epoch_us(nt) - epoch_us(pt))::DOUBLE) END, 6) AS filled,
    CASE WHEN v IS NOT NULL THEN 'SOURCE' WHEN pv IS NOT NULL AND nv IS NOT NULL THEN 'INTERPOLATED' ELSE 'FORWARD_FILLED' END AS source FROM o""",
    base=False,
)
def long_series_fill(spark: SparkSession, d: str) -> DataFrame:
    """All events as one series over time: the values of clicks and views are known, the others lie on the line between their neighbours."""
    us = lambda c: F.unix_micros(F.to_timestamp_ltz(c))
    v = F.when(F.col("event_type").isin("click", "view"), F.col("value"))
    rows = table(spark, d, "events").select("event_id", us(F.col("ts")).alias("t"), v.alias("v"))
    near = scan.neighbours(rows, ["t", "event_id"], F.when(F.col("v").isNotNull(), F.struct("t", "v")))
    both = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * ((F.col("t") - F.col("_p.t")).cast("double") / F.nullif(F.col("_n.t") - F.col("_p.t"), F.lit(0)).cast("double"))
    filled = F.coalesce("v", F.when(both, line), F.col("_p.v"), F.col("_n.v"))
    source = F.when(F.col("v").isNotNull(), "SOURCE").when(both, "INTERPOLATED").otherwise("FORWARD_FILLED")
    return near.select("event_id", F.round(filled, 6).alias("filled"), source.alias("source"))


# ---- quality --------------------------------------------------------------------------------------------------------

_LINE = ["order_id", "line_number", "sku_id", "vendor_brand", "matched_vendor_id", "fuzz_score", "non_product_hint", *quality.FLAGS, "has_quality_issues"]
_COLS = ", ".join(_LINE)


@query(f"SELECT {_COLS} FROM flagged")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return standin.flagged(spark, d).select(*_LINE)


@query(f"SELECT {_COLS} FROM flagged")
def quality_flags_scored(spark: SparkSession, d: str) -> DataFrame:
    """The same, with scores from a table of their own that holds seeded lines only."""
    scores = ["fuzz_score", "matched_vendor_id", "matched_vendor_name", "vendor_fuzz_score"]
    lines = standin.order_lines(spark, d)
    table_ = lines.where("fuzz_score is not null").select("line_uid", *scores).dropDuplicates(["line_uid"])
    return quality.flag_lines(lines.drop(*scores), standin.seed(spark, d), table_).select(*_LINE)


for _kind, _more in {"valid": [], "nonproduct": [], "exceptions": ["exception_type"]}.items():

    def _routed(spark: SparkSession, d: str, k: str = _kind, more: list = _more) -> DataFrame:
        return quality.route(standin.flagged(spark, d))[k].select(*_LINE, *more)

    query(f"SELECT {', '.join([_COLS, *_more])} FROM {_kind}", name=f"route_{_kind}")(_routed)


@query("SELECT exception_type, count(*) AS n FROM exceptions GROUP BY 1")
def exception_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.route(standin.flagged(spark, d))["exceptions"].groupBy("exception_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)", base=False)
def missing_in_seed_anti(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").where(F.col("p_partkey") % 10 != 0).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber").distinct()


@query("SELECT sku_id, order_id, line_number FROM lines1 WHERE sku_id NOT IN (SELECT sku_id FROM seed)")
def not_in_seed(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_in(standin.order_lines(spark, d), standin.seed(spark, d), "sku_id").select("sku_id", "order_id", "line_number")


# ---- text -----------------------------------------------------------------------------------------------------------


def _replaced(c: str, pairs: tuple) -> str:
    for a, b in pairs:
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


_DECODED = _replaced("html", text.ENTITIES)
_STRIPPED = f"regexp_replace(regexp_replace({_DECODED}, '<[^>]+>', ''), '</[^>]+>', '')"
_CLEANED = rf"lower(trim(regexp_replace({_replaced(_replaced(_STRIPPED, text.DASH_ENTITIES), text.MOJIBAKE)}, '[ \t\n\r\f\x0b]+', ' ')))"


@query(f"SELECT page_id, md5({_CLEANED}) AS cleaned_md5, length({_CLEANED}) AS n FROM pages", base=False)
def clean_text_html(spark: SparkSession, d: str) -> DataFrame:
    clean = text.clean_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(clean).alias("cleaned_md5"), F.length(clean).cast("long").alias("n"))


@query(f"SELECT doc_id, {' OR '.join(f"contains(lower(text), '{w}')" for w in text.CHARGE_WORDS)} AS hint FROM documents", base=False)
def nonproduct_hint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.charge_hint(F.col("text")).alias("hint"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, md5(concat(p_partkey, '|', p_brand, '|', p_type)) AS product_key FROM part", base=False)
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalize_text(F.col("p_name")).alias("name"), text.surrogate_key("p_partkey", "p_brand", "p_type").alias("product_key"))


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS bad, TRY_CAST('2024-02-3' || (o_orderkey % 10) AS DATE) AS day FROM orders", base=False)
def try_casts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("double").alias("level"), F.col("o_orderpriority").try_cast("double").alias("bad"), F.concat(F.lit("2024-02-3"), (F.col("o_orderkey") % 10).cast("string")).try_cast("date").alias("day"))


# ---- questions ------------------------------------------------------------------------------------------------------

_SINCE = "date_actual >= CAST(DATE '{}' - INTERVAL {} MONTH AS DATE)"
_SALES = "fct_order_line f JOIN dim_date USING (date_key) JOIN dim_cost_centre c USING (cost_centre_key) JOIN dim_vendor v USING (vendor_key) JOIN dim_product p USING (product_key)"


def _question_sql(name: str) -> str:
    """The question as SQL over the star schema, from its file, which names its tables and dates by placeholders."""
    text = resources.files("millrace.plans").joinpath("sql", f"{name}.sql").read_text(encoding="utf-8")
    names = {"as_of": AS_OF, "sales": _SALES, "sales_without_centres": _SALES.replace(" JOIN dim_cost_centre c USING (cost_centre_key)", "")}
    return text.format(**names, **{f"since_{n}": _SINCE.format(AS_OF, n) for n in (3, 6, 12)})


_QUESTION_SQL = {n: _question_sql(n) for n in ("q1_spend_top20", "q2_data_quality", "q3_price_variance", "q4_regions", "q5_seasons", "q6_vendors", "q7_executive")}
for (_key, _sql), _f in zip(_QUESTION_SQL.items(), questions.QUESTIONS.values(), strict=True):

    def _question(spark: SparkSession, d: str, f: Callable = _f) -> DataFrame:
        return f(standin.tables(spark, d), AS_OF)

    _head, _, _tail = _sql.partition("SELECT") if _sql.startswith("WITH") else ("", "", "")
    if _head:
        ORACLE_SQL[_key] = with_base(_sql[4:].strip()).rstrip()
        # the question's own expressions follow the base's
        _whole = with_base("#" + _sql[4:].strip())
        ORACLE_SQL[_key] = _whole.replace("\n#", ",\n")
    else:
        ORACLE_SQL[_key] = with_base(_sql)
    QUERIES[_key] = _question


FACT_SHARES = 4


def q5_from_warehouse(spark: SparkSession, d: str) -> DataFrame:
    """The seasons over tables written for it: pruned by month, and joined without an exchange. Facts get the columns that the question
    asks for, and their keys from the written dimensions; they are written in FACT_SHARES shares of the orders, so that only one share's
    exchanges are on the disks at a time. As a share has that part of the rows, tables have that part of the usual buckets, and so as many
    files in all. The answer is held, and the tables go."""
    buckets = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // FACT_SHARES)
    database = f"star_{uuid.uuid4().hex}"
    tables = standin.tables(spark, d)
    stored = warehouse.write(spark, tables, database, ("dim_date", "dim_product"), buckets)

    def facts(share: int) -> DataFrame:
        own = standin.Tables(spark, standin.Share(spark, d, share, FACT_SHARES))
        own.update(stored, dim_cost_centre=tables["dim_cost_centre"], dim_vendor=tables["dim_vendor"])
        return own["fct_order_line"].select("date_key", "product_key", "quantity", "line_total_aud", "order_id")

    stored |= warehouse.write(spark, {"fct_order_line": map(facts, range(FACT_SHARES))}, database, ["fct_order_line"], buckets)
    out = held(questions.seasons(stored, AS_OF))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


query(name="q5_from_warehouse")(q5_from_warehouse)
ORACLE_SQL["q5_from_warehouse"] = ORACLE_SQL["q5_seasons"]


# ---- checks ---------------------------------------------------------------------------------------------------------


@query("SELECT 'not_null' AS \"check\", column_name, failures FROM (SELECT unnest(['order_id', 'sku_id', 'vendor_brand', 'unit_price']) AS column_name, unnest([count(*) FILTER (order_id IS NULL), count(*) FILTER (sku_id IS NULL), count(*) FILTER (vendor_brand IS NULL), count(*) FILTER (unit_price IS NULL)]) AS failures FROM lines1)")
def check_not_null(spark: SparkSession, d: str) -> DataFrame:
    return checks.not_null(standin.order_lines(spark, d), ["order_id", "sku_id", "vendor_brand", "unit_price"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", base=False)
def check_unique(spark: SparkSession, d: str) -> DataFrame:
    return checks.unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1", base=False)
def check_accepted_values(spark: SparkSession, d: str) -> DataFrame:
    return checks.accepted_values(table(spark, d, "events"), "event_type", ["click", "view"])


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1", base=False)
def check_relationships(spark: SparkSession, d: str) -> DataFrame:
    return checks.relationships(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size < 40"), "p_partkey")


@query("SELECT count(*) AS n FROM region HAVING count(*) < 100", base=False)
def check_rowcount(spark: SparkSession, d: str) -> DataFrame:
    return checks.row_count(table(spark, d, "region"), 100)


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber < 2 AND l_quantity > 40 THEN 'line_number,quantity' WHEN l_linenumber < 2 THEN 'line_number' ELSE 'quantity' END AS broken FROM lineitem WHERE l_linenumber < 2 OR l_quantity > 40", base=False)
def check_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return checks.violations(rows, {"line_number": F.col("l_linenumber") >= 2, "quantity": F.col("l_quantity") <= 40}).withColumn("broken", F.array_join("broken", ","))


@query("SELECT * FROM (SELECT count(*) AS row_count, count(*) FILTER (sku_id IS NULL) AS null_sku_id, count(*) FILTER (order_date IS NULL) AS null_order_date, count(*) FILTER (quantity < 0) + count(*) FILTER (unit_price < 0) AS negative_values FROM lines1), (SELECT count(*) AS distinct_keys FROM (SELECT DISTINCT order_id, line_number FROM lines1))")
def contract_report(spark: SparkSession, d: str) -> DataFrame:
    return checks.contract_report(standin.order_lines(spark, d), ["sku_id", "order_date"], ["order_id", "line_number"], ["quantity", "unit_price"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("orders", "lineitem", "part", "supplier")), base=False)
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.table_counts({t: table(spark, d, t) for t in ("orders", "lineitem", "part", "supplier")})


_CONTRACTS = {
    "orders": lambda: contracts.Contract(not_null=["o_orderkey", "o_custkey"], unique=["o_orderkey"], accepted={"o_orderstatus": ["F", "O"]}, references={"o_custkey": ("customer", "c_custkey")}, rules={"price": F.col("o_totalprice") >= 1000}),
    "lineitem": lambda: contracts.Contract(not_null=["l_partkey"], unique=["l_orderkey"], references={"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_size")}, rules={"quantity": F.col("l_quantity") <= 40}),
    "region": lambda: contracts.Contract(not_null=["r_name"], least_rows=7),
}


@query(
    """SELECT 'orders' AS table_name, unnest(['not_null', 'not_null', 'accepted_values', 'rule', 'unique', 'relationships']) AS "check", unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'price', 'o_orderkey', 'o_custkey']) AS column_name,
    unnest([(SELECT count(*) FROM orders WHERE o_orderkey IS NULL), (SELECT count(*) FROM orders WHERE o_custkey IS NULL), (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')), (SELECT count(*) FROM orders WHERE o_totalprice < 1000),
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)), (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))]) AS failures
    UNION ALL SELECT 'lineitem', unnest(['not_null', 'rule', 'unique', 'relationships', 'relationships']), unnest(['l_partkey', 'quantity', 'l_orderkey', 'l_orderkey', 'l_partkey']),
    unnest([(SELECT count(*) FROM lineitem WHERE l_partkey IS NULL), (SELECT count(*) FROM lineitem WHERE l_quantity > 40), (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)),
    (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_size FROM part))])
    UNION ALL SELECT 'region', unnest(['not_null', 'row_count']), unnest(['r_name', '']), unnest([(SELECT count(*) FROM region WHERE r_name IS NULL), (SELECT greatest(0, 7 - count(*)) FROM region)])""",
    base=False,
)
def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of three tables, kept and broken, in one scan of each table."""
    return contracts.check({t: table(spark, d, t) for t in ("orders", "lineitem", "region", "customer", "part")}, {t: c() for t, c in _CONTRACTS.items()})


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS sku_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)", base=False)
def orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.orphans(*_named_lines(spark, d))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS sku_id FROM lineitem WHERE l_partkey % 9 = 0 OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40)", base=False)
def lines_without_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Keys that nine divides are left empty, so that they name no product."""
    lines, known = _named_lines(spark, d)
    return catalogue.without_orphans(lines.withColumn("sku_id", F.when(F.col("sku_id").cast("long") % 9 == 0, "").otherwise(F.col("sku_id"))), known)


def _named_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("sku_id"))
    return lines, table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").cast("string").alias("sku_id"))


@query(
    """SELECT p_brand, p_partkey, version, version = n AS is_active, CASE WHEN version = n THEN DATE '2025-01-01' + CAST(30 * (version - 1) AS INTEGER) ELSE DATE '2025-01-01' END AS created_date,
    CASE WHEN version = n THEN DATE '2025-07-01' ELSE DATE '2025-01-01' + CAST(30 * version AS INTEGER) END AS updated_date
    FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS version, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""",
    base=False,
)
def catalogue_versions(spark: SparkSession, d: str) -> DataFrame:
    out = catalogue.versions(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_size", "p_partkey"], "2025-01-01", "2025-07-01")
    return out.withColumn("version", F.col("version").cast("long")).drop("p_size")


@query("SELECT p_type, CASE WHEN b > 1 AND s > 1 THEN 'p_brand,p_size' WHEN b > 1 THEN 'p_brand' ELSE 'p_size' END AS fields FROM (SELECT p_type, count(DISTINCT p_brand) AS b, count(DISTINCT p_size) AS s FROM part GROUP BY 1) WHERE b > 1 OR s > 1", base=False)
def catalogue_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.conflicts(table(spark, d, "part"), "p_type", ["p_brand", "p_size"]).withColumn("fields", F.array_join("fields", ","))


_FAULTY = """t AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderkey % 50 WHEN 7 THEN 'n/a' WHEN 8 THEN '' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' END AS price,
    CASE o_orderkey % 70 WHEN 9 THEN '2024-02-30' WHEN 10 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderstatus AS status FROM orders)"""


def _faulty_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text, with prices and days that cannot be read."""
    k = F.col("o_orderkey")
    price = F.when(k % 50 == 7, "n/a").when(k % 50 == 8, "").otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5")))
    day = F.when(k % 70 == 9, "2024-02-30").when(k % 70 != 10, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select(k.cast("string").alias("key"), price.alias("price"), day.alias("day"), F.col("o_orderstatus").alias("status"))


@query(
    f"""WITH {_FAULTY}, n AS (SELECT count(*) AS n, count(*) FILTER (price = '') AS ep, count(*) FILTER (price = 'n/a') AS bp, count(*) FILTER (day IS NULL) AS ed, count(*) FILTER (day = '2024-02-30') AS bd FROM t)
    SELECT unnest(['key', 'price', 'day', 'status']) AS column_name, unnest(['long', CASE WHEN bp > 0 THEN 'string' ELSE 'double' END, CASE WHEN bd > 0 THEN 'string' ELSE 'date' END, 'string']) AS type, unnest([n, n - ep, n - ed, n]) AS n, unnest([0, ep, ed, 0]) AS empty,
    unnest([n, 0, 0, 0]) AS as_long, unnest([n, n - ep - bp, 0, 0]) AS as_double, unnest([0, 0, n - ed - bd, 0]) AS as_date FROM n""",
    base=False,
)
def sniffed_types(spark: SparkSession, d: str) -> DataFrame:
    return sniff.profile(_faulty_orders(spark, d)).select("column_name", "type", "n", "empty", "as_long", "as_double", "as_date")


@query(f"WITH {_FAULTY} SELECT CAST(key AS BIGINT) AS key, TRY_CAST(nullif(price, '') AS DOUBLE) AS price, TRY_CAST(day AS DATE) AS day, status, concat_ws(',', CASE WHEN price = 'n/a' THEN 'price=n/a' END, CASE WHEN day = '2024-02-30' THEN 'day=2024-02-30' END) AS rescued FROM t", base=False)
def rescued_orders(spark: SparkSession, d: str) -> DataFrame:
    """The same orders parsed; what cannot be read is kept as text."""
    out = sniff.rescued(_faulty_orders(spark, d), {"key": "long", "price": "double", "day": "date"})
    lost = F.transform(F.map_entries("_rescued"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("rescued", F.array_join(lost, ",")).drop("_rescued")


# ---- seeds and curation ---------------------------------------------------------------------------------------------


def _seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part, k = table(spark, d, "part"), F.col("p_partkey")
    name = lambda other: F.when(k % 3 == other, "approved_seed").otherwise("auto_ref").alias("source")
    old = part.where(k % 2 == 0).select(k.cast("string").alias("sku_id"), F.col("p_name").alias("canonical_name"), name(0), F.lit("2025-01-01").alias("effective_from"), F.lit("v0.1").alias("version"))
    new = part.where((k % 5 != 0) | (k % 2 == 1)).select(k.cast("string").alias("sku_id"), F.col("p_type").alias("canonical_name"), name(1), F.lit("2025-02-01").alias("effective_from"), F.lit("v0.2").alias("version"))
    return old, new


_SEEDS = """o AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS canonical_name, CASE WHEN p_partkey % 3 = 0 THEN 'approved_seed' ELSE 'auto_ref' END AS source, '2025-01-01' AS effective_from, 'v0.1' AS version FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_type AS canonical_name, CASE WHEN p_partkey % 3 = 1 THEN 'approved_seed' ELSE 'auto_ref' END AS source, '2025-02-01' AS effective_from, 'v0.2' AS version FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 1)"""


@query(f"WITH {_SEEDS} SELECT * EXCLUDE (p, fresh) FROM (SELECT *, CASE source WHEN 'approved_seed' THEN 2 ELSE 1 END AS p, 0 AS fresh FROM o UNION ALL SELECT *, CASE source WHEN 'approved_seed' THEN 2 ELSE 1 END, 1 FROM n) QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY p DESC, fresh DESC) = 1", base=False)
def seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return seed.upsert(*_seeds(spark, d))


@query(f"WITH {_SEEDS} SELECT * EXCLUDE (p, fresh) FROM (SELECT *, CASE source WHEN 'approved_seed' THEN 2 ELSE 1 END AS p, 0 AS fresh FROM o UNION ALL SELECT *, CASE source WHEN 'approved_seed' THEN 2 ELSE 1 END, 1 FROM n) QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY p DESC, fresh DESC) = 1", base=False)
def seed_merge_versioned(spark: SparkSession, d: str) -> DataFrame:
    """The same merge into a table of versions in the shared folder: written, merged into by bucket, and read again."""
    old, new = _seeds(spark, d)
    place = versioned.VersionedTable(spark, f"{shared_dir(spark)}/seed-{uuid.uuid4().hex}")
    place.create(old, "sku_id", buckets=16)
    place.merge(new)
    return place.read()


_APPROVED = "a AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_type AS canonical_name, CASE p_partkey % 4 WHEN 0 THEN 'approved_seed' ELSE 'auto_ref' END AS source, '2025-03-01' AS effective_from, '{}' AS version FROM part WHERE p_partkey % 4 < 2)"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on all parts, in the spelling of a spreadsheet; half of them rejected."""
    k = F.col("p_partkey")
    decision = F.when(k % 4 == 0, " approved").when(k % 4 == 1, "AUTO ").otherwise("rejected")
    return table(spark, d, "part").select(k.cast("string").alias("SKU ID"), F.concat(F.lit(" "), "p_type").alias("Final SKU Name"), decision.alias("Decision"))


@query(f"WITH {_APPROVED.format('v0.9')} SELECT * FROM a", base=False)
def seed_from_approvals(spark: SparkSession, d: str) -> DataFrame:
    return seed.rows_from_approvals(_decided(spark, d), "2025-03-01", "v0.9")


@query(f"WITH {_SEEDS}, {_APPROVED.format('v0.2')} SELECT * EXCLUDE (p, fresh) FROM (SELECT *, CASE source WHEN 'approved_seed' THEN 2 ELSE 1 END AS p, 0 AS fresh FROM o UNION ALL SELECT *, CASE source WHEN 'approved_seed' THEN 2 ELSE 1 END, 1 FROM a) QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY p DESC, fresh DESC) = 1", base=False)
def seed_merged(spark: SparkSession, d: str) -> DataFrame:
    """The old seed with the decisions on all parts, under the next version."""
    return seed.merged(_seeds(spark, d)[0], _decided(spark, d), "2025-03-01")


@query("SELECT 'v0.' || (max(p_size) + 1) AS version FROM part", base=False)
def version_bump(spark: SparkSession, d: str) -> DataFrame:
    return seed.next_version(table(spark, d, "part").select(F.concat(F.lit("v0."), F.col("p_size")).alias("version")))


@query("SELECT sku_id, item_description_cleaned AS description, count(*) AS line_order_count FROM lines1 WHERE sku_id IS NOT NULL AND item_description_cleaned IS NOT NULL GROUP BY ALL")
def sku_candidates(spark: SparkSession, d: str) -> DataFrame:
    return curation.candidates(standin.order_lines(spark, d), "sku_id", "item_description_cleaned")


@query("SELECT token, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT p_partkey) AS BIGINT) AS presence FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1", base=False)
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return curation.token_counts(table(spark, d, "part"), "p_partkey", "p_name")


_TOKENS = "t AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part)"


@query(f"WITH {_TOKENS} SELECT a.token AS a, b.token AS b, levenshtein(a.token, b.token) AS distance FROM t a, t b WHERE a.token < b.token AND levenshtein(a.token, b.token) <= 3", base=False)
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    tokens = curation.token_counts(table(spark, d, "part"), "p_partkey", "p_name").select("token")
    return edits.close_pairs(tokens, "token", 3)


@query(
    """WITH t AS (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS token FROM part), c AS (SELECT p_brand, token, count(*) AS n FROM t GROUP BY ALL)
    SELECT x.p_brand, x.token, coalesce(arg_max(y.token, (y.n, length(y.token), y.token)) FILTER (y.token IS NOT NULL), x.token) AS representative FROM c x LEFT JOIN c y
    ON x.p_brand = y.p_brand AND length(y.token) >= 4 AND levenshtein(x.token, y.token) <= 2 AND (y.n, length(y.token), y.token) >= (x.n, length(x.token), x.token) GROUP BY x.p_brand, x.token""",
    base=False,
)
def typo_collapse(spark: SparkSession, d: str) -> DataFrame:
    return curation.typo_map(table(spark, d, "part"), "p_brand", "p_name", max_distance=2, min_length=4)


_FIXED = """t AS (SELECT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')) AS token, generate_subscripts(string_split(lower(p_name), ' '), 1) AS i FROM part), c AS (SELECT p_brand, token, count(*) AS n FROM t GROUP BY ALL),
    m AS (SELECT x.p_brand, x.token, coalesce(arg_max(y.token, (y.n, length(y.token), y.token)) FILTER (y.token IS NOT NULL), x.token) AS representative FROM c x LEFT JOIN c y
    ON x.p_brand = y.p_brand AND length(y.token) >= 4 AND levenshtein(x.token, y.token) <= 2 AND (y.n, length(y.token), y.token) >= (x.n, length(x.token), x.token) GROUP BY x.p_brand, x.token),
    f AS (SELECT p_brand, p_partkey, i, representative FROM t JOIN m USING (p_brand, token))"""


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    part, tokens = table(spark, d, "part"), F.split(F.lower("p_name"), " ")
    return curation.apply_map(part, "p_brand", ["p_partkey"], tokens, curation.typo_map(part, "p_brand", "p_name", max_distance=2, min_length=4))


@query(f"WITH {_FIXED} SELECT p_brand, p_partkey, string_agg(representative, ' ' ORDER BY i) AS canonical FROM f GROUP BY ALL", base=False)
def corrected_names(spark: SparkSession, d: str) -> DataFrame:
    """Every part's name with its tokens replaced by the ones that stand for them in its brand."""
    return _fixed(spark, d).withColumn("canonical", F.array_join("canonical", " "))


@query(f"WITH {_FIXED}, p AS (SELECT p_brand, representative AS r, count(DISTINCT p_partkey) AS n FROM f GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(r) DESC, r) AS rn FROM p) SELECT p_brand, string_agg(r, ' ' ORDER BY rn) AS canonical_tokens FROM k WHERE rn <= 5 GROUP BY 1", base=False)
def brand_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The five tokens that most names of a brand hold, after correction."""
    return curation.frequent_tokens(_fixed(spark, d), "p_brand", "canonical", 5).withColumn("canonical_tokens", F.array_join("canonical_tokens", " "))


@query()
def curation_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Names of each brand's parts, ranked and decided; per brand one group of distinct names."""
    return curation.decide(curation.candidates(table(spark, d, "part"), "p_brand", "p_name"), "p_brand", "description")


@query()
def vendor_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned-up company names against all vendors."""
    names = table(spark, d, "customer").select(F.concat_ws(" ", F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "supply").otherwise("data")).alias("brand"))
    vendors = standin.vendors(spark, d).withColumn("vendor_name", F.regexp_replace("vendor_name", r"^\S+ ", "")).groupBy("vendor_name").agg(F.min("vendor_id").alias("vendor_id"))
    return matching.best_match(names, "brand", vendors, "vendor_id", "vendor_name")


@query()
def closest_part_types(spark: SparkSession, d: str) -> DataFrame:
    """Every part's name with the type that is most like it, of all types."""
    part = table(spark, d, "part")
    types = part.select("p_type").distinct().select("p_type", F.col("p_type").alias("id"))
    found = matching.best_match(part, "p_name", types, "id", "p_type", abbreviations={})
    return found.select("p_name", F.col("matched_vendor_id").alias("p_type"), F.round("vendor_fuzz_score", 6).alias("score"))


@query()
def fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Part names against their types by four scores; distinct pairs only are scored."""
    pairs = table(spark, d, "part").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", *[F.round(similarity(n, F.col("a"), F.col("b")), 6).alias(n) for n in ("ratio", "token_sort_ratio", "partial_token_set_ratio", "partial_token_ratio")])


# ---- reports --------------------------------------------------------------------------------------------------------


@query("SELECT r_name, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS O, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS P FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", base=False)
def region_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.pivot_sum(df, ["r_name"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 2) AS mean, round(stddev_samp(c_acctbal), 4) AS deviation FROM customer GROUP BY 1", base=False)
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("SELECT p_brand, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY total DESC, p_brand LIMIT 5", base=False)
def top_brands(spark: SparkSession, d: str) -> DataFrame:
    return reports.top(table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "l_extendedprice", 5)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sku_id, 'UPDATE seeds SET canonical_name = ''' || replace(s_name, '''', '''''') || ''' WHERE sku_id = ''' || s_suppkey || ''';' AS statement FROM supplier WHERE s_suppkey % 3 = 0", base=False)
def approval_statements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sku_id"), F.col("s_name").alias("final_sku_name"), F.when(F.col("s_suppkey") % 3 == 0, "APPROVED").otherwise("AUTO").alias("decision"))
    return reports.update_statements(rows, "seeds")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, c_nationkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 2) AS running, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS previous FROM customer", base=False)
def running_balance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_nationkey", F.round(F.sum("c_acctbal").over(w), 2).alias("running"), F.lag("c_custkey").over(w).alias("previous"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'Brass' WHEN lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%tin%' THEN 'Steel' ELSE 'Other' END AS label FROM part", base=False)
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    label: Column = text.first_rule(F.col("p_type"), (("Brass", ("brass",)), ("Steel", ("steel", "tin"))), "Other")
    return table(spark, d, "part").select("p_partkey", label.alias("label"))
