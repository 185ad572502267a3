"""Calendar spines, rates from both directions, and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.scan import neighbours, window_neighbours


def date_spine(spark: SparkSession, first: str, last: str, name: str = "date") -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


#: Days of a stretch of a spine that one row is spread to.
STRETCH = 10_000


def spine_of(df: DataFrame, date: str = "date", keys: tuple[str, ...] = (), stretch: int | None = None) -> DataFrame:
    """Every day from a series' first to its last; one spine per value of `keys`. With `stretch` a long spine is made by many tasks, that many
    days a row."""
    bounds = df.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).where(F.col("lo").isNotNull())
    if stretch:
        first = F.explode(F.sequence(F.lit(0), F.datediff("hi", "lo"), F.lit(stretch))).alias("_at")
        bounds = bounds.select(*keys, "lo", "hi", first).repartition("_at", *keys)
        bounds = bounds.select(*keys, F.date_add("lo", F.col("_at")).alias("lo"), F.least("hi", F.date_add("lo", F.col("_at") + (stretch - 1))).alias("hi"))
    return bounds.select(*keys, F.explode(F.sequence("lo", "hi")).alias(date))


def pair_rates(raw: DataFrame, base: str = "USD", quote: str = "AUD") -> DataFrame:
    """date, exchange_rate, rate_source: quoted rates and reciprocals of the opposite ones (only positive ones)."""
    direct = raw.where((F.col("from_currency") == base) & (F.col("to_currency") == quote)).select("date", "exchange_rate", F.lit("SOURCE").alias("rate_source"))
    inverse = raw.where((F.col("from_currency") == quote) & (F.col("to_currency") == base) & (F.col("exchange_rate") > 0))
    return direct.unionByName(inverse.select("date", (1.0 / F.col("exchange_rate")).alias("exchange_rate"), F.lit("CALCULATED").alias("rate_source")))


def prefer(df: DataFrame, keys: list[str], ranking: list) -> DataFrame:
    """The first row of each key in the order of `ranking`."""
    w = Window.partitionBy(*keys).orderBy(*ranking)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fill_gaps(df: DataFrame, date: str = "date", value: str = "exchange_rate", source: str = "rate_source", keys: tuple[str, ...] = (), long: bool = False) -> DataFrame:
    """Daily series without holes: linear between known neighbours, else the nearer end's value.

    `source` says INTERPOLATED or FORWARD_FILLED for new values. A series is a calendar's length, so one window per
    series is bounded; give `keys` to spread many series over tasks. With `long` each series is spread over many tasks itself.
    """
    days = spine_of(df, date, keys, STRETCH if long else None).join(df, [*keys, date], "left")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    days = (neighbours if long else window_neighbours)(days, [date], known, keys)
    between = F.col("_p").isNotNull() & F.col("_n").isNotNull() & (F.col("_p.d") != F.col("_n.d"))
    share = F.try_divide(F.datediff(date, "_p.d").cast("double"), F.datediff("_n.d", "_p.d").cast("double"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share
    have = F.col(value).isNotNull()
    new_source = F.when(have, F.col(source)).when(between, "INTERPOLATED").when(F.col("_p").isNotNull() | F.col("_n").isNotNull(), "FORWARD_FILLED")
    new_value = F.when(have, F.col(value)).when(between, line).otherwise(F.coalesce("_p.v", "_n.v"))
    return days.withColumns({source: new_source, value: new_value}).drop("_p", "_n")


def daily_rates(raw: DataFrame, base: str = "USD", quote: str = "AUD") -> DataFrame:
    """One rate for each day between the first and last known: quoted before reciprocal, gaps filled."""
    first = F.when(F.col("rate_source") == "SOURCE", 1).otherwise(2)
    best = prefer(pair_rates(raw, base, quote), ["date"], [first, "exchange_rate"])
    return fill_gaps(best).select("date", F.lit(base).alias("from_currency"), F.lit(quote).alias("to_currency"), "exchange_rate", "rate_source")
