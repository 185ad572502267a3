"""Contract checks. Each returns the violating rows or one row of counts; none raises."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """check, column_name, failures; all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("failures")) for i, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r")).select(F.lit("not_null").alias("check"), "r.*")


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Other non-null values, with their number."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null child values without a parent, with their number. Children are counted before the join."""
    counts = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(parent_column).alias("_key")).distinct()
    return counts.join(keys, counts[column] == keys["_key"], "left_anti")


def row_count(df: DataFrame, least: int = 1) -> DataFrame:
    """One row if the table has fewer rows than `least`."""
    return df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def contract_report(df: DataFrame, required: Sequence[str], key: Sequence[str], non_negative: Sequence[str]) -> DataFrame:
    """One row of metrics: rows, distinct keys, nulls of required columns, negative values."""
    whole = reduce(lambda a, b: a + b, [F.count_if(F.col(c) < 0) for c in non_negative])
    distinct = df.select(*key).distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required], whole.alias("negative_values"))
    return counts.crossJoin(F.broadcast(distinct))  # one row each


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count for each table."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()])
