"""Summaries at the edge: pivots, totals, top lists, statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], measure: str, digits: int = 2) -> DataFrame:
    """One column per value; given values spare the pass that would look for them. No rows: 0."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(F.sum(measure))
    return wide.select(*keys, *[F.round(F.coalesce(F.col(v), F.lit(0.0)), digits).alias(v) for v in values])


def summary(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """n, total, mean, deviation by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(measure), 2).alias("total"), F.round(F.avg(measure), 2).alias("mean"), F.round(F.stddev_samp(measure), 4).alias("deviation"))


def top(df: DataFrame, keys: Sequence[str], measure: str, k: int) -> DataFrame:
    """The k largest totals, ties by key."""
    return df.groupBy(*keys).agg(F.round(F.sum(measure), 2).alias("total")).orderBy(F.desc("total"), *keys).limit(k)


def update_statements(decisions: DataFrame, table: str) -> DataFrame:
    """sku_id, statement for approved rows; quotes in names are doubled."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    text = F.concat(F.lit(f"UPDATE {table} SET canonical_name = "), quote("final_sku_name"), F.lit(" WHERE sku_id = "), quote("sku_id"), F.lit(";"))
    return decisions.where(F.upper(F.trim("decision")) == "APPROVED").select("sku_id", text.alias("statement"))


def lines_of(df: DataFrame, label: str, value: str, k: int = 5, unit: str = "") -> list[str]:
    """Readable lines of a small report's first rows."""
    rows = df.select(label, value).limit(k).collect()
    return [f"{r[0]}: {unit}{r[1]:,.2f}" for r in rows if r[1] is not None]
