"""Types of text columns from one pass over all rows, drift from a declared schema, and parsing that keeps what it cannot read.

What is known of a column is how many of its values each type can read: counts, which tasks make and Spark adds up. A column's type is
the narrowest that reads every value that is not empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types from narrow to wide, and the form of their values; a date must also be a day of the calendar, a timestamp a moment.
FORMS = {
    "boolean": r"^(?i)(true|false)$", "long": r"^[+-]?[0-9]{1,18}$", "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$",
}
#: A declared type that holds all values of another.
WIDER = {("long", "double"), ("date", "timestamp")}


def parsed(c: Column, kind: str) -> Column:
    """The value of a text; null if it is empty or not of the type. Blanks around it do not count."""
    text = F.trim(c)
    if kind == "string":
        return F.nullif(c, F.lit(""))
    value = F.when(text.rlike(FORMS[kind]), text)
    return value.try_cast("timestamp_ntz" if kind == "timestamp" else kind)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, type, n (values that are not empty), empty (null or blank), and for each type how many values it reads; a row per
    column. Columns without values are strings. All columns in one pass."""
    columns = list(columns or df.columns)
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    cells = []
    for i, c in enumerate(columns):
        cells += [F.count_if(filled(c)).alias(f"n{i}"), F.count_if(~filled(c)).alias(f"e{i}"), *[F.count_if(parsed(F.col(c), k).isNotNull()).alias(f"{k}{i}") for k in FORMS]]
    one = df.agg(*cells)
    row = lambda i, c: F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("empty"), *[F.col(f"{k}{i}").alias(f"as_{k}") for k in FORMS])
    rows = one.select(F.explode(F.array(*[row(i, c) for i, c in enumerate(columns)])).alias("r")).select("r.*")
    fits = F.coalesce(*[F.when((F.col("n") > 0) & (F.col(f"as_{k}") == F.col("n")), F.lit(k)) for k in FORMS], F.lit("string"))
    return rows.select("column_name", fits.alias("type"), "n", "empty", *[f"as_{k}" for k in FORMS])


def drift(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """column_name, declared, found, unread, verdict: `missing` or `new` columns, `changed` ones whose declared type does not read
    all values (unread: how many), and `empty` ones; columns that are as declared have no row."""
    have = [c for c in df.columns if c in declared]
    spark = df.sparkSession
    out = spark.createDataFrame([(c, declared[c], None, None, "missing") for c in declared if c not in df.columns] + [(c, None, None, None, "new") for c in df.columns if c not in declared], "column_name string, declared string, found string, unread long, verdict string")
    if not have:
        return out
    said = F.create_map(*[F.lit(x) for c in have for x in (c, declared[c])])[F.col("column_name")]
    read = F.coalesce(*[F.when(F.col("declared") == k, F.col(f"as_{k}")) for k in FORMS], F.col("n"))
    rows = profile(df, have).withColumn("declared", said).withColumn("unread", F.col("n") - read)
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("unread") > 0, "changed")
    rows = rows.select("column_name", "declared", F.col("type").alias("found"), "unread", verdict.alias("verdict")).where("verdict is not null")
    return out.unionByName(rows)


def rescued(df: DataFrame, declared: Mapping[str, str], rest: str = "_rescued") -> DataFrame:
    """df with the declared columns parsed, and `rest`: a map from column to text of what could not be read (empty if all could).
    Columns that are not declared stay text, missing ones become null."""
    lost = [F.when(F.coalesce(F.trim(c) != "", F.lit(False)) & parsed(F.col(c), k).isNull(), F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))) for c, k in declared.items() if c in df.columns and k != "string"]
    none = F.create_map().cast("map<string,string>")
    kept = [parsed(F.col(c), declared[c]).alias(c) if c in declared else F.col(c) for c in df.columns]
    missing = [F.lit(None).cast("timestamp_ntz" if k == "timestamp" else k).alias(c) for c, k in declared.items() if c not in df.columns]
    return df.select(*kept, *missing, (F.map_from_entries(F.array_compact(F.array(*lost))) if lost else none).alias(rest))
