"""Writers: tables, views, CSV exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("bronze", "staging", "silver", "gold", "seeds")


def create_schemas(spark: SparkSession, prefix: str = "dev") -> None:
    for layer in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}_{layer}")


def materialize(df: DataFrame, layer: str, name: str, prefix: str = "dev", partition_by: list[str] | None = None) -> DataFrame:
    """Full refresh of a Parquet table; the table as read back."""
    writer = df.write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.saveAsTable(f"{prefix}_{layer}.{name}")
    return df.sparkSession.table(f"{prefix}_{layer}.{name}")


def view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def export_csv(df: DataFrame, folder: str, name: str, one_file: bool = False) -> str:
    """CSV with a header below folder/name. Written in parallel unless one file is asked for, which is for small tables."""
    path = f"{folder}/{name}"
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def export_ordered(df: DataFrame, path: str, order: list[Column | str], parts: int | None = None, kind: str = "csv") -> str:
    """A table in a total order, written in parallel: each task writes a range of the order, and files named in that order follow one
    another, so that reading them by name gives the sorted table. kind: csv (one header, in a file that comes first), json
    (an object a line). Nulls are empty in CSV and left out in JSON."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    if kind == "json":
        rows.write.mode("overwrite").json(path)
        return path
    rows.write.mode("overwrite").csv(path, header=False, escape='"')
    quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n\r') else c for c in df.columns]
    _put(df.sparkSession, f"{path}/header.csv", ",".join(quoted) + "\n")
    return path


def _put(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def by_key(df: DataFrame, path: str, keys: list[str], sort: list[str], kind: str = "json") -> None:
    """One folder per key value, rows in order within each, as JSON lines or CSV with a header a file."""
    writer = df.repartition(*keys).sortWithinPartitions(*keys, *sort).write.mode("overwrite").partitionBy(*keys)
    writer.json(path) if kind == "json" else writer.csv(path, header=True, escape='"')


def export_layer(tables: Mapping[str, DataFrame], layer: str, folder: str, target: str = "dev") -> list[str]:
    """Exports <layer>_<name> for each table. Bronze and silver only go out from the dev target."""
    if layer in ("bronze", "silver") and target != "dev":
        return []
    return [export_csv(df, folder, f"{layer}_{n}") for n, df in tables.items()]


def export_staged(df: DataFrame, folder: str, name: str = "stg_orders") -> str:
    """A staging table, under its own name."""
    return export_csv(df, folder, name)


def overwrite_seed(df: DataFrame, path: str, key: str = "sku_id") -> None:
    """Replaces the seed at `path` by df, in order of its key. df may have been read from there. The new seed is complete before the old one
    is moved aside, and that one goes last: a writer that dies leaves a whole seed at `path`, or, between two renames, beside it, where the
    next call finds it. Readers that must not see that moment read a VersionedTable."""
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.orderBy(key).coalesce(1).write.mode("overwrite").csv(new, header=True, escape='"')
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    fs.delete(at(old), True)
    for source, target in ((path, old), (new, path)):
        if fs.exists(at(source)) and not fs.rename(at(source), at(target)):
            raise OSError(f"cannot rename {source} to {target}")
    fs.delete(at(old), True)


def restored_seed(spark: SparkSession, path: str) -> str:
    """`path`, after a writer that died between its renames has been made up for: the new seed was complete by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    if not fs.exists(at(path)):
        whole = new if fs.exists(at(f"{new}/_SUCCESS")) else old
        if not fs.rename(at(whole), at(path)):
            raise FileNotFoundError(path)
    return path


def export_named(spark: SparkSession, name: str, folder: str, layer: str, prefix: str = "dev") -> str:
    return export_csv(spark.table(f"{prefix}_{layer}.{name}"), folder, f"{layer}_{name}")


def export_status(spark: SparkSession, target: str) -> DataFrame:
    """One row: whether exports are on for the target."""
    return spark.range(1).select(F.lit("EXPORTED" if target == "dev" else "SKIPPED").alias("status"), F.lit(target).alias("target"))


def curation_csv(df: DataFrame, folder: str, day: dt.date) -> str:
    flat = df.withColumn("raw_names", F.array_join("raw_names", ",")).drop("canonical_tokens")
    return export_csv(flat, folder, f"sku_name_curation_{day:%Y%m%d}", one_file=True)


def partitioned_json(df: DataFrame, path: str, keys: list[str], sort: list[str]) -> None:
    """One folder per key value, rows in order within each."""
    by_key(df, path, keys, sort)
