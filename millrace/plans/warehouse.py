"""The star schema as tables that are laid out for the joins and filters of the questions.

Facts are partitioned by month and bucketed by product, the one dimension that grows beyond a broadcast; products are bucketed alike, so
that lines meet them without an exchange. The calendar carries the month as well: a question's filter on days is
broadcast, and prunes the facts' months before they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.held import release

MONTH, PRODUCT = "month_key", "product_key"


def write(spark: SparkSession, tables: Mapping[str, DataFrame | Iterable[DataFrame]], database: str, names: Iterable[str], buckets: int | None = None) -> dict[str, DataFrame]:
    """Full refresh of the named tables; the tables as read back, by name. Facts without a month or product key are kept: these rows
    lie in the default partition, or in the bucket of null. Buckets default to the number of shuffle partitions. A table may come in
    several shares, which are written one after the other; what a share has shuffled is dropped before the next."""
    names = list(names)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        mode = "overwrite"
        for df in [tables[name]] if isinstance(tables[name], DataFrame) else tables[name]:
            _save(df, name, database, buckets, mode)
            mode = "append"
            release(spark)
    return {name: spark.table(f"{database}.{name}") for name in names}


def _save(df: DataFrame, name: str, database: str, buckets: int, mode: str) -> None:
    if "date_key" in df.columns:
        df = df.withColumn(MONTH, F.floor(F.col("date_key") / 100).cast("int"))
    if PRODUCT in df.columns:  # a task has a bucket, and writes one file of each month
        df = df.repartition(buckets, PRODUCT)
    writer = df.write.mode(mode).format("parquet").option("compression", "zstd")
    if PRODUCT in df.columns:
        writer = writer.bucketBy(buckets, PRODUCT).sortBy(PRODUCT)
    if name.startswith("fct_"):
        writer = writer.partitionBy(MONTH)
    writer.saveAsTable(f"{database}.{name}")
