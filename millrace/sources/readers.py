"""Readers. File readers add `filename`, the file that a row came from."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas


def _with_name(df: DataFrame, filename: bool) -> DataFrame:
    return df.withColumn("filename", F.col("_metadata.file_path")) if filename else df


def csv(spark: SparkSession, path: str, schema: str, filename: bool = True) -> DataFrame:
    return _with_name(spark.read.schema(schema).csv(path, header=True, quote='"', escape='"'), filename)


def json_arrays(spark: SparkSession, path: str, schema: str, filename: bool = True) -> DataFrame:
    """Files (a path may be a pattern) that hold one array of objects each, over many lines."""
    return _with_name(spark.read.schema(schema).json(path, multiLine=True), filename)


def json_lines(spark: SparkSession, path: str, schema: str, filename: bool = False) -> DataFrame:
    return _with_name(spark.read.schema(schema).json(path), filename)


def seed(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.SEED, filename=False)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, nulls as empty text."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"').na.fill("")


def table_or_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The table if the catalog has it, else its CSV export."""
    try:
        return spark.table(name)
    except AnalysisException:
        return spark.read.csv(path, header=True, inferSchema=True)


def source_files(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("hidden",)) -> DataFrame:
    """label (file name), value (path), n_bytes of every file below a folder, by name; without hidden files and folders (a
    name that begins with a dot) and folders named in `skip`. Only paths and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("value"), F.col("length").alias("n_bytes"))
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z0-9]+:(//[^/]*)?", "")
    root = bare(F.lit(folder.rstrip("/")))
    below = F.split(F.substr(bare(F.col("value")), F.length(root) + 2), "/")
    hidden = F.exists(below, lambda p: p.startswith(".") | p.isin(*skip))
    return files.where(~hidden).select(F.element_at(F.split("value", "/"), -1).alias("label"), "value", "n_bytes").orderBy("label", "value")


def required_tables(spark: SparkSession, names: list[str]) -> dict[str, int | None]:
    """Rows of each table, None for one that is not there."""
    return {n: spark.table(n).count() if spark.catalog.tableExists(n) else None for n in names}


def preview(df: DataFrame, k: int = 10) -> DataFrame:
    """Some rows, in no particular order."""
    return df.limit(k)
