"""Order lines as a stream: new files are cleaned, scored against static tables, flagged and routed. An extension: the
batch plan has no streaming part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import schemas
from millrace.operators.quality import flag_lines, route
from millrace.plans.procurement import fuzzy_scores, stage_orders


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    raw = spark.readStream.schema(schemas.ORDERS).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return stage_orders(raw.withColumn("filename", F.col("_metadata.file_path")))


def route_stream(lines: DataFrame, seed: DataFrame, vendors: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to out/valid, out/nonproduct and out/exceptions. A batch that is repeated after a failure replaces its
    own folder, so that no line is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            flagged = flag_lines(kept, seed, fuzzy_scores(kept, seed, vendors))
            for name, df in route(flagged).items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            kept.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_spend(lines: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Spend by cost centre and day of entry; lines later than `late` are left out."""
    return lines.withColumn("ts", F.col("created_timestamp").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "cost_centre_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("spend"), F.count(F.lit(1)).alias("lines"))
