"""Places in a whole table's order, without bringing the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.held import held

#: Rows up to which one task may number them.
ONE_TASK = 100_000


def numbered(df: DataFrame, orders: dict[str, list[Column]], one_task: int = ONE_TASK) -> DataFrame:
    """df, which is held, with a column per entry of `orders`: the row's place, from 1, in that order (which must be total).

    Up to `one_task` rows a window numbers them. Beyond, Spark range-partitions the rows by the order; a row's place is its
    place in its partition and the rows of the partitions before, of which there is one count per partition."""
    if df.limit(one_task + 1).count() <= one_task:
        return df.withColumns({n: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*o)).cast("long") for n, o in orders.items()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, order in orders.items():
        # in sorted partitions, monotonically_increasing_id is the partition and the place in it
        df = held(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
        df = df.withColumn("_p", F.shiftright("_m", 33))
        before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counts = df.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        df = df.join(F.broadcast(counts), "_p")  # a row per partition
        df = df.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_before")
    return df
