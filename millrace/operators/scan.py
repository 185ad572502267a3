"""The nearest known values before and after each row of a series of any length.

A window over one series is one task. Here Spark range-partitions the rows by series and place, so a long series lies in many slots; windows
look within a slot, and one row per slot and series carries the last known value forwards and the first known one
backwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.held import held

#: Rows of a slot, at most, about.
SLOT_ROWS = 100_000


def neighbours(df: DataFrame, order: Sequence[str], known: Column, keys: Sequence[str] = (), slot_rows: int = SLOT_ROWS) -> DataFrame:
    """df with `_p` and `_n`: `known` (null: not known) of the nearest row at or before, and at or after, each row in `order` within its
    series; null where there is none. Rows that are equal in `order` may be taken in either order; null keys are a series like others."""
    rows = held(df.withColumn("_known", known))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // slot_rows))
    rows = held(rows.repartitionByRange(parts, *keys, *order).withColumn("_slot", F.spark_partition_id()))
    group = [*keys, "_slot"]
    rows = rows.withColumns(dict(zip(("_p", "_n"), _sides(F.col("_known"), group, order, 0), strict=True)))
    # a row per slot and series
    place = F.when(F.col("_known").isNotNull(), F.struct(*order))
    ends = rows.groupBy(*group).agg(F.max_by("_known", place).alias("_last"), F.min_by("_known", place).alias("_first"))
    left, right = _sides(F.col("_last"), keys, ["_slot"], -1)[0], _sides(F.col("_first"), keys, ["_slot"], -1)[1]
    ends = ends.withColumns({"_from_left": left, "_from_right": right})
    ends = held(ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_s"), "_from_left", "_from_right"))
    meet = F.col("_slot") == F.col("_s")
    for i, k in enumerate(keys):
        meet = meet & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ends, meet).select(*df.columns, F.coalesce("_p", "_from_left").alias("_p"), F.coalesce("_n", "_from_right").alias("_n"))


def _sides(known: Column, keys: Sequence[str], order: Sequence[str], end: int) -> tuple[Column, Column]:
    """Last known value of the rows up to `end` (0: this one, -1: the one before), and the same from the other side. Both run forwards through
    a sorted series: a frame that reaches to the series' end would be read anew for each row."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    last = F.last(known, ignorenulls=True)
    frame = lambda o: last.over(group.orderBy(*o).rowsBetween(Window.unboundedPreceding, end))
    return frame([F.asc(c) for c in order]), frame([F.desc(c) for c in order])


def window_neighbours(df: DataFrame, order: Sequence[str], known: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The same by a window per series, for series that a task can hold."""
    return df.withColumns(dict(zip(("_p", "_n"), _sides(known, keys, order, 0), strict=True)))
