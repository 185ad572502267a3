"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII blanks: space, and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Text bytes that one numpy pass takes at a time; bounds the temporaries of a Python worker.
PASS_BYTES = 1 << 21
#: What a task that writes Parquet holds of its rows.
WRITE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id's decimal text has remainder 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def without_gc(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f with Python's garbage collector off while it runs, for millions of small lists without cycles; workers are used
    again, so it is switched back on."""

    def run(batches: Iterator) -> Iterator:
        on = gc.isenabled()
        gc.disable()
        try:
            yield from f(batches)
        finally:
            if on:
                gc.enable()

    return run


def by_bytes(texts: list, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows whose texts hold about `limit` bytes together; a longer text is a range of its own."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, which all executors share. The cluster names it in
    spark.checkpoint.dir; only a local session without that setting (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            place = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows, written once as Parquet to the shared folder and read again: as cut, with columns pruned on reading.
    And the folder, to be dropped when nothing reads it any more."""
    place = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", WRITE_BYTES).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def drop(spark: SparkSession, place: str) -> None:
    """Deletes a folder by Spark's own file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect what nothing refers to any more: with it Spark drops the shuffle files and checkpoints of
    finished steps, which otherwise stay on the disks until the driver happens to collect."""
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, hinted for broadcast if it has at most `rows` rows; df is cut, so counting it is cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sampled_rows(df: DataFrame, group: str, key: str, per_group: int) -> DataFrame:
    """About `per_group` rows of each value of `group`, chosen by a hash of `key`: the same rows in every run; more, if keys repeat.

    One pass counts the groups (one row per value reaches the driver; values are few: languages or classes),
    a second keeps a row when its hash falls under the group's rate.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    if not counts:
        return df.where(F.lit(False))
    span = 1 << 30
    rate = F.lit(0)
    for value, n in counts.items():
        rate = F.when(F.col(group) == value, F.lit(min(span, int(span * per_group / n)))).otherwise(rate)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(span)) < rate)


def bounded_texts(rows: DataFrame, group: str, key: str, text: str, most: int, total: int) -> list[Row]:
    """At most `most` different rows, in order of a hash, whose texts come to at most `total` bytes, each value of `group` having an
    even share: those that do not fit are left out. Hashes and sizes reach the driver first, then the texts that were chosen."""
    rows = rows.withColumns({"_k": F.xxhash64(F.lit("text"), key, text, group), "_n": F.octet_length(text)})
    sizes = [tuple(r) for r in rows.select("_k", group, "_n").distinct().orderBy("_k").limit(most).collect()]
    share = total // max(1, len({g for _, g, _ in sizes}))
    spent: dict = {}
    chosen = []
    for k, g, n in sizes:
        if spent.get(g, 0) + n <= share:
            spent[g] = spent.get(g, 0) + n
            chosen.append((k,))
    if not chosen:
        return []
    picked = rows.join(F.broadcast(rows.sparkSession.createDataFrame(chosen, "_k bigint")), "_k").drop("_n")
    return picked.dropDuplicates(["_k"]).drop("_k").collect()


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for joins and cogroups of tables with a common past."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def without(df: DataFrame, gone: DataFrame, id_col: str, columns: tuple[str, ...], how: str = "left_anti") -> DataFrame:
    """The rows of df whose id and `columns` are not those of a row of `gone` (id_col, row_hash: xxhash64 of the columns); null ids
    count as equal. Up to 100,000 rows of `gone` are sent to the rows; beyond, rows are dealt out by id and hash."""
    names = small(cut(gone.select(F.col(id_col).alias("_id"), F.col("row_hash").alias("_hash")).distinct()))
    return df.join(names, df[id_col].eqNullSafe(names["_id"]) & (F.xxhash64(*[df[c] for c in columns]) == names["_hash"]), how)
