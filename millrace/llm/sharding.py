"""Sharding by extendible hashing.

A document's address is a string of hash bits. The directory starts with one bucket of all documents; only a bucket over
the byte limit splits on its next bit, until every bucket fits. So shards near the limit stay whole while dense
regions of the hash space go deeper.

Bits come from the MD5 of the key and, beyond KEY_BITS, from a hash of the text and of a serial number among equal rows, so
that rows with one key, even a third of all rows, still split. Each round looks LEVELS bits ahead: bytes are added
up per address at the deepest level in the tasks, before the shuffle, and the levels above follow from these sums.
Documents themselves are not moved before their shards are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, written

SHARD_BYTES = 1 << 20
KEY_BITS, LEVELS = 60, 12


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows: h1, h2 (hash bits), n_bytes, n_rows (may be pre-aggregated). Returns depth, p1, p2 (the first `depth` bits,
    KEY_BITS of them in p1), shard_bytes, shard_rows of every bucket of the final directory.

    A bucket fits if it holds at most `limit` bytes or a single row."""
    done: DataFrame | None = None
    opened, depth = rows, 0
    while depth < 2 * KEY_BITS:
        top = min(depth + LEVELS, KEY_BITS if depth < KEY_BITS else 2 * KEY_BITS)
        fine = cut(opened.groupBy(*_prefix(top)).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows")))
        # below an open bucket lie at most 2**LEVELS addresses: one shuffle by open bucket serves the sums of all levels
        at = lambda d: (F.shiftright("p1", min(top, KEY_BITS) - min(d, KEY_BITS)), F.shiftright("p2", top - d) if d > KEY_BITS else F.lit(0).cast("long"))  # noqa: E731, B023
        fine = fine.withColumns(dict(zip(("o1", "o2"), at(depth), strict=True))).repartition("o1", "o2")
        tries = []
        for d in range(depth, top + 1):
            q1, q2 = at(d)
            within = Window.partitionBy("o1", "o2", q1, q2)
            size, n = F.sum("n_bytes").over(within), F.sum("n_rows").over(within)
            fine = fine.withColumns({f"b{d}": size, f"r{d}": n})
            fits = (F.col(f"b{d}") <= limit) | (F.col(f"r{d}") <= 1) | F.lit(d == 2 * KEY_BITS)
            tries.append(F.when(fits, F.struct(F.lit(d).alias("depth"), q1.alias("p1"), q2.alias("p2"), F.col(f"b{d}").alias("shard_bytes"), F.col(f"r{d}").alias("shard_rows"))))
        where = cut(fine.select("p1", "p2", F.coalesce(*tries).alias("b")))
        found = where.where("b is not null").select("b.*").distinct()
        done = found if done is None else done.unionByName(found)
        left = where.where("b is null").select("p1", "p2")
        left = cut(left)
        if left.isEmpty():
            break
        opened = rows.withColumns(dict(zip(("p1", "p2"), _prefix(top), strict=True))).join(left, ["p1", "p2"], "left_semi").drop("p1", "p2")
        depth = top
    assert done is not None
    return cut(done)


def _prefix(depth: int) -> list:
    """The first `depth` bits of an address, as two longs."""
    first = F.shiftright("h1", KEY_BITS - min(depth, KEY_BITS)).alias("p1")
    second = F.shiftright("h2", 2 * KEY_BITS - depth).alias("p2") if depth > KEY_BITS else F.lit(0).cast("long").alias("p2")
    return [first, second]


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """`id_col`, n_bytes (of the text), depth, prefix (first `depth` bits of the key's hash as a number), split (bits
    beyond the key's, 0 if there are none) and shard_bytes, one row per input row.

    No shard of more than one row exceeds `limit` bytes of text. A null text has no bytes; a null key is a key like any
    other; a text above the limit is a shard of its own. Rows with the same key part by text, equal rows by a serial number, so
    that the shards do not depend on how the input is split. Other columns are left out, whatever their names. An
    empty input gives no rows.
    """
    return _shards(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), limit, []).withColumnRenamed("id", id_col)


def _serial(rows: DataFrame) -> DataFrame:
    """rows: h1, t, p (number of the input's part). With `serial`, from 0 among rows of equal h1 and t: counts of the parts
    before a row's, and its place in its own part, so that no task sees all copies of a hot row."""
    key = ["h1", "t"]
    counts = rows.groupBy(*key, "p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # cut here, so that the join deals out both sides itself and can split a hot row
    place = F.row_number().over(Window.partitionBy(*key, "p").orderBy("h1"))
    return rows.withColumn("place", place).join(cut(counts), [*key, "p"]).withColumn("serial", F.col("before") + F.col("place") - 1).drop("before", "place", "p")


def _shards(df: DataFrame, limit: int, carry: list[str]) -> DataFrame:
    """df: id, text and the columns of `carry`."""
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = df.select(
        "id", *carry,
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(key), 1, KEY_BITS // 4), 16, 10).cast("long").alias("h1"),
        F.xxhash64("text").alias("t"), F.spark_partition_id().alias("p"),
    )
    rows = _serial(cut(rows)).withColumn("h2", F.xxhash64("t", "serial").bitwiseAND(F.lit((1 << KEY_BITS) - 1))).drop("t", "serial")
    rows = cut(rows)
    found = directory(rows.select("h1", "h2", "n_bytes", F.lit(1).cast("long").alias("n_rows")), limit)
    # each depth in use is one equi-join key; there are few of them
    depths = found.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).select("depth")
    depths = [r[0] for r in depths.collect()]  # at most 2 * KEY_BITS + 1 values
    if not depths:
        return rows.select("id", *carry, "n_bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("split"), F.lit(0).cast("long").alias("shard_bytes")).limit(0)
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), *_prefix(d)) for d in sorted(depths)])
    named = rows.select("id", *carry, "n_bytes", F.explode(tries).alias("a")).select("id", *carry, "n_bytes", "a.*")
    out = named.join(found.withColumnRenamed("depth", "d"), (F.col("depth") == F.col("d")) & (named["p1"] == found["p1"]) & (named["p2"] == found["p2"]))
    return out.select("id", *carry, "n_bytes", F.col("depth").cast("int").alias("depth"), named["p1"].alias("prefix"), named["p2"].alias("split"), "shard_bytes")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> None:
    """Parquet with one folder per shard, all rows and columns as they are: rows are numbered first and meet their shards by
    that number, so repeated and null ids are rows like any other. The folders' column is `shard`, with underscores
    behind it if the input has a column of that name. An empty input leaves no folder of a shard."""
    own = {f"in_{k}": c for k, c in enumerate(df.columns)}
    held = df.select(*[F.col(c).alias(k) for k, c in own.items()], F.monotonically_increasing_id().alias("u"))
    held, place = written(held, "numbered")
    name = {c: k for k, c in own.items()}
    where = _shards(held.select(F.col(name[id_col]).alias("id"), F.col(name[text_col]).alias("text"), "u"), limit, ["u"])
    shard = "shard"
    while shard in df.columns:
        shard += "_"
    where = where.select("u", F.concat_ws("-", "depth", "prefix", "split").alias("s"))
    out = held.join(where, "u").select(*[F.col(k).alias(c) for k, c in own.items()], F.col("s").alias(shard))
    out.repartition(shard).write.partitionBy(shard).parquet(path)
    drop(df.sparkSession, place)


def oracle_sql(limit: int = SHARD_BYTES, levels: int = 24) -> str:
    """The same directory over `documents` in DuckDB: bytes of every bucket at every depth, then the first that fits."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {KEY_BITS // 4}))::BIGINT AS h1
  FROM documents),
l AS (
  SELECT d.*, s.depth, CASE WHEN s.depth = 0 THEN 0 ELSE h1 >> ({KEY_BITS} - s.depth) END AS prefix
  FROM d, (SELECT unnest(range(0, {levels})) AS depth) s),
b AS (
  SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, CAST(min(l.depth) AS INTEGER) AS depth, CAST(arg_min(l.prefix, l.depth) AS BIGINT) AS prefix,
       CAST(0 AS BIGINT) AS split, CAST(arg_min(b.shard_bytes, l.depth) AS BIGINT) AS shard_bytes
FROM l JOIN b USING (depth, prefix) WHERE b.shard_bytes <= {limit} OR b.shard_rows = 1
GROUP BY l.doc_id, l.n_bytes"""
