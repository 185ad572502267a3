"""Mixing sources to target weights, to the word.

Every document gets a hash-random key. Spark range-partitions the documents by source and key, so that a source's documents
lie in random order over as many partitions as they need; running sums of sizes within a partition and one carry per
partition and source give each document its place in words. Where a source's budget goes past its size, all of it is taken
again; the rest of the budget cuts the random order at one exact word.

Budgets come from weights: shares that would go beyond a source's cap stop there, and what they leave is dealt to the others by
weight, again and again, by aggregates over one row per source.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.ranks import numbered

from .common import cut, map_batches, small

#: Weights of the sources in order, repeating; words of the mix for each word of the corpus; how often a source may come.
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Rows of a range partition, at most, about.
PART_ROWS = 100_000
SEED = "mix|"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII blanks; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds weight and target (double, in words).

    Sources get `weights` in order of code points, null last, repeating. Together they share `share` times all sizes by weight;
    no target exceeds `most` times its source's size, and what that leaves goes to the others by weight. If all are at
    their caps, the mix stays smaller. Comparisons are exact; the level of the shares is a fraction of whole numbers."""
    s = numbered(cut(sizes), {"_no": [F.asc_nulls_last("source")]})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = cut(s.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("_cap")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level: tuple[int, int] | None = None  # a weight of 1 gets level[0] / level[1] words
    number = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
    above = lambda: F.lit(False) if level is None else F.col("weight").cast("decimal(19,0)") * number(level[0]) > F.col("_cap").cast("decimal(19,0)") * number(level[1])
    while True:
        x = s.agg(F.sum(F.when(above(), F.col("_cap"))).alias("capped"), F.sum(F.when(~above(), F.col("weight"))).alias("open")).first()
        if not x["open"]:
            break
        new = (share.numerator * total - share.denominator * (x["capped"] or 0), share.denominator * x["open"])
        if new == level:
            break
        level = new
    free = F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1])) if level else F.lit(0.0)
    return s.withColumn("target", F.when(above(), F.col("_cap").cast("double")).otherwise(free)).drop("_cap")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range partition: adds the partition's number and the sizes before a row in it, of its source."""
    part, last, so_far = TaskContext.get().partitionId(), (), 0
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column("source").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first, end = b.column("source")[0].as_py(), b.column("source")[-1].as_py()
        size = b.column("size").to_numpy()
        sums = np.cumsum(size) - size
        starts = np.concatenate([[True], code[1:] != code[:-1]])
        at = np.maximum.accumulate(np.where(starts, np.arange(len(size)), 0))
        before = sums - sums[at]
        if last and last[0] == first:
            before[at == 0] += so_far
        so_far, last = int(before[-1] + size[-1]), (end,)
        yield b.append_column("part", pa.array(np.full(b.num_rows, part, np.int64))).append_column("before", pa.array(before))


def _mixed(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: Fraction, most: int, seed: str, carry: dict[str, Column]) -> DataFrame:
    """id, source, size, source_size, target, taken and the columns of `carry`."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))).alias("key"), *[c.alias(n) for n, c in carry.items()])
    rows = cut(rows)  # texts are read once
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    order = [F.asc_nulls_last("source"), F.asc_nulls_last("key"), "size"]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", part long, before long"
    ranged = cut(map_batches(ranged, _running, schema))
    # one row per partition and source: the words of the source in the partitions before
    sums = ranged.groupBy("part", "source").agg(F.sum("size").alias("here"))
    across = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("carried", F.coalesce(F.sum("here").over(across), F.lit(0))).drop("here")
    plan = plan.withColumn("budget", F.floor("target").cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"))
    plan = cut(sums.join(small(cut(plan)), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s").withColumnRenamed("part", "_p"))
    out = ranged.join(small(plan), (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("carried") - F.col("before")))
    return out.select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + once_more).alias("taken"), *carry)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per input row: `id_col`, source, size (words), source_size, target, taken (words that the mix takes, repeats
    counted). A source's taken words are its target, less the part of a word; a document's at most `most` times its
    size.

    Sizes of null and blank texts are 0; they and sources of size 0 are taken 0 times. Null sources are one source, the last;
    a null id comes after all others in its source's order. Rows that repeat an id are in order of their size, and such of one
    size get the same columns in either order, so that reruns agree. Very long texts are counted whole and may be cut in the middle. A
    hot source lies in as many partitions as its rows need. Columns of other names are left out. An empty input gives no
    rows."""
    out = _mixed(df, id_col, text_col, source_col, weights, share, most, seed, {})
    return out.withColumnRenamed("id", id_col)


def draw(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: `id_col`, source, epoch (from 1), words, text; a row each time that a document is taken. The last time a
    document may come in part: then its first words, joined by single spaces. Documents without words do not come."""
    d = _mixed(df, id_col, text_col, source_col, weights, share, most, seed, {"text_": F.col(text_col)}).where("taken > 0")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    part = F.array_join(F.slice(F.filter(F.split("text_", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), words.cast("int")), " ")
    return d.select(F.col("id").alias(id_col), "source", F.col("epoch").cast("int").alias("epoch"), words.alias("words"), F.when(words < F.col("size"), part).otherwise(F.col("text_")).alias("text"))


def oracle_sql() -> str:
    """The same rows in DuckDB: the level of the shares from the sources in order of cap over weight."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, {MOST} * source_size AS cap, row_number() OVER o AS place, coalesce(sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total FROM s WINDOW o AS (ORDER BY {MOST} * source_size / w, source)),
v AS (SELECT *, {SHARE.numerator} * total - {SHARE.denominator} * capped AS num, {SHARE.denominator} * open AS den FROM c),
f AS (SELECT * FROM v WHERE num * w <= cap * den ORDER BY place LIMIT 1),
t AS (SELECT v.source, v.source_size, CASE WHEN v.place < coalesce(f.place, 1000000000) THEN CAST(v.cap AS DOUBLE) ELSE CAST(f.num AS DOUBLE) * v.w / CAST(f.den AS DOUBLE) END AS target FROM v LEFT JOIN f ON true),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, budget - epochs * source_size AS rest FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target, CAST(b.epochs * p.size + greatest(0, least(p.size, b.rest - p.before)) AS BIGINT) AS taken FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source"""
