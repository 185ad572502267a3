"""Approximate nearest neighbours by largest inner product, with shifted space-filling curves.

Vectors are projected by several random rotations to a few dimensions and shifted; each rotation orders them along a
Hilbert curve. Spark range-partitions every order, so that each vector has a rank on each curve. A query looks at the
blocks of ranks around its own on every curve; what the blocks find is merged and reranked by exact inner products in
double precision.

How far to look is calibrated: a bounded sample of queries is held against all rows, in blocks, and the reach grows until
the sample's true neighbours are found at the wanted rate. So recall holds at any size, and the work follows
from how clustered the vectors are. Where the calibration is told to look everywhere, the search is exact.

Equal vectors form one class, searched once, so that a vector with very many copies costs no more than any other. A
class keeps its k+1 smallest ids: no answer can hold more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, map_batches

NEIGHBOURS = 20
CURVES, DIMENSIONS, BITS = 16, 6, 6
#: Query vectors of the calibration sample, rows that fit the scales, and the recall to reach on the sample.
SAMPLE_QUERIES, SAMPLE_ROWS, SAMPLE_RECALL = 160, 4000, 0.95
#: Rows of a block, at least and at most; between, half the reach.
BLOCK = (256, 8192)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of integer coordinates (0 to 2**bits - 1) along the Hilbert curve, by Skilling's transform:
    undo the rotations from the coarsest bit on, Gray-encode, interleave."""
    axes = [c.copy() for c in cells.T.astype(np.int64)]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(len(axes)):
            far = (axes[k] & q) != 0
            swap = np.where(far, 0, (axes[0] ^ axes[k]) & low)
            axes[0] ^= np.where(far, low, swap)
            axes[k] ^= swap
        q >>= 1
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    turn = np.zeros_like(axes[0])
    q = top
    while q > 1:
        turn ^= np.where((axes[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ turn) >> bit) & 1
    return key


class Curves:
    """The rotations, shifts and scales of all curves."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(dims, width)
        self.bits, self.axes, self.low, self.step = bits, [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
            seen = sample @ axes
            mid, spread = seen.mean(0), np.maximum(seen.std(0), 1e-9)
            self.axes.append(axes)
            self.low.append(mid - spread * (3 + rng.uniform(-0.4, 0.4, dims)))
            self.step.append(6 * spread / (1 << bits))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for axes, low, step in zip(self.axes, self.low, self.step, strict=True):
            cells = np.clip(np.nan_to_num((vectors @ axes - low) / step), 0, (1 << self.bits) - 1)
            out.append(hilbert_keys(cells.astype(np.int64), self.bits))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row: highest score, then smallest id. No tie at the border is lost."""
    n = scores.shape[1]
    if n > k:
        border = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= border[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _classes(df: DataFrame, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, int]:
    """cid (smallest id), v, members (up to k+1 smallest ids), for each distinct vector that takes part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0)).select("id", F.transform("v", lambda x: x + x * 0).alias("v"))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return rows.select(F.col("id").alias("cid"), "v", F.array("id").alias("members")), 0
    rows = rows.where(F.size("v") == width[0]).withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v")})
    rows = rows.groupBy("id").agg(F.min_by(F.struct("k1", "k2", "v"), F.struct("k1", "k2")).alias("r")).select("id", "r.*")
    first = Window.partitionBy("k1", "k2").orderBy("id")
    few = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)  # limited before the shuffle, too
    out = few.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.min_by("v", "id").alias("v"), F.sort_array(F.collect_list("id")).alias("members"))
    return cut(out.select("cid", "v", "members")), width[0]


def left_out(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """reason, length, n: rows that take no part in a search, and by their vectors' length the others, of which the most common
    length (the smaller of equals) takes part."""
    v = F.col(vector_col)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(F.col(id_col).isNull(), "no id").when(v.isNull() | (F.size(v) == 0), "no vector").when(broken, "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("length")
    return df.select(reason.alias("reason"), F.when(reason == "length", F.size(v)).alias("length")).groupBy("reason", "length").agg(F.count(F.lit(1)).alias("n"))


def _sampled(df: DataFrame, purpose: str, total: int, rows: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of cid, at most twice as many. No task sends more than its share.
    Small samples are widened, so that none comes out empty."""
    span = 1 << 30
    rate = span if total <= 2 * rows else int(span * 1.2 * rows / total)
    return df.where(F.pmod(F.xxhash64(F.lit(purpose), F.col("cid")), F.lit(span)) < rate).limit(2 * rows)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, recall: float = SAMPLE_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `is_query`, its k nearest found among all other rows,
    by inner product, ties to the smaller id; all of them, if fewer.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another
    length than the most common; left_out() counts them. Ids are whole numbers, or text that spells them; other text fails. Rows without an id take no part. An id given more than once counts once, with
    one of its vectors chosen by hash. Other columns are left out, whatever their names. An empty input gives no rows.
    """
    spark = df.sparkSession
    classes, width = _classes(df, id_col, vector_col, k)
    total = classes.count() if width else 0
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], schema)
    asked = df.where(is_query).select(F.col(id_col).cast("long").alias("q")).where("q is not null").distinct()
    # a query's class is found by its id among the rows that take part, not among the few members kept
    vectors = df.select(F.col(id_col).cast("long").alias("q"), F.col(vector_col).alias("v")).join(asked, "q", "left_semi")
    usable = F.size("v") == width
    vectors = vectors.where(usable & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select("q", F.transform("v", lambda x: x + x * 0).alias("v"))
    vectors = vectors.select("q", F.xxhash64("v").alias("k1"), F.hash("v").alias("k2")).groupBy("q").agg(F.min(F.struct("k1", "k2")).alias("r")).select("q", "r.*")
    of_class = cut(vectors.join(classes.select(F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), "cid"), ["k1", "k2"]).select("q", "cid"))
    query_ids = of_class.select("cid").distinct()

    sample = _sampled(classes.select("cid", "v"), "fit", total, SAMPLE_ROWS).collect()
    curves = Curves(np.array([r[1] for r in sample], np.float64))
    sent = spark.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for c, key in enumerate(sent.value.keys(_matrix(b.column(1), width))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), b.column(0)], names=["curve", "key", "cid"])

    placed = map_batches(classes.select("cid", "v"), place, "curve int, key bigint, cid bigint")
    parts = max(2 * CURVES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartitionByRange(parts, "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid")
    # in the sorted order, monotonically_increasing_id is the partition and the place in it
    ordered = cut(ordered.select("curve", "cid", F.monotonically_increasing_id().alias("m")).select("curve", "cid", F.shiftright("m", 33).alias("p"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    before, offsets = 0, []
    for p, n in sorted(ordered.groupBy("p").count().collect()):  # one row per partition
        offsets.append((p, before))
        before += n
    base = spark.createDataFrame(offsets, "p bigint, before bigint")
    ranks = ordered.join(F.broadcast(base), "p").select("curve", "cid", (F.col("before") + F.col("i") - F.col("curve") * F.lit(total)).alias("r"))

    reach = _calibrate(classes, query_ids, ranks, width, total, k, recall)
    block = int(np.clip(-(-reach // 2), *BLOCK))
    sides = -(-reach // block)
    last = (total - 1) // block
    in_block = F.floor(F.col("r") / block).cast("long")
    queries = ranks.join(query_ids, "cid").select("curve", in_block.alias("own"), "cid")
    look = F.sequence(F.greatest(F.col("own") - sides, F.lit(0)), F.least(F.col("own") + sides, F.lit(last)))
    queries = queries.select("curve", F.explode(look).alias("block"), F.col("cid").alias("q")).join(classes.select(F.col("cid").alias("q"), "v"), "q")
    rows = ranks.select("curve", in_block.alias("block"), "cid").join(classes.select("cid", "v"), "cid")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            q, ids = left["q"].to_numpy(), right["cid"].to_numpy()
            x, y = _matrix(left["v"].combine_chunks(), width), _matrix(right["v"].combine_chunks(), width)
            for lo in range(0, len(q), 256):
                scores = x[lo : lo + 256] @ y.T
                row, col = _top(scores, ids, k + 1)
                for out, values in zip(found, (q[lo + row], ids[col], scores[row, col]), strict=True):
                    out.append(values)
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(f) if f else [], t) for f, t in zip(found, types, strict=True)], names=["q", "cid", "score"])

    found = fresh(queries).groupBy("curve", "block").cogroup(fresh(rows).groupBy("curve", "block")).applyInArrow(meet, "q bigint, cid bigint, score double")
    found = found.groupBy("q", "cid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    answers = found.join(classes.select("cid", "members"), "cid").select("q", F.explode("members").alias("vec_id"), "score")
    pairs = of_class.select(F.col("q").alias("query_id"), F.col("cid").alias("q")).join(answers, "q").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(classes: DataFrame, query_ids: DataFrame, ranks: DataFrame, width: int, total: int, k: int, recall: float) -> int:
    """The smallest reach, in ranks, that finds `recall` of a query sample's true neighbours on some curve."""
    spark = classes.sparkSession
    picked = _sampled(query_ids, "calibrate", query_ids.count(), SAMPLE_QUERIES)
    rows = classes.join(F.broadcast(picked), "cid").select("cid", "v").collect()
    if not rows:
        return 1
    q = np.array([r[0] for r in rows])
    sent = spark.sparkContext.broadcast((q, np.array([r[1] for r in rows], np.float64)))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, x = sent.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo in range(0, len(ids), 4096):
                part = b.slice(lo, 4096)
                scores = x @ _matrix(part.column(1), width).T
                own = ids[lo : lo + 4096]
                scores[qs[:, None] == own[None, :]] = -np.inf
                row, col = _top(scores, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(qs[row]), pa.array(own[col]), pa.array(scores[row, col])], names=["q", "cid", "score"])

    near = map_batches(classes.select("cid", "v"), brute, "q bigint, cid bigint, score double").where(F.col("score") > float("-inf"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    truth = near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select("q", "cid").collect()
    if not truth:
        return 1
    wanted = spark.createDataFrame([(int(c),) for c in {*q.tolist(), *(r[1] for r in truth)}], "cid bigint")
    at: dict[int, dict[int, int]] = {}
    for curve, cid, r in ranks.join(F.broadcast(wanted), "cid").select("curve", "cid", "r").collect():  # sample x k x curves
        at.setdefault(cid, {})[curve] = r
    gaps = sorted(min(abs(at[a][c] - at[b][c]) for c in at[a]) for a, b in truth)
    return max(1, gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)])
