"""Near-duplicate documents by an LSH forest over MinHash signatures, with every link confirmed on full shingle sets.

Documents with equal shingle sets are one class; only a class's first document goes on. Each tree reads a signature as a
sequence that starts elsewhere in it, and sorts all classes by that sequence; Spark range-partitions all orders at
once. In each order, classes with a common prefix of DEPTH values form a region. Where a region holds at most NEAR + 1 classes, each
meets all others. Where it holds more, its depth grows with it: every class goes down, a value at a time, to the
first prefix that at most NEAR + 1 classes share, and meets those, and its neighbours with the longest common prefix in
any case. Of what it meets in large regions, a class goes on with the NEAREST partners of longest common prefix over all trees.
Candidates are confirmed on the texts, and links contract classes to components.

What deeper prefixes part in large regions is left to an exact step. Large regions that share a class form a cluster.
Only classes outside a cluster's largest component are still open; these are held against the whole
cluster: by signature (at least CLOSE equal values, else no look), then by all shingle hashes, at last by the texts. An
open class needs one link to a component, so at most one is made of it in a block, however many members the component has.

A pair of similarity s shares a tree's prefix with probability s**DEPTH; at 0.75 all trees miss it twice in a million. The
signature filter misses it three times in a million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, drop, fresh, map_batches, without, written
from .components import components

SHINGLE_WORDS = 5
#: Link if 100 * intersection >= 75 * union.
PERCENT = 75
TREES, DEPTH, VALUES = 24, 3, 96
#: Values of a tree's sequence, the tree's number apart; partners in the smallest regions; partners in large ones.
SEQUENCE, NEAR, NEAREST = 7, 6, 4
#: Rows of a partition of the sorted orders; classes and shingles of a block of a cluster.
ORDER_ROWS, BLOCK, BLOCK_SHINGLES = 100_000, 1024, 1_000_000
#: Bytes of text that are hashed at a time, and of two texts above which hashes alone decide a link.
PIECE, EXACT_BYTES = 1 << 20, 8 << 20
#: Equal values of two signatures that call for a look at the texts: 0.75 * 96 less more than four deviations.
CLOSE = 52

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A to Z count as a to z
_FACTOR = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)
_POWERS = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_RADIX = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * n, _RADIX, np.uint64)))
    return _POWERS


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes. Taken in pieces: a word that a piece cuts is put together from its parts."""
    starts, hashes = [], []
    begun, total, length = 0, np.uint64(0), 0  # the word that the last piece left open
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE]
        blank = _BLANK[part]
        inside = ~blank
        at = np.nonzero(inside & np.concatenate([[True], blank[:-1]]))[0]
        if length and not inside[0]:
            starts.append(np.array([begun]))
            hashes.append(_mix(np.array([total]) + np.uint64(length)))
            length = 0
        if not len(at):
            continue
        ends = np.append(np.nonzero(blank & np.concatenate([[False], inside[:-1]]))[0], len(part))[: len(at)]
        base = np.zeros(len(part), np.int64)
        base[at] = at
        place = np.arange(len(part)) - np.maximum.accumulate(base)
        value = _BYTE[part] * _powers(int((ends - at).max()) + 1)[np.where(inside, place, 0)]
        value[blank] = 0
        sums, sizes = np.add.reduceat(value, at), (ends - at).astype(np.uint64)
        at = at + lo
        if length:  # goes on here
            sums[:1] = sums[:1] * np.uint64(pow(_RADIX, length, 1 << 64)) + total
            sizes[0] += np.uint64(length)
            at[0] = begun
            length = 0
        if inside[-1] and lo + PIECE < len(data):
            begun, total, length = int(at[-1]), sums[-1], int(sizes[-1])
            at, sums, sizes = at[:-1], sums[:-1], sizes[:-1]
        starts.append(at)
        hashes.append(_mix(sums + sizes))
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def shingle_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; with fewer words than a shingle has, of all its words."""
    starts, word = _word_hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    size = np.array([len(t) + 1 for t in texts])
    bound = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        w = word[a:b]
        n = len(w)
        if not n:
            out.append(w)
            continue
        k = min(SHINGLE_WORDS, n)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + w[i : n - k + 1 + i])
        out.append(np.unique(h))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash under each of VALUES permutations, cut to 32 bits."""
    low = np.full(VALUES, 2**64 - 1, np.uint64)
    for lo in range(0, len(hashes), 2048):
        part = (hashes[None, lo : lo + 2048] ^ _FLIP[:, None]) * _FACTOR[:, None]
        np.minimum(low, part.min(1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: set size, a 128-bit name of the set, its signature."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for lo, hi in by_bytes(texts, 1 << 20):
            n, a, c, sig = [], [], [], []
            for h in shingle_hashes([(t or "").encode() for t in texts[lo:hi]]):
                n.append(len(h))
                a.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                c.append(int(np.bitwise_xor.reduce(_mix(h)).view(np.int64)) if len(h) else 0)
                sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(sig, pa.binary()), b.column(2).slice(lo, hi - lo)], names=["id", "n", "s1", "s2", "sig", "text_hash"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its number and its SEQUENCE values, packed in order, so that sorting rows sorts sequences."""
    for b in batches:
        if not b.num_rows:
            continue
        s = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, VALUES).astype(np.int64)
        for t in range(TREES):
            v = [np.full(len(s), t), *[s[:, (t * (VALUES // TREES) + k) % VALUES] for k in range(SEQUENCE)]]
            packed = [pa.array(v[k] << 32 | v[k + 1]) for k in range(0, SEQUENCE + 1, 2)]
            yield pa.RecordBatch.from_arrays([*packed, b.column(0)], names=[*_PACKED, "rep"])


_PACKED = ["v0", "v1", "v2", "v3"]
_MET = "kind int, a bigint, b bigint, depth int, " + ", ".join(f"{c} bigint" for c in _PACKED)
#: Kinds of rows: a pair of a small region, a pair of a large one, a class and the first of its large region, a class at a border.
SMALL, LARGE, MEMBER, BORDER = range(4)


def _runs(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a sorted order the number and the size of its run with `depth` common values; common[i] is the
    length of the common prefix of i and the class before it."""
    run = np.cumsum(common < depth) - 1
    return run, np.bincount(run)[run]


def neighbours(packed: list[np.ndarray], rep: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Rows (kind, a, b, depth) of a sorted piece of the orders, and the number of the region that each class is in."""
    n = len(rep)
    common, alike = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in range(SEQUENCE + 1):
        v = packed[k // 2] >> 32 if k % 2 == 0 else packed[k // 2] & 0xFFFFFFFF
        alike &= v[1:] == v[:-1]
        common[1:] += alike
    common = np.maximum(common - 1, 0)  # the tree's number is no value
    region, size = _runs(common, DEPTH)
    out = []

    def pairs(kind: int, run: np.ndarray, on: np.ndarray, reach: int) -> None:
        shared = np.full(n, SEQUENCE)
        for k in range(1, min(reach, n - 1) + 1):
            shared = np.minimum(shared[: n - k], common[k:])
            i = np.nonzero(on[: n - k] & (run[: n - k] == run[k:]))[0]
            out.append((kind, rep[i], rep[i + k], shared[i]))

    pairs(SMALL, region, size <= NEAR + 1, NEAR)
    left = size > NEAR + 1
    if left.any():
        pairs(LARGE, region, left, 1)
        first = np.nonzero(np.concatenate([[True], np.diff(region) != 0]))[0]
        out.append((MEMBER, rep[left], rep[first][region[left]], np.zeros(int(left.sum()), np.int64)))
        for depth in range(DEPTH + 1, SEQUENCE + 1):
            run, size = _runs(common, depth)
            pairs(LARGE, run, left & (size <= NEAR + 1), NEAR)
            left = left & (size > NEAR + 1)
    return out, region


def _batches(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    for kind, a, b, depth, *packed in found:
        if len(a):
            more = [pa.array(c) for c in packed] or [pa.nulls(len(a), pa.int64())] * len(_PACKED)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(depth.astype(np.int32)), *more], names=["kind", "a", "b", "depth", *_PACKED])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of the sorted orders: its rows, and those classes at its ends that may have partners across the
    border, for which b numbers the border."""
    t = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in (*_PACKED, "rep")]))])
    if not t.num_rows:
        return
    packed, rep = [t[c].to_numpy() for c in _PACKED], t["rep"].to_numpy()
    found, region = neighbours(packed, rep)
    yield from _batches(found)
    here = TaskContext.get().partitionId()
    for at, border in ((np.nonzero(region == region[0])[0][: NEAR + 1], here - 1), (np.nonzero(region == region[-1])[0][-NEAR - 1 :], here)):
        yield from _batches([(BORDER, rep[at], np.full(len(at), border), np.zeros(len(at), np.int64), *[c[at] for c in packed])])


def _across(t: pa.Table) -> pa.Table:
    """The classes at the two sides of a border."""
    t = t.sort_by([(c, "ascending") for c in (*_PACKED, "a")])
    found, _ = neighbours([t[c].to_numpy() for c in _PACKED], t["a"].to_numpy())
    return pa.Table.from_batches(list(_batches(found)), pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), *[(c, pa.int64()) for c in _PACKED]]))


def forest(classes: DataFrame, total: int) -> tuple[DataFrame, str]:
    """classes: rep, sig. Rows (kind, a, b, depth) of SMALL, LARGE and MEMBER, and the folder that holds them."""
    parts = max(1, -(-total * TREES // ORDER_ROWS), min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * TREES // 5000))
    keys = [*_PACKED, "rep"]
    orders = map_batches(classes.select("rep", "sig"), _orders, ", ".join(f"{c} bigint" for c in keys))
    met, place = written(map_batches(orders.repartitionByRange(parts, *keys).sortWithinPartitions(*keys), _neighbours, _MET), "forest")
    across = cut(met.where(F.col("kind") == BORDER).groupBy("b").applyInArrow(_across, _MET))
    return met.where(F.col("kind") != BORDER).unionByName(across).select("kind", "a", "b", "depth"), place


def shingles(text: str | None) -> set[tuple[str, ...]]:
    """The exact set."""
    words = (text or "").translate(_LOWER).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    k = min(SHINGLE_WORDS, len(words))
    return set(zip(*(words[i : len(words) - k + 1 + i] for i in range(k)), strict=True)) if k else set()


_LOWER = {c: c + 32 for c in range(65, 91)}


def _similar(x: np.ndarray, y: np.ndarray, texts: Callable[[], tuple[str, str]]) -> bool:
    """Whether two sets link: by their sorted hashes, and where these say so, by the sets of words themselves. Of two
    texts of more than EXACT_BYTES the 64-bit hashes decide."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    if 100 * both < PERCENT * (len(x) + len(y) - both):
        return False
    s, t = texts()
    if len(s) + len(t) > EXACT_BYTES:
        return True
    a, b = shingles(s), shingles(t)
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
        on = []
        for lo, hi in by_bytes([range(len(x) + len(y)) for x, y in zip(xs, ys, strict=True)], 1 << 18):
            mine = [xs[lo], *[xs[k] if xs[k] != xs[k - 1] else None for k in range(lo + 1, hi)]]  # rows come in order of a
            own = None
            for k, x, y in zip(range(lo, hi), _hashed(mine), _hashed(ys[lo:hi]), strict=True):
                own = x if mine[k - lo] is not None else own
                on.append(_similar(own, y, lambda k=k: (xs[k], ys[k])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(on, pa.bool_()))


def _links(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. own: rep, t of these classes."""
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a").join(own.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")
    return cut(map_batches(both.select("a", "b", "ta", "tb"), _confirm, "a bigint, b bigint"))


def _hashed(texts: list) -> list[np.ndarray]:
    return [h for lo, hi in by_bytes(texts, 1 << 20) for h in shingle_hashes([(t or "").encode() for t in texts[lo:hi]])]


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Open classes against a block of their cluster: for each, one confirmed link to every component that it has one to."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        q, qc, qt = left["rep"].to_numpy(), left["comp"].to_numpy(), left["t"].to_pylist()
        r, rc, rt = right["rep"].to_numpy(), right["comp"].to_numpy(), right["t"].to_pylist()
        x = np.frombuffer(b"".join(left["sig"].to_pylist()), "<u4").reshape(-1, VALUES)
        y = np.frombuffer(b"".join(right["sig"].to_pylist()), "<u4").reshape(-1, VALUES).T.copy()
        qs, rs = _hashed(qt), _hashed(rt)
        for k in range(len(q)):
            same = (x[k][:, None] == y).sum(0, dtype=np.int16)
            hit = np.nonzero((same >= CLOSE) & (rc != qc[k]))[0]
            done: set[int] = set()
            for j in hit[np.argsort(-same[hit], kind="stable")].tolist():
                if rc[j] not in done and _similar(qs[k], rs[j], lambda k=k, j=j: (qt[k], rt[j])):
                    done.add(rc[j])
                    a.append(q[k])
                    b.append(r[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """One row per input row: `id_col`, n_shingles, component_id (smallest id reachable over links, itself included) and
    kept (id = component_id); with `named` also text_hash, which together with the id names a row and its copies.

    A null or blank text has no shingles and no links, also not to another such text. Texts shorter than a shingle have
    one, all their words. Equal rows are one node. A row without an id takes no part: its component is null and it is
    kept. Ids are whole numbers, or text that spells them; other text fails. A very long text is hashed in pieces. An id that comes with several texts gets a result for each. Other columns are left out, whatever their names. An empty input gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sets = cut(map_batches(docs.withColumn("x", F.xxhash64("t")), _sets, "id bigint, n bigint, s1 bigint, s2 bigint, sig binary, text_hash bigint"))
    name = ["n", "s1", "s2"]
    classes = sets.where("id is not null and n > 0").groupBy(*name).agg(F.min_by(F.struct("sig", "text_hash"), F.struct("id", "text_hash")).alias("r"), F.min("id").alias("rep"))
    classes = cut(classes.select(*name, "rep", "r.sig", "r.text_hash"))

    met, place = forest(classes, classes.count())
    small = met.where(F.col("kind") == SMALL).select("a", "b")
    # in large regions each class goes on with its nearest ones; the groups hold at most TREES * NEAR partners of a class
    large = met.where(F.col("kind") == LARGE).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"))
    sides = large.unionByName(large.select(F.col("b").alias("a"), F.col("a").alias("b"), "depth"))
    nearest = sides.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "b"))), 1, NEAREST).alias("x")).select("a", F.explode("x.b").alias("b"))
    pairs = cut(_ordered(small.unionByName(nearest)))
    named_text = docs.where("id is not null").select(F.col("id").alias("rep"), F.xxhash64("t").alias("text_hash"), "t")

    def texts_of(reps: DataFrame) -> DataFrame:
        """rep, t of these classes: of a class's equal sets the text that the class was named by."""
        wanted = classes.select("rep", "text_hash").join(reps, "rep")
        return named_text.join(wanted, ["rep", "text_hash"]).dropDuplicates(["rep", "text_hash"]).select("rep", "t")

    needed = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    links = _links(pairs, cut(texts_of(needed)))
    comps = cut(components(links))

    members = met.where(F.col("kind") == MEMBER)
    # a class alone in a region's list is its first; the others lead to it
    clusters = cut(components(members.select("a", "b")))
    drop(df.sparkSession, place)
    inside = clusters.select(F.col("node").alias("rep"), F.col("component").alias("g")).join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    inside = cut(inside.join(classes.select("rep", "n", "sig"), "rep").select("rep", "g", F.coalesce("component", "rep").alias("comp"), "n", "sig"))
    parts = inside.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    whole = parts.groupBy("g").agg(F.sum("size").alias("m"), F.sum("n").alias("n"), F.max(F.struct("size", (-F.col("comp")).alias("c"), "n")).alias("top")).where(F.col("top.size") < F.col("m"))
    cuts = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    whole = whole.select("g", cuts(F.col("m"), F.col("n")).alias("blocks"), cuts(F.col("m") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("shares"), (-F.col("top.c")).alias("main"))
    inside = inside.join(whole, "g")
    if not inside.isEmpty():
        inside = cut(inside.join(texts_of(inside.select("rep").distinct()), "rep"))
        share = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        opened = inside.where(F.col("comp") != F.col("main")).select("g", "rep", "comp", "sig", "t", share("shares").alias("share"), spread("blocks").alias("block"))
        block = inside.select("g", "rep", "comp", "sig", "t", share("blocks").alias("block"), spread("shares").alias("share"))
        more = fresh(opened).groupBy("g", "block", "share").cogroup(fresh(block).groupBy("g", "block", "share")).applyInArrow(_meet, "a bigint, b bigint")
        # links between classes become links between components; these are few
        to = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        joined = more.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = cut(components(joined)).withColumnRenamed("node", "old").withColumnRenamed("component", "new")
        comps = comps.unionByName(merged.select(F.col("old").alias("node"), F.col("old").alias("component")).join(comps.select("node"), "node", "left_anti"))
        comps = cut(comps.join(merged, comps["component"] == merged["old"], "left").select("node", F.coalesce("new", "component").alias("component")))

    at = classes.select(*name, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*name, F.coalesce("component", "rep").alias("component"))
    out = sets.drop("sig").join(at, name, "left").select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), *(["text_hash"] if named else []))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns; of equal rows one."""
    found = cut(near_duplicates(df, id_col, text_col, named=True)).withColumnRenamed("text_hash", "row_hash")
    twice = cut(found.where("kept").groupBy(id_col, "row_hash").count().where("count > 1"))
    gone = found.where("not kept").select(id_col, "row_hash")
    if twice.isEmpty():
        return without(df, gone, id_col, (text_col,))
    single = without(df, gone.unionByName(twice.select(id_col, "row_hash")), id_col, (text_col,))
    return single.unionByName(without(df, twice, id_col, (text_col,), "left_semi").dropDuplicates([id_col, text_col]))
