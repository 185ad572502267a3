"""Removal of every byte that lies in a long string which occurs twice in the corpus: distributed bucket-pointer
refinement.

Suffixes are grouped into buckets by what they begin with; a bucket pointer names each suffix's bucket. A bucket is
refined by sorting its suffixes on the bucket pointers of their later offsets; the new pointers are written back at once,
so that whatever refers to them later sees the finer buckets. Buckets of one suffix are settled and leave the sort.

The work is dealt out by buckets that all executors agree on:
1. Each window of LENGTH bytes points to the smallest 32-byte bucket in it (leftmost of equals), its anchor. Equal windows
   have equal anchors at equal offsets, and neighbouring windows mostly share theirs: about one suffix in 70 remains.
   These are the initial buckets, named by hashes of their bytes. An anchor alone in its bucket is settled.
2. Anchors of a bucket that share their whole context (all bytes of the windows that point to them, named by 160 bits)
   cannot be told apart by any later offset: those windows are repeated. One of them stands for all from here on.
3. Buckets with several contexts come together with the contexts' bytes. There all suffixes are sorted by 8-grams, and
   refine() takes the depth of their buckets to 24, 72 and LENGTH bytes, by the pointers at two later offsets each. Window
   starts that still share a bucket are repeated: exactly, as these pointers are ranks and not hashes. A bucket of
   more than HOT contexts is split by the offset of the anchor in the window and by what follows, down to single
   windows (160-bit names), whose buckets are counted with partial sums, so that no task needs all of it.

Counts are combined before each shuffle, and joins on buckets are equi-joins that Spark splits where a bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, map_batches, sha256

LENGTH = 200
GRAM = 32
#: Bytes that one pass takes; a longer text is taken in pieces that overlap by what a window needs.
PASS = 1 << 18
_POSITION_BITS = 20
#: Contexts of a bucket that one task may refine together; bytes of contexts in one step.
HOT, STEP = 4096, 1 << 19
#: Bytes of a batch of rows that leaves a Python worker.
BATCH_BYTES = 1 << 20
#: Bytes of the suffixes' first buckets, and factor of the second names.
FIRST, FACTOR = 8, 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return _mix(a * np.uint64(0x2545F4914F6CDD1D + 2 * level) + (b ^ (b << np.uint64(17))))


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the GRAM-byte and of the 128-byte bucket at every offset; data ends with 128 bytes of padding or text
    that belongs to no window asked for."""
    b = data.astype(np.uint64)
    n = len(b)
    g, k = b, 1
    while k < 8:  # exact: the 8 bytes themselves
        g = g[: n - 2 * k + 1] << np.uint64(8 * k) | g[k : n - k + 1]
        k *= 2
    levels = {}
    while k < 128:
        g = _pair(g[: n - 2 * k + 1], g[k : n - k + 1], k)
        k *= 2
        levels[k] = g
    return levels[GRAM], levels[128]


def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, factor, np.uint64)))


_UP, _DOWN = _powers(FACTOR, 1), _powers(pow(FACTOR, -1, 1 << 64), 1)


def _second(data: np.ndarray) -> np.ndarray:
    """Running sums from which _between takes names that do not depend on those of buckets()."""
    global _UP, _DOWN
    if len(_UP) < len(data):
        _UP, _DOWN = _powers(FACTOR, 2 * len(data)), _powers(pow(FACTOR, -1, 1 << 64), 2 * len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=out[1:])
    return out


def _between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """32 bits for the bytes from lo to hi, wherever they lie."""
    return (_mix((sums[hi] - sums[lo]) * _DOWN[lo]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _window_ids(deep: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _pair(deep[at], deep[at + LENGTH - 128], 3)


class Pass:
    """Anchors of the windows of some texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = b"".join(texts) + bytes(LENGTH)
        n = int(self.size.sum())
        self.gram, self.deep = buckets(np.frombuffer(self.data, np.uint8))
        self.sums = _second(np.frombuffer(self.data, np.uint8))
        doc = np.repeat(np.arange(len(texts)), self.size)
        begin = np.arange(n)
        valid = begin + LENGTH <= (self.first + self.size)[doc]
        self.at = np.nonzero(valid)[0]  # windows
        key = (self.gram[: n + LENGTH - GRAM] >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS)
        key |= np.arange(len(key), dtype=np.uint64)
        span, k = LENGTH - GRAM + 1, 1
        while 2 * k <= span:
            key = np.minimum(key[: len(key) - k], key[k:])
            k *= 2
        low = np.minimum(key[self.at], key[self.at + span - k]) if len(self.at) else np.zeros(0, np.uint64)
        self.anchor = (low & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        self.doc = doc[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.begin = np.nonzero(new)[0]  # first window of each anchor, as an index into at
        self.end = np.append(self.begin[1:], len(self.at)) - 1

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Two names for all bytes that an anchor's windows cover, the first also for where the anchor is among them."""
        lo, hi = self.at[self.begin], self.at[self.end] + LENGTH
        length = hi - lo
        name = (length * 1024 + self.anchor[self.begin] - lo).astype(np.uint64)
        for k in range(4):  # 4 x 104 + 24 bytes: more than the longest context
            name = _pair(name, self.deep[lo + np.minimum(104 * k, length - 128)], k)
        return name, _between(self.sums, lo, hi)


def _split_long(texts: list[bytes], lo: int, hi: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """(texts, their rows, their offsets) for each pass over rows [lo, hi)."""
    if hi - lo == 1 and len(texts[lo]) > 2 * PASS:
        t = texts[lo]
        for at in range(0, max(1, len(t) - LENGTH + 1), PASS):
            yield [t[at : at + PASS + LENGTH - 1]], [lo], [at]
    else:
        yield texts[lo:hi], list(range(lo, hi)), [0] * (hi - lo)


_I8 = pa.int64()


def _keys(id_col: str, text_col: str) -> list[Column]:
    """A row's name: 96 bits from its id and text. Equal rows share it, and get equal results."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.hash(F.col(text_col), F.col(id_col)).alias("k2")]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = [(t or "").encode() for t in b.column(2).to_pylist()]
        for lo, hi in by_bytes(texts, PASS):
            for part, rows, offsets in _split_long(texts, lo, hi):
                p = Pass(part)
                if not len(p.begin):
                    continue
                doc = p.doc[p.begin]
                row = np.array(rows)[doc]
                shift = np.array(offsets)[doc] - p.first[doc]
                c, d = p.contexts()
                yield pa.RecordBatch.from_arrays([
                    pa.array(p.gram[p.anchor[p.begin]].view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(k1[row]), pa.array(k2[row]),
                    pa.array((p.at[p.begin] + shift).astype(np.int32)), pa.array((p.at[p.end] + shift).astype(np.int32)),
                ], names=["h", "c", "d", "k1", "k2", "lo", "hi"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pass, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passes over documents (k1, k2, text, begins of the first windows of open anchors): with the open anchors' indexes,
    and for every text of the pass its keys and its offset."""
    for b in batches:
        k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = [(t or "").encode() for t in b.column(2).to_pylist()]
        flat, off = b.column(3).flatten().to_numpy(), b.column(3).offsets.to_numpy()
        off = off - off[0]
        for lo, hi in by_bytes(texts, PASS):
            for part, rows, offsets in _split_long(texts, lo, hi):
                p = Pass(part)
                doc = p.doc[p.begin]
                shift = np.array(offsets) - p.first
                first = p.at[p.begin] + shift[doc]
                on = np.zeros(len(p.begin), bool)
                edge = np.searchsorted(doc, np.arange(len(rows) + 1))
                for j, r in enumerate(rows):
                    mine = slice(edge[j], edge[j + 1])
                    on[mine] = np.isin(first[mine], flat[off[r] : off[r + 1]])
                if on.any():
                    yield p, np.nonzero(on)[0], k1[rows], k2[rows], shift


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BATCH_BYTES: what the JVM holds of a Python worker's output lies outside its heap."""
    rows = max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes))
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open anchors with the bytes of their windows."""
    for p, on, k1, k2, shift in _open(batches):
        lo, hi = p.at[p.begin[on]], p.at[p.end[on]]
        doc, anchor = p.doc[p.begin[on]], p.anchor[p.begin[on]]
        data = [p.data[a : b + LENGTH] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        yield from _slices(pa.RecordBatch.from_arrays([
            pa.array(p.gram[anchor].view(np.int64)), pa.array(k1[doc]), pa.array(k2[doc]), pa.array((lo + shift[doc]).astype(np.int32)), pa.array(data, pa.binary()),
        ], names=["h", "k1", "k2", "lo", "bytes"]))


def refine(data: np.ndarray, room: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Marks the suffixes whose first `depth` bytes begin another suffix too; room[i] tells how many bytes suffix i has
    before its end, and only suffixes with room for `depth` bytes are told apart that far.

    Bucket-pointer refinement: pointer[i] is the place in sorted order at which the bucket of suffix i begins. A bucket at
    depth d, sorted on the pointers at two later offsets (at depth d as well, d bytes apart at most), is a run of buckets that
    are deeper by both offsets; where three pointers do not fit into a word, one offset is taken at a time. The
    suffixes of a round are those in buckets of two or more that have room for its depth; what a round has
    told apart, later rounds reuse through the pointers.
    """
    n = len(room)
    offsets = 2 if n < (1 << 21) - 1 else 1
    # the first byte is the most significant: buckets are in lexicographic order
    gram, k = np.concatenate([data, np.zeros(FIRST, np.uint8)]).astype(np.uint64), 1
    while k < FIRST:
        gram = gram[: len(gram) - k] << np.uint64(8 * k) | gram[k:]
        k *= 2
    left = np.nonzero(room >= FIRST)[0]
    left = left[np.argsort(gram[left])]
    same = gram[left]
    pointer = np.full(n, n, np.int64)  # what has no room for the first bucket is never looked up by what has room for `depth`
    base, seen = np.zeros(len(left), np.int64), FIRST
    while True:
        # buckets are runs of equal keys within the old buckets; a pointer is the old one plus the place in it
        new = np.ones(len(left), bool)
        new[1:] = (same[1:] != same[:-1]) | (base[1:] != base[:-1])
        old = np.ones(len(left), bool)
        old[1:] = base[1:] != base[:-1]
        at = np.arange(len(left))
        first = np.maximum.accumulate(np.where(new, at, 0))
        pointer[left] = base + first - np.maximum.accumulate(np.where(old, at, 0))
        size = np.diff(np.append(np.nonzero(new)[0], len(left)))
        left = left[np.repeat(size > 1, size)]
        if seen == depth or not len(left):
            break
        steps = [min(seen * k, depth - seen) for k in range(1, offsets + 1)]
        seen += steps[-1]
        left = left[room[left] >= seen]
        key = pointer[left]
        for step in steps:
            key = key * (n + 1) + pointer[left + step]
        order = np.argsort(key)
        left, key = left[order], key[order]
        base, same = pointer[left], key
    twice = np.zeros(n, bool)
    twice[left] = True
    return twice


def _refined(lo: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the repeated runs in the contexts of whole buckets."""
    size = np.array([len(d) for d in data])
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(data)), size)
    place = np.arange(len(row))
    hit = np.nonzero(refine(np.frombuffer(b"".join(data), np.uint8), end[row] - place))[0]
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])
    begin = hit[new]
    last = hit[np.append(np.nonzero(new)[0][1:], len(hit)) - 1]
    row = row[begin]
    shift = lo[row] - (end - size)[row]
    return row, begin + shift, last + shift + LENGTH


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _contexts, sorted by bucket, each bucket whole within the task; a step ends where a bucket ends."""

    def out(t: pa.Table) -> pa.RecordBatch:
        row, lo, hi = _refined(t["lo"].to_numpy(), t["bytes"].to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(t["k1"].to_numpy()[row]), pa.array(t["k2"].to_numpy()[row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["k1", "k2", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            held.append(b)
            size += b.column(4).nbytes
            if size > STEP:
                t = pa.Table.from_batches(held)
                h = t["h"].to_numpy()
                cut_at = int(np.searchsorted(h, h[-1]))
                if cut_at:
                    yield out(t.slice(0, cut_at))
                held, size = t.slice(cut_at).to_batches(), 0
    if held:
        yield out(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket of every window of the open anchors."""
    for p, on, k1, k2, shift in _open(batches):
        mark = np.zeros(len(p.begin), bool)
        mark[on] = True
        pick = np.nonzero(np.repeat(mark, p.end - p.begin + 1))[0]
        at, anchor, d = p.at[pick], p.anchor[pick], p.doc[pick]
        name = _pair(p.gram[anchor], (anchor - at).astype(np.uint64), 1)
        yield from _slices(pa.RecordBatch.from_arrays([
            pa.array(name.view(np.int64)), pa.array(_window_ids(p.deep, at).view(np.int64)), pa.array(_between(p.sums, at, at + LENGTH)), pa.array(k1[d]), pa.array(k2[d]), pa.array((at + shift[d]).astype(np.int32)),
        ], names=["w1", "w2", "w3", "k1", "k2", "lo"]))


def _removed(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the bytes within [lo, hi) for some pair."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:n]) > 0


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: `id_col`, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes
    that stay, with `with_text` also kept_text (a character of which only some bytes stay is left out of it); the
    columns of `carry` come along.

    A null text counts as empty. A text shorter than LENGTH bytes has no window and stays whole; a very long one is taken in overlapping passes. Equal rows, with
    equal ids or not, are copies of each other and lose all their windows. Other columns are left out,
    whatever their names. An empty input gives no rows.
    """
    extra = [f"x{k}" for k in range(len(carry))]
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("t"), *[df[c].alias(x) for c, x in zip(carry, extra, strict=True)])
    named = docs.select(*_keys("id", "t"), "id", "t", *extra)
    anchors = map_batches(named.select("k1", "k2", "t").where(F.octet_length("t") >= LENGTH), _anchors, "h bigint, c bigint, d int, k1 bigint, k2 int, lo int, hi int")
    # one context: all of a bucket's names c agree, so that d, which tells contexts of one c apart, is not needed here
    shared = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") == F.max("c")).alias("alike")).where("n > 1").select("h", "alike")
    # cut here, so that the join below deals out both sides itself and can split a hot bucket
    shared = cut(shared)
    met = cut(anchors.join(shared, "h"))
    mixed = met.where("not alike").select("h", "c", "d", "k1", "k2", "lo", "hi")
    one = F.struct("k1", "k2", "lo")
    kinds = cut(mixed.groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")))
    many = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > HOT).select("h", F.lit(True).alias("many")))
    mixed = mixed.join(kinds.where("n > 1").select("h", "c", "d"), ["h", "c", "d"])
    covered = met.where("alike").select("k1", "k2", "lo", "hi").unionByName(mixed.select("k1", "k2", "lo", "hi")).select("k1", "k2", "lo", (F.col("hi") + LENGTH).alias("hi"))
    # from here on a context that occurs more than once is open once
    hot = F.col("many").isNotNull()
    opened = kinds.join(many, "h", "left").groupBy("one.k1", "one.k2").agg(F.collect_list(F.when(~hot, F.col("one.lo"))).alias("few"), F.collect_list(F.when(hot, F.col("one.lo"))).alias("many"))
    opened = cut(opened)
    # all columns go along, so that this exchange of the texts and the last one are the same and are made once
    of = lambda which: named.join(opened.where(F.size(which) > 0).select("k1", "k2", which), ["k1", "k2"]).select("k1", "k2", "t", which, "id", *extra)
    contexts = map_batches(of("few"), _contexts, "h bigint, k1 bigint, k2 int, lo int, bytes binary")
    refined = map_batches(contexts.repartition("h").sortWithinPartitions("h"), _refine, "k1 bigint, k2 int, lo int, hi int")
    covered = covered.unionByName(refined)
    if not opened.where(F.size("many") > 0).isEmpty():
        windows = map_batches(of("many"), _windows, "w1 bigint, w2 bigint, w3 int, k1 bigint, k2 int, lo int")
        name = ["w1", "w2", "w3"]
        # dealt out anew, so that the join sees two exchanges and can split a hot window
        twice = windows.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*name).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        covered = covered.unionByName(windows.join(twice, name).select("k1", "k2", "lo", (F.col("lo") + LENGTH).alias("hi")))
    spans = covered.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    # a key may stand for several equal rows; the spans have one row per key
    full = named.join(spans, ["k1", "k2"], "left").select("id", "t", F.col("spans.lo").alias("a"), F.col("spans.hi").alias("b"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            cols = [b.column(k) for k in (2, 3)]
            flat = [c.flatten().to_numpy() for c in cols]
            # flatten() leaves out what null lists hold, so sizes and not offsets tell where a row's values are
            ends = [np.cumsum(np.array([0 if n is None else n for n in c.value_lengths().to_pylist()], np.int64)) for c in cols]
            for r, text in enumerate(b.column(1).to_pylist()):
                data = text.encode()
                own = [f[(e[r - 1] if r else 0) : e[r]] for f, e in zip(flat, ends, strict=True)]
                lo, hi = own
                kept, gone, runs = data, 0, 0
                if len(lo):
                    mask = _removed(len(data), lo, hi)
                    gone = int(mask.sum())
                    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                values = (len(data), gone, runs, sha256(kept), kept.decode("utf-8", "ignore") if with_text else None)
                for col, v in zip(out, values, strict=True):
                    col.append(v)
            arrays = [b.column(0), *[pa.array(c, _I8) for c in out[:3]], pa.array(out[3], pa.string())]
            if with_text:
                arrays.append(pa.array(out[4], pa.string()))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(arrays)]
            yield pa.RecordBatch.from_arrays([*arrays, *b.columns[4:]], names=[*names, *extra])

    kind = df.schema[id_col].dataType.simpleString()
    more = ", kept_text string" if with_text else ""
    more += "".join(f", {x} {docs.schema[x].dataType.simpleString()}" for x in extra)
    out = map_batches(full, run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")
    return out.withColumnsRenamed({"id": id_col} | dict(zip(extra, carry, strict=True)))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, each text without its repeated bytes; `size_col`, if there, counts its characters anew.
    A text of which nothing stays becomes empty, a null text too."""
    rest = tuple(c for c in df.columns if c not in (id_col, text_col, size_col))
    out = dedup(df, id_col, text_col, with_text=True, carry=rest)
    new = {text_col: F.col("kept_text"), size_col: F.char_length("kept_text")}
    return out.select(*[(new[c].cast(df.schema[c].dataType) if c in new else F.col(c)).alias(c) for c in df.columns])
