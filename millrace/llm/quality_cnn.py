"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and met by learned filters at every second byte of the whole document. Each filter is
max-pooled over overlapping chunks (a chunk is two neighbouring segments, each segment is in two chunks), a hidden
layer looks at each chunk, and the chunks' mean and maximum are combined into one probability. Only the positions that
win a maximum carry gradients to the filters, and only these are kept of a forward pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, by_bytes, map_batches, sampled_rows

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 24, 12
#: Bytes of a segment; a chunk is twice as long.
SEGMENT = 128
#: Labelled rows of each class that training collects, and bytes of all their texts; with these the driver's memory is bounded.
ROWS_PER_CLASS, SAMPLE_BYTES = 700, 32 << 20
#: Segments that are met by the filters at a time, and winning positions whose gradients are taken at a time; bound the temporaries.
PASS_SEGMENTS, PASS_WINS = 2048, 1 << 17
GOOD_FROM = 0.7


@dataclass
class Net:
    embed: np.ndarray  # 257 x EMBED; row 256 stands for what lies after a text's end
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    offset: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_offset: np.ndarray
    out: np.ndarray  # 2 * HIDDEN: chunk mean, chunk maximum
    out_offset: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.hidden, self.hidden_offset, self.out, self.out_offset]


def _lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, each text padded to whole segments (one at least) and kept apart by one more, so that no filter sees two
    texts; segments of each text; where these are among all."""
    n = np.array([max(1, -(-len(t) // SEGMENT)) for t in texts])
    first = np.cumsum(n + 1) - n - 1
    flat = np.full((n + 1).sum() * SEGMENT + WIDTH, 256, np.int32)
    for t, at in zip(texts, (first * SEGMENT).tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return flat, n, np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)


def _met(net: Net, flat: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """What the filters give at each position of these segments."""
    x = net.embed[flat[segments[:, None] * SEGMENT + np.arange(SEGMENT + WIDTH)]]
    s = x.strides
    patches = np.lib.stride_tricks.as_strided(x, (len(x), SEGMENT // STRIDE, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2])).reshape(-1, WIDTH * EMBED)
    return (patches @ net.filters).reshape(len(x), SEGMENT // STRIDE, FILTERS)


def _forward(net: Net, texts: list[bytes]):
    """The texts laid out, and of each segment and filter the largest value and its position."""
    flat, n, own = _lay_out(texts)
    most, win = np.empty((len(own), FILTERS), np.float32), np.empty((len(own), FILTERS), np.int64)
    for lo in range(0, len(own), PASS_SEGMENTS):
        seen = _met(net, flat, own[lo : lo + PASS_SEGMENTS])
        win[lo : lo + len(seen)] = at = seen.argmax(1)
        most[lo : lo + len(seen)] = np.take_along_axis(seen, at[:, None, :], 1)[:, 0]
    return flat, n, own, win, most


def _combine(net: Net, pooled: np.ndarray, n: np.ndarray):
    """pooled: per segment, after offset and ReLU. Chunk j of a text is segments j and j+1; the last is its own pair."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    nxt = np.minimum(np.arange(len(pooled)) + 1, len(pooled) - 1)
    ends = np.cumsum(n) - 1
    nxt[ends] = ends
    chunk = np.maximum(pooled, pooled[nxt])
    raw = chunk @ net.hidden + net.hidden_offset
    h = np.maximum(raw, 0)
    mean = np.add.reduceat(h, first, axis=0) / n[:, None]
    most = np.maximum.reduceat(h, first, axis=0)
    both = np.hstack([mean, most])
    logit = both @ net.out + net.out_offset[0]
    return first, nxt, chunk, h, most, both, logit


def _score_long(net: Net, text: bytes) -> np.ndarray:
    """As score, of one text, by passes over its segments: chunk outputs are summed up and their maxima kept."""
    f4 = np.float32
    n = max(1, -(-len(text) // SEGMENT))
    total, most = np.zeros(HIDDEN), np.full(HIDDEN, -np.inf, f4)
    before = np.zeros((0, FILTERS), f4)
    for lo in range(0, n, PASS_SEGMENTS):
        k = min(PASS_SEGMENTS, n - lo)
        flat = np.full(k * SEGMENT + WIDTH, 256, np.int32)
        own = np.frombuffer(text[lo * SEGMENT : lo * SEGMENT + len(flat)], np.uint8)
        flat[: len(own)] = own
        x = net.embed[flat]
        s = x.strides
        patches = np.lib.stride_tricks.as_strided(x, (k * SEGMENT // STRIDE, WIDTH * EMBED), (STRIDE * s[0], s[1]))
        seen = (patches @ net.filters).reshape(k, SEGMENT // STRIDE, FILTERS)
        pooled = np.concatenate([before, np.maximum(seen.max(1) + net.offset, 0)])
        before = pooled[-1:]
        # the last chunk of all is the last segment by itself
        chunk = np.maximum(pooled[:-1], pooled[1:]) if lo + k < n else np.maximum(pooled, np.concatenate([pooled[1:], pooled[-1:]]))
        h = np.maximum(chunk @ net.hidden + net.hidden_offset, 0)
        if len(h):
            total += h.sum(0, dtype=np.float64)
            most = np.maximum(most, h.max(0))
    logit = np.concatenate([(total / n).astype(f4), most]) @ net.out + net.out_offset[0]
    return 1 / (1 + np.exp(-np.clip(np.array([logit], np.float64), -30, 30)))


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > PASS_SEGMENTS * SEGMENT:
        return _score_long(net, texts[0])
    flat, n, own = _lay_out(texts)
    pooled = np.maximum(_met(net, flat, own).max(1) + net.offset, 0)
    logit = _combine(net, pooled, n)[-1]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def train(rows: list[tuple[str, int]], prior: float, epochs: int = 8, batch: int = 24, rate: float = 4e-3, seed: int = 5) -> Net:
    """rows: (text, 0 or 1); prior: share of ones among all labelled rows, to which the balanced sample is set back.
    Adam; one thread; the same result in every run."""
    rng = np.random.default_rng(seed)
    f4 = np.float32
    net = Net(rng.normal(0, 0.5, (257, EMBED)).astype(f4), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(f4), np.zeros(FILTERS, f4),
              rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f4), np.full(HIDDEN, 0.1, f4), rng.normal(0, 0.3, 2 * HIDDEN).astype(f4), np.zeros(1, f4))
    texts = [t.encode() for t, _ in rows]
    y = np.array([q for _, q in rows], f4)
    m1, m2, step = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            own = order[lo : lo + batch]
            flat, n, place, win, seen = _forward(net, [texts[k] for k in own])
            raw = seen + net.offset
            pooled = np.maximum(raw, 0)
            first, nxt, chunk, h, most, both, logit = _combine(net, pooled, n)
            d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[own]) / len(own)).astype(f4)
            d_both = d_logit[:, None] * net.out
            text_of = np.repeat(np.arange(len(own)), n)
            top = h == most[text_of]
            top = top / np.add.reduceat(top, first, axis=0)[text_of]
            d_h = d_both[text_of, :HIDDEN] / n[text_of, None] + d_both[text_of, HIDDEN:] * top
            d_raw = (d_h * (h > 0)).astype(f4)
            d_chunk = d_raw @ net.hidden.T
            left = pooled >= pooled[nxt]
            d_pool = d_chunk * left
            np.add.at(d_pool, nxt, d_chunk * ~left)
            d_seen = (d_pool * (raw > 0)).astype(f4)
            d_filters = np.zeros_like(net.filters)
            d_embed = np.zeros_like(net.embed)
            wins = np.flatnonzero(d_seen)
            for some in (wins[i : i + PASS_WINS] for i in range(0, len(wins), PASS_WINS)):
                seg, fil = np.divmod(some, FILTERS)
                g = d_seen[seg, fil]
                at = flat[(place[seg] * SEGMENT + win[seg, fil] * STRIDE)[:, None] + np.arange(WIDTH)]
                patch = net.embed[at].reshape(-1, WIDTH * EMBED)
                spread = net.filters.T[fil] * g[:, None]
                for k in range(FILTERS):
                    on = fil == k
                    d_filters[:, k] += g[on] @ patch[on]
                for e in range(EMBED):
                    d_embed[:, e] += np.bincount(at.ravel(), spread.reshape(-1, WIDTH, EMBED)[:, :, e].ravel(), 257)
            grads = [d_embed, d_filters, d_seen.sum(0), chunk.T @ d_raw, d_raw.sum(0), both.T @ d_logit, np.array([d_logit.sum()])]
            step += 1
            now = rate * (1 - step / (total + 1)) + 1e-5
            for w, d, a, b in zip(net.weights(), grads, m1, m2, strict=True):
                a += 0.1 * (d - a)
                b += 0.002 * (d * d - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.998**step)) + 1e-7)
    share = min(max(float(y.mean()), 0.01), 0.99)
    prior = min(max(prior, 0.01), 0.99)
    net.out_offset += f4(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Net | None:
    """Learns from the whole texts of about `rows_per_class` labelled rows of each class, chosen by a hash of the id, of
    together at most `sample_bytes`: a longer text than fits its class's share is not learned from. Repeated rows count once.
    Null labels and texts count for nothing; of an id with several labels the smallest counts. None without both classes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("q")).where("q in (0, 1) and id is not null").groupBy("id").agg(F.min("q").alias("q"))
    counts = {r[0]: r[1] for r in known.groupBy("q").count().collect()}
    if len(counts) < 2:
        return None
    most = 4 * rows_per_class + 100
    sample = sampled_rows(known, "q", "id", rows_per_class).orderBy(F.xxhash64("id")).limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    picked = texts.join(F.broadcast(sample), "id")  # the sample has a fixed bound
    rows = sorted(tuple(r) for r in bounded_texts(picked.select("id", "t", "q"), "q", "id", "t", 2 * most, sample_bytes))
    if len({q for *_, q in rows}) < 2:
        return None
    return train([(t, q) for _, t, q in rows], counts[1] / sum(counts.values()))


def classify(df: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """`id_col`, score (0 to 1, higher: quality 1 likelier) and predicted (1 from `good_from` on).

    A null text counts as empty and gets a score like any other; a very long one is scored in passes over all of it. Without a network every score is 0.5. Rows, repeated
    ones too, come out one for one; other columns are left out, whatever their names. An empty input gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)  # a few thousand floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            p: list[float] = []
            for lo, hi in by_bytes(texts, 1 << 18):
                own = [(t or "").encode() for t in texts[lo:hi]]
                p += score(sent.value, own).tolist() if sent.value else [0.5] * len(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= good_from) for x in p], pa.int32())], names=["id", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("t")), run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep(df: DataFrame, net: Net | None, text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """The rows that `classify` predicts to be good, with all their columns, whatever their names; all rows without a
    network. A null text counts as empty; of repeated rows all stay or all go. An empty input gives no rows."""
    if net is None:
        return df
    sent = df.sparkSession.sparkContext.broadcast(net)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            on: list[bool] = []
            for lo, hi in by_bytes(texts, 1 << 18):
                on += (score(sent.value, [(t or "").encode() for t in texts[lo:hi]]) >= good_from).tolist()
            yield b.filter(pa.array(on, pa.bool_()))

    return df.mapInArrow(run, df.schema)
