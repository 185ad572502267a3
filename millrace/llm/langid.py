"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte n-grams of 2 to 4 bytes within words (a word's edges are marked by a blank). Each is
hashed to a row of an embedding table, the rows are averaged over the whole text and a linear softmax gives one
probability per language. Both tables are trained together by stochastic gradient descent. As everything before the
softmax is linear, the trained tables fold into one table of per-subword scores for prediction.

Temperature and rejection are calibrated on a part of the sample that training leaves out. A softmax is sure of texts that are
like none it has learned, so a text must also be typical of the language it is given: the mean log frequency of its subwords among
those of that language's sample. Both levels are the highest that lose few right answers; how many texts of shuffled letters and of
held-back languages they reject is measured on the same part, and kept in `Model.rejects`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PASS_BYTES, bounded_texts, by_bytes, map_batches, sampled_rows

UNKNOWN = "und"
#: Labelled rows of each language that training collects, and bytes of all their texts; with these the driver's memory is bounded.
ROWS_PER_LANGUAGE, SAMPLE_BYTES = 300, 32 << 20
#: Rows of the whole sample, at most.
MOST_ROWS = 20_000
BUCKETS = 1 << 16
DIMENSIONS = 16
ORDERS = (2, 3, 4)
#: Share of right answers that may be rejected: half for a low probability, half for subwords that are not typical.
REJECTED_SHARE = 0.005

LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _grams(flat: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the bucket of the n-gram at every byte but the last four, and whether it counts."""
    n = len(flat) - 4
    blank = flat == 32
    code = flat.astype(np.uint32)
    hashes, counted = [], []
    part = code[:n].copy()
    inner = np.ones(n, bool)
    for k in range(1, max(ORDERS)):
        part = part * np.uint32(257) + code[k : n + k]
        if k > 1:
            inner &= ~blank[k - 1 : n + k - 1]
        if k + 1 in ORDERS:
            mixed = part * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            hashes.append((mixed * np.uint32(2246822519)) >> np.uint32(16))
            both = blank[:n] & blank[k : n + k]
            counted.append(inner & ~both)
    return hashes, counted


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """A long text as _grams takes it: each piece with the four bytes behind it, so that none of its n-grams is lost or met twice."""
    whole = b" " + text + b"    "
    for lo in range(0, len(whole) - 4, PASS_BYTES):
        yield _FOLD[np.frombuffer(whole[lo : lo + PASS_BYTES + 4], np.uint8)]


def subwords(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram at every byte and whether it counts; and where each text begins."""
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return *_grams(_FOLD[np.frombuffer(b" " + b" ".join(texts) + b"    ", np.uint8)]), starts


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times softmax weights; the last row, zero, is for what doesn't count
    bias: np.ndarray
    temperature: float
    reject_below: float
    frequency: np.ndarray  # as scores: log frequency of a subword in a language's sample
    typical_from: float = -np.inf
    rejects: dict[str, float] = field(default_factory=dict)  # shares of made-up wrong texts that the levels reject

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and how typical a text's subwords are, by text and language."""
        if len(texts) == 1 and len(texts[0]) > PASS_BYTES:
            return self._long_means(texts[0])
        hashes, counted, starts = subwords(texts)
        tables = (self.scores, self.frequency)
        total = [np.zeros((len(texts), len(self.languages))) for _ in tables]
        n = np.zeros(len(texts), np.int64)
        for h, c in zip(hashes, counted, strict=True):
            at = np.where(c, h, BUCKETS)
            for t, values in zip(total, tables, strict=True):
                t += np.add.reduceat(np.take(values, at, axis=0), starts, axis=0, dtype=np.float64)
            n += np.add.reduceat(c, starts, dtype=np.int64)
        n = np.maximum(n, 1)[:, None]
        return total[0] / n + self.bias, total[1] / n

    def _long_means(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Sums over pieces: the means over the text are the same as in one go."""
        count = np.zeros(BUCKETS, np.int64)
        for flat in _pieces(text):
            for h, c in zip(*_grams(flat), strict=True):
                count += np.bincount(h[c], minlength=BUCKETS)
        n = max(int(count.sum()), 1)
        logits, typical = (count @ values[:BUCKETS].astype(np.float64) / n for values in (self.scores, self.frequency))
        return (logits + self.bias)[None], typical[None]

    def _long(self, text: bytes) -> np.ndarray:
        return self._long_means(text)[0]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return self.means(texts)[0]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)

    def answers(self, logits: np.ndarray, typical: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its probability and whether it is rejected, from what `means` gives."""
        p = _softmax(logits / self.temperature)
        best = p.argmax(1)
        at = np.arange(len(p))
        return best, p[at, best], (p[at, best] < self.reject_below) | (typical[at, best] < self.typical_from)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> Model:
    """rows: (text, language). Plain numpy, one thread, the same result in every run."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    texts = [t.encode() for t, _ in rows]
    bags = []
    for t in texts:
        hashes, counted, _ = subwords([t])
        at, count = np.unique(np.concatenate([h[c] for h, c in zip(hashes, counted, strict=True)]), return_counts=True)
        bags.append((at.astype(np.int64), (count / max(1, count.sum())).astype(np.float32)))
    y = np.array([languages.index(lang) for _, lang in rows])
    order = rng.permutation(len(rows))
    kept_out, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = epochs * (len(fit) // 16 + 1), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), 16):
            now = rate * (1 - done / steps)
            done += 1
            batch = [k for k in fit[lo : lo + 16] if len(bags[k][0])]
            if not batch:
                continue
            at = np.concatenate([bags[k][0] for k in batch])
            w = np.concatenate([bags[k][1] for k in batch])
            begin = np.cumsum([0, *[len(bags[k][0]) for k in batch[:-1]]])
            size = [len(bags[k][0]) for k in batch]
            mean = np.add.reduceat(table[at] * w[:, None], begin, axis=0)
            off = _softmax(mean @ weights + bias)
            off[np.arange(len(batch)), y[batch]] -= 1
            back = off @ weights.T
            weights -= now / len(batch) * mean.T @ off
            bias -= now / len(batch) * off.sum(0)
            step = np.repeat(back, size, axis=0) * (w[:, None] * -now)
            uniq, inv = np.unique(at, return_inverse=True)
            push = np.stack([np.bincount(inv, step[:, d], len(uniq)) for d in range(DIMENSIONS)], 1)
            table[uniq] += push.astype(np.float32)
    scores = np.vstack([table @ weights, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
    seen = np.zeros((BUCKETS + 1, len(languages)))
    for k in fit:
        np.add.at(seen[:, y[k]], bags[k][0], bags[k][1])
    frequency = np.log((seen + 0.5 / BUCKETS) / (seen.sum(0) + 0.5)).astype(np.float32)
    frequency[BUCKETS] = 0
    model = Model(languages, scores, bias.astype(np.float64), 1.0, 0.0, frequency)
    if len(kept_out):
        _calibrate(model, [texts[k] for k in kept_out], y[kept_out], rng)
    return model


def _calibrate(model: Model, texts: list[bytes], right: np.ndarray, rng: np.random.Generator) -> None:
    """Sets temperature, levels and measured rejections from texts that training has left out and their languages."""
    logits, typical = model.means(texts)
    at = np.arange(len(texts))
    grid = np.geomspace(1e-4, 100, 121)
    loss = np.array([-np.mean(np.log(0.999 * _softmax(logits / t)[at, right] + 0.001 / len(model.languages))) for t in grid])
    # so many right answers do not rule out an error in the next one (rule of succession): no sharper than that
    model.temperature = float(grid[np.flatnonzero(loss <= loss.min() + 1 / (len(texts) + 2))[-1]])
    best, p, _ = model.answers(logits, typical)
    ok = best == right
    if not ok.any():
        return
    model.reject_below = float(np.quantile(p[ok], REJECTED_SHARE / 2))
    model.typical_from = float(np.quantile(typical[at, best][ok], REJECTED_SHARE / 2))
    share = lambda x: float(model.answers(*x)[2].mean())
    model.rejects["shuffled"] = share(model.means([_shuffled(t, rng) for t in texts]))
    if len(model.languages) > 2:
        others = logits.copy()
        others[at, right] = -np.inf
        model.rejects["held_back"] = share((others, typical))


def _shuffled(text: bytes, rng: np.random.Generator) -> bytes:
    """The text with its letters dealt anew to the places between blanks."""
    flat = np.frombuffer(text, np.uint8).copy()
    inner = np.flatnonzero(flat > 32)
    flat[inner] = rng.permutation(flat[inner])
    return flat.tobytes()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns from about `rows_per_language` labelled rows of each language, whole texts, chosen by a hash of the id, of
    together at most `sample_bytes`: a longer text than fits its language's share is not learned from.
    None if no row has both a text and a language. Repeated rows count once."""
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    rows = bounded_texts(sampled_rows(known, "l", "id", rows_per_language), "l", "id", "t", MOST_ROWS, sample_bytes)
    rows = sorted((r[2], r[0] is None, r[0] or 0, r[1]) for r in rows)
    return train([(t, lang) for lang, _, _, t in rows]) if rows else None


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, lang_pred, score (calibrated probability of lang_pred) and rejected (score, or how typical the
    text's subwords are of lang_pred, under its calibrated level; lang_pred and score stand all the same).

    A text that is null or has no letter is `und` with score 0, as is every text if there is no model. Rows, repeated
    ones too, come out one for one; equal probabilities go to the first language in order. A very long text is summed up
    in pieces. Other columns are left out, whatever their names. An empty input gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores, low = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for lo, hi in by_bytes(texts) if m else ():
                own = [k for k in range(lo, hi) if texts[k] is not None and LETTER.search(texts[k])]
                if not own:
                    continue
                best, p, no = m.answers(*m.means([texts[k].encode() for k in own]))
                for k, c, s, r in zip(own, best.tolist(), p.tolist(), no.tolist(), strict=True):
                    langs[k], scores[k], low[k] = m.languages[c], s, r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(low)], names=["id", "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("t")), run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
