"""Whitening of embeddings from an exact integer scatter.

Entries are quantized to whole numbers, and a shift is taken off. Tasks sum the vectors and their cross-products in blocks
small enough for a floating matrix product to be exact, entries cut into limbs where they are large, and add the blocks up as whole numbers of
any length. These travel as limbs of 32 bits, which Spark sums. From n, the sums S and the cross-products comes n XX' - SS',
still exact; only that becomes a floating matrix, which is decomposed by eigh.

What reaches the driver depends on the number of dimensions, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: x = floor(FACTOR * c) + SHIFT for an entry c.
FACTOR, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block and bits of a limb: 2**11 products of two limbs of 21 bits each are exact in a double.
BLOCK, LIMB = 2048, 21
#: Rows that are turned into output at a time.
OUT_ROWS = 4096


def _matrix(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch take part, and their vectors."""
    v = b.column("v")
    right = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) == width
    m = v.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls become NaN
    finite = np.isfinite(m).all(1)
    take = np.nonzero(right)[0][finite]
    return take, m[finite]


def _whole(m: np.ndarray) -> np.ndarray:
    """x - SHIFT as whole numbers: int64, or Python's where that could overflow."""
    if not len(m) or np.abs(m).max() < 2.0**41:
        return np.floor(m * FACTOR).astype(np.int64)
    return np.array([[math.floor(c * FACTOR) if abs(c) < 2.0**900 else int(c) * FACTOR for c in r] for r in m.tolist()], object)


def _cross(y: np.ndarray) -> np.ndarray:
    """y'y as Python's whole numbers, for at most BLOCK rows."""
    if y.dtype == object:
        return y.T.dot(y)
    most = int(np.abs(y).max(initial=0))
    if most <= 1 << LIMB:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs, rest = [], y
    while int(np.abs(rest).max()) > 1 << LIMB:
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _limbs(v: int) -> list[int]:
    """v in base 2**32, the last limb with the sign: sums of up to 2**31 such limbs fit a long."""
    out = []
    while not -(1 << 31) <= v < 1 << 31:
        out.append(v & 0xFFFFFFFF)
        v >>= 32
    return [*out, v]


def _scatter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(width, object), np.zeros((width, width), object)
        for b in batches:
            _, m = _matrix(b, width)
            for lo in range(0, len(m), BLOCK):
                y = _whole(m[lo : lo + BLOCK])
                n += len(y)
                sums += y.astype(object).sum(0) if y.dtype == object else y.sum(0).astype(object)
                cross += _cross(y)
        if not n:
            return
        cells = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(sums)), *((i, j, cross[i, j]) for i in range(width) for j in range(i + 1))]
        rows = [(i, j, k, limb) for i, j, v in cells for k, limb in enumerate(_limbs(int(v)))]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "limb"])

    return run


@dataclass(frozen=True)
class Model:
    """n vectors of `width` entries; sums of x - SHIFT; directions (rows: components, unit length, by falling eigenvalue); eigenvalues
    and trace of the covariance over 4**power."""

    n: int
    width: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    power: int


def scatter(df: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and cross-products of the vectors' whole numbers less SHIFT, exact. df: v."""
    found = map_batches(df.select("v"), _scatter(width), "i int, j int, k int, limb long").groupBy("i", "j", "k").agg(F.sum("limb").alias("limb"))
    cells: dict[tuple[int, int], int] = {}
    for i, j, k, limb in found.collect():  # as many as there are pairs of dimensions
        cells[i, j] = cells.get((i, j), 0) + (limb << 32 * k)
    cross = [[cells.get((max(i, j), min(i, j)), 0) for j in range(width)] for i in range(width)]
    return cells.get((-1, -1), 0), [cells.get((i, -1), 0) for i in range(width)], cross


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all vectors that take part; none if there are none."""
    rows = df.select(F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    widths = rows.groupBy(F.size("v").alias("width")).count().where("width > 0").orderBy(F.desc("count"), "width").first()
    if widths is None:
        return None
    width = widths["width"]
    n, sums, cross = scatter(rows, width)
    if not n:
        return None
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    # a power of two brings the largest variance near one, so that no whole number is too large for a double
    power = max(0, (max(exact[i][i] for i in range(width)).bit_length() - 2 * n.bit_length()) // 2)
    cov = np.array([[v / (n * n << 2 * power) for v in r] for r in exact])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v.T[::-1][:components].copy()
    v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]  # the same sign in every run
    v /= np.linalg.norm(v, axis=1)[:, None]
    return Model(n, width, tuple(sums), v, np.where(e > e.max(initial=0) * width * 2.0**-50, e, 0.0), float(np.trace(cov)), power)


def _whitened(m: np.ndarray, model: Model) -> np.ndarray:
    """Rows of vectors to rows of components; those without variance are NaN."""
    y = _whole(m)
    if y.dtype == object or model.power > 400:
        off = np.array([[(model.n * a - s) / (model.n << model.power) for a, s in zip(r, model.sums, strict=True)] for r in y.tolist()])
    else:
        off = np.ldexp(y.astype(np.float64) - np.array([s / model.n for s in model.sums]), -model.power)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, (off @ model.directions.T) / np.sqrt(model.values), np.nan)


def _deviation(m: np.ndarray, model: Model) -> list[int]:
    """Sum over dimensions of (n x - S)**2, exact."""
    y = _whole(m)
    most = model.n * (int(np.abs(y).max(initial=0)) if y.dtype != object else max(abs(a) for r in y.tolist() for a in r)) + max(map(abs, model.sums))
    if model.width * most * most < 1 << 63:
        return (np.square(model.n * y - np.array(model.sums)).sum(1)).tolist()
    if most < 1 << 52 and model.width < 1 << 9:
        q = np.abs(model.n * y - np.array(model.sums))
        hi, lo = q >> 26, q & ((1 << 26) - 1)
        parts = [np.square(hi).sum(1), (hi * lo).sum(1), np.square(lo).sum(1)]
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
    return [sum((model.n * a - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in y.tolist()]


def identity_error(df: DataFrame, model: Model, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with variance. Each task gives its
    mean and its centred products; centred about the common mean, they add up."""
    live = int((model.values > 0).sum())
    if not live:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(live), np.zeros((live, live))
        for b in batches:
            _, m = _matrix(b, model.width)
            for lo in range(0, len(m), OUT_ROWS):
                z = _whitened(m[lo : lo + OUT_ROWS], model)[:, :live]
                own = z.mean(0)
                step, k = own - mean, len(z)
                m2 += (z - own).T @ (z - own) + np.outer(step, step) * (n * k / (n + k))
                mean = mean + step * k / (n + k)
                n += k
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([mean.tolist()]), pa.array([m2.ravel().tolist()])], ["n", "mean", "m2"])

    parts = cut(map_batches(df.select(F.col(vector_col).cast("array<double>").alias("v")), run, "n long, mean array<double>, m2 array<double>"))
    c = F.col
    mean = parts.agg(*[(F.sum(c("n") * c("mean")[a]) / F.sum("n")).alias(f"m{a}") for a in range(live)]).first()
    products = [F.sum(c("m2")[a * live + b] + c("n") * (c("mean")[a] - mean[a]) * (c("mean")[b] - mean[b])) / F.sum("n") - float(a == b) for a in range(live) for b in range(a + 1)]
    return max(abs(x) for x in parts.agg(*products).first())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector that takes part and component (from 1): `id_col`, component, n, deviation (decimal, exact; null beyond 38
    digits), whitened, explained, identity_error.

    Vectors that are null or hold null, infinite or undefined entries take no part; nor do empty ones and those of another length than the
    most common one (the smaller of equals). Repeated rows count and come out each time, null ids like others. A component
    without variance (fewer vectors than dimensions, or equal ones) has null whitened; where no component has any, explained and
    identity_error are null as well. Entries may be as large as doubles are. Other columns are left out, whatever their names. An empty
    input gives no rows."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(df, vector_col, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, k = identity_error(df, model, vector_col), len(model.values)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, m = _matrix(b, model.width)
            for lo in range(0, len(m), OUT_ROWS):
                part = m[lo : lo + OUT_ROWS]
                r = len(part)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in _deviation(part, model)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(r), k))
                yield pa.record_batch([
                    b.column("id").take(pa.array(take[lo : lo + r])).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, model.n)), deviation.take(each),
                    pa.array(_whitened(part, model).ravel(), from_pandas=True), pa.array(explained * r, pa.float64()), pa.array([error] * (r * k), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), run, schema).withColumnRenamed("id", id_col)
