"""String similarity of the indel family, 0 to 100: twice the longest common subsequence over both lengths.

Python only where Spark has no function for it: each score is an Arrow pandas UDF over distinct pairs, and the scores
that saturate on a shared token answer those pairs in the JVM first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer one that is no longer than it."""
    return partial_ratios([(a, b)])[0]


#: Cells of the tables that are combed side by side, about: bounds the memory of a pass.
PASS_CELLS = 1 << 22


def partial_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """partial_ratio of each pair. Pairs of like lengths are combed together (see `strands`)."""
    out = [100.0 if a == b else 0.0 for a, b in pairs]
    jobs = []  # short text, long text, pair
    for k, (a, b) in enumerate(pairs):
        if a and b and a != b:
            jobs += [(*sorted((a, b), key=len), k)] if len(a) != len(b) else [(a, b, k), (b, a, k)]
    jobs.sort(key=lambda j: (len(j[1]), len(j[0])))
    lo = 0
    while lo < len(jobs):
        hi, n = lo, 0
        while hi < len(jobs) and hi - lo < 512:
            n = max(n, len(jobs[hi][0]))
            if hi > lo and (hi + 1 - lo) * (n + len(jobs[hi][1])) > PASS_CELLS // 8:
                break
            hi += 1
        part = jobs[lo:hi]
        short, long = [j[0] for j in part], [j[1] for j in part]
        for (_, _, k), s in zip(part, _best_stretches(short, long, strands(short, long)).tolist(), strict=True):
            out[k] = max(out[k], s)
        lo = hi
    return out


def _codes(texts: Sequence[str], width: int, fill: int) -> np.ndarray:
    """Code points, a column per text, filled up at the end."""
    out = np.full((width, len(texts)), fill, np.int32)
    for k, t in enumerate(texts):
        out[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def strands(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """Semi-local longest common subsequences: a column per pair, with the place where the strand began that ends below each letter of the
    long text.

    Strands enter the table of both texts at its left and its top and leave it at the bottom and at the right. In a cell two strands
    meet; they cross unless the letters are equal or they have crossed before. The common subsequence of the short text and
    any stretch [i, j) of the long one is as long as the stretch, less the strands that run from its top to its bottom:
    one pass thus settles all stretches. The cells of a diagonal do not depend on each other, nor do pairs, so they go
    side by side. Negative: the strand came from the left."""
    n, m = max(map(len, short)), max(map(len, long))
    a, b = _codes(short, n, -1)[::-1], _codes(long, m, -2)
    kind = np.int16 if n + m < 1 << 15 else np.int32
    left = np.repeat(np.arange(n, dtype=kind)[:, None], len(short), 1)  # from the last letter to the first
    top = np.repeat(np.arange(n, n + m, dtype=kind)[:, None], len(short), 1)
    for t in range(n + m - 1):
        first, last = max(0, t - m + 1), min(n - 1, t)  # rows of the diagonal
        h, v = left[n - 1 - last : n - first], top[t - last : t - first + 1]
        same = a[n - 1 - last : n - first] == b[t - last : t - first + 1]
        low, high = np.where(same, v, np.minimum(h, v)), np.where(same, h, np.maximum(h, v))
        h[:], v[:] = low, high
    ends = top.astype(np.int64) - n
    ends[np.arange(m)[:, None] >= np.array([len(x) for x in long])] = -1
    return ends


def _best_stretches(short: Sequence[str], long: Sequence[str], ends: np.ndarray) -> np.ndarray:
    """The best ratio of each short text with stretches of its long one: those of as many letters, and shorter ones at both ends."""
    n, m = np.array([len(x) for x in short]), np.array([len(x) for x in long])
    rows, pairs = ends.shape[0] + 1, len(n)
    at, pair = np.nonzero(ends >= 0)
    began = ends[at, pair]
    count = lambda place, of: np.cumsum(np.bincount(place * pairs + of, minlength=rows * pairs).reshape(rows, pairs), 0)
    # a strand that begins at d and ends at r is inside the stretches of n letters that start from r - n + 1 to d
    lo = np.maximum(at - n[pair] + 1, 0)
    inside = began >= lo
    lost = count(lo[inside], pair[inside]) - count(began[inside] + 1, pair[inside])
    lost[np.arange(rows)[:, None] > m - n] = rows
    best = 100.0 * (n - lost.min(0)) / n
    width = int(n.max()) - 1  # letters of a shorter stretch, less one
    if width > 0:
        k = np.arange(1, width + 1)[:, None]
        head = k - count(at, pair)[:width]
        tail = k - count(m[pair] - 1 - began, pair)[:width]
        part = 200.0 * np.maximum(head, tail) / (n + k)
        best = np.maximum(best, np.where(k < n, part, 0.0).max(0))
    return best


def _tokens(s: str) -> list[str]:
    return sorted(s.split())


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(_tokens(a)), " ".join(_tokens(b)))


def partial_token_set_ratio(a: str, b: str) -> float:
    """100 if a token is shared; else partial_ratio of the distinct tokens; 0 if a side has none."""
    return partial_token_set_ratios([(a, b)])[0]


def _settled(x: list[str], y: list[str]) -> float | None:
    """What a shared token, or a side without any, decides."""
    return 0.0 if not x or not y else 100.0 if set(x) & set(y) else None


def partial_token_set_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    out = [_settled(a.split(), b.split()) for a, b in pairs]
    rest = [k for k, s in enumerate(out) if s is None]
    for k, s in zip(rest, partial_ratios([(sorted_tokens(pairs[k][0]), sorted_tokens(pairs[k][1])) for k in rest]), strict=True):
        out[k] = s
    return out


def sorted_tokens(s: str) -> str:
    """The distinct tokens in order."""
    return " ".join(sorted(set(s.split())))


def partial_token_ratio(a: str, b: str) -> float:
    """100 if a token is shared; else the better partial_ratio, of sorted tokens or of distinct ones."""
    return partial_token_ratios([(a, b)])[0]


def partial_token_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    out = [100.0 if set(a.split()) & set(b.split()) else -1.0 for a, b in pairs]
    jobs, owner = [], []
    for k, (a, b) in enumerate(pairs):
        if out[k] < 0:
            for job in {(" ".join(_tokens(a)), " ".join(_tokens(b))), (sorted_tokens(a), sorted_tokens(b))}:
                jobs.append(job)
                owner.append(k)
    for k, s in zip(owner, partial_ratios(jobs), strict=True):
        out[k] = max(out[k], s)
    return out


SCORES: dict[str, Callable[[str, str], float]] = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, partial_token_set_ratio, partial_token_ratio)}
SATURATING = ("partial_token_set_ratio", "partial_token_ratio")


#: Scores that are cheaper for many pairs at once.
TOGETHER: dict[str, Callable[[Sequence[tuple[str, str]]], list[float]]] = {"partial_ratio": partial_ratios, "partial_token_set_ratio": partial_token_set_ratios, "partial_token_ratio": partial_token_ratios}


def _udf(name: str):
    many = TOGETHER.get(name) or (lambda pairs, f=SCORES[name]: [f(a, b) for a, b in pairs])

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = [(x or "", y or "") for x, y in zip(a, b, strict=True)]
        distinct = list(dict.fromkeys(rows))  # of this batch
        known = dict(zip(distinct, many(distinct), strict=True))
        return pd.Series([known[pair] for pair in rows], dtype="float64")

    return score


def similarity(name: str, a: Column, b: Column) -> Column:
    """SCORES[name] of two text columns; null counts as empty. Pairs that share a token never leave the JVM where that settles
    the score."""
    score = _udf(name)
    if name not in SATURATING:
        return score(a, b)
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    shared = F.arrays_overlap(words(a), words(b))
    # a UDF in a branch still gets every row, so settled pairs reach it as nulls, which cost nothing
    rest = score(F.when(~shared, a), F.when(~shared, b))
    return F.when(shared, F.lit(100.0)).otherwise(rest)
