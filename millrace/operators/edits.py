"""Joins of words within an edit distance, by keys that such words must share.

Short words share what is left of them after at most `distance` letters are taken out of each (deletion neighbourhoods). These grow
too many with the length, so longer words are cut into distance + 1 segments: edits leave one of them whole, and it stands in the
other word near its place, where only the few starts count that the edits before and after it allow. Keys are hashes; the distance itself
decides in the end. Words meet by equi-joins on keys, so a length or a group that holds many words is no hot spot. The joins are asked to
sort both sides: the size of a side with a row per key is not foreseen, and it would be broadcast for the size of its words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a segment that make it worth looking up, and deletions of a word that are too many in any case.
LETTERS, DELETIONS = 3, 200


def long_from(distance: int) -> int:
    """The length from which words are cut into segments."""
    n = distance + 1
    while n < max(LETTERS * (distance + 1), 1) and sum(math.comb(n, k) for k in range(distance + 1)) <= DELETIONS:
        n += 1
    return n


def _some(ok: Column, array: Column) -> Column:
    return F.when(ok, array).otherwise(F.array().cast("array<bigint>"))


def deletions(w: Column, distance: int) -> Column:
    """Hashes of what is left of a word after 0 to `distance` letters are taken out."""
    without = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>"))
    level = every = F.array(w)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, without)))
        every = F.concat(every, level)
    return F.transform(F.array_distinct(every), lambda x: F.xxhash64(F.lit("left"), x))


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i (from 0) of a word's `parts`: the later ones are a letter longer where they differ."""
    size, more = F.floor(length / parts), F.pmod(length, F.lit(parts))
    return i * size + F.greatest(F.lit(0), i - (parts - more)), size + F.when(i >= parts - more, 1).otherwise(0)


def segments(w: Column, distance: int) -> Column:
    """Hashes of a word's segments, with its length and their numbers."""

    def key(i: Column) -> Column:
        start, size = _segment(F.length(w), i, distance + 1)
        return F.xxhash64(F.lit("part"), F.length(w).cast("long"), i.cast("long"), F.substr(w, (start + 1).cast("int"), size.cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(distance)), key)


def probes(w: Column, distance: int) -> Column:
    """Hashes of the stretches of a word that can be a segment of one as long or up to `distance` letters shorter."""

    def of_segment(shorter: Column, i: Column) -> Column:
        start, size = _segment(shorter, i, distance + 1)
        gap = F.length(w) - shorter
        # edits before the segment shift it by their number at most, and so do those after it, from the other end
        lo = F.greatest(F.lit(0), start - i, start + gap - (distance - i))
        hi = F.least(F.length(w) - size, start + i, start + gap + (distance - i))
        key = lambda x: F.xxhash64(F.lit("part"), shorter.cast("long"), i.cast("long"), F.substr(w, (x + 1).cast("int"), size.cast("int")))
        return _some(lo <= hi, F.transform(F.sequence(lo, hi), key))

    shortest = F.greatest(F.lit(long_from(distance)), F.length(w) - distance)
    each = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: of_segment(n, i)))
    return _some(F.length(w) >= shortest, F.array_distinct(F.flatten(F.transform(F.sequence(shortest, F.length(w)), each))))


def _keyed(df: DataFrame, word: str, distance: int, index: bool) -> DataFrame:
    """df with a row per key; `_whole`: the key is of a kind that both sides have alike."""
    w, limit = F.col(word), long_from(distance)
    whole = _some(F.length(w) < limit + distance, deletions(w, distance))
    parts = _some(F.length(w) >= limit, segments(w, distance) if index else probes(w, distance))
    key = lambda a, kind: F.transform(a, lambda k: F.struct(k.alias("_key"), F.lit(kind).alias("_whole")))
    return df.withColumn("_k", F.explode(F.concat(key(whole, True), key(parts, False)))).select(*df.columns, "_k.*")


def within(left: DataFrame, right: DataFrame, left_word: str, right_word: str, distance: int, on: Sequence[str] = ()) -> DataFrame:
    """on, left_word, right_word, distance (long): the pairs of words, equal ones included, of rows that agree in `on`, up to an edit
    distance. Words and the columns of `on` are distinct on either side; null words and keys meet nothing."""
    a, b = left.select(*on, left_word), right.select(*on, right_word)
    keys = [*on, "_key", "_whole"]
    met = _keyed(a, left_word, distance, True).join(_keyed(b, right_word, distance, False).hint("merge"), keys)
    # the segments of the right words in the left ones
    back = _keyed(b, right_word, distance, True).where("not _whole").join(_keyed(a, left_word, distance, False).where("not _whole").hint("merge"), keys)
    columns = [*on, left_word, right_word]
    far = F.levenshtein(left_word, right_word, distance).cast("long")
    pairs = met.select(*columns).unionByName(back.select(*columns)).where(F.abs(F.length(left_word) - F.length(right_word)) <= distance).withColumn("distance", far)
    return pairs.where("distance >= 0").distinct()


def close_pairs(words: DataFrame, column: str, distance: int) -> DataFrame:
    """a < b and their edit distance, up to `distance`, of distinct words; null is none."""
    w = words.select(F.col(column).alias("a")).where("a is not null").distinct()
    index, probe = _keyed(w, "a", distance, True), _keyed(w.select(F.col("a").alias("b")), "b", distance, False)
    met = index.join(probe.hint("merge"), ["_key", "_whole"]).where((F.col("a") < F.col("b")) | ~F.col("_whole") & (F.col("a") > F.col("b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.abs(F.length("a") - F.length("b")) <= distance)
    return pairs.withColumn("distance", F.levenshtein("a", "b", distance).cast("long")).where("distance >= 0").distinct()
