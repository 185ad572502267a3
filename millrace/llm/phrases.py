"""Phrase collocations from vertical positional inverted lists.

The words of a block of text (a segment, of one language) are numbered by their places, with a gap wherever a piece ends; the index has
a row per segment and word with the list of the word's places. The length of a word's lists is its frequency. Frequent words
get numbers, which go back to the segments that hold them. There the lists are extended: the places after a phrase's
occurrences are merged with the places of the words that may follow, all lists of a segment side by side, so that what is left is the list of
each longer phrase, its length the exact frequency in the segment. Spark adds the lengths up; only phrases that are frequent
over all segments are extended again, since a phrase is no more frequent than its parts.

No step brings the rows of a word or a language into one task: a word has at most a row per segment, a segment is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_batches, written

#: Occurrences that make a phrase; per cent of a phrase's frequency from which a longer one stands for it; rows per language.
LEAST, WITHIN, TOP = 10, 50, 2000
SCALE = 1_000_000
#: Bytes of text of a segment, and of all that a task holds back to fill segments.
SEGMENT, HELD = 8 << 20, 32 << 20
#: Rows that tasks hand on at a time.
BATCH = 20_000
#: Groups in which the best rows of a language are found before they meet, from many to one.
ROUNDS = (256, 16, 1)

#: Lower case of A to Z, other bytes as they are; what ends a piece, what parts words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_GAP = _ENDS.copy()
_GAP[[9, 32]] = True


def split_words(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased bytes and their places: one more from word to word, two more where a piece ends between them."""
    gap = _GAP[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, stops = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    ends = np.nonzero(_ENDS[data])[0]
    new_piece = np.diff(np.searchsorted(ends, starts), prepend=0) > 0
    place = np.arange(len(starts)) + np.cumsum(new_piece)
    kept = data[~gap]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), place


def pack(place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising lists, one after another (`first`: where each begins), as differences in groups of seven bits, the lowest group first.
    The bytes, and where each list begins in them."""
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    size = 1 + (step >= 1 << 7) + (step >= 1 << 14) + (step >= 1 << 21) + (step >= 1 << 28)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        has = np.nonzero(size > k)[0]
        out[at[has] + k] = (step[has] >> 7 * k) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, np.append(at[first], at[-1])


def unpack(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The lists again, one after another, from their bytes and lengths."""
    last = data < 128
    start = np.concatenate([[0], np.nonzero(last)[0][:-1] + 1])
    shift = (np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))) * 7
    step = np.add.reduceat((data & 127).astype(np.int64) << shift, start)
    total = np.cumsum(step)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    return total - np.repeat(total[first] - step[first], n)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and text to segment, lang, local (a word's number in the segment), word, n, places."""
    segment = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def lists(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal segment
        data = _LOWER[np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)]
        size.pop(lang)
        words, place = split_words(data)
        if not len(words):
            return
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(coded.dictionary))
        packed, at = pack(place[order], np.concatenate([[0], np.cumsum(n)[:-1]]))
        k = len(n)
        places = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(packed)])
        whole = pa.record_batch([pa.array(np.full(k, segment)), pa.array([lang] * k), pa.array(np.arange(k, dtype=np.int32)), coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64)), places], ["segment", "lang", "local", "word", "n", "places"])
        segment += 1
        for lo in range(0, k, BATCH):
            yield whole.slice(lo, BATCH)

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            held.setdefault(lang, []).append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size[lang] = size.get(lang, 0) + len(held[lang][-1]) + 1
            if size[lang] >= SEGMENT:
                yield from lists(lang)
            elif sum(size.values()) >= HELD:
                yield from lists(max(size, key=size.__getitem__))
    for lang in list(held):
        yield from lists(lang)


def _segment(t: pa.Table, numbers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of a segment's frequent words in order, and the words' numbers there. t: local, n, places; numbers: local, id."""
    local = numbers["local"].to_numpy()
    order = np.argsort(t["local"].to_numpy())
    rows = order[np.searchsorted(t["local"].to_numpy()[order], local)]
    n = t["n"].to_numpy()[rows]
    data = np.frombuffer(b"".join(t["places"].take(pa.array(rows)).to_pylist()), np.uint8)
    place = unpack(data, n)
    word = np.repeat(numbers["id"].to_numpy(), n)
    by_place = np.argsort(place)
    return place[by_place], word[by_place]


def follow(ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two rising lists: which occurrences, ending at `ends`, have a word at the next place, and which word that is."""
    at = np.searchsorted(place, ends + 1)
    hit = np.nonzero(at < len(place))[0]
    hit = hit[place[at[hit]] == ends[hit] + 1]
    return hit, at[hit]


def _slices(columns: list[np.ndarray], schema: pa.Schema) -> pa.Table:
    """Columns as a table that travels in small batches, so that the JVM holds little of it at a time."""
    whole = pa.table([pa.array(c) for c in columns], schema=schema)
    return pa.Table.from_batches(whole.to_batches(max_chunksize=BATCH), schema)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the lengths of their lists."""
    return np.unique(keys, return_counts=True)


def _pairs(t: pa.Table, numbers: pa.Table) -> pa.Table:
    """segment, pair, n: phrases of two frequent words by the lengths of their lists in a segment."""
    schema = pa.schema([("segment", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])
    if not len(t) or not len(numbers):
        return schema.empty_table()
    place, word = _segment(t, numbers)
    a, b = follow(place, place)
    pair, n = _tally(word[a] << 32 | word[b])
    return _slices([np.full(len(pair), t["segment"][0].as_py()), pair, n], schema)


def _triples(t: pa.Table, numbers: pa.Table) -> pa.Table:
    """pair, next (pair), n: frequent pairs extended by a word that is in a frequent pair with their second. numbers: local, id (words), pair."""
    schema = pa.schema([("pair", pa.int64()), ("next", pa.int64()), ("n", pa.int64())])
    known = np.sort(numbers["pair"].drop_null().to_numpy())
    numbers = numbers.filter(pc.is_valid(numbers["local"]))
    if not len(t) or not len(numbers) or not len(known):
        return schema.empty_table()
    place, word = _segment(t, numbers)
    a, b = follow(place, place)
    pair = word[a] << 32 | word[b]
    at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
    frequent = known[at] == pair
    # the list of each frequent pair, by its second word, meets those of the pairs that begin there
    begin, end, at = place[a][frequent], place[b][frequent], at[frequent]
    x, y = follow(end - 1, begin)
    key, n = _tally(at[x] << 32 | at[y])
    return _slices([known[key >> 32], known[key & 0xFFFFFFFF], n], schema)


def numbered_words(index: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id: words of at least `least` occurrences, with numbers from 0 without gaps; one row per partition reaches the others."""
    words = index.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = cut(words.withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))
    counts = words.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = words.join(F.broadcast(counts), "_p")
    number = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # two numbers make a key of 64 bits
    fits = F.when(number < 1 << 31, number).otherwise(F.raise_error(F.lit("more than 2**31 frequent words")).cast("long"))
    return cut(out.select("lang", "word", "f", fits.alias("id")))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """Exact: 38 digits hold a squared and a million for counts up to 10**13; a quotient is at most SCALE."""
    wide = lambda c: c.cast("decimal(13,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    q = wide(l) * wide(r)
    return ((top - top % q) / q).cast("long")


def _best(df: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language and their rank. They are found in many groups first, then in fewer."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in ROUNDS:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        df = df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return df


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of two and three words of each language, by score, a and
    phrase. a is the phrase's frequency, l and r those of its parts at the cut of lowest score, n all words of the language.

    A to Z count as a to z. Pieces end at `.,;:!?` and line ends, words at spaces and tabs; phrases lie within a
    piece and overlap. The score of a cut is 1,000,000 a a / (l r), rounded down, without overflow; of cuts that score the same the
    first counts. Phrases of fewer than `least` occurrences are none; nor are those inside a longer one that has at least `within` per
    cent of their occurrences. A null text is empty, a null language is `und`; a language without such phrases has no
    rows. Repeated rows count each time. A very long text is one segment, taken whole. Other columns do not matter, whatever their names.
    An empty input gives no rows."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    index, place = written(map_batches(rows, _index, "segment long, lang string, local int, word string, n long, places binary"), "postings")
    total = index.groupBy("lang").agg(F.sum("n").alias("n"))
    words = numbered_words(index, least)
    # the numbers of frequent words go back to the segments that hold them
    numbers, numbers_at = written(index.select("segment", "local", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("segment", "local", "id"), "numbers")
    lists = index.select("segment", "local", "n", "places").groupBy("segment")
    found = lists.cogroup(numbers.groupBy("segment")).applyInArrow(_pairs, "segment long, pair long, n long")
    # a pair has at most a row per segment
    f = F.sum("n").over(Window.partitionBy("pair"))
    pairs, pairs_at = written(found.withColumn("f", f).where(F.col("f") >= least).select("segment", "pair", "f"), "pairs")
    both = numbers.select("segment", "local", "id", F.lit(None).cast("long").alias("pair")).unionByName(pairs.select("segment", F.lit(None).cast("int").alias("local"), F.lit(None).cast("long").alias("id"), "pair"))
    found = lists.cogroup(both.groupBy("segment")).applyInArrow(_triples, "pair long, next long, n long")
    triples = cut(found.groupBy("pair", "next").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    pairs = cut(pairs.groupBy("pair").agg(F.first("f").alias("a")))
    for x in (numbers_at, pairs_at):
        drop(spark, x)

    half = lambda c, k: F.shiftright(c, 32) if k == 0 else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    word = lambda k: words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 0 else []))
    # longer phrases that hold a pair
    longest = triples.select(F.explode(F.array("pair", "next")).alias("pair"), "a").groupBy("pair").agg(F.max("a").alias("longer"))
    two = pairs.join(longest, "pair", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    two = two.select(half("pair", 0).alias("id0"), half("pair", 1).alias("id1"), "a").join(word(0), "id0").join(word(1), "id1")
    two = two.select("lang", F.concat_ws(" ", "word0", "word1").alias("phrase"), "a", F.col("f0").alias("l"), F.col("f1").alias("r"), _score(F.col("a"), F.col("f0"), F.col("f1")).alias("score"))
    part = lambda c: pairs.select(F.col("pair").alias(c), F.col("a").alias(f"f_{c}"))
    three = triples.join(part("pair"), "pair").join(part("next"), "next").select("a", "f_pair", "f_next", half("pair", 0).alias("id0"), half("pair", 1).alias("id1"), half("next", 1).alias("id2"))
    for k in range(3):
        three = three.join(word(k), f"id{k}")
    first, second = _score(F.col("a"), F.col("f0"), F.col("f_next")), _score(F.col("a"), F.col("f_pair"), F.col("f2"))
    three = three.withColumns({"s1": first, "s2": second})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "word0", "word1", "word2").alias("phrase"), "a", F.when(early, F.col("f0")).otherwise(F.col("f_pair")).alias("l"), F.when(early, F.col("f_next")).otherwise(F.col("f2")).alias("r"), F.least("s1", "s2").alias("score"))
    best = cut(_best(two.unionByName(three), top).join(F.broadcast(cut(total)), "lang"))  # a row per language
    drop(spark, place)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same rows in DuckDB."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS x, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT f.lang, f.k, f.phrase, f.a, b.a AS l, e.a AS r, b.k AS cut, (f.a::HUGEINT * f.a * {SCALE} // (b.a::HUGEINT * e.a))::BIGINT AS score
    FROM f JOIN f b ON b.lang = f.lang AND b.k < f.k AND b.phrase = array_to_string(f.x[1:b.k], ' ') JOIN f e ON e.lang = f.lang AND e.k = f.k - b.k AND e.phrase = array_to_string(f.x[b.k + 1:], ' ')
    WHERE f.k > 1 QUALIFY row_number() OVER (PARTITION BY f.lang, f.phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(x[s:s + 1], ' ') AS phrase, max(a) AS longer FROM f, (SELECT unnest([1, 2]) AS s) WHERE k = 3 GROUP BY ALL)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, n, score
FROM c JOIN n USING (lang) LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase AND c.k = 2
WHERE longer IS NULL OR 100 * longer < {WITHIN} * a QUALIFY rank <= {TOP}"""
