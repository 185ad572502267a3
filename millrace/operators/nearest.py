"""The most similar candidate of each text by partial ratio, for many texts and many candidates, with the same answer as all pairs.

Three steps, each over what the one before leaves open:

1. Containment gives the full score. The rarest gram of the shorter text meets the grams of the longer ones.
2. A score of SURE or more leaves so few letters unmatched that many trigrams are common. An inverted index of trigrams finds such pairs:
   of the shorter text only as many of the rarest trigrams are looked up as must hold a common one, and pairs with too
   few common ones go. The few pairs with most in common are scored in any case, which gives the others a lower bound.
3. What is still below SURE meets the candidates in blocks. Letters and pairs of letters in common bound a score; blocks whose letters
   taken together cannot reach a text's lower bound are never met, and in a block only the candidates that can beat it are
   scored, those of the highest bound first.

Joins on grams are asked to sort both sides, as the size of a side with a row per gram is not foreseen. Blocks hold at most BLOCK candidates, which meet about SHARE texts at a time, by counts taken beforehand; a hot block has more shares.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import partial_ratios
from millrace.held import held
from millrace.operators.ranks import numbered

#: Score from which trigrams find every pair; pairs scored for a lower bound; candidates of a block and texts of a share.
SURE, TRIED, BLOCK, SHARE = 90.0, 3, 2048, 512
#: Blocks whose letters are sent to the tasks that deal out texts; of more, texts meet every block.
MOST_BLOCKS = 10_000
#: Classes of letters, and of pairs of letters, whose counts bound a score.
LETTERS, PAIRS = 64, 1024


def bare(c: Column) -> Column:
    """The distinct words in order, parted by single spaces."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))), " ")


def grams(c: Column, n: int) -> Column:
    """All stretches of n letters in order; none in a shorter text."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def counted(g: Column) -> Column:
    """An array's entries, told apart where they repeat: what two such arrays share is what the multisets share."""
    return F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def contained(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """s, c: texts and candidates of which one contains the other. texts: s, candidates: c, each of distinct, non-empty texts."""
    out = []
    for short, long, a, b in ((candidates, texts, "c", "s"), (texts, candidates, "s", "c")):
        every = long.select(b, F.explode(F.array_distinct(grams(F.col(b), 3))).alias("g"))
        often = every.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        # a gram that no longer text has is the rarest, and meets none
        rarest = short.select(a, F.explode(F.array_distinct(grams(F.col(a), 3))).alias("g")).join(often.hint("merge"), "g", "left").groupBy(a).agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
        tiny = short.where(F.length(a) < 3).select(a, F.col(a).alias("g"))
        parts = long.select(b, F.explode(F.array_distinct(F.concat(grams(F.col(b), 1), grams(F.col(b), 2)))).alias("g"))
        met = rarest.join(every.hint("merge"), "g").unionByName(tiny.join(parts.hint("merge"), "g"))
        out.append(met.where((F.length(a) <= F.length(b)) & F.col(b).contains(F.col(a))).select("s", "c"))
    return out[0].unionByName(out[1]).distinct()


def _least_common(n: Column, score: float) -> Column:
    """Trigrams that the shorter text, of n letters, has in common with one that scores `score`: with L letters matched of the stretch, and
    t for score / 100, L >= t (n + stretch) / 2 and the stretch >= t n / (2 - t); each unmatched letter breaks two."""
    t = score / 100
    return F.ceil((2.5 * t - 2) * (1 + t / (2 - t)) * n - 2 - 1e-9)


def by_trigrams(texts: DataFrame, candidates: DataFrame, score: float = SURE, tried: int = TRIED) -> DataFrame:
    """s, c, sure: the pairs that can reach `score`, where the shorter text has at least `_least_common` of one; and for each s the
    `tried` others with most in common of those that met. texts: s, candidates: c, distinct."""
    grouped = lambda df, c: held(df.select(c, counted(grams(F.col(c), 3)).alias(f"g{c}")).where(F.size(f"g{c}") > 0))
    x, y = grouped(texts, "s"), grouped(candidates, "c")
    often = held(y.select(F.explode("gc").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    met = []
    for short, long, a, b in ((x, y, "s", "c"), (y, x, "c", "s")):
        rare = short.select(a, F.explode(f"g{a}").alias("g")).join(often.hint("merge"), "g", "left").groupBy(a).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("o"))
        need = F.greatest(F.lit(1), _least_common(F.length(a), score))
        first = rare.select(a, F.explode(F.slice("o", F.lit(1), F.greatest(F.lit(1), F.size("o") - need + 1).cast("int"))).alias("o")).select(a, F.col("o.g").alias("g"))
        meet = first.join(long.select(b, F.explode(f"g{b}").alias("g")).hint("merge"), "g").where(F.length(a) <= F.length(b))
        met.append(meet.select("s", "c"))
    pairs = met[0].unionByName(met[1]).distinct().join(x, "s").join(y, "c")
    common = F.size(F.array_intersect("gs", "gc"))
    pairs = pairs.select("s", "c", common.alias("n")).withColumn("sure", F.col("n") >= _least_common(F.least(F.length("s"), F.length("c")), score))
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "c"))
    return pairs.withColumn("place", place).where(F.col("sure") | (F.col("place") <= tried)).select("s", "c", "sure")


def letter_counts(texts: list[str]) -> np.ndarray:
    """A column per text: how often it has the letters of each class."""
    out = np.zeros((LETTERS, len(texts)), np.int16)
    for k, t in enumerate(texts):
        out[:, k] = np.minimum(np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) % LETTERS, minlength=LETTERS), 32_000)
    return out


def pair_counts(texts: list[str]) -> np.ndarray:
    """A column per text: how often it has the pairs of neighbouring letters of each class."""
    out = np.zeros((PAIRS, len(texts)), np.float32)
    for k, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
        np.add.at(out[:, k], (c[:-1] * 31 + c[1:]) % PAIRS, 1)
    return out


def bounds(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Rows: texts of letter counts a and lengths n; columns: candidates. No partial ratio is higher.

    With L letters matched of the shorter text and a stretch of k: L is at most the letters in common, and k at least L. Of the L - 1
    neighbours among matched letters, all but one for each unmatched letter are pairs in common, so with p of these n + k is at least
    3 L - 1 - p. The ratio 2 L / (n + k) is largest where both bounds on k meet, or at the most letters. `pairs`: p, or more."""
    common = np.zeros((a.shape[1], b.shape[1]), np.int32)
    for i in range(LETTERS):
        if a[i].any() and b[i].any():
            common += np.minimum(a[i][:, None], b[i][None, :])
    short = np.minimum(n[:, None], m[None, :])
    x = common if pairs is None else np.minimum(common, (short + 1 + pairs) / 2)
    return 200.0 * x / (short + x)


def best_of_block(texts: list[str], least: np.ndarray, names: list[str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each text the place of its best candidate in `names` (-1: none scores above `least`, or as high with a smaller `order`),
    its score, and the pairs scored. least: score and order of what each text has already, as two rows."""
    size = lambda x: np.array([len(t) for t in x])
    best, rank, at, scored = least[0].copy(), least[1].copy(), np.full(len(texts), -1), 0
    counts, lengths, doubles = letter_counts(names), size(names), pair_counts(names)
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        # products of counts are no less than the pairs in common
        bound = bounds(letter_counts(part), size(part), counts, lengths, np.rint(pair_counts(part).T @ doubles)) + 1e-9
        # what can beat a text's best, from the highest bound; equal bounds by order, so that ties are settled early
        queues = []
        for i in range(len(part)):
            js = np.nonzero(bound[i] >= best[lo + i])[0]
            queues.append(js[np.lexsort((order[js], -bound[i, js]))])
        next_, step, live = 0, 1, [i for i, q in enumerate(queues) if len(q)]
        while live:
            jobs = []
            for i in live:
                for j in queues[i][next_ : next_ + step].tolist():
                    u = bound[i, j]
                    if u > best[lo + i] or u == best[lo + i] and order[j] < rank[lo + i]:
                        jobs.append((i, j))
            for (i, j), s in zip(jobs, partial_ratios([(part[i], names[j]) for i, j in jobs]), strict=True):
                if s > best[lo + i] or s == best[lo + i] and order[j] < rank[lo + i]:
                    best[lo + i], rank[lo + i], at[lo + i] = s, order[j], j
            scored += len(jobs)
            next_ += step
            live = [i for i in live if next_ < len(queues[i]) and bound[i, queues[i][next_]] >= best[lo + i]]
            step = min(2 * step, 16)
    return at, best, scored


def nearest(texts: DataFrame, candidates: DataFrame, sure: float = SURE, block: int = BLOCK) -> DataFrame:
    """s, c, score (0 to 100): for each text its most similar candidate by partial ratio, the one of smallest id among equals.
    texts: s; candidates: s, id, one id per text; all texts distinct and not empty. Without candidates no rows."""
    known = held(numbered(held(candidates.select(F.col("s").alias("c"), "id")), {"rank": [F.col("id"), F.col("c")]}).select("c", "rank"))
    top = lambda df: df.groupBy("s").agg(F.max_by(F.struct("c", "rank", "score"), F.struct("score", -F.col("rank"))).alias("b")).select("s", "b.*")
    whole = held(top(contained(texts, known.select("c")).join(known, "c").withColumn("score", F.lit(100.0))))
    rest = held(texts.join(whole.select("s"), "s", "left_anti"))
    pairs = by_trigrams(rest, known.select("c"), sure)
    met = held(top(pairs.mapInPandas(_scores, "s string, c string, score double").join(known, "c")))
    left = held(rest.join(met, "s", "left").where(F.col("score").isNull() | (F.col("score") < sure)))
    after = in_blocks(left, known, block)
    done = met.join(after.select("s"), "s", "left_anti")
    return whole.unionByName(done).unionByName(after.select("s", "c", "rank", "score")).select("s", "c", "score")


def _scores(batches):
    for pdf in batches:
        yield pdf[["s", "c"]].assign(score=partial_ratios(list(zip(pdf["s"], pdf["c"], strict=True))))


def in_blocks(left: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """s, c, rank, score, scored (pairs looked at): the best of all candidates. left: s with c, rank and score of the best so far, or
    nulls; known: c and rank, held."""
    blocks = max(1, -(-known.count() // block))
    # like lengths and letters come together
    shape = [F.length("c"), F.array_join(F.array_sort(F.array_distinct(F.split("c", ""))), ""), F.col("c")]
    placed = held(numbered(known, {"place": shape}).select("c", "rank", F.floor((F.col("place") - 1) / block).cast("long").alias("b")))
    met = left.select("s", "c", "rank", "score")
    dealt = held(_dealt(met, placed) if blocks <= MOST_BLOCKS else met.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    shares = dealt.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / min(SHARE, block)).alias("shares"))
    dealt = dealt.join(shares, "b").withColumn("share", F.pmod(F.xxhash64("s"), F.col("shares"))).select("b", "share", "s", "c", "rank", "score")
    sent = placed.join(shares, "b").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("b", "share", "c", "rank")

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        schema = pa.schema([("s", pa.string()), ("c", pa.string()), ("rank", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])
        if not len(x) or not len(y):
            return schema.empty_table()
        texts, names, rank = x["s"].to_pylist(), y["c"].to_pylist(), y["rank"].to_numpy()
        had = [np.array([-1.0 if v is None else v for v in x["score"].to_pylist()]), np.array([np.iinfo(np.int64).max if v is None else v for v in x["rank"].to_pylist()], np.int64)]
        at, best, scored = best_of_block(texts, had, names, rank)
        old = x["c"].to_pylist()
        rows = [(t, names[k] if k >= 0 else c, int(rank[k]) if k >= 0 else int(r), float(s), 0) for t, k, c, r, s in zip(texts, at.tolist(), old, had[1], best, strict=True) if k >= 0 or c is not None]
        if rows:
            rows[0] = (*rows[0][:4], scored)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    found = dealt.groupBy("b", "share").cogroup(sent.groupBy("b", "share")).applyInArrow(score, "s string, c string, rank long, score double, scored long")
    best = F.max_by(F.struct("c", "rank", "score"), F.struct("score", -F.col("rank"))).alias("b")
    return held(found.groupBy("s").agg(best, F.sum("scored").alias("scored")).select("s", "b.*", "scored"))


def _dealt(met: DataFrame, placed: DataFrame) -> DataFrame:
    """met with b: a row for each block whose letters taken together can reach the text's score."""
    envelopes = placed.groupBy("b").agg(F.collect_list("c").alias("c")).mapInPandas(_envelope, "b long, shortest int, most array<int>")
    frames = met.sparkSession.sparkContext.broadcast([(r.b, r.shortest, r.most) for r in envelopes.collect()])  # at most MOST_BLOCKS rows

    def deal(batches):
        b = np.array([x[0] for x in frames.value])
        m, most = np.array([x[1] for x in frames.value]), np.array([x[2] for x in frames.value], np.int16).reshape(-1, LETTERS).T
        for pdf in batches:
            texts = pdf["s"].tolist()
            if not texts or not len(b):
                continue
            n = np.array([len(t) for t in texts])
            i, j = np.nonzero(bounds(letter_counts(texts), n, most, m) >= pdf["score"].fillna(-1.0).to_numpy()[:, None])
            out = pdf.iloc[i].copy()
            out["b"] = b[j]
            yield out

    return met.mapInPandas(deal, "s string, c string, rank long, score double, b long")


def _envelope(batches):
    for pdf in batches:
        rows = [(b, min(map(len, c)), letter_counts(list(c)).max(1).tolist()) for b, c in zip(pdf["b"], pdf["c"], strict=True)]
        yield pd.DataFrame(rows, columns=["b", "shortest", "most"])
