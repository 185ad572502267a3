"""Quality rules: text statistics, and robust multivariate outliers among them.

DataFrame functions only. Each text gives a few statistics; documents that pass the base rules are compared with their
language and source by the minimum covariance determinant (MCD): from two deterministic starts, concentration steps
keep the three quarters of a group that lie nearest to the current estimate and estimate anew from them; of the
two results the one with the smaller determinant counts. A document is rejected if its Mahalanobis distance from that
estimate is extreme among the distances of the same group.

The statistics enter as integers (thousandths), so that sums are exact and the verdicts do not depend on the order
in which tasks finish; quantiles are taken over rounded values, so that their state has a fixed bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, fresh, small, without

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Thousandths of: log words, log word length, and roots of the rates of symbols per character, of equal lines per word and of
#: repetitions (six words each, the fewest that two equal windows cover apart) per word. Roots make counts about equally uncertain.
STATISTICS = ("v_words", "v_length", "v_symbols", "v_lines", "v_repeats")
#: Resolution of each statistic, whose square is added to every group's variance, so that statistics that hardly vary in a group leave
#: its covariance regular: one percent of the first two; and of a root of a rate what chance makes of a single event (half a unit of a
#: root of a count) in the shortest text that the base rules let pass: 500 / sqrt(50 words), or sqrt(250 characters).
FLOORS = (10, 10, 32, 71, 71)
#: Share of a group that a concentration step keeps, and what makes its covariance consistent at the normal
#: distribution for five statistics: share / P(chi2 with 7 degrees < share's quantile of chi2 with 5).
CORE_SHARE, CONSISTENCY = 0.75, 1.41
STEPS = 3
#: Groups with fewer rows join the other small groups of their language; where these are fewer together, the whole language
#: is the measure, and where that has fewer, all rows are.
MIN_GROUP = 60
#: The cube root of a squared distance is about normal. Its median and upper quartile in a group give that group's mean and spread,
#: which are at least those of chi-squared with 5 degrees; more than so many spreads above the mean is extreme.
CUBE_MEAN, CUBE_SPREAD, QUARTILE, EXTREME = 1.634, 0.36, 0.6745, 4.0
#: Positions share a long with their window's hash up to this many words; beyond, they are sorted as pairs.
PACKED_BITS = 21


def _without(c: Column, chars: str) -> Column:
    return reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit("")), chars, c)


def base_statistics(df: DataFrame, id_col: str, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """doc, the columns of `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = _without(F.col("t"), SYMBOLS)
    d = df.select(F.col(id_col).alias("doc"), *[c.alias(k) for k, c in keep.items()], text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc", *keep,
        F.array_remove(F.split("t", WORD_GAP, -1), "").alias("w"),
        F.char_length(_without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("n", F.size("w"))
    # the hash of every 3-word window
    d = d.withColumn("h", F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))))
    mask = (1 << PACKED_BITS) - 1
    packed = F.sort_array(F.transform("h", lambda h, i: h.bitwiseAND(F.lit(-1 - mask)).bitwiseOR(i.cast("long"))))
    pairs = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    small = F.col("n") <= mask
    d = d.withColumn("s", F.when(small, packed)).withColumn("p", F.when(~small, pairs))
    at = lambda x: x.bitwiseAND(F.lit(mask))
    same = lambda x, y: (F.shiftright(x, PACKED_BITS) == F.shiftright(y, PACKED_BITS)) & (F.get("h", at(x).cast("int")) == F.get("h", at(y).cast("int")))
    twice = F.transform(F.filter("s", lambda x, k: same(x, F.get("s", k + 1)) | same(x, F.get("s", k - 1))), at)
    twice_pairs = F.transform(F.filter("p", lambda x, k: (x["h"] == F.get("p", k + 1)["h"]) | (x["h"] == F.get("p", k - 1)["h"])), lambda x: x["i"])
    d = d.withColumn("r", F.sort_array(F.when(small, twice).otherwise(twice_pairs)))
    # each repeated window covers three words, less what the next one covers
    cover = F.aggregate(F.transform("r", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("r", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select("doc", *keep, F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _thousandths(c: Column) -> Column:
    return F.round(1000 * c).cast("long")


def _vector(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return d.withColumns({
        "v_words": _thousandths(F.log(n.cast("double"))),
        "v_length": _thousandths(F.log(chars / n)),
        "v_symbols": _thousandths(F.sqrt(F.col("n_symbols") / chars)),
        "v_lines": _thousandths(F.sqrt(F.col("n_dup_lines") / n)),
        "v_repeats": _thousandths(F.sqrt(F.col("n_repeat_words") / (6 * n))),
    })


GROUP = ("g_lang", "g_source")


def _distance(d: DataFrame) -> Column:
    """Squared Mahalanobis distance; d has means m_i and the precision matrix p_i_j (i >= j)."""
    x = [F.col(v) - F.col(f"m_{i}") for i, v in enumerate(STATISTICS)]
    return reduce(lambda a, b: a + b, [(1 if i == j else 2) * F.col(f"p_{i}_{j}") * x[i] * x[j] for i in range(len(x)) for j in range(i + 1)])


def _cube_root(d2: Column) -> Column:
    """Of a squared distance, to thousandths: few different values, whatever the rows, and in the order of the distances."""
    return F.round(F.cbrt(F.greatest(d2, F.lit(0.0))), 3)


def _estimate(sums: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Means, precision matrix and log determinant from counts n, sums s_i and cross sums s_i_j, by Cholesky's method."""
    k = len(STATISTICS)
    n = F.col("n")
    d = sums.select(*keys, "n", *[(F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(k)], *[
        (F.lit(consistency) * (F.col(f"s_{i}_{j}") / n - (F.col(f"s_{i}") / n) * (F.col(f"s_{j}") / n)) + F.lit(float(FLOORS[i] ** 2 if i == j else 0))).alias(f"c_{i}_{j}")
        for i in range(k) for j in range(i + 1)])
    total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    for i in range(k):
        for j in range(i):
            d = d.withColumn(f"l_{i}_{j}", (F.col(f"c_{i}_{j}") - total([F.col(f"l_{i}_{q}") * F.col(f"l_{j}_{q}") for q in range(j)])) / F.col(f"l_{j}_{j}"))
        d = d.withColumn(f"l_{i}_{i}", F.sqrt(F.greatest(F.col(f"c_{i}_{i}") - total([F.col(f"l_{i}_{q}") * F.col(f"l_{i}_{q}") for q in range(i)]), F.lit(1.0))))
    for j in range(k):  # inverse of the triangle, column by column
        for i in range(j, k):
            v = 1 / F.col(f"l_{i}_{i}") if i == j else -total([F.col(f"l_{i}_{q}") * F.col(f"z_{q}_{j}") for q in range(j, i)]) / F.col(f"l_{i}_{i}")
            d = d.withColumn(f"z_{i}_{j}", v)
    p = [total([F.col(f"z_{q}_{i}") * F.col(f"z_{q}_{j}") for q in range(i, k)]).alias(f"p_{i}_{j}") for i in range(k) for j in range(i + 1)]
    return d.select(*keys, *[f"m_{i}" for i in range(k)], *p, total([2 * F.log(F.col(f"l_{i}_{i}")) for i in range(k)]).alias("log_det"))


def _sums(d: DataFrame, keys: list[str]) -> DataFrame:
    v = STATISTICS
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(v)], *[F.sum(F.col(v[i]) * F.col(v[j])).alias(f"s_{i}_{j}") for i in range(len(v)) for j in range(i + 1)])


def _quantiles(d: DataFrame, keys: list[str], columns: list[tuple[str, str]], *q: float) -> DataFrame:
    """Exact quantiles of rounded columns. Equal values are counted in the tasks first, so that a group of any size
    reaches the task of its quantile as a bounded list of values and counts. Several q give arrays."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, (c, _) in enumerate(columns)]))
    counts = d.select(*keys, pairs.alias("x")).groupBy(*keys, "x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    at = q[0] if len(q) == 1 else f"array({', '.join(map(str, q))})"
    by = [F.expr(f"percentile(v, {at}, n) filter (where k = {k})").alias(name) for k, (_, name) in enumerate(columns)]
    return counts.groupBy(*keys).agg(*by)


def mcd(rows: DataFrame) -> DataFrame:
    """rows: GROUP and STATISTICS. One estimate per group: means, precision matrix, log determinant, and cutoff, the squared
    distance beyond which a row is extreme.

    Tables of a row or two per group go to the rows by broadcast while they are small, so that no group's rows come together."""
    k = len(STATISTICS)
    keys = [*GROUP, "start"]
    classical = _estimate(_sums(rows, list(GROUP)), list(GROUP), 1.0).withColumn("start", F.lit(0))
    # the other start: medians and median absolute deviations, of values rounded to two hundredths
    coarse = [(F.round(F.col(v) / 5) * 5).alias(v) for v in STATISTICS]
    mid = _quantiles(rows.select(*GROUP, *coarse), list(GROUP), [(v, f"m_{i}") for i, v in enumerate(STATISTICS)], 0.5)
    mid = cut(mid)
    off = rows.join(small(mid), list(GROUP)).select(*GROUP, *[f"m_{i}" for i in range(k)], *[(F.round(F.abs(F.col(v) - F.col(f"m_{i}")) / 5) * 5).alias(v) for i, v in enumerate(STATISTICS)])
    mad = _quantiles(off, list(GROUP), [(v, f"a_{i}") for i, v in enumerate(STATISTICS)], 0.5).join(mid, list(GROUP))
    robust = mad.select(*GROUP, *[f"m_{i}" for i in range(k)],
                        *[(1 / (F.pow(1.4826 * F.col(f"a_{i}"), 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"p_{i}_{j}") for i in range(k) for j in range(i + 1)],
                        F.lit(0.0).alias("log_det"), F.lit(1).alias("start"))
    now = cut(classical.unionByName(robust))
    for _ in range(STEPS):
        near = rows.join(small(now), list(GROUP)).withColumn("d", _cube_root(_distance(now)))
        bound = cut(_quantiles(near, keys, [("d", "core")], CORE_SHARE))
        core = near.join(small(bound), keys).where(F.col("d") <= F.col("core"))
        now = cut(_estimate(_sums(core, keys), keys, CONSISTENCY))
    names = [c for c in now.columns if c not in keys]
    best = cut(now.groupBy(*GROUP).agg(F.min(F.struct("log_det", "start", *[n for n in names if n != "log_det"])).alias("e")).select(*GROUP, "e.*").drop("start"))
    far = _quantiles(rows.join(small(best), list(GROUP)).select(*GROUP, _cube_root(_distance(best)).alias("d")), list(GROUP), [("d", "q")], 0.5, 0.75)
    spread = F.greatest((F.col("q")[1] - F.col("q")[0]) / QUARTILE, F.lit(CUBE_SPREAD))
    far = far.select(*GROUP, F.pow(F.greatest(F.col("q")[0], F.lit(CUBE_MEAN)) + EXTREME * spread, F.lit(3.0)).alias("cutoff"))
    return best.join(far, list(GROUP))


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: `id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance (squared, from the estimate that holds for the row's language and source; null only if the base rules reject it) and
    cutoff (the distance beyond which that estimate's rows are rejected).

    Words are maximal runs of anything but ASCII blanks; a null text has none, so it fails. Very long texts are taken
    whole, by array functions. Null languages and sources are groups like any other, a null id is a row like any other, equal rows get equal verdicts. Documents that
    fail the base rules take no part in the estimates. Groups of fewer than MIN_GROUP rows are taken together by
    language; if these are still that few, the language's estimate over all its sources holds for them, and if the
    language has that few rows itself, the one over all rows of the table. Other columns are left out, whatever their names. An empty input gives
    no rows.
    """
    out = _judged(df, id_col, text_col, lang_col, source_col, {})
    return out.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cutoff")


def _judged(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: dict[str, Column]) -> DataFrame:
    """Statistics, kept and distance of every row, with the columns of `carry`. The statistics are cut, so that texts are read once."""
    d = base_statistics(df, id_col, text_col, {"lang": F.col(lang_col), "source": F.col(source_col)} | carry)
    d = cut(_vector(d))
    lang, source = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    d = d.withColumns({"g_lang": lang, "g0": source})
    passed = d.where(~F.col("base_failed")).select("g_lang", "g0", *STATISTICS)
    groups = passed.groupBy("g_lang", "g0").agg(F.count(F.lit(1)).alias("in_group"))
    groups = cut(groups.withColumn("own", F.when(F.col("in_group") >= MIN_GROUP, F.col("g0")).otherwise(F.lit("*"))))
    groups = groups.join(groups.groupBy("g_lang", "own").agg(F.sum("in_group").alias("in_own")), ["g_lang", "own"]).join(groups.groupBy("g_lang").agg(F.sum("in_group").alias("in_lang")), "g_lang")
    pair = lambda a, b: F.struct(a.alias("g_lang"), b.alias("g_source"))
    every = [pair(F.col("g_lang"), F.col("own")), pair(F.col("g_lang"), F.lit("+")), pair(F.lit("+"), F.lit("+"))]
    measure = F.when(F.col("in_own") >= MIN_GROUP, every[0]).when(F.col("in_lang") >= MIN_GROUP, every[1]).otherwise(every[2])
    groups = cut(groups.select("g_lang", "g0", measure.alias("measure"), F.array(*every).alias("every")))
    # the rows of an estimate: all that it stands for, also those that have a closer one; only estimates that some group needs
    needed = fresh(groups.select("measure").distinct())
    members = cut(groups.select("g_lang", "g0", F.explode("every").alias("measure")).join(needed, "measure"))
    rows = passed.join(small(members), ["g_lang", "g0"]).select("measure.*", *STATISTICS)
    estimates = mcd(rows).withColumn("measure", pair(F.col("g_lang"), F.col("g_source"))).drop(*GROUP)
    rules = cut(groups.select("g_lang", "g0", "measure").join(estimates, "measure").drop("measure"))
    out = d.join(small(rules), ["g_lang", "g0"], "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance(out)))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True)))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that `assess` keeps, with all their columns, whatever their names. A row goes by its id, text, language and
    source, so each has its own verdict: a null text goes, a null id is like any other, of equal rows all stay or all go. An
    empty input gives no rows."""
    key = (text_col, lang_col, source_col)
    found = _judged(df, id_col, text_col, lang_col, source_col, {"row_hash": F.xxhash64(*key)})
    return without(df, found.where("not kept").select(F.col("doc").alias(id_col), "row_hash"), id_col, key)
