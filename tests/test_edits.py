"""Joins within an edit distance against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import similarity
from millrace.operators import curation, edits, matching
from tests.test_queries import edits as distance


def some_words(rng, n, letters, most):
    out = {"", "a", "b", "ab"}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
        out.add(w)
        for _ in range(rng.randrange(3)):  # a close one
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choice(["", "z", "é"]) + w[k + rng.randrange(2) :]
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("d", [0, 1, 2, 3, 4])
def test_close_pairs(spark, d):
    """Short words, long ones in segments, and pairs of both kinds."""
    words = some_words(random.Random(d), 220, "ab", 9) + [w for w in some_words(random.Random(10 + d), 120, "abcd", 45) if len(w) > 6]
    words = sorted(set(words))
    got = {(r.a, r.b): r.distance for r in edits.close_pairs(spark.createDataFrame([(w,) for w in [*words, None, *words[:5]]], "w string"), "w", d).collect()}
    want = {(a, b): k for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= d and (k := distance(a, b)) <= d}
    assert got == want and (d == 0 or any(len(a) >= edits.long_from(d) for a, _ in got) or d == 1)


@pytest.mark.parametrize("d", [1, 2])
def test_within_groups(spark, d, monkeypatch):
    monkeypatch.setattr(edits, "DELETIONS", 20)
    rng = random.Random(20 + d)
    left = [(rng.choice("xy"), w) for w in some_words(rng, 120, "abc", 14)] + [(None, "abc"), ("x", None)]
    right = [(rng.choice("xy"), w) for w in some_words(rng, 120, "abc", 14)] + [(None, "abc"), ("x", None)]
    got = edits.within(spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string"), "a", "b", d, ["k"])
    want = {(k, a, b, n) for k, a in left for h, b in right if None not in (k, a, b) and k == h and (n := distance(a, b)) <= d}
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_many_words_stay_near_linear(spark):
    """210,000 words, of 2 x 10**10 pairs: a few candidates a word."""
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(7, 20))) for _ in range(200_000)})
    words += [w[:3] + "x" + w[4:] for w in words[::20]]

    w = spark.createDataFrame([(x,) for x in words], "a string").distinct()
    index, probe = edits._keyed(w, "a", 2, True), edits._keyed(w.select(F.col("a").alias("b")), "b", 2, False)
    met = index.join(probe.hint("merge"), ["_key", "_whole"]).where("a < b").select("a", "b", F.levenshtein("a", "b", 2).alias("d"))
    rows, close = met.agg(F.count(F.lit(1)), F.count_if(F.col("d") >= 0)).first()
    assert 9_000 <= close <= rows < 10 * len(words)


def test_typo_map(spark):
    rng = random.Random(4)
    words = [w for w in some_words(rng, 60, "abcd", 9) if w]
    rows = [(rng.choice(["x", "y", "z"]), " ".join(rng.choice(words) for _ in range(5))) for _ in range(120)]
    for d, least in ((1, 4), (2, 2)):
        got = {(r.k, r.token): r.representative for r in curation.typo_map(spark.createDataFrame(rows, "k string, t string"), "k", "t", d, least).collect()}
        count = {}
        for k, t in rows:
            for w in t.split():
                count[k, w] = count.get((k, w), 0) + 1
        want = {}
        for (k, t), n in count.items():
            near = [(m, len(r), r) for (h, r), m in count.items() if h == k and len(r) >= least and (m, len(r), r) >= (n, len(t), t) and distance(t, r) <= d]
            want[k, t] = max(near)[2] if near else t
        assert got == want


@pytest.mark.parametrize("cutoff", [75.0, 90.0])
def test_collect_aliases(spark, cutoff):
    """Short and long names, by lengths and by pairs of letters."""
    rng = random.Random(int(cutoff))
    canonical = [w.title() for w in some_words(rng, 40, "abcd ", 25) if w]
    names = sorted({*some_words(rng, 60, "abcd ", 25)} | {c[: rng.randrange(len(c) + 1)] + rng.choice(["", "x"]) + c[rng.randrange(len(c)) :] for c in canonical for _ in range(3)} | {c.upper() for c in canonical[::5]} | {"AB"})
    got = {r.c: r.aliases for r in matching.collect_aliases(spark.createDataFrame([(c,) for c in canonical], "c string"), spark.createDataFrame([(n,) for n in [*names, None]], "n string"), "c", "n", cutoff, {"AB": canonical[0]}).collect()}
    want = {c: sorted({n for n in names if similarity.ratio(c.lower(), n.lower()) >= cutoff} | ({"AB"} if c == canonical[0] else set())) for c in canonical}
    assert got == want and sum(map(len, want.values())) > 60
