"""Partial ratios from one table against one comparison per stretch, and the join on the nearest candidate against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import similarity
from millrace.operators import matching, nearest
from millrace.plans import registry


def slide(short, long):
    n = len(short)
    return max(similarity.ratio(short, long[max(i, 0) : i + n]) for i in range(-n + 1, len(long)))


def stretches(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    return max(slide(a, b), slide(b, a)) if len(a) == len(b) else slide(*sorted((a, b), key=len))


def text(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


@pytest.mark.parametrize("cells", [64, 1 << 22])
def test_partial_ratios(monkeypatch, cells):
    """Few and many letters, equal lengths, empty texts, letters beyond ASCII and beyond the first plane; in passes of a pair and of many."""
    monkeypatch.setattr(similarity, "PASS_CELLS", cells)
    rng = random.Random(1)
    pairs = [(text(rng, rng.choice(["ab", "abcde ", "é日a😀"]), 14), text(rng, rng.choice(["ab", "abcdé 😀"]), 24)) for _ in range(1500)]
    assert similarity.partial_ratios(pairs) == [stretches(a, b) for a, b in pairs]
    assert [similarity.partial_ratio(a, b) for a, b in pairs[:40]] == [stretches(a, b) for a, b in pairs[:40]]


def test_strands_give_every_stretch():
    rng = random.Random(2)
    for _ in range(30):
        a, b = text(rng, "abc", 9) or "a", text(rng, "abc", 12) or "b"
        began = similarity.strands([a], [b])[:, 0]
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                assert similarity.lcs(a, b[i:j]) == j - i - int((began[:j] >= i).sum())


def test_long_texts_take_one_pass():
    """A window of 2,000 letters in 40,000: the number of steps is the sum of the lengths, where windows one by one take their product."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcd ") for _ in range(40_000))
    part = long[20_000:22_000]
    broken = part[:700] + "x" + part[701:]
    assert similarity.partial_ratio(broken, long) == pytest.approx(100 * 1999 / 2000, abs=0.06)


def test_scores_of_tokens():
    rng = random.Random(4)
    pairs = [(text(rng, "abc ", 16), text(rng, "abcd ", 16)) for _ in range(600)]
    for a, b in pairs:
        x, y = a.split(), b.split()
        whole = 100.0 if set(x) & set(y) else 0.0 if not x or not y else stretches(" ".join(sorted(set(x))), " ".join(sorted(set(y))))
        assert similarity.partial_token_set_ratio(a, b) == whole
        either = 100.0 if set(x) & set(y) else max(stretches(" ".join(sorted(x)), " ".join(sorted(y))), stretches(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))
        assert similarity.partial_token_ratio(a, b) == either


def test_bounds_hold():
    rng = random.Random(5)
    a, b = [text(rng, "abcde ", 15) or "a" for _ in range(60)], [text(rng, "abcdefg ", 20) or "b" for _ in range(60)]
    size = lambda x: np.array([len(t) for t in x])
    pairs = np.rint(nearest.pair_counts(a).T @ nearest.pair_counts(b))
    bound = nearest.bounds(nearest.letter_counts(a), size(a), nearest.letter_counts(b), size(b), pairs)
    plain = nearest.bounds(nearest.letter_counts(a), size(a), nearest.letter_counts(b), size(b))
    score = np.array(similarity.partial_ratios([(x, y) for x in a for y in b])).reshape(60, 60)
    assert (score <= bound + 1e-9).all() and (bound <= plain).all() and (bound < plain).any()
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if score[i, j] >= 90:  # found by trigrams or by containment
                assert x in y or y in x or grams(x, 3) & grams(y, 3)


def names(rng, n):
    words = ["".join(rng.choice("bdfkls") + rng.choice("aeio") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def spoiled(rng, t):
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(t) + 1)
        t = t[:k] + rng.choice(["", "x", "e", " "]) + t[k + rng.randrange(2) :]
    return t


@pytest.mark.parametrize("seed", [6, 7])
def test_best_match_against_all_pairs(spark, seed, monkeypatch):
    """Small blocks and shares; names that share a token, contain or are contained, are close, far, or blank; candidates of one
    spelling, without letters, and of few."""
    monkeypatch.setattr(nearest, "SHARE", 8)
    monkeypatch.setattr(matching, "BLOCK", 16)
    monkeypatch.setattr(nearest, "MOST_BLOCKS", 10_000 if seed == 6 else 1)
    rng = random.Random(seed)
    vendors = [(str(k), v) for k, v in enumerate(names(rng, 90) + ["", "a", "zz top", "Zz  Top", "é"])]
    asked = [spoiled(rng, rng.choice(vendors)[1]) for _ in range(120)] + [text(rng, "qwxyz ", 9) for _ in range(30)] + [None, " ", "VM", "ab"]
    got = matching.best_match(spark.createDataFrame([(a,) for a in asked], "n string"), "n", spark.createDataFrame(vendors, "id string, name string"), "id", "name")
    got = {r.n: (r.matched_vendor_id, r.matched_vendor_name, r.vendor_fuzz_score) for r in got.collect()}
    norm = lambda t: " ".join(t.lower().split())
    want = {}
    for a in set(asked):
        if a is None or not a.strip():
            want[a] = (None, None, 0.0)
        elif a == "VM":
            want[a] = (None, matching.ABBREVIATIONS[a], 1.0)
        else:
            scores = similarity.partial_token_set_ratios([(norm(a), norm(v)) for _, v in vendors])
            best = max(scores)
            k, v = min(x for x, s in zip(vendors, scores, strict=True) if s == best)
            want[a] = (k, v, best / 100) if best >= 60 else (None, None, best / 100)
    assert got == want


def test_few_pairs_are_scored(spark, monkeypatch):
    """Of 1,200 names with typing errors and 800 candidates in blocks of 64: the same as all pairs, from under a twentieth of the
    pairs, in groups of bounded size."""
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "ar", "en", "is")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(3, 6)))
    candidates = sorted({" ".join(sorted({word() for _ in range(rng.randrange(1, 4))})) for _ in range(800)})
    texts = sorted({x for x in (spoiled(rng, rng.choice(candidates)).strip() for _ in range(1200)) if x})
    t = spark.createDataFrame([(x,) for x in texts], "s string")
    c = spark.createDataFrame([(x, k) for k, x in enumerate(candidates)], "s string, id long")
    scored = []
    in_blocks = nearest.in_blocks

    def noted(*args):
        found = in_blocks(*args)
        scored.append(found.agg(F.sum("scored")).first()[0] or 0)
        return found

    monkeypatch.setattr(nearest, "in_blocks", noted)
    got = {r.s: (r.c, r.score) for r in nearest.nearest(t, c, block=64).collect()}
    for x in texts[::9]:
        scores = similarity.partial_ratios([(x, y) for y in candidates])
        assert got[x] == (candidates[scores.index(max(scores))], max(scores))
    assert set(got) == set(texts)
    pairs = nearest.by_trigrams(t, c.select(F.col("s").alias("c"))).count()
    assert 0 < pairs + sum(scored) < len(texts) * len(candidates) / 20


def test_nothing_to_match(spark):
    t, c = spark.createDataFrame([], "s string"), spark.createDataFrame([], "s string, id string")
    some = spark.createDataFrame([("abc", "1")], "s string, id string")
    assert nearest.nearest(t, c).collect() == [] == nearest.nearest(t, some).collect() == nearest.nearest(some.select("s"), c).collect()


def test_closest_types(spark):
    """The registered join: each part's name and the type most like it."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_name", "p_type").collect()
    types = sorted({r.p_type for r in rows})
    bare = lambda t: similarity.sorted_tokens(t.lower())
    got = {r.p_name: (r.p_type, r.score) for r in registry.closest_part_types(spark, sf).collect()}
    assert set(got) == {r.p_name for r in rows}
    for name, (kind, score) in got.items():
        scores = similarity.partial_token_set_ratios([(name.lower(), k.lower()) for k in types])
        best = max(scores)
        assert score == round(best / 100, 6)
        assert kind == (min(k for k, s in zip(types, scores, strict=True) if s == best) if best >= 60 else None), bare(name)
