"""Near-duplicate and suffix removal, components and rules against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import near_dedup, quality_rules, queries, suffix_dedup
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def removed(texts):
    """Brute force: (n_bytes, n_removed, n_spans, sha256) for each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        edge = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(df).collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts)


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_suffixes_of_documents(spark):
    docs = docs_of(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()}
    assert [got[d] for d, _ in docs] == removed([t for _, t in docs])


@pytest.mark.parametrize("hot", [1, 8192])
def test_suffixes_planted(spark, monkeypatch, hot):
    """Passages of many lengths about the limit, periodic texts, long texts over several passes; by contexts and by windows."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PASS", 1 << 12)
    rng = random.Random(hot)
    shared = [words(rng, 60)[:n] for n in (199, 200, 201, 230, 300)]
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 500, "ab" * 300, "é" * 150]
    texts += [words(rng, rng.randrange(30, 90)) + rng.choice(shared) + words(rng, rng.randrange(90)) for _ in range(40)]
    texts += [texts[-1], texts[-2][:-1] + "z", words(rng, 3000) + shared[4] + words(rng, 1500) + shared[3]]
    check_removed(spark, texts)


def test_suffix_rows(spark):
    text = "word " * 60
    df = spark.createDataFrame([(1, text, "q", 1), (1, text, "q", 1), (None, text, "q", 1), (2, None, "q", 5)], "doc_id long, text string, k1 string, n_chars int")
    got = suffix_dedup.dedup(df, with_text=True).collect()
    assert sorted((r.n_bytes, r.n_removed, r.kept_text) for r in got) == [(0, 0, ""), *[(300, 300, "")] * 3]
    assert sorted(map(tuple, suffix_dedup.remove(df).collect()), key=str) == sorted([(1, "", "q", 0), (1, "", "q", 0), (None, "", "q", 0), (2, "", "q", 0)], key=str)
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def groups(docs):
    sets = {d: shingles(t) for d, t in docs}
    ids, up = sorted(sets), {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_near_duplicates_of_documents(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op9_minhash_forest(spark, SF).collect()}
    assert got == groups(docs_of(spark))


@pytest.mark.parametrize("close", [0, 2])
def test_near_duplicates_in_one_large_group(spark, monkeypatch, close):
    """A large group about the threshold: hubs, chains, small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 30)
    monkeypatch.setattr(near_dedup, "NEAR", close)
    monkeypatch.setattr(near_dedup, "ORDER_ROWS", 300)
    rng = random.Random(close)
    base = words(rng, 120).split()
    docs = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = words(rng, 1)
        docs.append((1000 - k, " ".join(own)))
    docs += [(k, words(rng, 60)) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = groups(docs)
    assert len({c for _, c, _ in want.values()}) > 25
    assert got == want


def test_near_rows(spark):
    text = "a b c d e f g h"
    docs = [(1, None, 0), (2, "", 0), (3, " \t", 0), (4, "one Two", 0), (5, "ONE two ", 0), (6, text, 0), (7, text.upper() + "\n", 0), (7, text.upper() + "\n", 0), (None, text, 0), (8, text + " İ", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 4, 6, True), (7, 4, 6, False), (7, 4, 6, False), (None, 4, None, True), (8, 5, 6, False)], key=str)
    kept = near_dedup.keep(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]
    twice = near_dedup.keep(df.where("doc_id = 6").union(df.where("doc_id = 6")))
    assert [r.doc_id for r in twice.collect()] == [6]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(400, 450)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rules(text):
    w = WORD.findall(text or "")
    n, windows = len(w), collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(n - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("bits", [2, 21])
def test_rules(spark, monkeypatch, bits):
    """With few bits, texts take the route for those of very many words."""
    monkeypatch.setattr(quality_rules, "PACKED_BITS", bits)
    docs = docs_of(spark)[:80] + [(-1, None), (-2, ""), (-3, " \n\t\x0b\x0c\r "), (-4, "a b c a b c a b c"), (-5, "x\n\nx\n y\x85z  \n#|<>&%$*"), (-6, "q " * 40_000), (-7, "\U0001f642 é ß")]
    df = spark.createDataFrame([(d, t, "en", None, 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in quality_rules.assess(df).collect()}
    assert got == {d: rules(t) for d, t in docs}


def mcd_reference(x, steps, floors):
    """The same two starts and concentration steps in numpy."""

    def estimate(part, factor):
        return part.mean(0), factor * np.cov(part.T, bias=True) + np.diag(np.array(floors, float) ** 2)

    def distance(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    coarse = np.floor(x / 5 + 0.5) * 5
    mid = np.percentile(coarse, 50, axis=0)
    mad = np.percentile(np.floor(np.abs(x - mid) / 5 + 0.5) * 5, 50, axis=0)
    best = None
    for mean, cov in (estimate(x, 1.0), (mid, np.diag((1.4826 * mad) ** 2 + np.array(floors, float) ** 2))):
        for _ in range(steps):
            d = np.round(np.cbrt(distance(mean, cov)), 3)
            mean, cov = estimate(x[d <= np.percentile(d, 75)], quality_rules.CONSISTENCY)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


def test_mcd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 600, (5, 5)) + 5000
    x[:60] += 40_000
    x = np.abs(np.round(x)).astype(int)
    df = spark.createDataFrame([("l", "s", *map(int, r)) for r in x], "g_lang string, g_source string, " + ", ".join(f"{c} long" for c in quality_rules.STATISTICS))
    got = quality_rules.mcd(df).first()
    det, mean, cov = mcd_reference(x.astype(float), quality_rules.STEPS, quality_rules.FLOORS)
    assert got.log_det == pytest.approx(det, rel=1e-6)
    assert [got[f"m_{i}"] for i in range(5)] == pytest.approx(mean, rel=1e-6)
    p = np.linalg.inv(cov)
    assert [got[f"p_{i}_{j}"] for i in range(5) for j in range(i + 1)] == pytest.approx([p[i, j] for i in range(5) for j in range(i + 1)], rel=1e-4)


def test_rules_keep_clean_and_reject_odd(spark):
    rng = random.Random(5)
    good = [(k, words(rng, rng.randrange(60, 400)), "en", "a") for k in range(200)]
    bad = [(1000, " ".join(w + "###$$$" for w in words(rng, 200).split()), "en", "a"), (1001, " | ".join(words(rng, 200).split()), "en", "a")]
    odd = [(2000, None, None, None), (2001, words(rng, 80), None, "b"), (2001, words(rng, 80), None, "b"), (None, words(rng, 80), "xx", None)]
    df = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, source string")
    got = quality_rules.assess(df).collect()
    assert len(got) == len(good + bad + odd)
    assert {r.doc_id for r in got if not r.kept} == {1000, 1001, 2000}
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and kept.count() == len(got) - 3
    assert quality_rules.assess(df.limit(0)).count() == 0
