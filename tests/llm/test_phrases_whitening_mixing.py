"""Phrases, whitening and mixing against SQL and against plain Python with exact arithmetic."""

import collections
import hashlib
import math
import random
import re
from decimal import Decimal
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest

from millrace.llm import mixing, phrases, queries, whitening

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_budget_mixing"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert got == want and len(got) > 50


# ---- phrases --------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least=10, within=50, top=2000):
    words, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(f[q] >= least and 100 * f[q] >= within * a for q in f if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, lft, r, words[lang], -s) for n, (s, a, p, lft, r) in enumerate(sorted(found)[:top], 1)]
    return out


def phrase_rows(spark, rows, **args):
    df = spark.createDataFrame(rows, "lang string, text string, word string, segment long").repartition(3)
    return sorted(map(tuple, phrases.collocations(df, **args).collect()))


@pytest.mark.parametrize("segment", [1, 300, 1 << 20])
def test_phrases(spark, monkeypatch, segment):
    """Segments of one text, of a few and of all; nulls, blanks, ends of pieces, letters beyond ASCII, repeats, overlaps, other columns."""
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    rng = random.Random(3)
    vocabulary = ["a", "b", "Ab", "ç", "日本", "É", "x y", "-", "d'"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None]), text(rng.randrange(0, 120)), None, 1) for _ in range(60)]
    rows += [("en", None, None, 1), ("en", "", None, 1), ("fr", " \n ., ", None, 1), (None, None, None, 1), ("xx", "a a a a a a a a a a a a b", "w", None)] + rows[:5]
    got = phrase_rows(spark, rows)
    assert got == sorted(brute_phrases([r[:2] for r in rows])) and len(got) > 20
    assert phrase_rows(spark, rows, least=3, within=80, top=4) == sorted(brute_phrases([r[:2] for r in rows], 3, 80, 4))


def test_no_phrases(spark):
    assert phrase_rows(spark, []) == []
    assert phrase_rows(spark, [("en", "one two three", None, 1)]) == []


def test_a_long_text(spark):
    """Two million words in one text, beside one of a few."""
    rows = [("en", "to be or not to be. " * 350_000, None, 1), ("en", "to be", None, 2)]
    got = {r[2]: r[3:] for r in phrase_rows(spark, rows)}
    assert got["to be"][0] == 700_001 and got["to be"][3] == 2_100_002
    assert "or not" not in got and got["or not to"][0] == 350_000


def test_packed_lists():
    rng = np.random.default_rng(1)
    for limit in (2, 300, 1 << 22, 1 << 34):
        lists = [np.unique(rng.integers(0, limit, n)) for n in (1, 5, 1, 200)]
        n = np.array([len(x) for x in lists])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        data, at = phrases.pack(np.concatenate(lists), first)
        assert np.array_equal(phrases.unpack(data, n), np.concatenate(lists))
        assert np.array_equal(phrases.unpack(data[at[3] : at[4]], n[3:]), lists[3])


def test_scores_beyond_64_bits(spark):
    a, lft, r = 10**12 + 7, 10**12 + 9, 3 * 10**12 + 1
    df = spark.createDataFrame([(a, lft, r), (5, 7, 11)], "a long, l long, r long")
    got = [x.s for x in df.select("a", phrases._score(df.a, df.l, df.r).alias("s")).orderBy("a").collect()]
    assert got == [10**6 * 25 // 77, 10**6 * a * a // (lft * r)]


def test_the_best_are_whole(spark):
    """More phrases than the limit, so that every round leaves rows out."""
    rows = [("en", f"w{k}, " * (k % 7 + 1) + f"w{k} v{k}. " * (10 + k % 5), None, 1) for k in range(500)]
    assert phrase_rows(spark, rows, top=37) == sorted(brute_phrases([r[:2] for r in rows], top=37))


# ---- whitening ------------------------------------------------------------------------------------------------------


def exact_model(vectors):
    """n, sums and covariance of x in fractions."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return x, n, s, cov


def whitened(spark, rows, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v int").repartition(3)
    return whitening.whiten(df, **args).collect()


def check_whitened(rows, vectors, count):
    """rows of ids 0.. with their vectors, against fractions and eigh."""
    x, n, s, cov = exact_model(vectors)
    scale = max(cov[i][i] for i in range(len(cov)))
    e, u = np.linalg.eigh(np.array([[float(v / scale) for v in r] for r in cov]))
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == n * count
    for k in range(count):
        direction = u[:, -1 - k]
        for i in range(n):
            r = by[i, k + 1]
            deviation = sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True))
            assert r.n == n and r.deviation == (deviation if deviation < 10**38 else None)
            want = float(sum(Fraction(float(w)) * (Fraction(a) - Fraction(b, n)) for w, a, b in zip(direction, x[i], s, strict=True))) / math.sqrt(e[-1 - k]) / math.sqrt(scale)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-8)
            assert r.explained == pytest.approx(e[-1 - k] / e.sum(), rel=1e-6)
            assert r.identity_error < 1e-6
        sign = {np.sign(by[i, k + 1].whitened * float(np.dot(direction, [float(a - Fraction(b, n)) for a, b in zip(x[i], s, strict=True)]))) for i in range(n) if abs(by[i, k + 1].whitened) > 1e-3}
        assert len(sign) == 1


@pytest.mark.parametrize("scale", [1e-2, 1.0, 1e6, 1e14, 1e40])
def test_whitening(spark, scale, monkeypatch):
    """Small entries and such that need limbs or whole numbers of any length; more blocks than one."""
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(40, 5)) @ np.diag([5, 4, 3, 2, 1]) * scale).tolist()
    check_whitened(whitened(spark, [(k, v, "i", 1) for k, v in enumerate(vectors)]), vectors, 5)


def test_whitening_leaves_out(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [1.0, -inf, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(k, v, None, None) for k, v in enumerate(vectors)] + [(100 + k, v, None, None) for k, v in enumerate(odd)]
    got = whitened(spark, rows, components=2)
    assert {r.vec_id for r in got} == set(range(30))
    check_whitened(got, vectors, 2)
    assert whitened(spark, []) == [] == whitened(spark, rows[30:35])


def test_whitening_without_variance(spark):
    """Equal vectors, repeated and null ids: no component has variance; two different ones: one has."""
    got = whitened(spark, [(1, [1.0, 2.0], None, None), (1, [1.0, 2.0], None, None), (None, [1.0, 2.0], None, None)])
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    got = {(r.vec_id, r.component): r.whitened for r in whitened(spark, [(1, [1.0, 2.0], None, None), (2, [2.0, 4.0], None, None)])}
    assert abs(got[1, 1]) == pytest.approx(1) and got[1, 1] == pytest.approx(-got[2, 1]) and got[1, 2] is None
    one = whitened(spark, [(1, [7.0], None, None)])
    assert [(r.component, r.whitened, r.deviation) for r in one] == [(1, None, 0)]


def test_products_of_limbs():
    rng = np.random.default_rng(5)
    for bits in (3, 21, 22, 40, 50):
        y = rng.integers(-(1 << bits), 1 << bits, (50, 4))
        whole = y.astype(object)
        assert (whitening._cross(y) == whole.T.dot(whole)).all()
    for v in (0, 5, -5, 2**31, -(2**31), 2**200 + 3, -(2**90)):
        assert sum(x << 32 * k for k, x in enumerate(whitening._limbs(v))) == v


@pytest.mark.parametrize("most", [100, 10**7, 10**12])
def test_deviations_beyond_64_bits(most):
    rng = np.random.default_rng(6)
    n = 10**6
    m = rng.integers(-most, most, (20, 8)) / 1024.0
    sums = tuple(int(v) for v in rng.integers(-most, most, 8))
    model = whitening.Model(n, 8, sums, np.eye(8), np.ones(8), 8.0, 0)
    want = [sum((n * math.floor(Fraction(c) * 1024) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in m.tolist()]
    assert whitening._deviation(m, model) == want and Decimal(max(want)) > 0


def test_whitening_query(spark):
    vectors = [r.embedding for r in spark.read.parquet(str(SF / "embeddings.parquet")).orderBy("vec_id").collect()]
    got = queries.op12_exact_whitening(spark, str(SF))
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitened(got.collect(), vectors[:500], 8)


# ---- mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights, share, most):
    """Shares by the words of the definition: what goes beyond a cap is dealt to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    cap = {s: most * sizes[s] for s in order}
    target = dict.fromkeys(order, Fraction(0))
    left, open_ = share * sum(sizes.values()), set(order)
    while open_ and left:
        each = Fraction(left) / sum(w[s] for s in open_)
        left = 0
        for s in list(open_):
            target[s] += each * w[s]
            if target[s] >= cap[s]:
                left += target[s] - cap[s]
                target[s] = Fraction(cap[s])
                open_.remove(s)
    return target


def plain_mix(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of = collections.defaultdict(list)
    for doc, text, source in rows:
        key = hashlib.md5(f"mix|{doc}".encode()).hexdigest() if doc is not None else None
        of[source].append((key is None, key or "", size(text), doc))
    sizes = {s: sum(x[2] for x in d) for s, d in of.items()}
    target = plain_targets(sizes, weights, share, most)
    out = []
    for s, docs in of.items():
        epochs, rest = divmod(math.floor(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for _, _, n, doc in sorted(docs, key=lambda x: x[:3]):
            out.append((doc, s, n, sizes[s], float(target[s]), epochs * n + max(0, min(n, rest))))
            rest -= n
    return sorted(out, key=str)


def mix_rows(spark, rows, **args):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, key string").repartition(3)
    return sorted((tuple(r) for r in mixing.mix(df, **args).collect()), key=str)


def near(got, want):
    assert [(r[:4], r[5]) for r in got] == [(r[:4], r[5]) for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])


def some_documents(rng, n):
    source = lambda: rng.choice(["a", "a", "a", "a", "b", "c", "É", "日", None, "empty"])
    rows = []
    for k in range(n):
        s = source()
        rows.append((k, None if s == "empty" else "  ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), s))
    return rows + [(None, "null id", "a"), (None, "null id too", "a"), (3, "again", "b"), (3, "again", "b"), (5, None, "b"), (6, "  x\t\n", "c")]


@pytest.mark.parametrize("part_rows", [20, 100_000])
def test_mixing(spark, monkeypatch, part_rows):
    """Few and many range partitions; null sources and ids, empty sources, repeated rows, other columns."""
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    rows = some_documents(random.Random(7), 400)
    near(mix_rows(spark, rows), plain_mix(rows))
    assert mix_rows(spark, rows) == mix_rows(spark, rows[::-1])
    args = {"weights": (9, 1), "share": Fraction(1, 3), "most": 1}
    near(mix_rows(spark, rows, **args), plain_mix(rows, **args))


def test_mixing_of_little(spark):
    assert mix_rows(spark, []) == []
    near(mix_rows(spark, [(1, "", "a"), (2, None, None)]), [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)])
    near(mix_rows(spark, [(1, "one two", "a")]), [(1, "a", 2, 2, 3.0, 3)])
    # more asked for than the caps allow: each source as often as it may come
    near(mix_rows(spark, [(1, "one two", "a"), (2, "x", "b")], share=Fraction(9)), [(1, "a", 2, 2, 4.0, 4), (2, "b", 1, 1, 2.0, 2)])


def test_draw(spark):
    rows = some_documents(random.Random(8), 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draw(df).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert all(len(words(r.text)) == r.words > 0 for r in got)
    taken, of = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.doc_id] += r.words
        of[r.source] += r.words
    want = collections.Counter()
    for d, s, _, _, target, n in plain_mix(rows):
        want[d] += n
        assert of[s] == math.floor(target)
    assert taken == +want
    text = {d: t for d, t, _ in rows if d not in (None, 3, 5, 6)}  # ids that come once
    for r in got:
        if r.doc_id in text:
            assert r.text == text[r.doc_id] or words(text[r.doc_id])[: r.words] == words(r.text)


def test_a_long_text_is_cut(spark):
    df = spark.createDataFrame([(1, "w " * 300_001, "a"), (2, "x", "b")], "doc_id long, text string, source string")
    got = {(r.doc_id, r.epoch): r.words for r in mixing.draw(df, share=Fraction(1, 2), weights=(1, 1)).collect()}
    assert got == {(1, 1): 149_999, (2, 1): 1, (2, 2): 1}
