"""Every registered query against DuckDB on the smallest tables, or, where SQL cannot say it, against plain Python."""

import collections
import datetime
import math
import re
from pathlib import Path

import duckdb
import pytest

from millrace.functions import similarity
from millrace.operators import curation
from millrace.plans import registry, standin

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(cols, data):
    return sorted((tuple(plain(v) for v in r) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r)), cols


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = rows(cols, [[r[c] for c in cols] for r in df.collect()])
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = rows(cols, [[r[rel.columns.index(c)] for c in cols] for r in rel.fetchall()])
    assert got == want


#: What the rows of these queries are in order of; ascending unless marked.
ORDERED = {
    "q1_spend_top20": ["-total_spend_aud"], "q2_data_quality": ["-exception_count"], "q3_price_variance": ["-potential_savings_aud"], "q4_regions": ["country_code", "-region_total_spend_aud"],
    "q5_seasons": ["product_category", "month"], "q6_vendors": ["spend_rank"], "q7_executive": ["period_name"], "top_brands": ["-total"],
}


@pytest.mark.parametrize("name", ORDERED)
def test_order(spark, name):
    got = registry.QUERIES[name](spark, str(SF)).collect()
    assert len(got) > 1
    for a, b in zip(got, got[1:], strict=False):
        for c in ORDERED[name]:
            x, y = a[c.lstrip("-")], b[c.lstrip("-")]
            if x != y:
                assert (x > y) if c.startswith("-") else (x < y)
                break


def test_fuzzy_scores(spark, duck):
    """Every distinct pair of names, by the plain functions; these by the textbook table of the longest common subsequence."""
    want = {}
    for a, b in duck.sql("SELECT DISTINCT lower(p_name), lower(p_type) FROM part").fetchall():
        want[a, b] = tuple(round(f(a, b), 6) for f in (similarity.ratio, similarity.token_sort_ratio, similarity.partial_token_set_ratio, similarity.partial_token_ratio))
        assert similarity.lcs(a, b) == table_lcs(a, b)
    got = {(r.a, r.b): (r.ratio, r.token_sort_ratio, r.partial_token_set_ratio, r.partial_token_ratio) for r in registry.fuzzy_scores(spark, str(SF)).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_vendor_best_match(spark, duck):
    words = standin.VENDOR_WORDS
    vendors = {}
    for (k,) in duck.sql("SELECT s_suppkey FROM supplier").fetchall():
        name = words[k % len(words)]
        vendors[name] = min(vendors.get(name, str(k)), str(k))
    rows = duck.sql("SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' supply' ELSE ' data' END FROM customer").fetchall()
    want = {}
    for (brand,) in rows:
        best = max(similarity.partial_token_set_ratio(brand.lower(), v.lower().strip()) for v in vendors)
        i, v = min((i, v) for v, i in vendors.items() if similarity.partial_token_set_ratio(brand.lower(), v.lower()) == best)
        want[brand] = (i, v, best / 100) if best >= 60 else (None, None, best / 100)
    got = {r.brand: (r.matched_vendor_id, r.matched_vendor_name, r.vendor_fuzz_score) for r in registry.vendor_best_match(spark, str(SF)).collect()}
    assert got == want


def test_curation_decisions(spark, duck):
    """Each brand's names by plain lists: typos to the most wanted token nearby, frequent tokens, ranking, decision."""
    names = {}
    for brand, name in duck.sql("SELECT DISTINCT p_brand, p_name FROM part WHERE p_name IS NOT NULL ORDER BY ALL").fetchall():
        names.setdefault(brand, []).append(name)
    bare = lambda s: [w for w in re.sub(r"[^\w\s]+", " ", s.lower()).split() if w not in curation.STOP_WORDS]
    want = {}
    for brand, own in names.items():
        lists = [[w for w in bare(n) if w.isalpha()] for n in own]
        counts = collections.Counter(w for x in lists for w in x)
        near = lambda t, c=counts: max(((c[r], len(r), r) for r in c if (r == t or len(r) >= 4 and edits(t, r) <= 2) and (c[r], len(r), r) >= (c[t], len(t), t)))[2]
        fix = {t: near(t) for t in counts}
        changed = [[fix[w] for w in x] for x in lists]
        presence = collections.Counter(w for x in changed for w in set(x))
        tokens = sorted(presence, key=lambda w: (-presence[w], -len(w), w))[:2]
        ranked = sorted(((-similarity.token_sort_ratio(" ".join(bare(n)), " ".join(tokens)), n, k) for k, n in enumerate(own)) if tokens else [])
        first, second = (-ranked[0][0] if ranked else 0.0), (-ranked[1][0] if len(ranked) > 1 else 0.0)
        match = " ".join(changed[ranked[0][2]]) if ranked else ""
        auto = first > second and first > 80
        want[brand] = (own, tokens, match, pytest.approx(first), match if auto else "", "AUTO" if auto else "NEED_APPROVAL")
    got = {r.p_brand: (r.raw_names, r.canonical_tokens, r.match_name, r.match_score, r.final_sku_name, r.decision) for r in registry.curation_decisions(spark, str(SF)).collect()}
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_query_is_compared():
    """By SQL, by one of the tests above or by one of test_nearest."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"fuzzy_scores", "vendor_best_match", "curation_decisions", "closest_part_types"}


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
