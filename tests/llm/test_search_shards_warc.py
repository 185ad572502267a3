"""Vector search against brute force, sharding and revisit resolution against plain Python."""

import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, queries, sharding, warc

SF = "/root/testdata/sf0.01"


def brute(ids, x, q, k=20):
    s = x @ x[q]
    s[q] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[j]), s[j]) for j in order if s[j] > -np.inf]


def test_recall_on_embeddings(spark):
    got = collections.defaultdict(list)
    for r in sorted(queries.op6_shifted_curves(spark, SF).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hit = total = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        want = brute(ids, x, q)
        hit += len({i for i, _ in want} & {i for i, _ in got[ids[q]]})
        total += len(want)
        for i, s in got[ids[q]]:
            assert s == pytest.approx(float(x[q] @ x[np.searchsorted(ids, i)]), abs=1e-12)
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hit / total >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_of_curves_without_a_full_search(spark, monkeypatch, kind):
    """Each block that a query meets holds less than a fifth of the rows: the index finds the neighbours, not a scan."""
    monkeypatch.setattr(ann, "BLOCK", (64, 8192))
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(60, 24)), 60, 0) + 0.15 * rng.normal(size=(3600, 24))
    else:
        x = rng.normal(size=(12_000, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []
    calibrate = ann._calibrate
    monkeypatch.setattr(ann, "_calibrate", lambda *a: seen.append(calibrate(*a)) or seen[-1])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    block = max(64, -(-seen[0] // 2))
    assert (2 * -(-seen[0] // block) + 1) * block < len(x) / 5
    ids = np.arange(len(x))
    hits = [len({i for i, _ in brute(ids, x, q)} & got[q]) for q in range(0, len(x), 20)]
    assert sum(hits) / (20 * len(hits)) >= 0.9


def test_vectors_that_take_no_part_and_copies(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (60, [-0.0, 2.0])]
    rows += [(100 + k, [1.0, 0.0]) for k in range(1, 40) if (100 + k) % 20]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 60}
    assert sorted(got[0]) == [(1, 20, 1.0), *[(k, i, 1.0) for k, i in enumerate([x for x in range(101, 121) if x % 20], 2)]][:20]
    assert sorted(got[60])[:2] == [(1, 9, 1.0), (2, 0, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    counts = {(r.reason, r.length): r.n for r in ann.left_out(df).collect()}
    assert counts == {("zero", None): 2, ("no vector", None): 2, ("not finite", None): 3, ("length", 3): 1, ("no id", None): 1, ("length", 2): 5 + 38}
    few = ann.search(df.where("vec_id in (0, 9)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 9)]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(grid, bits)
        path = grid[np.argsort(keys)]
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check_shards(rows, limit):
    """Every shard fits, none could have stayed unsplit, and prefixes do not overlap."""
    size = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        size[r.depth, r.prefix, r.split][0] += r.n_bytes
        size[r.depth, r.prefix, r.split][1] += 1
    for r in rows:
        assert size[r.depth, r.prefix, r.split][0] == r.shard_bytes
    assert all(b <= limit or n == 1 for b, n in size.values())
    names = sorted(f"{p:0{min(d, 60)}b}"[: min(d, 60)] + (f"{s:0{d - 60}b}" if d > 60 else "") if d else "" for d, p, s in size)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    return names


def test_shards(spark):
    texts = ["x" * (k % 97) for k in range(900)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(5000, "y" * 4000, 1), (5001, None, 1), (None, "z" * 50, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, depth int").repartition(3)
    got = sharding.shards(df, limit=2000).collect()
    assert len(got) == len(rows)
    names = check_shards(got, 2000)
    assert len({len(n) for n in names}) > 1
    assert sharding.shards(df.limit(0)).count() == 0


def test_shards_of_one_key(spark):
    """A key with most rows splits beyond its hash; equal rows, too."""
    df = spark.createDataFrame([(7, "same " * 20)] * 200 + [(k, "other") for k in range(50)], "doc_id long, text string").repartition(4)
    got = sharding.shards(df, limit=1500).collect()
    check_shards(got, 1500)
    assert max(r.depth for r in got) > sharding.KEY_BITS


def test_shards_do_not_depend_on_the_split_of_the_input(spark):
    rows = [(7, "same " * 20)] * 150 + [(7, "other " * k) for k in range(20)] + [(k, "t" * 90) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, sharding.shards(df.repartition(n), limit=1500).collect())) for n in (1, 5)]
    assert found[0] == found[1]


def test_written_shards(spark, tmp_path):
    """Repeated and null ids, and an input column named as the folders."""
    rows = [(k, "t" * 100, k) for k in range(60)] + [(5, "t" * 100, 60), (5, "t" * 100, 60), (None, "x", 61), (None, None, 62)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long").repartition(3)
    sharding.write_shards(df, str(tmp_path / "s"), limit=1000)
    back = spark.read.option("recursiveFileLookup", "false").parquet(str(tmp_path / "s"))
    assert back.select("shard_").distinct().count() >= 6
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Example.com:80", "example.com/"), ("https://example.com:443/a?b=2&a=1#x", "example.com/a?a=1&b=2"), ("https://u:p@example.com/A?utm_source=x&ref=1", "example.com/A"),
        ("http://example.com:443/", "example.com:443/"), (" no url ", "no url"), ("", ""), (None, None),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key


RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, h string"


def resolve_plainly(records):
    out = {}
    for i, key, ts, kind, _, headers in records:
        if kind != "revisit":
            continue
        low = {k.lower(): v for k, v in (headers or {}).items()}
        before = [r for r in records if r[3] == "response" and r[4] == 200 and key is not None and r[1] == key and ts is not None and r[2] is not None and r[2] < ts]
        if not before:
            out[i] = ("missing", None, low)
            continue
        full = max(before, key=lambda r: (r[2], r[0]))
        old = {k.lower(): v for k, v in (full[5] or {}).items()}
        status = "no_validator"
        for name, strip in (("etag", "W/"), ("last-modified", "")):
            if name in old and name in low:
                status = "resolved" if old[name].removeprefix(strip) == low[name].removeprefix(strip) else "changed"
                break
        if status == "resolved":
            low = old | {k: v for k, v in low.items() if k in warc.PERMITTED}
        out[i] = (status, full[0], low)
    return out


@pytest.mark.parametrize("slot_rows", [1000, 20])
def test_revisits(spark, slot_rows):
    """Half of the records have one URL, many of them one time; in few slots and in many."""
    rng = np.random.default_rng(slot_rows)
    records = []
    for i in range(500):
        key = None if i % 97 == 0 else f"a.b/{0 if rng.random() < 0.5 else int(rng.integers(20))}"
        ts = None if i % 89 == 0 else 60 if rng.random() < 0.3 else int(rng.integers(120))
        kind, status = ("response", 200 if rng.random() < 0.8 else 404) if rng.random() < 0.5 else ("revisit", 304)
        headers = {"Date": str(i), "Content-Length": "9"}
        if rng.random() < 0.7:
            headers["ETag"] = ("W/" if rng.random() < 0.3 else "") + f'"{int(rng.integers(3))}"'
        if rng.random() < 0.5:
            headers["Last-Modified"] = str(int(rng.integers(2)))
        records.append((i, key, ts, kind, status, None if i % 83 == 0 else headers))
    df = spark.createDataFrame([(a, k and f"http://{k}", *r, "x") for a, k, *r in records], RECORD).repartition(4)
    got = {r.record_id: (r.status_text, r.response_id, r.headers) for r in warc.resolve(df, slot_rows).collect()}
    want = resolve_plainly(records)
    assert got == want
    assert {s for s, *_ in want.values()} == {"missing", "resolved", "changed", "no_validator"}
    twice = warc.resolve(df.union(df.where("kind = 'revisit'")), slot_rows)
    assert twice.count() == 2 * len(want)
    assert warc.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=key)
    want = sorted([tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()], key=key)
    assert got == want and not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)
