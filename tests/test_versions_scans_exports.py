"""Versioned merges, scans of long series, ordered exports."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import gapfill, scan
from millrace.sources import readers, writers
from millrace.sources.versioned import Conflict, VersionedTable

SEED = "sku_id string, canonical_name string, source string, effective_from string, version string"


def seeds(spark, rows):
    return spark.createDataFrame([(k, n, s, "2025-01-01", "v0.1") for k, n, s in rows], SEED)


def content(df):
    return {r.sku_id: (r.canonical_name, r.source) for r in df.collect()}


@pytest.fixture
def place(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.create(seeds(spark, [(str(k), f"old {k}", "approved_seed" if k % 3 == 0 else "auto_ref") for k in range(200)]), "sku_id", 16)
    return t


def test_merge_rewrites_only_what_it_touches(spark, place):
    before = place.version()
    after = place.merge(seeds(spark, [("7", "new 7", "auto_ref"), ("9", "new 9", "auto_ref"), ("new", "new one", "auto_ref")]))
    got = content(place.read())
    assert len(got) == 201 and got["7"] == ("new 7", "auto_ref") and got["9"] == ("old 9", "approved_seed") and got["new"] == ("new one", "auto_ref")
    changed = [b for b in after.folders if before.folders.get(b) != after.folders[b]]
    assert 1 <= len(changed) <= 3 and after.number == 2
    files = lambda v: {f: sorted(p.name for p in Path(place.path, f).glob("*.parquet")) for f in v.folders.values()}
    assert all(files(before)[f] == files(after)[f] for f in set(before.folders.values()) & set(after.folders.values()))
    assert content(place.read(1))["7"] == ("old 7", "auto_ref")  # the version before is whole as well
    assert place.merge(seeds(spark, [])).number == 2


@pytest.mark.parametrize("step", ["_write", "_folders", "_commit"])
def test_a_writer_that_dies_changes_nothing(spark, place, monkeypatch, step):
    was = content(place.read())

    def die(*args, **more):
        if step == "_write":
            VersionedTable_write(place, *args, **more)
        raise KeyboardInterrupt

    VersionedTable_write = VersionedTable._write
    with monkeypatch.context() as m:
        m.setattr(place, step, die)
        with pytest.raises(KeyboardInterrupt):
            place.merge(seeds(spark, [("7", "new 7", "auto_ref")]))
    assert content(place.read()) == was and place.versions() == [1]
    place.merge(seeds(spark, [("7", "again 7", "auto_ref")]))
    assert content(place.read())["7"] == ("again 7", "auto_ref")
    gone = place.vacuum()
    assert any(f.startswith("manifests/") for f in gone) and any(f.startswith("data/") for f in gone)
    assert content(place.read()) == was | {"7": ("again 7", "auto_ref")} and place.versions() == [2]


def test_two_writers(spark, place, monkeypatch):
    """The second to commit is told so, and nothing of it is seen."""
    first = VersionedTable(spark, place.path)
    commit = VersionedTable._commit

    def late(v):
        first.merge(seeds(spark, [("8", "first", "auto_ref")]))
        commit(place, v)

    monkeypatch.setattr(place, "_commit", late)
    with pytest.raises(Conflict):
        place.merge(seeds(spark, [("7", "second", "auto_ref")]))
    got = content(first.read())
    assert got["8"][0] == "first" and got["7"][0] == "old 7" and first.versions() == [1, 2]


def test_no_version(spark, tmp_path, place):
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, f"{tmp_path}/none").read()
    with pytest.raises(FileNotFoundError):
        place.read(7)
    with pytest.raises(Conflict):
        place.create(seeds(spark, []), "sku_id")
    empty = VersionedTable(spark, f"{tmp_path}/empty")
    empty.create(seeds(spark, []), "sku_id", 4)
    assert empty.read().columns == ["sku_id", "canonical_name", "source", "effective_from", "version"] and empty.read().isEmpty()
    empty.merge(seeds(spark, [("1", "a", "auto_ref")]))
    assert content(empty.read()) == {"1": ("a", "auto_ref")}


def test_a_seed_between_renames(spark, tmp_path):
    path = f"{tmp_path}/seed"
    writers.overwrite_seed(seeds(spark, [("1", "a", "auto_ref")]), path)
    Path(path).rename(f"{path}.old")
    assert content(readers.seed(spark, writers.restored_seed(spark, path))) == {"1": ("a", "auto_ref")}
    writers.overwrite_seed(readers.seed(spark, path).withColumn("canonical_name", F.lit("b")), path)
    assert content(readers.seed(spark, writers.restored_seed(spark, path))) == {"1": ("b", "auto_ref")} and not Path(f"{path}.old").exists()


# ---- scans ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_scan_equals_window(spark, keys):
    """Slots of some rows; series with long holes, without any known value, and a null key."""
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("i"), F.when(F.col("id") % 5 < 3, F.lit("a")).when(F.col("id") % 5 < 4, "b").alias("k"))
    df = df.withColumn("v", F.when((F.col("k").isNull() | (F.col("k") == "a")) & (F.col("i") % 97 < 3) & (F.col("i") > 200) & ~F.col("i").between(1000, 2500), F.col("i") * 2))
    known = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    many = scan.neighbours(df, ["i"], known, keys, slot_rows=50)
    one = scan.window_neighbours(df, ["i"], known, keys)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_a_million_days(spark):
    """A series of a million days with one in ten known, filled over many tasks as by one window."""
    day = F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(0, 1_000_000, 10).select(day.alias("date"), (F.col("id") % 1000).cast("double").alias("exchange_rate"), F.lit("SOURCE").alias("rate_source"))
    many, one = gapfill.fill_gaps(df, long=True), gapfill.fill_gaps(df)
    cells = [F.count(F.lit(1)), F.round(F.sum("exchange_rate"), 3), F.sum(F.xxhash64("date", F.round("exchange_rate", 9), "rate_source").cast("decimal(38,0)"))]
    assert many.agg(*cells).first() == one.agg(*cells).first()
    assert many.groupBy(F.spark_partition_id()).count().count() > 1
    assert gapfill.spine_of(df, stretch=777).distinct().count() == 999_991


# ---- exports --------------------------------------------------------------------------------------------------------


def test_ordered_exports(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.concat(F.lit('a "quoted", name\n'), F.col("id")).alias('odd, "name"'), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    path = writers.export_ordered(df, f"{tmp_path}/csv", [F.desc("n")], parts=7)
    files = sorted(p for p in Path(path).iterdir() if p.suffix == ".csv")
    assert files[0].name == "header.csv" and len(files) > 4
    rows = list(csv.reader("".join(p.read_text() for p in files).splitlines(keepends=True)))
    want = [[str(r.n), r[1], "" if r.v is None else str(r.v)] for r in df.orderBy(F.desc("n")).collect()]
    assert rows[0] == df.columns and rows[1:] == want
    path = writers.export_ordered(df.drop('odd, "name"'), f"{tmp_path}/json", ["n"], parts=5, kind="json")
    lines = [json.loads(x) for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["n"] for x in lines] == list(range(5000)) and sum("v" in x for x in lines) == df.where("v is not null").count()


def test_files_by_key(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1)], "k string, n int")
    writers.by_key(df, f"{tmp_path}/c", ["k"], ["n"], kind="csv")
    assert ["".join(p.read_text() for p in Path(f"{tmp_path}/c/k={k}").glob("*.csv")) for k in "ab"] == ["n\n1\n2\n", "n\n1\n"]
    writers.by_key(df, f"{tmp_path}/j", ["k"], ["n"])
    assert "".join(p.read_text() for p in Path(f"{tmp_path}/j/k=a").glob("*.json")) == '{"n":1}\n{"n":2}\n'
