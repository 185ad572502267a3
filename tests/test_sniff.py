"""Types, drift and rescue of text columns."""

import datetime as dt

from millrace.sources import sniff


def test_profile_and_drift(spark):
    rows = [("1", "1", "true", "2024-01-31", "2024-01-31 10:00:00", "x", None), (" -2 ", "2.5e3", "FALSE", "2024-02-29", "2024-02-01", "1", ""), ("", ".5", None, " ", "2024-02-01T00:00:00.5", "2", "  ")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string").repartition(3)
    got = {r.column_name: (r.type, r.n, r.empty) for r in sniff.profile(df).collect()}
    assert got == {"a": ("long", 2, 1), "b": ("double", 3, 0), "c": ("boolean", 2, 1), "d": ("date", 2, 1), "e": ("timestamp", 3, 0), "f": ("string", 3, 0), "g": ("string", 0, 3)}
    declared = {"a": "double", "b": "long", "d": "timestamp", "f": "long", "g": "date", "z": "string"}
    got = {r.column_name: (r.declared, r.found, r.unread, r.verdict) for r in sniff.drift(df, declared).collect()}
    assert got == {"b": ("long", "double", 2, "changed"), "f": ("long", "string", 1, "changed"), "g": ("date", "string", 0, "empty"), "z": ("string", None, None, "missing"), "c": (None, None, None, "new"), "e": (None, None, None, "new")}
    empty = {r.column_name: (r.type, r.n) for r in sniff.profile(df.where("false")).collect()}
    assert empty["a"] == ("string", 0) and len(empty) == 7


def test_rescue(spark):
    df = spark.createDataFrame([("7", "2024-02-30", "k"), ("x", "2024-02-28", ""), (None, "", "m"), ("99999999999999999999", " 2024-02-28 ", "")], "n string, d string, t string")
    got = [tuple(r) for r in sniff.rescued(df, {"n": "long", "d": "date", "t": "string", "more": "double"}).collect()]
    day = dt.date(2024, 2, 28)
    assert got == [(7, None, "k", None, {"d": "2024-02-30"}), (None, day, None, None, {"n": "x"}), (None, None, "m", None, {}), (None, day, None, None, {"n": "99999999999999999999"})]
