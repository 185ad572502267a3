import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions.similarity import token_sort_ratio
from millrace.operators import catalogue, checks, curation, gapfill, matching, quality, ranks, reports, seed
from millrace.plans import summaries


def day(n):
    return dt.date(2025, 7, n)


def test_gap_filling_is_linear_and_keeps_known_values(spark):
    df = spark.createDataFrame([(day(1), 1.0, "SOURCE"), (day(4), 4.0, "SOURCE"), (day(6), None, "SOURCE")], "date date, exchange_rate double, rate_source string")
    got = {r.date.day: (r.exchange_rate, r.rate_source) for r in gapfill.fill_gaps(df).collect()}
    assert got == {1: (1.0, "SOURCE"), 2: (2.0, "INTERPOLATED"), 3: (3.0, "INTERPOLATED"), 4: (4.0, "SOURCE"), 5: (4.0, "FORWARD_FILLED"), 6: (4.0, "FORWARD_FILLED")}


def test_direct_rates_win(spark):
    raw = spark.createDataFrame(
        [(day(1), "USD", "AUD", 1.5), (day(1), "AUD", "USD", 0.5), (day(2), "AUD", "USD", 0.5), (day(3), "AUD", "USD", 0.0), (day(3), "USD", "EUR", 9.0), (day(4), "USD", "AUD", 4.0)],
        "date date, from_currency string, to_currency string, exchange_rate double",
    )
    got = {r.date.day: (r.exchange_rate, r.rate_source) for r in gapfill.daily_rates(raw).collect()}
    assert got == {1: (1.5, "SOURCE"), 2: (2.0, "CALCULATED"), 3: (3.0, "INTERPOLATED"), 4: (4.0, "SOURCE")}
    assert gapfill.daily_rates(raw.limit(0)).count() == 0


LINE = "line_uid long, sku_id string, vendor_brand string, non_product_hint boolean"
SCORE = "line_uid long, fuzz_score double, matched_vendor_id string, matched_vendor_name string, vendor_fuzz_score double"


def test_routing_is_a_partition(spark):
    lines = spark.createDataFrame([(1, "A", "B", False), (2, None, "B", True), (3, None, "B", False), (4, "Z", "B", False), (5, "A", "B", True), (6, "A", " ", False), (7, "A", "B", None)], LINE)
    scores = spark.createDataFrame([(1, 0.8, "V", "Vee", 1.0), (5, 0.79, "V", "Vee", 1.0), (6, 1.0, None, None, 0.0), (7, None, "", None, 0.1)], SCORE)
    known = spark.createDataFrame([("A",), ("A",), (None,)], "sku_id string")
    flagged = quality.flag_lines(lines, known, scores)
    routed = {k: {r.line_uid: r for r in v.collect()} for k, v in quality.route(flagged).items()}
    assert {k: sorted(v) for k, v in routed.items()} == {"valid": [1], "nonproduct": [2], "exceptions": [3, 4, 5, 6, 7]}
    assert [routed["exceptions"][k].exception_type for k in (3, 4, 5, 6, 7)] == ["SKU_NOT_IN_SEED", "SKU_NOT_IN_SEED", "NAME_MISMATCH", "VENDOR_MISMATCH", "VENDOR_MISMATCH"]
    assert not routed["exceptions"][6].has_quality_issues  # a blank brand is no issue
    assert sorted(r[0] for r in quality.missing_in_seed(lines, known).collect()) == [2, 3, 4]
    assert [r.line_uid for r in quality.not_in(lines, known, "sku_id").collect()] == [4]


def test_seed_upsert_and_versions(spark):
    old = spark.createDataFrame([("1", "old", "approved_seed", "d0", "v0.1"), ("2", "old", "auto_ref", "d0", "v0.9"), ("3", "old", "auto_ref", "d0", "v0.1")], ",".join(f"{c} string" for c in seed.COLUMNS))
    approved = spark.createDataFrame([("1", " new ", "auto"), ("2", "new", "AUTO "), ("4", "new", "APPROVED"), ("5", "", "NEED_APPROVAL")], "`SKU id` string, `Final SKU name` string, decision string")
    assert seed.next_version(old).first()[0] == "v0.10"
    assert seed.next_version(old.limit(0)).first()[0] == "v0.1"
    new = seed.rows_from_approvals(approved, "d1", "v0.10")
    got = seed.upsert(old, new)
    assert {r.sku_id: (r.canonical_name, r.source) for r in got.collect()} == {"1": ("old", "approved_seed"), "2": ("new", "auto_ref"), "3": ("old", "auto_ref"), "4": ("new", "approved_seed")}
    assert sorted(seed.upsert(got, new).collect()) == sorted(got.collect())
    assert seed.check_seed(got).isEmpty() and not seed.check_seed(got.union(got)).isEmpty()
    with pytest.raises(ValueError, match="missing"):
        seed.rows_from_approvals(approved.drop("decision"), "d1", "v1.0")
    with pytest.raises(ValueError, match="need"):
        seed.rows_from_approvals(approved.withColumn("decision", F.lit("AUTO")), "d1", "v1.0")


def test_best_match(spark):
    vendors = spark.createDataFrame([("2", "TechFlow Corporation"), ("1", "DataVault  Corporation"), ("3", "Acme")], "id string, name string")
    names = spark.createDataFrame([("TF",), ("Data vault corp",), ("techflow",), ("qqqq",), ("  ",), (None,), ("techflow",), ("VM",)], "brand string")
    got = {r.brand: (r.matched_vendor_id, r.matched_vendor_name, round(r.vendor_fuzz_score, 2)) for r in matching.best_match(names, "brand", vendors, "id", "name").collect()}
    assert got["TF"] == ("2", "TechFlow Corporation", 1.0)
    assert got["techflow"] == ("2", "TechFlow Corporation", 1.0)
    assert got["Data vault corp"][0] == "1"
    assert got["qqqq"][:2] == (None, None)
    assert got["  "] == got[None] == (None, None, 0.0)
    assert got["VM"] == (None, "ViewMaster Corporation", 1.0)
    aliases = matching.collect_aliases(vendors, names, "name", "brand", 75, {"TF": "TechFlow Corporation"})
    assert {r.name: r.aliases for r in aliases.collect()}["TechFlow Corporation"] == ["TF"]
    assert {(r.a, r.b) for r in matching.close_pairs(spark.createDataFrame([("kitten",), ("mitten",), ("sit",)], "w string"), "w", 1).collect()} == {("kitten", "mitten")}


NAMES = ["Wireless Keyboard", "wireless keybord", "keyboard, wireless!", "Wireless Kayboard for the office", "mouse"]


def test_typo_map(spark):
    df = spark.createDataFrame([("s", n) for n in NAMES], "k string, d string")
    got = {r.token: r.representative for r in curation.typo_map(df, "k", "d", 2, 4, curation.letters(F.col("d"))).collect()}
    assert got["keybord"] == got["kayboard"] == got["keyboard"] == "keyboard"
    assert got["mouse"] == "mouse" and got["office"] == "office" and "the" not in got
    strict = {r.token: r.representative for r in curation.typo_map(df, "k", "d", 0, 4, curation.letters(F.col("d"))).collect()}
    assert all(a == b for a, b in strict.items())


def test_short_tokens_stand_for_themselves_only(spark):
    df = spark.createDataFrame([("s", "abc"), ("s", "abc"), ("s", "abd")], "k string, d string")
    assert {r.token: r.representative for r in curation.typo_map(df, "k", "d").collect()} == {"abc": "abc", "abd": "abd"}


def test_decisions(spark):
    rows = [("s", n) for n in NAMES] + [("one", "Steel Ring"), ("none", "12 34"), ("none", "  ")]
    got = {r.k: r for r in curation.decide(spark.createDataFrame(rows, "k string, d string"), "k", "d").collect()}
    assert got["s"].canonical_tokens == ["keyboard", "wireless"]
    assert got["s"].match_name == "wireless keyboard" and got["s"].match_score == 100 and got["s"].decision == "NEED_APPROVAL"  # two names tie
    assert got["one"].decision == "AUTO" and got["one"].final_sku_name == "steel ring"
    assert got["none"].decision == "NEED_APPROVAL" and got["none"].match_name == "" and got["none"].raw_names == ["12 34"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", -1.0), (2, None, None)], "k int, s string, v double")
    assert {r.column_name: r.failures for r in checks.not_null(df, ["k", "s"]).collect()} == {"k": 0, "s": 1}
    assert [tuple(r) for r in checks.unique(df, ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in checks.accepted_values(df, "s", ["a"]).collect()] == [("b", 1)]
    assert [tuple(r) for r in checks.relationships(df, "k", df.where("k = 1"), "k").collect()] == [(2, 1)]
    assert checks.row_count(df).isEmpty() and not checks.row_count(df.limit(0)).isEmpty()
    assert [r.broken for r in checks.violations(df, {"positive": F.col("v") >= 0}).collect()] == [["positive"]]
    assert checks.contract_report(df, ["s"], ["k"], ["v"]).first().asDict() == {"row_count": 3, "null_s": 1, "negative_values": 1, "distinct_keys": 2}


def test_reports(spark):
    df = spark.createDataFrame([("x", "O'Neil", "approved"), ("y", "b", "AUTO")], "sku_id string, final_sku_name string, decision string")
    assert [r.statement for r in reports.update_statements(df, "t").collect()] == ["UPDATE t SET canonical_name = 'O''Neil' WHERE sku_id = 'x';"]
    sums = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 4.0)], "k string, c string, v double")
    assert {r.k: (r.p, r.q) for r in reports.pivot_sum(sums, ["k"], "c", ["p", "q"], "v").collect()} == {"a": (1.0, 2.0), "b": (4.0, 0.0)}
    assert reports.lines_of(reports.top(sums, ["k"], "v", 1), "k", "total", unit="$") == ["b: $4.00"]


ALIASES = ["TechFlow Wireless Keyboard Black", "tf wireless keybord black", "wireless kb black", "tf wireless keybord black", "brand new techflow keyboard wireless", "  ", None]


def test_alias_pipeline(spark):
    df = spark.createDataFrame([("s", k, a) for k, a in enumerate(ALIASES)] + [("none", 0, " "), ("digits", 0, "12 34")], "key string, at int, alias string")
    got = {r.key: r for r in curation.alias_pipeline(df, "key", "alias", "at", top_tokens=3, top_names=3, stop=("the",)).collect()}
    assert set(got) == {"s", "digits"}
    r = got["s"]
    assert r.rep_map["keybord"] == "keyboard" and r.rep_map["keyboard"] == "keyboard"  # both come twice; the longer of equals
    assert r.transformed_aliases == ["techflow wireless keyboard black", "tf wireless keyboard black", "wireless kb black", "tf wireless keyboard black", "brand new techflow keyboard wireless"]
    assert r.canonical_tokens == ["wireless", "keyboard", "black"]
    ranked = sorted(((token_sort_ratio(a.lower(), "wireless keyboard black"), ALIASES.count(a), -k, a) for k, a in enumerate(ALIASES[:5])), reverse=True)[:3]
    assert [(x.score, x.freq, x.alias) for x in r.top_k_original] == [(s, n, a) for s, n, _, a in ranked]
    assert [x.alias_canonicalized for x in r.top_k_canonicalized] == [r.transformed_aliases[-k] for _, _, k, _ in ranked]
    assert r.params == {"max_edit_distance": 1, "min_rep_len": 4, "top_m_canonical_tokens": 3, "top_k_original": 3}
    assert (got["digits"].rep_map, got["digits"].canonical_tokens, got["digits"].top_k_original, got["digits"].transformed_aliases) == ({}, [], [], [""])


def test_ranks_break_ties_by_frequency_then_place(spark):
    rows = [("keyboard wireless", 0), ("wireless keyboard", 1), ("wireless keyboard", 2), ("mouse", 3)]
    df = spark.createDataFrame([("s", a, k, ["wireless", "keyboard"]) for a, k in rows] + [("e", "x", 0, [])], "k string, a string, i int, t array<string>")
    got = sorted((r["rank"], r.a, r.i, r.freq, r.score) for r in curation.rank_aliases(df, "k", "a", "t", "i", 3).collect())
    assert got == [(1, "wireless keyboard", 1, 2, 100.0), (2, "wireless keyboard", 2, 2, 100.0), (3, "keyboard wireless", 0, 1, 100.0)]


def test_capitalized_and_stop_words(spark):
    df = spark.createDataFrame([(["wireless", "USB-c", "x"],)], "t array<string>")
    assert df.select(curation.capitalized("t")).first()[0] == "Wireless Usb-c X"
    assert {"the", "of"} <= set(curation.library_stop_words())


def test_best_match_without_shared_tokens(spark, monkeypatch):
    """Unsettled names are held against all blocks of candidates."""
    import random

    from millrace.functions.similarity import partial_token_set_ratio

    monkeypatch.setattr(matching, "BLOCK", 5)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    vendors = [(f"{k:02d}", f"{word()} {word()}") for k in range(23)]
    names = [word() for _ in range(40)] + [f"{word()} {vendors[3][1].split()[0]}"]
    got = matching.best_match(spark.createDataFrame([(n,) for n in names], "b string"), "b", spark.createDataFrame(vendors, "id string, name string"), "id", "name", abbreviations={}).collect()
    assert len(got) == len(set(names))
    for r in got:
        s, v = max((partial_token_set_ratio(r.b, n) / 100, [-ord(c) for c in i]) for i, n in vendors)
        best = next(x for x in vendors if [-ord(c) for c in x[0]] == v)
        assert r.vendor_fuzz_score == pytest.approx(s)
        assert (r.matched_vendor_id, r.matched_vendor_name) == (best if s >= 0.6 else (None, None))


def test_aliases_by_length(spark):
    from millrace.functions.similarity import ratio

    canon, spelled = ["TechFlow", "ViewMaster", ""], ["techflow", "tecflow", "TF", "view master", "viewm", "", "zzz"]
    got = matching.collect_aliases(spark.createDataFrame([(c,) for c in canon], "c string"), spark.createDataFrame([(n,) for n in spelled], "n string"), "c", "n", 75, {"TF": "TechFlow"})
    want = {c: sorted({n for n in spelled if ratio(c.lower(), n.lower()) >= 75} | ({"TF"} if c == "TechFlow" else set())) for c in canon}
    assert {r.c: r.aliases for r in got.collect()} == want


def test_catalogue(spark):
    rows = [("s", 1, "a", "TF"), ("s", 2, "b", "Tech Flow"), ("s", 3, "b", None), ("t", 1, "c", "Other")]
    df = spark.createDataFrame(rows, "sku_id string, i int, text string, brand string")
    got = {(r.sku_id, r.version): (r.is_active, str(r.created_date), str(r.updated_date)) for r in catalogue.versions(df, "sku_id", ["i"], "2025-01-01", "2025-07-01").collect()}
    assert got == {("s", 1): (False, "2025-01-01", "2025-01-31"), ("s", 2): (False, "2025-01-01", "2025-03-02"), ("s", 3): (True, "2025-03-02", "2025-07-01"), ("t", 1): (True, "2025-01-01", "2025-07-01")}
    assert {r.sku_id: r.fields for r in catalogue.conflicts(df, "sku_id", ["text", "brand"]).collect()} == {"s": ["text", "brand"]}
    brands = catalogue.canonical_brands(df, "brand", ["TechFlow", "ViewMaster"], {"TF": "TechFlow"})
    assert sorted((r.i, r.sku_id, r.brand) for r in brands.collect()) == [(1, "s", "TechFlow"), (1, "t", "Other"), (2, "s", "TechFlow"), (3, "s", "")]


def test_orphans(spark):
    lines = spark.createDataFrame([("a", 1), ("x", 2), ("", 3), (None, 4)], "sku_id string, i int")
    known = spark.createDataFrame([("a",), ("b",)], "sku_id string")
    assert [r.sku_id for r in catalogue.orphans(lines, known).collect()] == ["x"]
    assert sorted((r.i, r.sku_id) for r in catalogue.without_orphans(lines, known).collect()) == [(1, "a"), (3, None), (4, None)]


@pytest.mark.parametrize("one_task", [1000, 10])
def test_numbered(spark, one_task):
    import random

    rng = random.Random(1)
    rows = [(k, rng.randrange(5), rng.random()) for k in range(300)]
    df = ranks.numbered(spark.createDataFrame(rows, "k int, a int, b double"), {"ra": [F.desc("a"), F.col("k")], "rb": [F.col("b")]}, one_task)
    got = {r.k: (r.ra, r.rb) for r in df.collect()}
    for n, key in enumerate((lambda r: (-r[1], r[0]), lambda r: r[2])):
        assert [got[r[0]][n] for r in sorted(rows, key=key)] == list(range(1, 301))


def test_summaries(spark):
    spend = spark.createDataFrame([("a", 1000.5, 3), ("b", 2000.0, 4), ("a", 1.0, 1)], "category string, total_spend_aud double, qty long")
    assert summaries.summarize("spend", spend) == [
        ">> Results: 3 records found", ">> Total spend (AUD): 3,001.50", ">> Total quantity: 8", "\n>> Top 10 Spending Categories:", "  1. b — 2,000.00 AUD", "  2. a — 1,001.50 AUD"]
    assert summaries.summarize("data_quality", spark.createDataFrame([("x", 1200)], "exception_type string, exception_count long"))[1:] == [
        ">> Total exceptions: 1,200", "\n>> Top 10 Exception Areas:", "  1. x — 1,200"]
    assert summaries.summarize("vendors", spend.limit(0)) == [">> Results: 0 vendor performance records"]
    periods = [("Current Month", 10.0, 5, 90.0, 2), ("Previous Month", 4.0, 7, 92.5, 2), ("Year to Date", 1234.0, 1500, 91.0, 30)]
    got = summaries.summarize("executive", spark.createDataFrame(periods, "period_name string, total_spend_aud double, total_orders long, avg_data_quality_score double, total_exceptions long"))
    assert got == [
        ">> Executive KPI Results:", "\n>> SPEND", "   • Spend: 10.00 AUD (▲ 6.00 AUD)", "   • YTD Spend: 1,234.00 AUD", "\n>> ORDERS", "   • Orders: 5 (▼ -2)", "   • YTD Orders: 1,500",
        "\n>> DATA QUALITY METRICS", "   • Quality Score: 90.0/100 (▼ -2.5)", "   • YTD Quality Score: 91.0/100", "   • Total Exceptions: 2 (• 0)", "   • YTD Exceptions: 30", "\n" + "=" * 80]
    assert len(summaries.REGISTRY) == 7 and summaries.summarize("executive", spend.limit(0)) == [">> Executive KPI Results: (no rows)"]
