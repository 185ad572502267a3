"""Contracts in one scan per table against the single checks."""

from pyspark.sql import functions as F

from millrace.operators import checks, contracts
from millrace.operators.contracts import Contract

SF = "/root/testdata/sf0.001"


def test_contracts_equal_single_checks(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    tables = {t: read(t) for t in ("lineitem", "part", "orders", "nation")}
    declared = {
        "lineitem": Contract(["l_partkey", "l_tax"], ["l_partkey", "l_shipdate"], {"l_returnflag": ["A", "N"]}, {"l_partkey": ("part", "p_partkey"), "l_suppkey": ("part", "p_size")}, {"cheap": F.col("l_extendedprice") < 30_000}),
        "orders": Contract(not_null=["o_comment"] if "o_comment" in tables["orders"].columns else ["o_orderkey"], least_rows=10**9),
        "nation": Contract(unique=["n_name"]),
    }
    got = {(r.table_name, r.check, r.column_name): r.failures for r in contracts.check(tables, declared).collect()}
    line = tables["lineitem"]
    want = {("lineitem", "not_null", r.column_name): r.failures for r in checks.not_null(line, ["l_partkey", "l_tax"]).collect()}
    want |= {("lineitem", "unique", c): checks.unique(line, [c]).count() for c in ("l_partkey", "l_shipdate")}
    rows = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    want["lineitem", "accepted_values", "l_returnflag"] = rows(checks.accepted_values(line, "l_returnflag", ["A", "N"]))
    want["lineitem", "relationships", "l_partkey"] = rows(checks.relationships(line, "l_partkey", tables["part"], "p_partkey"))
    want["lineitem", "relationships", "l_suppkey"] = rows(checks.relationships(line, "l_suppkey", tables["part"], "p_size"))
    want["lineitem", "rule", "cheap"] = line.where("l_extendedprice >= 30000").count()
    want["orders", "not_null", declared["orders"].not_null[0]] = tables["orders"].where(F.col(declared["orders"].not_null[0]).isNull()).count()
    want["orders", "row_count", ""] = 10**9 - tables["orders"].count()
    want["nation", "unique", "n_name"] = 0
    assert got == want and got["lineitem", "unique", "l_shipdate"] > 0


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), (1, None), (1, "x")], "k int, v string")
    none = df.where("false")
    declared = {"a": Contract(["k"], ["k"], {"v": ["x"]}, {"v": ("b", "v")}), "b": Contract(["k"], ["k"], least_rows=1)}
    got = {(r.table_name, r.check, r.column_name): r.failures for r in contracts.check({"a": df, "b": none}, declared).collect()}
    assert got == {("a", "not_null", "k"): 2, ("a", "unique", "k"): 1, ("a", "accepted_values", "v"): 1, ("a", "relationships", "v"): 3, ("b", "not_null", "k"): 0, ("b", "unique", "k"): 0, ("b", "row_count", ""): 1}


def test_one_scan_and_none_on_a_write(spark, tmp_path):
    """The rows pass once: an accumulator in the way counts them."""
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("id as k", "id % 3 as v").mapInArrow(count, "k long, v long")
    contract = Contract(["k", "v"], ["k", "v"], {"v": [0, 1]})
    got = {(r.check, r.column_name): r.failures for r in contracts.check({"t": df}, {"t": contract}).collect()}
    assert got == {("not_null", "k"): 0, ("not_null", "v"): 0, ("accepted_values", "v"): 33, ("unique", "k"): 0, ("unique", "v"): 3} and passed.value == 100
    seen_df, seen = contracts.watched(df, contract, "write")
    seen_df.write.parquet(f"{tmp_path}/t")
    assert contracts.observed(seen, contract) == {("not_null", "k"): 0, ("not_null", "v"): 0, ("accepted_values", "v"): 33} and passed.value == 200
