"""Questions over written tables: the same answers, months pruned, no exchange below the join with products."""

import re

import pytest

from millrace.plans import questions, registry, standin, warehouse
from millrace.plans.standin import AS_OF
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    names = ("dim_date", "dim_cost_centre", "dim_vendor", "dim_product", "fct_order_line", "fct_data_quality", "fct_price_variance")
    return warehouse.write(spark, standin.tables(spark, SF), "star_of_tests", names, buckets=4)


@pytest.mark.parametrize("name", sorted(questions.QUESTIONS))
def test_same_answers(spark, stored, name):
    ask = questions.QUESTIONS[name]
    got, want = ask(stored, AS_OF), ask(standin.tables(spark, SF), AS_OF)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())


def test_plan(spark, stored):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # products are too many to broadcast
    try:
        df = questions._joined(stored, "fct_order_line", "dim_date", "dim_product", when=questions._since(AS_OF, 3)).select("line_total_aud", "product_category")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    facts = next(x for x in plan.splitlines() if "fct_order_line" in x or "line_total_aud" in x and "FileScan" in x)
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", facts) and "SelectedBucketsCount: 4 out of 4" in facts
    months = {r.month_key for r in stored["dim_date"].where(questions._since(AS_OF, 3)).collect()}
    assert stored["fct_order_line"].select("month_key").distinct().count() > len(months)


def test_shares(spark):
    """Facts written in shares of the orders are all facts, each once, and no share has them all."""
    whole = standin.tables(spark, SF)
    dims = {n: whole[n] for n in ("dim_date", "dim_cost_centre", "dim_vendor", "dim_product")}
    shares = []
    for k in range(3):
        own = standin.Tables(spark, standin.Share(spark, SF, k, 3))
        own.update(dims)
        shares.append(own["fct_order_line"])
    got = warehouse.write(spark, {"fct_order_line": iter(shares)}, "star_in_shares", ["fct_order_line"], 2)["fct_order_line"]
    columns = whole["fct_order_line"].columns
    assert rows(columns, got.select(columns).collect()) == rows(columns, whole["fct_order_line"].collect())
    assert all(0 < f.count() < got.count() for f in shares)


def test_nothing_is_left(spark):
    def stars():
        return {r[0] for r in spark.sql("SHOW DATABASES").collect()}

    was = stars()
    out = registry.QUERIES["q5_from_warehouse"](spark, SF)
    assert stars() == was and out.count() > 0
