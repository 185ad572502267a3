"""The pipeline from files to star schema, in batch and as a stream, on a small made-up input."""

import json

import pytest

from millrace.operators import seed
from millrace.plans import procurement, questions
from millrace.sources import readers, writers
from millrace.streaming import orders as stream


def line(n, sku, text, brand, price, day="2025-07-01", currency="USD", quantity=2, **more):
    return {
        "sku_id": sku, "item_description": text, "brand": brand, "quantity": quantity, "order_date": day, "order_timestamp": f"{day}T00:00:00", "country_code": "AU", "cost_centre_id": "CC1",
        "currency": currency, "unit_price": price, "order_id": f"O{n}", "line_number": 1, "requisitioner": "x@y", "approval_status": "APPROVED", "delivery_date": "2025-07-09"} | more


LINES = [
    line(1, "S1", "Wireless &amp; Keyboard", "TF", 10.0),
    line(2, "S1", "wireless keyboard", "TechFlow", 40.0),
    line(3, "S1", "wireless keyboard", "techflow corp", 20.0, currency="AUD", day="2025-07-02"),
    line(4, None, "Delivery fee", None, 5.0),
    line(5, "S9", "Unknown thing", "TF", 5.0),
    line(6, "S1", "zzz qqq", "TF", 5.0),
    line(7, "S1", "keyboard", "", "bad", quantity=None),
]


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    (d / "orders").mkdir()
    for k in range(2):
        (d / f"orders/orders_{k}.json").write_text(json.dumps(LINES[k::2], indent=1))
    (d / "vendors.csv").write_text("vendor_id,vendor_name,tax_id,country_code\nV1,TechFlow Corporation,1,AU\nV2,DataVault Corporation,2,US\n")
    (d / "centres.csv").write_text("cost_centre_id,cost_centre_name,parent_cost_centre_id,country_code\nCC1,Sydney,,AU\n")
    (d / "rates.csv").write_text("date,from_currency,to_currency,exchange_rate\n2025-07-01,USD,AUD,1.5\n2025-07-03,USD,AUD,2.5\n")
    (d / "seed.csv").write_text("sku_id,canonical_name,source,effective_from,version\nS1,wireless keyboard,approved_seed,2025-01-01,v0.1\n")
    return procurement.Inputs(f"{d}/orders/orders_*.json", f"{d}/vendors.csv", f"{d}/centres.csv", f"{d}/rates.csv", f"{d}/seed.csv")


def test_batch(spark, inputs, tmp_path):
    layers = procurement.run(spark, inputs, "2025-06-01", "2025-08-31", "t", str(tmp_path))
    ids = lambda t: sorted(r.order_id for r in layers["silver"][t].collect())
    assert (ids("silver_orders_valid"), ids("silver_orders_nonproduct"), ids("silver_orders_exceptions")) == (["O1", "O2", "O3"], ["O4"], ["O5", "O6", "O7"])
    reasons = {r.order_id: r.exception_type for r in layers["silver"]["silver_orders_exceptions"].collect()}
    assert reasons == {"O5": "SKU_NOT_IN_SEED", "O6": "NAME_MISMATCH", "O7": "VENDOR_MISMATCH"}
    gold = layers["gold"]
    money = {r.order_id: (round(r.line_total_aud, 2), round(r.line_total_usd, 2)) for r in gold["fct_order_line"].collect()}
    assert money == {"O1": (30.0, 20.0), "O2": (120.0, 80.0), "O3": (40.0, 20.0)}
    assert gold["fct_price_variance"].count() == 1
    assert gold["dim_date"].count() == 92
    assert questions.spend(gold, "2025-08-01").first().total_spend_aud == 190.0
    assert questions.executive(gold, "2025-07-20").where("period_name = 'Current Month'").first().total_exceptions == 3
    assert readers.required_tables(spark, ["t_gold.dim_date", "t_gold.nothing"]) == {"t_gold.dim_date": 92, "t_gold.nothing": None}
    assert readers.text_csv(spark, f"{tmp_path}/gold_dim_vendor").count() == 2
    assert readers.table_or_csv(spark, "t_gold.none", f"{tmp_path}/gold_dim_vendor").count() == 2
    assert writers.export_status(spark, "prod").first().status == "SKIPPED"
    assert writers.export_layer(gold, "silver", str(tmp_path), "prod") == []


def test_stream_routes_as_batch_does(spark, inputs, tmp_path):
    seed = readers.seed(spark, inputs.seed)
    vendors = procurement.bronze(spark, inputs)["raw_vendor_master"]
    lines = stream.read(spark, inputs.orders.rsplit("/", 1)[0], 1)
    stream.route_stream(lines, seed, vendors, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination(120)
    got = {k: sorted(r.order_id for r in spark.read.parquet(f"{tmp_path}/out/{k}").collect()) for k in ("valid", "nonproduct", "exceptions")}
    assert got == {"valid": ["O1", "O2", "O3"], "nonproduct": ["O4"], "exceptions": ["O5", "O6", "O7"]}
    assert stream.windowed_spend(lines).isStreaming


def test_files(spark, inputs, tmp_path):
    raw = procurement.bronze(spark, inputs)["raw_orders"]
    assert {r.filename.rsplit("_", 1)[1] for r in raw.select("filename").collect()} == {"0.json", "1.json"}
    writers.partitioned_json(raw.drop("filename"), f"{tmp_path}/j", ["country_code", "cost_centre_id"], ["order_date"])
    assert readers.json_lines(spark, f"{tmp_path}/j/country_code=AU", "order_id string").count() == len(LINES)
    assert readers.preview(raw, 3).count() == 3


def test_listing_audit_and_seed(spark, inputs, tmp_path):
    folder = tmp_path / "source"
    for name in ("a.csv", "sub/b.json", "hidden/c.csv", ".git/d.csv", ".e"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("x")
    assert [(r.label, r.n_bytes) for r in readers.source_files(spark, str(folder)).collect()] == [("a.csv", 1), ("b.json", 1)]
    layers = procurement.run(spark, inputs, "2025-06-01", "2025-08-31", "audited", str(tmp_path / "x"), "2025-08-10 15:00:00")
    for name, df in layers["gold"].items():
        assert set(df.columns) & {"created_at", "updated_at"} == ({"created_at", "updated_at"} if name in ("dim_vendor", "dim_product", "dim_cost_centre") else set() if name == "dim_date" else {"created_at"})
    assert readers.text_csv(spark, str(tmp_path / "x/stg_orders")).count() == len(LINES)
    assert writers.export_named(spark, "dim_vendor", str(tmp_path / "n"), "gold", "audited").endswith("gold_dim_vendor")
    approved = spark.createDataFrame([("S2", "new one", "APPROVED"), ("S1", "other", "AUTO"), ("S3", "no", "NEED_APPROVAL")], "sku_id string, final_sku_name string, decision string")
    place = str(tmp_path / "seed")
    writers.overwrite_seed(readers.seed(spark, inputs.seed), place)
    for _ in range(2):  # the seed is read from where it is written
        writers.overwrite_seed(seed.merged(readers.seed(spark, place), approved, "2025-09-01"), place)
    assert [(r.sku_id, r.canonical_name, r.version) for r in readers.seed(spark, place).collect()] == [("S1", "wireless keyboard", "v0.1"), ("S2", "new one", "v0.3")]


def test_curation_csv(spark, tmp_path):
    import datetime

    from millrace.operators import curation

    found = curation.decide(spark.createDataFrame([("s", "Steel Ring"), ("s", "steel rings")], "k string, d string"), "k", "d")
    path = writers.curation_csv(found, str(tmp_path), datetime.date(2025, 8, 10))
    assert path.endswith("sku_name_curation_20250810")
    assert readers.text_csv(spark, path).select("k", "raw_names").collect() == [("s", "Steel Ring,steel rings")]
