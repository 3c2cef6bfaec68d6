"""Typed tables from two small deliveries: recovery, warnings, rejects, cascades, newest versions, reruns."""

import os

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import dedup, publish, rules
from lakeloom.plans import deliveries, silver
from lakeloom.sources.landing import with_lineage
from tests.conftest import SF


def landed(spark, dataset, rows, batch="b1"):
    columns = silver.CONTRACTS[dataset].columns
    data = [tuple(r.get(c) for c in columns) for r in rows]
    df = with_lineage(spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns)), batch, f"{dataset}.csv", "r1")
    return df.withColumn("_ingested_at", F.lit("2026-01-01 00:00:00" if batch == "b1" else "2026-02-01 00:00:00").cast("timestamp"))


REGION = {"region_code": "na-east", "region_name": "East", "country_code": "US", "country_name": "United States", "currency_code": "USD", "base_delivery_days": "3"}


def customer(i, **kw):
    return {"customer_id": f"CUST-{i:06d}", "first_name": " Ann ", "last_name": "Lee", "email": "ANN@EXAMPLE.COM ", "signup_date": "2024-03-01",
        "country": "usa", "region_code": "NA-EAST", "customer_segment": "vip", "updated_at": "2024-05-01T00:00:00Z"} | kw


def order(i, **kw):
    return {"order_id": f"ORD-{i:07d}", "customer_id": "CUST-000001", "order_date": "2025-05-01T10:00:00Z", "status": " PAID ", "currency": "usd",
        "order_total": "10.5", "updated_at": "2025-05-01T10:00:00Z", "channel": "web"} | kw


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("silver"))
    many = [customer(i) for i in range(10, 60)]
    frames = {
        "regions": landed(spark, "regions", [REGION]),
        "customers": landed(spark, "customers", [customer(1), customer(1), customer(2, email="not-an-email"), customer(3, customer_id=None),
            customer(4, signup_date="2024-02-30"), *many]),
        "orders": landed(spark, "orders", [order(1), order(2, region_code=None), order(3, customer_id="CUST-999999"), *[order(i) for i in range(10, 60)]]),
    }
    silver.build_all(frames, root, "b1", "r1")
    silver.build_all({"orders": landed(spark, "orders", [order(1, status="delivered", updated_at="2025-06-01T00:00:00Z"), order(2, status="cancelled",
        updated_at="2025-04-01T00:00:00Z")], "b2")}, root, "b2", "r2")
    return root


def test_customers(spark, built):
    rows = {r["customer_id"]: r for r in publish.read(spark, f"{built}/customers").collect()}
    assert len(rows) == 53 and "CUST-000003" not in rows
    assert (rows["CUST-000001"]["email"], rows["CUST-000001"]["country_code"], rows["CUST-000001"]["region_code"]) == ("ann@example.com", "US", "NA-EAST")
    assert rows["CUST-000002"]["email"] is None and "customers.email_format" in rows["CUST-000002"]["quality_warnings"]
    assert rows["CUST-000004"]["signup_date"] is None


def test_orders(spark, built):
    rows = {r["order_id"]: r for r in publish.read(spark, f"{built}/orders").collect()}
    assert len(rows) == 52 and "ORD-0000003" not in rows  # its customer is unknown
    assert rows["ORD-0000001"]["status"] == "delivered" and rows["ORD-0000002"]["status"] == "paid"  # newest version wins
    assert rows["ORD-0000002"]["region_code"] == "NA-EAST"  # from its customer


def test_quarantine_keeps_the_delivered_record(spark, built):
    bad = rules.read_quarantine(spark, f"{built}/_quarantine", "orders", "b1").head()
    assert bad["rule_ids"] == ["orders.customer_known"] and '"status":" PAID "' in bad["record"]


def test_breaker_leaves_evidence(spark, built):
    with pytest.raises(rules.RejectRateExceeded):
        silver.build_all({"orders": landed(spark, "orders", [order(i, currency="XXX") for i in range(70, 80)], "b3")}, built, "b3", "r3")
    assert rules.read_quarantine(spark, f"{built}/_quarantine", "orders", "b3").count() == 10


def test_other_projections(spark):
    items = landed(spark, "order_items", [{"order_item_id": "OI-1", "order_id": "ORD-0000001", "product_id": "PRD-00001", "quantity": "2",
        "unit_price": "9.50", "discount_pct": "10", "line_total": "24.87"}])
    orders = spark.createDataFrame([("ORD-0000001", "2025-05", 17.1)], "order_id string, order_month string, order_total double")
    products = spark.createDataFrame([("PRD-00001",)], "product_id string")
    good, _ = silver.typed("order_items", items, {"orders": orders, "products": products})
    row = good.head()
    assert (row["line_total"], row["line_total_source"], row["quality_warnings"]) == (17.1, 24.87, ["order_items.line_total_consistent"])
    pay = landed(spark, "payments", [{"payment_id": "P1", "order_id": "ORD-0000001", "payment_method": "Wallet", "amount": "17.1", "currency": "USD",
        "status": "captured", "paid_at": "2025-05-02T00:00:00Z"}])
    assert silver.typed("payments", pay, {"orders": orders})[0].head()["paid_month"] == "2025-05"
    product = landed(spark, "products", [{"product_id": "PRD-00001", "sku": "s", "name": "n", "category_id": "C", "supplier_id": "S",
        "unit_price": "$12.99", "unit_cost": "8", "currency": "USD", "is_active": "true", "updated_at": "2024-01-01T00:00:00Z",
        "dimensions_cm": "10x20"}])
    refs = {"categories": spark.createDataFrame([("C",)], "category_id string"), "suppliers": spark.createDataFrame([("S",)], "supplier_id string")}
    _, seen = silver.typed("products", product, refs)
    r = seen.head()
    assert r["rule_ids"] == ["products.unit_price_numeric"] and r["quality_warnings"] == ["products.dimensions_parseable"]
    stock = landed(spark, "inventory_events", [{"event_id": "e", "event_type": "shipment", "product_id": "prd-00001", "warehouse_id": "WH-01",
        "quantity_delta": "3", "event_ts": "2025-01-01T00:00:00Z"}])
    _, seen = silver.typed("inventory_events", stock, {"products": products, "warehouses": spark.createDataFrame([("WH-01",)], "warehouse_id string")})
    assert seen.head()["rule_ids"] == ["inventory_events.sign_matches_type"]
    ship = landed(spark, "shipping_events", [{"shipment_id": "SHP-0000001", "event": "DELIVERED", "order_id": "ORD-0000001",
        "event_ts": "2025-01-01T00:00:00Z", "warehouse_id": "WH-99"}])
    good, seen = silver.typed("shipping_events", ship, {"orders": orders, "warehouses": spark.createDataFrame([("WH-01",)], "warehouse_id string")})
    assert good.head()["event"] == "delivered" and set(seen.head()["quality_warnings"]) == {"shipping_events.warehouse_known", "shipping_events.carrier_present"}


def test_a_run_types_each_parent_once(spark, monkeypatch):
    given = deliveries.Deliveries(spark, SF)
    read, typed, scans, made = given.read, given.typed, [], []
    monkeypatch.setattr(given, "read", lambda t: (scans.append(t), read(t))[1])
    monkeypatch.setattr(given, "typed", lambda d: (made.append(d), typed(d))[1])
    assert given.statistics().count() == sum(len(s.rules) for s in silver.SUITES.values())
    assert sorted(made) == sorted(set(made)) == sorted({p for s in silver.SPECS.values() for p in s.needs})
    plan = given.evaluated("order_items")._jdf.queryExecution().analyzed().toString()
    assert scans.count("lineitem") == 1 and "l_shipdate" not in plan  # duplicates are told from a table, not from the window that makes it


@pytest.mark.parametrize("dataset, source, key, other", [("products", "part", "p_partkey", "p_partkey + 100000"), ("suppliers", "supplier", "s_suppkey", "s_suppkey * 10 + 1")])
def test_rows_that_share_a_typed_key_give_one_result_in_any_order_of_files(spark, folder, dataset, source, key, other):
    """Keys of many digits are cut to one typed key, whose rows agree in version: which row stays must not depend on how files are cut."""
    found = []
    for back in (False, True):
        for name in ("region", "nation", "supplier", "part"):
            spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{back}/{name}.parquet")
        first = spark.read.parquet(f"{SF}/{source}.parquet").where(f"{key} between 1 and 9").withColumn(key, F.col(key) * 1000)
        both = first.unionByName(first.withColumn(key, F.expr(other)))
        both.orderBy(F.col(key).desc() if back else key).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{back}/{source}.parquet")
        found.append(sorted(map(str, deliveries.Deliveries(spark, f"{folder}/{back}").shown(dataset).collect())))
    assert found[0] == found[1] and found[0]


def shuffle_files(spark):
    roots = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for r in roots for _, _, names in os.walk(r) for f in names if f.startswith("shuffle")}


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_a_build_leaves_neither_shuffles_nor_blocks_nor_scratch_behind(spark, folder, monkeypatch, at_once):
    monkeypatch.setattr(dedup, "AT_ONCE", at_once)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    shared = spark.conf.get("spark.checkpoint.dir")
    given = deliveries.Deliveries(spark, SF)
    frames = {d: given.landed(d) for d in ("regions", "customers", "orders")}
    before, cached = shuffle_files(spark), spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    seen = []
    monkeypatch.setattr(rules, "enforce", lambda *a: seen.append(spark.sparkContext._jsc.sc().getPersistentRDDs().size()))
    try:
        counts = silver.build_all(frames, folder, "b1", "r1")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = shuffle_files(spark) - before
    assert counts["orders"] == publish.read(spark, f"{folder}/orders").count() == given.typed("orders").count() > 0
    assert seen == [cached] * 3  # evaluated rows lie in a packed table, not in blocks of every column
    assert not left
    assert not [n for n in os.listdir(shared) if n.startswith("judged-")]


def test_records_hold_what_was_delivered_where_a_column_was_replaced(spark, folder):
    silver.build_all({"regions": landed(spark, "regions", [REGION])}, folder, "b1", "r1")
    rows = [customer(i) for i in range(1, 40)] + [customer(50, customer_id=" cust-000050 ", region_code=" na-east", customer_segment="alien")]
    silver.build_all({"customers": landed(spark, "customers", rows)}, folder, "b1", "r1")
    bad = rules.read_quarantine(spark, f"{folder}/_quarantine", "customers", "b1").head()
    assert bad["rule_ids"] == ["customers.segment_allowed"]
    assert '"customer_id":" cust-000050 "' in bad["record"] and '"region_code":" na-east"' in bad["record"] and "_given" not in bad["record"]
    assert all(f.endswith(".gz") for _, _, names in os.walk(f"{folder}/_quarantine") for f in names if f.startswith("part"))


def test_a_join_by_order_needs_no_shuffle_after_duplicates(spark, monkeypatch):
    """Where all rows are shuffled to find copies, they are dealt as the join with their parent needs them, and hold each delivered column once."""
    monkeypatch.setattr(dedup, "AT_ONCE", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        given = deliveries.Deliveries(spark, SF)
        plan = given.evaluated("payments")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(order_id") == 1 and "hashpartitioning(payment_id" not in plan
    assert all("_raw" not in line for line in plan.splitlines() if "Exchange" in line)
