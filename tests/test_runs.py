"""What the marts of one run read: shared tables are written once, sources are scanned a few times."""

from datetime import date
from decimal import Decimal

import pytest

from lakeloom import registry
from lakeloom.plans import marts, sample, staging, star
from lakeloom.plans.sample import Commerce
from tests.conftest import SF


@pytest.fixture()
def run(spark, monkeypatch):
    """A run that keeps account of its scans and of the tables it has written."""
    c = Commerce(spark, SF)
    c.scans, c.writes, source, once = [], [], c.source, c.once

    def counted(name, build):
        c.writes.extend([name] if name not in c._written else [])
        return once(name, build)

    monkeypatch.setattr(c, "source", lambda name: (c.scans.append(name), source(name))[1])
    monkeypatch.setattr(c, "once", counted)
    return c


def test_marts_of_one_run_share_their_facts(run):
    daily = run.daily
    assert run.scans.count("orders") == 3 and run.scans.count("lineitem") == 1  # days, headers and payments
    before = len(run.scans)
    monthly = marts.monthly_revenue(run.daily, run.orders_once)
    registry._ltv(run)
    assert run.scans[before:].count("orders") == 0 and run.scans.count("lineitem") == 1
    registry._supplier_mart(run)
    run.metrics  # noqa: B018
    assert run.scans.count("orders") == 3 and run.scans.count("lineitem") == 1
    assert sorted(run.writes) == sorted(set(run.writes)) and {"order-days", "rates", "items", "fact-orders", "fact-items", "active-sets"} == set(run.writes)
    assert monthly.count() == daily.select("year_month").distinct().count()


@pytest.mark.parametrize("mart", ["metrics", "supplier"])
def test_marts_of_lines_alone_make_no_order_fact(run, mart):
    _ = run.metrics if mart == "metrics" else registry._supplier_mart(run)
    assert run.scans.count("orders") == 2 and run.scans.count("lineitem") == 1 and "fact-orders" not in run.writes


@pytest.mark.parametrize("name", sorted(staging.STAGING))
def test_a_staging_table_makes_no_other_fact(run, name):
    registry._staged(run, name)
    assert not {"items", "fact-orders", "fact-items", "active-sets"} & set(run.writes)
    assert run.scans.count("lineitem") == (name in ("stg_orders", "stg_order_items")) and run.scans.count("events") == (name in
        ("stg_inventory_events", "stg_inventory_position", "stg_shipments"))


def test_facts_are_written_without_the_keys_that_readers_make(run):
    assert not {"order_key", "customer_key", "region_key"} & set(run.orders_once.sparkSession.read.parquet(*run.orders_once.inputFiles()).columns)
    for once, plan in ((run.orders_once, run.fact_orders), (run.items_once, run.fact_items)):
        assert once.columns == plan.columns and once.dtypes == plan.dtypes
        assert once.exceptAll(plan).isEmpty() and plan.exceptAll(once).isEmpty()


def test_stock_and_shipments_are_scanned_once_a_run(run):
    registry._turnover(run)
    registry._supplier_mart(run)
    _ = run.position
    assert run.scans.count("events") == 1
    other = len(run.scans)
    registry._fact_keys(run)
    assert run.scans[other:].count("events") == 1 and "fact-shipping" in run.writes


def test_tables_of_a_run_are_packed_tightly(run):
    assert run.order_days.inputFiles() and all(".zstd." in f for f in run.order_days.inputFiles())


def test_products_by_day_are_summed_in_tasks_of_a_known_size(run, monkeypatch):
    monkeypatch.setattr(sample, "A_TASK", 500)
    n = run.parts("lineitem")
    assert n == -(-run.spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500) and n > run.spark.sparkContext.defaultParallelism
    few = star.product_daily_sales(run.fact_items_in(n), n)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n}), REPARTITION_BY_NUM") == 3  # lines by order key, lines and then orders by product and day
    whole = star.product_daily_sales(run.fact_items)
    assert few.dtypes == whole.dtypes and few.exceptAll(whole).isEmpty() and whole.exceptAll(few).isEmpty()


def test_products_by_day_count_an_order_and_a_customer_once(spark):
    columns = "product_id, category_id, supplier_id, order_date, order_month, order_id, customer_id, quantity, line_total_usd, gross_margin_usd, is_revenue"
    types = "long long long date string long long long decimal(18,2) decimal(18,2) boolean".split()
    day = date(2024, 1, 2)
    rows = [(1, 2, 3, day, "2024-01", order, customer, 2, Decimal("5.00"), None, kept) for order, customer, kept in
        ((10, 7, True), (10, 7, True), (11, 7, True), (12, 8, True), (13, None, True), (14, 9, False))]
    lines = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns.split(", "), types)))
    for parts in (None, 3):
        got = star.product_daily_sales(lines, parts).collect()
        assert [tuple(r) for r in got] == [(1, 2, 3, day, "2024-01", 4, 10, Decimal("25.00"), None, 2)]
