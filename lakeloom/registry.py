"""Registered queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom import functions as fn
from lakeloom.operators import dedup, merge, prefix, publish, rules
from lakeloom.operators.asof import asof_join
from lakeloom.operators.scratch import scratch
from lakeloom.plans import checks, deliveries, marts, reads, silver, staging, star
from lakeloom.plans.sample import LINE_KEYS, LINE_VERSION, SQL_TABLES, Commerce
from lakeloom.sources import landing, readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and small integers as longs: what both engines print alike."""

    def cast(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double")
        return F.col(f.name).cast("bigint") if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name)

    return df.select(*[cast(f).alias(f.name) for f in df.schema.fields])


def _register(name: str, build: Callable[[Commerce], DataFrame], sql: str, tables: bool = True) -> None:
    _QUERIES[name] = lambda spark, sf_dir: _plain(build(Commerce(spark, sf_dir)))
    _SQL[name] = f"{SQL_TABLES}{sql}" if tables else sql


def _columns(spec: str) -> tuple[list[str], str]:
    """``a b:d c:i`` as names and a DuckDB select list; d is a double, i a bigint."""
    names, out = [], []
    for part in spec.split():
        name, _, kind = part.partition(":")
        names.append(name)
        out.append(f"CAST({name} AS {'DOUBLE' if kind == 'd' else 'BIGINT'}) AS {name}" if kind else name)
    return names, ", ".join(out)


def _table(name: str, build: Callable[[Commerce], DataFrame], source: str, spec: str) -> None:
    """A query that returns columns of a table that the SQL prefix has under another name."""
    names, listed = _columns(spec)
    _register(name, lambda c: build(c).select(*names), f"SELECT {listed} FROM {source}")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _weighted(value: str, weight: str) -> str:
    """SQL of a weighted mean, summed as decimals."""
    return f"CAST(sum(CAST({value} * {weight} AS DECIMAL(30,10))) AS DOUBLE) / nullif(sum({weight}) FILTER ({value} IS NOT NULL), 0)"


# ---- facts, dimensions, intermediates

_table("fact_orders", lambda c: c.fact_orders, "fact_orders",
    """order_id customer_id region_code order_date_key:i order_ts order_date order_month status channel currency coupon_code
    order_total_local:d fx_usd_per_unit:d order_total_usd:d gross_amount_usd:d discount_usd:d lines_total_usd:d lines_reconciled item_count:i total_quantity:i paid_at captured_amount_usd:d refunded_amount_usd:d
    failed_payment_attempts:i is_cancelled is_returned is_revenue customer_order_seq:i days_since_prev_order:i is_first_order updated_at _batch_id""")
_table("fact_order_items", lambda c: c.fact_items, "fact_items",
    """order_item_id order_id product_id category_id supplier_id customer_id region_code order_date_key:i order_date order_ts order_month status currency
    quantity:i unit_price_local:d discount_pct:i line_total_local:d fx_usd_per_unit:d unit_price_usd:d line_total_usd:d unit_cost_usd:d line_cost_usd:d gross_margin_usd:d is_revenue is_returned line_total_recomputed _batch_id""")
_table("fact_inventory", lambda c: c.inventory, "inventory",
    """event_id product_id warehouse_id supplier_id event_date_key:i event_ts event_date event_month event_type quantity_delta:i on_hand_after:i unit_cost:d
    receipt_value_usd:d defective_qty:i counted_quantity:i reference_id reason _batch_id""")
_table("fact_shipping", lambda c: c.shipping, "shipping",
    """shipment_id:i order_id:i customer_id warehouse_id region_code carrier order_date order_month ship_date_key:i delivered_date_key:i label_created_ts picked_up_ts in_transit_ts
    out_for_delivery_ts delivered_ts exception_ts returned_ts delivery_hours delivery_days is_delivered had_exception is_returned timeline_inconsistent event_count:i""")


def _fact_keys(c: Commerce) -> DataFrame:
    """Surrogate keys of all facts: how many differ, and how many of the ids that they stand for."""
    out = None
    for fact, rows, ids in (("orders", c.orders_once, "order customer region"), ("order_items", c.items_once,
        "order_item order product category supplier customer region"), ("inventory", c.inventory, "product warehouse supplier"), ("shipping",
        c.shipping_once, "shipment order customer warehouse region")):
        for name in ids.split():
            id = f"{name}_code" if name == "region" else f"{name}_id"
            one = rows.agg(F.lit(fact).alias("fact"), F.lit(id).alias("id"), F.countDistinct(f"{name}_key").alias("keys"),
                F.countDistinct(F.coalesce(F.col(id).cast("string"), F.lit(""))).alias("ids"))
            out = one if out is None else out.unionByName(one)
    return out


_KEYED = {"orders": ("fact_orders", "order_id customer_id region_code"), "order_items": ("fact_items",
    "order_item_id order_id product_id category_id supplier_id customer_id region_code"), "inventory": ("inventory",
    "product_id warehouse_id supplier_id"), "shipping": ("shipping", "shipment_id order_id customer_id warehouse_id region_code")}
_register(
    "fact_keys",
    _fact_keys,
    " UNION ALL ".join(f"SELECT '{fact}' AS fact, '{i}' AS id, count(DISTINCT coalesce(CAST({i} AS VARCHAR), '')) AS keys, count(DISTINCT coalesce(CAST({i} AS VARCHAR), '')) AS ids FROM {table}"
        for fact, (table, ids) in _KEYED.items() for i in ids.split()),
)
_table("agg_inventory_position", lambda c: c.position, "position",
    "product_id warehouse_id last_receipt_ts last_shipment_ts last_event_ts units_received:i units_shipped:i units_defective:i on_hand_units:i avg_unit_cost_usd:d inventory_value_usd:d")
_table("dim_product", lambda c: c.dim_product, "products",
    "product_id product_name brand category_id supplier_id unit_price:d unit_cost:d category_name parent_category_name supplier_name unit_margin:d is_negative_margin")
_table("dim_hierarchy", lambda c: star.dim_category(c.derived("c_categories")), "categories", "category_id category_name parent_category_name")
_table("dim_supplier", lambda c: star.dim_supplier(c.derived("c_suppliers")), "c_suppliers", "supplier_id supplier_name country_id")
_table("int_revenue_lines", lambda c: c.lines, "lines",
    "order_id order_item_id order_date order_month customer_id product_id product_name brand category_name parent_category_name supplier_id supplier_name region_code region_name quantity:i line_total_usd:d line_cost_usd:d gross_margin_usd:d")
_table("int_period_sales", lambda c: marts.period_sales(c.lines, c.order_days), "periods",
    "product_id as_of_date revenue_last_90d:d revenue_prior_90d:d units_last_90d:i units_prior_90d:i units_last_30d:i")
_table("int_shipping_enriched", lambda c: c.enriched, "enriched",
    "shipment_id:i order_id:i region_code region_name base_delivery_days:i warehouse_name delivery_days delivered_on_time")
_table("product_metrics", lambda c: c.metrics, "metrics",
    "product_id product_name category_name supplier_name orders:i units_sold:i revenue_usd:d gross_margin_usd:d unique_customers:i first_sold_date last_sold_date revenue_last_90d:d revenue_prior_90d:d revenue_trend_ratio is_declining velocity_units_per_day:d revenue_rank:i")
_table("daily_sales", lambda c: c.daily, "daily",
    "sales_date year_month is_weekend orders_placed:i revenue_orders:i cancelled_orders:i returned_orders:i active_customers:i new_customers:i revenue_usd:d discount_usd:d refunded_usd:d gross_margin_usd:d units_sold:i avg_order_value_usd")
_register(
    "fx_asof",
    lambda c: asof_join(c.derived("c_orders").select("order_id", "order_date", "currency"), c.given_rates.withColumn("rate_day", F.col("day")), ["currency"],
        "order_date", "day", ["usd_per_unit", "rate_day"]),
    """
    SELECT o.order_id, o.order_date, o.currency, CAST(r.usd_per_unit AS DOUBLE) AS usd_per_unit, r.day AS rate_day
    FROM c_orders o ASOF LEFT JOIN given_rates r ON o.currency = r.currency AND o.order_date >= r.day
    """,
)
_table("fx_forward_fill", lambda c: c.rates, "rates", "day currency usd_per_unit:d")
_table("order_item_agg", lambda c: star.item_totals(c.derived("c_items")), "item_totals", "order_id item_count:i total_quantity:i items_total:d gross_total:d")
_table("payment_agg", lambda c: star.payment_totals(c.derived("c_payments")), "payment_totals", "order_id paid_at captured:d refunded:d failed:i")
_register(
    "dim_customer",
    lambda c: c.dim_customer.drop("customer_key", "region_key"),
    """
    SELECT customer_id, first_name || ' ' || last_name AS full_name, email, customer_segment, country_code, region_code, city, signup_date, birth_date,
    marketing_opt_in, updated_at, coalesce(len(quality_warnings), 0) AS quality_warning_count FROM c_customers
    """,
)
_register(
    "dim_warehouse_region",
    lambda c: star.dim_warehouse(c.derived("c_warehouses")).select("warehouse_id", "warehouse_name", "capacity_units").unionByName(star.dim_region(c.derived("c_regions")).select(F.col("region_code").alias("warehouse_id"), F.col("region_name").alias("warehouse_name"),
        F.col("base_delivery_days").alias("capacity_units"))),
    """
    SELECT warehouse_id, warehouse_name, capacity_units FROM c_warehouses UNION ALL SELECT region_code, region_name, base_delivery_days FROM
    c_regions
    """,
)
_register(
    "date_dim",
    lambda c: c.dates,
    """
    , span AS (SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM c_orders), (SELECT max(order_date) FROM c_orders), INTERVAL 1 DAY)) AS
    DATE) AS full_date) SELECT CAST(strftime(full_date, '%Y%m%d') AS BIGINT) AS date_key, full_date, year(full_date) AS year, quarter(full_date) AS
    quarter, month(full_date) AS month, strftime(full_date, '%Y-%m') AS year_month, weekofyear(full_date) AS iso_week, day(full_date) AS
    day_of_month, dayofweek(full_date) + 1 AS day_of_week, monthname(full_date) AS month_name, dayname(full_date) AS day_name,
    dayofweek(full_date) IN (0, 6) AS is_weekend FROM span
    """,
)
_register(
    "agg_product_daily_sales",
    lambda c: star.product_daily_sales(c.fact_items_in(c.parts("lineitem")), c.parts("lineitem")),
    """
    SELECT product_id, category_id, supplier_id, order_date, order_month, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS
    units_sold, CAST(sum(line_total_usd) AS DOUBLE) AS revenue_usd, CAST(sum(gross_margin_usd) AS DOUBLE) AS gross_margin_usd, count(DISTINCT
    customer_id) AS unique_customers FROM fact_items WHERE is_revenue GROUP BY ALL
    """,
)
_register(
    "int_customer_orders",
    lambda c: marts.customer_orders(c.fact_orders),
    """
    SELECT customer_id, count(*) AS total_orders, count(*) FILTER (is_revenue) AS revenue_orders, count(*) FILTER (is_cancelled) AS cancelled_orders,
    count(*) FILTER (is_returned) AS returned_orders, CAST(sum(order_total_usd) FILTER (is_revenue) AS DOUBLE) AS revenue_usd,
    CAST(sum(refunded_amount_usd) AS DOUBLE) AS refunded_usd, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
    CAST(sum(days_since_prev_order) AS DOUBLE) / nullif(count(days_since_prev_order), 0) AS avg_days_between_orders FROM fact_orders GROUP BY
    customer_id
    """,
)

# ---- marts

_register(
    "monthly_revenue",
    lambda c: marts.monthly_revenue(c.daily, c.orders_once, c.active_sets),
    """
    , m AS (SELECT year_month, min(sales_date) AS month_start, CAST(sum(orders_placed) AS BIGINT) AS orders_placed, CAST(sum(revenue_orders) AS
    BIGINT) AS revenue_orders, CAST(sum(cancelled_orders) AS BIGINT) AS cancelled_orders, CAST(sum(returned_orders) AS BIGINT) AS returned_orders,
    sum(revenue_usd) AS r, CAST(sum(gross_margin_usd) AS DOUBLE) AS gross_margin_usd, CAST(sum(discount_usd) AS DOUBLE) AS discount_usd,
    CAST(sum(refunded_usd) AS DOUBLE) AS refunded_usd, CAST(sum(units_sold) AS BIGINT) AS units_sold, CAST(sum(new_customers) AS BIGINT) AS
    new_customers FROM daily GROUP BY year_month), a AS (SELECT order_month AS year_month, count(DISTINCT customer_id) AS active_customers FROM
    fact_orders WHERE is_revenue GROUP BY order_month) SELECT m.* EXCLUDE (r), CAST(r AS DOUBLE) AS revenue_usd, active_customers, CASE WHEN r > 0
    THEN gross_margin_usd / CAST(r AS DOUBLE) END AS gross_margin_pct, CASE WHEN revenue_orders > 0 THEN CAST(r AS DOUBLE) / revenue_orders END AS
    avg_order_value_usd, CAST(lag(r) OVER (ORDER BY year_month) AS DOUBLE) AS prev_month_revenue_usd, CASE WHEN lag(r) OVER (ORDER BY year_month) > 0
    THEN CAST(r - lag(r) OVER (ORDER BY year_month) AS DOUBLE) / CAST(lag(r) OVER (ORDER BY year_month) AS DOUBLE) END AS revenue_mom_growth FROM m
    LEFT JOIN a USING (year_month)
    """,
)
#: Attributes of a customer that the lifetime mart carries.
_LTV_CUSTOMER = ("customer_id", "full_name", "customer_segment", "country_code", "region_code", "signup_date")
_register(
    "customer_ltv",
    lambda c: marts.customer_ltv(c.dim_customer.select(*_LTV_CUSTOMER), c.orders_once),
    """
    , o AS (SELECT customer_id, count(*) AS total_orders, count(*) FILTER (is_revenue) AS revenue_orders, count(*) FILTER (is_cancelled) AS
    cancelled_orders, count(*) FILTER (is_returned) AS returned_orders, sum(order_total_usd) FILTER (is_revenue) AS rev, sum(refunded_amount_usd) AS
    ref, min(order_date) AS first_order_date, max(order_date) AS last_order_date, CAST(sum(days_since_prev_order) AS DOUBLE) /
    nullif(count(days_since_prev_order), 0) AS avg_days_between_orders FROM fact_orders GROUP BY customer_id) SELECT c.customer_id, first_name || ' ' ||
    last_name AS full_name, customer_segment, country_code, c.region_code, signup_date, coalesce(total_orders, 0) AS total_orders, coalesce(revenue_orders, 0) AS revenue_orders, coalesce(cancelled_orders, 0) AS
    cancelled_orders, coalesce(returned_orders, 0) AS returned_orders, first_order_date, last_order_date, avg_days_between_orders, CASE WHEN
    revenue_orders > 0 THEN CAST(rev AS DOUBLE) / revenue_orders END AS avg_order_value_usd, as_of - last_order_date AS recency_days,
    CAST(coalesce(rev, 0) AS DOUBLE) AS lifetime_revenue_usd, CAST(coalesce(ref, 0) AS DOUBLE) AS lifetime_refunded_usd, CAST(coalesce(rev, 0) -
    coalesce(ref, 0) AS DOUBLE) AS net_lifetime_value_usd, CASE WHEN last_order_date IS NULL THEN 'never_purchased' WHEN as_of - last_order_date <=
    90 THEN 'active' WHEN as_of - last_order_date <= 180 THEN 'at_risk' ELSE 'churned' END AS lifecycle_stage, ntile(10) OVER (ORDER BY coalesce(rev,
    0) DESC, c.customer_id) AS value_decile FROM c_customers c LEFT JOIN o USING (customer_id) CROSS JOIN (SELECT max(order_date) AS as_of FROM
    fact_orders)
    """,
)
_register(
    "category_revenue",
    lambda c: marts.category_revenue(c.lines),
    """
    , g AS (SELECT parent_category_name, category_name, order_month, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units_sold,
    sum(line_total_usd) AS r, CAST(sum(gross_margin_usd) AS DOUBLE) AS gross_margin_usd FROM lines GROUP BY ALL) SELECT * EXCLUDE (r), CAST(r AS
    DOUBLE) AS revenue_usd, CAST(sum(r) OVER (PARTITION BY order_month) AS DOUBLE) AS month_revenue_usd, CAST(r AS DOUBLE) / CAST(nullif(sum(r) OVER
    (PARTITION BY order_month), 0) AS DOUBLE) AS revenue_share FROM g
    """,
)
_register(
    "regional_performance",
    lambda c: marts.regional_performance(c.orders_once, c.enriched, c.derived("c_regions")),
    """
    , s AS (SELECT region_code, order_month, count(*) FILTER (is_revenue) AS revenue_orders, sum(order_total_usd) FILTER (is_revenue) AS r,
    count(DISTINCT customer_id) FILTER (is_revenue) AS active_customers, count(*) FILTER (is_returned) AS returned_orders FROM fact_orders GROUP BY
    ALL), h AS (SELECT region_code, order_month, count(*) AS shipments, CAST(sum(CAST(delivery_days AS DECIMAL(18,2))) AS DOUBLE) /
    nullif(count(delivery_days), 0) AS avg_delivery_days, count(*) FILTER (delivered_on_time) / count(*) AS on_time_rate FROM enriched WHERE
    is_delivered GROUP BY ALL) SELECT region_code, order_month, revenue_orders, CAST(r AS DOUBLE) AS revenue_usd, active_customers, returned_orders,
    region_name, shipments, avg_delivery_days, on_time_rate, CASE WHEN revenue_orders > 0 THEN CAST(r AS DOUBLE) / revenue_orders END AS
    avg_order_value_usd FROM s JOIN (SELECT region_code, region_name FROM c_regions) USING (region_code) LEFT JOIN h USING (region_code, order_month)
    """,
)
_TURNOVER = """
, held AS (SELECT product_id, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units, CAST(sum(CAST(inventory_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS
inventory_value_usd, count(*) AS warehouses_stocked, count(*) FILTER (on_hand_units <= 0) AS warehouses_out_of_stock FROM position GROUP BY
product_id), sent AS (SELECT i.product_id, CAST(sum(-quantity_delta) AS BIGINT) AS u, CAST(sum(CAST(CAST(-quantity_delta AS DECIMAL(5,0)) *
p.unit_cost AS DECIMAL(18,2))) AS DOUBLE) AS c FROM inventory i JOIN c_products p USING (product_id), (SELECT max(event_date) AS as_of FROM
inventory) WHERE event_type = 'shipment' AND event_date > as_of - 90 GROUP BY i.product_id), turnover AS (SELECT h.*, p.product_name,
p.category_name, p.supplier_name, coalesce(u, 0) AS units_shipped_90d, coalesce(c, 0.0) AS cogs_90d, m.velocity_units_per_day AS v, CASE WHEN
m.velocity_units_per_day > 0 THEN h.on_hand_units / m.velocity_units_per_day END AS cover FROM held h JOIN products p USING (product_id) LEFT JOIN
sent USING (product_id) LEFT JOIN metrics m USING (product_id)) SELECT * EXCLUDE (v, cover), CASE WHEN inventory_value_usd > 0 THEN cogs_90d /
inventory_value_usd END AS turnover_ratio_90d, v AS velocity_units_per_day, round(cover, 1) AS days_of_cover, CASE WHEN v IS NOT NULL THEN coalesce(v
> 0 AND cover < 14, FALSE) END AS is_low_stock, CASE WHEN v IS NOT NULL THEN coalesce(v >= 1 AND cover < 14, FALSE) END AS high_velocity_low_stock
FROM turnover
"""
_register("inventory_turnover", lambda c: marts.inventory_turnover(c.inventory, c.position, c.dim_product, c.metrics), _TURNOVER)
_register(
    "warehouse_performance",
    lambda c: marts.warehouse_performance(c.derived("c_warehouses"), c.position, c.inventory, c.enriched),
    """
    , st AS (SELECT warehouse_id, count(*) AS skus_stocked, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units, CAST(sum(CAST(inventory_value_usd AS
    DECIMAL(18,2))) AS DOUBLE) AS inventory_value_usd, count(*) FILTER (on_hand_units <= 0) AS skus_out_of_stock FROM position GROUP BY 1), re AS
    (SELECT warehouse_id, CAST(sum(CASE WHEN event_type = 'shipment' THEN -quantity_delta ELSE 0 END) AS BIGINT) AS units_shipped_90d, CAST(sum(CASE
    WHEN event_type = 'receipt' THEN quantity_delta ELSE 0 END) AS BIGINT) AS units_received_90d, CAST(sum(CASE WHEN event_type = 'adjustment' THEN
    abs(quantity_delta) ELSE 0 END) AS BIGINT) AS units_adjusted_90d FROM inventory, (SELECT max(event_date) AS as_of FROM inventory) WHERE
    event_date > as_of - 90 GROUP BY 1), sh AS (SELECT warehouse_id, count(*) AS shipments, CAST(sum(CAST(delivery_days AS DECIMAL(18,2))) FILTER
    (is_delivered) AS DOUBLE) / nullif(count(delivery_days) FILTER (is_delivered), 0) AS avg_delivery_days, count(*) FILTER (had_exception) /
    count(*) AS exception_rate, count(*) FILTER (delivered_on_time AND is_delivered) / nullif(count(*) FILTER (is_delivered), 0) AS on_time_rate FROM
    enriched GROUP BY 1) SELECT *, CASE WHEN capacity_units > 0 THEN on_hand_units / capacity_units END AS capacity_utilisation, CASE WHEN
    units_shipped_90d > 0 THEN units_adjusted_90d / units_shipped_90d END AS shrinkage_rate_90d FROM c_warehouses LEFT JOIN st USING (warehouse_id)
    LEFT JOIN re USING (warehouse_id) LEFT JOIN sh USING (warehouse_id)
    """,
)
_SUPPLIERS = """
, sp AS (SELECT supplier_id, count(*) AS products_supplied FROM c_products GROUP BY 1), rc AS (SELECT supplier_id, count(*) AS receipts,
CAST(sum(quantity_delta) AS BIGINT) AS units_received, CAST(sum(coalesce(defective_qty, 0)) AS BIGINT) AS units_defective FROM inventory WHERE
event_type = 'receipt' GROUP BY 1), rt AS (SELECT supplier_id, CAST(sum(quantity) AS BIGINT) AS ret FROM fact_items WHERE is_returned GROUP BY 1), sa
AS (SELECT supplier_id, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_total_usd) AS DOUBLE) AS revenue_usd, CAST(sum(gross_margin_usd)
AS DOUBLE) AS gross_margin_usd FROM lines GROUP BY 1), scored AS (SELECT supplier_id, supplier_name, country_id, coalesce(products_supplied, 0) AS
products_supplied, coalesce(receipts, 0) AS receipts, coalesce(units_received, 0) AS units_received, coalesce(units_defective, 0) AS units_defective,
coalesce(units_sold, 0) AS units_sold, coalesce(revenue_usd, 0.0) AS revenue_usd, coalesce(gross_margin_usd, 0.0) AS gross_margin_usd, CASE WHEN
units_sold > 0 THEN ret / units_sold END AS return_rate, CASE WHEN units_received > 0 THEN units_defective / units_received END AS defect_rate,
coalesce(ret, 0) AS units_returned FROM c_suppliers LEFT JOIN sp USING (supplier_id) LEFT JOIN rc USING (supplier_id) LEFT JOIN rt USING
(supplier_id) LEFT JOIN sa USING (supplier_id)) SELECT *, rank() OVER (ORDER BY defect_rate DESC NULLS LAST) AS defect_rank FROM scored
"""
_supplier_mart = lambda c: marts.supplier_performance(c.derived("c_suppliers").select("supplier_id", "supplier_name", "country_id"), c.derived("c_products"), c.inventory, c.items_once, c.lines)
_register("supplier_performance", _supplier_mart, _SUPPLIERS)
_SHIPPING = """
SELECT region_code, region_name, carrier, order_month, count(*) AS shipments, count(*) FILTER (is_delivered) AS delivered, count(*) FILTER
(had_exception) AS exceptions, count(*) FILTER (is_returned) AS returned, CAST(sum(CAST(delivery_days AS DECIMAL(18,2))) FILTER (is_delivered) AS
DOUBLE) / nullif(count(delivery_days) FILTER (is_delivered), 0) AS avg_delivery_days, round(quantile_cont(delivery_days, 0.5) FILTER (is_delivered),
6) AS median_delivery_days, round(quantile_cont(delivery_days, 0.9) FILTER (is_delivered), 6) AS p90_delivery_days, count(*) FILTER
(delivered_on_time AND is_delivered) / nullif(count(*) FILTER (is_delivered), 0) AS on_time_rate, count(*) FILTER (had_exception) / count(*) AS
exception_rate, max(base_delivery_days) AS sla_days FROM enriched GROUP BY 1, 2, 3, 4
"""
_register("shipping_performance", lambda c: marts.shipping_performance(c.enriched), _SHIPPING)


def _workload(c: Commerce) -> DataFrame:
    items = c.text("c_items", order_id="order_id", product_id="product_id",
        quantity="CASE WHEN (order_id + line_number) % 97 = 0 THEN 'x' ELSE CAST(quantity AS STRING) END", unit_price="CAST(unit_price AS STRING)",
        discount_pct="CAST(discount_pct AS STRING)")
    orders = c.text("c_orders", order_id="order_id", order_date="CAST(order_ts AS STRING)")
    return marts.order_lines_workload(items, orders, c.text("c_products", product_id="product_id", unit_cost="CAST(unit_cost AS STRING)"))


_register(
    "bench_order_lines",
    _workload,
    """
    , l AS (SELECT *, (order_id + line_number) % 97 <> 0 AND quantity > 0 AND unit_price > 0 AND order_date IS NOT NULL AND unit_cost IS NOT NULL AS
    ok FROM c_items LEFT JOIN (SELECT order_id, order_date FROM c_orders) USING (order_id) LEFT JOIN (SELECT product_id, unit_cost FROM c_products)
    USING (product_id)), d AS (SELECT product_id, order_date, sum(line_total) FILTER (ok) AS r, sum(CAST(line_total - CAST(quantity AS DECIMAL(5,0))
    * unit_cost AS DECIMAL(14,2))) FILTER (ok) AS m, CAST(sum(quantity) FILTER (ok) AS BIGINT) AS units, count(*) FILTER (NOT ok) AS rejected FROM l
    GROUP BY 1, 2) SELECT product_id, order_date, CAST(r AS DOUBLE) AS revenue, CAST(m AS DOUBLE) AS margin, units, rejected, CAST(sum(r) OVER
    (PARTITION BY product_id ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_revenue FROM d
    """,
)

# ---- read queries

_LTV = _SQL["customer_ltv"]
_DAILY_TOTALS = "CAST(sum(revenue_usd) AS DOUBLE) AS revenue_usd, CAST(sum(orders_placed) AS BIGINT) AS orders_placed, CAST(sum(gross_margin_usd) AS DOUBLE) AS gross_margin_usd, CAST(sum(units_sold) AS BIGINT) AS units_sold"
_ltv = lambda c: marts.customer_ltv(c.dim_customer.select(*_LTV_CUSTOMER), c.orders_once)
_turnover = lambda c: marts.inventory_turnover(c.inventory, c.position, c.dim_product, c.metrics)
_register(
    "read_sales_range",
    lambda c: reads.sales_totals(c.daily, "1996-01-01", "1998-12-31"),
    f"SELECT {_DAILY_TOTALS} FROM daily WHERE sales_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
)
_register(
    "read_newest_days",
    lambda c: reads.sales(c.daily, limit=30).select("sales_date", "orders_placed", "revenue_usd"),
    """
    SELECT sales_date, orders_placed, CAST(revenue_usd AS DOUBLE) AS revenue_usd FROM daily ORDER BY sales_date DESC LIMIT 30
    """,
)
_register(
    "read_categories",
    lambda c: reads.categories(marts.category_revenue(c.lines)),
    """
    , g AS (SELECT parent_category_name, category_name, order_month, count(DISTINCT order_id) AS orders, sum(quantity) AS units_sold,
    sum(line_total_usd) AS revenue_usd, sum(gross_margin_usd) AS gross_margin_usd FROM lines GROUP BY ALL) SELECT parent_category_name,
    category_name, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(units_sold) AS BIGINT) AS units_sold, CAST(sum(revenue_usd) AS DOUBLE) AS
    revenue_usd, CAST(sum(gross_margin_usd) AS DOUBLE) AS gross_margin_usd FROM g GROUP BY 1, 2 ORDER BY revenue_usd DESC, 1, 2 LIMIT 20
    """,
)
_register(
    "top_products",
    lambda c: reads.products(c.metrics).select("product_id", "product_name", "revenue_usd", "units_sold", "revenue_rank"),
    """
    SELECT product_id, product_name, CAST(revenue_usd AS DOUBLE) AS revenue_usd, units_sold, revenue_rank FROM metrics ORDER BY metrics.revenue_usd
    DESC, product_id LIMIT 20
    """,
)
_register(
    "declining_products",
    lambda c: reads.products(c.metrics, declining=True, limit=50).select("product_id", "revenue_last_90d", "revenue_prior_90d", "revenue_trend_ratio"),
    """
    SELECT product_id, CAST(revenue_last_90d AS DOUBLE) AS revenue_last_90d, CAST(revenue_prior_90d AS DOUBLE) AS revenue_prior_90d,
    revenue_trend_ratio FROM metrics WHERE is_declining ORDER BY metrics.revenue_prior_90d DESC, product_id LIMIT 50
    """,
)
_register(
    "read_inventory",
    lambda c: reads.inventory_summary(_turnover(c)),
    _TURNOVER.replace("SELECT * EXCLUDE (v, cover),", ", t AS (SELECT * EXCLUDE (v, cover),").strip()
        + ") SELECT count(*) AS products, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units, CAST(sum(CAST(inventory_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS inventory_value_usd, count(*) FILTER (is_low_stock) AS low_stock, count(*) FILTER (high_velocity_low_stock) AS high_velocity_low_stock FROM t",
        
)
_register(
    "read_customers",
    lambda c: reads.customers_by(_ltv(c), "lifecycle_stage"),
    "SELECT lifecycle_stage, count(*) AS customers, CAST(sum(CAST(net_lifetime_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS net_lifetime_value_usd FROM (" + _LTV + ") GROUP BY 1",
    tables=False,
)
_register(
    "read_customer_segments",
    lambda c: reads.customer_segments(_ltv(c)),
    "SELECT customer_segment, count(*) AS customers, round(CAST(sum(CAST(net_lifetime_value_usd AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_net_value_usd FROM (" + _LTV + ") GROUP BY 1",
    tables=False,
)
_register(
    "read_top_customers",
    lambda c: reads.customers_top(_ltv(c)).select("customer_id", "net_lifetime_value_usd", "value_decile"),
    "SELECT customer_id, net_lifetime_value_usd, value_decile FROM (" + _LTV + ") ORDER BY 2 DESC, 1 LIMIT 20",
    tables=False,
)
_register(
    "read_suppliers",
    lambda c: reads.suppliers_by_defects(_supplier_mart(c)).select("supplier_id", "defect_rate", "defect_rank"),
    "SELECT supplier_id, defect_rate, defect_rank FROM (" + _SQL["supplier_performance"] + ") ORDER BY defect_rate DESC NULLS LAST, supplier_id LIMIT 20",
    tables=False,
)
_register(
    "shipping_weighted",
    lambda c: reads.shipping_by(marts.shipping_performance(c.enriched), "carrier"),
    "SELECT carrier, CAST(sum(shipments) AS BIGINT) AS shipments, CAST(sum(delivered) AS BIGINT) AS delivered, "
        + f"{_weighted('avg_delivery_days', 'delivered')} AS avg_delivery_days, {_weighted('exception_rate', 'shipments')} AS exception_rate, max(sla_days) AS sla_days FROM ("
        + _SQL["shipping_performance"] + ") GROUP BY carrier",
    tables=False,
)
_register(
    "rolling_7d",
    lambda c: reads.rolling_revenue(c.daily),
    """
    SELECT sales_date, CAST(revenue_usd AS DOUBLE) AS revenue_usd, CASE WHEN count(*) OVER w = 7 THEN CAST(sum(revenue_usd) OVER w AS DOUBLE) / 7 END
    AS rolling_7d_usd FROM daily WINDOW w AS (ORDER BY sales_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    """,
)

# ---- column functions

_RAW_NAME = "CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 11 = 0 THEN '   ' ELSE c_name END AS raw"
_register(
    "normalize_text",
    lambda c: c.source("customer").selectExpr("c_custkey", _RAW_NAME).select("c_custkey", fn.norm(F.col("raw")).alias("n"),
        fn.lower(F.col("raw")).alias("l"), fn.upper(F.col("raw")).alias("u")),
    f"SELECT c_custkey, nullif(trim(raw), '') AS n, lower(nullif(trim(raw), '')) AS l, upper(nullif(trim(raw), '')) AS u FROM (SELECT c_custkey, {_RAW_NAME} FROM customer)",
    tables=False,
)
_CASTS = ["o_orderkey",
    "CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey AS STRING) || '.0' ELSE CAST(o_orderkey AS STRING) END AS n",
    "CASE o_orderkey % 4 WHEN 0 THEN '2023-02-30' WHEN 1 THEN 'N/A' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS d",
    "CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'x' WHEN 3 THEN ' T ' ELSE 'false' END AS b"]
_register(
    "safe_casts",
    lambda c: c.source("orders").selectExpr(*_CASTS).select("o_orderkey", fn.num(F.col("n")).alias("as_num"), fn.integer(F.col("n")).alias("as_int"),
        fn.date(F.col("d")).alias("as_date"), fn.boolean(F.col("b")).alias("as_bool"), F.date_format(fn.ts(F.concat(F.col("d"),
        F.lit("T10:00:00Z"))), "yyyy-MM-dd HH").alias("as_ts")),
    f"SELECT o_orderkey, TRY_CAST(n AS DOUBLE) AS as_num, CASE WHEN regexp_full_match(n, '-?[0-9]+') THEN TRY_CAST(n AS BIGINT) END AS as_int, TRY_CAST(d AS DATE) AS as_date, CASE WHEN lower(trim(b)) IN ('true', '1', 'yes', 't') THEN TRUE WHEN lower(trim(b)) IN ('false', '0', 'no', 'f') THEN FALSE END AS as_bool, strftime(TRY_CAST(d AS DATE), '%Y-%m-%d') || ' 10' AS as_ts FROM (SELECT {', '.join(_CASTS)} FROM orders)",
        
    tables=False,
)
_ALIASES = {"FR": ("france",), "DE": ("germany",), "US": ("united states", "usa")}
_register(
    "alias_map",
    lambda c: c.source("nation").select("n_nationkey", "n_name", fn.alias_code(F.concat(F.lit(" "), "n_name"), _ALIASES).alias("code")),
    """
    SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE lower(trim(n_name)) WHEN 'france' THEN 'FR' WHEN 'fr' THEN 'FR' WHEN 'germany'
    THEN 'DE' WHEN 'de' THEN 'DE' WHEN 'united states' THEN 'US' WHEN 'usa' THEN 'US' WHEN 'us' THEN 'US' END AS code FROM nation
    """,
    tables=False,
)
_BAD_JSON = "CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 4) ELSE props END AS props"
_register(
    "json_flatten",
    lambda c: c.source("events").selectExpr("event_id", _BAD_JSON).select("event_id", fn.parse_json(F.col("props"), "k bigint")["k"].alias("k")),
    f"SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM (SELECT event_id, {_BAD_JSON} FROM events)",
    tables=False,
)
_register(
    "surrogate_key_props",
    lambda c: c.source("customer").select(fn.surrogate_key(F.col("c_custkey")).alias("k"), "c_custkey").agg(F.countDistinct("k").alias("keys"),
        F.countDistinct("c_custkey").alias("ids")),
    "SELECT count(DISTINCT c_custkey) AS keys, count(DISTINCT c_custkey) AS ids FROM customer",
    tables=False,
)
_register(
    "line_total_recompute",
    lambda c: c.derived("c_items").withColumn("given", (F.col("line_total") + F.when(F.col("order_id") % 9 == 0,
        F.lit("7.77").cast("decimal(14,2)")).otherwise(F.lit("0.01").cast("decimal(14,2)"))).cast("decimal(14,2)")).select("order_id", "line_number",
        "given", fn.recompute(F.col("given"), F.col("line_total")).alias("line_total")),
    """
    SELECT order_id, CAST(line_number AS BIGINT) AS line_number, CAST(line_total + CASE WHEN order_id % 9 = 0 THEN 7.77 ELSE 0.01 END AS DOUBLE) AS
    given, CAST(CASE WHEN order_id % 9 = 0 THEN line_total ELSE line_total + 0.01 END AS DOUBLE) AS line_total FROM c_items
    """,
)

# ---- duplicates, windows

_LINES2 = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 5 = 0"
_register(
    "exact_dedup",
    lambda c: dedup.drop_exact_duplicates(c.source("lineitem").unionByName(c.source("lineitem").where("l_orderkey % 5 = 0")), c.source("lineitem").columns, ["l_orderkey"]),
    f"SELECT DISTINCT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM ({_LINES2})",
    tables=False,
)
_register(
    "keep_latest",
    lambda c: dedup.keep_latest(c.source("lineitem"), LINE_KEYS, LINE_VERSION).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"),
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity FROM latest_lines
    """,
)
_register(
    "customer_sequence",
    lambda c: prefix.sequence_in_group(c.derived("c_orders"), ["customer_id"], ["order_ts", "order_id"], "seq", "order_date").select("order_id", "seq", "days_since_prev_seq"),
    """
    SELECT order_id, row_number() OVER w AS seq, CAST(order_date - lag(order_date) OVER w AS BIGINT) AS days_since_prev_seq FROM c_orders WINDOW w AS
    (PARTITION BY customer_id ORDER BY order_ts, order_id)
    """,
)
_register(
    "running_balance",
    lambda c: prefix.running_sum(c.derived("c_stock_events"), ["product_id"], ["event_ts", "event_id"], "quantity_delta", "balance").select("event_id", "balance"),
    """
    SELECT event_id, CAST(sum(quantity_delta) OVER (PARTITION BY product_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS
    balance FROM c_stock_events
    """,
)

# ---- rules

_MESSY = ["o_orderkey", "o_custkey",
    "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 'ORD-' || lpad(CAST(o_orderkey AS STRING), 7, '0') END AS order_id",
    "CASE WHEN o_orderkey % 30 = 1 THEN 'unknown' ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 50 = 2 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS total",
    "CASE WHEN o_orderkey % 70 = 3 THEN -1.0 ELSE o_totalprice END AS amount",
    "CASE WHEN o_orderkey % 40 = 4 THEN o_custkey + 1000000 ELSE o_custkey END AS customer_id", "o_orderdate AS ts",
    "CAST('2001-01-01' AS TIMESTAMP_NTZ) AS now"]
_SUITE = rules.Suite("orders", (
    rules.Rule("id_present", "not_null", "reject", "order_id"), rules.Rule("id_format", "regex", "reject", "order_id", {"pattern": r"^ORD-\d{7}$"}),
        rules.Rule("status_allowed", "in_set", "reject", "status", {"values": ["F", "O", "P"]}),
    rules.Rule("total_castable", "castable", "reject", "total", {"typed": "total_t"}), rules.Rule("amount_positive", "compare", "reject", "amount",
        {"op": ">", "value": 0}), rules.Rule("customer_known", "fk", "reject", "customer_id", {"ref": "customers", "ref_column": "c_custkey"}),
    rules.Rule("not_future", "not_future", "warn", "ts", {"reference": "now"}), rules.Rule("total_is_key", "compare_cols", "warn", None,
        {"left": "total_t", "op": "==", "right": "o_orderkey"}), rules.Rule("amount_bounded", "expr", "warn", None,
        {"expression": "amount < 400000"}),
), 0.05)


def _evaluated(c: Commerce) -> DataFrame:
    rows = c.source("orders").selectExpr(*_MESSY).withColumn("total_t", fn.integer(F.col("total")))
    return rules.evaluate(rows, _SUITE, {"customers": c.source("customer")})


_EVAL = "WITH m AS (SELECT " + ", ".join(_MESSY).replace("TIMESTAMP_NTZ",
    "TIMESTAMP") + """, CASE WHEN o_orderkey % 50 = 2 THEN NULL ELSE o_orderkey END AS total_t FROM orders), e AS (SELECT m.*, [x for x in [CASE WHEN order_id IS NULL THEN 'id_present' END, CASE WHEN status = 'unknown' THEN 'status_allowed' END, CASE WHEN total_t IS NULL THEN 'total_castable' END,
  CASE WHEN amount <= 0 THEN 'amount_positive' END, CASE WHEN c_custkey IS NULL THEN 'customer_known' END] if x IS NOT NULL] AS rule_ids, [x for x in [CASE WHEN ts > now THEN 'not_future' END, CASE WHEN total_t <> o_orderkey THEN 'total_is_key' END, CASE WHEN amount >= 400000 THEN 'amount_bounded' END] if x IS NOT NULL] AS quality_warnings
  FROM m LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) ON c_custkey = customer_id) """
_IDS = "(VALUES ('id_present','reject'),('id_format','reject'),('status_allowed','reject'),('total_castable','reject'),('amount_positive','reject'),('customer_known','reject'),('not_future','warn'),('total_is_key','warn'),('amount_bounded','warn')) v(rule_id, severity)"
_register(
    "rules_stats",
    lambda c: rules.statistics(_evaluated(c), _SUITE),
    _EVAL
        + f"SELECT rule_id, severity, count(*) FILTER (list_contains(rule_ids, rule_id) OR list_contains(quality_warnings, rule_id)) AS failed, count(*) AS total FROM e CROSS JOIN {_IDS} GROUP BY 1, 2",
        
    tables=False,
)
_register(
    "rules_valid",
    lambda c: rules.valid(_evaluated(c)).select("o_orderkey", F.array_join("quality_warnings", ",").alias("warnings")),
    _EVAL + "SELECT o_orderkey, array_to_string(quality_warnings, ',') AS warnings FROM e WHERE len(rule_ids) = 0",
    tables=False,
)
_register(
    "rules_rejected",
    lambda c: rules.rejected(_evaluated(c)).select("o_orderkey", F.array_join("rule_ids", ",").alias("rules")),
    _EVAL + "SELECT o_orderkey, array_to_string(rule_ids, ',') AS rules FROM e WHERE len(rule_ids) > 0",
    tables=False,
)
_register(
    "rules_warnings",
    lambda c: rules.valid(_evaluated(c)).select(F.explode("quality_warnings").alias("rule_id")).groupBy("rule_id").count().withColumnRenamed("count", "rows"),
    _EVAL + "SELECT rule_id, count(*) AS rows FROM (SELECT unnest(quality_warnings) AS rule_id FROM e WHERE len(rule_ids) = 0) GROUP BY 1",
    tables=False,
)
_register(
    "circuit_breaker",
    lambda c: rules.reject_rate(_evaluated(c), _SUITE),
    _EVAL
        + "SELECT count(*) AS total, count(*) FILTER (len(rule_ids) > 0) AS rejected, count(*) FILTER (len(rule_ids) > 0) / count(*) AS rate, count(*) FILTER (len(rule_ids) > 0) / count(*) > 0.05 AS tripped FROM e",
        
    tables=False,
)
_register(
    "rule_passes",
    lambda c: rules.rule_passes(rules.statistics(_evaluated(c), _SUITE), _SUITE).select("rule_id", "passed"),
    _EVAL
        + f"SELECT rule_id, count(*) FILTER (list_contains(rule_ids, rule_id) OR list_contains(quality_warnings, rule_id)) <= count(*) * 0.05 AS passed FROM e CROSS JOIN {_IDS} GROUP BY 1",
        
    tables=False,
)
_register(
    "fk_orphans",
    lambda c: rules.rejected(_evaluated(c)).where(F.array_contains("rule_ids", "customer_known")).select("o_orderkey", "customer_id"),
    _EVAL + "SELECT o_orderkey, customer_id FROM e WHERE list_contains(rule_ids, 'customer_known')",
    tables=False,
)
_register(
    "cascade_reject",
    lambda c: c.source("lineitem").join(rules.valid(_evaluated(c)).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey",
        "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")),
    _EVAL + "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM e WHERE len(rule_ids) = 0) GROUP BY 1",
    tables=False,
)


def _quarantined(c: Commerce) -> DataFrame:
    path = scratch(c.spark, "quarantine")
    rules.write_quarantine(rules.quarantine_records(_evaluated(c), ["o_orderkey", "status", "total"], "orders", "feed", "b1", "silver", "r1"), path)
    return rules.quarantine_counts(rules.read_quarantine(c.spark, path, "orders", "b1"))


_register(
    "quarantine_per_rule",
    _quarantined,
    _EVAL + "SELECT rule_id, count(*) AS records FROM (SELECT unnest(rule_ids) AS rule_id FROM e) GROUP BY 1",
    tables=False,
)

# ---- checks

_register(
    "uniqueness",
    lambda c: rules.check_unique(c.source("lineitem"), "lineitem", *LINE_KEYS),
    """
    SELECT 'unique_lineitem' AS check_name, count(*) AS total, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS failed FROM lineitem
    """,
    tables=False,
)
_register(
    "ri",
    lambda c: rules.check_reference(_evaluated(c), "orders_customer", "customer_id", c.source("customer"), "c_custkey"),
    _EVAL + "SELECT 'reference_orders_customer' AS check_name, count(*) AS total, count(*) FILTER (customer_id NOT IN (SELECT c_custkey FROM customer)) AS failed FROM e",
    tables=False,
)
_register(
    "range",
    lambda c: rules.check_predicates(c.source("lineitem"), {"quantity": "l_quantity BETWEEN 1 AND 45", "discount": "l_discount <= 0.08"}),
    """
    SELECT 'range_quantity' AS check_name, count(*) AS total, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45) AS failed FROM lineitem UNION ALL
    SELECT 'range_discount', count(*), count(*) FILTER (l_discount > 0.08) FROM lineitem
    """,
    tables=False,
)
_register(
    "null_rate",
    lambda c: rules.check_null_rates(_evaluated(c), ["order_id", "total_t"]),
    _EVAL
        + "SELECT 'nulls_order_id' AS check_name, count(*) AS total, count(*) FILTER (order_id IS NULL) AS failed FROM e UNION ALL SELECT 'nulls_total_t', count(*), count(*) FILTER (total_t IS NULL) FROM e",
        
    tables=False,
)
_register(
    "freshness",
    lambda c: rules.check_freshness(c.derived("c_orders"), "orders", "order_date", F.lit("2001-07-30").cast("date")),
    """
    SELECT 'fresh_orders' AS check_name, CAST(1 AS BIGINT) AS total, CAST(max(order_date) < DATE '2001-07-30' AS BIGINT) AS failed FROM c_orders
    """,
)


def _checks(c: Commerce) -> DataFrame:
    parts = [rules.check_unique(c.source("orders"), "orders", "o_orderkey"), rules.check_unique(c.source("lineitem"), "lineitem", *LINE_KEYS),
        rules.check_predicates(c.source("orders"), {"price": "o_totalprice < 300000"})]
    return rules.summarize(parts[0].unionByName(parts[1]).unionByName(parts[2]), {"range_price": 0.9}, {"unique_lineitem": "warn"})


_CHECKS = """
SELECT check_name, total, failed, round(failed / total, 6) AS failure_rate, CASE check_name WHEN 'range_price' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END
AS threshold, CASE check_name WHEN 'unique_lineitem' THEN 'warn' ELSE 'error' END AS severity, round(failed / total, 6) <= CASE check_name WHEN
'range_price' THEN 0.9 ELSE 0.0 END AS passed FROM (SELECT 'unique_orders' AS check_name, count(*) AS total, count(*) - count(DISTINCT o_orderkey) AS
failed FROM orders UNION ALL SELECT 'unique_lineitem', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT
'range_price', count(*), count(*) FILTER (NOT o_totalprice < 300000) FROM orders)
"""
_register("check_summary", _checks, _CHECKS, tables=False)
_register(
    "check_status",
    lambda c: rules.overall_status(_checks(c)),
    f"SELECT CASE WHEN bool_or(NOT passed AND severity = 'error') THEN 'fail' WHEN bool_or(NOT passed AND severity = 'warn') THEN 'warn' ELSE 'pass' END AS status, count(*) AS checks, count(*) FILTER (passed) AS passed FROM ({_CHECKS})",
        
    tables=False,
)
_register(
    "assert_reconciled",
    lambda c: c.fact_orders.agg(F.count_if(F.col("is_revenue") & ~F.col("lines_reconciled")).alias("unreconciled"), F.count_if("is_revenue").alias("revenue_orders")),
    """
    SELECT count(*) FILTER (is_revenue AND NOT lines_reconciled) AS unreconciled, count(*) FILTER (is_revenue) AS revenue_orders FROM fact_orders
    """,
)

# ---- merges


def _split_orders(c: Commerce) -> tuple[DataFrame, DataFrame]:
    """A first delivery, and a second one that updates every seventh order, moves some to another month and brings new ones."""
    o = c.derived("c_orders").select("order_id", "order_date", "order_month", "status", F.lit(1).alias("version"))
    first = o.where("order_id % 10 <> 3")
    second = o.where("order_id % 10 = 3 OR order_id % 7 = 0").withColumns({"status": F.lit("updated"), "version": F.lit(2),
        "order_month": F.when(F.col("order_id") % 14 == 0, "2002-01").otherwise(F.col("order_month"))})
    return first, second


_MERGED = """
SELECT order_id, order_date, CASE WHEN order_id % 14 = 0 AND (order_id % 10 = 3 OR order_id % 7 = 0) THEN '2002-01' ELSE order_month END AS
order_month, CASE WHEN order_id % 10 = 3 OR order_id % 7 = 0 THEN 'updated' ELSE status END AS status, CAST(CASE WHEN order_id % 10 = 3 OR order_id %
7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM c_orders
"""


def _snapshot(c: Commerce) -> DataFrame:
    path = scratch(c.spark, "snapshot")
    for part in _split_orders(c):
        merge.merge_snapshot(part, path, ["order_id"], ["version"])
    return publish.read(c.spark, path)


def _partitioned(c: Commerce) -> DataFrame:
    path = scratch(c.spark, "partitioned")
    for part in _split_orders(c):
        merge.merge_partitioned(part, path, ["order_id"], ["version"], "order_month")
    return publish.read(c.spark, path)


def _upserted(c: Commerce) -> DataFrame:
    first, second = _split_orders(c)
    return merge.upsert(first, second.withColumn("extra", F.lit(1)), ["order_id"])


_register("merge_snapshot", _snapshot, _MERGED)
_register("merge_partitioned", _partitioned, _MERGED)
_register("upsert_rows", lambda c: _upserted(c).drop("_action"), _MERGED)
_register(
    "upsert_counts",
    lambda c: merge.upsert_counts(_upserted(c)),
    """
    SELECT count(*) AS read, count(*) FILTER (order_id % 10 = 3) AS inserted, count(*) FILTER (order_id % 10 <> 3) AS updated FROM c_orders WHERE
    order_id % 10 = 3 OR order_id % 7 = 0
    """,
)


def _lookback(c: Commerce) -> DataFrame:
    per_day = lambda rows: rows.groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"), F.sum("order_total").alias("total"))
    orders = c.derived("c_orders")
    loaded = per_day(orders.where("order_date < DATE '1998-01-01' AND order_id % 3 <> 0"))
    recent = per_day(merge.since_lookback(orders, "order_date", loaded, "order_date", 7))
    return merge.replace_recent(loaded, recent, "order_date")


_register(
    "lookback_upsert",
    _lookback,
    """
    , newest AS (SELECT max(order_date) - 7 AS d FROM c_orders WHERE order_date < DATE '1998-01-01' AND order_id % 3 <> 0) SELECT order_date,
    count(*) AS orders, CAST(sum(order_total) AS DOUBLE) AS total FROM c_orders, newest WHERE order_date >= d OR (order_date < d AND order_id % 3 <>
    0) GROUP BY order_date
    """,
)
_register(
    "incremental_scope",
    lambda c: merge.months_from(c.derived("c_orders"), c.derived("c_orders").where("order_date >= DATE '2001-06-01' AND order_id % 97 = 0"), ["customer_id"], "order_month"),
    """
    , t AS (SELECT customer_id, min(order_month) AS m FROM c_orders WHERE order_date >= DATE '2001-06-01' AND order_id % 97 = 0 GROUP BY 1) SELECT
    DISTINCT order_month FROM c_orders JOIN t USING (customer_id) WHERE order_month >= m
    """,
)


_LATE = "order_date >= DATE '2001-03-01' AND order_id % 97 = 0"


def _incremental(c: Commerce) -> DataFrame:
    """Orders built without some late rows, then the months that these touch rebuilt: must equal a full build, row by row."""
    orders = c.derived("c_orders")
    build = lambda rows, months=None: star.fact_orders(rows, c.derived("c_items"), c.derived("c_payments"), c.rates, months)
    late = orders.where(_LATE)
    months = star.touched_months([r[0] for r in merge.months_from(orders, late, ["customer_id"], "order_month").collect()], [r[0]
        for r in late.select("order_month").distinct().collect()])  # one row a month
    untouched = build(orders.where(f"NOT ({_LATE})")).where(~F.col("order_month").isin(*months))
    rows = untouched.unionByName(build(orders, months))
    return rows.select("order_id", "order_month", "customer_order_seq", "days_since_prev_order", "order_total_usd", "item_count")


_register(
    "incremental_equals_full",
    _incremental,
    """
    SELECT order_id, order_month, CAST(customer_order_seq AS BIGINT) AS customer_order_seq, CAST(days_since_prev_order AS BIGINT) AS
    days_since_prev_order, CAST(order_total_usd AS DOUBLE) AS order_total_usd, CAST(item_count AS BIGINT) AS item_count FROM fact_orders
    """,
)
_register(
    "shipped_order_months",
    lambda c: star.shipped_months(c.derived("c_tracker"), c.derived("c_orders")),
    """
    SELECT DISTINCT event_month, order_month FROM c_tracker JOIN (SELECT order_id, order_month FROM c_orders) USING (order_id) WHERE order_month IS NOT NULL
    """,
)


def _scope(c: Commerce) -> DataFrame:
    """Months of orders to rebuild after late orders, lines and payments, and those of shipments after tracker events."""
    months = lambda rows: [r[0] for r in rows.select("order_month").distinct().collect()]  # noqa: E731  one row a month
    orders = c.derived("c_orders")
    late = months(orders.where(_LATE))
    paid = months(orders.where("order_id % 4999 = 7"))
    shipped = [r[0] for r in star.shipped_order_months(c.derived("c_tracker"), orders, None).collect()]
    rows = [("orders", m) for m in star.touched_months(late, None, paid) or []] + [("shipments", m) for m in star.touched_months(late, shipped) or []]
    return c.spark.createDataFrame(rows, "fact string, order_month string")


_register(
    "gold_scope",
    _scope,
    f"SELECT DISTINCT 'orders' AS fact, order_month FROM c_orders WHERE ({_LATE}) OR order_id % 4999 = 7 UNION SELECT DISTINCT 'shipments', order_month FROM c_orders WHERE ({_LATE}) OR order_id IN (SELECT order_id FROM c_tracker)",
        
)

# ---- sources and landing


def _as_text(c: Commerce, name: str, *columns: str) -> DataFrame:
    return c.source(name).select(*[F.col(x).cast("string").alias(x) for x in columns])


def _land_csv(c: Commerce) -> DataFrame:
    raw, bronze = scratch(c.spark, "csv"), scratch(c.spark, "bronze")
    _as_text(c, "customer", "c_custkey", "c_name", "c_mktsegment").repartition(3).write.option("header", True).csv(raw)
    rows = readers.read_csv(c.spark, raw, columns=["c_custkey", "c_name", "c_mktsegment"], multiline=False)
    landing.land(rows, landing.Contract("customers", ("c_custkey", "c_name"), ("c_mktsegment",)), bronze, "2025-11-30", None, "r1")
    return readers.read_bronze(c.spark, bronze, ["2025-11-30"], ["c_custkey", "c_name", "c_mktsegment", "phone"]).select("c_custkey", "c_name",
        "c_mktsegment", "phone", F.col("_batch_id").cast("string").alias("_batch_id"))


_register(
    "land_csv",
    _land_csv,
    """
    SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name, c_mktsegment, CAST(NULL AS STRING) AS phone, '2025-11-30' AS _batch_id FROM customer
    """,
    tables=False,
)


def _json_document(c: Commerce) -> DataFrame:
    path = scratch(c.spark, "json")
    _as_text(c, "nation", "n_nationkey", "n_name").agg(F.to_json(F.struct(F.lit("x").alias("feed"), F.collect_list(F.struct("n_nationkey",
        "n_name")).alias("data"))).alias("value")).write.text(path)
    return readers.good(readers.read_json_document(c.spark, path, "data"), ["n_nationkey", "n_name"]).select("n_nationkey", "n_name")


_register("land_json_document", _json_document, "SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name FROM nation", tables=False)
_NDJSON = "CASE WHEN event_id % 9 = 0 THEN '<<<restart>>>' WHEN event_id % 10 = 0 THEN substr(props, 1, 4) ELSE props END AS value"
_register(
    "ndjson_rejects",
    lambda c: readers.rejects(readers.parse_ndjson(c.source("events").selectExpr("event_id", _NDJSON))).select("event_id", "raw"),
    f"SELECT event_id, value AS raw FROM (SELECT event_id, {_NDJSON} FROM events) WHERE NOT json_valid(value)",
    tables=False,
)
_register(
    "ndjson_rows",
    lambda c: readers.good(readers.parse_ndjson(c.source("events").selectExpr("event_id", _NDJSON)), ["k", "missing"]),
    f"SELECT json_extract_string(value, '$.k') AS k, CAST(NULL AS STRING) AS missing, event_id FROM (SELECT event_id, {_NDJSON} FROM events) WHERE json_valid(value)",
    tables=False,
)
_LOG = "CASE WHEN event_id % 11 = 0 THEN '# note' WHEN event_id % 13 = 0 THEN 'tracker restarted' ELSE '2025-01-01T00:00:00Z INFO [tracker] event=' || event_type || ' shipment_id=S' || CAST(user_id AS STRING) || ' carrier=\"North ' || CAST(user_id AS STRING) || '\" shipment_id=T' || CAST(user_id AS STRING) END AS value"
_register(
    "log_parse",
    lambda c: readers.good(readers.parse_log(c.source("events").selectExpr("event_id", _LOG)), ["event_ts", "level", "event", "shipment_id", "carrier", "location"]),
    f"SELECT '2025-01-01T00:00:00Z' AS event_ts, 'INFO' AS level, event_type AS event, 'T' || CAST(user_id AS STRING) AS shipment_id, 'North ' || CAST(user_id AS STRING) AS carrier, CAST(NULL AS STRING) AS location, event_id FROM (SELECT *, {_LOG} FROM events) WHERE event_id % 11 <> 0 AND event_id % 13 <> 0",
        
    tables=False,
)
_register(
    "log_rejects",
    lambda c: readers.rejects(readers.parse_log(c.source("events").selectExpr("event_id", _LOG))).select("event_id", "raw"),
    """
    SELECT event_id, 'tracker restarted' AS raw FROM events WHERE event_id % 11 <> 0 AND event_id % 13 = 0
    """,
    tables=False,
)


def _ledger_skip(c: Commerce) -> DataFrame:
    """A file for each kind of event in two deliveries; the second one repeats all but clicks, which have grown: what is new then."""
    path = scratch(c.spark, "feed")
    rows = c.source("events").select("event_type", F.concat_ws(",", "event_id", "user_id", "event_type").alias("value"),
        (F.col("event_type") == "click").alias("grows"), "event_id")

    def deliver(name: str, part: DataFrame) -> DataFrame:
        part.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(f"{path}/{name}")
        return landing.content_hashes(c.spark, f"{path}/{name}")

    first = landing.not_yet_landed(deliver("a", rows.where("NOT grows OR event_id % 2 = 0")), c.spark.createDataFrame([], landing.LEDGER), "events")
    ledger = landing.ledger_entries(first, "events", 5, 0, "r1")
    again = deliver("b", rows)
    kind = F.regexp_extract("source_file", "event_type=([a-z]+)", 1).alias("event_type")
    new = landing.not_yet_landed(again, ledger, "events").select(kind, F.lit(True).alias("is_new"))
    forced = landing.not_yet_landed(again, ledger, "events", force=True).select(kind)
    return forced.join(new, "event_type", "left").select("event_type", F.coalesce("is_new", F.lit(False)).alias("is_new"))


_register("ledger_skip", _ledger_skip, "SELECT DISTINCT event_type, event_type = 'click' AS is_new FROM events", tables=False)
_register(
    "watermarks",
    lambda c: landing.watermark(c.derived("c_orders"), "orders", "b1", "order_ts").unionByName(landing.watermark(c.derived("c_stock_events"), "events", "b1", "event_ts")),
    """
    SELECT 'orders' AS dataset, 'b1' AS last_batch_id, max(order_ts) AS high_watermark FROM c_orders UNION ALL SELECT 'events', 'b1', max(event_ts)
    FROM c_stock_events
    """,
)
_CONTRACT = landing.Contract("events", ("event_id", "view", "purchase", "refund"), ("click", "region"))
_KEYED_LINES = "to_json(map('event_id', CAST(event_id AS STRING), event_type, CAST(value AS STRING))) AS value"


def _event_drift(c: Commerce) -> DataFrame:
    """Drift of a delivery whose columns are the keys that any of its lines has: each line brings the key of its own kind of event."""
    parsed = readers.parse_ndjson(c.source("events").selectExpr(_KEYED_LINES))
    return landing.drift(c.spark, _CONTRACT, readers.key_union(parsed))


_DRIFT = """
SELECT 'events' AS dataset, "column", change, severity FROM ( SELECT c AS "column", 'missing_required' AS change, 'ERROR' AS severity FROM (VALUES
('view'), ('purchase'), ('refund')) v(c) WHERE c NOT IN (SELECT event_type FROM events) UNION ALL SELECT c, 'missing_optional', 'WARN' FROM (VALUES
('click'), ('region')) v(c) WHERE c NOT IN (SELECT event_type FROM events) UNION ALL SELECT DISTINCT event_type, 'new_column', 'INFO' FROM events
WHERE event_type NOT IN ('view', 'purchase', 'refund', 'click', 'region'))
"""
_register("schema_drift", _event_drift, _DRIFT, tables=False)
_register(
    "drift_gate",
    lambda c: landing.drift_gate(_event_drift(c)).withColumn("new_columns", F.array_join("new_columns", ",")),
    f"SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings, count(*) FILTER (severity = 'INFO') AS infos, string_agg('events.' || \"column\", ',' ORDER BY \"column\") FILTER (change = 'new_column') AS new_columns, count(*) FILTER (severity = 'ERROR') = 0 AS passed FROM ({_DRIFT})",
        
    tables=False,
)


def _drift_runs(c: Commerce) -> DataFrame:
    """Drift events of two runs, appended as telemetry and read back."""
    path = scratch(c.spark, "drift")
    events = _event_drift(c)
    landing.append_telemetry(events.where("severity <> 'INFO'").withColumn("detected_at", F.lit("2026-01-01")), path, "r1")
    landing.append_telemetry(events.withColumn("detected_at", F.lit("2026-01-02")), path, "r2")
    return c.spark.read.parquet(path)


_register(
    "read_drift_of_run",
    lambda c: reads.drift_of_run(_drift_runs(c), "r2"),
    f"SELECT dataset, change, \"column\", severity FROM ({_DRIFT})",
    tables=False,
)
_register(
    "read_newest_drift",
    lambda c: reads.newest_drift(_drift_runs(c)).select("dataset", "column", "severity", "run_id"),
    f"SELECT dataset, \"column\", severity, run_id FROM (SELECT *, 'r2' AS run_id FROM ({_DRIFT}) UNION ALL SELECT *, 'r1' FROM ({_DRIFT}) WHERE severity <> 'INFO') ORDER BY run_id DESC, \"column\" LIMIT 20",
        
    tables=False,
)


def _marks(c: Commerce) -> DataFrame:
    """Stored marks of two batches, and a rerun of the first that moves nothing back."""
    early = c.derived("c_orders").where("order_date < DATE '1999-01-01'")
    first = landing.watermark(early, "orders", "2025-11-30", "order_ts").unionByName(landing.watermark(c.derived("c_stock_events"), "events", "2025-11-30", "event_ts"))
    second = landing.watermark(c.derived("c_orders"), "orders", "2025-12-31", "order_ts")
    return landing.advance(landing.advance(first, second), first)


_register(
    "watermarks_advanced",
    _marks,
    """
    SELECT 'orders' AS dataset, '2025-12-31' AS last_batch_id, max(order_ts) AS high_watermark FROM c_orders UNION ALL SELECT 'events', '2025-11-30',
    max(event_ts) FROM c_stock_events
    """,
)


def _reference_rates(c: Commerce) -> DataFrame:
    """Rates as response documents, one for each year, one of them sent twice: landed once, days that lack a date take that of the document."""
    path = scratch(c.spark, "rates")
    rate = F.struct(F.when(F.dayofmonth("day") > 1, F.col("day").cast("string")).alias("rate_date"), F.col("currency").alias("currency_code"),
        F.col("usd_per_unit").cast("string").alias("usd_per_unit"))
    years = c.given_rates.groupBy(F.year("day").alias("y")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(rate)).alias("data"))).alias("value"))
    name = F.concat(F.lit("rates-"), F.col("y").cast("string"))
    twice = years.select(F.explode(F.array(name, F.concat(name, F.lit("-again")))).alias("source_file"), "value")
    landing.land_documents(twice, silver.CONTRACTS["exchange_rates"], path, "b1", "2026-01-01", "r1", c.spark.createDataFrame([], landing.LEDGER))
    return readers.read_bronze(c.spark, path, ["b1"], []).groupBy("rate_date", "currency_code").agg(F.count(F.lit(1)).alias("rows"))


_register(
    "land_reference_documents",
    _reference_rates,
    """
    SELECT CASE WHEN day(day) > 1 THEN CAST(day AS VARCHAR) ELSE '2026-01-01' END AS rate_date, currency AS currency_code, count(*) AS rows FROM
    given_rates GROUP BY 1, 2
    """,
)


# ---- telemetry


def _telemetry(c: Commerce) -> DataFrame:
    """Rule statistics of two runs, appended and read back: what the newest run broke."""
    path = scratch(c.spark, "telemetry")
    stats = rules.rule_passes(rules.statistics(_evaluated(c), _SUITE), _SUITE).withColumn("stage", F.lit("silver"))
    for run, at in (("r1", "2026-01-01"), ("r2", "2026-01-02")):
        landing.append_telemetry(stats.withColumn("checked_at", F.lit(at)), path, run)
    return reads.rule_results(c.spark.read.parquet(path), failed_only=True).select("run_id", "rule_id", "failed", "passed")


_register(
    "read_rule_results",
    _telemetry,
    _EVAL
        + f"SELECT 'r2' AS run_id, rule_id, failed, failed <= total * 0.05 AS passed FROM (SELECT rule_id, count(*) FILTER (list_contains(rule_ids, rule_id) OR list_contains(quality_warnings, rule_id)) AS failed, count(*) AS total FROM e CROSS JOIN {_IDS} GROUP BY 1) WHERE failed > 0",
        
    tables=False,
)
_register(
    "read_quality_summary",
    lambda c: reads.quality_summary(rules.rule_passes(rules.statistics(_evaluated(c), _SUITE), _SUITE).withColumn("stage", F.lit("silver"))),
    _EVAL
        + f"SELECT 'silver' AS stage, count(*) AS rules, count(*) FILTER (failed <= total * 0.05) AS passed, count(*) FILTER (failed > total * 0.05) AS broken, CAST(sum(failed) AS BIGINT) AS failed_rows FROM (SELECT rule_id, count(*) FILTER (list_contains(rule_ids, rule_id) OR list_contains(quality_warnings, rule_id)) AS failed, count(*) AS total FROM e CROSS JOIN {_IDS} GROUP BY 1)",
        
    tables=False,
)
_register(
    "read_low_stock",
    lambda c: reads.low_stock(_turnover(c)).select("product_id", "days_of_cover", "turnover_ratio_90d"),
    "SELECT product_id, days_of_cover, turnover_ratio_90d FROM (" + _SQL["inventory_turnover"]
        + ") WHERE is_low_stock OR turnover_ratio_90d >= 1 ORDER BY days_of_cover NULLS LAST, product_id LIMIT 25",
    tables=False,
)
_trend = lambda c: reads.shipping_by(marts.shipping_performance(c.enriched), "region_name", "carrier", "order_month")
_register(
    "read_shipping_trend",
    lambda c: _trend(c).withColumns({x: F.round(x, 6) for x in ("avg_delivery_days", "exception_rate")}),
    f"""
    SELECT region_name, carrier, order_month, CAST(sum(shipments) AS BIGINT) AS shipments, CAST(sum(delivered) AS BIGINT) AS delivered,
    round({_weighted("avg_delivery_days", "delivered")}, 6) AS avg_delivery_days,
    round({_weighted("exception_rate", "shipments")}, 6) AS exception_rate, max(sla_days) AS sla_days
    FROM ({_SQL["shipping_performance"]}) GROUP BY 1, 2, 3
    """,
    tables=False,
)
_register(
    "assert_monthly_matches_daily",
    lambda c: reads.monthly_against_daily(marts.monthly_revenue(c.daily, c.orders_once, c.active_sets), c.daily),
    """
    SELECT year_month, CAST(by_month AS DOUBLE) AS monthly_usd, CAST(by_day AS DOUBLE) AS daily_usd, coalesce(abs(by_month - by_day) <= 0.01, FALSE) AS matches
    FROM (SELECT order_month AS year_month, coalesce(sum(order_total_usd) FILTER (is_revenue), 0) AS by_month FROM fact_orders WHERE order_date IS NOT NULL GROUP BY 1)
    FULL JOIN (SELECT year_month, sum(revenue_usd) AS by_day FROM daily GROUP BY 1) USING (year_month)
    """,
)
_register(
    "overview",
    lambda c: reads.overview(c.daily, _ltv(c), _turnover(c), marts.shipping_performance(c.enriched)).withColumn("avg_delivery_days", F.round("avg_delivery_days", 6)),
    f"""
    SELECT CAST(sum(revenue_usd) AS DOUBLE) AS revenue_usd, CAST(sum(orders_placed) AS BIGINT) AS orders, max(sales_date) AS newest_day,
    (SELECT count(*) FROM ({_LTV}) WHERE lifecycle_stage = 'active') AS active_customers,
    (SELECT count(*) FROM ({_SQL["inventory_turnover"]}) WHERE is_low_stock) AS low_stock_products,
    (SELECT round({_weighted('avg_delivery_days', 'delivered')}, 6) FROM ({_SQL["shipping_performance"]})) AS avg_delivery_days FROM daily
    """,
)

# ---- typed tables from text deliveries with planted defects

for _dataset in silver.SPECS:
    _QUERIES[f"silver_{_dataset}"] = lambda spark, sf_dir, d=_dataset: _plain(deliveries.Deliveries(spark, sf_dir).shown(d))
    _SQL[f"silver_{_dataset}"] = deliveries.typed_sql(_dataset)
_QUERIES["silver_rule_statistics"] = lambda spark, sf_dir: deliveries.Deliveries(spark, sf_dir).statistics()
_SQL["silver_rule_statistics"] = deliveries.statistics_sql()


def _silver_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All datasets built in order from what was landed: merged tables, quarantine and breaker included; rows of each."""
    root, given = scratch(spark, "silver"), deliveries.Deliveries(spark, sf_dir)
    silver.build_all({d: given.landed(d) for d in silver.SPECS}, root, "b1", "r1")
    parts = [publish.read(spark, f"{root}/{d}").agg(F.lit(d).alias("dataset"), F.count(F.lit(1)).alias("rows")) for d in silver.SPECS]
    return reduce(DataFrame.unionByName, parts)


_QUERIES["silver_run"] = _silver_run
_SQL["silver_run"] = deliveries.counts_sql()


def _quarantined_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the typed tables reject, and why: rules by failed rows."""
    stats = deliveries.Deliveries(spark, sf_dir).statistics().where("failed > 0").withColumn("rate", F.round(F.col("failed") / F.col("total"), 5))
    return stats.orderBy(F.desc("failed"), "rule_id").limit(15)


_QUERIES["ask_quarantined"] = _quarantined_why
_SQL["ask_quarantined"] = f"SELECT rule_id, failed, total, round(failed / total, 5) AS rate FROM ({deliveries.statistics_sql()}) WHERE failed > 0 ORDER BY failed DESC, rule_id LIMIT 15"

# ---- further reads, and the business questions

_monthly = lambda c: marts.monthly_revenue(c.daily, c.orders_once, c.active_sets)
_categories = lambda c: marts.category_revenue(c.lines)
_MONTHLY_COLUMNS = "year_month, month_start, orders_placed, revenue_orders, revenue_usd, gross_margin_usd, gross_margin_pct, units_sold, active_customers, new_customers, avg_order_value_usd, revenue_mom_growth"
_over = lambda mart: f"({_SQL[mart]})"
_register(
    "read_sales_monthly",
    lambda c: reads.sales_monthly(_monthly(c), "1996-01-01", "1999-12-31"),
    f"SELECT {_MONTHLY_COLUMNS} FROM {_over('monthly_revenue')} WHERE month_start BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
    tables=False,
)
_register(
    "ask_monthly_growth",
    lambda c: reads.sales_monthly(_monthly(c), limit=12).select("year_month", "revenue_usd", "gross_margin_pct", "revenue_mom_growth"),
    f"SELECT year_month, revenue_usd, gross_margin_pct, revenue_mom_growth FROM {_over('monthly_revenue')} ORDER BY year_month DESC LIMIT 12",
    tables=False,
)
_register(
    "ask_category_revenue",
    lambda c: reads.revenue_by_parent(_categories(c)),
    """
    SELECT parent_category_name, CAST(sum(line_total_usd) AS DOUBLE) AS revenue_usd FROM lines GROUP BY 1
    """,
)
_register(
    "read_category_months",
    lambda c: reads.revenue_by_parent_and_month(_categories(c)),
    """
    SELECT order_month, parent_category_name, CAST(sum(line_total_usd) AS DOUBLE) AS revenue_usd FROM lines GROUP BY 1, 2
    """,
)
_register(
    "read_regions",
    lambda c: reads.revenue_by_region(marts.regional_performance(c.orders_once, c.enriched, c.derived("c_regions"))),
    f"SELECT region_name, CAST(sum(CAST(revenue_usd AS DECIMAL(18,2))) AS DOUBLE) AS revenue_usd, round({_weighted('avg_delivery_days', 'shipments')}, 6) AS delivery_days FROM {_over('regional_performance')} GROUP BY 1",
        
    tables=False,
)
_register(
    "ask_declining_products",
    lambda c: reads.products(c.metrics, declining=True).select("product_id", "product_name", "revenue_prior_90d", "revenue_last_90d",
        F.round("revenue_trend_ratio", 2).alias("ratio")),
    """
    SELECT product_id, product_name, CAST(revenue_prior_90d AS DOUBLE) AS revenue_prior_90d, CAST(revenue_last_90d AS DOUBLE) AS revenue_last_90d,
    round(revenue_trend_ratio, 2) AS ratio FROM metrics WHERE is_declining ORDER BY metrics.revenue_prior_90d DESC, product_id LIMIT 20
    """,
)
_register(
    "ask_low_warehouses",
    lambda c: reads.low_warehouses(marts.warehouse_performance(c.derived("c_warehouses"), c.position, c.inventory, c.enriched)),
    f"SELECT warehouse_name, on_hand_units, skus_out_of_stock, round(capacity_utilisation, 3) AS utilisation FROM {_over('warehouse_performance')}",
    tables=False,
)
_register(
    "ask_top_customers",
    lambda c: reads.customers_top(_ltv(c)).select("customer_id", "full_name", "total_orders", "net_lifetime_value_usd", "lifecycle_stage"),
    f"SELECT customer_id, full_name, total_orders, net_lifetime_value_usd, lifecycle_stage FROM {_over('customer_ltv')} ORDER BY net_lifetime_value_usd DESC, customer_id LIMIT 20",
    tables=False,
)
_register(
    "ask_defective_suppliers",
    lambda c: reads.defective_suppliers(_supplier_mart(c), 100),
    f"SELECT supplier_name, units_received, units_defective, round(defect_rate, 4) AS defect_rate FROM {_over('supplier_performance')} WHERE units_received > 100 ORDER BY round(defect_rate, 4) DESC, supplier_name LIMIT 10",
        
    tables=False,
)
_register(
    "ask_delivery_by_region",
    lambda c: reads.delivery_by_region(marts.shipping_performance(c.enriched)),
    f"SELECT region_name, round({_weighted('avg_delivery_days', 'delivered')}, 2) AS avg_days, round({_weighted('on_time_rate', 'delivered')}, 3) AS on_time_rate FROM {_over('shipping_performance')} GROUP BY 1",
        
    tables=False,
)
_register(
    "ask_fast_and_low",
    lambda c: reads.fast_and_low(_turnover(c)),
    f"SELECT product_id, product_name, on_hand_units, velocity_units_per_day, days_of_cover FROM {_over('inventory_turnover')} WHERE high_velocity_low_stock ORDER BY days_of_cover, product_id LIMIT 20",
        
    tables=False,
)
_register(
    "ask_turnover_by_category",
    lambda c: reads.turnover_by_category(_turnover(c), None),
    f"SELECT category_name, round(avg(turnover_ratio_90d), 6) AS turnover FROM {_over('inventory_turnover')} WHERE turnover_ratio_90d IS NOT NULL GROUP BY 1",
    tables=False,
)

# ---- checks of the warehouse and tests of the marts


#: Warehouse tables by name; each is made only when it is asked for.
_WAREHOUSE: dict[str, Callable[[Commerce], DataFrame]] = {
    "fact_orders": lambda c: c.orders_once, "fact_order_items": lambda c: c.items_once, "fact_inventory": lambda c: c.inventory, "fact_shipping": lambda c: c.shipping,
        "dim_customer": lambda c: c.dim_customer,
    "dim_product": lambda c: c.dim_product, "dim_region": lambda c: c.derived("c_regions"), "dim_warehouse": lambda c: c.derived("c_warehouses"),
        "dim_category": lambda c: star.dim_category(c.derived("c_categories")), "dim_supplier": lambda c: c.derived("c_suppliers"),
}


def _warehouse_tables(c: Commerce) -> dict[str, DataFrame]:
    return {name: build(c) for name, build in _WAREHOUSE.items()}


def _mart_tables(c: Commerce) -> dict[str, DataFrame]:
    return {
        "daily_sales": c.daily, "monthly_revenue": _monthly(c), "customer_ltv": _ltv(c), "product_metrics": c.metrics,
            "category_revenue": _categories(c), "inventory_turnover": _turnover(c), "supplier_performance": _supplier_mart(c),
            "shipping_performance": marts.shipping_performance(c.enriched),
        "regional_performance": marts.regional_performance(c.orders_once, c.enriched, c.derived("c_regions")),
            "warehouse_performance": marts.warehouse_performance(c.derived("c_warehouses"), c.position, c.inventory, c.enriched),
            "dim_customer": c.dim_customer,
    }


_WAREHOUSE_SQL = {
    "fact_orders": "fact_orders", "fact_order_items": "fact_items", "fact_inventory": "inventory", "fact_shipping": "shipping",
        "dim_customer": "c_customers",
    "dim_product": "products", "dim_region": "c_regions", "dim_warehouse": "c_warehouses", "dim_category": "categories", "dim_supplier": "c_suppliers",
}
_MART_SQL = {m: _over(m) for m in ("daily_sales", "monthly_revenue", "customer_ltv", "product_metrics", "category_revenue", "inventory_turnover",
    "supplier_performance", "shipping_performance", "regional_performance", "warehouse_performance")} | {"dim_customer": "c_customers"}
_register("warehouse_checks", lambda c: checks.run(checks.WAREHOUSE, _warehouse_tables(c)), checks.sql(checks.WAREHOUSE, _WAREHOUSE_SQL))


def _source_tables(c: Commerce) -> dict[str, DataFrame]:
    return _warehouse_tables(c) | {"agg_inventory_position": c.position}


def _intermediate_tables(c: Commerce) -> dict[str, DataFrame]:
    key = lambda rows, name, of: rows.withColumn(name, fn.surrogate_key(F.col(of)))
    orders, lines = c.orders_once, c.lines
    return {
        "int_revenue_lines": key(lines, "order_item_key", "order_item_id"), "int_product_period_sales": key(marts.period_sales(lines, c.order_days), "product_key", "product_id"),
        "int_customer_orders": key(marts.customer_orders(orders), "customer_key", "customer_id"), "int_shipping_enriched": key(c.enriched, "shipment_key", "shipment_id"),
    }


#: DuckDB makes no surrogate keys; they stand for their ids one to one, so ids are tested in their place.
_SOURCE_SQL = {
    "dim_customer": "(SELECT *, customer_id AS customer_key FROM c_customers)", "dim_product": "(SELECT *, product_id AS product_key FROM products)",
    "fact_orders": "(SELECT *, order_id AS order_key, customer_id AS customer_key FROM fact_orders)", "fact_shipping": "(SELECT *, shipment_id AS shipment_key FROM shipping)",
    "fact_order_items": "(SELECT *, order_item_id AS order_item_key, product_id AS product_key, order_id AS order_key FROM fact_items)",
    "fact_inventory": "(SELECT *, event_id AS inventory_event_key FROM inventory)",
    "agg_inventory_position": "(SELECT *, CAST(product_id AS VARCHAR) || '|' || CAST(warehouse_id AS VARCHAR) AS position_key FROM position)",
}
_INTERMEDIATE_SQL = {
    "int_revenue_lines": "(SELECT *, order_item_id AS order_item_key FROM lines)", "int_product_period_sales": "(SELECT *, product_id AS product_key FROM periods)",
    "int_customer_orders": "(SELECT DISTINCT customer_id AS customer_key FROM fact_orders)", "int_shipping_enriched": "(SELECT *, shipment_id AS shipment_key FROM enriched)",
}
_register("source_tests", lambda c: checks.run(checks.SOURCES, _source_tables(c)), SQL_TABLES + checks.sql(checks.SOURCES, _SOURCE_SQL), tables=False)
_register("intermediate_tests", lambda c: checks.run(checks.INTERMEDIATE, _intermediate_tables(c)), SQL_TABLES + checks.sql(checks.INTERMEDIATE, _INTERMEDIATE_SQL), tables=False)
_register("mart_tests", lambda c: checks.run(checks.MARTS, _mart_tables(c)), checks.sql(checks.MARTS, _MART_SQL))
_register(
    "freshness_pair",
    lambda c: checks.freshness(c.derived("c_orders"), "updated_at", "order_date", F.lit("2001-08-02").cast("timestamp_ntz"), F.lit("2001-08-01").cast("date")),
    """
    SELECT 'fact_orders.loaded_recently' AS check_name, 'warn' AS severity, CAST(1 AS BIGINT) AS total, CAST(max(updated_at) < TIMESTAMP
    '2001-08-01 00:00:00' AS BIGINT) AS failed FROM c_orders UNION ALL SELECT 'fact_orders.covers_batch', 'error', CAST(1 AS BIGINT),
    CAST(max(order_date) < DATE '2001-07-30' AS BIGINT) FROM c_orders
    """,
)
_register(
    "assert_lines_reconciled",
    lambda c: checks.run([k for k in checks.WAREHOUSE if k.name.endswith("lines_reconciled_rate")], {"fact_orders": c.fact_orders}).select("total", "failed", "passed"),
    """
    SELECT count(*) AS total, count(*) FILTER (is_revenue AND NOT lines_reconciled) AS failed, round(count(*) FILTER (is_revenue AND NOT
    lines_reconciled) / count(*), 6) <= 0.1 AS passed FROM fact_orders
    """,
)
_register(
    "duplicate_keys",
    lambda c: checks.duplicates(c.source("lineitem"), *LINE_KEYS),
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    tables=False,
)
_register(
    "records_to_text",
    lambda c: readers.records_to_text(c.source("events").selectExpr("to_json(named_struct('id', event_id, 'kind', event_type, 'big', value > 50, 'deep', named_struct('u', user_id), 'none', CAST(NULL AS STRING))) AS r"),
        "r", ["id", "kind", "big", "deep", "none"]),
    """
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS big, '{"u":' || CAST(user_id AS
    VARCHAR) || '}' AS deep, CAST(NULL AS VARCHAR) AS "none" FROM events
    """,
    tables=False,
)
_register(
    "exact_dedup_counts",
    lambda c: dedup.removed_duplicates(c.source("lineitem"), LINE_KEYS),
    """
    SELECT count(*) AS total, count(DISTINCT (l_orderkey, l_linenumber)) AS kept, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed
    FROM lineitem
    """,
    tables=False,
)


def _written_fact(c: Commerce) -> DataFrame:
    """A fact written by month, then some months again: what the second write reports."""
    path = scratch(c.spark, "fact")
    merge.write_with_stats(c.orders_once, path, "fact_orders", "order_month")
    months = ["1996-02", "1998-11", "2001-07"]
    return merge.write_with_stats(star.only_months(c.orders_once, "order_month", months), path, "fact_orders", "order_month", months)


_register(
    "gold_write_stats",
    _written_fact,
    """
    SELECT 'fact_orders' AS "table", order_month AS partition, count(*) AS rows FROM c_orders WHERE order_month IN ('1996-02', '1998-11', '2001-07')
    GROUP BY order_month
    """,
)


def _loaded(c: Commerce) -> DataFrame:
    """An upsert that stamps what it brings; what it doesn't touch keeps its stamp."""
    first, second = _split_orders(c)
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    done = merge.upsert(first.withColumn("_loaded_at", stamp("2026-01-01 00:00:00")), second, ["order_id"], stamp("2026-01-02 00:00:00"))
    return done.select("order_id", "version", "_loaded_at")


_register(
    "upsert_loaded_at",
    _loaded,
    """
    SELECT order_id, CAST(CASE WHEN order_id % 10 = 3 OR order_id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN order_id % 10 = 3 OR
    order_id % 7 = 0 THEN TIMESTAMP '2026-01-02 00:00:00' ELSE TIMESTAMP '2026-01-01 00:00:00' END AS _loaded_at FROM c_orders
    """,
)


def _ndjson_files(c: Commerce) -> DataFrame:
    """Lines of NDJSON files and their numbers: each file holds its lines in order, the number of the line among them."""
    path = scratch(c.spark, "ndjson")
    rows = c.source("events").select((F.col("event_id") % 3).alias("f"), "event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"))).alias("value"))
    rows.repartition("f").sortWithinPartitions("f", "event_id").select("f", "value").write.partitionBy("f").text(path)
    read = readers.good(readers.read_ndjson(c.spark, path), ["id"])
    return read.select(F.col("id").cast("long").alias("event_id"), "_row_number")


_register("ndjson_files", _ndjson_files, "SELECT event_id, event_id // 3 + 1 AS _row_number FROM events", tables=False)


# ---- staging

_DATES_SQL = """(SELECT CAST(strftime(full_date, '%Y%m%d') AS BIGINT) AS date_key, full_date, year(full_date) AS year, quarter(full_date) AS quarter, month(full_date) AS month,
    monthname(full_date) AS month_name, strftime(full_date, '%Y-%m') AS year_month, weekofyear(full_date) AS iso_week, dayofweek(full_date) + 1 AS day_of_week, dayname(full_date) AS day_name,
    dayofweek(full_date) IN (0, 6) AS is_weekend
    FROM (SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM c_orders), (SELECT max(order_date) FROM c_orders), INTERVAL 1 DAY)) AS DATE) AS full_date))"""
_STAGED_SQL = _WAREHOUSE_SQL | {"dim_date": _DATES_SQL, "agg_inventory_position": "position", "dim_customer": "(SELECT *, first_name || ' ' || last_name AS full_name FROM c_customers)"}
_DOUBLES = ("_usd", "_local", "unit_cost", "unit_price", "unit_margin")


#: What staging tables read: a fact of its own is a plan, since nothing else reads it.
_STAGED: dict[str, Callable[[Commerce], DataFrame]] = _WAREHOUSE | {"dim_date": lambda c: c.dates, "agg_inventory_position": lambda c: c.position,
    "fact_orders": lambda c: c.fact_orders, "fact_order_items": lambda c: c.fact_items}


def _staged(c: Commerce, name: str) -> DataFrame:
    """A staging table without the surrogate keys, whose values only one engine makes. Only its own warehouse table is made."""
    return staging.stage(name, _STAGED[staging.STAGING[name][0]](c)).select(*[new for new, _ in _plain_columns(name)])


def _plain_columns(name: str) -> list[tuple[str, str]]:
    return [(new, old) for new, old in staging.columns(name) if not new.endswith("_key") or new in ("date_key", "order_date_key")]


#: When rows were loaded is no property of the given tables.
_LACKING = {
    "stg_order_items": ("_loaded_at",), "stg_orders": ("_loaded_at",),
}


def _staged_sql(name: str) -> str:
    def one(new: str, old: str) -> str:
        if old in _LACKING.get(name, ()):
            return f"CAST(NULL AS VARCHAR) AS {new}"
        return f"CAST({old} AS DOUBLE) AS {new}" if old.endswith(_DOUBLES) else f"{old} AS {new}"

    return f"SELECT {', '.join(one(*x) for x in _plain_columns(name))} FROM {_STAGED_SQL[staging.STAGING[name][0]]}"


for _name in staging.STAGING:
    _register(_name, lambda c, n=_name: _staged(c, n), _staged_sql(_name))
