"""Commerce tables derived from the driver's tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.operators import windows as win
from lakeloom.operators.dedup import keep_latest
from lakeloom.operators.scratch import written
from lakeloom.plans import marts, star

_MONTH = "substr(CAST(CAST({0} AS DATE) AS STRING), 1, 7)"
#: Columns of each derived table over its source.
EXPRESSIONS: dict[str, tuple[str, list[str]]] = {
    "c_orders": ("orders", [
        "o_orderkey AS order_id", "o_custkey AS customer_id", "o_custkey % 5 AS region_code", "o_orderdate AS order_ts",
            "CAST(o_orderdate AS DATE) AS order_date", _MONTH.format("o_orderdate") + " AS order_month",
        "CASE o_orderkey % 6 WHEN 0 THEN 'placed' WHEN 1 THEN 'paid' WHEN 2 THEN 'shipped' WHEN 3 THEN 'delivered' WHEN 4 THEN 'cancelled' ELSE 'returned' END AS status",
        "CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency", "CAST(o_totalprice AS DECIMAL(14,2)) AS order_total",
        "CASE o_orderkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'store' WHEN 2 THEN 'mobile_app' END AS channel",
            "CASE WHEN o_orderkey % 9 = 0 THEN 'SAVE' END AS coupon_code", "o_orderdate AS updated_at", "'b1' AS _batch_id",
    ]),
    "c_items": ("latest_lines", [
        "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS order_item_id", "'b1' AS _batch_id",
        "l_orderkey AS order_id", "l_linenumber AS line_number", "l_partkey AS product_id", "CAST(l_quantity AS BIGINT) AS quantity",
            "CAST(l_extendedprice AS DECIMAL(14,2)) AS unit_price", "CAST(round(l_discount * 100) AS INT) AS discount_pct",
        "CAST(round(CAST(l_quantity AS DECIMAL(5,0)) * CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(100 - round(l_discount * 100) AS DECIMAL(3,0)) * CAST('0.01' AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS line_total",
            
    ]),
    "c_products": ("part", [
        "p_partkey AS product_id", "p_name AS product_name", "p_brand AS brand", "p_partkey % 25 AS category_id", "p_partkey % 10 AS supplier_id",
            "CAST(p_retailprice AS DECIMAL(14,2)) AS unit_price", "'SKU-' || CAST(p_partkey AS STRING) AS sku", "p_size > 5 AS is_active",
        "CAST(round(CAST(p_retailprice AS DECIMAL(14,2)) * CAST('0.6' AS DECIMAL(2,1)), 2) AS DECIMAL(14,2)) AS unit_cost",
    ]),
    "c_categories": ("nation", ["CAST(n_nationkey AS BIGINT) AS category_id", "n_name AS category_name",
        "CASE WHEN n_nationkey >= 5 THEN CAST(n_nationkey % 5 AS BIGINT) END AS parent_category_id"]),
    "c_suppliers": ("supplier", ["s_suppkey AS supplier_id", "s_name AS supplier_name", "CAST(s_nationkey AS BIGINT) AS country_id",
        "'N' || CAST(s_nationkey AS STRING) AS country_code", "CAST(s_nationkey % 5 AS BIGINT) AS region_code", "s_suppkey % 30 + 1 AS lead_time_days",
        "CASE WHEN s_acctbal > 5000 THEN 'A' WHEN s_acctbal > 0 THEN 'B' ELSE 'C' END AS quality_tier", "s_suppkey % 7 <> 0 AS is_active"]),
    "c_customers": ("customer", [
        "c_custkey AS customer_id", "c_name AS first_name", "c_mktsegment AS last_name", "CASE WHEN c_custkey % 10 > 0 THEN c_name || '@example.com' END AS email",
        "c_mktsegment AS customer_segment", "'N' || CAST(c_nationkey AS STRING) AS country_code", "CAST(c_nationkey % 5 AS BIGINT) AS region_code",
        "'City ' || CAST(c_custkey % 40 AS STRING) AS city", "CAST('2020-01-01' AS DATE) + CAST(c_custkey % 700 AS INT) AS signup_date",
        "CAST('1950-01-01' AS DATE) + CAST(c_custkey % 19000 AS INT) AS birth_date", "c_acctbal >= 0 AS marketing_opt_in",
        "CAST('2025-01-01' AS DATE) + CAST(c_custkey % 300 AS INT) AS updated_at",
        "CASE WHEN c_acctbal < 0 THEN split('email_format,signup_date_not_future', ',') WHEN c_custkey % 10 = 0 THEN split('email_format', ',') END AS quality_warnings",
    ]),
    "c_regions": ("region", ["CAST(r_regionkey AS BIGINT) AS region_code", "r_name AS region_name", "CAST(r_regionkey + 2 AS BIGINT) AS base_delivery_days",
        "substr(r_name, 1, 2) AS country_code", "'Country of ' || r_name AS country_name", "CASE r_regionkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency_code"]),
    "c_warehouses": ("region", ["CAST(r_regionkey AS BIGINT) AS warehouse_id", "r_name AS warehouse_name", "CAST((r_regionkey + 1) * 1000 AS BIGINT) AS capacity_units", "'City ' || r_name AS city",
        "CAST(r_regionkey AS BIGINT) AS region_code"]),
    "c_payments": ("orders", [
        "o_orderkey AS order_id", "CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'refunded' ELSE 'captured' END AS payment_status",
        "CAST(CASE o_orderkey % 5 WHEN 1 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(14,2)) AS amount", "o_orderdate AS paid_at",
    ]),
    "c_stock_events": ("events", [
        "event_id", "user_id AS product_id", "event_id % 4 AS warehouse_id", "event_id % 10 AS supplier_id", "ts AS event_ts",
            "CAST(ts AS DATE) AS event_date", _MONTH.format("ts") + " AS event_month",
        "CASE event_type WHEN 'signup' THEN 'receipt' WHEN 'purchase' THEN 'shipment' WHEN 'error' THEN 'adjustment' WHEN 'click' THEN 'return' ELSE 'stock_count' END AS event_type",
            
        "CASE event_type WHEN 'purchase' THEN -(event_id % 20 + 1) WHEN 'view' THEN 0 ELSE event_id % 20 + 1 END AS quantity_delta",
        "CASE event_type WHEN 'signup' THEN CAST(event_id % 50 + 1 AS DECIMAL(14,2)) END AS unit_cost", "CASE event_type WHEN 'signup' THEN event_id % 3 END AS defective_qty",
        "CASE event_type WHEN 'view' THEN event_id % 9 END AS counted_quantity",
            "CASE WHEN event_id % 5 = 0 THEN 'R' || CAST(event_id AS STRING) END AS reference_id",
            "CASE event_type WHEN 'error' THEN 'lost' END AS reason", "'b1' AS _batch_id",
    ]),
    "c_tracker": ("events", [
        "event_id", "user_id * 100 + day(ts) AS shipment_id", "(user_id * 100 + day(ts)) % 1000 AS order_id", "ts AS event_ts",
            "user_id % 4 AS warehouse_id", "user_id % 5 AS region_code", _MONTH.format("ts") + " AS event_month",
            "CASE event_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' END AS carrier",
        "CASE event_type WHEN 'signup' THEN 'label_created' WHEN 'click' THEN 'picked_up' WHEN 'view' THEN 'in_transit' WHEN 'purchase' THEN 'delivered' ELSE 'delivery_exception' END AS event",
            
    ]),
}
RATE = "CASE currency WHEN 'USD' THEN CAST(1 AS DECIMAL(14,6)) ELSE CAST(1 + CAST(day(order_date) AS DECIMAL(4,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(14,6)) END AS usd_per_unit"
LINE_KEYS, LINE_VERSION = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
#: Rows of a source that one task sorts or groups, about: what a task holds doesn't grow with the source.
A_TASK = 250_000


class Commerce:
    """Lazily derived tables of one directory, and the star schema over them.

    One object is one run: what several marts read (days of orders, rates, latest lines, facts) is written once, when it is first asked for,
    and read by all that follow. ``fact_orders`` and ``fact_items`` are plans of their own for a query that is the fact itself;
    ``orders_once`` and ``items_once`` are the run's tables. Their surrogate keys are made by those that read them. Stock events are
    scanned once a run, whatever reads ``inventory``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}
        self._columns: dict[str, list[str]] = {}
        self._inventory: DataFrame | None = None
        self._parts: dict[str, int] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of this run: written when it is first asked for."""
        if name not in self._written:
            self._written[name] = written(build(), name, "zstd")
        return self._written[name]

    def fact_once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A fact of this run, written without surrogate keys."""

        def unkeyed() -> DataFrame:
            fact = build()
            self._columns[name] = fact.columns
            return star.unkeyed(fact)

        rows = self.once(name, unkeyed)
        return star.rekeyed(rows, self._columns[name])

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Partitions for a shuffle of a source's rows: as many as run at once, or as many as have ``A_TASK`` rows each. Rows are counted from the files' footers, once a run."""
        if name not in self._parts:
            rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").count()
            self._parts[name] = max(self.spark.sparkContext.defaultParallelism, -(-rows // A_TASK))
        return self._parts[name]

    def derived(self, name: str, parts: int | None = None) -> DataFrame:
        """A derived table; lines are dealt by order to ``parts`` partitions, or as the session has it, which saves a shuffle where sums of orders join other tables."""
        source, expressions = EXPRESSIONS[name]
        # partitioned by order once: the window over an order's lines, sums per order and the join with headers all keep that
        if source == "latest_lines":
            rows = keep_latest(self.source("lineitem").repartition(*([parts] if parts else []), "l_orderkey"), LINE_KEYS, LINE_VERSION)
        else:
            rows = self.source(source)
        return rows.selectExpr(*expressions)

    def text(self, name: str, **columns: str) -> DataFrame:
        """Columns of a derived table as text, for jobs that start from text."""
        return self.derived(name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    @property
    def order_days(self) -> DataFrame:
        """Days and currencies that have orders: calendar, rates and the newest day come from it."""
        return self.once("order-days", lambda: self.derived("c_orders").select("order_date", "currency").distinct())

    @property
    def given_rates(self) -> DataFrame:
        return self.order_days.where("day(order_date) % 7 <> 0").selectExpr("order_date AS day", "currency", RATE)

    @property
    def rates(self) -> DataFrame:
        return self.once("rates", lambda: win.dense_rates(self.given_rates, "day", "currency", "usd_per_unit", "USD"))

    @property
    def items(self) -> DataFrame:
        """Latest lines: every line is deduplicated once a run."""
        return self.once("items", lambda: self.derived("c_items"))

    @property
    def orders_once(self) -> DataFrame:
        return self.fact_once("fact-orders", lambda: star.fact_orders(self.derived("c_orders"), self.items, self.derived("c_payments"), self.rates))

    @property
    def items_once(self) -> DataFrame:
        return self.fact_once("fact-items", lambda: star.fact_order_items(self.items, self.heads, self.derived("c_products"), self.rates))

    @property
    def heads(self) -> DataFrame:
        """Headers of orders: the fact, once it is written, else what it is made from."""
        return self._written["fact-orders"] if "fact-orders" in self._written else self.derived("c_orders")

    @property
    def fact_orders(self) -> DataFrame:
        return star.fact_orders(self.derived("c_orders"), self.derived("c_items"), self.derived("c_payments"), self.rates)

    @property
    def fact_items(self) -> DataFrame:
        return self.fact_items_in(None)

    def fact_items_in(self, parts: int | None) -> DataFrame:
        """The fact of lines as a plan of its own, its lines dealt to ``parts`` partitions."""
        return star.fact_order_items(self.derived("c_items", parts), self.derived("c_orders"), self.derived("c_products"), self.rates)

    @property
    def inventory(self) -> DataFrame:
        if self._inventory is None:
            self._inventory = star.fact_inventory(self.derived("c_stock_events"))
        return self._inventory

    @property
    def shipping(self) -> DataFrame:
        return star.fact_shipping(self.derived("c_tracker"), self.heads)

    @property
    def shipping_once(self) -> DataFrame:
        return self.fact_once("fact-shipping", lambda: self.shipping)

    @property
    def dim_product(self) -> DataFrame:
        return star.dim_product(self.derived("c_products"), star.dim_category(self.derived("c_categories")), self.derived("c_suppliers"))

    @property
    def dim_customer(self) -> DataFrame:
        return star.dim_customer(self.derived("c_customers"))

    @property
    def lines(self) -> DataFrame:
        return marts.revenue_lines(self.items_once, self.dim_product, self.derived("c_regions"))

    @property
    def enriched(self) -> DataFrame:
        return marts.shipping_enriched(self.shipping, self.derived("c_regions"), self.derived("c_warehouses"))

    @property
    def dates(self) -> DataFrame:
        from pyspark.sql import functions as F

        bounds = self.order_days.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
        return star.dim_date(F.col("lo"), F.col("hi"), bounds)

    @property
    def daily(self) -> DataFrame:
        orders = self.orders_once  # first, so that the lines take their headers from it
        return marts.daily_sales(orders, self.items_once, self.dates, self.active_sets)

    @property
    def active_sets(self) -> DataFrame:
        """Customers with revenue of each day, as sets that months are merged from."""
        return self.once("active-sets", lambda: marts.active_sets(self.orders_once))

    @property
    def position(self) -> DataFrame:
        return star.inventory_position(self.inventory)

    @property
    def metrics(self) -> DataFrame:
        return marts.product_metrics(self.dim_product, self.lines, self.order_days)


def _cte(name: str) -> str:
    source, expressions = EXPRESSIONS[name]
    return f"{name} AS (SELECT {', '.join(expressions)} FROM {source})"


_LATEST = f"latest_lines AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY {', '.join(LINE_KEYS)} ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in LINE_VERSION)}) = 1)"
#: The same tables and the star schema in DuckDB's SQL; a query's SQL begins with them and reads those that it needs.
SQL_TABLES = f"""WITH {_LATEST},
{', '.join(_cte(n) for n in EXPRESSIONS)},
given_rates AS (SELECT order_date AS day, currency, {RATE} FROM (SELECT DISTINCT order_date, currency FROM c_orders) WHERE day(order_date) % 7 <> 0),
rate_days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM given_rates), (SELECT max(day) FROM given_rates), INTERVAL 1 DAY)) AS DATE) AS day),
rates AS (SELECT day, currency, CASE WHEN currency = 'USD' THEN CAST(1 AS DECIMAL(14,6)) ELSE last_value(usd_per_unit IGNORE NULLS) OVER (PARTITION BY currency ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS usd_per_unit
  FROM rate_days CROSS JOIN (SELECT DISTINCT currency FROM given_rates) LEFT JOIN given_rates USING (day, currency)),
item_totals AS (SELECT order_id, count(*) AS item_count, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(line_total) AS DECIMAL(14,2)) AS items_total, CAST(sum(CAST(quantity AS DECIMAL(5,0)) * unit_price) AS DECIMAL(14,2)) AS gross_total FROM c_items GROUP BY order_id),
payment_totals AS (SELECT order_id, max(CASE WHEN payment_status = 'captured' THEN paid_at END) AS paid_at, CAST(sum(CASE WHEN payment_status = 'captured' THEN amount ELSE 0 END) AS DECIMAL(14,2)) AS captured,
  CAST(sum(CASE WHEN payment_status = 'refunded' THEN -amount ELSE 0 END) AS DECIMAL(14,2)) AS refunded, count(*) FILTER (payment_status = 'failed') AS failed FROM c_payments GROUP BY order_id),
fact_orders AS (SELECT o.* EXCLUDE (order_total), CAST(strftime(o.order_date, '%Y%m%d') AS INT) AS order_date_key, o.order_total AS order_total_local, r.usd_per_unit AS fx_usd_per_unit,
  CAST(round(o.order_total * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS order_total_usd, CAST(round(i.gross_total * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS gross_amount_usd,
  CAST(round((coalesce(i.gross_total, 0) - coalesce(i.items_total, 0)) * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS discount_usd, CAST(round(coalesce(i.items_total, 0) * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS lines_total_usd,
  abs(coalesce(i.items_total, 0) - o.order_total) <= greatest(1.0, CAST(o.order_total * CAST('0.01' AS DECIMAL(6,4)) AS DECIMAL(18,4))) AS lines_reconciled, coalesce(i.item_count, 0) AS item_count, coalesce(i.total_quantity, 0) AS total_quantity, p.paid_at,
  CAST(round(coalesce(p.captured, 0) * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS captured_amount_usd, CAST(round(coalesce(p.refunded, 0) * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS refunded_amount_usd, coalesce(p.failed, 0) AS failed_payment_attempts,
  o.status = 'cancelled' AS is_cancelled, o.status = 'returned' AS is_returned, o.status IN ('paid', 'shipped', 'delivered') AS is_revenue,
  row_number() OVER w AS customer_order_seq, CAST(o.order_date - lag(o.order_date) OVER w AS INT) AS days_since_prev_order, row_number() OVER w = 1 AS is_first_order
  FROM c_orders o LEFT JOIN item_totals i USING (order_id) LEFT JOIN payment_totals p USING (order_id) LEFT JOIN rates r ON r.day = o.order_date AND r.currency = o.currency
  WINDOW w AS (PARTITION BY o.customer_id ORDER BY o.order_ts, o.order_id)),
fact_items AS (SELECT i.order_item_id, i._batch_id, i.order_id, i.line_number, i.product_id, p.category_id, p.supplier_id, o.customer_id, o.region_code, CAST(strftime(o.order_date, '%Y%m%d') AS INT) AS order_date_key, o.order_date, o.order_ts, o.order_month, o.status, o.currency,
  i.quantity, i.unit_price AS unit_price_local, i.discount_pct, i.line_total AS line_total_local, r.usd_per_unit AS fx_usd_per_unit, p.unit_cost AS unit_cost_usd, FALSE AS line_total_recomputed,
  CAST(round(i.unit_price * r.usd_per_unit, 4) AS DECIMAL(18,4)) AS unit_price_usd, CAST(round(i.line_total * r.usd_per_unit, 2) AS DECIMAL(18,2)) AS line_total_usd, CAST(CAST(i.quantity AS DECIMAL(5,0)) * p.unit_cost AS DECIMAL(14,2)) AS line_cost_usd,
  CAST(round(i.line_total * r.usd_per_unit - CAST(i.quantity AS DECIMAL(5,0)) * p.unit_cost, 2) AS DECIMAL(18,2)) AS gross_margin_usd, o.status IN ('paid', 'shipped', 'delivered') AS is_revenue, o.status = 'returned' AS is_returned
  FROM c_items i JOIN c_orders o USING (order_id) LEFT JOIN c_products p USING (product_id) LEFT JOIN rates r ON r.day = o.order_date AND r.currency = o.currency),
inventory AS (SELECT *, CAST(strftime(event_date, '%Y%m%d') AS INT) AS event_date_key, CAST(sum(quantity_delta) OVER (PARTITION BY product_id, warehouse_id ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS on_hand_after, CAST(CAST(quantity_delta AS DECIMAL(5,0)) * unit_cost AS DECIMAL(18,2)) AS receipt_value_usd FROM c_stock_events),
ship AS (SELECT shipment_id, order_id, arg_min(carrier, (event_ts, event_id)) FILTER (carrier IS NOT NULL) AS carrier, arg_min(warehouse_id, (event_ts, event_id)) AS warehouse_id, arg_min(region_code, (event_ts, event_id)) AS region_code, {', '.join(f"min(CASE WHEN event = '{e}' THEN event_ts END) AS {c}" for e, c in star.STEPS.items())}, count(*) AS event_count FROM c_tracker GROUP BY shipment_id, order_id),
hours AS (SELECT s.*, o.customer_id, CAST(strftime(label_created_ts, '%Y%m%d') AS INT) AS ship_date_key, CAST(strftime(delivered_ts, '%Y%m%d') AS INT) AS delivered_date_key, o.order_date, o.order_month, sign(epoch_us(delivered_ts) - epoch_us(label_created_ts)) * ((200 * (abs(epoch_us(delivered_ts) - epoch_us(label_created_ts)) // 1000000) + 3600) // 7200) / 100 AS delivery_hours FROM ship s JOIN c_orders o USING (order_id)),
shipping AS (SELECT *, coalesce(delivered_ts < label_created_ts, FALSE) AS timeline_inconsistent, CASE WHEN delivery_hours >= 0 THEN ((200 * CAST(round(delivery_hours * 100) AS BIGINT) + 2400) // 4800) / 100 END AS delivery_days, delivered_ts IS NOT NULL AS is_delivered, exception_ts IS NOT NULL AS had_exception, returned_ts IS NOT NULL AS is_returned FROM hours),
categories AS (SELECT c.category_id, c.category_name, coalesce(p.category_name, c.category_name) AS parent_category_name FROM c_categories c LEFT JOIN c_categories p ON p.category_id = c.parent_category_id),
products AS (SELECT p.*, c.category_name, c.parent_category_name, s.supplier_name, CAST(p.unit_price - p.unit_cost AS DECIMAL(14,2)) AS unit_margin, p.unit_price < p.unit_cost AS is_negative_margin FROM c_products p LEFT JOIN categories c USING (category_id) LEFT JOIN c_suppliers s USING (supplier_id)),
lines AS (SELECT f.order_id, f.order_item_id, f.order_date, f.order_month, f.customer_id, f.product_id, p.product_name, p.brand, p.category_name, p.parent_category_name, f.supplier_id, p.supplier_name, f.region_code, r.region_name, f.quantity, f.line_total_usd, f.line_cost_usd, f.gross_margin_usd
  FROM fact_items f JOIN products p USING (product_id) LEFT JOIN c_regions r USING (region_code) WHERE f.is_revenue),
periods AS (SELECT product_id, max(as_of) AS as_of_date, coalesce(sum(line_total_usd) FILTER (as_of - order_date < 90), 0) AS revenue_last_90d, coalesce(sum(line_total_usd) FILTER (as_of - order_date >= 90 AND as_of - order_date < 180), 0) AS revenue_prior_90d,
  CAST(coalesce(sum(quantity) FILTER (as_of - order_date < 90), 0) AS BIGINT) AS units_last_90d, CAST(coalesce(sum(quantity) FILTER (as_of - order_date >= 90 AND as_of - order_date < 180), 0) AS BIGINT) AS units_prior_90d, CAST(coalesce(sum(quantity) FILTER (as_of - order_date < 30), 0) AS BIGINT) AS units_last_30d
  FROM lines, (SELECT max(order_date) AS as_of FROM c_orders) GROUP BY product_id),
enriched AS (SELECT s.*, r.region_name, r.base_delivery_days, w.warehouse_name, CASE WHEN s.delivery_days IS NOT NULL THEN s.delivery_days <= r.base_delivery_days + 1 END AS delivered_on_time FROM shipping s LEFT JOIN c_regions r USING (region_code) LEFT JOIN c_warehouses w USING (warehouse_id)),
day_lines AS (SELECT order_date, sum(gross_margin_usd) AS gross_margin_usd, CAST(sum(quantity) AS BIGINT) AS units_sold FROM fact_items WHERE is_revenue GROUP BY order_date),
daily AS (SELECT o.order_date AS sales_date, o.order_month AS year_month, dayofweek(o.order_date) IN (0, 6) AS is_weekend, count(*) AS orders_placed, count(*) FILTER (is_revenue) AS revenue_orders, count(*) FILTER (is_cancelled) AS cancelled_orders, count(*) FILTER (is_returned) AS returned_orders,
  count(DISTINCT customer_id) FILTER (is_revenue) AS active_customers, count(DISTINCT customer_id) FILTER (is_first_order) AS new_customers, coalesce(sum(order_total_usd) FILTER (is_revenue), 0) AS revenue_usd, coalesce(sum(discount_usd) FILTER (is_revenue), 0) AS discount_usd, coalesce(sum(refunded_amount_usd), 0) AS refunded_usd,
  coalesce(max(l.gross_margin_usd), 0) AS gross_margin_usd, coalesce(max(l.units_sold), 0) AS units_sold, CASE WHEN count(*) FILTER (is_revenue) > 0 THEN CAST(coalesce(sum(order_total_usd) FILTER (is_revenue), 0) AS DOUBLE) / count(*) FILTER (is_revenue) END AS avg_order_value_usd
  FROM fact_orders o LEFT JOIN day_lines l USING (order_date) GROUP BY o.order_date, o.order_month),
position AS (SELECT product_id, warehouse_id, max(event_ts) FILTER (event_type = 'receipt') AS last_receipt_ts, max(event_ts) FILTER (event_type = 'shipment') AS last_shipment_ts, max(event_ts) AS last_event_ts,
  CAST(coalesce(sum(quantity_delta) FILTER (event_type = 'receipt'), 0) AS BIGINT) AS units_received, CAST(coalesce(sum(-quantity_delta) FILTER (event_type = 'shipment'), 0) AS BIGINT) AS units_shipped, CAST(sum(coalesce(defective_qty, 0)) AS BIGINT) AS units_defective, arg_max(on_hand_after, (event_ts, event_id)) AS on_hand_units,
  round(CAST(sum(unit_cost) FILTER (event_type = 'receipt') AS DOUBLE) / count(unit_cost) FILTER (event_type = 'receipt'), 4) AS avg_unit_cost_usd,
  round(coalesce(arg_max(on_hand_after, (event_ts, event_id)), 0) * coalesce(round(CAST(sum(unit_cost) FILTER (event_type = 'receipt') AS DOUBLE) / count(unit_cost) FILTER (event_type = 'receipt'), 4), 0.0), 2) AS inventory_value_usd
  FROM inventory GROUP BY product_id, warehouse_id),
totals AS (SELECT product_id, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units_sold, sum(line_total_usd) AS revenue_usd, sum(gross_margin_usd) AS gross_margin_usd, count(DISTINCT customer_id) AS unique_customers, min(order_date) AS first_sold_date, max(order_date) AS last_sold_date FROM lines GROUP BY product_id),
metrics AS (SELECT p.*, coalesce(t.orders, 0) AS orders, coalesce(t.units_sold, 0) AS units_sold, coalesce(t.revenue_usd, 0) AS revenue_usd, coalesce(t.gross_margin_usd, 0) AS gross_margin_usd, coalesce(t.unique_customers, 0) AS unique_customers, t.first_sold_date, t.last_sold_date,
  coalesce(s.revenue_last_90d, 0) AS revenue_last_90d, coalesce(s.revenue_prior_90d, 0) AS revenue_prior_90d, CASE WHEN s.revenue_prior_90d > 0 THEN CAST(s.revenue_last_90d AS DOUBLE) / CAST(s.revenue_prior_90d AS DOUBLE) END AS revenue_trend_ratio,
  coalesce(CASE WHEN s.revenue_prior_90d > 0 THEN CAST(s.revenue_last_90d AS DOUBLE) / CAST(s.revenue_prior_90d AS DOUBLE) END < 0.7, FALSE) AS is_declining, round(coalesce(s.units_last_30d, 0) / 30.0, 3) AS velocity_units_per_day,
  rank() OVER (ORDER BY coalesce(t.revenue_usd, 0) DESC) AS revenue_rank FROM products p LEFT JOIN totals t USING (product_id) LEFT JOIN periods s USING (product_id))
"""
