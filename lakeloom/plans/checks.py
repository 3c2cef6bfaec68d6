"""Checks of the warehouse and tests of the marts as data, and one runner for both.

A check names a table, what is tested, the share of failures that is allowed, and a severity. The runner makes one aggregation per table
for all its checks: each table is planned once, whatever is asked of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``kind`` is ``unique`` (columns), ``reference`` (column, parent table and column), ``holds`` (predicate) or ``known`` (column is not null)."""

    name: str
    table: str
    kind: str
    columns: tuple[str, ...] = ()
    predicate: str = ""
    parent: tuple[str, str] = ("", "")
    limit: float = 0.0
    severity: str = "error"


def _unique(table: str, *columns: str) -> Check:
    return Check(f"{table}.{'_'.join(columns)}_unique", table, "unique", columns)


def _reference(table: str, column: str, parent: str, parent_column: str | None = None) -> Check:
    return Check(f"{table}.{column}_ri", table, "reference", (column,), parent=(parent, parent_column or column))


def _holds(table: str, name: str, predicate: str, limit: float = 0.0, severity: str = "error") -> Check:
    return Check(f"{table}.{name}", table, "holds", predicate=predicate, limit=limit, severity=severity)


def _known(table: str, column: str, limit: float = 0.0) -> Check:
    return Check(f"{table}.{column}_null_rate", table, "known", (column,), limit=limit)


#: Checks of facts and dimensions: keys, references, ranges, null rates, reconciliation.
WAREHOUSE = (
    _unique("fact_orders", "order_id"),
    _unique("fact_order_items", "order_item_id"),
    _unique("fact_inventory", "event_id"),
    _unique("fact_shipping", "shipment_id"),
    _unique("dim_customer", "customer_id"),
    _unique("dim_product", "product_id"),
    _reference("fact_orders", "customer_id", "dim_customer"),
    _reference("fact_orders", "region_code", "dim_region"),
    _reference("fact_order_items", "product_id", "dim_product"),
    _reference("fact_order_items", "order_id", "fact_orders"),
    _reference("fact_inventory", "product_id", "dim_product"),
    _reference("fact_inventory", "warehouse_id", "dim_warehouse"),
    _reference("fact_shipping", "order_id", "fact_orders"),
    _reference("dim_product", "category_id", "dim_category"),
    _reference("dim_product", "supplier_id", "dim_supplier"),
    _holds("fact_order_items", "quantity_positive", "quantity > 0"),
    _holds("fact_order_items", "unit_price_positive", "unit_price_usd > 0"),
    _holds("fact_orders", "total_non_negative", "order_total_usd >= 0"),
    _holds("fact_orders", "fx_present", "fx_usd_per_unit IS NOT NULL AND fx_usd_per_unit > 0"),
    _holds("fact_shipping", "delivery_days_non_negative", "delivery_days IS NULL OR delivery_days >= 0"),
    _holds("dim_product", "price_positive", "unit_price > 0"),
    _holds("fact_orders", "status_allowed", "status IN ('placed', 'paid', 'shipped', 'delivered', 'cancelled', 'returned')"),
    _known("fact_orders", "region_code", 0.02),
    _known("dim_customer", "email", 0.05),
    _holds("fact_orders", "lines_reconciled_rate", "NOT is_revenue OR lines_reconciled", 0.10, "warn"),
)

#: Tests of the tables that the marts read: surrogate and business keys, references between surrogate keys, allowed values.
SOURCES = (
    *[check(t, c) for t, columns in (("dim_customer", "customer_key customer_id"), ("dim_product", "product_key product_id"), ("fact_orders", "order_key order_id"),
        ("fact_order_items", "order_item_key"), ("fact_inventory", "inventory_event_key"), ("fact_shipping", "shipment_key"),
        ("agg_inventory_position", "position_key")) for c in columns.split() for check in (_unique, _known)],
    _known("fact_orders", "customer_key"),
    _reference("fact_orders", "customer_key", "dim_customer"),
    _holds("fact_orders", "status_accepted", "status IN ('placed', 'paid', 'shipped', 'delivered', 'cancelled', 'returned')"),
    _known("fact_order_items", "product_key"),
    _reference("fact_order_items", "product_key", "dim_product"),
    _reference("fact_order_items", "order_key", "fact_orders"),
    _holds("fact_order_items", "quantity_positive", "quantity > 0"),
    _holds("fact_inventory", "event_type_accepted", "event_type IN ('receipt', 'shipment', 'adjustment', 'return', 'stock_count')"),
)

#: Tests of the intermediate tables.
INTERMEDIATE = (
    *[check(t, c) for t, c in (("int_revenue_lines", "order_item_key"), ("int_product_period_sales", "product_key"), ("int_customer_orders", "customer_key"),
        ("int_shipping_enriched", "shipment_key")) for check in (_unique, _known)],
    _holds("int_revenue_lines", "line_total_non_negative", "line_total_usd >= 0"),
)

#: Tests of the marts: keys, values that may not be missing or negative, allowed values.
MARTS = (
    _unique("daily_sales", "sales_date"),
    _known("daily_sales", "sales_date"),
    _known("daily_sales", "revenue_usd"),
    _holds("daily_sales", "revenue_non_negative", "revenue_usd >= 0"),
    _holds("daily_sales", "revenue_orders_non_negative", "revenue_orders >= 0"),
    _unique("monthly_revenue", "year_month"),
    _known("monthly_revenue", "year_month"),
    _known("monthly_revenue", "revenue_usd"),
    _holds("monthly_revenue", "revenue_non_negative", "revenue_usd >= 0"),
    _unique("customer_ltv", "customer_id"),
    _known("customer_ltv", "customer_id"),
    _reference("customer_ltv", "customer_id", "dim_customer"),
    _holds("customer_ltv", "lifetime_revenue_non_negative", "lifetime_revenue_usd >= 0"),
    _holds("customer_ltv", "lifecycle_stage_allowed", "lifecycle_stage IN ('never_purchased', 'active', 'at_risk', 'churned')"),
    _unique("product_metrics", "product_id"),
    _known("product_metrics", "product_id"),
    _holds("product_metrics", "revenue_non_negative", "revenue_usd >= 0"),
    _holds("product_metrics", "velocity_non_negative", "velocity_units_per_day >= 0"),
    _unique("category_revenue", "category_name", "order_month"),
    _unique("regional_performance", "region_code", "order_month"),
    _unique("inventory_turnover", "product_id"),
    _known("inventory_turnover", "product_id"),
    _known("inventory_turnover", "inventory_value_usd"),
    _unique("warehouse_performance", "warehouse_id"),
    _known("warehouse_performance", "warehouse_id"),
    _unique("supplier_performance", "supplier_id"),
    _known("supplier_performance", "supplier_id"),
    _holds("supplier_performance", "defect_rate_range", "defect_rate BETWEEN 0 AND 1"),
    _holds("shipping_performance", "avg_delivery_days_non_negative", "avg_delivery_days >= 0"),
)


def _row(check: Check, total: Column, failed: Column) -> list[Column]:
    return [F.lit(check.name).alias("check_name"), F.lit(check.severity).alias("severity"), F.lit(check.limit).alias("threshold"),
        total.alias("total"), failed.cast("long").alias("failed")]


def _judge(rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("total") > 0, F.round(F.col("failed") / F.col("total"), 6)).otherwise(0.0)
    return rows.withColumn("failure_rate", rate).withColumn("passed", rate <= F.col("threshold"))


def run(checks: Sequence[Check], tables: Mapping[str, DataFrame]) -> DataFrame:
    """``check_name``, ``severity``, ``threshold``, ``total``, ``failed``, ``failure_rate`` and ``passed`` of every check whose table is given."""
    parts = []
    for name in dict.fromkeys(c.table for c in checks if c.table in tables):
        rows, mine = tables[name], [c for c in checks if c.table == name]
        sums = [F.count(F.lit(1)).alias("total")]
        for i, c in enumerate(mine):  # one pass over the table: its references as joins with different keys, all checks as sums
            if c.kind == "reference":
                keys = tables[c.parent[0]].select(F.col(c.parent[1]).alias(f"_parent{i}")).distinct()
                rows = rows.join(keys, F.col(c.columns[0]) == F.col(f"_parent{i}"), "left")
                bad = F.count_if(F.col(c.columns[0]).isNotNull() & F.col(f"_parent{i}").isNull())
            elif c.kind == "unique":
                whole = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c.columns])
                bad = F.count(F.lit(1)) - F.countDistinct(F.when(whole, F.struct(*c.columns)))
            else:
                bad = F.count_if(F.col(c.columns[0]).isNull() if c.kind == "known" else ~F.expr(c.predicate))
            sums.append(bad.alias(f"f{i}"))
        each = F.array(*[F.struct(*_row(c, F.col("total"), F.col(f"f{i}"))) for i, c in enumerate(mine)])
        parts.append(rows.agg(*sums).select(F.explode(each).alias("r")).select("r.*"))
    return _judge(reduce(DataFrame.unionByName, parts))


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that appear more than once, and how often."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def freshness(orders: DataFrame, loaded: str, day: str, now: Column, batch: Column) -> DataFrame:
    """The pair of freshness checks: loaded within 24 hours of ``now`` (warning), newest day at most two days before the batch (error)."""
    newest = orders.agg(F.max(loaded).alias("loaded"), F.max(day).alias("day"))
    late = F.coalesce(F.col("loaded") < now - F.expr("INTERVAL 24 HOURS"), F.lit(True))
    short = F.coalesce(F.col("day") < F.date_sub(batch, 2), F.lit(True))
    row = lambda name, severity, bad: F.struct(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"),
        F.lit(1).cast("long").alias("total"), bad.cast("long").alias("failed"))
    both = F.array(row("fact_orders.loaded_recently", "warn", late), row("fact_orders.covers_batch", "error", short))
    return newest.select(F.explode(both).alias("r")).select("r.*")


def sql(checks: Sequence[Check], tables: Mapping[str, str]) -> str:
    """The same in DuckDB's SQL, over named tables."""

    def one(c: Check) -> str:
        table = tables[c.table]
        match c.kind:
            case "unique":
                whole = " AND ".join(f"{x} IS NOT NULL" for x in c.columns)
                failed = f"count(*) - count(DISTINCT CASE WHEN {whole} THEN ({', '.join(c.columns)}) END)"
            case "reference":
                failed = f"count(*) FILTER ({c.columns[0]} IS NOT NULL AND {c.columns[0]} NOT IN (SELECT {c.parent[1]} FROM {tables[c.parent[0]]} WHERE {c.parent[1]} IS NOT NULL))"
            case "holds":
                failed = f"count(*) FILTER (NOT ({c.predicate}))"
            case "known":
                failed = f"count(*) FILTER ({c.columns[0]} IS NULL)"
        return f"SELECT '{c.name}' AS check_name, '{c.severity}' AS severity, CAST({c.limit} AS DOUBLE) AS threshold, count(*) AS total, {failed} AS failed FROM {table}"

    rows = " UNION ALL ".join(one(c) for c in checks if c.table in tables)
    return f"SELECT *, CASE WHEN total > 0 THEN round(failed / total, 6) ELSE 0 END AS failure_rate, CASE WHEN total > 0 THEN round(failed / total, 6) ELSE 0 END <= threshold AS passed FROM ({rows})"
