"""Read queries over marts: filters, rankings and weighted re-aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import windows as win


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of a mart's means by how many rows each stands for. Summed as decimals, so that the order of rows doesn't matter."""
    product = (F.col(value) * F.col(weight)).cast("decimal(30,10)")
    return F.try_divide(F.sum(product).cast("double"), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).cast("double"))


def between(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows in a closed range; a missing limit is none."""
    out = df if first is None else df.where(F.col(column) >= F.lit(first))
    return out if last is None else out.where(F.col(column) <= F.lit(last))


def sales(daily: DataFrame, first: str | None = None, last: str | None = None, limit: int = 400) -> DataFrame:
    """Newest days of a range."""
    return between(daily, "sales_date", first, last).orderBy(F.desc("sales_date")).limit(limit)


def sales_totals(daily: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    rows = between(daily, "sales_date", first, last)
    return rows.agg(F.sum("revenue_usd").alias("revenue_usd"), F.sum("orders_placed").alias("orders_placed"),
        F.sum("gross_margin_usd").alias("gross_margin_usd"), F.sum("units_sold").alias("units_sold"))


def categories(mart: DataFrame, month: str | None = None, limit: int = 20) -> DataFrame:
    """Categories of a month, or summed over all, by revenue."""
    names = ["parent_category_name", "category_name"]
    if month is not None:
        return mart.where(F.col("order_month") == month).select(*names, "orders", "units_sold", "revenue_usd",
            "gross_margin_usd").orderBy(F.desc("revenue_usd"), *names).limit(limit)
    sums = mart.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("orders", "units_sold", "revenue_usd", "gross_margin_usd")])
    return sums.orderBy(F.desc("revenue_usd"), *names).limit(limit)


def products(metrics: DataFrame, declining: bool = False, limit: int = 20) -> DataFrame:
    """Best sellers, or declining products by what they sold before."""
    if declining:
        return metrics.where("is_declining").orderBy(F.desc("revenue_prior_90d"), "product_id").limit(limit)
    return metrics.orderBy(F.desc("revenue_usd"), "product_id").limit(limit)


def inventory_summary(turnover: DataFrame) -> DataFrame:
    return turnover.agg(F.count(F.lit(1)).alias("products"), F.sum("on_hand_units").alias("on_hand_units"),
        F.sum("inventory_value_usd").alias("inventory_value_usd"), F.count_if("is_low_stock").alias("low_stock"),
        F.count_if("high_velocity_low_stock").alias("high_velocity_low_stock"))


def low_stock(turnover: DataFrame, limit: int = 25) -> DataFrame:
    """Products that run out soon or turn fast, soonest first; no cover known comes last."""
    return turnover.where("is_low_stock OR turnover_ratio_90d >= 1").orderBy(F.asc_nulls_last("days_of_cover"), "product_id").limit(limit)


def customers_top(ltv: DataFrame, limit: int = 20) -> DataFrame:
    return ltv.orderBy(F.desc("net_lifetime_value_usd"), "customer_id").limit(limit)


def customers_by(ltv: DataFrame, column: str) -> DataFrame:
    """Customers and value by stage or segment, most valuable first."""
    return ltv.groupBy(column).agg(F.count(F.lit(1)).alias("customers"),
        F.sum("net_lifetime_value_usd").alias("net_lifetime_value_usd")).orderBy(F.desc("net_lifetime_value_usd"), column)


def customer_segments(ltv: DataFrame) -> DataFrame:
    """Customers of each segment and their mean net value, most valuable first."""
    mean = F.round(F.sum("net_lifetime_value_usd").cast("double") / F.count(F.lit(1)), 6)
    return ltv.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"), mean.alias("avg_net_value_usd")).orderBy(F.desc("avg_net_value_usd"), "customer_segment")


def shipping_by(mart: DataFrame, *columns: str, month: str | None = None) -> DataFrame:
    """Delivery by region, carrier or month: means weighted by deliveries, rates by shipments."""
    rows = mart if month is None else mart.where(F.col("order_month") == month)
    return rows.groupBy(*columns).agg(F.sum("shipments").alias("shipments"), F.sum("delivered").alias("delivered"), weighted_mean("avg_delivery_days",
        "delivered").alias("avg_delivery_days"), weighted_mean("exception_rate", "shipments").alias("exception_rate"),
        F.max("sla_days").alias("sla_days"))


def suppliers_by_defects(mart: DataFrame, limit: int = 20) -> DataFrame:
    return mart.orderBy(F.desc_nulls_last("defect_rate"), "supplier_id").limit(limit)


def overview(daily: DataFrame, ltv: DataFrame, turnover: DataFrame, shipping: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    money = daily.agg(F.sum("revenue_usd").alias("revenue_usd"), F.sum("orders_placed").alias("orders"), F.max("sales_date").alias("newest_day"))
    people = ltv.agg(F.count_if(F.col("lifecycle_stage") == "active").alias("active_customers"))
    stock = turnover.agg(F.count_if("is_low_stock").alias("low_stock_products"))
    days = shipping.agg(weighted_mean("avg_delivery_days", "delivered").alias("avg_delivery_days"))
    return money.crossJoin(people).crossJoin(stock).crossJoin(days)  # one row each


def rolling_revenue(daily: DataFrame) -> DataFrame:
    """Mean revenue of the last seven days that have sales; null for the first six."""
    return win.rolling_mean(daily.select("sales_date", F.col("revenue_usd")), "sales_date", "revenue_usd", 7, "rolling_7d_usd")


def rule_results(stats: DataFrame, failed_only: bool = False) -> DataFrame:
    """Rules of the newest run (by ``checked_at``), most failures first."""
    newest = stats.agg(F.max("checked_at").alias("_at"))
    rows = stats.join(F.broadcast(newest), stats["checked_at"] == newest["_at"]).drop("_at")
    return (rows.where("failed > 0") if failed_only else rows).orderBy(F.desc("failed"), "rule_id")


def quality_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("stage").agg(F.count(F.lit(1)).alias("rules"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("broken"), F.sum("failed").alias("failed_rows"))


def monthly_against_daily(monthly: DataFrame, daily: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Revenue of every month from both marts, and whether they agree; a month that one of them lacks doesn't."""
    days = daily.groupBy("year_month").agg(F.sum("revenue_usd").alias("daily_usd"))
    both = monthly.select("year_month", F.col("revenue_usd").alias("monthly_usd")).join(days, "year_month", "full_outer")
    return both.withColumn("matches", F.coalesce(F.abs(F.col("monthly_usd") - F.col("daily_usd")) <= tolerance, F.lit(False)))


def sales_monthly(monthly: DataFrame, first: str | None = None, last: str | None = None, limit: int = 400) -> DataFrame:
    """Newest months whose first day lies in a range."""
    columns = ["year_month", "month_start", "orders_placed", "revenue_orders", "revenue_usd", "gross_margin_usd", "gross_margin_pct", "units_sold",
        "active_customers", "new_customers", "avg_order_value_usd", "revenue_mom_growth"]
    return between(monthly, "month_start", first, last).select(*columns).orderBy(F.desc("year_month")).limit(limit)


def revenue_by_parent(mart: DataFrame) -> DataFrame:
    """Revenue of top-level categories, largest first."""
    return mart.groupBy("parent_category_name").agg(F.sum("revenue_usd").alias("revenue_usd")).orderBy(F.desc("revenue_usd"), "parent_category_name")


def revenue_by_parent_and_month(mart: DataFrame) -> DataFrame:
    return mart.groupBy("order_month", "parent_category_name").agg(F.sum("revenue_usd").alias("revenue_usd")).orderBy("order_month", "parent_category_name")


def revenue_by_region(mart: DataFrame) -> DataFrame:
    """Revenue of regions and their delivery days, weighted by shipments; largest first."""
    by = mart.groupBy("region_name").agg(F.sum("revenue_usd").alias("revenue_usd"), F.round(weighted_mean("avg_delivery_days", "shipments"), 6).alias("delivery_days"))
    return by.orderBy(F.desc("revenue_usd"), "region_name")


def turnover_by_category(turnover: DataFrame, limit: int | None = 20) -> DataFrame:
    """Mean turnover of the products of a category that have one, fastest first."""
    mean = F.sum(F.col("turnover_ratio_90d").cast("decimal(30,12)")).cast("double") / F.count("turnover_ratio_90d")
    out = turnover.where("turnover_ratio_90d IS NOT NULL").groupBy("category_name").agg(F.round(mean, 6).alias("turnover")).orderBy(F.desc("turnover"), "category_name")
    return out if limit is None else out.limit(limit)


def low_warehouses(mart: DataFrame) -> DataFrame:
    """Warehouses by how many of their products are out of stock."""
    return mart.select("warehouse_name", "on_hand_units", "skus_out_of_stock", F.round("capacity_utilisation",
        3).alias("utilisation")).orderBy(F.desc_nulls_last("skus_out_of_stock"), "warehouse_name")


def defective_suppliers(mart: DataFrame, least_units: int = 1000, limit: int = 10) -> DataFrame:
    """Suppliers of more than ``least_units`` received units with the highest defect rate."""
    rows = mart.where(F.col("units_received") > least_units).select("supplier_name", "units_received", "units_defective", F.round("defect_rate", 4).alias("defect_rate"))
    return rows.orderBy(F.desc("defect_rate"), "supplier_name").limit(limit)


def delivery_by_region(mart: DataFrame) -> DataFrame:
    """Delivery days and share in time by region, both weighted by deliveries."""
    days, rate = (F.round(weighted_mean(c, "delivered"), n) for c, n in (("avg_delivery_days", 2), ("on_time_rate", 3)))
    return mart.groupBy("region_name").agg(days.alias("avg_days"), rate.alias("on_time_rate")).orderBy("avg_days", "region_name")


def fast_and_low(turnover: DataFrame, limit: int = 20) -> DataFrame:
    """Products that sell fast and run out soon."""
    rows = turnover.where("high_velocity_low_stock").select("product_id", "product_name", "on_hand_units", "velocity_units_per_day", "days_of_cover")
    return rows.orderBy("days_of_cover", "product_id").limit(limit)


def drift_of_run(events: DataFrame, run_id: str) -> DataFrame:
    """What changed in the deliveries of a run."""
    return events.where(F.col("run_id") == run_id).select("dataset", "change", "column", "severity").orderBy("dataset", "column")


def newest_drift(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.desc("detected_at"), "dataset", "column").limit(limit)
