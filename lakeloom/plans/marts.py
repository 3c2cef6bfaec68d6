"""Intermediate and mart queries over the star schema. Sums are exact decimals; shares and rates are doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom import functions as fn
from lakeloom.operators import distinct, ordered, prefix
from lakeloom.operators import windows as win
from lakeloom.plans import star

#: Parameters of the marts.
DECLINING, LOW_STOCK_DAYS, ACTIVE_DAYS, RISK_DAYS = 0.7, 14, 90, 180


def _n(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def _sum_if(cond: str, value: str) -> Column:
    return F.sum(F.when(F.col(cond), F.col(value)))


def _rate(cond: Column, of: Column | None = None) -> Column:
    """Share of rows (of those where ``of`` holds) for which ``cond`` holds; null counts as false."""
    base = F.count(F.lit(1)) if of is None else F.count_if(of)
    hit = F.count_if(F.coalesce(cond, F.lit(False)) & (F.lit(True) if of is None else of))
    return F.when(base > 0, hit / base)


def _mean(value: Column) -> Column:
    """Mean of cents-exact doubles: summed as decimals, so that the order of rows doesn't matter."""
    return F.when(F.count(value) > 0, F.sum(value.cast("decimal(18,2)")).cast("double") / F.count(value))


def revenue_lines(items: DataFrame, products: DataFrame, regions: DataFrame) -> DataFrame:
    """Revenue lines with product names and region."""
    named = products.select("product_id", "product_name", "brand", "category_name", "parent_category_name", "supplier_name")
    out = items.where("is_revenue").join(named, "product_id").join(regions.select("region_code", "region_name"), "region_code", "left")
    return out.select("order_id", "order_item_id", "order_date", "order_month", "customer_id", "product_id", "product_name", "brand", "category_name",
        "parent_category_name", "supplier_id", "supplier_name", "region_code", "region_name", "quantity", "line_total_usd", "line_cost_usd",
        "gross_margin_usd")


def _periods() -> list[Column]:
    """Revenue and units of the last 90 days, the 90 before and the last 30, of lines with a column ``as_of``."""
    age = F.datediff("as_of", "order_date")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    last90, prior90, last30 = age < 90, (age >= 90) & (age < 180), age < 30
    return [
        total(last90, "line_total_usd").alias("revenue_last_90d"), total(prior90, "line_total_usd").alias("revenue_prior_90d"),
        total(last90, "quantity").alias("units_last_90d"), total(prior90, "quantity").alias("units_prior_90d"), total(last30, "quantity").alias("units_last_30d"),
    ]


def _dated(lines: DataFrame, orders: DataFrame) -> DataFrame:
    return lines.crossJoin(F.broadcast(orders.agg(F.max("order_date").alias("as_of"))))  # one row


def period_sales(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Per product: revenue and units of the last 90 days, the 90 before and the last 30, counted from the newest order."""
    return _dated(lines, orders).groupBy("product_id").agg(F.max("as_of").alias("as_of_date"), *_periods())


def customer_orders(orders: DataFrame) -> DataFrame:
    """Per customer: orders by state, revenue, refunds, first and last day, mean gap."""
    gap = F.when(F.count("days_since_prev_order") > 0, F.sum("days_since_prev_order") / F.count("days_since_prev_order"))
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"), _n(F.col("is_revenue"), "revenue_orders"), _n(F.col("is_cancelled"), "cancelled_orders"),
            _n(F.col("is_returned"), "returned_orders"),
        _sum_if("is_revenue", "order_total_usd").alias("revenue_usd"), F.sum("refunded_amount_usd").alias("refunded_usd"),
            F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"), gap.alias("avg_days_between_orders"),
    )


def shipping_enriched(shipments: DataFrame, regions: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Shipments with region, warehouse and whether they came in time."""
    out = shipments.join(regions.select("region_code", "region_name", "base_delivery_days"), "region_code",
        "left").join(warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id", "left")
    return out.withColumn("delivered_on_time", fn.sla_flag(F.col("delivery_days"), F.col("base_delivery_days")))


def active_sets(orders: DataFrame) -> DataFrame:
    """For each day (and its month) the set of customers with revenue; coarser spans are counted by merging these."""
    return distinct.id_sets(orders.where("is_revenue"), ["order_date", "order_month"], "customer_id")


def daily_sales(orders: DataFrame, items: DataFrame, dates: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """One row per day of the calendar that has orders. ``active`` are the ``active_sets`` of ``orders``, where they have been written.

    A customer has one first order, so new customers are counted as rows.
    """
    buyers = distinct.set_sizes(active_sets(orders) if active is None else active, ["order_date"], "active_customers")
    zero = F.lit("0").cast("decimal(18,2)")
    lines = items.where("is_revenue").groupBy("order_date").agg(F.sum("gross_margin_usd").alias("gross_margin_usd"), F.sum("quantity").alias("units_sold"))
    days = orders.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("orders_placed"), _n(F.col("is_revenue"), "revenue_orders"), _n(F.col("is_cancelled"), "cancelled_orders"),
            _n(F.col("is_returned"), "returned_orders"),
        _n(F.col("is_first_order") & F.col("customer_id").isNotNull(), "new_customers"),
        F.coalesce(_sum_if("is_revenue", "order_total_usd"), zero).alias("revenue_usd"), F.coalesce(_sum_if("is_revenue", "discount_usd"),
            zero).alias("discount_usd"), F.coalesce(F.sum("refunded_amount_usd"), zero).alias("refunded_usd"),
    )
    out = days.join(dates.select(F.col("full_date").alias("order_date"), "year_month", "is_weekend"), "order_date").join(lines, "order_date", "left").join(buyers, "order_date", "left")
    out = out.withColumn("active_customers", F.coalesce("active_customers", F.lit(0).cast("long")))
    out = out.withColumn("gross_margin_usd", F.coalesce("gross_margin_usd", zero)).withColumn("units_sold", F.coalesce("units_sold", F.lit(0)).cast("long"))
    return out.withColumn("avg_order_value_usd", fn.ratio(F.col("revenue_usd"), F.col("revenue_orders"))).withColumnRenamed("order_date", "sales_date")


def monthly_revenue(daily: DataFrame, orders: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Roll-up of days; active customers, who may buy on several days, by merging the days' sets (see ``daily_sales``)."""
    summed = ("orders_placed", "revenue_orders", "cancelled_orders", "returned_orders", "revenue_usd", "gross_margin_usd", "discount_usd",
        "refunded_usd", "units_sold", "new_customers")
    months = daily.groupBy("year_month").agg(F.min("sales_date").alias("month_start"), *[F.sum(c).alias(c) for c in summed])
    buyers = distinct.set_sizes(active_sets(orders) if active is None else active, ["order_month"], "active_customers").withColumnRenamed("order_month", "year_month")
    months = months.join(buyers, "year_month", "left")
    out = months.withColumn("active_customers", F.when(F.col("revenue_orders") > 0, F.coalesce("active_customers", F.lit(0).cast("long"))))
    out = out.withColumn("gross_margin_pct", fn.ratio(F.col("gross_margin_usd"), F.col("revenue_usd"))).withColumn("avg_order_value_usd",
        fn.ratio(F.col("revenue_usd"), F.col("revenue_orders")))
    return win.change_from_previous(out, "year_month", "revenue_usd", "prev_month_revenue_usd", "revenue_mom_growth")


def customer_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per customer: value, recency, stage and value decile (ties by id)."""
    zero = F.lit("0").cast("decimal(18,2)")
    out = customers.join(customer_orders(orders), "customer_id", "left").crossJoin(F.broadcast(orders.agg(F.max("order_date").alias("as_of"))))
    for c in ("total_orders", "revenue_orders", "cancelled_orders", "returned_orders"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    recency = F.datediff("as_of", "last_order_date")
    out = out.withColumn("avg_order_value_usd", fn.ratio(F.col("revenue_usd"), F.col("revenue_orders"))).withColumn("recency_days", recency)
    out = out.withColumn("lifetime_revenue_usd", F.coalesce("revenue_usd", zero)).withColumn("lifetime_refunded_usd", F.coalesce("refunded_usd", zero))
    out = out.withColumn("net_lifetime_value_usd", F.col("lifetime_revenue_usd") - F.col("lifetime_refunded_usd"))
    out = out.withColumn("lifecycle_stage", fn.band(F.col("recency_days"), [(ACTIVE_DAYS, "active"), (RISK_DAYS, "at_risk")], "churned", "never_purchased"))
    return ordered.tiles(out, [F.desc("lifetime_revenue_usd"), F.asc("customer_id")], 10, "value_decile").drop("as_of", "revenue_usd", "refunded_usd")


def product_metrics(products: DataFrame, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Per product: totals, trend of the last 90 days against the 90 before, velocity of the last 30, rank. One pass over the lines."""
    zero = F.lit("0").cast("decimal(18,2)")
    totals = _dated(star.by_order(lines, ["product_id", "order_date"]), orders).groupBy("product_id").agg(
        F.count("order_id").alias("orders"), F.sum("quantity").alias("units_sold"), F.sum("line_total_usd").alias("revenue_usd"),
            F.sum("gross_margin_usd").alias("gross_margin_usd"),
        F.countDistinct("customer_id").alias("unique_customers"), F.min("order_date").alias("first_sold_date"), F.max("order_date").alias("last_sold_date"), *_periods(),
    )
    out = products.join(totals.drop("units_last_90d", "units_prior_90d"), "product_id", "left")
    for c in ("orders", "units_sold", "unique_customers"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    for c in ("revenue_usd", "gross_margin_usd", "revenue_last_90d", "revenue_prior_90d"):
        out = out.withColumn(c, F.coalesce(c, zero))
    out = out.withColumn("revenue_trend_ratio", fn.ratio(F.col("revenue_last_90d"), F.col("revenue_prior_90d")))
    out = out.withColumn("is_declining", F.coalesce(F.col("revenue_trend_ratio") < DECLINING, F.lit(False)))
    out = out.withColumn("velocity_units_per_day", F.round(F.coalesce("units_last_30d", F.lit(0)) / F.lit(30.0), 3)).drop("units_last_30d")
    return ordered.ranked(out, "revenue_usd", "revenue_rank")


def category_revenue(lines: DataFrame) -> DataFrame:
    """Category and month with its share of the month."""
    out = lines.groupBy("parent_category_name", "category_name", "order_month").agg(
        F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("units_sold"), F.sum("line_total_usd").alias("revenue_usd"),
            F.sum("gross_margin_usd").alias("gross_margin_usd"),
    )
    return win.share_of_group(out, ["order_month"], "revenue_usd", "month_revenue_usd", "revenue_share")


def regional_performance(orders: DataFrame, shipments: DataFrame, regions: DataFrame) -> DataFrame:
    """Region and month: sales, and delivery of what was delivered."""
    sales = orders.groupBy("region_code", "order_month").agg(
        _n(F.col("is_revenue"), "revenue_orders"), _sum_if("is_revenue", "order_total_usd").alias("revenue_usd"),
            F.countDistinct(F.when(F.col("is_revenue"), F.col("customer_id"))).alias("active_customers"), _n(F.col("is_returned"),
            "returned_orders"),
    )
    ship = shipments.where("is_delivered").groupBy("region_code", "order_month").agg(F.count(F.lit(1)).alias("shipments"),
        _mean(F.col("delivery_days")).alias("avg_delivery_days"), _rate(F.col("delivered_on_time")).alias("on_time_rate"))
    out = sales.join(regions.select("region_code", "region_name"), "region_code").join(ship, ["region_code", "order_month"], "left")
    return out.withColumn("avg_order_value_usd", fn.ratio(F.col("revenue_usd"), F.col("revenue_orders")))


def inventory_turnover(inventory: DataFrame, position: DataFrame, products: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per product: stock, cost of goods shipped in 90 days, days of cover and the two low-stock flags."""
    zero = F.lit("0").cast("decimal(18,2)")
    recent = _recent(inventory, 90).where("event_type = 'shipment'").join(products.select("product_id", F.col("unit_cost").alias("_cost")), "product_id")
    shipped = recent.groupBy("product_id").agg(F.sum(-F.col("quantity_delta")).alias("units_shipped_90d"),
        F.sum((-F.col("quantity_delta") * F.col("_cost")).cast("decimal(18,2)")).alias("cogs_90d"))
    held = position.groupBy("product_id").agg(
        F.sum("on_hand_units").alias("on_hand_units"), F.sum(F.col("inventory_value_usd").cast("decimal(18,2)")).alias("inventory_value_usd"),
            F.count(F.lit(1)).alias("warehouses_stocked"), _n(F.col("on_hand_units") <= 0, "warehouses_out_of_stock"),
    )
    out = held.join(products.select("product_id", "product_name", "category_name", "supplier_name"), "product_id").join(shipped, "product_id",
        "left").join(metrics.select("product_id", "velocity_units_per_day"), "product_id", "left")
    out = out.withColumn("units_shipped_90d", F.coalesce("units_shipped_90d", F.lit(0)).cast("long")).withColumn("cogs_90d", F.coalesce("cogs_90d", zero))
    out = out.withColumn("turnover_ratio_90d", fn.ratio(F.col("cogs_90d"), F.col("inventory_value_usd")))
    v, cover = F.col("velocity_units_per_day"), fn.ratio(F.col("on_hand_units"), F.col("velocity_units_per_day"))
    out = out.withColumn("days_of_cover", F.round(cover, 1)).withColumn("is_low_stock", F.when(v.isNotNull(), F.coalesce((v > 0) & (cover < LOW_STOCK_DAYS), F.lit(False))))
    return out.withColumn("high_velocity_low_stock", F.when(v.isNotNull(), F.coalesce((v >= 1) & (cover < LOW_STOCK_DAYS), F.lit(False))))


def _recent(inventory: DataFrame, days: int) -> DataFrame:
    """Events of the last days before the newest event, not before today."""
    return inventory.crossJoin(F.broadcast(inventory.agg(F.max("event_date").alias("as_of")))).where(F.col("event_date") > F.date_sub("as_of", days))


def warehouse_performance(warehouses: DataFrame, position: DataFrame, inventory: DataFrame, shipments: DataFrame) -> DataFrame:
    """Per warehouse: stock, 90-day throughput, use of capacity, shrinkage and delivery."""
    stock = position.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("skus_stocked"), F.sum("on_hand_units").alias("on_hand_units"),
            F.sum(F.col("inventory_value_usd").cast("decimal(18,2)")).alias("inventory_value_usd"), _n(F.col("on_hand_units") <= 0,
            "skus_out_of_stock"),
    )
    of = lambda e, v: F.sum(F.when(F.col("event_type") == e, v).otherwise(0))
    delta = F.col("quantity_delta")
    recent = _recent(inventory, 90).groupBy("warehouse_id").agg(of("shipment", -delta).alias("units_shipped_90d"), of("receipt",
        delta).alias("units_received_90d"), of("adjustment", F.abs(delta)).alias("units_adjusted_90d"))
    ship = shipments.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("shipments"), _mean(F.when(F.col("is_delivered"), F.col("delivery_days"))).alias("avg_delivery_days"),
            _rate(F.col("had_exception")).alias("exception_rate"), _rate(F.col("delivered_on_time"), F.col("is_delivered")).alias("on_time_rate"),
    )
    out = warehouses.join(stock, "warehouse_id", "left").join(recent, "warehouse_id", "left").join(ship, "warehouse_id", "left")
    return out.withColumn("capacity_utilisation", fn.ratio(F.col("on_hand_units"), F.col("capacity_units"))).withColumn("shrinkage_rate_90d",
        fn.ratio(F.col("units_adjusted_90d"), F.col("units_shipped_90d")))


def supplier_performance(suppliers: DataFrame, products: DataFrame, inventory: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    """Per supplier: defects of receipts, returns and revenue of its products, rank by defects. No returns leave the return rate null."""
    zero = F.lit("0").cast("decimal(18,2)")
    receipts = inventory.where("event_type = 'receipt'").groupBy("supplier_id").agg(F.count(F.lit(1)).alias("receipts"),
        F.sum("quantity_delta").alias("units_received"), F.sum(F.coalesce("defective_qty", F.lit(0))).alias("units_defective"))
    returns = items.where("is_returned").groupBy("supplier_id").agg(F.sum("quantity").alias("_returned"))
    sales = lines.groupBy("supplier_id").agg(F.sum("quantity").alias("units_sold"), F.sum("line_total_usd").alias("revenue_usd"),
        F.sum("gross_margin_usd").alias("gross_margin_usd"))
    supplied = products.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("products_supplied"))
    out = suppliers
    for part in (supplied, receipts, returns, sales):
        out = out.join(part, "supplier_id", "left")
    out = out.withColumn("return_rate", fn.ratio(F.col("_returned"), F.col("units_sold"))).withColumn("defect_rate", fn.ratio(F.col("units_defective"), F.col("units_received")))
    out = out.withColumn("units_returned", F.coalesce("_returned", F.lit(0)).cast("long")).drop("_returned")
    for c in ("products_supplied", "receipts", "units_received", "units_defective", "units_sold"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    for c in ("revenue_usd", "gross_margin_usd"):
        out = out.withColumn(c, F.coalesce(c, zero))
    return ordered.ranked(out, "defect_rate", "defect_rank")


def shipping_performance(shipments: DataFrame) -> DataFrame:
    """Region, carrier and month: counts, mean, median and 90th percentile of days, rates.

    Shipments are counted by group and days first, with map-side combine; percentiles are picked by rank from these counts, so that no
    task holds the values of a group, and all else are sums of them.
    """
    keys, done = ["region_code", "region_name", "carrier", "order_month"], F.when(F.col("is_delivered"), F.col("delivery_days"))
    facts = {"shipments": F.lit(True), "delivered": F.col("is_delivered"), "exceptions": F.col("had_exception"), "returned": F.col("is_returned"),
        "_on_time": F.col("delivered_on_time") & F.col("is_delivered"), "_timed": done.isNotNull()}
    counted = shipments.groupBy(*keys, done.alias("_days")).agg(*[_n(v, k) for k, v in facts.items()],
        F.sum(done.cast("decimal(18,2)")).alias("_sum"), F.max("base_delivery_days").alias("sla_days"))
    sums = [F.sum(k).alias(k) for k in (*facts, "_sum")]
    out = prefix.percentiles(counted, keys, "_days", "_timed", {"median": 0.5, "p90": 0.9}, [*sums, F.max("sla_days").alias("sla_days")])
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of))
    return out.select(*keys, "shipments", "delivered", "exceptions", "returned", F.when(F.col("_timed") > 0, F.col("_sum").cast("double") / F.col("_timed")).alias("avg_delivery_days"),
        F.round("median", 6).alias("median_delivery_days"), F.round("p90", 6).alias("p90_delivery_days"), share("_on_time", "delivered").alias("on_time_rate"),
        share("exceptions", "shipments").alias("exception_rate"), "sla_days")


def order_lines_workload(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Benchmark workload over latest lines, headers and products as text: cast, join, tell invalid lines, derive money, sum by product and day, accumulate.

    Valid and rejected lines are summed in one pass, so nothing is cached or read twice. Lines arrive partitioned by order (see ``Commerce``), which the
    join with the headers keeps; products are few, and Spark broadcasts them where they are.
    """
    heads = orders.select("order_id", F.to_date(fn.ts(F.col("order_date"), "yyyy-MM-dd HH:mm:ss")).alias("order_date"))
    goods = products.select("product_id", F.col("unit_cost").try_cast("decimal(14,2)").alias("unit_cost"))
    rows = items.join(heads, "order_id", "left").join(goods, "product_id", "left")
    q, p, d = fn.integer(F.col("quantity")), F.col("unit_price").try_cast("decimal(14,2)"), F.coalesce(fn.integer(F.col("discount_pct")), F.lit(0))
    rows = rows.select("product_id", "order_date", q.cast("decimal(5,0)").alias("q"), p.alias("p"), (F.lit(100) - d).cast("decimal(3,0)").alias("share"), "unit_cost")
    valid = F.coalesce((F.col("q") > 0) & (F.col("p") > 0) & F.col("order_date").isNotNull() & F.col("unit_cost").isNotNull(), F.lit(False))
    total = F.round(F.col("q") * F.col("p") * F.col("share") * F.lit("0.01").cast("decimal(3,2)"), 2).cast("decimal(14,2)")
    rows = rows.select("product_id", "order_date", valid.alias("ok"), F.when(valid, total).alias("total"), F.when(valid,
        (total - F.col("q") * F.col("unit_cost")).cast("decimal(14,2)")).alias("margin"), F.when(valid, F.col("q").cast("long")).alias("units"))
    days = rows.groupBy("product_id", "order_date").agg(F.sum("total").alias("revenue"), F.sum("margin").alias("margin"),
        F.sum("units").alias("units"), F.count_if(~F.col("ok")).alias("rejected"))
    return win.running_sum(days, ["product_id"], ["order_date"], "revenue", "cum_revenue")
