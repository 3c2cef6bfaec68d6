"""Staging: thin projections that marts read in place of warehouse tables. Columns are fixed by the warehouse's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Warehouse table and columns of every staging table; ``new=old`` renames.
STAGING: dict[str, tuple[str, str]] = {
    "stg_customers": ("dim_customer", "customer_key customer_id full_name customer_segment country_code region_code region_key city signup_date marketing_opt_in"),
    "stg_dates": ("dim_date", "date_key full_date year quarter month month_name year_month week_of_year=iso_week day_of_week day_name is_weekend"),
    "stg_inventory_events": ("fact_inventory", """inventory_event_key event_id product_key product_id warehouse_key warehouse_id supplier_key supplier_id event_ts event_date event_month
        event_type quantity_delta on_hand_after unit_cost receipt_value_usd defective_qty counted_quantity reason"""),
    "stg_inventory_position": ("agg_inventory_position", """position_key product_key product_id warehouse_key warehouse_id on_hand_units avg_unit_cost_usd inventory_value_usd units_received
        units_shipped units_defective last_receipt_ts last_shipment_ts last_event_ts"""),
    "stg_order_items": ("fact_order_items", """order_item_key order_item_id order_key order_id product_key product_id category_key supplier_key customer_key region_key order_date order_month
        order_ts status quantity unit_price_usd discount_pct line_total_usd unit_cost_usd line_cost_usd gross_margin_usd is_revenue is_returned loaded_at=_loaded_at"""),
    "stg_orders": ("fact_orders", """order_key order_id customer_key customer_id region_key region_code order_date_key order_ts order_date order_month status channel currency coupon_code
        order_total_local order_total_usd gross_amount_usd discount_usd lines_total_usd lines_reconciled item_count total_quantity paid_at captured_amount_usd refunded_amount_usd
        failed_payment_attempts is_cancelled is_returned is_revenue customer_order_seq days_since_prev_order is_first_order updated_at loaded_at=_loaded_at"""),
    "stg_products": ("dim_product", """product_key product_id sku product_name brand category_key category_id category_name parent_category_name supplier_key supplier_id supplier_name
        unit_price_usd=unit_price unit_cost_usd=unit_cost unit_margin_usd=unit_margin is_active has_negative_margin=is_negative_margin"""),
    "stg_regions": ("dim_region", "region_key region_code region_name country_code country_name currency_code base_delivery_days"),
    "stg_shipments": ("fact_shipping", """shipment_key shipment_id order_key order_id customer_key warehouse_key warehouse_id region_key region_code carrier order_date order_month
        label_created_ts delivered_ts exception_ts returned_ts delivery_hours delivery_days is_delivered had_exception is_returned timeline_inconsistent"""),
    "stg_suppliers": ("dim_supplier", "supplier_key supplier_id supplier_name country_code region_code lead_time_days quality_tier is_active"),
    "stg_warehouses": ("dim_warehouse", "warehouse_key warehouse_id warehouse_name city region_code region_key capacity_units"),
}


def columns(name: str) -> list[tuple[str, str]]:
    """(new, old) name of every column."""
    return [tuple(x.split("=")) if "=" in x else (x, x) for x in STAGING[name][1].split()]


def stage(name: str, table: DataFrame) -> DataFrame:
    """The projection; a column that the warehouse table lacks is null text."""
    return table.select(*[(F.col(old) if old in table.columns else F.lit(None).cast("string")).alias(new) for new, old in columns(name)])
