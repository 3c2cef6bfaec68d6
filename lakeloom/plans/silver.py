"""Typed tables from landed text: one specification per dataset, one plan for all."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom import functions as fn
from lakeloom.operators import merge, publish, rules
from lakeloom.operators.dedup import drop_exact_duplicates, keep_latest_of_few
from lakeloom.operators.rules import Rule, Suite
from lakeloom.operators.scratch import drop, scratch, shuffles_dropped
from lakeloom.sources.landing import Contract

# Fixed values of the deliveries.
STATUSES = ["placed", "paid", "shipped", "delivered", "cancelled", "returned"]
CHANNELS = ["web", "mobile_app", "marketplace", "store"]
CURRENCIES = ["USD", "CAD", "EUR", "GBP", "SEK", "INR", "SGD", "AUD", "BRL", "AED"]
PAYMENT_METHODS = ["credit_card", "debit_card", "wallet", "bank_transfer", "cash_on_delivery", "refund"]
PAYMENT_STATUSES = ["captured", "failed", "refunded", "authorized"]
SEGMENTS = ["consumer", "business", "vip"]
STOCK_EVENTS = ["receipt", "shipment", "adjustment", "return", "stock_count"]
TRACKER_EVENTS = ["label_created", "picked_up", "in_transit", "out_for_delivery", "delivered", "delivery_exception", "returned"]
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
#: Spellings of countries in deliveries, by code; letter case and outer blanks don't matter.
COUNTRIES = {
    "US": ("United States", "USA", "U.S.", "United States of America"),
    "CA": ("Canada", "CAN"),
    "DE": ("Germany", "Deutschland"),
    "GB": ("United Kingdom", "UK", "U.K.", "Great Britain"),
    "ES": ("Spain", "España"),
    "SE": ("Sweden",),
    "IN": ("India", "IND"),
    "SG": ("Singapore",),
    "AU": ("Australia", "AUS"),
    "BR": ("Brazil", "Brasil"),
    "AE": ("United Arab Emirates", "UAE", "U.A.E."),
}

_LINEAGE = ("_batch_id", "_source_file", "_ingested_at", "_run_id", "_row_number")

CONTRACTS = {c.dataset: c for c in (
    Contract("customers", ("customer_id", "first_name", "last_name", "email", "signup_date", "country", "region_code", "updated_at"), ("phone",
        "birth_date", "customer_segment", "city", "street_address", "marketing_opt_in"), ("customer_id",), "updated_at"),
    Contract("products", ("product_id", "sku", "name", "category_id", "supplier_id", "unit_price", "unit_cost", "currency", "is_active",
        "updated_at"), ("brand", "weight_kg", "dimensions_cm", "attributes", "created_at"), ("product_id",), "updated_at"),
    Contract("categories", ("category_id", "category_name", "level"), ("parent_category_id",), ("category_id",)),
    Contract("suppliers", ("supplier_id", "supplier_name", "country_code"), ("region_code", "lead_time_days", "quality_tier", "active"), ("supplier_id",)),
    Contract("orders", ("order_id", "customer_id", "order_date", "status", "currency", "order_total", "updated_at"), ("channel", "region_code",
        "shipping_country", "coupon_code"), ("order_id",), "updated_at"),
    Contract("order_items", ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total"), ("discount_pct", "currency"), ("order_item_id",)),
    Contract("payments", ("payment_id", "order_id", "payment_method", "amount", "currency", "status", "paid_at"), (), ("payment_id",)),
    Contract("inventory_events", ("event_id", "event_type", "product_id", "warehouse_id", "quantity_delta", "event_ts"), ("reference_id",
        "supplier_id", "unit_cost", "defective_qty", "counted_quantity", "reason", "source_system"), ("event_id",)),
    Contract("shipping_events", ("event_ts", "event", "shipment_id", "order_id"), ("level", "component", "carrier", "warehouse_id", "region",
        "location"), ("shipment_id", "event", "event_ts")),
    Contract("regions", ("region_code", "region_name", "country_code", "country_name", "currency_code"), ("base_delivery_days", "timezone"), ("region_code",)),
    Contract("warehouses", ("warehouse_id", "warehouse_name", "region_code"), ("city", "capacity_units", "opened_date"), ("warehouse_id",)),
    Contract("exchange_rates", ("rate_date", "currency_code", "usd_per_unit"), (), ("rate_date", "currency_code")),
)}


def _rule(dataset: str, name: str, check: str, column: str | None = None, severity: str = "reject", **params) -> Rule:
    return Rule(f"{dataset}.{name}", check, severity, column, params)


def _suites() -> dict[str, Suite]:
    """All rules. Columns that end in ``_t`` are typed casts, in ``_n`` normalised texts, made by the projections below."""
    c, p, o, i, m, s, t = (partial(_rule, d) for d in ("customers", "products", "orders", "order_items", "payments", "inventory_events", "shipping_events"))
    fk = lambda r, name, column, ref, key=None, severity="reject": r(name, "fk", column, severity, ref=ref, ref_column=key or column)
    typed = lambda r, name, column, severity="reject": r(name, "castable", column, severity, typed=f"{column}_t")
    allowed = lambda r, name, column, values, severity="reject": r(name, "in_set", column, severity, values=values)
    above = lambda r, name, column, op: r(name, "compare", column, op=op, value=0)
    return {x.dataset: x for x in (
        Suite("customers", (
            c("customer_id_not_null", "not_null", "customer_id"), c("customer_id_format", "regex", "customer_id", pattern=r"^CUST-\d{6}$"),
                c("email_format", "regex", "email_n", "warn", pattern=EMAIL), c("email_present", "not_null", "email_n", "warn"),
            typed(c, "signup_date_valid", "signup_date", "warn"), c("signup_date_not_future", "not_future", "signup_date_t", "warn"), typed(c,
                "updated_at_valid", "updated_at"), allowed(c, "segment_allowed", "customer_segment_n", SEGMENTS),
            fk(c, "region_known", "region_code", "regions"), c("country_recognised", "not_null", "country_code_n", "warn"), typed(c, "birth_date_valid", "birth_date", "warn"),
        )),
        Suite("products", (
            p("product_id_not_null", "not_null", "product_id"), p("product_id_format", "regex", "product_id", pattern=r"^PRD-\d{5}$"),
                p("unit_price_not_null", "not_null", "unit_price"), typed(p, "unit_price_numeric", "unit_price"), above(p, "unit_price_positive",
                "unit_price_t", ">"),
            typed(p, "unit_cost_numeric", "unit_cost"), above(p, "unit_cost_non_negative", "unit_cost_t", ">="), p("margin_non_negative",
                "compare_cols", None, "warn", left="unit_cost_t", op="<=", right="unit_price_t"),
            fk(p, "category_known", "category_id", "categories"), fk(p, "supplier_known", "supplier_id", "suppliers"), allowed(p, "currency_allowed",
                "currency_n", CURRENCIES), typed(p, "is_active_boolean", "is_active"), typed(p, "updated_at_valid", "updated_at"),
            p("dimensions_parseable", "expr", None, "warn", expression="dimensions_cm IS NULL OR length_cm_t IS NOT NULL"),
        )),
        Suite("orders", (
            o("order_id_not_null", "not_null", "order_id"), o("order_id_format", "regex", "order_id", pattern=r"^ORD-\d{7}$"), fk(o, "customer_known",
                "customer_id", "customers"), o("order_date_not_null", "not_null", "order_date"), typed(o, "order_date_valid", "order_date"),
            o("order_date_not_future", "not_future", "order_date_t"), allowed(o, "status_allowed", "status_n", STATUSES), allowed(o,
                "currency_allowed", "currency_n", CURRENCIES), typed(o, "order_total_numeric", "order_total"), above(o, "order_total_non_negative",
                "order_total_t", ">="),
            typed(o, "updated_at_valid", "updated_at"), allowed(o, "channel_allowed", "channel_n", CHANNELS, "warn"), o("region_present", "not_null", "region_code_n", "warn"),
        )),
        Suite("order_items", (
            i("order_item_id_not_null", "not_null", "order_item_id"), fk(i, "order_known", "order_id", "orders"), fk(i, "product_known", "product_id",
                "products"), i("quantity_not_null", "not_null", "quantity"), typed(i, "quantity_integer", "quantity"),
            above(i, "quantity_positive", "quantity_t", ">"), typed(i, "unit_price_numeric", "unit_price"), above(i, "unit_price_positive",
                "unit_price_t", ">"), i("discount_range", "expr",
                expression="discount_pct_t IS NULL OR (discount_pct_t >= 0 AND discount_pct_t <= 100)"),
            typed(i, "line_total_numeric", "line_total"), i("line_total_consistent", "expr", None, "warn", expression="ABS(line_total_t - line_total_calc) <= 0.05"),
        ), 0.10),
        Suite("payments", (
            m("payment_id_not_null", "not_null", "payment_id"), fk(m, "order_known", "order_id", "orders"), allowed(m, "method_allowed",
                "payment_method_n", PAYMENT_METHODS), allowed(m, "status_allowed", "status_n", PAYMENT_STATUSES), typed(m, "amount_numeric",
                "amount"),
            m("paid_at_not_null", "not_null", "paid_at"), typed(m, "paid_at_valid", "paid_at"), m("amount_matches_order", "expr", None, "warn",
                expression="status_n <> 'captured' OR order_total_ref IS NULL OR ABS(amount_t - order_total_ref) <= 0.05"),
        ), 0.10),
        Suite("inventory_events", (
            s("event_id_not_null", "not_null", "event_id"), allowed(s, "event_type_allowed", "event_type_n", STOCK_EVENTS), fk(s, "product_known",
                "product_id", "products"), fk(s, "warehouse_known", "warehouse_id", "warehouses"), s("quantity_delta_not_null", "not_null",
                "quantity_delta"),
            typed(s, "quantity_delta_integer", "quantity_delta"), s("event_ts_not_null", "not_null", "event_ts"), typed(s, "event_ts_valid",
                "event_ts"), s("event_ts_not_future", "not_future", "event_ts_t"),
            s("sign_matches_type", "expr",
                expression="(event_type_n IN ('receipt','return') AND quantity_delta_t >= 0) OR (event_type_n = 'shipment' AND quantity_delta_t <= 0) OR event_type_n IN ('adjustment','stock_count') OR event_type_n IS NULL OR quantity_delta_t IS NULL"),
                
            s("defective_within_received", "expr", None, "warn", expression="defective_qty_t IS NULL OR quantity_delta_t IS NULL OR defective_qty_t <= quantity_delta_t"),
        )),
        Suite("shipping_events", (
            t("event_ts_not_null", "not_null", "event_ts"), typed(t, "event_ts_valid", "event_ts"), allowed(t, "event_allowed", "event_n",
                TRACKER_EVENTS), t("shipment_id_format", "regex", "shipment_id", pattern=r"^SHP-\d{7}$"), t("order_id_not_null", "not_null",
                "order_id_n"),
            fk(t, "order_known", "order_id_n", "orders", "order_id"), fk(t, "warehouse_known", "warehouse_id", "warehouses", severity="warn"),
                t("carrier_present", "not_null", "carrier", "warn"),
        ), 0.10),
    )}


SUITES = _suites()


@dataclass(frozen=True)
class Spec:
    """How a dataset becomes a typed table: added columns, then (after the rules) the final projection.

    ``replaced`` names the delivered columns that ``transform`` replaces, ``near`` those by which it joins a large parent.
    """

    dataset: str
    transform: Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]
    final: Sequence[tuple[str, str]]
    partition: str | None = None
    needs: Sequence[str] = field(default_factory=tuple)
    replaced: Sequence[str] = field(default_factory=tuple)
    near: Sequence[str] = field(default_factory=tuple)

    @property
    def contract(self) -> Contract:
        return CONTRACTS[self.dataset]

    @property
    def suite(self) -> Suite:
        return SUITES.get(self.dataset, Suite(self.dataset, ()))


def _add(df: DataFrame, **columns) -> DataFrame:
    return df.withColumns(columns)


def _customers(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    df = _add(df, customer_id=fn.upper(col("customer_id")), region_code=fn.upper(col("region_code")))
    return _add(df, email_n=fn.lower(col("email")), customer_segment_n=fn.lower(col("customer_segment")), country_code_n=fn.alias_code(col("country"),
        COUNTRIES), signup_date_t=fn.date(col("signup_date")), birth_date_t=fn.date(col("birth_date")), updated_at_t=fn.ts(col("updated_at")))


def _products(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    dims = fn.parse_json(col("dimensions_cm"), "length double, width double, height double")
    return _add(df, unit_price_t=fn.num(col("unit_price")), unit_cost_t=fn.num(col("unit_cost")), weight_kg_t=fn.num(col("weight_kg")),
        currency_n=fn.upper(col("currency")), is_active_t=fn.boolean(col("is_active")), updated_at_t=fn.ts(col("updated_at")),
        created_at_t=fn.ts(col("created_at")),
                length_cm_t=dims["length"], width_cm_t=dims["width"], height_cm_t=dims["height"], attributes_t=fn.parse_json(col("attributes"),
                    "map<string,string>"), brand_n=fn.title(col("brand")))


def _orders(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    homes = refs["customers"].select(col("customer_id").alias("_c"), col("region_code").alias("_home"))
    df = df.join(homes, df["customer_id"] == homes["_c"], "left")
    order_date = fn.ts(col("order_date"))
    return _add(df, region_code_n=F.coalesce(fn.upper(col("region_code")), col("_home")), status_n=fn.lower(col("status")),
        currency_n=fn.upper(col("currency")), channel_n=fn.lower(col("channel")), order_date_t=order_date, order_total_t=fn.num(col("order_total")),
        updated_at_t=fn.ts(col("updated_at")), order_month=fn.month_of(order_date)).drop("_c", "_home")


def _order_items(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    months = refs["orders"].select(col("order_id").alias("_o"), "order_month")
    df = df.join(months, df["order_id"] == months["_o"], "left").drop("_o")
    df = _add(df, quantity_t=fn.integer(col("quantity")), unit_price_t=fn.num(col("unit_price")),
        discount_pct_t=F.coalesce(fn.num(col("discount_pct")), F.lit(0.0)), line_total_t=fn.num(col("line_total")),
        currency_n=fn.upper(col("currency")))
    df = _add(df, line_total_calc=F.round(col("quantity_t") * col("unit_price_t") * (1 - col("discount_pct_t") / 100), 2))
    return _add(df, line_total_fixed=fn.recompute(col("line_total_t"), col("line_total_calc")))


def _payments(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    totals = refs["orders"].select(col("order_id").alias("_o"), col("order_total").alias("order_total_ref"))
    df = df.join(totals, df["order_id"] == totals["_o"], "left").drop("_o")
    paid = fn.ts(col("paid_at"))
    return _add(df, payment_method_n=fn.lower(col("payment_method")), status_n=fn.lower(col("status")), currency_n=fn.upper(col("currency")),
        amount_t=fn.num(col("amount")), paid_at_t=paid, paid_month=fn.month_of(paid))


def _inventory_events(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    df = _add(df, product_id=fn.upper(col("product_id")), warehouse_id=fn.upper(col("warehouse_id")))
    at = fn.ts(col("event_ts"))
    return _add(df, event_type_n=fn.lower(col("event_type")), quantity_delta_t=fn.integer(col("quantity_delta")),
        unit_cost_t=fn.num(col("unit_cost")), defective_qty_t=fn.integer(col("defective_qty")),
        counted_quantity_t=fn.integer(col("counted_quantity")), event_ts_t=at, event_month=fn.month_of(at))


def _shipping_events(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    col = F.col
    at = fn.ts(col("event_ts"))
    return _add(df, event_n=fn.lower(col("event")), order_id_n=fn.norm(col("order_id")), warehouse_id=fn.upper(col("warehouse_id")),
        carrier=fn.norm(col("carrier")), event_ts_t=at, event_month=fn.month_of(at))


def _regions(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    return _add(df, region_code=fn.upper(F.col("region_code")), base_delivery_days_t=fn.integer(F.col("base_delivery_days")))


def _warehouses(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    return _add(df, warehouse_id=fn.upper(F.col("warehouse_id")), region_code=fn.upper(F.col("region_code")),
        capacity_units_t=fn.integer(F.col("capacity_units")), opened_date_t=fn.date(F.col("opened_date")))


def _categories(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    return _add(df, level_t=fn.integer(F.col("level")))


def _suppliers(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    return _add(df, lead_time_days_t=fn.integer(F.col("lead_time_days")), active_t=fn.boolean(F.col("active")), quality_tier_n=fn.upper(F.col("quality_tier")))


def _exchange_rates(df: DataFrame, refs: Mapping[str, DataFrame]) -> DataFrame:
    return _add(df, rate_date_t=fn.date(F.col("rate_date")), currency_code=fn.upper(F.col("currency_code")), usd_per_unit_t=fn.num(F.col("usd_per_unit")))


def _final(spec: str) -> list[tuple[str, str]]:
    """``name`` or ``name=expression column`` pairs."""
    return [tuple(reversed(x.split("="))) if "=" in x else (x, x) for x in spec.split()]


#: Datasets in the order in which they must be built: references first, since children check against typed parents.
SPECS = {s.dataset: s for s in (
    Spec("regions", _regions, _final("region_code region_name country_code country_name currency_code base_delivery_days=base_delivery_days_t timezone"),
        replaced=("region_code",)),
    Spec("warehouses", _warehouses, _final("warehouse_id warehouse_name region_code city capacity_units=capacity_units_t opened_date=opened_date_t"),
        replaced=("warehouse_id", "region_code")),
    Spec("categories", _categories, _final("category_id category_name level=level_t parent_category_id")),
    Spec("suppliers", _suppliers, _final("supplier_id supplier_name country_code region_code lead_time_days=lead_time_days_t quality_tier=quality_tier_n is_active=active_t")),
    Spec("exchange_rates", _exchange_rates, _final("rate_date=rate_date_t currency_code usd_per_unit=usd_per_unit_t"), replaced=("currency_code",)),
    Spec("customers", _customers,
        _final("customer_id first_name last_name email=email_n phone customer_segment=customer_segment_n city country_code=country_code_n region_code birth_date=birth_date_t signup_date=signup_date_t updated_at=updated_at_t"),
        needs=("regions",), replaced=("customer_id", "region_code")),
    Spec("products", _products,
        _final("product_id sku name brand=brand_n category_id supplier_id unit_price=unit_price_t unit_cost=unit_cost_t currency=currency_n weight_kg=weight_kg_t length_cm=length_cm_t width_cm=width_cm_t height_cm=height_cm_t attributes=attributes_t attributes_json=attributes is_active=is_active_t created_at=created_at_t updated_at=updated_at_t"),
        needs=("categories", "suppliers")),
    Spec("orders", _orders,
        _final("order_id customer_id region_code=region_code_n order_ts=order_date_t order_month status=status_n channel=channel_n currency=currency_n order_total=order_total_t coupon_code updated_at=updated_at_t"),
        "order_month", ("customers",), near=("customer_id",)),
    Spec("order_items", _order_items,
        _final("order_item_id order_id product_id quantity=quantity_t unit_price=unit_price_t discount_pct=discount_pct_t line_total=line_total_fixed line_total_source=line_total_t currency=currency_n order_month"),
        "order_month", ("orders", "products"), near=("order_id",)),
    Spec("payments", _payments,
        _final("payment_id order_id payment_method=payment_method_n amount=amount_t currency=currency_n status=status_n paid_at=paid_at_t paid_month"),
        "paid_month", ("orders",), near=("order_id",)),
    Spec("inventory_events", _inventory_events,
        _final("event_id event_type=event_type_n product_id warehouse_id supplier_id quantity_delta=quantity_delta_t unit_cost=unit_cost_t defective_qty=defective_qty_t counted_quantity=counted_quantity_t reference_id reason event_ts=event_ts_t event_month"),
        "event_month", ("products", "warehouses"), ("product_id", "warehouse_id")),
    Spec("shipping_events", _shipping_events,
        _final("shipment_id event=event_n order_id=order_id_n carrier warehouse_id region_code=region location event_ts=event_ts_t event_month"),
        "event_month", ("orders", "warehouses"), ("warehouse_id", "carrier")),
)}


def typed(dataset: str, landed: DataFrame, refs: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows with ``quality_warnings`` and lineage, evaluated rows with the raw record) of one landed batch.

    Exact duplicates go before the rules; the raw columns are kept as delivered for the quarantine. They become a record after the joins, so that
    what the joins shuffle holds them once.
    """
    spec = SPECS[dataset]
    columns = [c for c in landed.columns if c not in _LINEAGE]
    rows = drop_exact_duplicates(landed, columns, ["_ingested_at", "_row_number"], spec.near)
    given = {c: f"_given_{c}" for c in spec.replaced}
    evaluated = rules.evaluate(spec.transform(rows.withColumns({g: F.col(c) for c, g in given.items()}), refs), spec.suite, refs)
    evaluated = evaluated.withColumn("_raw", F.struct(*[F.col(given.get(c, c)).alias(c) for c in columns])).drop(*given.values())
    return rules.valid(evaluated).select(*_final_columns(dataset), "quality_warnings", *_LINEAGE), evaluated


def _final_columns(dataset: str) -> list[Column]:
    spec = SPECS[dataset]
    final = [F.col(source).alias(name) for source, name in spec.final]
    if dataset == "customers":  # values that a warning calls wrong are not kept
        w = F.col("quality_warnings")
        replaced = {"email": fn.null_on_warning(F.col("email_n"), w, "customers.email_format"),
            "signup_date": fn.null_on_warning(F.col("signup_date_t"), w, "customers.signup_date_not_future")}
        final = [replaced[name].alias(name) if name in replaced else F.col(source).alias(name) for source, name in spec.final]
    return final


def _judged(dataset: str, evaluated: DataFrame) -> DataFrame:
    """What quarantine, breaker and merge read of evaluated rows: typed columns, rules that failed, and the raw record of rejected rows only."""
    record = F.when(F.size("rule_ids") > 0, F.col("_raw")).alias("_raw")
    return evaluated.select(*_final_columns(dataset), "quality_warnings", *_LINEAGE, "rule_ids", "errors", record)


def _one_text(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Those of ``columns`` that hold one text in all rows, and the text."""
    ends = df.agg(*[f(c).alias(f"{n}{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))], F.count_if(F.greatest(*[F.col(c).isNull() for c in
        columns])).alias("nulls")).head()
    return {c: ends[f"min{c}"] for c in columns if not ends["nulls"] and ends[f"min{c}"] is not None and ends[f"min{c}"] == ends[f"max{c}"]}


def build(dataset: str, landed: DataFrame, refs: Mapping[str, DataFrame], path: str, quarantine_path: str, batch_id: str, run_id: str) -> int:
    """Merge a batch into the typed table; rejects are written first, then the breaker may stop the batch. Returns rows written."""
    spec, spark = SPECS[dataset], landed.sparkSession
    judged = scratch(spark, f"judged-{dataset}")  # evaluated once for quarantine, breaker and merge
    with shuffles_dropped(spark):
        try:
            plan = _judged(dataset, typed(dataset, landed, refs)[1])
            plan.write.option("compression", "zstd").parquet(judged)
            evaluated = spark.read.schema(plan.schema).parquet(judged)
            records = rules.quarantine_records(evaluated, ["_raw.*"], dataset, "bronze", batch_id, "silver", run_id)
            rules.write_quarantine(records, quarantine_path)
            rules.enforce(evaluated, spec.suite)
            version = [*([spec.contract.version] if spec.contract.version else []), "_ingested_at", "_row_number"]
            keys, good = list(spec.contract.key), rules.valid(evaluated).drop("_raw")
            if spec.partition:
                return merge.merge_partitioned(good, path, keys, version, spec.partition, newest=keep_latest_of_few, fixed=_one_text(good, ("_batch_id", "_source_file", "_run_id")))[0]
            return merge.merge_snapshot(good, path, keys, version, keep_latest_of_few)
        finally:
            drop(spark, judged)


def build_all(landed: Mapping[str, DataFrame], root: str, batch_id: str, run_id: str, only: Sequence[str] | None = None) -> dict[str, int]:
    """Build datasets in dependency order from landed rows; each reads its parents' typed tables."""
    counts = {}
    for name, spec in SPECS.items():
        if name in landed and (only is None or name in only):
            spark = landed[name].sparkSession
            refs = {r: publish.read(spark, f"{root}/{r}") for r in spec.needs}
            counts[name] = build(name, landed[name], refs, f"{root}/{name}", f"{root}/_quarantine", batch_id, run_id)
    return counts
