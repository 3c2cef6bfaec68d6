"""Rule engine on the commerce tables: every rule's failures against a plain filter, breaker, quarantine, construction, checks."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import rules
from lakeloom.operators.rules import Rule, Suite
from lakeloom.plans import checks, silver
from lakeloom.plans.sample import Commerce
from tests.conftest import SF

#: Rules over order lines, each with the plain filter that finds its failures.
LINES = [
    (Rule("lines.note_known", "not_null", "warn", "note"), "note IS NULL"),
    (Rule("lines.flag_form", "regex", "reject", "l_returnflag", {"pattern": "^[ANR]$"}), "l_returnflag NOT IN ('A', 'N', 'R')"),
    (Rule("lines.status_listed", "in_set", "warn", "l_linestatus", {"values": ["O"]}), "l_linestatus <> 'O'"),
    (Rule("lines.tax_typed", "castable", "reject", "tax_text", {"typed": "tax_typed"}), "tax_text IS NOT NULL AND tax_typed IS NULL"),
    (Rule("lines.quantity_limit", "compare", "reject", "l_quantity", {"op": "<=", "value": 47}), "l_quantity > 47"),
    (Rule("lines.discount_below_tax", "compare_cols", "warn", None, {"left": "l_discount", "op": "<=", "right": "l_tax"}), "l_discount > l_tax"),
    (Rule("lines.shipped_by_cutoff", "not_future", "reject", "l_shipdate", {"reference": "cutoff"}), "l_shipdate > cutoff"),
    (Rule("lines.part_listed", "fk", "reject", "l_partkey", {"ref": "parts", "ref_column": "p_partkey"}), "l_partkey % 20 = 3"),
    (Rule("lines.price_per_unit", "expr", "warn", None, {"expression": "l_extendedprice / l_quantity > 300"}), "l_extendedprice / l_quantity <= 300"),
]
SUITE = Suite("lines", tuple(r for r, _ in LINES), 0.2)


@pytest.fixture(scope="module")
def lines(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("tax_text", F.expr("CASE WHEN l_linenumber = 4 THEN 'tax' WHEN l_linenumber < 4 THEN CAST(l_tax AS STRING) END"))
    rows = rows.withColumn("tax_typed", F.expr("try_cast(tax_text AS DOUBLE)")).withColumn("note", F.expr("CASE WHEN l_suppkey % 2 = 0 THEN l_returnflag END"))
    return rows.withColumn("cutoff", F.expr("CASE WHEN l_orderkey % 50 = 0 THEN l_shipdate - INTERVAL 1 DAY ELSE l_shipdate END")).cache()


@pytest.fixture(scope="module")
def evaluated(spark, lines):
    parts = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 20 <> 3")
    return rules.evaluate(lines, SUITE, {"parts": parts.unionByName(parts)}).cache()


def test_failures_of_every_rule(lines, evaluated):
    got = {r["rule_id"]: (r["failed"], r["total"]) for r in rules.statistics(evaluated, SUITE).collect()}
    assert got == {r.id: (lines.where(bad).count(), lines.count()) for r, bad in LINES}
    assert got["lines.flag_form"][0] == 0 and all(n for name, (n, _) in got.items() if name != "lines.flag_form")


def test_rows_are_kept_rejected_or_warned(lines, evaluated):
    hard = " OR ".join(f"coalesce({bad}, false)" for r, bad in LINES if r.severity == "reject")
    assert rules.rejected(evaluated).count() == lines.where(hard).count() and rules.valid(evaluated).count() == lines.where(f"NOT ({hard})").count()
    warned = rules.valid(evaluated).where(F.array_contains("quality_warnings", "lines.price_per_unit")).count()
    assert warned == lines.where(f"NOT ({hard}) AND l_extendedprice / l_quantity <= 300").count()
    assert not {"rule_ids", "errors"} & set(rules.valid(evaluated).columns)


def test_breaker_trips_above_its_limit_only(evaluated):
    seen = rules.reject_rate(evaluated, SUITE).head()
    exact = seen["rejected"] / seen["total"]
    assert 0 < exact < 1
    rules.enforce(evaluated, Suite("lines", SUITE.rules, exact))
    with pytest.raises(rules.RejectRateExceeded):
        rules.enforce(evaluated, Suite("lines", SUITE.rules, exact - 1e-9))


def test_construction(spark, lines):
    for wrong in ({"check": "guess"}, {"check": "regex", "severity": "fatal"}):
        with pytest.raises(ValueError):
            Rule("lines.wrong", **wrong)
    reference = next(r for r in SUITE.rules if r.check == "fk")
    with pytest.raises(KeyError):
        rules.evaluate(lines, Suite("lines", (reference,)), {})


def test_quarantine_is_replaced_by_a_rerun(spark, evaluated, folder):
    path, n = f"{folder}/quarantine", rules.rejected(evaluated).count()
    for batch in ("b1", "b2", "b1"):
        rules.write_quarantine(rules.quarantine_records(evaluated, ["l_orderkey", "tax_text"], "lines", "feed", batch, "silver", "r1"), path)
    assert [rules.read_quarantine(spark, path, "lines", b).count() for b in ("b1", "b2", "b3", None)] == [n, n, 0, 2 * n]
    per_rule = {r["rule_id"]: r["records"] for r in rules.quarantine_counts(rules.read_quarantine(spark, path, "lines", "b1")).collect()}
    assert per_rule["lines.tax_typed"] == evaluated.where("tax_text = 'tax'").count()


def test_catalogue():
    every = [r for s in silver.SUITES.values() for r in s.rules]
    assert len(every) == 76 and len({r.id for r in every}) == 76
    assert set(silver.SPECS) == set(silver.CONTRACTS)
    for spec in silver.SPECS.values():
        assert all(list(silver.SPECS).index(n) < list(silver.SPECS).index(spec.dataset) for n in spec.needs)


def test_status(spark):
    seen = spark.createDataFrame([("a", 10, 0), ("b", 10, 3)], "check_name string, total long, failed long")
    status = lambda limits, severities: rules.overall_status(rules.summarize(seen, limits, severities)).head()["status"]
    assert [status({}, {"b": "warn"}), status({"b": 0.3}, {}), status({}, {})] == ["warn", "pass", "fail"]


def test_checks_find_planted_faults(spark):
    """Each kind of check fails by as many rows as are spoilt."""
    c = Commerce(spark, SF)
    orders = c.derived("c_orders").select("order_id", "customer_id", "status", "order_total")
    spoilt = orders.withColumn("customer_id",
        F.expr("CASE WHEN order_id % 100 = 1 THEN -7 WHEN order_id % 100 = 2 THEN NULL ELSE customer_id END")).withColumn("status",
        F.expr("CASE WHEN order_id % 100 = 3 THEN 'odd' ELSE status END"))
    spoilt = spoilt.unionByName(spoilt.where("order_id % 100 = 4"))
    mine = (checks._unique("o", "order_id"), checks._reference("o", "customer_id", "p"), checks._known("o", "customer_id", 0.5), checks._holds("o",
        "known_state", "status <> 'odd'"))
    got = {r["check_name"]: (r["failed"], r["passed"]) for r in checks.run(mine, {"o": spoilt, "p": c.derived("c_customers")}).collect()}
    assert got == {"o.order_id_unique": (15, False), "o.customer_id_ri": (15, False), "o.customer_id_null_rate": (15, True), "o.known_state": (15, False)}
    assert {(r["order_id"] % 100, r["rows"]) for r in checks.duplicates(spoilt, "order_id").collect()} == {(4, 2)}
