"""Column functions and windows on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from lakeloom import functions as fn
from lakeloom.operators import dedup
from lakeloom.operators import windows as win
from lakeloom.plans import star


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


def test_text_and_casts(spark):
    assert one(spark, fn.norm, " a ", "  ", None, "") == ["a", None, None, None]
    assert one(spark, fn.title, " new york ") == ["New York"]
    assert one(spark, fn.num, "1.5", "$12.99", "x", " 2 ") == [1.5, None, None, 2.0]
    assert one(spark, fn.integer, "3", "3.0", "-4", "9" * 30) == [3, None, -4, None]
    assert one(spark, fn.boolean, "Yes", "0", "maybe", " T ") == [True, False, None, True]
    assert one(spark, fn.date, "2024-02-29", "2024-02-30", "31/12/2023", "2023-13-01") == [dt.date(2024, 2, 29), None, None, None]
    assert one(spark, lambda c: fn.ts(c).isNotNull(), "2024-05-01T00:00:00Z", "2024-05-01", "2024-02-30T00:00:00Z") == [True, False, False]
    assert one(spark, lambda c: fn.alias_code(c, {"US": ("usa",)}), " USA ", "us", "mars") == ["US", "US", None]
    assert one(spark, lambda c: fn.parse_json(c, "length double")["length"], '{"length": 2}', "10x20") == [2.0, None]


def test_money_and_flags(spark):
    row = spark.sql("SELECT CAST(10.00 AS DECIMAL(14,2)) AS a, CAST(10.04 AS DECIMAL(14,2)) AS b, CAST(11 AS DECIMAL(14,2)) AS c, CAST(1.5 AS DECIMAL(14,6)) AS r")
    got = row.select(fn.recompute(F.col("a"), F.col("b")), fn.recompute(F.col("a"), F.col("c")), fn.convert(F.col("b"), F.col("r")),
        fn.within_tolerance(F.col("a"), F.col("c"), "1.0", "0.01"), fn.within_tolerance(F.col("a"), F.col("b") + 2, "1.0", "0.01")).head()
    assert [float(x) if not isinstance(x, bool) else x for x in got] == [10.0, 11.0, 15.06, True, False]
    bands = [(90, "active"), (180, "at_risk")]
    assert [r[0] for r in spark.createDataFrame([(10,), (90,), (91,), (400,), (None,)], "d int").select(fn.band(F.col("d"), bands, "churned",
        "never")).collect()] == ["active", "active", "at_risk", "churned", "never"]
    assert [r[0] for r in spark.createDataFrame([(1.0, 0), (1.0, 2), (1.0, None)], "a double, b int").select(fn.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None]


def test_surrogate_key_treats_null_as_empty(spark):
    df = spark.createDataFrame([("", "a"), (None, "a"), ("a", "")], "x string, y string").select(fn.surrogate_key(F.col("x"), F.col("y")).alias("k"))
    keys = [r["k"] for r in df.collect()]
    assert keys[0] == keys[1] and isinstance(keys[0], int)


def test_exact_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, None, None), (5, None, None)], "n long, x string, y string")
    assert sorted(r["n"] for r in dedup.drop_exact_duplicates(df, ["x", "y"], ["n"]).collect()) == [1, 3, 4]


def test_keep_latest_puts_null_versions_last(spark):
    df = spark.createDataFrame([("k", None, 9), ("k", 1, 1), ("k", 2, 2), ("k", 2, 3)], "k string, v long, n long")
    assert dedup.keep_latest(df, ["k"], ["v", "n"]).head()["n"] == 3


def test_dense_rates(spark):
    rows = [(dt.date(2024, 1, 1), "EUR", "1.1"), (dt.date(2024, 1, 4), "EUR", "1.2"), (dt.date(2024, 1, 2), "USD", "7")]
    df = spark.createDataFrame(rows, "day date, currency string, r string").selectExpr("day", "currency", "CAST(r AS DECIMAL(14,6)) AS rate")
    got = {(r["day"].day, r["currency"]): None if r["rate"] is None else float(r["rate"]) for r in win.dense_rates(df, "day", "currency", "rate", "USD").collect()}
    assert got == {**{(d, "EUR"): 1.1 for d in (1, 2, 3)}, (4, "EUR"): 1.2, **{(d, "USD"): 1.0 for d in range(1, 5)}}


def test_late_event_changes_later_balances(spark):
    rows = [(1, "p", "w", "2024-01-05", 5), (2, "p", "w", "2024-02-05", -2)]
    unset = {c: F.lit(None).cast("string") for c in ("supplier_id", "event_type", "defective_qty", "counted_quantity", "reference_id", "reason", "_batch_id")}
    given = {"event_month": F.substring("event_ts", 1, 7), "event_date": F.to_date("event_ts"), "unit_cost": F.lit(None).cast("decimal(14,2)")}

    def events(extra):
        return spark.createDataFrame(rows + extra, "event_id long, product_id string, warehouse_id string, event_ts string, quantity_delta long").withColumns(given | unset)

    late = events([(3, "p", "w", "2024-01-20", 10)])
    full = {r["event_id"]: r["on_hand_after"] for r in star.fact_inventory(late).collect()}
    assert full == {1: 5, 3: 15, 2: 13}
    assert [r["on_hand_after"] for r in star.fact_inventory(late, ["2024-02"]).collect()] == [13]
    assert star.fact_inventory(late, []).count() == 0
