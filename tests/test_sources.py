"""Readers, drift, landing and the ledger on tiny files."""

import json
import pathlib
import random

import pytest
from pyspark.sql.utils import AnalysisException  # noqa: F401

from lakeloom.sources import landing, quoted, readers


def put(folder, name, text):
    path = pathlib.Path(folder) / name
    path.write_text(text)
    return str(path)


def test_csv(spark, folder):
    rows = readers.read_csv(spark, put(folder, "a.csv", 'id,qty,price\n1,3,9.99\n2,,"a\nb"\n')).orderBy("id").collect()
    assert [(r["id"], r["qty"], r["price"]) for r in rows] == [("1", "3", "9.99"), ("2", None, "a\nb")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, put(folder, "b.csv", "id,id\n1,2\n"))
    with pytest.raises(ValueError):
        readers.read_csv(spark, put(folder, "c.csv", ""))


def test_ndjson(spark, folder):
    parsed = readers.read_ndjson(spark, put(folder, "a.ndjson", '{"a":1,"b":{"c":2}}\n{"a":\n\n[1]\n{"a":null,"d":true}\n'))
    assert sorted(readers.key_union(parsed)) == ["a", "b", "d"]
    good = readers.good(parsed, ["a", "b", "d"]).orderBy("_row_number").collect()
    assert [(r["a"], r["b"], r["d"]) for r in good] == [("1", '{"c":2}', None), (None, None, "true")]
    assert sorted(r["_row_number"] for r in readers.rejects(parsed).collect()) == [2, 4]


def test_json_document(spark, folder):
    path = put(folder, "a.json", '{"feed":"x","items":[{"a":1},5]}')
    parsed = readers.read_json_document(spark, path, "items")
    assert readers.good(parsed, ["a"]).count() == 1 and readers.rejects(parsed).count() == 1
    with pytest.raises(Exception, match="no array"):
        readers.read_json_document(spark, path, "nothing").collect()


def test_log(spark, folder):
    text = '# comment\n2025-01-01T00:00:00Z INFO [t] event=delivered shipment_id=S1 carrier="North Star" x=1\n2025-01-01T00:00:00Z INFO [t] nothing here\n2025-01-01T00:0\n'
    parsed = readers.read_log(spark, put(folder, "a.log", text))
    row = readers.good(parsed, [*readers.LOG_COLUMNS, "x"]).head()
    assert (row["event"], row["carrier"], row["x"], row["location"]) == ("delivered", "North Star", "1", None)
    assert sorted(r["_row_number"] for r in readers.rejects(parsed).collect()) == [3, 4]


CONTRACT = landing.Contract("orders", ("order_id",), ("channel",), ("order_id",))


def test_drift(spark):
    got = {(r["column"], r["severity"]) for r in landing.drift(spark, CONTRACT, ["order_id", "promo", "_run_id"]).collect()}
    assert got == {("channel", "WARN"), ("promo", "INFO")}
    with pytest.raises(landing.BreakingDrift):
        landing.raise_on_breaking(landing.drift(spark, CONTRACT, ["channel"]))


def test_landing_again_replaces(spark, folder):
    rows = spark.createDataFrame([("1", "web"), ("2", None)], "order_id string, channel string")
    for _ in range(2):
        landing.land(rows, CONTRACT, f"{folder}/bronze", "b1", "f.csv", "r1")
    landing.land(rows.limit(1), CONTRACT, f"{folder}/bronze", "b2", "f.csv", "r1")
    back = readers.read_bronze(spark, f"{folder}/bronze", ["b1"], ["order_id", "channel", "region"])
    assert back.count() == 2 and set(landing.with_lineage(rows, "b", "s", "r").columns) <= {*back.columns}
    assert readers.read_bronze(spark, f"{folder}/bronze", None, []).count() == 3


def test_run_mode(spark):
    marks = spark.createDataFrame([("orders", "2025-11-30")], "dataset string, last_batch_id string")
    assert [landing.run_mode(marks, d, b) for d, b in (("x", "1"), ("orders", "2025-11-30"), ("orders", "2025-12-31"))] == ["initial", "rerun", "incremental"]


def test_content_hashes_see_the_order_of_lines_and_not_the_splits(spark, folder):
    lines = [f"{i},{'x' * (i % 7)}" for i in range(3000)]
    swapped, moved = lines.copy(), lines[1:] + lines[:1]
    swapped[10], swapped[11] = swapped[11], swapped[10]
    files = {"a": lines, "same": lines, "swapped": swapped, "moved": moved, "doubled": lines + lines, "reversed": lines[::-1]}
    for name, text in files.items():
        put(folder, f"{name}.csv", "\n".join(text) + "\n")
    put(folder, "open.csv", "\n".join(lines))
    put(folder, "returns.csv", "\r\n".join(lines) + "\r\n")
    put(folder, "empty.csv", "")
    seen = []
    for size in ("128m", "1k", "333b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({pathlib.Path(r["source_file"]).stem: r["content_hash"] for r in landing.content_hashes(spark, folder).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2] and seen[0]["a"] == seen[0]["same"] and len(set(seen[0].values())) == len(seen[0]) - 1 >= 7
    files = landing.content_hashes(spark, folder)
    first = landing.not_yet_landed(files, spark.createDataFrame([], landing.LEDGER), "d")
    assert first.count() == len(set(seen[0].values()))
    ledger = spark.createDataFrame(landing.ledger_entries(first, "d", 1, 0, "r1").collect(), landing.LEDGER)
    put(folder, "later.csv", "\n".join(swapped[::-1]) + "\n")
    put(folder, "copy.csv", "\n".join(moved) + "\n")
    new = landing.not_yet_landed(landing.content_hashes(spark, folder), ledger, "d").collect()
    assert [pathlib.Path(r["source_file"]).stem for r in new] == ["later"]


def test_reference_documents_are_counted_in_the_ledger(spark, folder):
    contract = landing.Contract("exchange_rates", ("currency_code", "rate_date"), ("usd",))
    docs = [("a", '{"data":[{"currency_code":"EUR","usd":1.1},{"currency_code":"GBP"},5,"x"]}'), ("b", '{"nothing":1}'), ("c", "no json"), ("d", '{"data":[]}')]
    ledger = spark.createDataFrame([], landing.LEDGER)
    new = landing.land_documents(spark.createDataFrame(docs, "source_file string, value string"), contract, f"{folder}/rates", "b1", "2026-01-01", "r1", ledger)
    assert {r["source_file"]: (r["rows"], r["rejected"]) for r in new.collect()} == {"a": (2, 2), "b": (0, 1), "c": (0, 1), "d": (0, 0)}
    got = {(r["currency_code"], r["usd"], r["rate_date"]) for r in readers.read_bronze(spark, f"{folder}/rates", ["b1"], []).collect()}
    assert got == {("EUR", "1.1", "2026-01-01"), ("GBP", None, "2026-01-01")}


def csv_of(rnd, n):
    """A file of quoted and plain values with line feeds, doubled quotes, separators, empty values and carriage returns in quotes."""
    parts = ["a", "x y", '""', "\n", ",", "é", "", "\n\n", '"",""', "b,c\n"]
    value = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))
    cell = lambda: f'"{value()}"' if rnd.random() < 0.6 else rnd.choice(["", "plain", "5", "it's", 'in"ner', "NULL"])
    return "id,v,w\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(n))


@pytest.mark.parametrize("size", ["128m", "97b", "700b"])
def test_csv_records_in_splits_equal_the_reader_of_whole_files(spark, folder, size):
    rnd = random.Random(len(size))
    for k in range(3):
        put(folder, f"{k}.csv", csv_of(rnd, 150))
    put(folder, "long.csv", 'id,v,w\n1,"' + "long \n" * 300 + '",x\n2,"y\n",\n')
    put(folder, "crlf.csv", 'id,v,w\r\n7,"a",b\r\n8,"c",d\r\n')
    put(folder, "open.csv", "id,v,w\n9,z,z")
    want = readers.read_csv(spark, folder, columns=["id", "v", "w"], multiline="file")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = readers.read_csv(spark, folder, columns=["id", "v", "w"])
    rows = lambda df: sorted(map(str, df.collect()))
    try:
        assert rows(got) == rows(want) and got.count() > 450
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_state_after_a_line():
    after = quoted.after_line
    assert [after(x, False, ",") for x in ('a,"b', 'a,"b"', 'a"b', '"', '""', '"""', '"a""', 'a,"b","c', "", ',"', '"a"b"c,"d')] == [
        True, False, False, True, False, True, True, True, False, True, True]
    assert [after(x, True, ",") for x in ("a", 'a"', 'a"",b', 'a","', '"', '""', "")] == [True, False, True, True, False, True, True]


def test_headers_that_differ_are_errors(spark, folder):
    put(folder, "a.csv", "id,v\n1,2\n")
    put(folder, "b.csv", "id,w\n1,2\n")
    with pytest.raises(Exception, match="other header"):
        readers.read_csv(spark, folder, columns=["id", "v"]).collect()
    marked = put(folder, "bom.txt", "\ufeffid,v\n3,4\n")
    assert [(r["id"], r["v"]) for r in readers.read_csv(spark, marked).collect()] == [("3", "4")]


def test_a_delivery_with_ids_as_keys_is_an_error(spark):
    parsed = spark.range(30).selectExpr("map(concat('k', id), 'v') AS fields")
    assert len(readers.key_union(parsed)) == 30
    with pytest.raises(ValueError, match="more than 20"):
        readers.key_union(parsed, 20)


def json_of(rnd, n):
    """A document with nested values, strings that hold brackets, commas and quotes, other arrays and objects, and white space."""
    text = lambda: "".join(rnd.choice(["a", ",", "[", "]", "{", "}", '"', "\\", "é", "items", ":", "\n"]) for _ in range(rnd.randint(0, 8)))
    item = lambda d=0: rnd.choice([lambda: {text(): text(), "n": rnd.randint(0, 9)}, lambda: {"items": [text(), {"x": [1, [2, text()]]}]}, text, lambda: 5,
        lambda: [text(), []], lambda: None, lambda: {}])()
    doc = {"before": {"items": [1, {"items": [2]}]}, "items ": [9], text() + "k": text(), "items": [item() for _ in range(n)], "after": [{"items": [3, 4]}, "[", 'x"items":[']}
    return json.dumps(doc, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5)


@pytest.mark.parametrize("size", ["128m", "61b", "500b"])
def test_json_elements_in_splits_equal_the_reader_of_whole_documents(spark, folder, size):
    rnd = random.Random(len(size))
    for k, n in enumerate((0, 1, 2, 60, 200)):
        put(folder, f"{k}.json", json_of(rnd, n))
    put(folder, "long.json", '{"items": [ {"a": "' + "long, [ " * 400 + '"} , 7 ]\n}\n')
    rows = lambda df: sorted((r["_source_file"], r["_row_number"], r["raw"], str(r["fields"])) for r in df.collect())
    want = rows(readers.read_json_document(spark, folder, "items", whole=True).where("raw IS NOT NULL"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = rows(readers.read_json_document(spark, folder, "items").where("raw IS NOT NULL AND raw <> 'null'"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(got) > 200


@pytest.mark.parametrize("text", ['{"x":[1]}', '{"items":5}', '{"items":[1,2', '["items",[1]]', '{"items":{"a":[1]}}', '{"y":{"items":[1]}}', '{"items":["a'])
def test_documents_without_the_array_are_errors(spark, folder, text):
    with pytest.raises(Exception, match="no array"):
        readers.read_json_document(spark, put(folder, "a.json", text), "items").collect()
