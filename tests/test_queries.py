"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from lakeloom import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return ""
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    place = [want.columns.index(c) for c in order]
    assert sorted(tuple(canon(r[c]) for c in order) for r in got) == sorted(tuple(canon(r[i]) for i in place) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
