"""As-of join against a plain search over both sides."""

import random

import pytest

from lakeloom.operators.asof import asof_join

LEFT, RIGHT = "i int, k string, t int", "k string, at int, v int, w string"


def searched(left, right):
    out = []
    for i, k, t in left:
        found = [r for r in right if None not in (k, t, r[1]) and r[0] == k and r[1] <= t]
        best = max(found, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3])) if found else (None,) * 4
        out.append((i, k, t, best[2], best[3]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,m", [(0, 0), (0, 5), (5, 0), (1, 1), (600, 90)])
def test_asof(spark, n, m):
    rnd = random.Random(n + m)
    key = lambda: rnd.choice(["hot"] * 5 + ["a", "b", None])
    left = [(i, key(), rnd.choice([None, *range(60)])) for i in range(n)]
    right = [(key(), rnd.choice([None, *range(5, 50)]), rnd.choice([None, 1, 2, 3]), rnd.choice("xy")) for _ in range(m)]
    a, b = spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2)
    got = asof_join(a, b, ["k"], "t", "at", ["v", "w"])
    assert got.columns == ["i", "k", "t", "v", "w"] and sorted(map(tuple, got.collect()), key=str) == searched(left, right)


def test_asof_without_keys_and_with_equal_rows(spark):
    a = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 1)], LEFT)
    b = spark.createDataFrame([("z", 5, 7, "x"), ("y", 2, 8, "y")], RIGHT)
    got = asof_join(a, b, [], "t", "at", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 5, 7), (1, "a", 5, 7), (2, "b", 1, None)]


def test_asof_refuses_clashing_names(spark):
    a = spark.createDataFrame([], LEFT)
    with pytest.raises(ValueError, match="both sides"):
        asof_join(a, a, ["k"], "t", "t", ["i"])
