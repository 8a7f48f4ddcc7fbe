"""Pairs in reach on points with one dense city: the pairs of a plain test, in even buckets."""

import random
from statistics import median

from pyspark.sql import functions as F

from fiberloom.operators import dense, spatial


def city(rng, n, key):
    spread = [(rng.random() * 50_000, rng.random() * 50_000) for _ in range(n // 2)]
    return [(f"{key}{i}", x, y) for i, (x, y) in enumerate(spread + [(20_000 + rng.gauss(0, 150), 30_000 + rng.gauss(0, 150)) for _ in range(n - n // 2 - 60)] + [(20_000.0, 30_000.0)] * 60)]


def test_pairs_are_those_of_the_plain_join_in_even_buckets(spark):
    rng = random.Random(8)
    left, right = city(rng, 900, "L"), city(rng, 1200, "R")
    l = spark.createDataFrame(left + [("nowhere", None, 1.0)], "a string, x double, y double")  # noqa: E741
    r = spark.createDataFrame(right + [("none", 1.0, None)], "b string, bx double, by double")
    for radius in (60.0, 700.0):
        plain = sorted((p[0], q[0]) for p in left for q in right if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= radius * radius)
        got = dense.within_radius(l, r, radius, most=25, guests=40)
        assert got.columns == ["a", "x", "y", "b", "bx", "by", "d2"]
        assert sorted((x["a"], x["b"]) for x in got.collect()) == plain
    a, b = dense.buckets(l, r, 700.0, most=25, guests=40)
    key = ["__leaf", "__a", "__b"]
    work = a.groupBy(*key).count().join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key).select((F.col("count") * F.col("m")).alias("w"), "__leaf", "__a", "__b").collect()
    tasks = [0] * 16
    for x in work:
        tasks[hash((x["__leaf"], x["__a"], x["__b"])) % 16] += x["w"]
    assert max(x["w"] for x in work) <= 3 * 25 * 40 and max(tasks) <= 3 * median(tasks)
    assert a.count() < len(plain) / 5


def test_the_plain_join_turns_to_it_where_a_cell_is_hot(spark, monkeypatch):
    rng = random.Random(9)
    l = spark.createDataFrame(city(rng, 200, "L"), "a string, x double, y double")  # noqa: E741
    r = spark.createDataFrame(city(rng, 200, "R"), "b string, bx double, by double")
    rows = lambda: sorted(tuple(x) for x in spatial.within_radius(l, r, 500.0).select("a", "b", "d2").collect())
    plain, used = rows(), []
    whole = dense.within_radius
    monkeypatch.setattr(spatial, "HOT_PAIRS", 100)
    monkeypatch.setattr(dense, "within_radius", lambda *a, **k: used.append(1) or whole(*a, **k))
    assert rows() == plain and used
    assert spatial.within_radius(l.limit(0), r, 500.0).count() == spatial.within_radius(l, r.limit(0), 500.0).count() == 0
    assert dense.within_radius(l, r.limit(0), 5.0).count() == dense.within_radius(l.limit(0), r, 5.0).count() == 0
