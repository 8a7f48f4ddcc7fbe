"""Linkage in rounds gives the labels of the matrix form, ties and large clusters included."""

import random

from pyspark.sql import functions as F

from fiberloom.operators import linkage, network


def fixture(rng, groups, n, whole):
    sites, dist = [], []
    for g in range(groups):
        nodes = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)]
        own = [(f"G{g}", f"S{i:03d}", k) for i, k in enumerate(rng.choices(range(n), k=int(1.4 * n)))]
        heads = {}
        for _, site, k in own:
            heads.setdefault(k, site)
        for k, a in heads.items():
            for m, b in heads.items():
                d = abs(nodes[k][0] - nodes[m][0]) + abs(nodes[k][1] - nodes[m][1]) + (0.5 if k != m else 0.0)
                if k != m and (whole or d < 14):
                    dist.append((f"G{g}", a, b, float(d)))
        sites += own
    return sites, dist


def both(spark, sites, dist, *args):
    s = spark.createDataFrame(sites, "g string, site_id string, node long")
    d = spark.createDataFrame(dist, "g string, site_i string, site_j string, dist double")
    rows = lambda df: sorted(tuple(r) for r in df.select("g", "site_id", "label").collect())
    return rows(network.cluster(s, d, "g", *args)), rows(linkage.by_rounds(s, d, "g", *args)), s, d


def test_rounds_equal_the_matrix(spark):
    rng = random.Random(5)
    for whole, limit, expectation, tolerance in ((False, 9.0, 1000, 0), (True, 60.0, 9, 1)):
        want, got, s, d = both(spark, *fixture(rng, 2, 20, whole), limit, expectation, tolerance)
        assert got == want and len({x[2] for x in got}) > 3
    mixed = linkage.cluster(s, d, "g", limit, expectation, tolerance, in_task=14)
    assert sorted(tuple(r) for r in mixed.select("g", "site_id", "label").collect()) == want


def test_sites_without_pairs_and_none(spark):
    sites = [("A", "x", 1), ("A", "y", 2), ("A", "z", 2), ("B", "x", 1)]
    want, got, s, d = both(spark, sites, [], 5.0, 10, 2)
    assert got == want == [("A", "x", "x"), ("A", "y", "y"), ("A", "z", "y"), ("B", "x", "x")]
    assert linkage.cluster(s.limit(0), d, "g", 5.0).count() == 0


def test_equal_distances_merge_in_order_of_names(spark):
    pairs = [("A", a, b, 1.0) for a in "pqrs" for b in "pqrs" if a < b] + [("A", "s", "t", 1.0)]
    df = spark.createDataFrame(pairs, "g string, a string, b string, d double")
    got = sorted((r["keep"], r["gone"]) for r in linkage.mergers(df, "g").collect())
    assert got == [("p", "q"), ("p", "r"), ("p", "s")]
    assert linkage.mergers(df.where(F.lit(False)), "g").count() == 0


def test_places_equal_the_matrix(spark):
    rng = random.Random(8)
    for whole, limit, expectation, tolerance in ((False, 9.0, 3, 0), (True, 60.0, 9, 1)):
        sites, dist = fixture(rng, 2, 20, whole)
        sites += [(g, f"T{i:03d}", rng.choice([k for h, _, k in sites if h == g])) for g in ("G0", "G1") for i in range(60)]
        # A second node without any way to the first of its group, and a site before and after those of the other.
        first = next(r for r in sites if r[0] == "G0")
        least = min(s for g, s, k in sites if g == "G0" and k == first[2])
        sites += [("G0", "A00", 99), ("G0", "Z00", 99)]
        dist += [("G0", "A00", b if a == least else a, d) for _, a, b, d in [r for r in dist if r[0] == "G0"] if a == least]
        dist += [("G0", "A00", least, 0.0)]
        s = spark.createDataFrame(sites, "g string, site_id string, node long")
        d = spark.createDataFrame(dist, "g string, site_i string, site_j string, dist double")
        rows = lambda df: sorted(tuple(r) for r in df.select("g", "site_id", "label").collect())
        # The plain form takes the two nodes for one if they are given as such.
        joined = spark.createDataFrame([(g, x, first[2] if k == 99 and g == "G0" else k) for g, x, k in sites], s.schema)
        renamed = d.replace({least: "A00"}, subset=["site_i", "site_j"]).where("site_i <> site_j")
        both_ways = d.where("g <> 'G0'").unionByName(renamed.where("g = 'G0'"))
        want = rows(network.cluster(joined, both_ways, "g", limit, expectation, tolerance))
        assert rows(linkage.by_places(s, d, "g", limit, expectation, tolerance)) == want
        assert rows(linkage.cluster(s, d, "g", limit, expectation, tolerance, in_task=50)) == want


def test_many_sites_at_few_places_take_no_matrix(spark):
    n = 20_000
    s = spark.range(n).select(F.lit("A").alias("g"), F.format_string("S%06d", "id").alias("site_id"), (F.col("id") % 2).alias("node"))
    d = spark.createDataFrame([("A", "S000000", "S000001", 5.0)], "g string, site_i string, site_j string, dist double")
    sizes = sorted(r["count"] for r in linkage.cluster(s, d, "g", 10.0, 8, 2).groupBy("label").count().collect())
    # Each round but the first leaves 7 of 8 of the larger clusters; the first one merges 17,500 of 19,998 times.
    kept = [10_000, 7_502]
    for _ in range(4):
        kept = [k - -(-k // 8) + 1 for k in kept]
    assert sum(sizes) == n and sizes[-2:] == sorted(kept) and sizes[-3] == 1
