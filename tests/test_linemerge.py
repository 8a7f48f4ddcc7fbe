import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fiberloom.functions import geo, kernel
from fiberloom.operators import linemerge
from fiberloom.plans.boq import agg_11
from fiberloom.plans.fixtures import view

SF = "/root/testdata/sf0.001"

SCHEMA = f"zone string, ord long, line {geo.LINE}"


def table(spark, rows):
    return spark.createDataFrame([(k, i, None if line is None else [(float(x), float(y)) for x, y in line]) for k, i, line in rows], SCHEMA)


def plain(rows):
    """What the walk over one key gives, key by key."""
    out = {}
    for k in {r[0] for r in rows}:
        mine = [line for _, _, line in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) if line]
        for part, line in enumerate(kernel.merge_lines(mine)):
            out[k, part] = [(float(x), float(y)) for x, y in line]
    return out


def got(spark, rows):
    found = linemerge.merged(table(spark, rows), "zone").collect()
    out = {(r["zone"], r["part"]): [(p["x"], p["y"]) for p in r["line"]] for r in found}
    assert len(out) == len(found)
    for r in found:
        assert r["length"] == pytest.approx(kernel.length(out[r["zone"], r["part"]]))
    return out


def test_shapes(spark):
    rows = [
        ("chain", 1, [(1, 0), (0, 0)]), ("chain", 2, [(2, 0), (1, 0)]), ("chain", 3, [(2, 0), (3, 1), (4, 0)]), ("chain", 4, [(9, 9), (8, 8)]),
        ("fork", 1, [(0, 0), (1, 0)]), ("fork", 2, [(1, 0), (2, 0)]), ("fork", 3, [(1, 0), (1, 1)]),
        ("ring", 5, [(1, 1), (1, 0)]), ("ring", 3, [(0, 0), (1, 0)]), ("ring", 7, [(1, 1), (0, 1)]), ("ring", 9, [(0, 0), (0, 1)]),
        ("two", 1, [(0, 0), (5, 0)]), ("two", 2, [(0, 0), (2, 2), (5, 0)]),
        ("closed", 1, [(0, 0), (1, 1), (0, 0)]), ("closed", 2, [(0, 0), (7, 7)]), ("closed", 3, [(20, 0), (21, 1), (20, 0)]),
        ("same", 1, [(0, 0), (1, 0)]), ("same", 2, [(0, 0), (1, 0)]), ("thrice", 1, [(0, 0), (1, 0)]), ("thrice", 2, [(0, 0), (1, 0)]), ("thrice", 3, [(0, 0), (1, 0)]),
        (None, 1, [(0, 0), (1, 0)]), (None, 2, [(1, 0), (1, 5)]), ("point", 1, [(0, 0)]), ("none", 1, None), ("near", 1, [(0, 0), (1.00000001, 0)]), ("near", 2, [(1, 0), (2, 0)]),
    ]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_networks_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in ("a", "b", "c"):
        free = [(x, y) for x in range(14) for y in range(14)]
        edges = [((x, y), (x + 1, y)) for x, y in free if x < 13] + [((x, y), (x, y + 1)) for x, y in free if y < 13]
        for i, (p, q) in enumerate(rng.sample(edges, 190)):
            rows.append((k, i, [p, q] if rng.random() < 0.5 else [q, p]))
    assert got(spark, rows) == plain(rows)


def test_long_chain_and_ring(spark):
    """700 lines in a row, dealt in any order and either way, and a ring of 300."""
    rng = random.Random(4)
    ring = [(round(1000 * math.cos(i * math.tau / 300), 3), round(1000 * math.sin(i * math.tau / 300), 3)) for i in range(300)]
    parts = [[(i, 5000 + i % 7), (i + 1, 5000 + (i + 1) % 7)] for i in range(700)] + [[ring[i], ring[(i + 1) % 300]] for i in range(300)]
    rng.shuffle(parts)
    rows = [("k", i, p if rng.random() < 0.5 else p[::-1]) for i, p in enumerate(parts)]
    found = got(spark, rows)
    assert found == plain(rows) and sorted(map(len, found.values())) == [301, 701]


def test_empty_clashing_and_unknown_columns(spark):
    empty = linemerge.merged(table(spark, []), "zone")
    assert empty.count() == 0 and empty.columns == ["zone", "part", "line", "length"]
    rows = table(spark, [("a", 1, [(0, 0), (1, 0)]), ("a", 2, [(1, 0), (3, 0)])])
    clash = rows.select("*", *[F.lit("x").alias(c) for c in ("id", "part", "last", "d", "to", "left", "length")])
    (r,) = linemerge.merged(clash, "zone").collect()
    assert (r["zone"], r["part"], r["length"]) == ("a", 0, 3.0)
    (r,) = linemerge.merged(rows.withColumnRenamed("zone", "z.k").withColumnRenamed("line", "l.n"), "z.k", "l.n").collect()
    assert r["z.k"] == "a"


def test_no_key_is_one_group(spark):
    """The hot key's rows are only grouped by place, by chain and in partial sums."""
    plan = linemerge.merged(table(spark, [("a", i, [(i, 0), (i + 1, 0)]) for i in range(20)]), "zone")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_the_walk_over_whole_tables(spark):
    rows = view(spark, SF, "fiber_lines").select(F.floor(F.col("ax") / 10000).alias("zone"), F.xxhash64("name").alias("ord"), "ax", "ay", "bx", "by").collect()
    want = plain([(r["zone"], r["ord"], [(r["ax"], r["ay"]), (r["bx"], r["by"])]) for r in rows])
    found = {(r["zone"], r["part"]): r["length"] for r in agg_11(spark, SF).collect()}
    assert found == pytest.approx({k: kernel.length(line) for k, line in want.items()}, abs=1e-4)
