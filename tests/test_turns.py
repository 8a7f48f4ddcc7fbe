"""Turn classes by areas: the outline walk against samples and the closed form."""

import math
import random

from pyspark.sql import functions as F

from fiberloom.functions import geo, kernel
from fiberloom.operators import boq

R, W = 2.0, 0.5


def sampled(segments, step=0.01):
    """Areas of the free parts by flooding a raster, largest last."""
    n = int(2 * R / step)
    free = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            x, y = -R + (i + 0.5) * step, -R + (j + 0.5) * step
            free[i][j] = x * x + y * y < R * R and all(kernel._point_segment2(x, y, *s) >= W * W for s in segments)
    sizes = []
    for i in range(n):
        for j in range(n):
            if free[i][j]:
                free[i][j], stack, size = False, [(i, j)], 0
                while stack:
                    a, b = stack.pop()
                    size += 1
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < n and 0 <= d < n and free[c][d]:
                            free[c][d] = False
                            stack.append((c, d))
                sizes.append(size * step * step)
    return sorted(sizes)


def test_the_walk_matches_a_raster():
    rng = random.Random(6)
    cases = [[], [(0, 0, 30, 0)], [(0, 0, 30, 0), (0, 0, -20, 1)], [(0, 0, 0, 9), (0, 0, 0, -9), (0, 0, 9, 0), (0, 0, -9, 0)], [(0, 0, 0.8, 0.3)], [(-9, 1.2, 9, 1.2), (0, 0, 5, 5)], [(-9, 1.9, 9, 1.9)], [(0, 0, 0, 0)], [(3, 3, 4, 4)]]
    for _ in range(4):
        far = lambda: (rng.uniform(-9, 9), rng.uniform(-9, 9))
        cases.append([(0, 0, *far()) for _ in range(rng.randrange(1, 5))] + [(*far(), *far()) for _ in range(rng.randrange(3))] + [(rng.uniform(-2, 2), rng.uniform(-2, 2), *far())])
    for segments in cases:
        got, want = kernel.disc_parts(segments, R, W), sampled(segments)
        big = lambda v: [a for a in v if a > 0.02]
        assert len(big(got)) == len(big(want)), segments
        assert all(abs(a - b) <= 0.01 * max(a, b) + 0.004 for a, b in zip(big(got), big(want), strict=True)), segments
    assert kernel.disc_parts([], R, W) == [kernel.disc_parts([(50, 50, 60, 60)], R, W)[0]] and abs(kernel.disc_parts([], R, W)[0] - math.pi * R * R) < 1e-9


def test_the_closed_form_is_the_walk_of_long_edges(spark):
    gaps = [0.3, 0.5054, 0.6, 1.0, math.pi / 2, 3.0, math.pi, 3.5, 5.0, 6.2]
    df = spark.createDataFrame([(g,) for g in gaps], "g double").select("g", geo.gap_area(F.col("g"), R, W).alias("a"))
    for g, a in df.collect():
        walked = kernel.disc_parts([(0, 0, 40, 0), (0, 0, 40 * math.cos(g), 40 * math.sin(g))], R, W)
        both = sorted(x for x in (a, df.sparkSession.range(1).select(geo.gap_area(F.lit(2 * math.pi - g), R, W).alias("v")).first()["v"]) if x > 1e-9)
        assert len(both) == len(walked) and all(abs(x - y) < 1e-6 for x, y in zip(both, walked, strict=True)), g


def test_edges_that_pass_by_count(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    lines = spark.createDataFrame([("a", p((0, 0), (40, 0), (80, 3))), ("b", p((40, -1000), (41, 1200))), ("c", p((500, 500), (501, 500), (540, 500)))], "k string, line array<struct<x:double,y:double>>")
    nodes, edges = boq.graph_tables(lines, "k")
    at = {r["node_id"]: (r["x"], r["y"]) for r in nodes.collect()}
    whole = {at[r["node_id"]]: r for r in boq.turns(nodes, edges).collect()}
    own = {at[r["node_id"]]: r for r in boq.turns(nodes, edges, own=True).collect()}
    assert own[40.0, 0.0]["kind"] == "straight" and whole[40.0, 0.0]["kind"] == "branch" and whole[40.0, 0.0]["parts"] == 4
    assert whole[0.0, 0.0]["kind"] == "end" and whole[0.0, 0.0]["ratio"] is None
    # An edge shorter than the disc cuts with what follows it.
    assert whole[501.0, 500.0]["parts"] == 1 and own[501.0, 500.0]["parts"] == 2
    assert boq.turns(nodes.limit(0), edges.limit(0)).count() == 0
