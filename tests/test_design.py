"""Operators that SQL can't check: against plain versions on small fixtures."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from fiberloom.functions import kernel
from fiberloom.operators import boq, components, fwa, insert, intake, network, overlay, rings, spatial, tables
from fiberloom.runtime import skewed_join
from fiberloom.sources import files, reports, vector, xlsx

POINT = "array<struct<x:double,y:double>>"


def grid(n, group="R"):
    """Road grid of n x n nodes, 100 m apart; node = row * n + column."""
    edges = [(group, r * n + c, r * n + c + 1, 100.0 + c, 100.0) for r in range(n) for c in range(n - 1)]
    return edges + [(group, r * n + c, (r + 1) * n + c, 101.0 + r, 100.0) for r in range(n - 1) for c in range(n)]


def all_pairs(edges):
    nodes = sorted({v for e in edges for v in e[1:3]})
    d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for _, a, b, w, _ in edges:
        d[a, b] = d[b, a] = min(w, d[a, b])
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


EDGE = "ring_name string, node_start long, node_end long, weight double, length double"


def test_road_searches_equal_all_pairs(spark):
    edges = grid(5)
    d = all_pairs(edges)
    roads = spark.createDataFrame(edges, EDGE)
    points = spark.createDataFrame([("R", "a", 0), ("R", "b", 12), ("R", "c", 24), ("S", "d", 7)], "ring_name string, site_id string, node long")
    got = {(r["site_i"], r["site_j"]): r["dist"] for r in network.distances(points, roads, "ring_name", 450.0).collect()}
    at = {"a": 0, "b": 12, "c": 24}
    assert got == {(i, j): d[p, q] for i, p in at.items() for j, q in at.items() if i != j and d[p, q] <= 450.0}

    hubs = spark.createDataFrame([("R", "h1", 4), ("R", "h2", 20), ("R", "h3", 23), ("R", "h4", 23)], "ring_name string, hub_id string, node long")
    found = sorted((r["dist"], r["hub_id"], r["flag"]) for r in network.nearest_hubs(points, hubs, roads, "ring_name", 350.0).collect())
    want = sorted((min(d[p, n] for p in at.values()), h) for h, n in (("h1", 4), ("h2", 20), ("h3", 23)))
    want = [(x, h) for x, h in want if x <= 350.0][:2]
    assert found == [(x, h, f) for (x, h), f in zip(want, ("start", "end"), strict=False)]

    fiber = spark.createDataFrame([("R", 2), ("R", 22)], "ring_name string, node long")
    lit = {r["site_id"]: (r["fiber_node"], r["dist"]) for r in network.nearest_fiber(points, fiber, roads, "ring_name", 250.0).collect()}
    assert lit == {s: min((d[n, f], f) for f in (2, 22))[::-1] if min(d[n, f] for f in (2, 22)) <= 250.0 else (None, None) for s, n in at.items()} | {"d": (None, None)}


def test_walks():
    assert network.follow([("a", "b"), ("b", "c")], "a", {"a", "c"}) == (["a", "b", "c"], "hub")
    assert network.follow([("a", "b"), ("b", "a")], "a", {"a"}) == (["a", "b"], "hub")
    assert network.follow([("a", "b"), ("b", "c"), ("c", "b")], "a", {"a"}) == (["a", "b", "c"], "loop")
    assert network.follow([("a", "b")], "a", {"a"}) == (["a", "b"], "dead end")


def test_routes_after_insertion(spark):
    edges = grid(4)
    roads = spark.createDataFrame(edges, EDGE)
    xy = {n: (100.0 * (n % 4), 100.0 * (n // 4)) for n in range(16)}
    places = spark.createDataFrame([("R", n, *p) for n, p in xy.items()], "ring_name string, node long, x double, y double")
    stops = [("h", "existing", 0), ("a", "existing", 3), ("n", "insert", 7), ("b", "existing", 15)]
    order = spark.createDataFrame([("R", i, s, note, n, xy[n][0], xy[n][1] + 5) for i, (s, note, n) in enumerate(stops)], "ring_name string, place int, site_id string, note string, node long, x double, y double")
    line = lambda *ns: [xy[n] for n in ns]
    previous = spark.createDataFrame([("R", "a", "h", line(3, 2, 1, 0)), ("R", "a", "b", line(3, 7, 11, 15))], f"ring_name string, near_end string, far_end string, line {POINT}")
    got = {(r["near_end"], r["far_end"]): (r["existing_length"], r["new_length"], r["length"], r["route_type"]) for r in network.insertion_routes(order, roads, places, previous).collect()}
    assert got["h", "a"] == (300.0, 0.0, 300.0, "Existing Route")
    # Drop wires of 5 m at both ends; all of it runs along the segment that it replaces.
    assert got["a", "n"] == (110.0, 0.0, 110.0, "New Route")
    assert got["n", "b"] == (210.0, 0.0, 210.0, "New Route")


def test_spans_equal_samples():
    rng = random.Random(4)
    for _ in range(60):
        line = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(4)]
        other = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(3)]
        spans = kernel.near_spans(line, other, 15.0)
        n = kernel.length(line)
        for i in range(201):
            m = n * i / 200
            x, y = (kernel.substring(line, m, m) or [line[-1]])[0]
            far = kernel.measure(other, x, y)[1]
            if abs(far - 15.0) > 1e-3:
                assert (far < 15.0) == any(a - 1e-6 <= m <= b + 1e-6 for a, b in spans)


def test_overlay(spark):
    line = [(0.0, 0.0), (10_000.0, 0.0)]
    pairs = spark.createDataFrame([("near", line, [(1000.0, 5.0), (2000.0, 5.0), (2500.0, 500.0), (3000.0, 5.0), (4000.0, 5.0)]), ("apart", line, [(0.0, 5.0), (10.0, 900.0), (5000.0, 900.0), (5010.0, 5.0)]), ("none", line, [(0.0, 99.0), (9.0, 99.0)])], f"line_id string, line {POINT}, other {POINT}")
    got = {r["line_id"]: (r["first"], r["last"], r["length"]) for r in overlay.overlay_span(pairs, 20.0, 1000.0).collect()}
    assert got["none"] == (None, None, 0.0)
    assert got["near"][0] == pytest.approx(980.6, abs=0.1) and got["near"][2] == pytest.approx(got["near"][1] - got["near"][0])
    assert got["apart"][2] < 100 and got["apart"][1] > 4900  # the gap beyond 1000 m doesn't count

    hubs = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 9000.0, 0.0)], "ord long, x double, y double")
    r = overlay.circle_overlaps(hubs, "ord", 800.0, 256).collect()
    lens = 2 * 800**2 * math.acos(500 / 800) - 500 * math.sqrt(4 * 800**2 - 1000**2)
    assert [(x["a"], x["b"]) for x in r] == [(1, 2)] and r[0]["area"] == pytest.approx(lens, rel=1e-3)


def test_area_outside_equals_samples():
    rng = random.Random(2)
    for _ in range(10):
        ring = kernel.polygon(0, 0, 10, 16)
        windows = [kernel.polygon(rng.uniform(-12, 12), rng.uniform(-12, 12), rng.uniform(3, 12), 16) for _ in range(4)]
        inside = lambda p, w: all((w[k][0] - w[k - 1][0]) * (p[1] - w[k - 1][1]) - (w[k][1] - w[k - 1][1]) * (p[0] - w[k - 1][0]) >= 0 for k in range(len(w)))
        cells = [(x / 10, y / 10) for x in range(-100, 101) for y in range(-100, 101)]
        want = sum(inside(p, ring) and not any(inside(p, w) for w in windows) for p in cells) / 100
        assert kernel.area_outside(ring, windows) == pytest.approx(want, abs=4)


def test_protected_sites(spark):
    sites = spark.createDataFrame([(1, "a", "Rooftop", 0.0, 0.0, 50), (2, "b", "Green Field", 100.0, 0.0, 1), (3, "c", "Rooftop", 150.0, 0.0, 90), (4, "d", "Rooftop", 9000.0, 0.0, 0)], "ord long, site_id string, site_type string, x double, y double, total_homepass long")
    kept = lambda ids: {r["site_id"] for r in fwa.clean_protected(sites, spark.createDataFrame([(i,) for i in ids], "site_id string")).where("kept").collect()}
    assert kept(["x"]) == {"b", "d"}
    assert kept(["a"]) == {"a", "d"}
    assert kept(["a", "c"]) == {"a", "c", "d"}


def test_best_coverage(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 5, 1, 1), (2, 900.0, 0.0, 9, 1, 1), (3, 950.0, 0.0, 1, 1, 1), (4, 9000.0, 0.0, 0, 2, 1)], "ord long, x double, y double, homes long, site_score int, tower_score int")
    got = {r["ord"]: r["kept"] for r in fwa.best_coverage(sites, 500.0).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}  # 3 adds more area to 1 than 2 does, and then covers 2


def test_accepted_sectors(spark):
    rng = random.Random(1)
    sites = spark.createDataFrame([(1, "a", "Rooftop", 0.0, 0.0), (2, "b", "Rooftop", 300.0, 0.0), (3, "c", "Rooftop", 5000.0, 0.0)], "ord long, site_id string, site_type string, x double, y double")
    homes = [(i, rng.uniform(-600, 900), rng.uniform(-600, 600), 60.0) for i in range(300)] + [(500 + i, 5000 + rng.uniform(-300, 300), rng.uniform(-300, 300), 60.0) for i in range(100)]
    buildings = spark.createDataFrame(homes, "building_id long, x double, y double, area_in_meters double")
    got = fwa.accept_sectors(sites, buildings, spark.createDataFrame([("a",)], "site_id string"), 500.0, threshold=5).collect()
    rounds = {s: {r["round"] for r in got if r["site_id"] == s} for s in "abc"}
    assert rounds["a"] == {0} and sum(r["site_id"] == "a" for r in got) == 3
    assert rounds["c"] == {1} and sum(r["site_id"] == "c" for r in got) == 3
    assert all(r["total_homepass"] > 0 for r in got)
    assert sum(r["site_id"] == "b" for r in got) < 3  # what overlaps the protected site's sectors does not come in


def test_bill(spark):
    points = spark.createDataFrame([("R", "a", 0.0, 0.0), ("R", "b", 5000.0, 0.0)], "ring_name string, site_id string, x double, y double")
    lines = spark.createDataFrame([("R", "a-b", "a", "b", [(0.0, 0.0), (200.0, 0.0), (200.0, 100.0), (4800.0, 100.0), (4800.0, 0.0), (5000.0, 0.0)])], f"ring_name string, line_id string, near_end string, far_end string, line {POINT}")
    fiber = spark.createDataFrame([("F1", [(1000.0, 110.0), (2500.0, 110.0)]), ("F2", [(1100.0, 95.0), (1700.0, 95.0)]), ("F3", [(3000.0, 110.0), (3300.0, 110.0)]), ("F4", [(4000.0, 500.0), (4300.0, 500.0)])], f"fiber string, ref {POINT}")
    barriers = spark.createDataFrame([("Rail", 3700.0, -50.0, 3700.0, 500.0), ("Toll", 0.0, 900.0, 5000.0, 900.0)], "name string, ax double, ay double, bx double, by double")
    found = boq.bill(points, lines, fiber, barriers)
    (cut,) = found["lines"].collect()
    assert (cut["length"], cut["access_ne"], cut["access_fe"], cut["backbone"]) == (5200.0, 200.0, 200.0, 4800.0)
    runs = {r["fiber"]: (r["class"], round(r["length"], 1)) for r in found["stretches"].collect()}
    assert runs == {"F1": ("fo_exist", 1556.6), "F3": ("pole_exist", 356.6)}  # F2 lies within F1
    layers = [(r["layer"], r["name"]) for r in boq.compiled(found).collect()]
    assert sorted(layers) == sorted([("odp", "ODP a"), ("odp", "ODP b"), ("otb", "OTB a"), ("otb", "OTB b"), ("closure", "Closure a-b"), ("closure", "Closure a-b"), ("backbone", "BB a-b"), ("access_ne", "Access a-b"), ("access_fe", "Access a-b"), ("fo_exist", "a-b/F1"), ("pole_exist", "a-b/POLE EXT"), ("obstacle_railway", "Obstacle Rail a-b")])


def test_vector_files(spark, tmp_path):
    tables = {"lines": [({"name": "a", "n": "1"}, "line", [(0.0, 1.0), (2.0, 3.0)]), ({"name": None}, "point", [(5.0, 6.0)])], "areas": [({}, "polygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]}
    (tmp_path / "x.gpkg").write_bytes(vector.package(tables))
    got = sorted((r["layer"], r["kind"], r["data"].get("name"), [(p["x"], p["y"]) for p in r["line"]]) for r in files.read_table(spark, str(tmp_path / "x.gpkg")).collect())
    assert got == [("areas", "polygon", None, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("lines", "line", "a", [(0.0, 1.0), (2.0, 3.0)]), ("lines", "point", None, [(5.0, 6.0)])]
    point = struct.pack("<i2d", 1, 7.0, 8.0)
    run = struct.pack("<i4d2i", 3, 0, 0, 0, 0, 2, 4) + struct.pack("<2i", 0, 2) + struct.pack("<8d", *range(8))
    body = b"".join(struct.pack(">2i", i + 1, len(x) // 2) + x for i, x in enumerate((point, struct.pack("<i", 0), run)))
    (tmp_path / "s.shp").write_bytes(bytes(100) + body)
    field = b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15)
    rows = b"".join(b" " + n.ljust(6) for n in (b"one", b"two", b"three"))
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 3, 65, 7) + bytes(20) + field + b"\r" + rows)
    got = [(r["id"], r["kind"], r["data"], [(p["x"], p["y"]) for p in r["line"]]) for r in files.read_table(spark, str(tmp_path / "s.shp")).collect()]
    assert got == [(0, "point", {"name": "one"}, [(7.0, 8.0)]), (2, "line", {"name": "three"}, [(0.0, 1.0), (2.0, 3.0)]), (2, "line", {"name": "three"}, [(4.0, 5.0), (6.0, 7.0)])]


def test_routing_template(spark, tmp_path):
    import pandas as pd

    sheet = pd.DataFrame({"site": ["a"], "Longitude": [106.8], "Latitude": [-6.2]})
    (tmp_path / "t.xlsx").write_bytes(xlsx.workbook({"Origin": sheet, "Destination": sheet}))
    origin, destination = files.routing_template(spark, str(tmp_path / "t.xlsx"))
    assert origin.first()["x"] == pytest.approx(11888921, abs=1e3) and destination.count() == 1
    (tmp_path / "u.xlsx").write_bytes(xlsx.workbook({"Origin": sheet}))
    with pytest.raises(ValueError, match="Destination"):
        files.routing_template(spark, str(tmp_path / "u.xlsx"))


def test_intake_refuses(spark):
    table = spark.createDataFrame([("a", "b")], "site_id string, site_name string")
    with pytest.raises(ValueError, match="missing columns"):
        intake.new_ring(table, "supervised")
    with pytest.raises(ValueError, match="method"):
        intake.new_ring(table, "other")
    with pytest.raises(ValueError, match="Hub Sites"):
        intake.insert_sheets({"New Sites": table, "Existing Sites": table})
    with pytest.raises(ValueError, match="route_type"):
        reports.update_report(table, "other")


def test_numbers_hulls_and_matches(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int")
    got = tables.numbered(rows.repartition(5), ["v"]).orderBy("v").collect()
    assert [r["no"] for r in got] == list(range(1, 102))
    square = spark.createDataFrame([("a", float(x), float(y)) for x in range(5) for y in range(5)] + [("b", 1.0, 1.0)], "k string, x double, y double")
    got = [(r["k"], r["x"], r["y"]) for r in spatial.hulls(square.repartition(4), "k").orderBy("k", "vertex").collect()]
    assert got == [("a", 0.0, 0.0), ("a", 4.0, 0.0), ("a", 4.0, 4.0), ("a", 0.0, 4.0), ("b", 1.0, 1.0)]
    words = spark.createDataFrame([("latitude",), ("zzz",), (None,)], "word string")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["long", "lat", "latitud", "latitud"])], "ord int, name string")
    for block in (1, 100):
        got = {r["word"]: (r["match"], round(r["score"], 3)) for r in tables.best_match(words, names, 0.8, block).collect()}
        assert got == {"latitude": ("latitud", 0.975), "zzz": ("zzz", 0.0), None: (None, 0.0)}


def test_components_of_a_hub_and_hot_keys(spark, monkeypatch):
    from fiberloom import runtime

    rng = random.Random(3)
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    links = [e for e in links if e[0] != e[1]]
    for bound in (1_000_000, 3):  # broadcast, and shuffled
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
        got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {v: root(v) for e in links for v in e}
        monkeypatch.setattr(runtime, "HOT_KEY", 5)
        rows = spark.createDataFrame([(i % 7 if i < 60 else 7,) for i in range(200)], "k int")
        table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(r["n"] for r in skewed_join(rows, table, "k", "n").collect()) == sorted([9] * 4 * 9 + [8] * 3 * 8 + [140] * 140)


def test_hub_assignment_without_centroid(spark):
    sites = spark.createDataFrame([("r1", "a", 0.0, 0.0), ("r1", "b", 10.0, 0.0), ("r2", "c", 9000.0, 0.0), ("r3", "d", 5000.0, 0.0), ("r3", "e", 5001.0, 0.0)], "ring_name string, site_id string, x double, y double")
    hubs = spark.createDataFrame([("h", 0.0, 50.0)], "site_id string, x double, y double")
    got = sorted((r["ring_name"], r["outcome"], r["hub_id"], r["flag"]) for r in rings.hub_assignment(sites, hubs, 100.0).collect())
    assert got == [("r1", "assigned", "h", "start"), ("r2", "standalone", None, None), ("r3", "dropped", None, None)]


def test_insert_keeps_limits(spark):
    members = spark.createDataFrame([("R", i, f"s{i}", "FO Hub" if i in (0, 5) else "Site") for i in range(6)], "ring_name string, seq int, site_id string, site_type string")
    new = spark.createDataFrame([("R", f"n{i}", "s2", float(9 - i)) for i in range(6)], "ring_name string, site_id string, near_end string, dist double")
    got = [r["site_id"] for r in insert.inserted(members, new, 6).orderBy("place").collect()]
    assert got == ["s0", "s1", "s2", "n5", "n4", "s3", "s4", "s5"]


def test_rounds_equal_greedy(spark, monkeypatch):
    import pandas as pd

    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    score = {i: [rng.randrange(3), rng.randrange(4)] for i in range(60)}
    plain = fwa._greedy(pd.DataFrame([(a, b, score[a], score[b]) for a, b in pairs], columns=["a", "b", "sa", "sb"]))["ord"].tolist()
    p = spark.createDataFrame(pairs, "a long, b long")
    s = spark.createDataFrame([(i, v) for i, v in score.items()], "ord long, score array<long>")
    for bound in (20_000, 0):
        monkeypatch.setattr(fwa, "ONE_TASK", bound)
        assert sorted(r["ord"] for r in fwa.eliminate(p, s).collect()) == plain


def test_centerline_equals_plain_version(spark):
    rng = random.Random(9)
    lines = []
    for i in range(25):
        x, y, n = rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(200, 2500)
        for _ in range(4):
            a, b = sorted((rng.uniform(0, n), rng.uniform(0, n)))
            off = rng.choice([0.0, 0.4, 0.9, 1.5])
            lines.append((x + a, y + off, x + b, y + off) if i % 2 else (x + off, y + b, x + off, y + a))
    lines += lines[:3]
    rows = [(i * 31 % 1009, *p) for i, p in enumerate(lines)]
    kept = []
    for o, a, b, c, d in sorted(rows, key=lambda r: (-((r[1] - r[3]) ** 2 + (r[2] - r[4]) ** 2), r[0])):
        if not any(kernel.measure(s, a, b)[1] <= 1.0 and kernel.measure(s, c, d)[1] <= 1.0 for _, s in kept):
            kept.append((o, ((a, b), (c, d))))
    got = boq.centerline(spark.createDataFrame(rows, "ord long, ax double, ay double, bx double, by double"), 1.0)
    assert sorted(r["ord"] for r in got.collect()) == sorted(o for o, _ in kept)


def test_cells_of_a_hull(spark):
    points = spark.createDataFrame([(0.0, 0.0), (95.0, 0.0), (0.0, 95.0)], "x double, y double")
    got = {r["cell"] for r in files.cells_over(points, "hull", 10.0, 3.0).collect()}
    inside = lambda x, y: x >= 0 and y >= 0 and x + y <= 95
    far = lambda x, y: 0.0 if inside(x, y) else kernel.measure([(0, 0), (95, 0), (0, 95), (0, 0)], x, y)[1]
    want = {f"{i}_{j}" for i in range(-1, 10) for j in range(-1, 10) if min(far(i * 10 + a / 4, j * 10 + b / 4) for a in range(41) for b in range(41)) <= 3.0}
    assert got == want
    assert files.cells_over(points, "box", 10.0, 3.0).count() == 11 * 11
    with pytest.raises(ValueError, match="no points"):
        files.cells_over(points.limit(0))


def test_kmeans(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(i, rng.uniform(0, 9) + 1000 * (i % 2), rng.uniform(0, 9)) for i in range(40)], "ord int, x double, y double")
    labels = {(r["ord"] % 2, r["label"]) for r in rings.kmeans(points, 2).collect()}
    assert len(labels) == 2


def test_names_between_dashes(spark):
    names = spark.createDataFrame([("-AB1-xAB2- route",), ("AB2 AB1-AB2",), ("none-AB1",), ("AB1",)], "name string")
    ids = spark.createDataFrame([("AB1",), ("AB2",)], "site_id string")
    got = {r["name"]: (r["near_end"], r["far_end"]) for r in tables.near_far(names, ids).collect()}
    assert got == {"-AB1-xAB2- route": ("AB1", "AB2"), "AB2 AB1-AB2": ("AB1", "AB2"), "none-AB1": (None, "AB1"), "AB1": ("AB1", "AB1")}


def test_rings_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(rings, "ROWS", 10)
    sites = spark.range(200).select(F.concat(F.lit("R"), (F.col("id") / 4).cast("int").cast("string")).alias("ring_name"), F.format_string("S%03d", "id").alias("site_id"), (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    hubs = spark.createDataFrame([("H1", 0.0, 5.0), ("H2", 1000.0, 5.0)], "site_id string, x double, y double")
    found = rings.ring_hubs(sites, hubs, 50.0)
    assert found.rdd.getNumPartitions() == 20
    rows = {(r["ring_name"], r["outcome"], r["hub_id"]) for r in rings.hub_assignment(sites, hubs, 50.0, use_centroid=True).collect()}
    assert len(rows) == 50 and {r for r in rows if r[1] == "assigned"} == {("R0", "assigned", "H1"), ("R1", "assigned", "H1"), ("R24", "assigned", "H2"), ("R25", "assigned", "H2"), ("R26", "assigned", "H2")}
