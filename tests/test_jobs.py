"""The planning jobs over whole tables, on small ones, against brute force."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fiberloom.functions import kernel
from fiberloom.operators import components, insert, network, rings, spatial
from fiberloom.plans import boq as bills
from fiberloom.plans import jobs
from fiberloom.plans import rings as plans
from fiberloom.plans.fixtures import view


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Two rings of six sites whose names and places are beyond the first four rings and the square's edge."""
    d = str(tmp_path_factory.mktemp("jobs"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    write("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    keys = [*range(40, 46), *range(80, 86)]
    write("customer", [(k, f"c{k}", 0, "BUILDING") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    write("part", [(k, k * 7 % 50 + 1, "STANDARD") for k in range(40 * 52)], "p_partkey long, p_size int, p_type string")
    write("supplier", [(k, f"s{k}", 0) for k in range(1, 30)], "s_suppkey long, s_name string, s_nationkey int")
    return d


def test_jobs_plan_every_ring_at_least_cost(spark, small):
    sites = [r.asDict() for r in view(spark, small, "site_rings").collect()]
    assert any(r["x"] >= 49_000 for r in sites)
    nodes = view(spark, small, "road_nodes").collect()
    near = {r["site_id"]: min(nodes, key=lambda n: (math.dist((n["x"], n["y"]), (r["x"], r["y"])), n["node_id"]))["node_id"] for r in sites}  # noqa: B023
    around = jobs.roads_of(view(spark, small, "site_rings"), rings.edge_costs(view(spark, small, "road_edges"), view(spark, small, "road_nodes")), view(spark, small, "road_nodes"), "ring_name").collect()
    names = {r["ring_name"] for r in sites}
    planned, fixed = jobs.job_supervised(spark, small).collect(), jobs.job_fixroute(spark, small).collect()
    assert len(names) == 2 and names == {r["ring_name"] for r in planned} == {r["ring_name"] for r in fixed}
    for name in names:
        hub, *rest = [near[r["site_id"]] for r in sorted(sites, key=lambda r: r["seq"]) if r["ring_name"] == name]
        graph = network.adjacency((r["node_start"], r["node_end"], r["weight"]) for r in around if r["ring_name"] == name)
        cost = {n: network.dijkstra(graph, [n])[0] for n in (hub, *rest)}
        walk = lambda order: sum(cost[a][b] for a, b in zip((hub, *order), (*order, hub), strict=True))  # noqa: B023, E731
        hops = sorted((r["seq"], r["start"], r["end"]) for r in planned if r["ring_name"] == name)
        assert hops[0][1] == hops[-1][2] == hub and {h[1] for h in hops} == {hub, *rest}
        assert sum(cost[a][b] for _, a, b in hops) == pytest.approx(min(map(walk, itertools.permutations(rest))))
        assert sum(r["ring_name"] == name for r in fixed) == len(rest)


def test_utilization_meets_fiber_wherever_it_starts(spark):
    lines = {"far end": [(4500.0, 10.0), (5000.0, 10.0)], "diagonal": [(0.0, 0.0), (3000.0, 4000.0)], "away": [(4500.0, 30.0), (5000.0, 30.0)]}
    fiber = {"straight": [(0.0, 0.0), (5000.0, 0.0)], "slope": [(-3000.0, -4000.0), (6000.0, 8000.0)], "next": [(5000.0, 10.0), (6250.0, 10.0)]}
    table = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} string, line array<struct<x:double,y:double>>")
    near = lambda p, q: kernel.near_spans(p, q, 20.0)
    want = {(r, f): sum(b - a for a, b in near(p, q)) for r, p in lines.items() for f, q in fiber.items()}
    got = {(r["ring_name"], r["fiber"]): r["existing"] for r in jobs.fiber_utilization(table(lines, "ring_name"), table(fiber, "name")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items() if v} == got
    assert got["far end", "straight"] == pytest.approx(500.0) and got["diagonal", "slope"] == pytest.approx(5000.0)


def plain_linkage(d, limit=None, groups=None):
    clusters = {i: [i] for i in range(len(d))}
    while len(clusters) > (groups or 1):
        c, i, j = min((max(d[p][q] for p in clusters[i] for q in clusters[j]), i, j) for i in clusters for j in clusters if i < j)
        if limit is not None and c >= limit:
            break
        clusters[i] += clusters.pop(j)
    return [next(k for k, m in clusters.items() if i in m) for i in range(len(d))]


def test_linkage_of_many_ties_is_the_plain_one():
    rng = random.Random(3)
    for n in (1, 2, 9, 14):
        d = [[0] * n for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            d[i][j] = d[j][i] = rng.randrange(5)
        for more in ({"limit": 3}, {"groups": 2}, {}):
            assert network.complete_linkage(d, **more) == plain_linkage(d, **more)


@pytest.mark.parametrize("reach", [10.0, 25.0, 60.0])
def test_blobs_equal_components_of_all_pairs(spark, reach):
    rng = random.Random(int(reach))
    sites = spark.createDataFrame([(k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(150)], "ord long, x double, y double")
    want = {r["id"]: r["component"] for r in components.connected(spatial.self_pairs(sites, "ord", reach).select("a", "b"), sites.selectExpr("ord as id")).collect()}
    assert {r["id"]: r["component"] for r in jobs.blobs(sites, reach).collect()} == want


def test_clusters_cover_every_site(spark, small, tmp_path):
    """Sites beyond the first 200, some on one node, against distances and linkage of each component as a whole."""
    for t in ("region", "nation", "part", "supplier"):
        os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    keys = [k for k in range(1, 1500) if k * 7919 % 50000 < 16000 and k * 104729 % 50000 < 12000][:60] + [*range(1300, 1320)]
    spark.createDataFrame([(k, f"c{k}", 0, "BUILDING") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    d = str(tmp_path)
    sites, nodes = view(spark, d, "sites"), view(spark, d, "road_nodes")
    pts = jobs.snapped(sites, nodes).join(components.connected(spatial.self_pairs(sites, "ord", 10_000.0).select("a", "b"), sites.selectExpr("ord as id")).withColumnRenamed("id", "ord"), "ord").collect()
    graph = network.adjacency((r["node_start"], r["node_end"], r["length"]) for r in rings.edge_costs(view(spark, d, "road_edges"), nodes, "route").collect())
    want = set()
    for c in {r["component"] for r in pts}:
        own = sorted((r["site_id"], r["node"]) for r in pts if r["component"] == c)
        cost = {n: network.dijkstra(graph, [n], 10_000.0)[0] for _, n in own}
        m = [[0.0 if i == j else cost[a].get(b, 1e10) for j, (_, b) in enumerate(own)] for i, (_, a) in enumerate(own)]
        labels = plain_linkage(m, limit=10_000.0)
        for _ in range(5):
            for k in {k for k in labels if labels.count(k) > 10}:
                at = [i for i, x in enumerate(labels) if x == k]
                for i, x in zip(at, plain_linkage([[m[i][j] for j in at] for i in at], groups=math.ceil(len(at) / 8)), strict=True):
                    labels[i] = at[x]
        want |= {frozenset(own[i][0] for i, x in enumerate(labels) if x == k) for k in labels}
    got = {}
    for r in jobs.job_unsupervised(spark, d).where("flag = ''").collect():
        got.setdefault(r["ring_name"], set()).add(r["site_id"])
    assert sum(map(len, got.values())) == len(keys) and {frozenset(v) for v in got.values()} == want


def test_road_queries_hold_every_ring_member(spark, small):
    members = {(r["ring_name"], r["site_id"]) for r in view(spark, small, "site_rings").collect()}
    pts, e = plans._ring_nodes(spark, small)
    node, roads = {r["site_id"]: r["node"] for r in pts.collect()}, e.collect()
    assert {(r["ring_name"], r["site_id"]) for r in pts.collect()} == members
    got = {(r["site_i"], r["site_j"]): r["dist"] for r in plans.gr_01(spark, small).collect()}
    want = {}
    for name in {r for r, _ in members}:
        graph = network.adjacency((r["node_start"], r["node_end"], r["weight"]) for r in roads if r["ring_name"] == name)
        ids = [i for r, i in members if r == name]
        cost = {i: network.dijkstra(graph, [node[i]], 9e8)[0] for i in ids}
        want |= {(i, j): cost[i][node[j]] for i in ids for j in ids if i != j and node[j] in cost[i]}
    assert want and got == pytest.approx(want)
    for query in (plans.tsp_05, plans.cl_02):
        assert {(r["ring_name"], r["site_id"]) for r in query(spark, small).collect()} == members
    hops = plans.gr_02(spark, small).collect()
    assert len(hops) == len(members) - 2 and {h["start"] for h in hops} | {h["end"] for h in hops} == set(node.values())


def test_routes_pass_every_site_of_a_ring(spark, small):
    rows = view(spark, small, "site_rings").collect()
    ends = [r for r in rows if r["seq"] == max(q["seq"] for q in rows if q["ring_name"] == r["ring_name"])]
    assert {(r["x"], r["y"]) for r in bills.geo_18(spark, small).collect()} >= {(r["x"], r["y"]) for r in ends}
    assert all(r["otb_distance"] == 0 for r in bills.boq_01(spark, small).collect() if r["site_id"] in {e["site_id"] for e in ends})
    length = {}
    for a, b in itertools.pairwise(sorted(rows, key=lambda r: (r["ring_name"], r["seq"]))):
        if a["ring_name"] == b["ring_name"]:
            length[a["ring_name"]] = length.get(a["ring_name"], 0) + math.dist((a["x"], a["y"]), (b["x"], b["y"]))
    for r in bills.geo_19(spark, small).collect():
        assert r["access_length"] + r["backbone_length"] == pytest.approx(length[r["line_id"]], abs=1e-3)
    for r in (*bills.geo_14(spark, small).collect(), *bills.geo_21(spark, small).collect()):
        assert r["existing"] + r["new"] == pytest.approx(length[r["line_id"]], abs=0.2)


def test_alike_groups_share_one_search(spark, monkeypatch):
    rnd = random.Random(3)
    nodes = [(i * 10 + j, i * 1000.0, j * 1000.0) for i in range(6) for j in range(6)]
    roads = [(a, b, float(rnd.randrange(900, 1500))) for a, x, y in nodes for b, u, v in nodes if abs(x - u) + abs(y - v) == 1000 and a < b]
    shapes = [[rnd.choice(nodes) for _ in range(4)] for _ in range(3)]
    pts = [(f"R{r}", f"s{r}-{k}", n, x, y) for r in range(9) for k, (n, x, y) in enumerate(shapes[r % 3])]
    p = spark.createDataFrame(pts, "ring string, site_id string, node long, x double, y double")
    e = spark.createDataFrame(roads, "node_start long, node_end long, weight double")
    n = spark.createDataFrame(nodes, "node_id long, x double, y double")
    want = sorted(tuple(r) for r in network.distances(p.select("ring", "site_id", "node"), spark.createDataFrame(jobs.roads_of(p, e, n, "ring").collect()), "ring", 5000.0).collect())
    seen, plain = [], jobs.roads_of
    monkeypatch.setattr(jobs, "roads_of", lambda points, *a: seen.append(points.select("ring").distinct().count()) or plain(points, *a))
    assert sorted(tuple(r) for r in jobs.road_distances(p, e, n, "ring", 5000.0).collect()) == want
    assert seen == [3]


def test_sites_at_one_place_are_shared_out(spark):
    places = [(0.0, 0.0), (500.0, 0.0), (500.0, 900.0)]
    sites = spark.createDataFrame([(f"s{r}{k}", x, y) for r in range(2) for k, (x, y) in enumerate(places)] + [("s9", 0.0, 5000.0)], "site_id string, x double, y double")
    line = [{"x": x, "y": y} for x, y in places]
    lines = spark.createDataFrame([("R0", line), ("R1", line)], "ring_name string, line array<struct<x: double, y: double>>")
    got = sorted((r["ring_name"], r["seq"], r["site_id"]) for r in insert.drawn_order(lines, sites).collect())
    assert got == [(f"R{r}", k, f"s{r}{k}") for r in range(2) for k in range(3)]


def test_rings_with_the_same_ends_are_routed_once(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, i * 1000.0, 0.0, 0) for i in range(6)], "node_id long, x double, y double, ref_fo int")
    edges = spark.createDataFrame([(i, i + 1, 1000.0, "primary", 0) for i in range(5)], "node_start long, node_end long, length double, highway string, ref_fo int")
    pairs = spark.createDataFrame([(f"R{r}", k, k * 1000.0 + r % 2, 0.0, k * 1000.0 + 2000.0, 0.0) for r in range(6) for k in range(3)], "ring_name string, seq int, ax double, ay double, bx double, by double")
    seen, plain = [], network.routes
    monkeypatch.setattr(network, "routes", lambda hops, *a, **kw: seen.append(hops.count()) or plain(hops, *a, **kw))
    got = jobs.fixroute(pairs, edges, nodes).collect()
    assert seen == [6] and len(got) == 18
    costs = {(r["ring_name"], r["seq"]): (r["nodes"], r["cost"], r["length"]) for r in got}
    assert all(costs[f"R{r}", k] == costs[f"R{r % 2}", k] for r in range(6) for k in range(3))


def test_rings_beyond_9999_have_names_of_their_own(spark):
    sites = spark.range(10_050).select(F.format_string("S%06d", "id").alias("site_id"), F.when(F.col("id") < 10_020, "R").alias("region"))
    rows = jobs._named(sites.select("site_id", F.col("site_id").alias("label")), sites).collect()
    names = {r["site_id"]: r["ring_name"] for r in rows}
    assert len(rows) == 10_050 and len(set(names.values())) == 10_050
    assert (names["S000000"], names["S009999"], names["S010020"]) == ("R_0001", "R_10000", "0001")
