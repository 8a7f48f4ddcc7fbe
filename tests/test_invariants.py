"""Queries without SQL hold what they promise on the smallest data."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fiberloom.operators import fwa as wireless
from fiberloom.plans import fwa, jobs
from fiberloom.plans.fixtures import view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
QUERIES = queries()


FOUND = {}


def rows(spark, name):
    """Rows of a query, which runs once."""
    if name not in FOUND:
        FOUND[name] = QUERIES[name](spark, SF).collect()
    return FOUND[name]


def chained(hops):
    """Hops of each ring by their number."""
    out = {}
    for r in sorted(hops, key=lambda r: r["seq"]):
        out.setdefault(r["ring_name"], []).append(r)
    return out


def test_supervised_rings(spark):
    members = {r["ring_name"]: r["n"] for r in view(spark, SF, "site_rings").groupBy("ring_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    with_hub = {r["ring_name"] for r in view(spark, SF, "site_rings").where("seq = 0").select("ring_name").collect()}
    found = chained(rows(spark, "JOB-supervised"))
    assert set(found) <= with_hub
    for ring, hops in found.items():
        assert len(hops) <= members[ring]  # one hub: the ring closes
        for a, b in zip(hops, hops[1:], strict=False):
            if b["seq"] == a["seq"] + 1:
                assert a["end"] == b["start"]
        assert all(r["route_type"] in ("initial", "spof", "alternative") and r["length"] >= 0 for r in hops)
    split = {}
    for r in rows(spark, "JOB-supervised-classified"):
        split[r["ring_name"], r["seq"]] = split.get((r["ring_name"], r["seq"]), 0) + r["length"]
    for ring, hops in found.items():
        for r in hops:  # the steps of a path are among the roads with both ends on it
            assert split.get((ring, r["seq"]), 0) <= r["length"] + 1e-6


def test_unsupervised_rings(spark):
    whole = jobs.unsupervised(*[view(spark, SF, n) for n in ("sites", "hubs", "road_edges", "road_nodes")], max_distance=4000.0)
    found = whole["points"].collect()
    apart = [r["site_id"] for k in ("standalone", "dropped") for r in whole[k].select("site_id").collect()]
    sites = [r for r in found if not r["flag"]]
    assert sorted([*apart, *(r["site_id"] for r in sites)]) == sorted(r["site_id"] for r in view(spark, SF, "sites").select("site_id").collect())
    size, hubs = {}, {}
    for r in found:
        (hubs if r["flag"] else size).setdefault(r["ring_name"], []).append(r["flag"])
    assert max(map(len, size.values())) <= 10  # expectation 8, tolerance 2
    assert all(sorted(f) in (["end", "start"], ["start"]) for f in hubs.values()) and set(hubs) == set(size)
    asked = {r["site_id"] for r in rows(spark, "JOB-unsupervised") if not r["flag"]}
    assert asked <= {r["site_id"] for r in view(spark, SF, "sites").select("site_id").collect()}


def test_fixed_routes(spark):
    found = rows(spark, "FIX-01")
    per_ring = chained(found)
    want = {r["ring_name"]: r["n"] - 1 for r in view(spark, SF, "site_rings").groupBy("ring_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()}
    assert {k: len(v) for k, v in per_ring.items()} == want
    assert all(r["cost"] is None or r["length"] >= 0 for r in found)


def test_routes_and_their_feedback(spark):
    plain, cheaper = chained(rows(spark, "GR-02")), chained(rows(spark, "GR-13"))
    assert {k: len(v) for k, v in plain.items()} == {k: len(v) for k, v in cheaper.items()}
    for ring, hops in plain.items():
        for r, c in zip(hops, cheaper[ring], strict=True):
            assert (r["start"], r["end"]) == (c["start"], c["end"])
            assert (r["cost"] is None) == (c["cost"] is None)
            if r["cost"] is not None:
                assert (r["nodes"][0], r["nodes"][-1]) == (r["start"], r["end"]) and c["cost"] <= r["cost"] + 1e-6
    again = chained(rows(spark, "GR-12-reroute"))
    for ring, hops in again.items():
        before = {c["seq"]: c for c in cheaper[ring]}
        for r in hops:
            assert (r["start"], r["end"]) == (before[r["seq"]]["start"], before[r["seq"]]["end"])
            assert r["route_type"] == "alternative" or list(r["nodes"]) == list(before[r["seq"]]["nodes"])


def test_shared_road(spark):
    hops = chained(r for r in rows(spark, "GR-02") if r["cost"] is not None)
    length = {}
    for r in rows(spark, "PRJ-15"):
        length[r["node_start"], r["node_end"]] = r["length"]
    want = {}
    for ring, found in hops.items():
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                both = set(a["nodes"]) & set(b["nodes"])
                shared = sum(n for (u, v), n in length.items() if u in both and v in both)
                if shared > 3000.0:
                    want[ring, a["seq"], b["seq"]] = shared
    assert {(r["ring_name"], r["seq_a"], r["seq_b"]): r["shared"] for r in rows(spark, "GR-12-routes")} == pytest.approx(want)


def test_silhouettes(spark):
    found = rows(spark, "AGG-18")
    labels = {r["site_id"]: (r["ring_name"], r["label"]) for r in rows(spark, "CL-02")}
    dist = {(r["site_i"], r["site_j"]): r["dist"] for r in rows(spark, "GR-01")}
    assert all(-1 <= r["silhouette"] <= 1 for r in found)
    for r in found:  # where all distances are within the query's cutoff, the plain formula gives the same
        i = r["site_id"]
        near = {}
        for j, label in labels.items():
            if label[0] == labels[i][0] and j != i:
                near.setdefault(label[1], []).append(dist.get((i, j)))
        if any(None in v for v in near.values()):
            continue
        mean = {k: sum(v) / len(v) for k, v in near.items()}
        own, other = mean.pop(labels[i][1], None), min(mean.values(), default=None)
        want = 0.0 if own is None or other is None else (other - own) / max(own, other)
        assert r["silhouette"] == pytest.approx(want, abs=1e-9)


def test_sectors(spark):
    for r in rows(spark, "GEO-10"):
        assert r["a"] < r["b"] and 0 < r["percent"] <= 100.001
    base = fwa._sectored(spark, SF)
    kept = {r["sector_id"]: r["kept"] for r in rows(spark, "FWA-02")}
    own = base.where("kept").select("ord", "sector_id")
    names = {r["ord"]: r["sector_id"] for r in own.collect()}
    pairs = [(names[r["a"]], names[r["b"]]) for r in wireless.sector_overlaps(base.where("kept"), 500.0).where("percent >= 10").collect()]
    assert set(kept) == set(names.values())
    assert not any(kept[a] and kept[b] for a, b in pairs)
    assert {s for s, k in kept.items() if not k} <= {s for p in pairs for s in p}
    back = rows(spark, "FWA-05")
    assert not {r["site_id"] for r in back} & {r["site_id"] for r in base.where("kept").select("site_id").distinct().collect()}
    homes = {r["site_id"]: r for r in rows(spark, "FWA-06")}
    counted = {r["site_id"]: r["total_homepass"] for r in rows(spark, "AGG-01")}
    for name, r in homes.items():
        assert 1 <= r["sectors"] <= 3 and r["total_homepass"] <= counted[name]
        assert sum(r[c] for c in fwa.HP) == r["total_homepass"]
    assert all(1 <= r["sectors"] <= 3 and sum(r[c] for c in fwa.HP) == r["total_homepass"] for r in rows(spark, "FWA-07"))


def test_insertion(spark):
    order = {}
    for r in rows(spark, "INS-02"):
        order.setdefault(r["ring_name"], []).append(r)
    dist = {r["site_id"]: r for r in rows(spark, "GR-15")}
    for ring, found in order.items():
        found.sort(key=lambda r: r["place"])
        assert [r["place"] for r in found] == list(range(len(found)))
        for r in found:
            if r["note"] == "insert":
                assert dist[r["site_id"]]["ring_name"] == ring
                at = next(x["place"] for x in found if x["site_id"] == dist[r["site_id"]]["near_end"])
                assert all(x["note"] == "insert" for x in found[at + 1 : r["place"]])
    for r in rows(spark, "INS-02-paths"):
        assert r["length"] == pytest.approx(r["existing_length"] + r["new_length"], abs=0.011)
        notes = {x["site_id"]: x["note"] for x in order[r["ring_name"]]}
        assert (r["route_type"] == "New Route") == ("insert" in (notes[r["near_end"]], notes[r["far_end"]]))


def test_bill_by_ring(spark):
    layers = rows(spark, "BOQ-03")
    summary = {r["ring_name"]: r for r in rows(spark, "BOQ-05")}
    for ring, r in summary.items():
        mine = [x for x in layers if x["ring_name"] == ring]
        for layer in ("odp", "otb", "closure", "obstacle_railway", "obstacle_toll"):
            assert r[layer] == sum(x["layer"] == layer for x in mine)
        for layer in ("backbone", "access_ne", "access_fe", "fo_exist", "pole_exist"):
            assert r[layer] == pytest.approx(sum(x["length"] for x in mine if x["layer"] == layer), abs=0.1)
    members = {r["ring_name"]: r["n"] for r in view(spark, SF, "site_rings").groupBy("ring_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(summary[k]["otb"] == n for k, n in members.items())
    devices = rows(spark, "BOQ-01")
    assert len(devices) == sum(members.values()) and all(r["otb"] and r["odp"] for r in devices)


def test_lines(spark):
    whole = {r["ring_name"]: r["route_length"] for r in rows(spark, "BOQ-04")}
    for name in ("GEO-14", "GEO-21"):
        for r in rows(spark, name):
            assert r["existing"] + r["new"] == pytest.approx(whole[r["line_id"]], abs=0.2) and r["existing"] >= 0
    merged = {}
    for r in rows(spark, "AGG-11"):
        merged[r["zone"]] = merged.get(r["zone"], 0) + r["length"]
    size = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    want = {r["zone"]: r["n"] for r in view(spark, SF, "fiber_lines").groupBy(F.floor(F.col("ax") / 10000).alias("zone")).agg(F.sum(size).alias("n")).collect()}
    assert merged == pytest.approx(want)
