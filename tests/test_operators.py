"""Decisions about odd inputs, pinned one by one."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiberloom.operators import boq, components, fwa, rings, spatial, tables
from fiberloom.sources import files, kml, xlsx


def test_nearest_keeps_ties_or_the_lower_id(spark):
    a = spark.createDataFrame([("s", 0.0, 0.0), ("far", 90_000.0, 0.0)], "id string, x double, y double")
    b = spark.createDataFrame([("q", 3.0, 4.0), ("p", 5.0, 0.0), ("z", 0.0, 0.0)], "k string, bx double, by double")
    assert [r["k"] for r in spatial.nearest(a.where("id = 's'"), b, "id", "k", exclusive=True).collect()] == ["p"]
    assert sorted(r["k"] for r in spatial.nearest(a.where("id = 's'"), b, "id", "k", ties=True, exclusive=True).collect()) == ["p", "q"]
    assert {r["id"]: r["k"] for r in spatial.nearest(a, b, "id", "k").collect()} == {"s": "z", "far": "p"}
    assert spatial.nearest(a, b.limit(0), "id", "k").count() == 0


def test_points_in_a_ring_with_a_hole(spark):
    ring = lambda a, b: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))])
    area = spark.range(1).select(F.lit("g").alias("g"), ring(0, 100).alias("ring"), F.array(ring(40, 60)).alias("holes"))
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 50.0, 50.0), (3, 200.0, 0.0)], "p int, x double, y double")
    assert [r["p"] for r in spatial.in_polygon(pts, area, cell=30.0).collect()] == [1]
    assert sorted(r["p"] for r in spatial.in_polygon(pts, area, cell=30.0, how="left_anti").collect()) == [2, 3]


def test_overlap_elimination(spark):
    rows = [("a", "Rooftop", 0.0, 5, 1), ("b", "Green Field", 10.0, 1, 2), ("c", "Rooftop", 5000.0, 3, 3), ("d", "Rooftop", 5010.0, 3, 4)]
    sites = spark.createDataFrame([(i, t, x, 0.0, n, o) for i, t, x, n, o in rows], "site_id string, site_type string, x double, y double, total_homepass long, ord long")
    assert {r["site_id"] for r in fwa.clean_overlaps(sites).where("kept").collect()} == {"b", "d"}  # greenfield wins; of equals the first goes


def test_ring_topology_by_hub_count(spark):
    rows = [("one", i, f"o{i}", "FO Hub" if i == 0 else "Site") for i in range(3)] + [("two", i, f"t{i}", "FO Hub" if i != 1 else "Site") for i in range(3)] + [("none", i, f"n{i}", "Site") for i in range(2)]
    got = rings.topology(spark.createDataFrame(rows, "ring_name string, seq int, site_id string, site_type string")).collect()
    pairs = {(r["near_end"], r["far_end"]) for r in got}
    assert ("o2", "o0") in pairs and ("t2", "t0") not in pairs
    assert {r["ring_name"] for r in got if r["rejected"]} == {"none"}


def test_validation_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="lat"):
        tables.validate(spark.createDataFrame([("a",)], "site_id string"), "fwa" if False else "supervised")
    ok = tables.validate(spark.createDataFrame([(" a ", None, "1", "2"), ("b", "n", "x", "2")], "site_id string, site_name string, lat string, long string"), "unsupervised").collect()
    assert [(r["site_id"], r["site_name"]) for r in ok] == [("a", "")]


def test_modes_take_the_least_of_equals(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "b"), ("k", "a"), ("k", "a"), ("k", None)], "k string, v string")
    assert tables.mode_of(df, ["k"], "v").first()["v"] == "a"


def test_suffix_split(spark):
    near, far = tables.split_sides(spark.createDataFrame([("p", "q", "r")], "site_a_x_a string, site_a_x_b string, ring_name string"))
    assert near.columns == ["site_a_x", "ring_name", "point_type"] and far.first()["site_a_x"] == "q"


def test_components_with_isolated_vertices(spark):
    links = spark.createDataFrame([(3, 2), (2, 1), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected(links, spark.range(1, 9)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_turn_kinds(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    lines = spark.createDataFrame([("a", p((0, 0), (10, 0), (20, 0), (20, 10))), ("b", p((10, 0), (10, 10)))], "k string, line array<struct<x:double,y:double>>")
    nodes, edges = boq.graph_tables(lines, "k")
    at = {(r["x"], r["y"]): r["node_id"] for r in nodes.collect()}
    kinds = {r["node_id"]: r["kind"] for r in boq.turns(nodes, edges).collect()}
    assert kinds[at[10.0, 0.0]] == "branch" and kinds[at[20.0, 0.0]] == "turn" and kinds[at[0.0, 0.0]] == "end"


def test_kmz_and_xlsx_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("R;A & B", "n<1>", "line", [(1.5, 2.5), (3.0, 4.0)], {"k": "v"}), ("R", "p", "point", [(0.1, 0.2)], None)], "folders string, name string, kind string, line array<struct<x:double,y:double>>, data map<string,string>")
    kml.write_kmz(rows, str(tmp_path / "a.kmz"))
    back = {r["name"]: r for r in kml.read_kml(spark, str(tmp_path / "a.kmz")).collect()}
    assert back["n<1>"]["folders"] == "R;A & B" and back["n<1>"]["line"][1]["y"] == 4.0 and back["n<1>"]["data"] == {"k": "v"} and back["p"]["folders"] == "R"
    assert kml.kml_color("#A1B2C3") == "ffc3b2a1"
    book = tmp_path / "b.xlsx"
    book.write_bytes(xlsx.workbook({"sitelist": pd.DataFrame({"site_id": ["a", None], "Long.": [106.5, 1]}), "hubs": pd.DataFrame({"x": [1]})}))
    assert [tuple(r) for r in xlsx.read_sheet(spark, str(book), "sitelist").collect()] == [("a", "106.5"), (None, "1.0")]
    with pytest.raises(ValueError, match="absent"):
        xlsx.read_sheet(spark, str(book), "absent")


def test_column_matching():
    assert files.match_column(["Site", "Longitude", "Lat"], files.LON, 0.85) == "Longitude"
    with pytest.raises(ValueError, match="looks like"):
        files.match_column(["foo"], files.LON, 0.85)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))
