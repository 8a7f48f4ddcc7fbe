"""Steps whose tasks must not hold a group whole, and work that must not be done row by row."""

from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators import boq, rings


def test_edges_through_a_node_take_the_closed_form(spark, monkeypatch):
    places = [("N1", 0.0, 0.0), ("N2", 100.0, 0.0), ("N3", -100.0, 0.0), ("N4", 60.0, 80.0), ("N5", -60.0, -80.0), ("N6", 0.0, 50.0)]
    nodes = spark.createDataFrame(places, "node_id string, x double, y double")
    edges = spark.createDataFrame([("N2", "N3"), ("N4", "N5"), ("N6", "N1")], "node_a string, node_b string")
    seen, real = [], boq.durable
    monkeypatch.setattr(boq, "durable", lambda df: seen.append(real(df)) or seen[-1])
    found = {r["node_id"]: (r["parts"], r["low"], r["high"]) for r in boq.disc_parts(nodes, edges).collect()}
    walked = [df.count() for df in seen if df.columns == ["node_id"]]
    assert walked == [0]
    at = {k: (x, y) for k, x, y in places}
    drawn = [(*at[a], *at[b]) for a, b in (("N2", "N3"), ("N4", "N5"), ("N6", "N1"))]
    areas = boq.kernel.disc_parts(drawn, boq.DISC, boq.CABLE)
    assert found["N1"][0] == len(areas) == 5
    assert abs(found["N1"][1] - min(areas)) < 1e-6 and abs(found["N1"][2] - max(areas)) < 1e-6


def test_lines_of_one_course_meet_the_fiber_once(spark, monkeypatch):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (0.0, 2000.0)]).cast(geo.LINE)
    lines = spark.range(7).select(F.concat(F.lit("L"), "id").alias("line_id"), line.alias("line"))
    fiber = spark.range(1).select(F.lit("F").alias("fiber"), line.alias("ref"))
    met, real = [], boq.fiber_pairs
    monkeypatch.setattr(boq, "fiber_pairs", lambda lines, *rest: met.append(lines.count()) or real(lines, *rest))
    rows = boq.stretches(lines, fiber).collect()
    assert met == [1]
    assert sorted((r["line_id"], r["fiber"], r["length"], r["class"]) for r in rows) == [(f"L{i}", "F", 2000.0, "fo_exist") for i in range(7)]


def test_only_roads_between_passed_nodes_meet_the_hops(spark, monkeypatch):
    paths = spark.createDataFrame([("R", 0, 1), ("R", 0, 2), ("R", 0, 3), ("R", 1, 2), ("R", 1, 3), ("S", 0, 1), ("S", 1, 2)], "ring_name string, seq int, node long")
    edges = spark.range(1000).select(F.col("id").alias("node_start"), (F.col("id") + 1).alias("node_end"), (F.col("id") * 1000.0).alias("length"))
    sent, real = [], rings.few
    monkeypatch.setattr(rings, "few", lambda df: sent.append(df.count()) or real(df), raising=False)
    assert [tuple(r) for r in rings.shared_road(paths, edges, 1500.0).collect()] == [("R", 0, 1, 2000.0)]
    assert sent == [3, 3, 2]
