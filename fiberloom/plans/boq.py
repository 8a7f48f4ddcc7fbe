"""Queries of the bill of quantity and of line geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators import boq, linemerge, spatial
from fiberloom.plans.fixtures import view, with_views
from fiberloom.plans.rings import _lines, _SEG
from fiberloom.runtime import durable


def _routes(s, d):
    """Drawn route of each ring through all its sites."""
    return _lines(s, d).select("ring_name", "line")


def _fiber(s, d):
    return view(s, d, "fiber_lines").select("name", "ax", "ay", "bx", "by")


def geo_03(s, d):
    return boq.exploded(_lines(s, d), "ring_name").select("ring_name", "part", "ax", "ay", "bx", "by")


def geo_17(s, d):
    nodes, edges = boq.graph_tables(_routes(s, d), "ring_name")
    return edges.select("ring_name", "node_a", "node_b", F.round("length", 6).alias("length"))


def geo_18(s, d):
    nodes, edges = boq.graph_tables(_routes(s, d), "ring_name")
    nodes, edges = durable(nodes), durable(edges)
    return boq.turns(nodes, edges).join(nodes.select("node_id", "x", "y"), "node_id")


def geo_18_own(s, d):
    """What a node's own edges leave of the disc around it: parts, least and largest area."""
    nodes, edges = boq.graph_tables(_routes(s, d), "ring_name")
    nodes, edges = durable(nodes), durable(edges)
    areas = boq.own_parts(nodes, edges).select("node_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
    return boq.turns(nodes, edges, own=True).join(areas, "node_id")


def boq_01(s, d):
    nodes, edges = boq.graph_tables(_routes(s, d), "ring_name")
    nodes, edges = durable(nodes), durable(edges)
    return boq.devices(view(s, d, "sites"), nodes, boq.turns(nodes, edges)).select("site_id", "otb", F.round("otb_distance", 6).alias("otb_distance"), "odp")


def geo_19(s, d):
    mid = F.get(F.col("line"), F.lit(1))
    rows = _routes(s, d).select(F.col("ring_name").alias("line_id"), "line", mid["x"].alias("px"), mid["y"].alias("py")).where("px is not null")
    return boq.access_backbone(rows).select("line_id", F.round("access_length", 4).alias("access_length"), F.round("backbone_length", 4).alias("backbone_length"))


def geo_21(s, d):
    rows = _routes(s, d).select(F.col("ring_name").alias("line_id"), "line", F.slice("line", 1, 3).alias("other")).where("size(line) > 3")
    out = boq.fiber_overlap(rows, 20.0)
    return out.select("line_id", F.round("existing", 1).alias("existing"), F.round("new", 1).alias("new"), boq.overlap_class(F.col("existing")).alias("class"))


def geo_14(s, d):
    rows = _routes(s, d).select(F.col("ring_name").alias("line_id"), "line", F.slice("line", 2, 2).alias("other")).where("size(line) > 3")
    return boq.previous_route(rows, 50.0).select("line_id", F.round("existing", 1).alias("existing"), F.round("new", 1).alias("new"))


def geo_20(s, d):
    segs = boq.exploded(_routes(s, d), "ring_name").select(F.col("ring_name").alias("line_id"), "ax", "ay", "bx", "by")
    rail = s.createDataFrame([("rail", 0.0, 20000.5, 50000.0, 20000.5), ("toll", 30000.5, 0.0, 30000.5, 50000.0)], "name string, ax double, ay double, bx double, by double")
    return boq.obstacles(segs, rail, 0.01).select("line_id", "name", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def geo_12(s, d):
    e = _fiber(s, d).withColumn("ord", F.xxhash64("name"))
    return e.join(boq.centerline(e, 1.0), "ord").select("name")


def agg_11(s, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    e = _fiber(s, d).select(F.floor(F.col("ax") / 10000).alias("zone"), F.xxhash64("name").alias("ord"), F.array(p("ax", "ay"), p("bx", "by")).alias("line"))
    return linemerge.merged(e, "zone").select("zone", "part", F.round("length", 4).alias("length"))


def geo_22(s, d):
    """Roads as existing where both their nodes are within reach of fiber."""
    near = spatial.near_line(view(s, d, "road_nodes"), _fiber(s, d), 30.0).select(F.col("node_id").alias("n")).distinct()
    e = view(s, d, "road_edges")
    e = e.join(near.select(F.col("n").alias("node_start"), F.lit(1).alias("a")), "node_start", "left").join(near.select(F.col("n").alias("node_end"), F.lit(1).alias("b")), "node_end", "left")
    return e.groupBy(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "Existing").otherwise("New").alias("fo_note")).agg(F.sum("length").alias("length"))


def geo_25(s, d):
    rows = _lines(s, d).select("ring_name", F.col("line").alias("r")).where("size(r) >= 3")
    cx, cy = geo.centroid(F.col("r"))
    area = geo.signed_area(F.col("r"))
    return rows.select("ring_name", F.round(F.abs(area), 4).alias("area"), F.round(F.when(area != 0, cx), 4).alias("cx"), F.round(F.when(area != 0, cy), 4).alias("cy"))


def boq_02(s, d):
    entry = F.map_from_entries(F.collect_list(F.struct("site_id", "site_type")))
    rows = view(s, d, "site_rings").groupBy("ring_name").agg(entry.alias("m"))
    return boq.flattened(rows, ["ring_name"], "m")


def boq_04(s, d):
    lines = _lines(s, d).select("ring_name", geo.length(F.col("line")).alias("length"))
    out = boq.summary(view(s, d, "site_rings"), lines, view(s, d, "site_rings").where("seq % 4 = 0"))
    return out.select("ring_name", "sites", F.round("route_length", 4).alias("route_length"), "obstacles")


QUERIES = {
    "GEO-03": geo_03, "GEO-12": geo_12, "GEO-14": geo_14, "GEO-17": geo_17, "GEO-18": geo_18, "GEO-18-own": geo_18_own, "GEO-19": geo_19, "GEO-20": geo_20, "GEO-21": geo_21, "GEO-22": geo_22, "GEO-25": geo_25,
    "AGG-11": agg_11, "BOQ-01": boq_01, "BOQ-02": boq_02, "BOQ-04": boq_04,
}

_R = with_views("site_rings")
_P = "v AS (SELECT ring_name, x, y, row_number() OVER (PARTITION BY ring_name ORDER BY seq) AS k FROM site_rings), r AS (SELECT * FROM v)"
_E = "s AS (SELECT ring_name, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS zy, k FROM r WINDOW w AS (PARTITION BY ring_name ORDER BY k)), e AS (SELECT * FROM s WHERE bx IS NOT NULL)"
_N = "p AS (SELECT DISTINCT x, y FROM r), n AS (SELECT x, y, concat('N', lpad(CAST(row_number() OVER (ORDER BY x, y) AS VARCHAR), 7, '0')) AS node_id FROM p)"

ORACLE = {
    "GEO-12": f"{with_views('fiber_lines')} SELECT name FROM fiber_lines",
    "GEO-03": f"""{_R}, s AS (SELECT ring_name, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS zy, row_number() OVER w - 1 AS part FROM site_rings WINDOW w AS (PARTITION BY ring_name ORDER BY seq)) SELECT ring_name, CAST(part AS INT) AS part, ax, ay, bx, zy AS "by" FROM s WHERE bx IS NOT NULL""",
    "GEO-17": f"{_R}, {_P}, {_E}, {_N} SELECT ring_name, a.node_id AS node_a, b.node_id AS node_b, round(sqrt((ax-bx)*(ax-bx)+(ay-zy)*(ay-zy)), 6) AS length FROM e JOIN n a ON a.x = ax AND a.y = ay JOIN n b ON b.x = bx AND b.y = zy",
    "GEO-18-own": f"""{_R}, {_P}, {_E}, {_N}, z AS (SELECT DISTINCT a.node_id AS i, a.x AS x0, a.y AS y0, b.node_id AS j, b.x AS x1, b.y AS y1 FROM e JOIN n a ON a.x = ax AND a.y = ay JOIN n b ON b.x = bx AND b.y = zy),
      u AS (SELECT DISTINCT node_id, round((degrees(atan2(dx, dy)) + 360.0) % 360.0, 6) AS a FROM (SELECT i AS node_id, x1-x0 AS dx, y1-y0 AS dy FROM z UNION ALL SELECT j, x0-x1, y0-y1 FROM z)),
      g AS (SELECT node_id, radians(coalesce(lead(a) OVER w - a, first_value(a) OVER w + 360.0 - a)) AS t FROM u WINDOW w AS (PARTITION BY node_id ORDER BY a)),
      m AS (SELECT node_id, CASE WHEN t / 2 <= asin(0.25) THEN 0 WHEN t <= pi() THEN 4 * (t / 2 - asin(0.25)) + 0.25 * (cos(t / 2) / sin(t / 2) - sqrt(15)) ELSE 2 * t - (0.5 * sqrt(3.75) + 4 * asin(0.25)) - (t - pi()) * 0.125 END AS area FROM g),
      h AS (SELECT node_id, count(*) AS parts, min(area) AS low, max(area) AS high FROM m WHERE area > 1e-9 GROUP BY 1)
      SELECT node_id, parts, round(CASE WHEN parts >= 2 THEN low / high END, 6) AS ratio, CASE WHEN parts < 2 THEN 'end' WHEN parts >= 3 THEN 'branch' WHEN low / high < 0.8 THEN 'turn' ELSE 'straight' END AS kind, round(low, 6) AS low, round(high, 6) AS high FROM h""",
    "GEO-19": f"{_R}, {_P}, {_E}, l AS (SELECT ring_name, sum(sqrt((ax-bx)*(ax-bx)+(ay-zy)*(ay-zy))) AS n, sum(CASE WHEN k = 1 THEN sqrt((ax-bx)*(ax-bx)+(ay-zy)*(ay-zy)) END) AS m FROM e GROUP BY 1) SELECT ring_name AS line_id, round(least(m, n - m), 4) AS access_length, round(n - least(m, n - m), 4) AS backbone_length FROM l",
    "GEO-20": f"""{_R}, {_P}, {_E} SELECT DISTINCT ring_name AS line_id, 'rail' AS name, round(ax + (20000.5-ay)/(zy-ay)*(bx-ax), 4) AS x, 20000.5::DOUBLE AS y FROM e WHERE zy <> ay AND (20000.5-ay)/(zy-ay) BETWEEN 0 AND 1
      UNION ALL SELECT DISTINCT ring_name, 'toll', 30000.5::DOUBLE, round(ay + (30000.5-ax)/(bx-ax)*(zy-ay), 4) FROM e WHERE bx <> ax AND (30000.5-ax)/(bx-ax) BETWEEN 0 AND 1""",
    "GEO-22": f"""{with_views("road_edges", "road_nodes", "fiber_lines")}, f AS (SELECT ax, ay FROM fiber_lines UNION SELECT bx, "by" FROM fiber_lines), q AS (SELECT node_id FROM road_nodes JOIN f ON x = ax AND y = ay)
      SELECT CASE WHEN node_start IN (SELECT node_id FROM q) AND node_end IN (SELECT node_id FROM q) THEN 'Existing' ELSE 'New' END AS fo_note, sum(length) AS length FROM road_edges GROUP BY 1""",
    "GEO-25": f"""{_R}, {_P}, t AS (SELECT ring_name, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS z FROM r WINDOW w AS (PARTITION BY ring_name ORDER BY k)),
      a AS (SELECT ring_name, sum(x*z-u*y)/2 AS area, sum((x+u)*(x*z-u*y)) AS sx, sum((y+z)*(x*z-u*y)) AS sy FROM t GROUP BY 1 HAVING count(*) >= 3) SELECT ring_name, round(abs(area), 4) AS area, round(CASE WHEN area <> 0 THEN sx/(6*area) END, 4) AS cx, round(CASE WHEN area <> 0 THEN sy/(6*area) END, 4) AS cy FROM a""",
    "BOQ-02": f"{_R} SELECT ring_name, site_id AS fiber, site_type AS value FROM site_rings",
    "BOQ-04": f"{_R}, s AS ({_SEG.format('site_rings')}), l AS (SELECT ring_name, round(sum(length), 4) AS route_length FROM s WHERE site_id_b IS NOT NULL GROUP BY 1) SELECT ring_name, count(*) AS sites, coalesce(any_value(route_length), 0) AS route_length, CAST(sum((seq % 4 = 0)::INT) AS BIGINT) AS obstacles FROM site_rings LEFT JOIN l USING (ring_name) GROUP BY 1",
}
