"""Queries of joins, tables, rings and road networks, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators import boq, fwa, linkage, network, rings, spatial, tables
from fiberloom.plans.fixtures import view, with_views
from fiberloom.runtime import durable, stored


def _hub_points(s, d):
    return view(s, d, "hubs").select(F.col("site_id").alias("hub_id"), F.col("x").alias("bx"), F.col("y").alias("by"))


def _ring(x0, y0, x1, y1):
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def _squares(s, d):
    p = view(s, d, "polygons")
    return p.select("polygon_id", F.col("name").alias("polygon_name"), _ring(F.col("minx"), F.col("miny"), F.col("minx") + 10000, F.col("miny") + 10000).alias("ring"))


def _lines(s, d):
    return view(s, d, "site_rings").groupBy("ring_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def _noted(s, d):
    """Ring points with a hub at each end and every seventh site as an insert."""
    p = view(s, d, "site_rings")
    kind = F.when(F.col("seq").isin(0, 9), "FO Hub").otherwise(F.col("site_type"))
    note = F.when(F.col("seq") % 7 == 3, "insert").otherwise("existing")
    return p.withColumn("site_type", kind).withColumn("note", note)


_NOTED = """, noted AS (SELECT site_id, site_name, CASE WHEN seq IN (0, 9) THEN 'FO Hub' ELSE site_type END AS site_type, region, x, y, ring_name, seq,
 CASE WHEN seq % 7 = 3 THEN 'insert' ELSE 'existing' END AS note FROM site_rings)"""


def _edges(s, d):
    return rings.edge_costs(view(s, d, "road_edges"), view(s, d, "road_nodes"))


def _ring_points(s, d):
    from fiberloom.plans import jobs  # which imports this module

    return durable(jobs.snapped(view(s, d, "site_rings"), view(s, d, "road_nodes")).select("ring_name", "site_id", F.col("node").cast("long").alias("node"), "x", "y"))


def _ring_distances(s, d, cutoff=float("inf")):
    """Every site of every ring with its road node, and the distances between a ring's sites."""
    from fiberloom.plans import jobs  # which imports this module

    pts = _ring_points(s, d)
    return pts.drop("x", "y"), jobs.road_distances(pts, _edges(s, d), view(s, d, "road_nodes"), "ring_name", cutoff)


def jn_01(s, d):
    return spatial.in_polygon(view(s, d, "sites"), _squares(s, d)).select("site_id", "polygon_id")


def jn_23(s, d):
    p = view(s, d, "polygons")  # areas with gaps between them
    inside = p.select("polygon_id", _ring(F.col("minx"), F.col("miny"), F.col("minx") + 6000, F.col("miny") + 6000).alias("ring"))
    return spatial.in_polygon(view(s, d, "sites"), inside, how="left").select("site_id", "polygon_id")


def jn_22(s, d):
    pairs = spatial.in_polygon(view(s, d, "site_rings"), _squares(s, d)).select("ring_name", "polygon_id")
    return tables.mode_of(pairs, ["ring_name"], "polygon_id")


def jn_03(s, d):
    f = view(s, d, "fiber_lines").select("name", "ax", "ay", "bx", "by")
    return spatial.near_line(view(s, d, "sites").select("site_id", "x", "y"), f, 100.0).select("site_id", "name", F.round("d2", 3).alias("d2"))


def geo_24(s, d):
    f = view(s, d, "fiber_lines").select("name", "ax", "ay", "bx", "by")
    return spatial.near_line(view(s, d, "road_nodes"), f, 30.0).select("node_id").distinct()


def jn_05(s, d):
    return spatial.nearest(view(s, d, "sites").select("site_id", "x", "y"), _hub_points(s, d), "site_id", "hub_id", ties=True, max_distance=10000.0).select("site_id", "hub_id", "d2")


def jn_06(s, d):
    n = view(s, d, "road_nodes").select("node_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    return spatial.nearest(view(s, d, "sites").select("site_id", "x", "y"), n, "site_id", "node_id").select("site_id", "node_id", "d2")


def jn_07(s, d):
    b = view(s, d, "sites").select(F.col("site_id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return spatial.nearest(view(s, d, "sites").select("site_id", "x", "y"), b, "site_id", "other", max_distance=2000.0, exclusive=True).select("site_id", "other", "d2")


def jn_08(s, d):
    return spatial.nearest(view(s, d, "sites").select("site_id", "x", "y"), _hub_points(s, d), "site_id", "hub_id", k=3).select("site_id", "hub_id", "nth")


def jn_20(s, d):
    words = view(s, d, "sites").select(F.lower("site_type").alias("word"))
    names = s.createDataFrame([(0, "new sites"), (1, "greenfield"), (2, "existing site"), (3, "roof")], "ord int, name string")
    return tables.best_match(words, names, 0.6).select("word", "match", F.round("score", 9).alias("score"))


def jn_17(s, d):
    near = jn_05(s, d).where("d2 <= 4000000").select("site_id")
    sites = view(s, d, "sites").select("site_id")
    return sites.join(near, "site_id", "left_semi").withColumn("kind", F.lit("near")).unionByName(sites.join(near, "site_id", "left_anti").withColumn("kind", F.lit("far")))


def agg_05(s, d):
    segs = rings.segments(view(s, d, "site_rings")).withColumn("fo_note", F.when(F.col("sequence") % 2 == 0, "New").otherwise("Existing"))
    out = tables.pivot_sum(segs, ["ring_name"], "fo_note", ["Existing", "New"], "length")
    return out.select("ring_name", F.round("Existing", 4).alias("existing"), F.round("New", 4).alias("new"))


def agg_06(s, d):
    """Four pivots by ring: sites and devices by type, route length by note, obstacles by kind."""
    p = _noted(s, d)
    segs = rings.segments(p).select("ring_name", F.when(F.col("sequence") % 3 == 0, "Backbone").otherwise("Access").alias("type"), "length", "sequence")
    crossed = boq.exploded(_lines(s, d), "ring_name").select(F.col("ring_name").alias("line_id"), "ax", "ay", "bx", "by")
    barriers = s.createDataFrame([("Obstacle Railway", 0.0, 20000.5, 50000.0, 20000.5), ("Obstacle Toll", 30000.5, 0.0, 30000.5, 50000.0)], "name string, ax double, ay double, bx double, by double")
    hit = boq.obstacles(crossed, barriers, 0.01).select(F.col("line_id").alias("ring_name"), F.col("name").alias("type"))
    sites = p.select("ring_name", F.when(rings.is_hub(F.col("site_type")), "FO Hub").otherwise("Site List").alias("type"))
    devices = p.select("ring_name", F.when(F.col("note") == "insert", "ODP").otherwise("OTB").alias("type"))
    out = boq.pivots(sites, devices, segs, hit, {"sites": ["FO Hub", "Site List"], "devices": ["ODP", "OTB"], "routes": ["Access", "Backbone"], "obstacles": ["Obstacle Railway", "Obstacle Toll"]})
    return out.withColumns({c: F.round(c, 4) for c in ("Access", "Backbone")})


def agg_08(s, d):
    return tables.mode_of(view(s, d, "site_rings"), ["ring_name"], "site_type")


def agg_09(s, d):
    return view(s, d, "sites").groupBy("site_type").count().orderBy(F.desc("count"), "site_type")


def agg_10(s, d):
    from pyspark.sql.window import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("ring_name", "region"))
    return view(s, d, "site_rings").withColumn("n", n).where("n > 3").select("site_id", "ring_name", "region", "n")


def agg_14(s, d):
    return rings.coordinate_counts(_lines(s, d), "ring_name").select("ring_name", "x", "y", "n")


def agg_15(s, d):
    return rings.duplicate_score(_lines(s, d), "ring_name")


def agg_17(s, d):
    return view(s, d, "site_rings").groupBy("ring_name").agg(F.min_by("region", "seq").alias("region"))


def agg_20(s, d):
    return rings.ring_centroids(view(s, d, "site_rings")).select("ring_name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def win_01(s, d):
    return rings.topology(_noted(s, d)).select("ring_name", "near_end", "far_end", "hubs", "rejected")


def win_02(s, d):
    return rings.segments(view(s, d, "site_rings")).select("ring_name", "site_id_a", "site_id_b", F.col("sequence").cast("long").alias("sequence"), F.round("length", 6).alias("length"))


def win_03(s, d):
    return rings.vertex_flags(_lines(s, d), "ring_name").select("ring_name", "vertex", "x", "y", "flag", "site_type")


def win_05(s, d):
    return rings.ring_hubs(view(s, d, "site_rings"), view(s, d, "hubs")).select("ring_name", "hub_id", "d2", "flag")


def win_07(s, d):
    return rings.numbered(view(s, d, "site_rings").select("site_id", "region", F.col("ring_name").alias("label")), "label").select("site_id", F.col("cluster_no").cast("int").alias("cluster_no"), "ring_name")


def win_11(s, d):
    order = view(s, d, "site_rings").where("seq % 3 = 0").select("site_id", F.col("seq").alias("place"))
    return rings.sorted_by(view(s, d, "site_rings"), order, "site_id").select("site_id", F.col("sort_no").cast("int").alias("sort_no"))


def cl_07(s, d):
    return rings.with_new_site(view(s, d, "site_rings")).select("site_id", "ring_name")


def prj_21(s, d):
    return rings.gained(_noted(s, d).where("seq <> 3 or region = 'ASIA'")).select("site_id", "ring_name")


def ins_03(s, d):
    segs = rings.topology(_noted(s, d)).select("ring_name", "near_end", "far_end")
    return rings.segment_report(segs, _noted(s, d)).select("ring_name", "near_end", "far_end", "near_type", "far_type", "priority", "remark", "first_hub", "last_hub")


def prj_11(s, d):
    p = tables.split_folders(F.col("folders"))
    return view(s, d, "folders").select("site_id", p["region"].alias("region"), p["ring"].alias("ring"), p["site_type"].alias("site_type"), p["ring_last"].alias("ring_last"), tables.region_code(F.col("folders")).alias("code"))


def str_08(s, d):
    name = F.concat(F.lit("design_v"), (F.col("seq") % 4).cast("string"))
    name = F.when(F.col("seq") == 0, "design").otherwise(name)
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("seq") * 41), "yyyyMMdd")
    return view(s, d, "site_rings").select("site_id", tables.next_version(name).alias("version"), tables.iso_week(day).alias("week"))


def prj_15(s, d):
    return _edges(s, d).select("node_start", "node_end", "length", "fiber", "weight")


def gr_12(s, d):
    """Shared road of the hops of a ring: each hop runs along ten nodes of a row of the road grid."""
    hop = view(s, d, "site_rings").select("ring_name", F.col("seq"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    start = F.substring("ring_name", 2, 6).cast("long")
    paths = hop.select("ring_name", "seq", (start * 3 % 30 + F.col("seq") * 2 + F.col("i")).cast("long").alias("node"))
    return rings.shared_road(paths, _edges(s, d), 3000.0).select("ring_name", "seq_a", "seq_b", "shared")


def gr_01(s, d):
    return _ring_distances(s, d, 9e8)[1].select("ring_name", "site_i", "site_j", "dist")


def _ordered(s, d):
    """Rings with those they are like, all sites of rings on their nodes, and the order of the sites."""
    from fiberloom.plans import jobs  # which imports this module

    pts = _ring_points(s, d)
    first = pts.groupBy("ring_name").agg(F.min("site_id").alias("h"))
    p = pts.join(first, "ring_name").withColumn("ord", F.substring("site_id", 2, 7).cast("long")).withColumn("hub", F.col("site_id") == F.col("h")).drop("h")
    return *jobs.ring_orders(p, _edges(s, d), view(s, d, "road_nodes")), pts


def tsp_05(s, d):
    return _ordered(s, d)[1]


def _routed(s, d, feedback=None):
    """Rings with those they are like; routes of one of these; and the roads that they share, with their nets."""
    from pyspark.sql.window import Window

    from fiberloom.plans import jobs  # which imports this module

    like, order, pts = _ordered(s, d)
    pts, order = jobs.first_of(pts, like), jobs.first_of(order.where("not rejected"), like)
    order = order.join(pts.select("site_id", "node"), "site_id")
    nxt = F.lead("node").over(Window.partitionBy("ring_name").orderBy("place"))
    hops = order.withColumn("to", nxt).where("to is not null").select("ring_name", F.col("place").cast("long").alias("seq"), F.col("node").alias("start"), F.col("to").alias("end"))
    net, roads = jobs.shared_nets(pts, _edges(s, d), view(s, d, "road_nodes"))
    return like, network.routes(hops, roads, "ring_name", feedback, net), roads, net


def gr_02(s, d):
    from fiberloom.plans import jobs  # which imports this module

    like, found, _, _ = _routed(s, d)
    return jobs.for_alike(stored(found), like)


def gr_12_routes(s, d):
    """Shared road of the hops of each ring, over the routes that they take."""
    from fiberloom.plans import jobs  # which imports this module

    like, found, _, _ = _routed(s, d)
    paths = stored(found).select("ring_name", "seq", F.explode("nodes").alias("node"))
    return jobs.for_alike(rings.shared_road(paths, _edges(s, d), 3000.0).select("ring_name", "seq_a", "seq_b", "shared"), like)


def gr_13(s, d):
    from fiberloom.plans import jobs  # which imports this module

    like, found, _, _ = _routed(s, d, 4.0)
    return jobs.for_alike(stored(found), like)


def gr_12_reroute(s, d):
    from fiberloom.plans import jobs  # which imports this module

    like, found, roads, net = _routed(s, d, 4.0)
    return jobs.for_alike(stored(network.reroute(found.where("cost is not null"), roads, of=net)), like)


def cl_02(s, d):
    pts, dist = _ring_distances(s, d)
    return linkage.cluster(pts, dist, "ring_name", 3e8, 4, 1)


def agg_18(s, d):
    pts, dist = _ring_distances(s, d)
    dist = durable(dist)
    return network.silhouette(network.cluster(pts, dist, "ring_name", 3e8, 4, 1), dist)


def pol_01(s, d):
    """Sites and hubs of each polygon, numbered ring names by area code, first two hubs as start and end."""
    from pyspark.sql.window import Window

    p = spatial.in_polygon(view(s, d, "sites").unionByName(view(s, d, "hubs")), _squares(s, d))
    n = F.row_number().over(Window.partitionBy("polygon_id", rings.is_hub(F.col("site_type"))).orderBy("site_id"))
    hub = rings.is_hub(F.col("site_type"))
    flag = F.when(hub & (n == 1), "Start").when(hub & (n == 2), "End").when(~hub, "")
    code = F.regexp_extract("polygon_name", r"\b(\d{2})([A-Z]{3})(\d+)\b", 2)
    no = F.dense_rank().over(Window.partitionBy("code").orderBy("polygon_id"))
    out = p.withColumn("flag", flag).where("flag is not null").withColumn("code", code)
    return out.withColumn("ring", rings.ring_code("code", no)).select("site_id", "polygon_id", "flag", "ring")


QUERIES = {
    "JN-01": jn_01, "JN-03": jn_03, "JN-05": jn_05, "JN-06": jn_06, "JN-07": jn_07, "JN-08": jn_08, "JN-17": jn_17, "JN-20": jn_20, "JN-22": jn_22, "JN-23": jn_23,
    "GEO-24": geo_24, "AGG-05": agg_05, "AGG-06": agg_06, "AGG-08": agg_08, "AGG-09": agg_09, "AGG-10": agg_10, "AGG-14": agg_14, "AGG-15": agg_15, "AGG-17": agg_17, "AGG-20": agg_20,
    "WIN-01": win_01, "WIN-02": win_02, "WIN-03": win_03, "WIN-05": win_05, "WIN-07": win_07, "WIN-11": win_11, "CL-07": cl_07, "PRJ-21": prj_21, "INS-03": ins_03, "PRJ-11": prj_11,
    "STR-08": str_08, "PRJ-15": prj_15, "GR-12": gr_12, "GR-01": gr_01, "TSP-05": tsp_05, "GR-02": gr_02, "GR-13": gr_13, "GR-12-reroute": gr_12_reroute, "GR-12-routes": gr_12_routes, "CL-02": cl_02, "AGG-18": agg_18, "POL-01": pol_01,
}

_S, _R = with_views("sites"), with_views("site_rings")
_IN = "x >= minx AND x < minx + 10000 AND y >= miny AND y < miny + 10000"
_SEG = """SELECT ring_name, site_id AS site_id_a, lead(site_id) OVER w AS site_id_b, row_number() OVER w - 1 AS sequence, sqrt((x-lead(x) OVER w)*(x-lead(x) OVER w)+(y-lead(y) OVER w)*(y-lead(y) OVER w)) AS length FROM {} WINDOW w AS (PARTITION BY ring_name ORDER BY seq)"""
_D2 = "(p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)"


_NEAR = """n AS (SELECT p.*, f.name, f.ax, f.ay, f.bx AS zx, f."by" AS zy, greatest(0.0, least(1.0, ((p.x-f.ax)*(f.bx-f.ax)+(p.y-f.ay)*(f."by"-f.ay))/((f.bx-f.ax)*(f.bx-f.ax)+(f."by"-f.ay)*(f."by"-f.ay)))) AS t
 FROM {} p JOIN fiber_lines f ON p.x BETWEEN least(f.ax, f.bx) - {} AND greatest(f.ax, f.bx) + {} AND p.y BETWEEN least(f.ay, f."by") - {} AND greatest(f.ay, f."by") + {}),
m AS (SELECT *, (x-(ax+t*(zx-ax)))*(x-(ax+t*(zx-ax)))+(y-(ay+t*(zy-ay)))*(y-(ay+t*(zy-ay))) AS d2 FROM n)"""
_KNN = "k AS (SELECT p.site_id, q.site_id AS hub_id, {d2} AS d2, row_number() OVER (PARTITION BY p.site_id ORDER BY {d2}, q.site_id) AS nth, rank() OVER (PARTITION BY p.site_id ORDER BY {d2}) AS r FROM sites p, hubs q)".format(d2=_D2)
_SH = with_views("sites", "hubs")
_TOPO = """t AS (SELECT ring_name, seq, site_id AS near_end, lead(site_id) OVER w AS nx, first_value(site_id) OVER w AS fx, sum(CASE WHEN lower(site_type) LIKE '%hub%' THEN 1 ELSE 0 END) OVER (PARTITION BY ring_name) AS hubs
 FROM noted WINDOW w AS (PARTITION BY ring_name ORDER BY seq)), topo AS (SELECT ring_name, near_end, coalesce(nx, CASE WHEN hubs = 1 THEN fx END) AS far_end, CAST(hubs AS BIGINT) AS hubs FROM t)"""
_COST = f"""{with_views("road_edges", "road_nodes")}, c AS (SELECT least(node_start, node_end) AS node_start, greatest(node_start, node_end) AS node_end, max(struct_pack(length := length, highway := highway)) AS r FROM road_edges GROUP BY 1, 2),
costs AS (SELECT c.node_start, c.node_end, r.length AS length, a.ref_fo = 1 AND b.ref_fo = 1 AS fiber, CAST(CASE WHEN a.ref_fo = 1 AND b.ref_fo = 1 THEN 10000 ELSE 35000 END * r.length
 * CASE r.highway WHEN 'residential' THEN 2 WHEN 'track' THEN 99 ELSE 1 END AS DOUBLE) AS weight FROM c JOIN road_nodes a ON a.node_id = c.node_start JOIN road_nodes b ON b.node_id = c.node_end)"""

ORACLE = {
    "JN-01": f"{with_views('sites', 'polygons')} SELECT site_id, polygon_id FROM sites JOIN polygons ON {_IN}",
    "JN-23": f"{with_views('sites', 'polygons')} SELECT site_id, polygon_id FROM sites LEFT JOIN polygons ON x >= minx AND x < minx + 6000 AND y >= miny AND y < miny + 6000",
    "JN-22": f"{with_views('site_rings', 'polygons')}, c AS (SELECT ring_name, polygon_id, count(*) AS n FROM site_rings JOIN polygons ON {_IN} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ring_name ORDER BY n DESC, polygon_id) AS k FROM c) SELECT ring_name, polygon_id FROM r WHERE k = 1",
    "JN-03": f"{with_views('sites', 'fiber_lines')}, {_NEAR.format('sites', *[100] * 4)} SELECT site_id, name, round(d2, 3) AS d2 FROM m WHERE d2 <= 10000",
    "GEO-24": f"{with_views('road_nodes', 'fiber_lines')}, {_NEAR.format('road_nodes', *[30] * 4)} SELECT DISTINCT node_id FROM m WHERE d2 <= 900",
    "JN-05": f"{_SH}, {_KNN} SELECT site_id, hub_id, d2 FROM k WHERE r = 1 AND d2 <= 100000000",
    "JN-08": f"{_SH}, {_KNN} SELECT site_id, hub_id, CAST(nth AS INT) AS nth FROM k WHERE nth <= 3",
    "JN-06": f"{with_views('sites', 'road_nodes')}, k AS (SELECT site_id, node_id, {_D2} AS d2, row_number() OVER (PARTITION BY site_id ORDER BY {_D2}, node_id) AS n FROM sites p, road_nodes q) SELECT site_id, node_id, d2 FROM k WHERE n = 1",
    "JN-07": f"{_S}, k AS (SELECT p.site_id, q.site_id AS other, {_D2} AS d2, row_number() OVER (PARTITION BY p.site_id ORDER BY {_D2}, q.site_id) AS n FROM sites p JOIN sites q ON {_D2} > 0 AND {_D2} <= 4000000) SELECT site_id, other, d2 FROM k WHERE n = 1",
    "JN-17": f"{_SH}, {_KNN} SELECT site_id, CASE WHEN d2 <= 4000000 THEN 'near' ELSE 'far' END AS kind FROM k WHERE nth = 1",
    "JN-20": f"""{_S}, w AS (SELECT DISTINCT lower(site_type) AS word FROM sites), c AS (SELECT * FROM (VALUES (0, 'new sites'), (1, 'greenfield'), (2, 'existing site'), (3, 'roof')) AS v(ord, name)),
      k AS (SELECT word, name, jaro_winkler_similarity(word, name) AS s, row_number() OVER (PARTITION BY word ORDER BY jaro_winkler_similarity(word, name) DESC, ord) AS n FROM w, c)
      SELECT word, CASE WHEN s >= 0.6 THEN name ELSE word END AS match, round(CASE WHEN s >= 0.6 THEN s ELSE 0 END, 9) AS score FROM k WHERE n = 1""",
    "AGG-05": f"{_R}, s AS ({_SEG.format('site_rings')}), z AS (SELECT * FROM s WHERE site_id_b IS NOT NULL) SELECT ring_name, round(coalesce(sum(CASE WHEN sequence % 2 = 1 THEN length END), 0), 4) AS existing, round(coalesce(sum(CASE WHEN sequence % 2 = 0 THEN length END), 0), 4) AS new FROM z GROUP BY 1",
    "AGG-06": f"""{_R}{_NOTED}, s AS ({_SEG.format('noted')}), l AS (SELECT ring_name, sum(CASE WHEN sequence % 3 <> 0 THEN length END) AS access, sum(CASE WHEN sequence % 3 = 0 THEN length END) AS backbone FROM s WHERE site_id_b IS NOT NULL GROUP BY 1),
      g AS (SELECT ring_name, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS zy FROM site_rings WINDOW w AS (PARTITION BY ring_name ORDER BY seq)),
      o AS (SELECT DISTINCT ring_name, 'rail' AS kind, ax + (20000.5-ay)/(zy-ay)*(bx-ax) AS at FROM g WHERE zy <> ay AND (20000.5-ay)/(zy-ay) BETWEEN 0 AND 1 UNION ALL SELECT DISTINCT ring_name, 'toll', ay + (30000.5-ax)/(bx-ax)*(zy-ay) FROM g WHERE bx <> ax AND (30000.5-ax)/(bx-ax) BETWEEN 0 AND 1),
      q AS (SELECT ring_name, count(*) FILTER (kind = 'rail') AS rail, count(*) FILTER (kind = 'toll') AS toll FROM o GROUP BY 1)
      SELECT ring_name, CAST(sum((lower(site_type) LIKE '%hub%')::INT) AS BIGINT) AS "FO Hub", CAST(sum((NOT lower(site_type) LIKE '%hub%')::INT) AS BIGINT) AS "Site List", CAST(sum((note = 'insert')::INT) AS BIGINT) AS "ODP", CAST(sum((note <> 'insert')::INT) AS BIGINT) AS "OTB",
      round(coalesce(any_value(access), 0), 4) AS "Access", round(coalesce(any_value(backbone), 0), 4) AS "Backbone", coalesce(any_value(rail), 0) AS "Obstacle Railway", coalesce(any_value(toll), 0) AS "Obstacle Toll" FROM noted LEFT JOIN l USING (ring_name) LEFT JOIN q USING (ring_name) GROUP BY 1""",
    "AGG-08": f"{_R}, c AS (SELECT ring_name, site_type, count(*) AS n FROM site_rings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ring_name ORDER BY n DESC, site_type) AS k FROM c) SELECT ring_name, site_type FROM r WHERE k = 1",
    "AGG-09": f'{_S} SELECT site_type, count(*) AS "count" FROM sites GROUP BY 1',
    "AGG-10": f"{_R}, c AS (SELECT *, count(*) OVER (PARTITION BY ring_name, region) AS n FROM site_rings) SELECT site_id, ring_name, region, n FROM c WHERE n > 3",
    "AGG-14": f"{_R} SELECT ring_name, x, y, count(*) AS n FROM site_rings GROUP BY 1, 2, 3",
    "AGG-15": f"{_R}, c AS (SELECT ring_name, x, y, count(*) AS n FROM site_rings GROUP BY 1, 2, 3) SELECT ring_name, CAST(sum(CASE WHEN n > 1 THEN n * n ELSE 0 END) AS BIGINT) AS score FROM c GROUP BY 1",
    "AGG-17": f"{_R} SELECT ring_name, arg_min(region, seq) AS region FROM site_rings GROUP BY 1",
    "AGG-20": f"{_R}, u AS (SELECT DISTINCT ring_name, x, y FROM site_rings) SELECT ring_name, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM u GROUP BY 1",
    "WIN-01": f"{_R}{_NOTED}, {_TOPO} SELECT ring_name, near_end, far_end, hubs, hubs NOT IN (1, 2) AS rejected FROM topo WHERE far_end IS NOT NULL AND far_end <> near_end",
    "WIN-02": f"{_R}, s AS ({_SEG.format('site_rings')}) SELECT ring_name, site_id_a, site_id_b, sequence, round(length, 6) AS length FROM s WHERE site_id_b IS NOT NULL",
    "WIN-03": f"""{_R}, v AS (SELECT ring_name, x, y, CAST(row_number() OVER (PARTITION BY ring_name ORDER BY seq) - 1 AS INT) AS vertex, count(*) OVER (PARTITION BY ring_name) AS n FROM site_rings),
      g AS (SELECT *, CASE WHEN vertex = 0 THEN 'Start' WHEN vertex = n - 1 THEN 'End' ELSE 'Middle' END AS flag FROM v) SELECT ring_name, vertex, x, y, flag, CASE WHEN flag = 'Middle' THEN 'Site List' ELSE 'FO Hub' END AS site_type FROM g""",
    "WIN-05": f"""{with_views("site_rings", "hubs")}, k AS (SELECT ring_name, p.site_id, q.site_id AS hub_id, {_D2} AS d2, row_number() OVER (PARTITION BY p.site_id ORDER BY {_D2}, q.site_id) AS n FROM site_rings p, hubs q WHERE {_D2} <= 100000000),
      b AS (SELECT ring_name, hub_id, min(d2) AS d2 FROM k WHERE n <= 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ring_name ORDER BY d2, hub_id) AS m FROM b) SELECT ring_name, hub_id, d2, CASE m WHEN 1 THEN 'start' ELSE 'end' END AS flag FROM r WHERE m <= 2""",
    "WIN-07": f"{_R}, c AS (SELECT site_id, region, CAST(dense_rank() OVER (PARTITION BY region ORDER BY ring_name) AS INT) AS cluster_no FROM site_rings) SELECT site_id, cluster_no, concat(region, '_', lpad(CAST(cluster_no AS VARCHAR), 4, '0')) AS ring_name FROM c",
    "WIN-11": f"{_R} SELECT site_id, CAST(row_number() OVER (PARTITION BY ring_name ORDER BY CASE WHEN seq % 3 = 0 THEN seq END ASC NULLS LAST, site_id) AS INT) AS sort_no FROM site_rings",
    "CL-07": f"{_R} SELECT site_id, ring_name FROM site_rings WHERE ring_name IN (SELECT ring_name FROM site_rings WHERE lower(site_type) LIKE '%new%')",
    "PRJ-21": f"{_R}{_NOTED}, z AS (SELECT * FROM noted WHERE seq <> 3 OR region = 'ASIA') SELECT site_id, ring_name FROM z WHERE ring_name IN (SELECT ring_name FROM z WHERE note = 'insert')",
    "INS-03": f"""{_R}{_NOTED}, {_TOPO}, h AS (SELECT ring_name, arg_min(site_id, seq) AS first_hub, arg_max(site_id, seq) AS last_hub FROM noted WHERE lower(site_type) LIKE '%hub%' GROUP BY 1)
      SELECT o.ring_name, near_end, far_end, a.site_type AS near_type, b.site_type AS far_type, CASE WHEN a.note = 'existing' AND lower(b.site_type) LIKE '%hub%' THEN 'P0' WHEN a.note = 'existing' THEN 'Access' WHEN a.note = 'insert' AND NOT lower(b.site_type) LIKE '%hub%' THEN 'Insert Site' ELSE 'Access' END AS priority,
      CASE WHEN a.note = 'insert' OR b.note = 'insert' THEN 'Insert Segment' ELSE '' END AS remark, first_hub, last_hub FROM topo o LEFT JOIN noted a ON a.site_id = near_end LEFT JOIN noted b ON b.site_id = far_end LEFT JOIN h ON h.ring_name = o.ring_name WHERE far_end IS NOT NULL AND far_end <> near_end""",
    "PRJ-11": f"{with_views('folders')} SELECT site_id, trim(split_part(folders, ';', 1)) AS region, trim(split_part(folders, ';', 2)) AS ring, trim(split_part(folders, ';', -1)) AS site_type, trim(split_part(folders, ';', -2)) AS ring_last, nullif(regexp_extract(folders, '([A-Z]{{3,6}})\\s*;', 1), '') AS code FROM folders",
    "STR-08": f"{_R} SELECT site_id, CASE WHEN seq = 0 THEN 'v1' ELSE concat('v', CAST(seq % 4 + 1 AS VARCHAR)) END AS version, CAST(weekofyear(DATE '2024-01-01' + CAST(seq * 41 AS INT)) AS INT) AS week FROM site_rings",
    "PRJ-15": f"{_COST} SELECT * FROM costs",
    "GR-12": f"""{_COST}, rr AS ({with_views("site_rings")} SELECT ring_name, seq FROM site_rings), p AS (SELECT DISTINCT ring_name, seq, CAST(CAST(substring(ring_name, 2, 6) AS BIGINT) * 3 % 30 + seq * 2 + i AS BIGINT) AS node FROM rr, (SELECT unnest(range(10)) AS i)),
      b AS (SELECT a.ring_name, a.seq AS seq_a, c.seq AS seq_b, a.node FROM p a JOIN p c ON a.ring_name = c.ring_name AND a.node = c.node AND a.seq < c.seq)
      SELECT x.ring_name, x.seq_a, x.seq_b, sum(length) AS shared FROM b x JOIN costs ON x.node = node_start JOIN b y ON y.node = node_end AND y.ring_name = x.ring_name AND y.seq_a = x.seq_a AND y.seq_b = x.seq_b GROUP BY 1, 2, 3 HAVING sum(length) > 3000""",
    "POL-01": f"""{with_views("sites", "hubs", "polygons")}, a AS (SELECT * FROM sites UNION ALL SELECT * FROM hubs), z AS (SELECT site_id, polygon_id, name, lower(site_type) LIKE '%hub%' AS hub, row_number() OVER (PARTITION BY polygon_id, lower(site_type) LIKE '%hub%' ORDER BY site_id) AS n FROM a JOIN polygons ON {_IN}),
      f AS (SELECT *, CASE WHEN hub AND n = 1 THEN 'Start' WHEN hub AND n = 2 THEN 'End' WHEN NOT hub THEN '' END AS flag, regexp_extract(name, '\\b(\\d{{2}})([A-Z]{{3}})(\\d+)\\b', 2) AS code FROM z)
      SELECT site_id, polygon_id, flag, concat('RING-', code, '-P-', lpad(CAST(dense_rank() OVER (PARTITION BY code ORDER BY polygon_id) AS VARCHAR), 4, '0')) AS ring FROM f WHERE flag IS NOT NULL""",
}
