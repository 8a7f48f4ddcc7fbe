"""Queries of the fixed wireless line, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators import components, fwa, spatial
from fiberloom.plans.fixtures import view, with_views
from fiberloom.runtime import durable

RADIUS = 1500.0
USABLE = "SELECT * FROM buildings WHERE asp_ratio > 0.25 AND area_in_meters > 25 AND area_in_meters < 500"
CLASS = "CASE WHEN area_in_meters > 70 THEN 'high' WHEN area_in_meters > 45 THEN 'medium' WHEN area_in_meters > 36 THEN 'low' ELSE 'very low' END"
#: Candidate pairs of the oracle side, by cells as well: a plain inequality join would take minutes.
PAIRS = f"""h AS ({USABLE}),
g AS (SELECT building_id, x AS hx, y AS hy, {CLASS} AS home_class, CAST(floor(x / {RADIUS}) AS BIGINT) AS cx, CAST(floor(y / {RADIUS}) AS BIGINT) AS cy FROM h),
o AS (SELECT unnest([-1, 0, 1]) AS d),
c AS (SELECT s.*, CAST(floor(x / {RADIUS}) AS BIGINT) + a.d AS cx, CAST(floor(y / {RADIUS}) AS BIGINT) + b.d AS cy FROM sites s, o a, o b),
pairs AS (SELECT c.site_id, c.ord, c.x, c.y, g.building_id, g.hx, g.hy, g.home_class FROM c JOIN g USING (cx, cy) WHERE (c.x-g.hx)*(c.x-g.hx)+(c.y-g.hy)*(c.y-g.hy) <= {RADIUS * RADIUS})"""
SUMS = ", ".join(f"CAST(coalesce(sum(CASE WHEN home_class = '{c}' THEN 1 END), 0) AS BIGINT) AS hp_{c.replace(' ', '_')}" for c in fwa.CLASSES)
GRADE = "CASE WHEN total_homepass > 700 THEN 'P1' WHEN total_homepass > 500 THEN 'P2' WHEN total_homepass > 300 THEN 'P3' ELSE 'P4' END"
HP = [f"hp_{c.replace(' ', '_')}" for c in fwa.CLASSES]
ROTATION = f"""{PAIRS},
f AS (SELECT site_id, building_id, home_class, (degrees(atan2(hx - x, hy - y)) + 360.0) % 360.0 AS az FROM pairs),
bins AS (SELECT site_id, CAST(floor(az / 5) AS INT) AS fan, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT site_id, rotation, n, CAST(floor(((fan * 5 - rotation + 360) % 360) / 120.0) AS INT) + 1 AS sector FROM bins, (SELECT unnest(range(0, 120, 5)) AS rotation)),
z AS (SELECT site_id, CAST(rotation AS INT) AS rotation, sector, CAST(sum(n) AS BIGINT) AS total_homepass FROM t GROUP BY ALL),
k AS (SELECT site_id, rotation, sum(CASE WHEN ceil(total_homepass * 83 / 100.0) >= 20 THEN 1 ELSE 0 END) AS v FROM z GROUP BY ALL),
best AS (SELECT site_id, rotation FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY v DESC, rotation) AS r FROM k) WHERE r = 1)"""


def _sites(s, d):
    return view(s, d, "sites")


def _homes(s, d):
    return fwa.usable_buildings(view(s, d, "buildings"))


def agg_01(s, d):
    return fwa.count_homes(_sites(s, d), _homes(s, d), RADIUS).select("site_id", "region", *HP, "total_homepass", "market_grade")


def jn_02(s, d):
    b = _homes(s, d).select("building_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    return spatial.within_radius(_sites(s, d).select("site_id", "x", "y"), b, RADIUS).select("site_id", "building_id", "d2")


def fwa_03(s, d):
    return fwa.rotations(_sites(s, d), _homes(s, d), RADIUS, threshold=20).select("site_id", "rotation", "sector", "total_homepass", "valid")


def geo_08(s, d):
    best = fwa.rotations(_sites(s, d), _homes(s, d), RADIUS, threshold=20)
    return fwa.sectors(best, 120, 240).select("sector_id", "sector_group", F.col("azimuth_start").cast("int"), F.col("azimuth_end").cast("int"))


def agg_02(s, d, method="maximize"):
    best = fwa.rotations(_sites(s, d), _homes(s, d), RADIUS, threshold=20)
    return fwa.sector_homes(best, _sites(s, d), _homes(s, d), RADIUS, method=method).select("site_id", F.col("sector").cast("int"), *HP, "total_homepass")


def agg_03(s, d):
    return fwa.site_rollup(agg_02(s, d))


def agg_04(s, d):
    return agg_02(s, d, "unique")


def geo_09(s, d):
    return fwa.overlaps(_sites(s, d), 300.0).select("a", "b", F.round("percent", 6).alias("percent"))


def fwa_01(s, d):
    homes = fwa.count_homes(_sites(s, d), _homes(s, d), RADIUS)
    return fwa.clean_overlaps(homes).select("site_id", "total_homepass", "kept")


def _sectored(s, d):
    homes = fwa.count_homes(_sites(s, d), _homes(s, d), RADIUS)
    kept = fwa.clean_overlaps(homes)
    best = fwa.sectors(fwa.rotations(_sites(s, d), _homes(s, d), RADIUS, threshold=20))
    rows = best.join(kept.select("site_id", "site_type", "x", "y", "kept", "ord"), "site_id")
    return durable(rows.withColumn("ord", F.col("ord") * 10 + F.col("sector")).withColumn("angle", F.lit(120)))


def geo_10(s, d):
    return fwa.sector_overlaps(_sectored(s, d).where("kept"), 800.0).select("a", "b", F.round("shared", 3).alias("shared"), F.round("percent", 3).alias("percent"))


def fwa_02(s, d):
    return fwa.clean_sector_overlaps(_sectored(s, d).where("kept").drop("kept"), 500.0).select("sector_id", "kept")


def fwa_05(s, d):
    rows = _sectored(s, d)
    return fwa.extend_sectors(rows.where("not kept").drop("kept"), rows.where("kept").drop("kept"), 500.0).select("sector_id", "site_id")


def fwa_06(s, d):
    """Region pipeline: count, clean, sectorize, clean sectors, count again, roll up."""
    rows = fwa.clean_sector_overlaps(_sectored(s, d).where("kept").drop("kept"), 500.0).where("kept")
    return fwa.site_rollup(fwa.sector_homes(rows.select("site_id", "rotation", "sector"), _sites(s, d), _homes(s, d), RADIUS))


def geo_07(s, d):
    return fwa.regions(view(s, d, "hubs"), 2250.0).select("site_id", "group")


def cl_01(s, d):
    pairs = spatial.self_pairs(view(s, d, "hubs"), "ord", 4500.0)
    comp = components.connected(pairs.select("a", "b"))
    return comp.select(F.col("id").alias("ord"), F.col("component").alias("cluster"))


def jn_11(s, d):
    return spatial.self_pairs(_sites(s, d), "ord", 2000.0)


def prj_12(s, d):
    b = view(s, d, "buildings")
    return b.select("building_id", fwa.home_class(F.col("area_in_meters")).alias("home_class"), fwa.market_grade(F.col("area_in_meters")).alias("grade"))


def src_04(s, d):
    return fwa.usable_buildings(view(s, d, "buildings"), one_unit=True)


def prj_crs(s, d):
    lon, lat = geo.degrees_of(F.col("x"), F.col("y"))
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    out = _sites(s, d).select("site_id", lon.alias("lon"), lat.alias("lat"))
    return out.select("site_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round(x, 4).alias("x"), (F.round(y, 4) + F.lit(0.0)).alias("y"))


QUERIES = {
    "AGG-01": agg_01, "JN-02": jn_02, "FWA-03": fwa_03, "GEO-08": geo_08, "AGG-02": agg_02, "AGG-03": agg_03, "AGG-04": agg_04,
    "GEO-09": geo_09, "FWA-01": fwa_01, "GEO-10": geo_10, "FWA-02": fwa_02, "FWA-05": fwa_05, "FWA-06": fwa_06, "GEO-07": geo_07, "CL-01": cl_01, "JN-11": jn_11,
    "PRJ-12": prj_12, "SRC-04": src_04, "CRS": prj_crs,
}

_SB = with_views("sites", "buildings")
_SECTOR = f"""{_SB}, {ROTATION},
j AS (SELECT f.site_id, f.building_id, f.home_class, CAST(floor(((az - rotation + 360) % 360) / 120.0) AS INT) + 1 AS sector FROM f JOIN best USING (site_id))"""
_REACH = """RECURSIVE {views}, e AS (SELECT a.ord AS a, b.ord AS b FROM hubs a JOIN hubs b ON a.ord <> b.ord AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 4500.0*4500.0),
r(ord, root) AS (SELECT ord, ord FROM hubs UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.ord)"""


def _recursive(*names):
    return "WITH " + _REACH.format(views=with_views(*names).removeprefix("WITH "))


ORACLE = {
    "AGG-01": f"""{_SB}, {PAIRS}, c2 AS (SELECT site_id, {SUMS}, count(*) AS n FROM pairs GROUP BY 1)
      SELECT site_id, region, {", ".join(f"coalesce({h}, 0) AS {h}" for h in HP)}, coalesce(n, 0) AS total_homepass, {GRADE.replace("total_homepass", "coalesce(n, 0)")} AS market_grade FROM sites LEFT JOIN c2 USING (site_id)""",
    "JN-02": f"{_SB}, {PAIRS} SELECT site_id, building_id, (x-hx)*(x-hx)+(y-hy)*(y-hy) AS d2 FROM pairs",
    "FWA-03": f"{_SB}, {ROTATION} SELECT site_id, rotation, sector, total_homepass, ceil(total_homepass * 83 / 100.0) >= 20 AS valid FROM z JOIN best USING (site_id, rotation)",
    "GEO-08": f"""{_SB}, {ROTATION} SELECT concat(site_id, '_', CAST(sector AS VARCHAR)) AS sector_id, concat(site_id, '_', CAST(CAST(floor((sector - 1) / 2.0) AS BIGINT) + 1 AS VARCHAR)) AS sector_group,
      CAST((sector - 1) * 120 + rotation AS INT) AS azimuth_start, CAST(CASE WHEN sector * 120 + rotation > 360 THEN sector * 120 + rotation - 360 ELSE sector * 120 + rotation END AS INT) AS azimuth_end FROM z JOIN best USING (site_id, rotation)""",
    "AGG-02": f"{_SECTOR} SELECT site_id, sector, {SUMS}, count(*) AS total_homepass FROM j GROUP BY 1, 2",
    "AGG-03": f"{_SECTOR}, q AS (SELECT site_id, sector, {SUMS}, count(*) AS total_homepass FROM j GROUP BY 1, 2) SELECT site_id, count(*) AS sectors, {', '.join(f'CAST(sum({h}) AS BIGINT) AS {h}' for h in [*HP, 'total_homepass'])} FROM q GROUP BY 1",
    "AGG-04": f"{_SECTOR}, u AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY site_id, sector) AS n FROM j) SELECT site_id, sector, {SUMS}, count(*) AS total_homepass FROM u WHERE n = 1 GROUP BY 1, 2",
    "GEO-09": f"""{with_views("sites")}, p AS (SELECT a.ord AS a, b.ord AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM sites a JOIN sites b ON a.ord < b.ord AND abs(a.x-b.x) <= 1200 AND abs(a.y-b.y) <= 1200),
      q AS (SELECT a, b, CASE WHEN d >= 1200 THEN 0 ELSE (CAST(720000 AS DOUBLE)*acos(least(1.0, d/1200.0)) - d/2*sqrt(greatest(0.0, CAST(1440000 AS DOUBLE)-d*d))) * 100.0 / (CAST(3.141592653589793 AS DOUBLE)*600*600) END AS percent FROM p)
      SELECT a, b, round(percent, 6) AS percent FROM q WHERE percent >= 10""",
    "GEO-07": f"""{_recursive("hubs")} SELECT h.site_id, min(r.root) AS "group" FROM r JOIN hubs h ON h.ord = r.ord GROUP BY 1""",
    "CL-01": f"{_recursive('hubs')}, c AS (SELECT ord, min(root) AS cluster FROM r GROUP BY 1) SELECT ord, cluster FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY 1 HAVING count(*) > 1)",
    "JN-11": f"{with_views('sites')} SELECT a.ord AS a, b.ord AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM sites a JOIN sites b ON a.ord < b.ord AND abs(a.x-b.x) <= 2000 AND abs(a.y-b.y) <= 2000 WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 4000000",
    "PRJ-12": f"{with_views('buildings')} SELECT building_id, {CLASS} AS home_class, {GRADE.replace('total_homepass', 'area_in_meters')} AS grade FROM buildings",
    "SRC-04": f"{with_views('buildings')} {USABLE} AND one_unit = 1",
    "CRS": f"""{with_views("sites")}, d AS (SELECT site_id, degrees(x/6378137.0) AS lon, degrees(2*atan(exp(y/6378137.0)) - 1.5707963267948966) AS lat FROM sites)
      SELECT site_id, round(lon, 9) AS lon, round(lat, 9) AS lat, round(6378137.0*radians(lon), 4) AS x, round(6378137.0*ln(tan(0.7853981633974483+radians(lat)/2)), 4) + 0.0 AS y FROM d""",
}
