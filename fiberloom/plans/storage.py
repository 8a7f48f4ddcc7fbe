"""Queries of sources and sinks: what is written is read back as the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.operators import tables
from fiberloom.plans.fixtures import view, with_views
from fiberloom.runtime import scratch
from fiberloom.sources import files, kml


def src_05(s, d):
    """Placemarks written as one KML for each region and read back."""
    point = F.array(F.struct("x", "y"))
    rows = view(s, d, "folders").join(view(s, d, "sites"), "site_id").select("region", "folders", F.col("site_id").alias("name"), F.lit("point").alias("kind"), point.alias("line"), F.create_map(F.lit("type"), F.col("site_type")).alias("data"))
    back = kml.parse(kml.documents(rows, "region"))
    return back.select(F.col("name").alias("site_id"), "folders", F.col("data")["type"].alias("site_type"), F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))


def src_03(s, d):
    """Road ids by island, for the cells around the hubs, one row for each geometry."""
    n = view(s, d, "road_nodes")
    e = view(s, d, "road_edges").join(n.select(F.col("node_id").alias("node_start"), "x", "y"), "node_start")
    data = e.select("node_start", "node_end", "length", F.lit("J").alias("Island"), F.concat_ws("_", F.floor(F.col("x") / 10000), F.floor(F.col("y") / 10000)).alias("cell"), F.concat_ws("-", "node_start", "node_end").alias("geometry"))
    around = files.cells_of(view(s, d, "hubs"), 10_000.0, 1000.0)
    return files.roads(data, around).select("node_start", "node_end", "length", "cell")


def prj_04(s, d):
    wide = view(s, d, "site_rings").where("seq < 9").select(F.col("site_id").alias("site_id_a"), F.col("x").alias("x_a"), (F.col("x") + 1).alias("x_b"), F.concat(F.lit("B"), "site_id").alias("site_id_b"), "ring_name")
    near, far = tables.split_sides(wide)
    return near.unionByName(far)


def prj_18(s, d):
    ids = view(s, d, "sites").select("site_id")
    after = F.concat(F.lit("S"), F.lpad((F.substring("site_id", 2, 7).cast("int") + 1).cast("string"), 7, "0"))
    # Names as they are drawn: parts hold more than the id, some the other end's too, some end in a marker word.
    first = F.when(F.col("seq") % 3 == 1, F.concat(F.lit("X"), "site_id", F.lit("/2"))).when(F.col("seq") % 3 == 2, F.concat("site_id", F.lit(" "), after)).otherwise(F.col("site_id"))
    segs = view(s, d, "site_rings").select(F.concat(first, F.lit("-"), after, F.when(F.col("seq") % 2 == 0, " Connection").otherwise(" route")).alias("name"))
    return tables.near_far(segs, ids)


def snk_01(s, d):
    """Hubs written in degrees and read back."""
    path = f"{scratch(s)}/hubs.parquet"
    files.write_degrees(view(s, d, "hubs").select("site_id", "x", "y"), path)
    return s.read.parquet(path).select("site_id", F.round("long", 9).alias("long"), F.round("lat", 9).alias("lat"))


QUERIES = {"SRC-05": src_05, "SRC-03": src_03, "PRJ-04": prj_04, "PRJ-18": prj_18, "SNK-01": snk_01}

ORACLE = {
    "SRC-05": f"{with_views('sites', 'folders')} SELECT site_id, folders, site_type, x, y FROM folders JOIN sites USING (site_id)",
    "SRC-03": f"""{with_views("hubs", "road_edges", "road_nodes")}, o AS (SELECT DISTINCT i, j FROM (SELECT ord, unnest(range(CAST(floor((x-1000)/10000.0) AS BIGINT), CAST(floor((x+1000)/10000.0) AS BIGINT)+1)) AS i FROM hubs) a
      JOIN (SELECT ord, unnest(range(CAST(floor((y-1000)/10000.0) AS BIGINT), CAST(floor((y+1000)/10000.0) AS BIGINT)+1)) AS j FROM hubs) b USING (ord))
      SELECT concat('J_', CAST(node_start AS VARCHAR)) AS node_start, concat('J_', CAST(node_end AS VARCHAR)) AS node_end, length, concat(CAST(i AS VARCHAR), '_', CAST(j AS VARCHAR)) AS cell
      FROM road_edges JOIN road_nodes ON node_id = node_start JOIN o ON i = CAST(floor(x/10000.0) AS BIGINT) AND j = CAST(floor(y/10000.0) AS BIGINT)""",
    "PRJ-04": f"{with_views('site_rings')} SELECT site_id, x, ring_name, 'NE' AS point_type FROM site_rings WHERE seq < 9 UNION ALL SELECT concat('B', site_id), x + 1, ring_name, 'FE' FROM site_rings WHERE seq < 9",
    "PRJ-18": f"""{with_views("site_rings")}, n AS (SELECT site_id, seq, concat('S', lpad(CAST(CAST(substring(site_id, 2, 7) AS INT) + 1 AS VARCHAR), 7, '0')) AS nx FROM site_rings),
      p AS (SELECT concat(CASE seq % 3 WHEN 1 THEN concat('X', site_id, '/2') WHEN 2 THEN concat(site_id, ' ', nx) ELSE site_id END, '-', nx, CASE seq % 2 WHEN 0 THEN ' Connection' ELSE ' route' END) AS name FROM n),
      a AS (SELECT name, site_id FROM p JOIN sites ON contains(split_part(name, '-', 1), site_id)), b AS (SELECT name, site_id FROM p JOIN sites ON contains(split_part(name, '-', 2), site_id)),
      c AS (SELECT name, min(CASE WHEN k = 1 OR site_id NOT IN (SELECT site_id FROM b WHERE b.name = z.name) THEN site_id END) AS near_end FROM (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM a) z GROUP BY 1),
      e AS (SELECT name, min(CASE WHEN k = 1 OR site_id NOT IN (SELECT site_id FROM a WHERE a.name = z.name) THEN site_id END) AS far_end FROM (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM b) z GROUP BY 1)
      SELECT name, near_end, far_end FROM p LEFT JOIN c USING (name) LEFT JOIN e USING (name)""",
    "SNK-01": f"{with_views('hubs')} SELECT site_id, round(degrees(x/6378137.0), 9) AS long, round(degrees(2*atan(exp(y/6378137.0)) - 1.5707963267948966), 9) AS lat FROM hubs",
}
