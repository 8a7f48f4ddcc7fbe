"""Views of the driver's tables as sites, hubs, buildings and roads; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS: dict[str, str] = {
    "sites": """SELECT concat('S', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) AS site_id, c_name AS site_name,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'New Site' WHEN 'BUILDING' THEN 'Green Field' WHEN 'MACHINERY' THEN 'Rooftop' ELSE 'Existing Site' END AS site_type,
 r_name AS region, CAST((c_custkey*7919)%50000 AS DOUBLE) AS x, CAST((c_custkey*104729)%50000 AS DOUBLE) AS y, c_custkey AS ord
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "hubs": """SELECT concat('H', lpad(CAST(s_suppkey AS VARCHAR(20)), 7, '0')) AS site_id, s_name AS site_name, 'FO Hub' AS site_type, r_name AS region,
 CAST((s_suppkey*15485863+17)%50000 AS DOUBLE) AS x, CAST((s_suppkey*32452843+29)%50000 AS DOUBLE) AS y, s_suppkey AS ord
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "buildings": """SELECT o_orderkey AS building_id, CAST((o_orderkey*6700417)%50000 AS DOUBLE) AS x, CAST((o_orderkey*2147483647)%50000 AS DOUBLE) AS y,
 CAST(CAST(floor(o_totalprice) AS BIGINT)%600 AS DOUBLE) AS area_in_meters, (o_orderkey%100)/CAST(100 AS DOUBLE) AS asp_ratio, CAST(o_orderkey%2 AS INT) AS one_unit FROM orders""",
    "road_nodes": """SELECT p_partkey AS node_id, CAST((p_partkey%40)*1250 AS DOUBLE) AS x, CAST(CAST(floor(p_partkey/CAST(40 AS DOUBLE)) AS BIGINT)*1000 AS DOUBLE) AS y,
 CASE WHEN p_size<=10 THEN 1 ELSE 0 END AS ref_fo FROM part""",
    "road_edges": """SELECT a.p_partkey AS node_start, b.p_partkey AS node_end, CAST(1250 + a.p_size AS DOUBLE) AS length,
 CASE a.p_type WHEN 'ECONOMY' THEN 'residential' WHEN 'PROMO' THEN 'track' ELSE 'primary' END AS highway, CASE WHEN a.p_size<=10 AND b.p_size<=10 THEN 1 ELSE 0 END AS ref_fo
 FROM part a JOIN part b ON b.p_partkey=a.p_partkey+1 WHERE a.p_partkey%40<>39
 UNION ALL SELECT a.p_partkey AS node_start, b.p_partkey AS node_end, CAST(1000 + a.p_size AS DOUBLE) AS length,
 CASE a.p_type WHEN 'ECONOMY' THEN 'residential' WHEN 'PROMO' THEN 'track' ELSE 'primary' END AS highway, CASE WHEN a.p_size<=10 AND b.p_size<=10 THEN 1 ELSE 0 END AS ref_fo
 FROM part a JOIN part b ON b.p_partkey=a.p_partkey+40""",
    "site_rings": """SELECT site_id, site_name, site_type, region, x, y, concat('R', lpad(CAST(CAST(floor(ord/CAST(10 AS DOUBLE)) AS BIGINT) AS VARCHAR(20)), 6, '0')) AS ring_name,
 CAST(ord%10 AS INT) AS seq FROM sites""",
    "polygons": """SELECT a.p_partkey AS polygon_id, concat('Area ', lpad(CAST(a.p_partkey AS VARCHAR(20)), 2, '0'), 'XYZ', CAST(a.p_partkey AS VARCHAR(20)), ' fiber') AS name,
 CAST(((a.p_partkey-1)%5)*10000 AS DOUBLE) AS minx, CAST(CAST(floor((a.p_partkey-1)/CAST(5 AS DOUBLE)) AS BIGINT)*10000 AS DOUBLE) AS miny FROM part a WHERE a.p_partkey BETWEEN 1 AND 25""",
    "fiber_lines": """SELECT concat('F', CAST(e.node_start AS VARCHAR(20)), '-', CAST(e.node_end AS VARCHAR(20))) AS name, s.x AS ax, s.y AS ay, t.x AS bx, t.y AS by, e.length
 FROM road_edges e JOIN road_nodes s ON s.node_id=e.node_start JOIN road_nodes t ON t.node_id=e.node_end WHERE e.ref_fo=1""",
    "folders": """SELECT site_id, concat(region, ' ; Program ', CAST(seq%3 AS VARCHAR(20)), ';', ring_name, ';', site_type) AS folders FROM site_rings""",
}

NEEDS = {"site_rings": ("sites",), "fiber_lines": ("road_edges", "road_nodes"), "folders": ("sites", "site_rings")}


def _order(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in (*_order(NEEDS.get(n, ())), n):
            if d not in out:
                out.append(d)
    return out


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for an SQL engine."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _order(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"{with_views(name)} SELECT * FROM {name}"
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
