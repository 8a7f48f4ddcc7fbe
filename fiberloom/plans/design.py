"""Queries of intake, overlay, hub search, insertion routes, wireless variants, the bill's layers, and report layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators import boq, fwa, intake, network, overlay, rings, spatial, tables
from fiberloom.plans import jobs
from fiberloom.plans.fixtures import view, with_views
from fiberloom.plans.fwa import PAIRS, RADIUS, _homes
from fiberloom.plans.rings import _NOTED, _SEG, _TOPO, _lines, _noted, _ring
from fiberloom.runtime import durable, scratch
from fiberloom.sources import files, kml, reports, vector, xlsx


def _gaps(s, d):
    """Areas of 6 km with gaps of 4 km between them."""
    return view(s, d, "polygons").select("polygon_id", _ring(F.col("minx"), F.col("miny"), F.col("minx") + 6000, F.col("miny") + 6000).alias("ring"))


def _barriers(s):
    return s.createDataFrame([("Railway", 0.0, 20000.5, 50000.0, 20000.5), ("Toll", 30000.5, 0.0, 30000.5, 50000.0)], "name string, ax double, ay double, bx double, by double")


# intake -----------------------------------------------------------------------------------------


def prj_05(s, d):
    """Drawn sites and segments of all rings; every second segment lies in a folder of routes."""
    f = view(s, d, "folders").join(view(s, d, "sites").select("site_id", "x", "y"), "site_id").withColumnRenamed("site_id", "name")
    mark = f.limit(0).unionByName(f).unionByName(f.select(F.concat("name", F.lit(" Connection")).alias("name"), "folders", "x", "y"))
    segs = rings.segments(view(s, d, "site_rings")).join(f.select(F.col("name").alias("site_id_a"), "folders"), "site_id_a")
    lines = segs.select(F.concat_ws("-", "site_id_a", "site_id_b").alias("name"), "folders", F.when(F.col("sequence") % 2 == 0, "Route A").otherwise("Topology").alias("folder_name"), F.array().cast(geo.LINE).alias("line"))
    new = view(s, d, "hubs").select("site_id", "site_name", F.col("x").alias("long"), F.col("y").alias("lat"))
    _, points, routes = intake.insertion(new, mark, lines)
    both = points.select(F.lit("site").alias("kind"), F.col("site_id").alias("name"), F.col("site_type").alias("what"), "ring_name", "program", "region")
    return both.unionByName(routes.select(F.lit("route").alias("kind"), F.col("near_end").alias("name"), F.col("far_end").alias("what"), "ring_name", "program", "region"))


def prj_08(s, d):
    both = view(s, d, "sites").unionByName(view(s, d, "hubs"))
    return intake.without_hubs(both, view(s, d, "hubs")).select("site_id")


def prj_19(s, d):
    segs = rings.segments(view(s, d, "site_rings")).select(F.concat("site_id_a", F.lit(" - "), "site_id_b", F.when(F.col("sequence") % 4 == 1, " Connection").otherwise("")).alias("name"), F.when(F.col("sequence") == 0, "fo hub x").otherwise("Rooftop").alias("site_type"))
    return intake.earlier_design(segs).select("name", "site_type", "near_end", "far_end")


def _three_ways(s, d):
    """Rings whose hub is a near end, only a far end, or in no segment at all."""
    p = view(s, d, "site_rings").withColumn("no", F.substring("ring_name", 2, 6).cast("int"))
    points = p.withColumn("site_type", F.when(F.col("seq") == 5, "FO Hub").otherwise(F.lit("Site List")))
    segs = rings.segments(p).join(p.select(F.col("site_id").alias("site_id_a"), F.col("seq").alias("at"), "no"), "site_id_a")
    cut = segs.where(~((F.col("no") % 3 > 0) & (F.col("at") == 5)) & ~((F.col("no") % 3 == 2) & (F.col("at") == 4)))
    return points, cut.select("ring_name", F.col("site_id_a").alias("near_end"), F.col("site_id_b").alias("far_end"), F.col("sequence").alias("seq"))


def prj_20(s, d):
    return intake.start_of_ring(*_three_ways(s, d))


def cl_06(s, d):
    cluster = (F.floor(F.col("x") / 2500) * 100 + F.floor(F.col("y") / 2500)).cast("int")
    rows = view(s, d, "sites").select("site_id", F.when(F.col("site_type") == "Existing Site", -1).otherwise(cluster).alias("cluster"))
    return intake.large_enough(rows, "cluster", 3)


def cl_10(s, d):
    return rings.hub_assignment(view(s, d, "site_rings"), view(s, d, "hubs"), 900.0, use_centroid=True).select("ring_name", "outcome", "hub_id", "flag")


def prj_01(s, d):
    """Hubs under a header that stands in the second row, as a workbook without one has them."""
    body = view(s, d, "hubs").select((F.col("ord") + 5).cast("long").alias("row"), F.col("site_id").alias("Unnamed: 0"), F.col("region").alias("Unnamed: 1"), F.lit(None).cast("string").alias("Unnamed: 2"))
    head = s.createDataFrame([(0, None, None, None), (1, "Site\n ID*", "Region.x", "nan")], "row long, `Unnamed: 0` string, `Unnamed: 1` string, `Unnamed: 2` string")
    return tables.sanitize_header(head.unionByName(body), "row", lowercase=True).select("site_id", "region")


def _given(s, d):
    """Sites as a user writes them: text, blanks, coordinates that are none."""
    p = view(s, d, "site_rings")
    lat = F.when(F.col("seq") == 3, "bad").when(F.col("seq") == 5, "95.0").otherwise((F.col("y") / 1000).cast("string"))
    name = F.when(F.col("seq") == 2, F.lit(None)).otherwise(F.concat(F.lit("  "), "site_name", F.lit(" ")))
    return p.select("site_id", name.alias("site_name"), "site_type", lat.alias("lat"), (F.col("x") / 1000).alias("long"), "ring_name", F.lit(" x ").alias("flag"))


def _checked(kind: str):
    def run(s, d):
        return tables.validate(_given(s, d), kind).select("site_id", "site_name", F.round("lat", 6).alias("lat"), F.round("long", 6).alias("long"))

    return run


# graph ------------------------------------------------------------------------------------------


def gr_05(s, d):
    """The two hubs nearest to each ring by road, from all its sites at once."""
    return jobs.hubs_by_road(view(s, d, "site_rings"), view(s, d, "hubs"), view(s, d, "road_edges"), view(s, d, "road_nodes"), 3000.0)


def _walked(s, d):
    segs = rings.topology(_noted(s, d)).withColumnRenamed("seq", "order").select("ring_name", F.col("order").alias("seq"), "near_end", "far_end")
    return network.linear_walk(segs, _noted(s, d))


def gr_09(s, d):
    return _walked(s, d)


def gr_19(s, d):
    """Points of a ring in the order in which its connections pass them."""
    return _noted(s, d).join(_walked(s, d).select("site_id", "place"), "site_id").select("ring_name", "site_id", "site_type", "place")


def gr_14(s, d):
    return jobs.routed_insertion(_noted(s, d), view(s, d, "road_edges"), view(s, d, "road_nodes")).drop("seq")


def gr_18(s, d):
    return jobs.fiber_by_road(view(s, d, "site_rings"), view(s, d, "road_edges"), view(s, d, "road_nodes"), 5000.0)


# geometry ---------------------------------------------------------------------------------------


def jn_09(s, d):
    out = overlay.intersection(boq.exploded(_lines(s, d), "ring_name"), _gaps(s, d))
    return out.groupBy("ring_name", "polygon_id").agg(F.round(F.sum("length"), 3).alias("length")).where("length > 0")


def jn_10(s, d):
    out = overlay.difference(boq.exploded(_lines(s, d), "ring_name"), _gaps(s, d))
    return out.groupBy("ring_name").agg(F.round(F.sum("length"), 3).alias("length")).where("length > 0")


def jn_04(s, d):
    """Sites within the buffer of a fiber line, its edge left out."""
    f = view(s, d, "fiber_lines").select("name", "ax", "ay", "bx", "by")
    return spatial.near_line(view(s, d, "road_nodes"), f, 1000.0, within=True).select("node_id", "name").distinct()


def prj_16(s, d):
    """Road costs without classes, for the kinds that don't weigh them."""
    e = lambda k: rings.edge_costs(view(s, d, "road_edges"), view(s, d, "road_nodes"), k).select("node_start", "node_end", F.col("weight").alias(k))
    return e("route").join(e("fiber"), ["node_start", "node_end"]).join(e("full_fiber"), ["node_start", "node_end"])


def twin_weights(s, d):
    """Roads along earlier fiber cost a third."""
    f = view(s, d, "fiber_lines").select("ax", "ay", "bx", "by")
    plain = rings.edge_costs(view(s, d, "road_edges"), view(s, d, "road_nodes"), "route")
    return rings.lighter(plain, view(s, d, "road_nodes"), f).select("node_start", "node_end", F.round("weight", 6).alias("weight"))


def jn_21(s, d):
    """Sites in and out of the zone of 2000 m around fiber."""
    f = view(s, d, "fiber_lines").select("ax", "ay", "bx", "by")
    near = spatial.near_line(view(s, d, "sites").select("site_id", "x", "y"), f, 2000.0).select("site_id").distinct()
    mark = near.withColumn("near", F.lit(True))
    return view(s, d, "sites").join(mark, "site_id", "left").select("site_id", F.when(F.col("near"), "fiber zone").otherwise("no fiber").alias("zone"))


def geo_01_box(s, d):
    return files.cells_over(view(s, d, "hubs").where("region = 'ASIA'"), "box", 5000.0, 2500.0)


def geo_01_hull(s, d):
    return files.cells_over(view(s, d, "hubs"), "hull", 2500.0, 1000.0)


def geo_02(s, d):
    cells = view(s, d, "sites").select(F.concat_ws("_", F.floor(F.col("x") / 10000), F.floor(F.col("y") / 10000)).alias("cell"), F.col("region").alias("Island"))
    return files.cells_of_island(cells, "ASIA")


def geo_13(s, d):
    segs = rings.segments(view(s, d, "site_rings"))
    near = jobs.snapped(view(s, d, "sites"), view(s, d, "road_nodes")).join(view(s, d, "road_nodes").select(F.col("node_id").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny")), "node")
    near = durable(near)
    end = lambda k: near.select(F.col("site_id").alias(f"site_id_{k}"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias(f"n{k}"))
    rows = segs.drop("length").join(end("a"), "site_id_a").join(end("b"), "site_id_b").withColumn("line", F.array("na", "nb"))
    return overlay.with_drop_wires(rows).select("ring_name", "site_id_a", F.round("length", 4).alias("length"))


def geo_15(s, d):
    """Each ring's route along the fiber that it comes near, as one stretch."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    fiber = view(s, d, "fiber_lines").select(F.col("name").alias("fiber"), F.array(p("ax", "ay"), p("bx", "by")).alias("ref"))
    pairs = boq.fiber_pairs(_lines(s, d), fiber, 20.0, ["ring_name"]).select(F.concat_ws("|", "ring_name", "fiber").alias("line_id"), "line", F.col("ref").alias("other"))
    return overlay.overlay_span(pairs).where("length > 0").select("line_id", *[F.round(c, 3).alias(c) for c in ("first", "last", "length")])


def geo_16(s, d):
    rail = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(20000.0).alias("y")), F.struct(F.lit(50000.0).alias("x"), F.lit(20000.0).alias("y")))
    rows = _lines(s, d).select("ring_name", F.posexplode(overlay.snapped_line(F.col("line"), rail, 800.0)).alias("vertex", "p"))
    return rows.select("ring_name", "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def geo_26(s, d):
    return overlay.circle_overlaps(view(s, d, "hubs"), "ord", 1500.0).select("a", "b", F.round("area", 3).alias("area"), F.size("ring").alias("corners"))


# wireless ---------------------------------------------------------------------------------------


def _counted(s, d):
    return fwa.count_homes(view(s, d, "sites"), _homes(s, d), RADIUS)


def _listed(s, d):
    """The first site of each ring, as the list of sites that are kept."""
    return view(s, d, "site_rings").groupBy("ring_name").agg(F.min("site_id").alias("site_id")).select("site_id")


def fwa_09(s, d):
    out = fwa.accept_sectors(view(s, d, "sites").select("ord", "site_id", "site_type", "x", "y"), _homes(s, d), _listed(s, d), 800.0, threshold=5)
    return out.select("sector_id", "site_id", F.col("total_homepass"), "round")


def fwa_10(s, d):
    green = F.when(fwa.is_greenfield(F.col("site_type")), 2).otherwise(1)
    rows = _counted(s, d).select("ord", "site_id", "x", "y", F.col("total_homepass").alias("homes"), green.alias("site_score"), F.when(F.col("ord") % 3 == 0, 2).otherwise(1).alias("tower_score"))
    return fwa.best_coverage(rows, 500.0).select("site_id", "kept")


def fwa_11(s, d):
    return fwa.balanced_rotations(view(s, d, "sites"), _homes(s, d), RADIUS, threshold=5).select("site_id", "rotation", "sector", "total_homepass", "valid")


def fwa_12(s, d):
    return fwa.clean_protected(_counted(s, d), _listed(s, d)).select("site_id", "kept")


# bill of quantity -------------------------------------------------------------------------------


def _bill(s, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    segs = rings.segments(view(s, d, "site_rings")).select("ring_name", "site_id_a", "site_id_b")
    end = lambda k: view(s, d, "sites").select(F.col("site_id").alias(f"site_id_{k}"), F.struct("x", "y").alias(f"p{k}"))
    ends = view(s, d, "road_nodes").select(F.col("node_id").alias("node"), F.struct("x", "y").alias("n"))
    near = durable(jobs.snapped(view(s, d, "sites").select("site_id", "x", "y"), view(s, d, "road_nodes")).join(ends, "node").select("site_id", "n"))
    at = lambda k: near.select(F.col("site_id").alias(f"site_id_{k}"), F.col("n").alias(f"n{k}"))
    lines = segs.join(end("a"), "site_id_a").join(end("b"), "site_id_b").join(at("a"), "site_id_a").join(at("b"), "site_id_b")
    lines = lines.select("ring_name", F.concat_ws("-", "site_id_a", "site_id_b").alias("line_id"), F.col("site_id_a").alias("near_end"), F.col("site_id_b").alias("far_end"), F.array("pa", "na", "nb", "pb").alias("line"))
    fiber = view(s, d, "fiber_lines").select(F.col("name").alias("fiber"), F.array(p("ax", "ay"), p("bx", "by")).alias("ref"))
    return jobs.bill_of_quantity(view(s, d, "site_rings").select("ring_name", "site_id", "x", "y"), durable(lines), fiber, _barriers(s))


def boq_03(s, d):
    return _bill(s, d)["layers"].select("layer", "ring_name", "name", F.round("length", 3).alias("length"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def boq_05(s, d):
    return _bill(s, d)["summary"]


# sources and sinks ------------------------------------------------------------------------------


def src_07(s, d):
    """Roads written by island and read for one."""
    path = f"{scratch(s)}/roads"
    e = view(s, d, "road_edges").withColumn("island", F.when(F.col("node_start") % 40 < 20, "W").otherwise("E"))
    e.write.partitionBy("island").parquet(path)
    return files.read_part(s, path, island="W").select("node_start", "node_end", "length")


def src_08(s, d):
    path = f"{scratch(s)}/buildings"
    b = view(s, d, "buildings").withColumn("city", F.concat(F.lit("C"), F.floor(F.col("x") / 10000).cast("string")))
    b.write.partitionBy("city").parquet(path)
    return files.city_buildings(s, path, "C2").select("building_id", "area_in_meters")


def src_09(s, d):
    """Hubs written as a workbook for each region, two headers in turn, and read as one table."""
    folder = scratch(s)
    regions = sorted(r[0] for r in view(s, d, "hubs").select("region").distinct().collect())
    for i, region in enumerate(regions):
        rows = view(s, d, "hubs").where(F.col("region") == region).select("site_id", F.col("region").alias("Prov" if i % 2 else "province")).toPandas()
        files.write_bytes(s, f"{folder}/hubs_{i}.xlsx", xlsx.workbook({"Sheet1": rows}))
    return files.workbooks(s, f"{folder}/hubs_*.xlsx", {"Prov": "prov2"}).select("site_id", F.coalesce("province", "prov2").alias("province"))


def src_01(s, d):
    """Hubs written as CSV and as GeoJSON in degrees and read by their extension."""
    folder = scratch(s)
    lon, lat = geo.degrees_of(F.col("x"), F.col("y"))
    view(s, d, "hubs").select("site_id", lon.alias("Longitude"), lat.alias("Latitude")).write.option("header", True).csv(f"{folder}/hubs.csv")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("site_id").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    whole = view(s, d, "hubs").agg(F.collect_list(feature).alias("features")).withColumn("type", F.lit("FeatureCollection"))  # a small fixture, as one document
    whole.write.json(f"{folder}/hubs.geojson")
    a = files.read_table(s, f"{folder}/hubs.csv").select("site_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
    b = files.read_table(s, f"{folder}/hubs.geojson").select("site_id", F.from_json("coordinates", "array<double>").alias("c"))
    return a.join(b.select("site_id", F.col("c")[0].alias("gx"), F.col("c")[1].alias("gy")), "site_id")


def src_06(s, d):
    folder = scratch(s)
    sheet = view(s, d, "hubs").select("site_id", "region").toPandas()
    files.write_bytes(s, f"{folder}/p.xlsx", xlsx.workbook({"sitelist": sheet, "hubs": sheet}))
    found = files.read_sheets(s, f"{folder}/p.xlsx", ("sitelist", "hubs"))
    return found["sitelist"].unionByName(found["hubs"])


def src_10(s, d):
    """Points of all regions written apart and compiled."""
    folder = scratch(s)
    for region in sorted(r[0] for r in view(s, d, "hubs").select("region").distinct().collect()):
        view(s, d, "sites").where(F.col("region") == region).write.parquet(f"{folder}/Points_{region.replace(' ', '_')}.parquet")
    return files.compiled(s, folder, "Points").select("site_id", "region")


def snk_06(s, d):
    """Layers that have rows, written under their names and read back."""
    folder = scratch(s)
    sites = view(s, d, "sites").select("site_id", "site_type")
    done = files.write_layers({"odp": sites.where("site_type = 'Rooftop'"), "otb": sites, "closure": sites.limit(0)}, folder)
    out = None
    for name in done:
        rows = s.read.parquet(f"{folder}/{name}").groupBy(F.lit(name).alias("layer")).agg(F.count(F.lit(1)).alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def src_11(s, d):
    path = f"{scratch(s)}/sites"
    view(s, d, "sites").write.parquet(path)
    return files.lookup(s, path, ["site_id", "region"])


def snk_04(s, d):
    """Ring designs drawn by region, and what the drawing says when it is read back."""
    lines = view(s, d, "site_rings").groupBy("ring_name").agg(F.min("region").alias("region")).join(_lines(s, d), "ring_name").where("size(line) > 1")
    named = lines.select("region", "ring_name", F.concat(F.lit("T"), "ring_name").alias("name"), "line")
    routes = named.withColumn("name", F.concat(F.lit("P"), F.substring("name", 2, 9)))
    back = kml.parse(reports.draw(reports.ring_layers(_noted(s, d), routes, named), "region"))
    return back.select("folders", "name", "kind", F.size("line").alias("places"))


def snk_05(s, d):
    lines = view(s, d, "site_rings").groupBy("ring_name").agg(F.min("region").alias("region")).join(_lines(s, d), "ring_name").where("size(line) > 1")
    back = kml.parse(reports.draw(reports.insert_layers(_noted(s, d), lines.select("region", "ring_name", F.col("ring_name").alias("name"), "line")), "region"))
    return back.select("folders", "name", "kind", F.col("data")["color"].alias("color"))


def snk_07(s, d):
    order = rings.segments(view(s, d, "site_rings")).select("ring_name", F.concat_ws(" ", F.lit("OTB"), "site_id_a").alias("name"), F.col("sequence").alias("place"))
    rows = view(s, d, "site_rings").select(F.lit("otb").alias("layer"), "ring_name", F.concat_ws(" ", F.lit("OTB"), "site_id").alias("name"))
    return reports.bill_layers(rows, order).select("folders", "name", "place")


def snk_08(s, d):
    """Counted sites as parquet and a workbook of two sheets, read back."""
    folder = scratch(s)
    homes = view(s, d, "hubs").select("site_id", "region", "x")
    regions = homes.groupBy("region").agg(F.count(F.lit(1)).alias("sites"))
    reports.export({"sites": homes}, {"Sites": homes, "Regions": regions}, folder)
    sheet = lambda n: xlsx.read_sheet(s, f"{folder}/report.xlsx", n)
    table = s.read.parquet(f"{folder}/sites").groupBy("region").agg(F.count(F.lit(1)).alias("in_table"))
    return sheet("Regions").select("region", F.col("sites").cast("long").alias("sites")).join(table, "region").join(sheet("Sites").groupBy("region").agg(F.count(F.lit(1)).alias("in_sheet")), "region")


def snk_10(s, d):
    """Hubs as CSV and as GeoPackage, read back side by side."""
    folder = scratch(s)
    reports.csv_and_package(view(s, d, "hubs").select("site_id", "x", "y"), "site_id", folder)
    a = s.read.option("header", True).csv(f"{folder}/points.csv").select("site_id", F.col("x").cast("double").alias("x"))
    b = files.read_table(s, f"{folder}/points.gpkg").select(F.col("data")["site_id"].alias("site_id"), F.col("line")[0]["y"].alias("y"))
    return a.join(b, "site_id")


def snk_11(s, d):
    """A GeoPackage layer for each region of hubs, read back."""
    folder = scratch(s)
    rows = view(s, d, "hubs").select("site_id", "region", "x", "y").toPandas()
    tables = {r: [({"site_id": i}, "point", [(x, y)]) for i, x, y in part[["site_id", "x", "y"]].itertuples(index=False)] for r, part in rows.groupby("region")}
    files.write_bytes(s, f"{folder}/hubs.gpkg", vector.package(tables))
    back = files.read_table(s, f"{folder}/hubs.gpkg")
    return back.select(F.col("layer").alias("region"), F.col("data")["site_id"].alias("site_id"), F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))


def snk_12(s, d):
    segs = rings.topology(_noted(s, d)).select("ring_name", "near_end", "far_end")
    r = rings.segment_report(segs, _noted(s, d)).select("ring_name", "near_end", "far_end", F.col("priority").alias("near_priority"), F.when(rings.is_hub(F.col("far_type")), "P0").otherwise("Insert Site").alias("far_priority"), F.when(F.col("remark") != "", 12.5).otherwise(0.0).alias("new_length"))
    return reports.insert_report(r)


def snk_13(s, d):
    segs = rings.segments(view(s, d, "site_rings"))
    paths = segs.select(F.concat_ws("-", "site_id_a", "site_id_b").alias("name"), F.col("site_id_a").alias("near_end"), F.col("site_id_b").alias("far_end"), "ring_name", F.lit("X").alias("region"), F.explode(F.array(F.struct(F.lit("Existing").alias("fo_note"), (F.floor(F.col("length")) * 0.25).alias("length")), F.struct(F.lit("New").alias("fo_note"), (F.floor(F.col("length")) * 0.75).alias("length")))).alias("x")).select("name", "near_end", "far_end", "ring_name", "region", "x.*")
    return reports.update_report(paths)


QUERIES = {
    "PRJ-01": prj_01, "PRJ-02": _checked("supervised"), "PRJ-03": _checked("unsupervised"), "PRJ-06": _checked("fwa"), "PRJ-07": _checked("topology"), "JN-04": jn_04, "PRJ-16": prj_16, "TWIN-insert-weights": twin_weights, "SRC-01": src_01, "SRC-06": src_06, "SRC-10": src_10, "SNK-06": snk_06,
    "PRJ-05": prj_05, "PRJ-08": prj_08, "PRJ-19": prj_19, "PRJ-20": prj_20, "CL-06": cl_06, "CL-10": cl_10, "GR-05": gr_05, "GR-09": gr_09, "GR-14": gr_14, "GR-18": gr_18, "GR-19": gr_19,
    "JN-09": jn_09, "JN-10": jn_10, "JN-21": jn_21, "GEO-02": geo_02, "GEO-01-box": geo_01_box, "GEO-01-hull": geo_01_hull, "GEO-13": geo_13, "GEO-15": geo_15, "GEO-16": geo_16, "GEO-26": geo_26,
    "FWA-09": fwa_09, "FWA-10": fwa_10, "FWA-11": fwa_11, "FWA-12": fwa_12, "BOQ-03": boq_03, "BOQ-05": boq_05,
    "SRC-07": src_07, "SRC-08": src_08, "SRC-09": src_09, "SRC-11": src_11, "SNK-04": snk_04, "SNK-05": snk_05, "SNK-07": snk_07, "SNK-08": snk_08, "SNK-10": snk_10, "SNK-11": snk_11, "SNK-12": snk_12, "SNK-13": snk_13,
}

_R, _S, _H = with_views("site_rings"), with_views("sites"), with_views("hubs")
_D2 = "(p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)"
_G = "g AS (SELECT ring_name, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS zy FROM site_rings WINDOW w AS (PARTITION BY ring_name ORDER BY seq)), e AS (SELECT * FROM g WHERE bx IS NOT NULL)"
#: What of a segment lies in a square, by its places along the segment.
_CLIP = """c AS (SELECT ring_name, polygon_id, sqrt((ax-bx)*(ax-bx)+(ay-zy)*(ay-zy)) AS len,
  greatest(0.0, CASE WHEN bx <> ax THEN least((minx-ax)/(bx-ax), (minx+6000-ax)/(bx-ax)) WHEN ax >= minx AND ax < minx+6000 THEN 0 ELSE 2 END, CASE WHEN zy <> ay THEN least((miny-ay)/(zy-ay), (miny+6000-ay)/(zy-ay)) WHEN ay >= miny AND ay < miny+6000 THEN 0 ELSE 2 END) AS t0,
  least(1.0, CASE WHEN bx <> ax THEN greatest((minx-ax)/(bx-ax), (minx+6000-ax)/(bx-ax)) ELSE 1 END, CASE WHEN zy <> ay THEN greatest((miny-ay)/(zy-ay), (miny+6000-ay)/(zy-ay)) ELSE 1 END) AS t1 FROM e, polygons),
 i AS (SELECT * FROM c WHERE t1 > t0)"""
_WALK = """h AS (SELECT ring_name, arg_min(site_id, seq) AS start FROM noted WHERE lower(site_type) LIKE '%hub%' GROUP BY 1),
 o AS (SELECT ring_name, near_end, far_end FROM topo WHERE far_end IS NOT NULL AND far_end <> near_end),
 w AS (SELECT ring_name, start AS site_id, 0 AS place, [start] AS path, false AS done, start FROM h
  UNION ALL SELECT w.ring_name, o.far_end, w.place + 1, list_append(w.path, o.far_end), lower(n.site_type) LIKE '%hub%', w.start FROM w JOIN o ON o.ring_name = w.ring_name AND o.near_end = w.site_id JOIN noted n ON n.site_id = o.far_end WHERE NOT w.done AND NOT list_contains(w.path, o.far_end)),
 z AS (SELECT ring_name, arg_max(site_id, place) AS last, max(place) AS places FROM w GROUP BY 1),
 f AS (SELECT z.ring_name, CASE WHEN places > 0 AND lower(n.site_type) LIKE '%hub%' THEN 'hub' WHEN o.far_end IS NULL THEN 'dead end' WHEN o.far_end = h.start THEN 'hub' ELSE 'loop' END AS ended FROM z JOIN h USING (ring_name) JOIN noted n ON n.site_id = z.last LEFT JOIN o ON o.near_end = z.last)"""
_RNOTED = "WITH RECURSIVE " + _R.removeprefix("WITH ") + _NOTED + ", " + _TOPO

_VALID = f"{_R} SELECT site_id, CASE WHEN seq = 2 THEN '' ELSE trim(site_name) END AS site_name, round(y / 1000, 6) AS lat, round(x / 1000, 6) AS long FROM site_rings WHERE seq NOT IN (3, 5)"
_ONE = "c AS (SELECT least(node_start, node_end) AS node_start, greatest(node_start, node_end) AS node_end, max(struct_pack(length := length, highway := highway)) AS r FROM road_edges GROUP BY 1, 2)"

ORACLE = {
    "PRJ-01": f"{_H} SELECT site_id, region FROM hubs", "PRJ-02": _VALID, "PRJ-03": _VALID, "PRJ-06": _VALID, "PRJ-07": _VALID,
    "JN-04": f"""{with_views("road_nodes", "fiber_lines")} SELECT DISTINCT p.node_id, f.name FROM road_nodes p JOIN fiber_lines f ON p.x BETWEEN f.ax - 1000 AND f.bx + 1000 AND p.y BETWEEN f.ay - 1000 AND f."by" + 1000
      WHERE (p.x - greatest(f.ax, least(f.bx, p.x))) * (p.x - greatest(f.ax, least(f.bx, p.x))) + (p.y - greatest(f.ay, least(f."by", p.y))) * (p.y - greatest(f.ay, least(f."by", p.y))) < 1000000""",
    "PRJ-16": f"{with_views('road_edges', 'road_nodes')}, {_ONE} SELECT c.node_start, c.node_end, r.length AS route, r.length * CASE WHEN a.ref_fo = 1 AND b.ref_fo = 1 THEN 10000.0::DOUBLE ELSE 35000.0::DOUBLE END AS fiber, r.length * CASE WHEN a.ref_fo = 1 AND b.ref_fo = 1 THEN 100.0::DOUBLE ELSE 35000.0::DOUBLE END AS full_fiber FROM c JOIN road_nodes a ON a.node_id = c.node_start JOIN road_nodes b ON b.node_id = c.node_end",
    "TWIN-insert-weights": f"""{with_views("road_edges", "road_nodes", "fiber_lines")}, {_ONE}, f AS (SELECT ax, ay FROM fiber_lines UNION SELECT bx, "by" FROM fiber_lines), q AS (SELECT node_id FROM road_nodes JOIN f ON x = ax AND y = ay) SELECT node_start, node_end, round(CASE WHEN node_start IN (SELECT * FROM q) AND node_end IN (SELECT * FROM q) THEN r.length / 3 ELSE r.length END, 6) AS weight FROM c""",
    "SRC-01": f"{_H} SELECT site_id, x, y, x AS gx, y AS gy FROM hubs", "SRC-06": f"{_H} SELECT site_id, region FROM hubs UNION ALL SELECT site_id, region FROM hubs", "SRC-10": f"{_S} SELECT site_id, region FROM sites",
    "SNK-06": f"{_S} SELECT 'odp' AS layer, count(*) AS rows FROM sites WHERE site_type = 'Rooftop' UNION ALL SELECT 'otb', count(*) FROM sites",
    "PRJ-05": f"""{with_views("sites", "folders")}, s AS ({_SEG.format('site_rings')}), v AS (SELECT site_id, split_part(folders, ';', -2) AS ring_name, trim(split_part(folders, ';', -3)) AS program, nullif(regexp_extract(folders, '([A-Z]{{3,6}})\\s*;', 1), '') AS region, CASE WHEN lower(split_part(folders, ';', -1)) LIKE '%hub%' THEN 'FO Hub' ELSE 'Site List' END AS what FROM folders)
      SELECT 'site' AS kind, site_id AS name, what, ring_name, program, region FROM v UNION ALL SELECT 'route', site_id_a, site_id_b, v.ring_name, program, region FROM s JOIN v ON v.site_id = site_id_a WHERE site_id_b IS NOT NULL AND sequence % 2 = 0""",
    "PRJ-08": f"{_S} SELECT site_id FROM sites",
    "PRJ-19": f"{_R}, s AS ({_SEG.format('site_rings')}) SELECT concat(site_id_a, ' - ', site_id_b) AS name, CASE sequence WHEN 0 THEN 'FO Hub' ELSE 'Site List' END AS site_type, site_id_a AS near_end, site_id_b AS far_end FROM s WHERE site_id_b IS NOT NULL AND sequence % 4 <> 1",
    "PRJ-20": f"""{_R}, p AS (SELECT *, CAST(substring(ring_name, 2, 6) AS INT) AS no FROM site_rings), h AS (SELECT * FROM p WHERE seq = 5), l AS (SELECT ring_name, max(seq) AS last FROM p GROUP BY 1)
      SELECT h.ring_name, h.site_id AS start_hub, CASE WHEN no % 3 = 1 OR no % 3 = 0 AND last = 5 THEN CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.ring_name = h.ring_name AND p.seq < 5) THEN 'far_end' ELSE 'near_end' END ELSE 'near_end' END AS start_column FROM h JOIN l USING (ring_name)""",
    "CL-06": f"{_S}, c AS (SELECT site_id, CAST(floor(x/2500)*100 + floor(y/2500) AS INT) AS cluster FROM sites WHERE site_type <> 'Existing Site'), k AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM c) SELECT site_id, cluster FROM k WHERE n >= 3",
    "CL-10": f"""{with_views("site_rings", "hubs")}, k AS (SELECT ring_name, p.site_id, q.site_id AS hub_id, {_D2} AS d2, row_number() OVER (PARTITION BY p.site_id ORDER BY {_D2}, q.site_id) AS n FROM site_rings p JOIN hubs q ON {_D2} <= 810000),
      b AS (SELECT ring_name, hub_id, min(d2) AS d2 FROM k WHERE n <= 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ring_name ORDER BY d2, hub_id) AS m FROM b), a AS (SELECT ring_name, 'assigned' AS outcome, hub_id, CASE m WHEN 1 THEN 'start' ELSE 'end' END AS flag FROM r WHERE m <= 2),
      m AS (SELECT ring_name, avg(x) AS mx, avg(y) AS my FROM (SELECT DISTINCT ring_name, x, y FROM site_rings) GROUP BY 1), c AS (SELECT ring_name, count(*) AS n, arg_min(site_id, struct_pack(d := (x-mx)*(x-mx)+(y-my)*(y-my), i := site_id)) AS hub_id FROM site_rings JOIN m USING (ring_name) WHERE ring_name NOT IN (SELECT ring_name FROM a) GROUP BY 1)
      SELECT * FROM a UNION ALL SELECT ring_name, CASE WHEN n < 2 THEN 'standalone' ELSE 'centroid' END, CASE WHEN n > 1 THEN hub_id END, CASE WHEN n > 1 THEN 'start' END FROM c""",
    "GR-09": f"{_RNOTED}, {_WALK} SELECT w.ring_name, CAST(place AS INT) AS place, site_id, ended FROM w JOIN f ON f.ring_name = w.ring_name",
    "GR-19": f"{_RNOTED}, {_WALK} SELECT w.ring_name, w.site_id, n.site_type, CAST(place AS INT) AS place FROM w JOIN noted n ON n.site_id = w.site_id",
    "JN-09": f"{with_views('site_rings', 'polygons')}, {_G}, {_CLIP} SELECT * FROM (SELECT ring_name, polygon_id, round(sum(len*(t1-t0)), 3) AS length FROM i GROUP BY 1, 2) WHERE length > 0",
    "JN-10": f"{with_views('site_rings', 'polygons')}, {_G}, {_CLIP}, u AS (SELECT ring_name, sum(len*(t1-t0)) AS inside FROM i GROUP BY 1), a AS (SELECT ring_name, sum(sqrt((ax-bx)*(ax-bx)+(ay-zy)*(ay-zy))) AS whole FROM e GROUP BY 1) SELECT * FROM (SELECT ring_name, round(whole - coalesce(inside, 0), 3) AS length FROM a LEFT JOIN u USING (ring_name)) WHERE length > 0",
    "JN-21": f"""{with_views("sites", "fiber_lines")}, n AS (SELECT p.site_id, p.x, p.y, f.ax, f.ay, f.bx AS zx, f."by" AS zy, greatest(0.0, least(1.0, ((p.x-f.ax)*(f.bx-f.ax)+(p.y-f.ay)*(f."by"-f.ay))/((f.bx-f.ax)*(f.bx-f.ax)+(f."by"-f.ay)*(f."by"-f.ay)))) AS t FROM sites p JOIN fiber_lines f ON p.x BETWEEN f.ax - 2000 AND f.bx + 2000 AND p.y BETWEEN f.ay - 2000 AND f."by" + 2000),
      k AS (SELECT DISTINCT site_id FROM n WHERE (x-(ax+t*(zx-ax)))*(x-(ax+t*(zx-ax)))+(y-(ay+t*(zy-ay)))*(y-(ay+t*(zy-ay))) <= 4000000) SELECT site_id, CASE WHEN site_id IN (SELECT site_id FROM k) THEN 'fiber zone' ELSE 'no fiber' END AS zone FROM sites""",
    "GEO-01-box": f"""{_H}, b AS (SELECT min(x) - 2500 AS x0, max(x) + 2500 AS x1, min(y) - 2500 AS y0, max(y) + 2500 AS y1 FROM hubs WHERE region = 'ASIA'), i AS (SELECT unnest(range(CAST(floor(x0/5000) AS BIGINT), CAST(floor(x1/5000) AS BIGINT) + 1)) AS i FROM b), j AS (SELECT unnest(range(CAST(floor(y0/5000) AS BIGINT), CAST(floor(y1/5000) AS BIGINT) + 1)) AS j FROM b) SELECT concat(CAST(i AS VARCHAR), '_', CAST(j AS VARCHAR)) AS cell FROM i, j""",
    "GEO-02": f"{_S} SELECT DISTINCT concat(CAST(CAST(floor(x/10000) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(y/10000) AS BIGINT) AS VARCHAR)) AS cell FROM sites WHERE region = 'ASIA'",
    "GEO-13": f"""{with_views("site_rings", "road_nodes")}, s AS ({_SEG.format('site_rings')}), k AS (SELECT site_id, p.x, p.y, q.x AS nx, q.y AS ny, row_number() OVER (PARTITION BY site_id ORDER BY {_D2}, node_id) AS n FROM sites p, road_nodes q), m AS (SELECT * FROM k WHERE n = 1)
      SELECT ring_name, site_id_a, round(sqrt((a.x-a.nx)*(a.x-a.nx)+(a.y-a.ny)*(a.y-a.ny)) + sqrt((a.nx-b.nx)*(a.nx-b.nx)+(a.ny-b.ny)*(a.ny-b.ny)) + sqrt((b.x-b.nx)*(b.x-b.nx)+(b.y-b.ny)*(b.y-b.ny)), 4) AS length FROM s JOIN m a ON a.site_id = site_id_a JOIN m b ON b.site_id = site_id_b""",
    "GEO-16": f"{_R} SELECT ring_name, CAST(row_number() OVER (PARTITION BY ring_name ORDER BY seq) - 1 AS INT) AS vertex, x, CASE WHEN abs(y - 20000) <= 800 THEN 20000.0 ELSE y END AS y FROM site_rings",
    "FWA-11": f"""{with_views("sites", "buildings")}, {PAIRS}, f AS (SELECT site_id, CAST(floor((degrees(atan2(hx - x, hy - y)) + 360.0) % 360.0) AS INT) AS fan FROM pairs), bins AS (SELECT site_id, fan, count(*) AS n FROM f GROUP BY ALL),
      t AS (SELECT site_id, rotation, n, CAST(floor(((fan - rotation + 360) % 360) / 120.0) AS INT) + 1 AS sector FROM bins, (SELECT unnest(range(0, 120)) AS rotation)), z AS (SELECT site_id, CAST(rotation AS INT) AS rotation, sector, CAST(sum(n) AS BIGINT) AS total_homepass FROM t GROUP BY ALL),
      k AS (SELECT site_id, rotation, count(*) * 1000 - max(total_homepass - 5) AS v FROM z WHERE total_homepass >= 5 GROUP BY ALL), best AS (SELECT site_id, rotation FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY v DESC, rotation) AS r FROM k) WHERE r = 1)
      SELECT site_id, rotation, sector, total_homepass, total_homepass >= 5 AS valid FROM z JOIN best USING (site_id, rotation)""",
    "SRC-07": f"{with_views('road_edges')} SELECT node_start, node_end, length FROM road_edges WHERE node_start % 40 < 20",
    "SRC-08": f"{with_views('buildings')} SELECT building_id, area_in_meters FROM buildings WHERE floor(x/10000) = 2 AND asp_ratio > 0.25 AND area_in_meters > 25 AND area_in_meters < 500",
    "SRC-09": f"{_H} SELECT site_id, region AS province FROM hubs",
    "SRC-11": f"{_S} SELECT site_id, region FROM sites",
    "SNK-04": f"""{_R}{_NOTED}, g AS (SELECT ring_name, min(region) AS region, count(*) AS n FROM site_rings GROUP BY 1 HAVING count(*) > 1)
      SELECT concat(region, ';', ring_name, ';', CASE WHEN lower(site_type) LIKE '%hub%' THEN 'FO Hub' ELSE 'Site List' END) AS folders, site_id AS name, 'point' AS kind, 1 AS places FROM noted
      UNION ALL SELECT concat(region, ';', ring_name, ';Topology'), concat('T', ring_name), 'line', CAST(n AS INT) FROM g UNION ALL SELECT concat(region, ';', ring_name, ';Route'), concat('P', ring_name), 'line', CAST(n AS INT) FROM g""",
    "SNK-05": f"""{_R}{_NOTED}, g AS (SELECT ring_name, min(region) AS region FROM site_rings GROUP BY 1 HAVING count(*) > 1), k AS (SELECT *, CASE WHEN lower(site_type) LIKE '%hub%' THEN 'FO Hub' WHEN note = 'insert' THEN 'Insert Site' ELSE 'Existing Site' END AS f FROM noted)
      SELECT concat(region, ';', ring_name, ';', f) AS folders, site_id AS name, 'point' AS kind, CASE f WHEN 'FO Hub' THEN '#0000ff' WHEN 'Insert Site' THEN '#ffff00' ELSE '#00aa00' END AS color FROM k UNION ALL SELECT concat(region, ';', ring_name, ';Route'), ring_name, 'line', '#ff0000' FROM g""",
    "SNK-07": f"{_R}, s AS ({_SEG.format('site_rings')}) SELECT concat(ring_name, ';01 otb') AS folders, concat('OTB ', site_id_a) AS name, CAST(CASE WHEN site_id_b IS NULL THEN 2147483647 ELSE sequence END AS INT) AS place FROM s",
    "SNK-08": f"{_H} SELECT region, count(*) AS sites, count(*) AS in_table, count(*) AS in_sheet FROM hubs GROUP BY 1",
    "SNK-10": f"{_H} SELECT site_id, x, y FROM hubs",
    "SNK-11": f"{_H} SELECT region, site_id, x, y FROM hubs",
    "SNK-12": f"""{_R}{_NOTED}, {_TOPO}, j AS (SELECT o.ring_name, near_end, far_end, CASE WHEN a.note = 'existing' AND lower(b.site_type) LIKE '%hub%' THEN 'P0' WHEN a.note = 'existing' THEN 'Access' WHEN a.note = 'insert' AND NOT lower(b.site_type) LIKE '%hub%' THEN 'Insert Site' ELSE 'Access' END AS near_priority,
      CASE WHEN lower(b.site_type) LIKE '%hub%' THEN 'P0' ELSE 'Insert Site' END AS far_priority, CASE WHEN a.note = 'insert' OR b.note = 'insert' THEN 12.5 ELSE 0.0 END::DOUBLE AS new_length FROM topo o JOIN noted a ON a.site_id = near_end JOIN noted b ON b.site_id = far_end WHERE far_end IS NOT NULL AND far_end <> near_end)
      SELECT *, near_priority = 'P0' AS fill_near_p0, far_priority = 'P0' AS fill_far_p0, near_priority = 'Insert Site' AS fill_near_insert, far_priority = 'Insert Site' AS fill_far_insert, new_length > 0 AS fill_new_cable FROM j""",
    "SNK-13": f"{_R}, s AS ({_SEG.format('site_rings')}) SELECT concat(site_id_a, '-', site_id_b) AS name, site_id_a AS near_end, site_id_b AS far_end, ring_name, floor(length) * 0.25::DOUBLE AS existing, floor(length) * 0.75::DOUBLE AS new, floor(length) * 0.25::DOUBLE + floor(length) * 0.75::DOUBLE AS total_length, 'X' AS region FROM s WHERE site_id_b IS NOT NULL",
}
