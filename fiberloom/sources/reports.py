"""Result layouts: drawn layers by ring, report tables with their style flags, and export folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.operators.rings import is_hub
from fiberloom.sources import files, kml, vector, xlsx

#: Colours of drawn layers (fixed values).
COLORS = {"existing": "#00aa00", "insert": "#ffff00", "hub": "#0000ff", "route": "#ff0000"}
#: Layers of a bill of quantity in the order they are drawn.
BILL = ("odp", "otb", "closure", "backbone", "access_ne", "access_fe", "fo_exist", "pole_exist", "obstacle_railway", "obstacle_toll")


def _row(folders, name, kind: str, line, **data) -> list:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return [folders.alias("folders"), name.alias("name"), F.lit(kind).alias("kind"), line.alias("line"), held.alias("data")]


def _place(x: str = "x", y: str = "y"):
    return F.array(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))


def ring_layers(points: DataFrame, routes: DataFrame, topology: DataFrame) -> DataFrame:
    """Placemarks of a ring design under ``region;ring`` and then Topology, Route, Site List or FO Hub.

    ``points`` has ``region, ring_name, site_id, site_name, site_type, x, y``; ``routes`` and
    ``topology`` ``region, ring_name, name, line``.
    """
    folder = lambda last: F.concat_ws(";", "region", "ring_name", last)
    kind = F.when(is_hub(F.col("site_type")), "FO Hub").otherwise("Site List")
    sites = points.select("region", *_row(folder(kind), F.col("site_id"), "point", _place(), site_name=F.col("site_name"), site_type=F.col("site_type")))
    lines = lambda rows, last: rows.select("region", *_row(folder(F.lit(last)), F.col("name"), "line", F.col("line")))
    return lines(topology, "Topology").unionByName(lines(routes, "Route")).unionByName(sites)


def insert_layers(points: DataFrame, routes: DataFrame) -> DataFrame:
    """Placemarks of a ring after insertion: existing sites, inserted ones and hubs in folders and colours of their own."""
    note = F.when(is_hub(F.col("site_type")), "FO Hub").when(F.lower("note").contains("insert"), "Insert Site").otherwise("Existing Site")
    color = F.when(note == "FO Hub", COLORS["hub"]).when(note == "Insert Site", COLORS["insert"]).otherwise(COLORS["existing"])
    folder = lambda last: F.concat_ws(";", "region", "ring_name", last)
    sites = points.select("region", *_row(folder(note), F.col("site_id"), "point", _place(), color=color))
    lines = routes.select("region", *_row(folder(F.lit("Route")), F.col("name"), "line", F.col("line"), color=F.lit(COLORS["route"])))
    return sites.unionByName(lines)


def bill_layers(layers: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of a compiled bill with ``folders`` by ring and layer, numbered by the ring's connection order.

    ``order`` has ``ring_name, name, place``; what it does not list comes last.
    """
    rows = layers.join(order, ["ring_name", "name"], "left")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ((n, i) for i, n in enumerate(BILL)) for x in kv]), F.col("layer"))
    return rows.withColumn("folders", F.concat_ws(";", "ring_name", F.concat_ws(" ", F.lpad(rank.cast("string"), 2, "0"), "layer"))).withColumn("place", F.coalesce("place", F.lit(2**31 - 1)))


def insert_report(segments: DataFrame) -> DataFrame:
    """Segment report of an insertion with its cell fills as flags: P0 ends, insert sites, new cable.

    ``segments`` has ``ring_name, near_end, far_end, near_priority, far_priority, new_length`` and other columns.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    return segments.withColumns({
        "fill_near_p0": flag(F.col("near_priority") == "P0"),
        "fill_far_p0": flag(F.col("far_priority") == "P0"),
        "fill_near_insert": flag(F.lower("near_priority") == "insert site"),
        "fill_far_insert": flag(F.lower("far_priority") == "insert site"),
        "fill_new_cable": F.coalesce("new_length", F.lit(0.0)) > 0,
    })


def update_report(paths: DataFrame, route_type: str = "classified") -> DataFrame:
    """Route lengths of an update by note, one row for each segment, with the ring's region.

    ``paths`` has ``name, near_end, far_end, ring_name, region, fo_note, length``. ``merged`` has one
    length, ``classified`` existing, new and total.
    """
    if route_type not in ("merged", "classified"):
        raise ValueError("route_type must be merged or classified")
    keys = ["name", "near_end", "far_end", "ring_name"]
    region = paths.select("ring_name", "region").distinct()
    if route_type == "merged":
        out = paths.where("fo_note = 'merged'").groupBy(*keys).agg(F.sum("length").alias("length"))
    else:
        out = paths.groupBy(*keys).pivot("fo_note", ["Existing", "New"]).agg(F.sum("length")).fillna(0.0, ["Existing", "New"])
        out = out.select(*keys, F.col("Existing").alias("existing"), F.col("New").alias("new"), (F.col("Existing") + F.col("New")).alias("total_length"))
    return out.join(region, "ring_name", "left")


def export(tables: dict[str, DataFrame], sheets: dict[str, DataFrame], folder: str, bound: int = 100_000) -> list[str]:
    """Tables as parquet under their names, and the sheets as one workbook; what was written.

    A sheet goes through the driver; one beyond ``bound`` rows (a workbook holds a million) is written as CSV part files instead.
    """
    done = files.write_layers(tables, folder)
    small = {}
    for name, rows in sheets.items():
        if rows.limit(bound + 1).count() > bound:
            rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
            done.append(f"{name}.csv")
        else:
            small[name] = rows.toPandas()
    if small:
        files.write_bytes(next(iter(sheets.values())).sparkSession, f"{folder}/report.xlsx", xlsx.workbook(small))
        done.append("report.xlsx")
    return done


def csv_and_package(rows: DataFrame, key: str, folder: str, bound: int = 1_000_000) -> list[str]:
    """Points as CSV part files and as one GeoPackage layer, which goes through the driver and holds ``bound`` rows at most; what was written."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/points.csv")
    if rows.limit(bound + 1).count() > bound:
        return ["points.csv"]
    features = [({key: r[key]}, "point", [(r["x"], r["y"])]) for r in rows.select(key, "x", "y").toLocalIterator()]
    files.write_bytes(rows.sparkSession, f"{folder}/points.gpkg", vector.package({"points": features}))
    return ["points.csv", "points.gpkg"]


def draw(rows: DataFrame, group: str) -> DataFrame:
    """KML documents of each value of ``group``, built where their rows are; large groups fall into several."""
    return kml.documents(rows, group)
