"""Readers by format, partitioned road and building data sets, and writers of the result layers."""

from __future__ import annotations

import math
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.functions import geo, kernel
from fiberloom.operators.spatial import hulls
from fiberloom.operators.tables import clean_names, first_per
from fiberloom.sources import kml, vector, xlsx

LON, LAT = ("longitude", "long", "lon", "lng"), ("latitude", "lat")


def match_column(names: list[str], wanted: tuple[str, ...], threshold: float) -> str:
    """The name most like one of the wanted ones; ``ValueError`` below the threshold."""
    score, at = max((kernel.jaro_winkler(n.lower(), w), -i) for i, n in enumerate(names) for w in wanted)
    if score < threshold:
        raise ValueError(f"none of {names} looks like {wanted}")
    return names[-at]


def with_places(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Add metres ``x, y`` from the columns that look like longitude and latitude."""
    lon, lat = (F.expr(f"try_cast(`{match_column(df.columns, w, threshold)}` AS double)") for w in (LON, LAT))
    x, y = geo.mercator(lon, lat)
    return df.withColumn("x", x).withColumn("y", y)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A table by its extension: parquet, csv, xlsx (first sheet unless named), geojson, kml, kmz, gpkg or shp."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        df = spark.read.option("header", True).csv(path)
        return with_places(df.toDF(*clean_names(df.columns)))
    if kind == "xlsx":
        first = sheet or xlsx.read_cells(spark, path).select("sheet").first()["sheet"]
        df = xlsx.read_sheet(spark, path, first)
        return with_places(df.toDF(*clean_names(df.columns)), 0.6)
    if kind in ("geojson", "json"):
        f = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
        return f.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.to_json("f.geometry.coordinates").alias("coordinates"))
    if kind in ("kml", "kmz"):
        return kml.read_kml(spark, path)
    if kind == "gpkg":
        return vector.read_gpkg(spark, path)
    if kind == "shp":
        return vector.read_shp(spark, f"{path[:-3]}{{shp,dbf}}")
    raise ValueError(f"unsupported file: {path}")


def read_upload(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A table that a user sends in: workbook or CSV only, without places; ``ValueError`` for any other file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "xlsx":
        return xlsx.read_sheet(spark, path, sheet or xlsx.read_cells(spark, path).select("sheet").first()["sheet"])
    raise ValueError(f"only xlsx and csv can be sent in, not {path}")


def read_sheets(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Sheets of a workbook by name; ``ValueError`` that lists the missing ones."""
    there = {r["sheet"] for r in xlsx.read_cells(spark, path).select("sheet").distinct().collect()}
    missing = [n for n in names if n not in there]
    if missing:
        raise ValueError(f"missing sheets {missing} in {path}")
    return {n: xlsx.read_sheet(spark, path, n) for n in names}


def cells_of(points: DataFrame, size: float = 10_000.0, buffer: float = 10_000.0) -> DataFrame:
    """Distinct grid cells (``cell``) that the points' surroundings touch; ``ValueError`` where there are no points."""
    if points.isEmpty():
        raise ValueError("no points to find cells for")
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - buffer) / size), F.floor((F.col(c) + buffer) / size)))
    return points.select(span("x").alias("i"), F.col("y")).select("i", span("y").alias("j")).select(F.concat_ws("_", "i", "j").alias("cell")).distinct()


def cells_over(points: DataFrame, kind: str = "box", size: float = 10_000.0, buffer: float = 10_000.0) -> DataFrame:
    """Distinct grid cells (``cell``) that the points' bounding box, or their convex hull, touches when it is grown by the buffer.

    Only the box or the corners of the hull reach the driver; ``ValueError`` where there are no points.
    """
    spark, name = points.sparkSession, F.concat_ws("_", "i", "j").alias("cell")
    box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        raise ValueError("no points to find cells for")
    at = lambda v: math.floor(v / size)
    columns = spark.range(at(box[0] - buffer), at(box[2] + buffer) + 1).withColumnRenamed("id", "i")
    every = columns.withColumn("j", F.explode(F.sequence(F.lit(at(box[1] - buffer)), F.lit(at(box[3] + buffer)))))
    if kind == "box":
        return every.select(name)
    if kind != "hull":
        raise ValueError("kind must be box or hull")
    ring = [(r["x"], r["y"]) for r in hulls(points.select(F.lit(0).alias("k"), "x", "y"), "k").orderBy("vertex").collect()]

    @F.pandas_udf("boolean")
    def touches(i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([kernel.convex_distance(ring, [(a * size, b * size), (a * size + size, b * size), (a * size + size, b * size + size), (a * size, b * size + size)]) <= buffer for a, b in zip(i, j, strict=True)])

    return every.where(touches("i", "j")).select(name)


def cells_of_island(cells: DataFrame, island: str) -> DataFrame:
    """Distinct cells of an island, from a table of ``cell`` and ``Island``."""
    return cells.where(F.col("Island") == island).select("cell").distinct()


def in_cells(data: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of a data set partitioned by ``cell``; the list prunes its partitions at run time."""
    return data.join(cells, "cell", "left_semi")


def roads(data: DataFrame, cells: DataFrame) -> DataFrame:
    """Roads of the cells, ids prefixed with their island, one row for each geometry."""
    rows = in_cells(data, cells).withColumns({c: F.concat_ws("_", "Island", c) for c in ("node_start", "node_end") if c in data.columns} | ({"node_id": F.concat_ws("_", "Island", "node_id")} if "node_id" in data.columns else {}))
    return first_per(rows, ["geometry"], ["cell"])


def compiled(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Union of the part tables ``prefix*`` of a folder; nothing is deleted."""
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/{prefix}*")


def write_layers(layers: dict[str, DataFrame], folder: str) -> list[str]:
    """Each layer that has rows, as parquet under its name."""
    done = []
    for name, df in layers.items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            done.append(name)
    return done


def write_degrees(points: DataFrame, path: str) -> None:
    """Points as parquet with longitude and latitude in place of metres."""
    lon, lat = geo.degrees_of(F.col("x"), F.col("y"))
    points.withColumn("long", lon).withColumn("lat", lat).drop("x", "y").write.mode("overwrite").parquet(path)


def zipped(folder: str, target: str) -> str:
    """A zip of an export folder on the driver."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file() and p.resolve() != Path(target).resolve():
                z.write(p, p.relative_to(folder))
    return target


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file through the file system that Spark uses for the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_part(spark: SparkSession, path: str, **values) -> DataFrame:
    """Rows of a data set whose partition columns have the given values; other partitions are not read."""
    rows = spark.read.parquet(path)
    for column, value in values.items():
        rows = rows.where(F.col(column) == value)
    return rows


def city_buildings(spark: SparkSession, path: str, city: str, **limits) -> DataFrame:
    """Usable buildings of a city, those without a place left out."""
    from fiberloom.operators.fwa import usable_buildings

    return usable_buildings(read_part(spark, path, city=city).where("x is not null and y is not null"), **limits)


def lookup(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their first name that is there; the others keep theirs."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def workbooks(spark: SparkSession, pattern: str, names: dict[str, str], sheet: str | None = None) -> DataFrame:
    """First (or named) sheet of all workbooks of a pattern as one table; a column that one lacks is null there.

    Workbooks are grouped by their header, so there is a read for each different header, not for each file.
    """
    cells = xlsx.read_cells(spark, pattern)
    first = cells.where(F.col("sheet") == sheet) if sheet else cells.withColumn("__f", F.min("sheet").over(Window.partitionBy("file"))).where("sheet = __f").drop("__f")
    heads = first.where("row = 0").select("file", F.col("cells").alias("head"))
    body = first.where("row > 0").join(heads, "file")
    # Cells by the name of their column, whatever its place.
    named = body.select("file", F.map_from_entries(F.transform(F.map_entries("cells"), lambda c: F.struct(F.coalesce(F.get(F.map_values(F.map_filter("head", lambda k, _: k == c["key"])), F.lit(0)), c["key"].cast("string")).alias("k"), c["value"].alias("v")))).alias("m"))
    columns = [r[0] for r in heads.select(F.explode(F.map_values("head")).alias("c")).distinct().orderBy("c").collect()]
    wide = named.select(*[F.col("m")[c].alias(c) for c in columns])
    return renamed(wide, names)


def routing_template(spark: SparkSession, path: str, sheets: tuple[str, str] = ("Origin", "Destination")) -> tuple[DataFrame, DataFrame]:
    """Two sheets of places of a routing request; ``ValueError`` where one or its coordinates are missing."""
    return tuple(with_places(renamed(xlsx.read_sheet(spark, path, s), {}), 0.6) for s in sheets)
