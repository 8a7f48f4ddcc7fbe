"""KML and KMZ: reading placemarks into rows, and writing rows as placemarks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberloom.runtime import durable, few

PLACEMARK = "file string, name string, folders string, kind string, data map<string,string>, line array<struct<x:double,y:double>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _coordinates(text: str | None) -> list[dict]:
    """Longitude and latitude of a coordinate list; heights are left out."""
    out = []
    for triple in (text or "").split():
        parts = triple.split(",")
        if len(parts) >= 2:
            out.append({"x": float(parts[0]), "y": float(parts[1])})
    return out


def placemarks(content: bytes) -> Iterator[tuple]:
    """``name, folders, kind, data, line`` of every placemark within a folder; kinds are point, line and polygon (outer ring)."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    root = ElementTree.fromstring(content)
    stack = [(root, None)]
    while stack:
        node, path = stack.pop()
        for child in reversed(list(node)):
            tag = _local(child.tag)
            if tag in ("Document", "kml"):
                stack.append((child, path))
            elif tag == "Folder":
                label = next((c.text or "" for c in child if _local(c.tag) == "name"), "")
                stack.append((child, label if path is None else f"{path};{label}"))
        if path is None:
            continue
        for mark in node:
            if _local(mark.tag) != "Placemark":
                continue
            name = next((c.text for c in mark if _local(c.tag) == "name"), None)
            data = {}
            for e in mark.iter():
                if _local(e.tag) == "Data":
                    data[e.get("name")] = next((v.text or "" for v in e if _local(v.tag) == "value"), "")
                elif _local(e.tag) == "SimpleData":
                    data[e.get("name")] = e.text or ""
            for e in mark.iter():
                kind = {"Point": "point", "LineString": "line", "Polygon": "polygon"}.get(_local(e.tag))
                if kind:
                    text = next((c.text for c in e.iter() if _local(c.tag) == "coordinates"), None)
                    yield name, path, kind, data, _coordinates(text)


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``PLACEMARK`` from a table of ``path`` and ``content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PLACEMARK.replace("map<string,string>", "m").replace("array<struct<x:double,y:double>>", "l").split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in placemarks(bytes(content))], columns=names)

    return files.select("path", "content").mapInPandas(run, PLACEMARK)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").load(path))


def kml_color(color: str, alpha: str = "ff") -> str:
    """``#RRGGBB`` as KML's alpha, blue, green, red."""
    c = color.lstrip("#").lower()
    return f"{alpha}{c[4:6]}{c[2:4]}{c[0:2]}"


def pieces(rows: Iterator[tuple], color: str = "#ff0000") -> Iterator[str]:
    """A document piece by piece, from rows ``folders, name, kind, line, data`` sorted by folders; nested folders come from ``;``.

    A row whose data has a ``color`` is drawn in it, the others in the layer's.
    """
    yield '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    yield f'<Style id="s"><LineStyle><color>{kml_color(color)}</color><width>3</width></LineStyle><IconStyle><color>{kml_color(color)}</color></IconStyle></Style>'
    open_: list[str] = []
    for folders, name, kind, line, data in rows:
        path = folders.split(";")
        same = 0
        while same < min(len(path), len(open_)) and path[same] == open_[same]:
            same += 1
        yield "</Folder>" * (len(open_) - same) + "".join(f"<Folder><name>{escape(p)}</name>" for p in path[same:])
        open_ = path
        at = " ".join(f"{p['x']!r},{p['y']!r},0" for p in line)
        shape = {"point": "<Point><coordinates>{}</coordinates></Point>", "line": "<LineString><coordinates>{}</coordinates></LineString>"}.get(kind, "<Polygon><outerBoundaryIs><LinearRing><coordinates>{}</coordinates></LinearRing></outerBoundaryIs></Polygon>").format(at)
        extra = "".join(f'<Data name="{escape(k)}"><value>{escape(str(v))}</value></Data>' for k, v in (data or {}).items())
        own = (data or {}).get("color")
        style = f"<Style><LineStyle><color>{kml_color(own)}</color><width>3</width></LineStyle><IconStyle><color>{kml_color(own)}</color></IconStyle></Style>" if own else "<styleUrl>#s</styleUrl>"
        yield f'<Placemark><name>{escape(name or "")}</name>{style}<ExtendedData>{extra}</ExtendedData>{shape}</Placemark>'
    yield "</Folder>" * len(open_) + "</Document></kml>"


def document(rows: Iterator[tuple], color: str = "#ff0000") -> str:
    """One document as a text."""
    return "".join(pieces(rows, color))


#: Placemarks of one document, about; a group with more gets several.
PART = 10_000


def documents(rows: DataFrame, group: str) -> DataFrame:
    """KML texts of each value of ``group`` (a region, say), built where their rows are.

    ``rows`` has ``folders, name, kind, line, data`` besides. A group of more than ``PART`` rows falls
    into several documents of about that many, a folder within one of them unless it is as large
    itself; so no task holds a group whole.
    """

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["folders", "name"])
        return pd.DataFrame([(str(key[0]), document(part[["folders", "name", "kind", "line", "data"]].itertuples(index=False)).encode())], columns=["path", "content"])

    g, dealt = F.col(f"`{group}`"), lambda *by: F.pmod(F.xxhash64(*by), F.col("__n"))
    held = durable(rows.groupBy(g.alias("__g"), F.col("folders").alias("__f")).agg(F.count(F.lit(1)).alias("__rows")))
    sizes = held.groupBy("__g").agg(F.ceil(F.sum("__rows") / PART).alias("__n"))
    large = held.where(F.col("__rows") > PART).select(F.col("__g").alias("__h"), "__f", F.lit(True).alias("__large"))
    rows = rows.join(few(durable(sizes)), g.eqNullSafe(F.col("__g")))
    rows = rows.join(few(durable(large)), g.eqNullSafe(F.col("__h")) & F.col("folders").eqNullSafe(F.col("__f")), "left")
    part = F.when(F.col("__large"), dealt("folders", "name", "kind", "line")).otherwise(dealt("folders"))
    rows = rows.withColumn("__part", part).select(*[F.col(f"`{c}`") for c in dict.fromkeys((group, "folders", "name", "kind", "line", "data"))], "__part")
    total = held.agg(F.sum("__rows")).first()[0] or 0
    # Few documents a partition, as what reads them takes a partition's documents at a time.
    rows = rows.repartition(-(-total // (2 * PART)) or 1, g, F.col("__part"))
    return rows.groupBy(g, F.col("__part")).applyInPandas(run, "path string, content binary")


def write_kmz(rows: DataFrame, path: str, color: str = "#ff0000") -> None:
    """One KMZ of a layer, streamed through the driver in order of folders; no more than a partition is held."""
    ordered = rows.select("folders", "name", "kind", "line", F.coalesce("data", F.create_map().cast("map<string,string>"))).orderBy("folders", "name")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("doc.kml", "w", force_zip64=True) as f:
        for piece in pieces((tuple(r) for r in ordered.toLocalIterator()), color):
            f.write(piece.encode())
