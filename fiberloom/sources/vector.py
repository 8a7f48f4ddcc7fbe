"""Shapefiles and GeoPackages: features as rows of properties and a line, read where Spark reads the bytes."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "file string, layer string, id long, kind string, data map<string,string>, line array<struct<x:double,y:double>>"
#: Shape types by their code, flat, with heights and with measures (fixed by the format).
SHAPES = {1: "point", 11: "point", 21: "point", 3: "line", 13: "line", 23: "line", 5: "polygon", 15: "polygon", 25: "polygon", 8: "multipoint", 18: "multipoint", 28: "multipoint"}


def shapes(content: bytes) -> Iterator[tuple[int, str, list[tuple[float, float]]]]:
    """``number, kind, points`` of each part of a shapefile's records, numbered from 0; null shapes are passed over."""
    at, number = 100, 0
    while at + 8 <= len(content):
        size = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        kind = SHAPES.get(struct.unpack("<i", body[:4])[0]) if len(body) >= 4 else None
        if kind == "point":
            yield number, kind, [struct.unpack("<2d", body[4:20])]
        elif kind == "multipoint":
            n = struct.unpack("<i", body[36:40])[0]
            for i in range(n):
                yield number, "point", [struct.unpack("<2d", body[40 + 16 * i : 56 + 16 * i])]
        elif kind:
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            base = 44 + 4 * parts
            for a, b in zip(starts, starts[1:], strict=False):
                yield number, kind, [struct.unpack("<2d", body[base + 16 * i : base + 16 * i + 16]) for i in range(a, b)]
        number += 1


def table(content: bytes) -> list[dict[str, str]]:
    """Rows of a dBASE file as text; deleted ones keep their number with no values."""
    rows, header, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), content[at + 16]))
        at += 32
    out = []
    for i in range(rows):
        row, pos = content[header + i * width : header + (i + 1) * width], 1
        values = {}
        for name, size in fields:
            text = row[pos : pos + size].decode("utf-8", "replace").strip()
            pos += size
            if text and row[:1] != b"*":
                values[name] = text
        out.append(values)
    return out


def geometry(blob: bytes) -> Iterator[tuple[str, list[tuple[float, float]]]]:
    """``kind, points`` of each part of a GeoPackage's or plain well-known binary; of polygons the outer ring."""
    if blob[:2] == b"GP":
        blob = blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]

    def read(at: int) -> Iterator:
        order = "<" if blob[at] else ">"
        code = struct.unpack(order + "I", blob[at + 1 : at + 5])[0]
        kind, dims = code % 1000 & 0xFF, 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3) + bool(code & 0x80000000) + bool(code & 0x40000000)
        at += 5 + 4 * bool(code & 0x20000000)
        size = 8 * dims

        def run(at: int) -> tuple[list, int]:
            n = struct.unpack(order + "I", blob[at : at + 4])[0]
            return [struct.unpack(order + "2d", blob[at + 4 + i * size : at + 20 + i * size]) for i in range(n)], at + 4 + n * size

        if kind == 1:
            yield "point", [struct.unpack(order + "2d", blob[at : at + 16])]
            return at + size
        if kind == 2:
            points, at = run(at)
            yield "line", points
            return at
        n = struct.unpack(order + "I", blob[at : at + 4])[0]
        at += 4
        if kind == 3:
            for i in range(n):
                points, at = run(at)
                if not i:
                    yield "polygon", points
            return at
        for _ in range(n):
            at = yield from read(at)
        return at

    yield from read(0)


def layers(content: bytes) -> Iterator[tuple[str, int, str, dict, list]]:
    """``layer, id, kind, data, points`` of the features of a GeoPackage."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        quote = lambda n: '"' + n.replace('"', '""') + '"'
        for layer, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
            cursor = db.execute(f"SELECT rowid, * FROM {quote(layer)}")
            names = [c[0] for c in cursor.description]
            for row in cursor:
                held = dict(zip(names[1:], row[1:], strict=True))
                blob = held.pop(column, None)
                data = {k: str(v) for k, v in held.items() if v is not None}
                for kind, points in geometry(blob) if blob else ():
                    yield layer, row[0], kind, data, points
    finally:
        db.close()


def package(tables: dict[str, list[tuple[dict, str, list[tuple[float, float]]]]], srs: int = 3857) -> bytes:
    """A GeoPackage of small layers of (values, kind, points)."""
    db = sqlite3.connect(":memory:")
    db.executescript(
        """PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"""
    )
    db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("EPSG", srs, "EPSG", srs), ("undefined cartesian", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0)])
    code = {"point": 1, "line": 2, "polygon": 3}
    for name, rows in tables.items():
        columns = list(dict.fromkeys(k for values, _, _ in rows for k in values))
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        db.execute(f"CREATE TABLE {quoted(name)} (fid INTEGER PRIMARY KEY, geom BLOB{''.join(f', {quoted(c)} TEXT' for c in columns)})")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, srs))
        for values, kind, points in rows:
            flat = struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in p))
            body = flat if kind == "point" else struct.pack("<I", len(points)) + flat
            body = struct.pack("<I", 1) + body if kind == "polygon" else body
            blob = b"GP\0\1" + struct.pack("<i", srs) + struct.pack("<BI", 1, code[kind]) + body
            db.execute(f"INSERT INTO {quoted(name)} VALUES (NULL, ?{', ?' * len(columns)})", [blob, *(values.get(c) for c in columns)])
    db.commit()
    out = db.serialize()
    db.close()
    return out


def _line(points) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


NAMES = ["file", "layer", "id", "kind", "data", "line"]


def read_gpkg(spark: SparkSession, path: str) -> DataFrame:
    """Features of all layers of the GeoPackages at ``path``, as rows of ``FEATURE``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(file, n, i, k, d, _line(p)) for n, i, k, d, p in layers(bytes(content))], columns=NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FEATURE)


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """Features of the shapefiles at ``path`` (a folder, or a pattern that also matches the ``.dbf`` beside), as rows of ``FEATURE``."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    stem = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    both = raw.select(stem.alias("stem"), kind.alias("kind"), "content").where("kind in ('shp', 'dbf')").groupBy("stem").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stem_, shp, dbf in zip(batch["stem"], batch["shp"], batch["dbf"], strict=True):
                rows = table(bytes(dbf)) if dbf is not None else []
                found = [(f"{stem_}.shp", os.path.basename(stem_), i, k, rows[i] if i < len(rows) else {}, _line(p)) for i, k, p in shapes(bytes(shp))]
                yield pd.DataFrame(found, columns=NAMES)

    return both.where("shp is not null").mapInPandas(run, FEATURE)
