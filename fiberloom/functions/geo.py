"""Geometry as column expressions. Points are two doubles in metres; a line is an array of struct(x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
LINE = "array<struct<x:double,y:double>>"


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to spherical Mercator metres."""
    return F.lit(EARTH) * F.radians(lon), F.lit(EARTH) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def degrees_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres to degrees of longitude and latitude."""
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.lit(1.5707963267948966))


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def segment_distance2(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    return distance2(px, py, ax + t * dx, ay + t * dy)


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0))


def gap_area(gap: Column, radius: float, width: float) -> Column:
    """What the gap (radians) between two ways out of a disc's centre leaves of it, each way ``width`` wide on either side and longer than the disc."""
    r, w, start = radius, width, math.asin(width / radius)
    half = gap / 2
    narrow = r * r * (half - start) + w * w * (F.cos(half) / F.sin(half) - 1 / math.tan(start))
    wide = gap * (r * r / 2) - (w * math.sqrt(r * r - w * w) + r * r * start) - (gap - math.pi) * (w * w / 2)
    return F.when(half <= start, 0.0).when(gap <= math.pi, narrow).otherwise(wide)


def lens_area(d: Column, r: Column) -> Column:
    """Overlap of two circles of one radius whose centres are d apart."""
    inside = 2 * r * r * F.acos(F.least(F.lit(1.0), d / (2 * r))) - d / 2 * F.sqrt(F.greatest(F.lit(0.0), 4 * r * r - d * d))
    return F.when(d >= 2 * r, 0.0).otherwise(inside)


def segments(line: Column) -> Column:
    """Array of struct(a, b): the line's two-point pieces; empty under two points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + F.sqrt(distance2(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a ring that need not repeat its first point; positive counter-clockwise."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.aggregate(segments(closed), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of the area of a ring."""
    closed, a = F.concat(ring, F.slice(ring, 1, 1)), signed_area(ring)
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    part = lambda c: F.aggregate(segments(closed), F.lit(0.0), lambda acc, s: acc + (s["a"][c] + s["b"][c]) * cross(s)) / (6 * a)
    return part("x"), part("y")


def contains(ring: Column, px: Column, py: Column) -> Column:
    """Whether a point is in a ring by crossings; points on the right or upper edge count as outside."""
    closed = F.concat(ring, F.slice(ring, 1, 1))

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(spans & (px < at), 1).otherwise(0)

    return F.aggregate(segments(closed), F.lit(0), lambda acc, s: acc + crosses(s)) % 2 == 1


def bounds(line: Column) -> Column:
    """struct(minx, miny, maxx, maxy) of a line or ring."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
