"""Lines cut by polygons and by each other: overlay, snapping, drop wires and the overlap of circles."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.functions import geo, kernel
from fiberloom.operators.spatial import self_pairs

POINT = "struct<x:double,y:double>"


def _crossings(ring: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Places along a segment, from 0 to 1, where it meets a ring's edges."""
    closed = F.concat(ring, F.slice(ring, 1, 1))

    def at(s: Column) -> Column:
        dx, dy, ox, oy = bx - ax, by - ay, s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        det = dx * oy - dy * ox
        qx, qy = s["a"]["x"] - ax, s["a"]["y"] - ay
        t, u = F.try_divide(qx * oy - qy * ox, det), F.try_divide(qx * dy - qy * dx, det)
        return F.when((u >= 0) & (u <= 1) & (t > 0) & (t < 1), t)

    return F.filter(F.transform(geo.segments(closed), at), lambda t: t.isNotNull())


def _met(segments: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of a segment (``key, part, ax, ay, bx, by``) and a polygon (``polygon_id, ring``) whose boxes share a cell."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    l = segments.withColumn("cx", span(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("cy", span(F.least("ay", "by"), F.greatest("ay", "by")))  # noqa: E741
    box = polygons.withColumn("b", geo.bounds(F.col("ring")))
    r = box.withColumn("cx", span(F.col("b.minx"), F.col("b.maxx"))).withColumn("cy", span(F.col("b.miny"), F.col("b.maxy"))).select("polygon_id", "ring", "cx", "cy")
    pairs = l.join(r, ["cx", "cy"])
    return pairs.groupBy(*segments.columns, "polygon_id").agg(F.first("ring").alias("ring"))


def _pieces(rows: DataFrame, cuts: Column) -> DataFrame:
    """Rows with ``t0, t1``, each stretch of the segment between two cuts."""
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
    both = F.zip_with(F.slice(ts, F.lit(1), F.size(ts) - 1), F.slice(ts, F.lit(2), F.size(ts) - 1), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))
    return rows.withColumn("t", F.explode(both)).withColumn("t0", F.col("t.t0")).withColumn("t1", F.col("t.t1")).drop("t")


def _ends(keep: list[str]) -> list[Column]:
    on = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    size = F.sqrt(geo.distance2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))) * (F.col("t1") - F.col("t0"))
    return [*keep, on("ax", "bx", "t0").alias("px"), on("ay", "by", "t0").alias("py"), on("ax", "bx", "t1").alias("qx"), on("ay", "by", "t1").alias("qy"), size.alias("length")]


def intersection(segments: DataFrame, polygons: DataFrame, cell: float = 2500.0) -> DataFrame:
    """Stretches ``px, py, qx, qy, length`` of segments inside polygons, one row for each polygon.

    ``segments`` has ``ax, ay, bx, by`` and other columns that tell them apart; ``polygons`` has
    ``polygon_id, ring``. A segment is cut where it meets the ring, and a piece counts by its middle.
    """
    pairs = _met(segments, polygons, cell)
    s = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    cut = _pieces(pairs, _crossings(F.col("ring"), *s))
    mid = (F.col("t0") + F.col("t1")) / 2
    inside = geo.contains(F.col("ring"), s[0] + mid * (s[2] - s[0]), s[1] + mid * (s[3] - s[1]))
    keep = [c for c in segments.columns if c not in ("ax", "ay", "bx", "by")]
    return cut.where(inside).select(*_ends([*keep, "polygon_id"]))


def difference(segments: DataFrame, polygons: DataFrame, cell: float = 2500.0) -> DataFrame:
    """Stretches of segments outside all polygons; segments that meet none stay whole."""
    pairs = _met(segments, polygons, cell).groupBy(*segments.columns).agg(F.collect_list("ring").alias("rings"))
    rows = segments.join(pairs, [*segments.columns], "left")
    s = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    rings = F.coalesce("rings", F.array().cast(f"array<{geo.LINE}>"))
    rows = rows.withColumn("rings", rings)
    cut = _pieces(rows, F.flatten(F.transform("rings", lambda r: _crossings(r, *s))))
    mid = (F.col("t0") + F.col("t1")) / 2
    inside = F.exists("rings", lambda r: geo.contains(r, s[0] + mid * (s[2] - s[0]), s[1] + mid * (s[3] - s[1])))
    keep = [c for c in segments.columns if c not in ("ax", "ay", "bx", "by")]
    return cut.where(~inside).select(*_ends(keep))


def snapped_line(line: Column, reference: Column, threshold: float) -> Column:
    """The line with each vertex moved to the nearest place of the reference line, where that is within the threshold."""

    def moved(p: Column) -> Column:
        def foot(s: Column) -> Column:
            dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
            n = dx * dx + dy * dy
            t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / n))).otherwise(0.0)
            x, y = s["a"]["x"] + t * dx, s["a"]["y"] + t * dy
            return F.struct(geo.distance2(p["x"], p["y"], x, y).alias("d2"), x.alias("x"), y.alias("y"))

        best = F.array_min(F.transform(geo.segments(reference), foot))
        near = F.coalesce(best["d2"] <= threshold * threshold, F.lit(False))
        return F.struct(F.when(near, best["x"]).otherwise(p["x"]).alias("x"), F.when(near, best["y"]).otherwise(p["y"]).alias("y"))

    return F.transform(line, moved)


def with_drop_wires(rows: DataFrame) -> DataFrame:
    """Routes from site to site: the near site (``ax, ay``), the ``line`` between road nodes, the far site (``bx, by``), with ``length``."""
    p = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    whole = F.concat(p("ax", "ay"), F.col("line"), p("bx", "by"))
    return rows.withColumn("line", whole).withColumn("length", geo.length(F.col("line")))


def overlay_span(pairs: DataFrame, reach: float = 20.0, gap: float = 1000.0) -> DataFrame:
    """The stretch of a line between its first and last place near another, without the gaps beyond ``gap`` metres.

    ``pairs`` has ``line_id, line, other``; the result ``line_id, first, last, length``.
    """

    @F.pandas_udf("first double, last double, length double")
    def measure(line: pd.Series, other: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, ref in zip(line, other, strict=True):
            spans = kernel.near_spans([(p["x"], p["y"]) for p in raw], [(p["x"], p["y"]) for p in ref], reach)
            if not spans:
                rows.append((None, None, 0.0))
                continue
            wide = sum(b[0] - a[1] for a, b in zip(spans, spans[1:], strict=False) if b[0] - a[1] > gap)
            rows.append((spans[0][0], spans[-1][1], spans[-1][1] - spans[0][0] - wide))
        return pd.DataFrame(rows, columns=["first", "last", "length"])

    return pairs.withColumn("o", measure("line", "other")).select("line_id", "o.*")


def circle_overlaps(rows: DataFrame, key: str, radius: float, corners: int = 64) -> DataFrame:
    """Pairs ``a`` < ``b`` of circles that overlap, with the ``ring`` and ``area`` of what they share."""
    base = rows.select(F.col(key).alias("k"), "x", "y")
    near = self_pairs(rows, key, 2 * radius).where(F.col("d2") < 4 * radius * radius).select("a", "b")
    pairs = near.join(base.toDF("a", "x0", "y0"), "a").join(base.toDF("b", "x1", "y1"), "b")

    @F.pandas_udf(f"ring array<{POINT}>, area double")
    def lens(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        rings, areas = [], []
        for a in range(0, len(x0), 2000):
            p, q, u, v = (c.to_numpy(float)[a : a + 2000] for c in (x0, y0, x1, y1))
            found, size = kernel.clip_many(kernel.polygons(p, q, radius, corners), kernel.polygons(u, v, radius, corners))
            points = [{"x": x, "y": y} for x, y in found.tolist()]
            end = size.cumsum()
            rings += [points[e - n : e] for n, e in zip(size.tolist(), end.tolist(), strict=True)]
            areas += kernel.areas(found, size).tolist()
        return pd.DataFrame({"ring": rings, "area": areas})

    pairs = pairs.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "a", "b")  # few bytes, much work
    # A filter would be pushed below, and clip once more for it, before the pairs are dealt.
    out = pairs.select("a", "b", lens("x0", "y0", "x1", "y1").alias("o")).select("a", "b", F.explode(F.array("o")).alias("o"))
    return out.select("a", "b", "o.ring", "o.area").where("area > 0")
