"""Bill of quantity over drawn routes: nodes and turns, devices, access and backbone, fiber overlap, obstacles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.functions import geo, kernel
from fiberloom.operators.components import connected
from fiberloom.operators.spatial import near_line, nearest, self_pairs
from fiberloom.runtime import durable

PT = "struct<x:double,y:double>"
#: Radius of the disc around a node and half the width of a cable in it, in metres.
DISC, CABLE = 2.0, 0.5
#: Pieces that a long edge is cut into while nodes near it are looked for, in metres.
PIECE = 500.0


def _points(line) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in line]


def _line(points) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def exploded(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Two-point segments of lines with their place along the line."""
    rows = lines.select(key, F.posexplode(geo.segments(F.col(line))).alias("part", "s"))
    return rows.select(key, "part", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def graph_tables(lines: DataFrame, key: str, line: str = "line", decimals: int = 12) -> tuple[DataFrame, DataFrame]:
    """Nodes (every distinct vertex, numbered ``N0000001`` in order of place, with its count) and edges between them."""
    cut = lambda c: F.round(c, decimals)
    vertices = lines.select(F.explode(line).alias("p")).select(cut(F.col("p.x")).alias("x"), cut(F.col("p.y")).alias("y"))
    counts = vertices.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    # Numbers follow from the order of places, range by range: no task holds them all.
    ordered = counts.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("__p", F.spark_partition_id())
    ordered = durable(ordered)
    sizes = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("__p")) if before else F.lit(0)
    no = F.row_number().over(Window.partitionBy("__p").orderBy("x", "y")) + start
    nodes = ordered.select(F.concat(F.lit("N"), F.lpad(no.cast("string"), 7, "0")).alias("node_id"), "x", "y", "n")
    segs = exploded(lines, key, line).withColumns({c: cut(F.col(c)) for c in ("ax", "ay", "bx", "by")})
    end = lambda side: nodes.select(F.col("node_id").alias(f"node_{side}"), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"))
    edges = segs.join(end("a"), ["ax", "ay"]).join(end("b"), ["bx", "by"])
    return nodes, edges.select(key, "part", "node_a", "node_b", F.sqrt(geo.distance2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("length"))


def _kinds(areas: DataFrame, min_ratio: float) -> DataFrame:
    """``node_id, parts, ratio, kind`` from ``node_id, parts, low, high``; a node whose disc is left in one part has no ratio."""
    ratio = F.when(F.col("parts") >= 2, F.col("low") / F.col("high"))
    kind = F.when(F.col("parts") < 2, "end").when(F.col("parts") >= 3, "branch").when(ratio < min_ratio, "turn").otherwise("straight")
    return areas.select("node_id", F.col("parts").cast("long").alias("parts"), F.round(ratio, 6).alias("ratio"), kind.alias("kind"))


def _free(ways: DataFrame, radius: float, width: float) -> DataFrame:
    """``node_id, parts, low, high``: what ways out of a node, ``dx, dy`` and all longer than the disc, leave of a disc around it."""
    angles = ways.select("node_id", F.round(geo.azimuth(F.col("dx"), F.col("dy")), 6).alias("a")).distinct()
    by = Window.partitionBy("node_id").orderBy("a")
    gap = F.coalesce(F.lead("a").over(by) - F.col("a"), F.first("a").over(by) + 360.0 - F.col("a"))
    area = angles.withColumn("area", geo.gap_area(F.radians(gap), radius, width)).where(F.col("area") > 1e-9)
    return area.groupBy("node_id").agg(F.count(F.lit(1)).alias("parts"), F.min("area").alias("low"), F.max("area").alias("high"))


def own_parts(nodes: DataFrame, edges: DataFrame, radius: float = DISC, width: float = CABLE) -> DataFrame:
    """``node_id, parts, low, high``: what a node's own edges leave of a disc around it, taken as longer than the disc, in column expressions."""
    xy = lambda k: nodes.select(F.col("node_id").alias(f"node_{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    e = edges.select("node_a", "node_b").distinct().join(xy("a"), "node_a").join(xy("b"), "node_b")
    both = e.select("node_a", "xa", "ya", "xb", "yb").unionAll(e.select("node_b", "xb", "yb", "xa", "ya")).toDF("node_id", "x0", "y0", "x1", "y1")
    return _free(both.select("node_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy")), radius, width)


def disc_parts(nodes: DataFrame, edges: DataFrame, radius: float = DISC, width: float = CABLE) -> DataFrame:
    """``node_id, parts, low, high``: what all edges leave of a disc around each node, those passing by included.

    Nodes that edges come near only by ending there or by passing exactly through, all longer than
    the disc on either side, take the closed form (an edge that passes through is two ways out); the
    others a walk over the outlines of what is cut out.
    """
    xy = lambda k, x, y: nodes.select(F.col("node_id").alias(f"node_{k}"), F.col("x").alias(x), F.col("y").alias(y))
    drawn = edges.select("node_a", "node_b").distinct().join(xy("a", "ax", "ay"), "node_a").join(xy("b", "bx", "by"), "node_b")
    n = F.ceil(F.sqrt(geo.distance2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))) / PIECE)
    cut = drawn.withColumn("n", F.greatest(n, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    along = lambda c, i: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (i / F.col("n"))
    cut = cut.withColumns({f"{k}{c}": along(c, F.col("i") + d) for k, d in (("p", 0), ("q", 1)) for c in "xy"}).drop("n", "i")
    met = near_line(nodes.select("node_id", "x", "y"), cut, radius + width, ends=("px", "py", "qx", "qy"))
    met = durable(met.select("node_id", "x", "y", "node_a", "node_b", "ax", "ay", "bx", "by").distinct())
    off = (F.col("ax") - F.col("x")) * (F.col("by") - F.col("y")) != (F.col("ay") - F.col("y")) * (F.col("bx") - F.col("x"))
    passing = (F.col("node_id") != F.col("node_a")) & (F.col("node_id") != F.col("node_b"))
    far = lambda k: geo.distance2(F.col(f"{k}x"), F.col(f"{k}y"), F.col("x"), F.col("y")) >= (radius + width) ** 2
    whole = (far("a") | (F.col("node_id") == F.col("node_a"))) & (far("b") | (F.col("node_id") == F.col("node_b"))) & (F.col("node_a") != F.col("node_b"))
    odd = durable(met.where(passing & off | ~whole).select("node_id").distinct())
    end = lambda k: F.struct(F.col(f"node_{k}").alias("to"), (F.col(f"{k}x") - F.col("x")).alias("dx"), (F.col(f"{k}y") - F.col("y")).alias("dy"))
    ways = met.join(odd, "node_id", "left_anti").select("node_id", F.explode(F.array(end("a"), end("b"))).alias("w"))
    plain = _free(ways.where(F.col("w.to") != F.col("node_id")).select("node_id", "w.dx", "w.dy"), radius, width)

    @F.pandas_udf("array<double>")
    def left(segments: pd.Series) -> pd.Series:
        return pd.Series([kernel.disc_parts([(s["ax"], s["ay"], s["bx"], s["by"]) for s in x], radius, width) for x in segments])

    shifted = F.struct(*[(F.col(c) - F.col(c[1])).alias(c) for c in ("ax", "ay", "bx", "by")])
    areas = met.join(odd, "node_id", "left_semi").groupBy("node_id").agg(F.collect_set(shifted).alias("s")).select("node_id", left("s").alias("areas"))
    walked = areas.where(F.size("areas") > 0).select("node_id", F.size("areas").cast("long").alias("parts"), F.array_min("areas").alias("low"), F.array_max("areas").alias("high"))
    return plain.unionByName(walked)


def turns(nodes: DataFrame, edges: DataFrame, min_ratio: float = 0.8, *, own: bool = False) -> DataFrame:
    """``node_id, parts, ratio, kind``: a disc around a node, without its cables, falls in parts.

    Three parts or more make a ``branch``, two of uneven areas (least by most under ``min_ratio``) a
    ``turn``, two even ones ``straight``, and a disc in one part an ``end``. All edges cut, or only
    the node's ``own``. A disc that cables cover wholly has no row.
    """
    return _kinds((own_parts if own else disc_parts)(nodes, edges), min_ratio)


def devices(points: DataFrame, nodes: DataFrame, classes: DataFrame, reach: float = 500.0) -> DataFrame:
    """For each site point its terminal (nearest node) and distribution point (nearest turn in reach, else the terminal).

    A branch in reach with a ratio under 0.5 goes before the nearest turn.
    """
    at = nodes.select("node_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    otb = nearest(points.select("site_id", "x", "y"), at, "site_id", "node_id").select("site_id", F.col("node_id").alias("otb"), F.sqrt("d2").alias("otb_distance"))
    # Read several times below, and costly to find.
    marked = durable(at.join(classes.where("kind in ('turn', 'branch')"), "node_id"))
    turn = nearest(points.select("site_id", "x", "y"), marked.where("kind = 'turn'"), "site_id", "node_id", max_distance=reach).select("site_id", F.col("node_id").alias("turn"))
    branch = nearest(points.select("site_id", "x", "y"), marked.where("kind = 'branch' and ratio < 0.5"), "site_id", "node_id", max_distance=reach).select("site_id", F.col("node_id").alias("branch"))
    out = otb.join(turn, "site_id", "left").join(branch, "site_id", "left")
    return out.select("site_id", "otb", "otb_distance", F.coalesce("branch", "turn", "otb").alias("odp"))


def access_backbone(lines: DataFrame) -> DataFrame:
    """Split a line at the device nearest to it: the shorter part is access, the rest backbone.

    ``lines`` has ``line_id, line`` and the device at ``px, py``.
    """

    @F.pandas_udf(f"at double, length double, access array<{PT}>, backbone array<{PT}>")
    def split(line: pd.Series, px: pd.Series, py: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, x, y in zip(line, px, py, strict=True):
            pts = _points(raw)
            m, n = kernel.measure(pts, x, y)[0], kernel.length(pts)
            a, b = kernel.substring(pts, 0, m), kernel.substring(pts, m, n)
            short, rest = (a, b) if m <= n - m else (b, a)
            rows.append((m, n, _line(short), _line(rest)))
        return pd.DataFrame(rows, columns=["at", "length", "access", "backbone"])

    out = lines.withColumn("s", split("line", "px", "py"))
    shorter = F.least(F.col("s.at"), F.col("s.length") - F.col("s.at"))
    return out.select("line_id", shorter.alias("access_length"), (F.col("s.length") - shorter).alias("backbone_length"), F.col("s.access").alias("access"), F.col("s.backbone").alias("backbone"))


def fiber_overlap(pairs: DataFrame, reach: float = 20.0) -> DataFrame:
    """Length of a line that runs within ``reach`` of another: ``existing``, the rest is ``new``; with the outermost span.

    ``pairs`` has ``line_id, line, other``. ``first`` and ``last`` bound the overlap along the line.
    """

    @F.pandas_udf("existing double, new double, first double, last double")
    def cut(line: pd.Series, other: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, ref in zip(line, other, strict=True):
            pts = _points(raw)
            spans = kernel.near_spans(pts, _points(ref), reach)
            n, on = kernel.length(pts), sum(b - a for a, b in spans)
            rows.append((on, n - on, spans[0][0] if spans else None, spans[-1][1] if spans else None))
        return pd.DataFrame(rows, columns=["existing", "new", "first", "last"])

    return pairs.withColumn("o", cut("line", "other")).select(*[c for c in pairs.columns if c not in ("line", "other")], "o.*")


def previous_route(pairs: DataFrame, reach: float = 50.0) -> DataFrame:
    """Overlap of a new route with the previous one, gaps inside counted as existing."""
    o = fiber_overlap(pairs, reach)
    span = F.coalesce(F.col("last") - F.col("first"), F.lit(0.0))
    return o.select("line_id", span.alias("existing"), (F.col("existing") + F.col("new") - span).alias("new"))


def overlap_class(length) -> F.col:
    """Fiber above 1000 m is existing fiber, from 100 m a pole line."""
    return F.when(length > 1000, "fo_exist").when(length >= 100, "pole_exist").otherwise("none")


def obstacles(segments: DataFrame, barriers: DataFrame, blob: float = 100.0) -> DataFrame:
    """Places where route segments cross barriers (rail, toll), one for each blob of ``blob`` metres.

    Both have ``ax, ay, bx, by``; the first also ``line_id``, the second ``name``.
    """
    cell = 1000.0
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    def boxed(df):
        return df.withColumn("cx", span(F.col("ax"), F.col("bx"))).withColumn("cy", span(F.col("ay"), F.col("by")))

    other = boxed(barriers).withColumnsRenamed({c: f"o{c}" for c in ("ax", "ay", "bx", "by")})
    pairs = boxed(segments).join(other, ["cx", "cy"]).drop("cx", "cy").distinct()
    # Both orientations must differ for two segments to cross; exact in doubles.
    dx, dy, ox, oy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    det = dx * oy - dy * ox
    qx, qy = F.col("oax") - F.col("ax"), F.col("oay") - F.col("ay")
    t, u = F.try_divide(qx * oy - qy * ox, det), F.try_divide(qx * dy - qy * dx, det)
    hit = pairs.withColumn("t", t).withColumn("u", u).where("t between 0 and 1 and u between 0 and 1")
    hit = hit.select("line_id", "name", (F.col("ax") + F.col("t") * dx).alias("x"), (F.col("ay") + F.col("t") * dy).alias("y"))
    # Places are linked, not crossings: many lines may cross at one place.
    rows = durable(hit.distinct().withColumn("ord", F.xxhash64("x", "y")))
    spots = durable(rows.select("ord", "x", "y").distinct())
    comp = connected(self_pairs(spots, "ord", 2 * blob).select("a", "b"), spots.select(F.col("ord").alias("id")))
    first = F.row_number().over(Window.partitionBy("component", "line_id", "name").orderBy("x", "y"))
    return rows.join(comp.withColumnRenamed("id", "ord"), "ord").withColumn("n", first).where("n = 1").select("line_id", "name", "x", "y")


def covers(lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Pairs ``a, b`` of segments (``ord, ax, ay, bx, by``) where a, the longer or of equal ones the earlier, has both ends of b within the tolerance.

    Segments are dealt to the cells of their boxes, grown by the tolerance; a covered one shares a cell with what covers it.
    """
    cell = 1000.0
    span = lambda p, q, grow: F.explode(F.sequence(F.floor((F.least(p, q) - grow) / cell), F.floor((F.greatest(p, q) + grow) / cell)))
    ends = ("ax", "ay", "bx", "by")
    n = geo.distance2(*[F.col(c) for c in ends]).alias("n")
    rows = lines.select("ord", *ends, n)
    whole = rows.withColumn("cx", span(F.col("ax"), F.col("bx"), tolerance)).withColumn("cy", span(F.col("ay"), F.col("by"), tolerance))
    # The covered one is met in the cell of one of its ends.
    part = rows.select(F.col("ord").alias("b"), *[F.col(c).alias(f"o{c}") for c in ends], F.col("n").alias("m"), F.floor(F.col("ax") / cell).alias("cx"), F.floor(F.col("ay") / cell).alias("cy"))
    near = lambda x, y: geo.segment_distance2(F.col(x), F.col(y), *[F.col(c) for c in ends]) <= tolerance * tolerance
    longer = (F.col("n") > F.col("m")) | (F.col("n") == F.col("m")) & (F.col("ord") < F.col("b"))
    return whole.join(part, ["cx", "cy"]).where((F.col("ord") != F.col("b")) & longer & near("oax", "oay") & near("obx", "oby")).select(F.col("ord").alias("a"), "b")


def centerline(lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``ord`` of the segments that no longer kept segment covers within the tolerance, longest first.

    ``lines`` has ``ord, ax, ay, bx, by``. The order matters only among segments that cover each
    other, link by link; those are few, and each such group runs alone. What a segment covers that nothing covers goes before, without a group.
    """
    pairs = durable(covers(lines, tolerance))
    tops = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    sure = durable(tops.select(F.col("b").alias("ord")).distinct())
    for end in ("a", "b"):
        pairs = pairs.join(sure.withColumnRenamed("ord", end), end, "left_anti")
    pairs = durable(pairs.select("a", "b"))
    if pairs.isEmpty():
        return lines.select("ord").join(sure, "ord", "left_anti")
    group = connected(pairs).withColumnsRenamed({"id": "b", "component": "group"})
    n = geo.distance2(*[F.col(c) for c in ("ax", "ay", "bx", "by")]).alias("n")
    rows = pairs.join(group, "b").join(lines.select(F.col("ord").alias("b"), n), "b")

    def drop(part: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        above: dict[int, list[int]] = {}
        for a, b in part[["a", "b"]].itertuples(index=False):
            above.setdefault(b, []).append(a)
        for b in part.sort_values(["n", "b"], ascending=[False, True])["b"].drop_duplicates():
            if any(a not in gone for a in above[b]):  # all that may cover it are longer, so they are settled
                gone.add(b)
        return pd.DataFrame({"ord": sorted(gone)}, dtype="int64")

    return lines.select("ord").join(sure.unionByName(rows.groupBy("group").applyInPandas(drop, "ord long")), "ord", "left_anti")


def summary(points: DataFrame, lines: DataFrame, obstacle: DataFrame) -> DataFrame:
    """Sites, route metres and obstacles of each ring; 0 where it has none."""
    a = points.groupBy("ring_name").agg(F.count(F.lit(1)).alias("sites"))
    b = lines.groupBy("ring_name").agg(F.sum("length").alias("route_length"))
    c = obstacle.groupBy("ring_name").agg(F.count(F.lit(1)).alias("obstacles"))
    return a.join(b, "ring_name", "left").join(c, "ring_name", "left").fillna(0)


def pivots(sites: DataFrame, devices: DataFrame, routes: DataFrame, obstacle: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """One row for each ring of ``sites``: sites and devices by ``type``, route ``length`` by type, obstacles by type; 0 where there are none.

    All have ``ring_name`` and ``type``; ``kinds`` has the types of each table, which are columns of the result.
    """
    out = sites.select("ring_name").distinct()
    for rows, name in ((sites, "sites"), (devices, "devices"), (routes, "routes"), (obstacle, "obstacles")):
        by = rows.groupBy("ring_name").pivot("type", kinds[name])
        out = out.join(by.agg(F.sum("length")) if name == "routes" else by.count(), "ring_name", "left")
    return out.fillna(0)


def flattened(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row for each entry of a map column."""
    return rows.select(*keys, F.explode(column).alias("fiber", "value"))


def fiber_pairs(lines: DataFrame, fiber: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """Pairs of a line (``keys``, ``line``) and a fiber (``fiber``, ``ref``) that may come within reach of each other.

    Segment against segment: both are dealt to the cells of their boxes, the fiber's grown by the reach.
    """
    cell = max(reach * 8, 1000.0)
    span = lambda a, b, grow: F.explode(F.sequence(F.floor((F.least(a, b) - grow) / cell), F.floor((F.greatest(a, b) + grow) / cell)))

    def cells(rows: DataFrame, names: list[str], line: str, grow: float) -> DataFrame:
        s = rows.select(*names, F.explode(geo.segments(F.col(line))).alias("s"))
        s = s.withColumn("cx", span(F.col("s.a.x"), F.col("s.b.x"), grow)).withColumn("cy", span(F.col("s.a.y"), F.col("s.b.y"), grow))
        return s.select(*names, "cx", "cy").distinct()

    met = cells(lines, keys, "line", 0.0).join(cells(fiber, ["fiber"], "ref", reach), ["cx", "cy"]).select(*keys, "fiber").distinct()
    return met.join(lines, keys).join(fiber, "fiber")


def stretches(lines: DataFrame, fiber: DataFrame, reach: float = 30.0, tolerance: float = 5.0) -> DataFrame:
    """``line_id, fiber, first, last, length, class``: where lines run along existing fiber, a row for each fiber.

    A stretch that a longer one of the line covers within the tolerance goes. Beyond 1000 m it is
    ``fo_exist``, beyond 100 m ``pole_exist``; shorter ones don't count. Lines of one course are
    held against the fiber once.
    """
    courses = durable(lines.groupBy("line").agg(F.min("line_id").alias("__of")))
    same = durable(lines.select("line_id", "line").join(courses, "line").select("line_id", "__of"))
    pairs = fiber_pairs(courses.select(F.col("__of").alias("line_id"), "line"), fiber, reach, ["line_id"]).withColumnRenamed("ref", "other")
    o = fiber_overlap(pairs.select("line_id", "fiber", "line", "other"), reach).where("existing > 0")
    o = o.select("line_id", "fiber", "first", "last", F.col("existing").alias("length")).withColumn("class", overlap_class(F.col("length"))).where("class <> 'none'")
    o = durable(o)
    # Longest first: covered by one that begins no later, ends no earlier, and is longer (or the earlier name).
    other = o.select("line_id", F.col("fiber").alias("f2"), F.col("first").alias("a2"), F.col("last").alias("b2"), F.col("length").alias("n2"))
    longer = (F.col("n2") > F.col("length")) | (F.col("n2") == F.col("length")) & (F.col("f2") < F.col("fiber"))
    covered = o.join(other, "line_id").where((F.col("a2") <= F.col("first") + tolerance) & (F.col("b2") >= F.col("last") - tolerance) & longer).select("line_id", "fiber").distinct()
    kept = o.join(covered, ["line_id", "fiber"], "left_anti").withColumnRenamed("line_id", "__of")
    return same.join(kept, "__of").select("line_id", *[c for c in kept.columns if c != "__of"])


def parts(lines: DataFrame) -> DataFrame:
    """Lines with ``length``, ``access_ne`` and ``access_fe``: how far the near and the far end's device is along the line from that end.

    ``lines`` has ``line_id, line`` and the devices at ``nx, ny`` and ``fx, fy``; one that is nearer
    to the other end gives no access part. What lies between is ``backbone``.
    """

    @F.pandas_udf("length double, near double, far double")
    def split(line: pd.Series, nx: pd.Series, ny: pd.Series, fx: pd.Series, fy: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, a, b, c, d in zip(line, nx, ny, fx, fy, strict=True):
            pts = _points(raw)
            rows.append((kernel.length(pts), kernel.measure(pts, a, b)[0], kernel.measure(pts, c, d)[0]))
        return pd.DataFrame(rows, columns=["length", "near", "far"])

    out = lines.withColumn("s", split("line", "nx", "ny", "fx", "fy"))
    n, near, far = F.col("s.length"), F.col("s.near"), F.col("s.far")
    ne, fe = F.when(near <= n - near, near).otherwise(0.0), F.when(n - far <= far, n - far).otherwise(0.0)
    return out.select(*lines.columns, n.alias("length"), ne.alias("access_ne"), fe.alias("access_fe"), F.greatest(F.lit(0.0), n - ne - fe).alias("backbone"))


def bill(points: DataFrame, lines: DataFrame, fiber: DataFrame, barriers: DataFrame, reach: float = 30.0) -> dict[str, DataFrame]:
    """Bill of quantity of all rings at once: ``points``, ``lines``, ``stretches``, ``closures`` and ``obstacles``.

    ``points`` has ``ring_name, site_id, x, y``; ``lines`` ``ring_name, line_id, near_end, far_end,
    line`` with a unique ``line_id``; ``fiber`` ``fiber, ref``; ``barriers`` as in :func:`obstacles`.
    Devices come from the nodes and turns of the lines; closures are the ends of an existing
    stretch that lie on the backbone.
    """
    nodes, edges = graph_tables(lines, "line_id")
    nodes, edges = durable(nodes), durable(edges)
    at = nodes.select("node_id", "x", "y")
    placed = devices(points, nodes, turns(nodes, edges))
    placed = durable(points.join(placed, "site_id").join(at.toDF("otb", "otb_x", "otb_y"), "otb").join(at.toDF("odp", "odp_x", "odp_y"), "odp"))
    end = lambda side, x, y: placed.select(F.col("site_id").alias(f"{side}_end"), F.col("odp_x").alias(x), F.col("odp_y").alias(y)).dropDuplicates([f"{side}_end"])
    cut = durable(parts(lines.join(end("near", "nx", "ny"), "near_end").join(end("far", "fx", "fy"), "far_end")))
    runs = durable(stretches(lines, fiber, reach))
    on = runs.where("class = 'fo_exist'").join(cut.select("line_id", "line", "access_ne", "access_fe", F.col("length").alias("whole")), "line_id")
    ends = on.withColumn("m", F.explode(F.array("first", "last"))).where("m > access_ne + 1e-6 and m < whole - access_fe - 1e-6")

    @F.pandas_udf("x double, y double")
    def place(line: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(kernel.substring(_points(raw), at_, at_) or [_points(raw)[-1]])[0] for raw, at_ in zip(line, m, strict=True)], columns=["x", "y"])

    closures = ends.withColumn("p", place("line", "m")).select("line_id", "fiber", "p.x", "p.y")
    crossed = exploded(lines, "line_id").drop("part")
    return {"points": placed, "lines": cut, "stretches": runs, "closures": closures, "obstacles": obstacles(crossed, barriers)}


def compiled(found: dict[str, DataFrame]) -> DataFrame:
    """The ten layers of a bill as rows ``layer, ring_name, name, length, x, y``; lines have a length, points a place."""
    of = found["lines"].select("line_id", "ring_name", F.concat_ws("-", "near_end", "far_end").alias("ends"))
    none = F.lit(None).cast("double")

    def line(layer: str, rows: DataFrame, name, length) -> DataFrame:
        return rows.select(F.lit(layer).alias("layer"), "ring_name", name.alias("name"), length.alias("length"), none.alias("x"), none.alias("y"))

    def point(layer: str, rows: DataFrame, name, x: str = "x", y: str = "y") -> DataFrame:
        return rows.select(F.lit(layer).alias("layer"), "ring_name", name.alias("name"), none.alias("length"), F.col(x).alias("x"), F.col(y).alias("y"))

    ends, points = F.col("ends"), found["points"]
    cut = found["lines"].withColumn("ends", F.concat_ws("-", "near_end", "far_end"))
    runs = found["stretches"].join(of, "line_id")
    crossed = found["obstacles"].join(of, "line_id")
    layers = [
        point("odp", points, F.concat_ws(" ", F.lit("ODP"), "site_id"), "odp_x", "odp_y"),
        point("otb", points, F.concat_ws(" ", F.lit("OTB"), "site_id"), "otb_x", "otb_y"),
        point("closure", found["closures"].join(of, "line_id"), F.concat_ws(" ", F.lit("Closure"), ends)),
        line("backbone", cut.where("backbone > 0"), F.concat_ws(" ", F.lit("BB"), ends), F.col("backbone")),
        line("access_ne", cut.where("access_ne > 0"), F.concat_ws(" ", F.lit("Access"), ends), F.col("access_ne")),
        line("access_fe", cut.where("access_fe > 0"), F.concat_ws(" ", F.lit("Access"), ends), F.col("access_fe")),
        line("fo_exist", runs.where("class = 'fo_exist'"), F.concat_ws("/", ends, "fiber"), F.col("length")),
        line("pole_exist", runs.where("class = 'pole_exist'"), F.concat_ws("/", ends, F.lit("POLE EXT")), F.col("length")),
        point("obstacle_railway", crossed.where("lower(name) like '%rail%'"), F.concat_ws(" ", F.lit("Obstacle Rail"), ends)),
        point("obstacle_toll", crossed.where("lower(name) like '%toll%'"), F.concat_ws(" ", F.lit("Obstacle Toll"), ends)),
    ]
    out = layers[0]
    for rows in layers[1:]:
        out = out.unionByName(rows)
    return out
