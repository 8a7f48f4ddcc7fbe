"""Ring logic that is order within a group: consecutive pairs, hubs, numbering and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.functions import geo
from fiberloom.operators.spatial import near_line, nearest
from fiberloom.runtime import durable, few, stored


def is_hub(site_type: Column) -> Column:
    return F.coalesce(F.lower(site_type).contains("hub"), F.lit(False))


def topology(points: DataFrame, ring: str = "ring_name", order: str = "seq") -> DataFrame:
    """Consecutive pairs of a ring's points. One hub: the last point closes on the first; two: the line ends there.

    Rings with any other number of hubs have ``rejected`` set and no pairs that close.
    """
    by = Window.partitionBy(ring).orderBy(order)
    whole = Window.partitionBy(ring)
    hubs = F.sum(is_hub(F.col("site_type")).cast("int")).over(whole)
    nxt = F.coalesce(F.lead("site_id").over(by), F.when(hubs == 1, F.first("site_id").over(by)))
    rows = points.select(ring, order, F.col("site_id").alias("near_end"), nxt.alias("far_end"), hubs.alias("hubs"))
    return rows.where("far_end is not null and far_end <> near_end").withColumn("rejected", ~F.col("hubs").isin(1, 2))


def segments(points: DataFrame, ring: str = "ring_name", order: str = "seq") -> DataFrame:
    """Consecutive points side by side with ``sequence`` from 0, and the straight length between them."""
    by = Window.partitionBy(ring).orderBy(order)
    rows = points.select(ring, order, F.col("site_id").alias("site_id_a"), "x", "y", F.lead("site_id").over(by).alias("site_id_b"), F.lead("x").over(by).alias("xb"), F.lead("y").over(by).alias("yb"), (F.row_number().over(by) - 1).alias("sequence"))
    return rows.where("site_id_b is not null").withColumn("length", F.sqrt(geo.distance2(F.col("x"), F.col("y"), F.col("xb"), F.col("yb")))).drop("x", "y", "xb", "yb", order)


def vertex_flags(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Vertices of drawn lines with Start, Middle or End, and the site type that follows from it."""
    n = F.size(line)
    rows = lines.select(key, n.alias("n"), F.posexplode(line).alias("vertex", "p"))
    flag = F.when(F.col("vertex") == 0, "Start").when(F.col("vertex") == F.col("n") - 1, "End").otherwise("Middle")
    return rows.select(key, "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y"), flag.alias("flag"), F.when(flag == "Middle", "Site List").otherwise("FO Hub").alias("site_type"))


def ring_centroids(points: DataFrame, ring: str = "ring_name") -> DataFrame:
    """Mean of the distinct places of a ring."""
    return points.select(ring, "x", "y").distinct().groupBy(ring).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


#: Rows of sites that a task of :func:`dealt` holds about.
ROWS = 50_000


def dealt(rows: DataFrame, points: DataFrame, ring: str) -> DataFrame:
    """Rows dealt by ring over as many tasks as the number of ``points`` asks for, so that what a task holds does not grow with the table."""
    return rows.repartition(max(1, -(-points.count() // ROWS)), ring)


def ring_hubs(points: DataFrame, hubs: DataFrame, max_distance: float = 10_000.0, ring: str = "ring_name") -> DataFrame:
    """The two nearest hubs of a ring within reach of any of its sites: the nearer is the start, the other the end."""
    h = hubs.select(F.col("site_id").alias("hub_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = nearest(points.select(ring, "site_id", "x", "y"), h, "site_id", "hub_id", k=2, max_distance=max_distance)
    best = dealt(near.select(ring, "hub_id", "d2"), points, ring).groupBy(ring, "hub_id").agg(F.min("d2").alias("d2"))
    n = F.row_number().over(Window.partitionBy(ring).orderBy("d2", "hub_id"))
    return best.withColumn("n", n).where("n <= 2").select(ring, "hub_id", "d2", F.when(F.col("n") == 1, "start").otherwise("end").alias("flag"))


def numbered(df: DataFrame, label: str, region: str = "region") -> DataFrame:
    """Clusters renumbered from 1 in order within each region, with a name."""
    n = F.dense_rank().over(Window.partitionBy(region).orderBy(label))
    return df.withColumn("cluster_no", n).withColumn("ring_name", F.concat_ws("_", region, F.lpad(n.cast("string"), 4, "0")))


def ring_code(area: str, number: Column, prefix: str = "RING", project: str = "P") -> Column:
    """Name of a ring by its area's code and its number there; prefix and project are the user's."""
    return F.concat(F.lit(f"{prefix}-"), F.col(area), F.lit(f"-{project}-"), F.lpad(number.cast("string"), 4, "0"))


def sorted_by(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows with ``sort_no``, their place in an external list (``key``, ``place``); unlisted keys last."""
    rows = df.join(order.select(key, "place"), key, "left")
    return rows.withColumn("sort_no", F.row_number().over(Window.partitionBy("ring_name").orderBy(F.asc_nulls_last("place"), key))).drop("place")


def gained(points: DataFrame, ring: str = "ring_name") -> DataFrame:
    """Rings that hold an inserted point."""
    got = points.groupBy(ring).agg(F.bool_or(F.col("note") == "insert").alias("got")).where("got").select(ring)
    return points.join(got, ring, "left_semi")


def with_new_site(points: DataFrame, ring: str = "ring_name") -> DataFrame:
    """Rings in which some site's type speaks of a new site."""
    new = points.groupBy(ring).agg(F.bool_or(F.lower("site_type").contains("new")).alias("new")).where("new").select(ring)
    return points.join(new, ring, "left_semi")


def segment_report(segs: DataFrame, points: DataFrame) -> DataFrame:
    """Segments with both ends' attributes, priority, remark and the ring's first and last hub as peers."""
    side = lambda e: points.select(F.col("site_id").alias(f"{e}_end"), F.col("site_name").alias(f"{e}_name"), F.col("site_type").alias(f"{e}_type"), F.col("note").alias(f"{e}_note"))
    hubs = points.where(is_hub(F.col("site_type"))).groupBy("ring_name").agg(F.min_by("site_id", "seq").alias("first_hub"), F.max_by("site_id", "seq").alias("last_hub"))
    out = segs.join(side("near"), "near_end", "left").join(side("far"), "far_end", "left").join(hubs, "ring_name", "left")
    existing, insert, far_hub = F.col("near_note") == "existing", F.col("near_note") == "insert", is_hub(F.col("far_type"))
    priority = F.when(existing & far_hub, "P0").when(existing, "Access").when(insert & ~far_hub, "Insert Site").otherwise("Access")
    remark = F.when((F.col("near_note") == "insert") | (F.col("far_note") == "insert"), "Insert Segment").otherwise("")
    return out.withColumn("priority", priority).withColumn("remark", remark)


def shared_road(paths: DataFrame, edges: DataFrame, threshold: float = 3000.0, protected: DataFrame | None = None) -> DataFrame:
    """Pairs of hops of a ring that run along the same roads for more than ``threshold`` metres.

    ``paths`` has ``ring_name, seq, node``; ``edges`` ``node_start, node_end, length``, one row for
    a pair of nodes. ``protected`` (``ring_name, node``) doesn't count. A road is shared when both
    hops pass both its ends.
    """
    nodes = paths.select("ring_name", "seq", "node").distinct()
    if protected is not None:
        nodes = nodes.join(protected, ["ring_name", "node"], "left_anti")
    # Many rings may pass the same few nodes, which would be hot keys: only the roads between nodes that are passed meet the hops.
    passed = durable(nodes.select("node").distinct())
    for end in ("node_start", "node_end"):
        edges = edges.join(few(passed).withColumnRenamed("node", end), end, "left_semi")
    edges = few(durable(edges.groupBy("node_start", "node_end").agg(F.sum("length").alias("length"))))
    ends = nodes.withColumnRenamed("node", "node_end")
    on = nodes.withColumnRenamed("node", "node_start").join(edges, "node_start").join(ends, ["ring_name", "seq", "node_end"])
    later = on.select("ring_name", "node_start", "node_end", F.col("seq").alias("seq_b"))
    both = on.withColumnRenamed("seq", "seq_a").join(later, ["ring_name", "node_start", "node_end"]).where("seq_a < seq_b")
    return both.groupBy("ring_name", "seq_a", "seq_b").agg(F.sum("length").alias("shared")).where(F.col("shared") > threshold)


def endpoints_once(lines: DataFrame, line: str = "line") -> DataFrame:
    """Places that are an end of exactly one line."""
    ends = lines.select(F.explode(F.array(F.element_at(line, 1), F.element_at(line, -1))).alias("p"))
    return ends.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("x", "y")


def neighbours(points: DataFrame, topo: DataFrame) -> DataFrame:
    """Points with the ``next`` and the ``previous`` site of their ring, null at its ends."""
    after = topo.select(F.col("near_end").alias("site_id"), F.col("far_end").alias("next"))
    before = topo.select(F.col("far_end").alias("site_id"), F.col("near_end").alias("previous"))
    return points.join(after, "site_id", "left").join(before, "site_id", "left")


def lighter(edges: DataFrame, nodes: DataFrame, fiber: DataFrame, reach: float = 20.0, divisor: float = 3.0) -> DataFrame:
    """Costed roads whose ends are both within reach of earlier fiber (``ax, ay, bx, by``), made cheaper by the divisor."""
    near = near_line(nodes.select("node_id", "x", "y"), fiber, reach).select("node_id").distinct()
    side = lambda end: near.select(F.col("node_id").alias(end), F.lit(True).alias(f"__{end}"))
    out = edges.join(side("node_start"), "node_start", "left").join(side("node_end"), "node_end", "left")
    along = F.col("__node_start").isNotNull() & F.col("__node_end").isNotNull()
    return out.withColumn("weight", F.when(along, F.col("weight") / divisor).otherwise(F.col("weight"))).drop("__node_start", "__node_end")


def coordinate_counts(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    return lines.select(key, F.explode(line).alias("p")).groupBy(key, "p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))


def duplicate_score(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Sum of squared counts of the places a line passes more than once."""
    c = coordinate_counts(lines, key, line)
    return c.groupBy(key).agg(F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("n")).otherwise(0)).cast("long").alias("score"))


def edge_costs(edges: DataFrame, nodes: DataFrame, kind: str = "full_weighted", cable_cost: float = 35_000.0, fiber_cost: float = 10_000.0, full_fiber_cost: float = 100.0, avoid_railway: bool = True) -> DataFrame:
    """Road edges, one for each unordered pair of nodes (the last by ``ord``), with ``weight``.

    An edge is fiber only if both its nodes are; road classes weigh 1, residential 2, paths and
    motorways 99.
    """
    heavy = ("path", "footway", "cycleway", "pedestrian", "track", "motorway")  # fixed values
    pair = [F.least("node_start", "node_end").alias("node_start"), F.greatest("node_start", "node_end").alias("node_end")]
    has = edges.columns
    ordinal = F.col("ord") if "ord" in has else F.struct("length", "highway")
    charge = F.col("build_charge") if "build_charge" in has and avoid_railway else F.lit(0.0)
    rows = edges.select(*pair, F.struct(ordinal.alias("o"), "length", "highway", charge.alias("charge")).alias("r"))
    one = rows.groupBy("node_start", "node_end").agg(F.max("r").alias("r")).select("node_start", "node_end", F.col("r.length").alias("length"), F.col("r.highway").alias("highway"), F.col("r.charge").alias("charge"))
    fo = nodes.where("ref_fo = 1").select(F.col("node_id").alias("n")).distinct()
    for side in ("node_start", "node_end"):
        one = one.join(fo.withColumnRenamed("n", side).withColumn(f"__{side}", F.lit(1)), side, "left")
    fiber = F.col("__node_start").isNotNull() & F.col("__node_end").isNotNull()
    road = F.when(F.col("highway") == "residential", 2).when(F.col("highway").isin(*heavy), 99).otherwise(1)
    cost = {
        "fiber": F.when(fiber, fiber_cost).otherwise(cable_cost) * F.col("length"),
        "full_fiber": F.when(fiber, full_fiber_cost).otherwise(cable_cost) * F.col("length"),
        "full_weighted": F.when(fiber, fiber_cost).otherwise(cable_cost) * F.col("length") * road + F.col("charge"),
    }.get(kind, F.col("length"))
    return one.withColumn("fiber", fiber).withColumn("weight", cost.cast("double")).drop("__node_start", "__node_end", "charge")


def kmeans(points: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Points with ``label``, their cluster by straight distance where no road network is at hand."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("__at", array_to_vector(F.array(F.col("x").cast("double"), F.col("y").cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="__at", predictionCol="label").fit(rows.where("x is not null and y is not null"))
    return model.transform(rows.where("x is not null and y is not null")).drop("__at")


def hub_assignment(points: DataFrame, hubs: DataFrame, max_distance: float = 10_000.0, use_centroid: bool = False, ring: str = "ring_name") -> DataFrame:
    """``ring, outcome, hub_id, flag``: what becomes of each ring of sites (``ring, site_id, x, y``).

    ``hubs`` within reach in a straight line: ``assigned``, a row for the start and one for the end
    (the nearest two). None in reach: ``standalone`` if the ring is one site; else, with
    ``use_centroid``, ``centroid``: the site nearest to the mean of the ring's places is its hub;
    else ``dropped``.
    """
    near = stored(ring_hubs(points, hubs, max_distance, ring).select(ring, F.lit("assigned").alias("outcome"), "hub_id", "flag"))
    lone = dealt(points.select(ring, "site_id", "x", "y"), points, ring).join(near.select(ring).distinct(), ring, "left_anti")
    size = lone.groupBy(ring).agg(F.count(F.lit(1)).alias("n"))
    middle = ring_centroids(lone, ring).withColumnsRenamed({"x": "mx", "y": "my"})
    far = geo.distance2(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))
    closest = lone.join(middle, ring).groupBy(ring).agg(F.min_by("site_id", F.struct(far, F.col("site_id"))).alias("hub_id"))
    outcome = F.when(F.col("n") < 2, "standalone").otherwise("centroid" if use_centroid else "dropped")
    rest = size.join(closest, ring).withColumn("outcome", outcome)
    own = F.col("outcome") == "centroid"
    return near.unionByName(rest.select(ring, "outcome", F.when(own, F.col("hub_id")).alias("hub_id"), F.when(own, "start").alias("flag")))
