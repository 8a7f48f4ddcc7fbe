"""Pairs in reach where the points are dense in places: quadtree leaves in place of cells of one width.

The right side lies in leaves cut by its counts; a left row goes to the leaves whose points its
circle may touch. A leaf that many left rows touch, or that holds many points at one place, is dealt
into buckets of bounded sides. So the pairs tested in any bucket are bounded, and a left row is copied
about as often as it has pairs by the thousand, not nine times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators import quadtree
from fiberloom.runtime import durable

#: Right rows of a leaf, and left rows that meet them in one bucket.
RIGHT, LEFT = 1_000, 4_000
#: Leaves that may be broadcast: their base cell, name, box of four numbers and two counts, some 10 MB.
BROADCAST_LEAVES = 100_000
#: Digits of a leaf below its base cell at most; more points than ``RIGHT`` within such a leaf are dealt into buckets.
DEEPER = 10


def _gap(v: Column, low: str, high: str) -> Column:
    return F.greatest(F.col(low) - v, v - F.col(high), F.lit(0.0))


def buckets(left: DataFrame, right: DataFrame, radius: float, *, at: tuple[str, str] = ("x", "y"), to: tuple[str, str] = ("bx", "by"), most: int = RIGHT, guests: int = LEFT) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with ``__leaf, __a, __b``: pairs in reach meet in exactly one bucket. None where a side has no point.

    Buckets hold some ``most`` right and ``guests`` left rows at most.
    """
    (lx, ly), (rx, ry) = at, to
    left = left.where(F.col(lx).isNotNull() & F.col(ly).isNotNull())
    right = right.where(F.col(rx).isNotNull() & F.col(ry).isNotNull())
    own = quadtree.Square.around(right, at=to)
    if own is None:
        return None
    floor = max(0, min(20, math.floor(math.log2(own.side / radius)))) if radius > 0 else 20
    depth = floor + DEEPER
    names = lambda x, y: quadtree.path(own, x, y, depth)
    leaf_of = durable(quadtree.cut(right.select(names(F.col(rx), F.col(ry)).alias("path")), most, depth, floor))
    placed = right.withColumn("__path", names(F.col(rx), F.col(ry))).join(leaf_of.select(F.col("path").alias("__path"), F.col("leaf").alias("__leaf")), "__path").drop("__path")
    placed = durable(placed)
    boxes = placed.groupBy("__leaf").agg(F.min(rx).alias("__lx"), F.max(rx).alias("__hx"), F.min(ry).alias("__ly"), F.max(ry).alias("__hy"), F.count(F.lit(1)).alias("__nr"))
    boxes = durable(boxes.withColumn("__base", F.substring("__leaf", 1, floor)))
    small = boxes.count() <= BROADCAST_LEAVES
    # Base cells are as wide as the reach at least, so a circle touches three in a row at most.
    span = lambda c, low: F.sequence(*[quadtree.place(F.col(c) + d, low, own.side, floor) for d in (-radius, radius)])
    dealt = left.withColumn("__i", F.explode(span(lx, own.x))).withColumn("__j", F.explode(span(ly, own.y)))
    dealt = dealt.withColumn("__base", quadtree.path_of(F.col("__i"), F.col("__j"), floor)).drop("__i", "__j")
    met = dealt.join(F.broadcast(boxes) if small else boxes, "__base")
    gaps = _gap(F.col(lx), "__lx", "__hx"), _gap(F.col(ly), "__ly", "__hy")
    met = met.where(gaps[0] * gaps[0] + gaps[1] * gaps[1] <= radius * radius).drop("__base", "__lx", "__hx", "__ly", "__hy")
    met = durable(met)
    counts = met.groupBy("__leaf").agg(F.count(F.lit(1)).alias("__nl"))
    sizes = boxes.select("__leaf", "__nr").join(counts, "__leaf")
    sizes = durable(sizes.select("__leaf", F.ceil(F.col("__nl") / guests).alias("__na"), F.ceil(F.col("__nr") / most).alias("__nb")))
    sizes = F.broadcast(sizes) if small else sizes
    deal = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # Rows at one place are dealt by their other columns too, and equal ones by their place in the table.
    guests_ = met.drop("__nr").join(sizes, "__leaf").withColumn("__u", F.monotonically_increasing_id())
    hosts = placed.join(sizes, "__leaf").withColumn("__u", F.monotonically_increasing_id())
    l = guests_.withColumn("__a", deal("__na", "__u")).withColumn("__b", every("__nb")).drop("__u", "__na", "__nb")  # noqa: E741
    r = hosts.withColumn("__b", deal("__nb", "__u")).withColumn("__a", every("__na")).drop("__u", "__na", "__nb")
    return l, r


def within_radius(left: DataFrame, right: DataFrame, radius: float, *, at: tuple[str, str] = ("x", "y"), to: tuple[str, str] = ("bx", "by"), most: int = RIGHT, guests: int = LEFT) -> DataFrame:
    """As :func:`spatial.within_radius`, at any density: all pairs at most ``radius`` apart, with ``d2``."""
    (lx, ly), (rx, ry) = at, to
    d2 = geo.distance2(F.col(lx), F.col(ly), F.col(rx), F.col(ry))
    sides = buckets(left, right, radius, at=at, to=to, most=most, guests=guests)
    if sides is None:
        return left.join(right, F.lit(False)).withColumn("d2", d2)
    met = sides[0].join(sides[1], ["__leaf", "__a", "__b"])
    return met.withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)], "d2")
