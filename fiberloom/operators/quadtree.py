"""Cells as fine as the points demand: a quadtree cut by counts.

A cell is a text of quadrant digits, so the cells around it are its prefixes. Counts are taken
once at the finest depth and summed upwards, so the table of cells has a few rows for each cell that
is cut, however dense one place may be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.runtime import durable

#: Digits of a cell at most.
DEPTH = 14


@dataclass(frozen=True)
class Square:
    """The square that is cut, by its lower left corner and its side."""

    x: float
    y: float
    side: float

    @staticmethod
    def around(*points: DataFrame, at: tuple[str, str] = ("x", "y")) -> Square | None:
        """The least square around all points; None without any."""
        boxes = [p.agg(*[f(c) for c in at for f in (F.min, F.max)]).first() for p in points]
        boxes = [tuple(b) for b in boxes if None not in tuple(b)]
        if not boxes:
            return None
        x, y = min(b[0] for b in boxes), min(b[2] for b in boxes)
        side = max(max(b[1] for b in boxes) - x, max(b[3] for b in boxes) - y)
        return Square(x, y, max(side, 1.0) * (1 + 1e-9))


def place(v: Column, low: float, side: float, depth: int) -> Column:
    """Number of a coordinate's column or row among 2^depth; what lies outside counts to the edge."""
    n = 1 << depth
    at = F.floor((v - F.lit(float(low))) * F.lit(n / side))
    return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("long")


def path_of(i: Column, j: Column, depth: int) -> Column:
    """Digits of the cell in column ``i`` and row ``j`` of 2^depth."""
    bit = lambda c, b: F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long"))
    return F.concat(F.lit(""), *[(bit(j, b) * 2 + bit(i, b)).cast("string") for b in range(depth - 1, -1, -1)])


def path(square: Square, x: Column, y: Column, depth: int = DEPTH) -> Column:
    return path_of(place(x, square.x, square.side, depth), place(y, square.y, square.side, depth), depth)


def cut(paths: DataFrame, most: int, depth: int = DEPTH, floor: int = 0) -> DataFrame:
    """``path, leaf``: of each finest cell that holds points (column ``path``), the largest cell around it with ``most`` points at most.

    Cells have ``floor`` digits at least; cells of ``depth`` digits are not cut, whatever they hold.
    """
    finest = durable(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")))
    full, above = None, finest
    for d in range(depth - 1, floor - 1, -1):
        above = above.groupBy(F.substring("path", 1, d).alias("path")).agg(F.sum("n").alias("n"))
        some = above.where(F.col("n") > most).select("path")
        full = some if full is None else full.unionByName(some)
    if full is None:
        return finest.select("path", F.substring("path", 1, depth).alias("leaf"))
    # The cells that are cut are closed upwards, so a leaf has one digit more than the deepest of them around it.
    deepest = None
    full = durable(full)
    each = finest.select("path", F.explode(F.sequence(F.lit(floor), F.lit(depth - 1))).alias("d"))
    each = each.withColumn("cell", F.substring("path", 1, F.col("d")))
    deepest = each.join(full.withColumnRenamed("path", "cell"), "cell", "left_semi").groupBy("path").agg(F.max("d").alias("d"))
    found = finest.select("path").join(deepest, "path", "left")
    return found.select("path", F.substring(F.col("path"), F.lit(1), F.coalesce(F.col("d") + 1, F.lit(floor))).alias("leaf"))
