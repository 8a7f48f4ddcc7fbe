"""Lines joined where exactly two of them meet, by list ranking: no key and no network is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.functions import geo
from fiberloom.operators.components import connected
from fiberloom.operators.tables import numbered
from fiberloom.runtime import stored

#: Rows that a partition of a round holds about; small rounds get few partitions.
ROWS = 50_000


def _ends(rows: DataFrame, key: str) -> DataFrame:
    """Both ends of each line: ``id``, ``side`` (0 where it starts) and its place, to a millionth."""
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    end = F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("p")), F.struct(F.lit(1).alias("side"), last.alias("p")))).alias("e")
    return rows.select(key, "id", end).select(key, "id", "e.side", F.round("e.p.x", 6).alias("__x"), F.round("e.p.y", 6).alias("__y"))


def joints(rows: DataFrame, key: str) -> DataFrame:
    """``a, a_side, b, b_side`` where the ends of just two lines of a key meet, and no other. A hub is a count, not a list."""
    end = F.struct("id", "side")
    met = _ends(rows, key).groupBy(key, "__x", "__y").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("a"), F.max(end).alias("b"))
    met = met.where("n = 2 and a.id <> b.id")
    return met.select(F.col("a.id").alias("a"), F.col("a.side").alias("a_side"), F.col("b.id").alias("b"), F.col("b.side").alias("b_side"))


def _followers(met: DataFrame, rows: DataFrame) -> DataFrame:
    """``d, to``: the way that follows each. Way ``2 * id + 1`` runs along a line, ``2 * id`` against it; a ring is cut where its first line starts."""
    way = lambda d, to: F.struct(d.alias("d"), to.alias("to"))
    both = [
        way(2 * F.col("a") + F.col("a_side"), 2 * F.col("b") + 1 - F.col("b_side")),
        way(2 * F.col("b") + F.col("b_side"), 2 * F.col("a") + 1 - F.col("a_side")),
    ]
    links = met.select(F.explode(F.array(*both)).alias("w")).select("w.d", "w.to")
    group = stored(connected(met.select("a", "b")))
    n_joints = met.join(group, F.col("a") == F.col("id")).groupBy("component").agg(F.count(F.lit(1)).alias("joints"))
    lines = group.join(rows.select("id", "ord"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("lines"), F.min(F.struct("ord", "id")).alias("first"))
    cut = stored(n_joints.join(lines, "component").where("joints = lines").select((2 * F.col("first.id")).alias("cut")))
    return links.join(cut, F.col("d") == F.col("cut"), "left_anti").join(cut, F.col("to") == F.col("cut") + 1, "left_anti")


def ranked(links: DataFrame) -> DataFrame:
    """``d, last, left``: the last way that each of ``links`` (``d, to``, no rings) leads to, and how many follow it; by pointer jumping.

    Every round doubles how far a way sees, so the rounds are the logarithm of the longest chain.
    """
    ends = links.select(F.col("to").alias("d")).join(links.select("d"), "d", "left_anti")
    done = ends.select("d", F.col("d").alias("to"), F.lit(0).cast("long").alias("left"), F.lit(True).alias("done"))
    state = stored(links.select("d", "to", F.lit(1).cast("long").alias("left"), F.lit(False).alias("done")).unionByName(done))
    while True:
        n, open_ = state.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).first()
        if not open_:
            return state.select("d", F.col("to").alias("last"), "left")
        ahead = state.select(F.col("d").alias("to"), F.col("to").alias("then"), F.col("left").alias("more"), F.col("done").alias("ended"))
        jumped = state.where("not done").join(ahead, "to").select("d", F.col("then").alias("to"), (F.col("left") + F.col("more")).alias("left"), F.col("ended").alias("done"))
        state = stored(state.where("done").unionByName(jumped).coalesce(-(-n // ROWS)))


def _length(line: Column) -> Column:
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: geo.distance2(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, d2: total + F.sqrt(d2))


def merged(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """``key, part, line, length``: lines of a key joined where the ends of exactly two meet, to a millionth; rings close.

    ``lines`` has ``key``, ``ord`` and the points of each line. What results runs along its first line by ``ord``, a ring
    from where that line starts; ``part`` numbers the results of a key from 0 in that order. Lines without
    two points, or null, are left out; a null key is a key of its own; equal lines are lines of their own and
    make a ring where nothing else meets them. Other columns are dropped. One resulting line is one row, the only thing that is held whole.
    """
    rows = stored(lines.select(F.col(f"`{key}`").alias("__key"), "ord", F.col(f"`{line}`").alias("line")).where("size(line) > 1").withColumn("id", F.monotonically_increasing_id()))
    met = stored(joints(rows, "__key"))
    ways = ranked(_followers(met, rows))
    ways = ways.withColumn("id", F.expr("d div 2")).withColumn("along", F.col("d") % 2 == 1)
    short = rows.select("__key", "id", "ord")
    ways = stored(ways.join(short, "id"))
    # A chain stands in the table both ways; the one that runs along its first line stays.
    first = ways.groupBy("last").agg(F.min(F.struct("ord", "id", "along")).alias("first")).where("first.along").select("last", "first.ord", "first.id")
    chosen = ways.drop("ord").withColumnRenamed("id", "line_id").join(first, "last").select("__key", "last", "left", "along", "line_id", "ord", "id")
    alone = short.join(ways.select("id"), "id", "left_anti").select("__key", F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("left"), F.lit(True).alias("along"), F.col("id").alias("line_id"), "ord", "id")
    chosen = stored(chosen.unionByName(alone))
    points = chosen.join(rows.select(F.col("id").alias("line_id"), "line"), "line_id").withColumn("line", F.when(F.col("along"), F.col("line")).otherwise(F.reverse("line")))
    chains = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "line"))).alias("of"))
    whole = chains.select("id", F.flatten(F.transform("of", lambda x, i: F.when(i == 0, x["line"]).otherwise(F.slice(x["line"], 2, F.size(x["line"]))))).alias("line"))
    # Numbers over all results, less the first of the key: no key is sorted in one task.
    places = numbered(chosen.where("line_id = id").select("__key", "ord", "id"), ["__key", "ord", "id"], "__no")
    least = places.groupBy(F.col("__key").alias("__k")).agg(F.min("__no").alias("__least"))
    least = F.broadcast(least) if least.count() <= ROWS else least
    places = places.join(least, F.col("__key").eqNullSafe(F.col("__k"))).select("__key", "id", (F.col("__no") - F.col("__least")).cast("int").alias("part"))
    return places.join(whole, "id").select(F.col("__key").alias(key), "part", "line", _length(F.col("line")).alias("length"))
