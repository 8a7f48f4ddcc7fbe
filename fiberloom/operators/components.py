"""Connected components over a DataFrame of links, by alternating stars; any orderable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.runtime import durable, few

#: Links that a partition holds about; small rounds get few partitions.
LINKS = 20_000


def _least(state: DataFrame) -> DataFrame:
    """``(u, m)``: the least smaller neighbour of each vertex that has one; combined before the shuffle."""
    return durable(state.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))


def connected(links: DataFrame, vertices: DataFrame | None = None, *, rounds: int = 60) -> DataFrame:
    """``(id, component)``: the least id each vertex reaches. ``vertices`` (column ``id``) adds isolated ones.

    Links point from the larger ``a`` to the smaller ``b``. The large star moves each link to the
    least neighbour of ``b``, where it has a smaller one; a hub that is the least of its component
    has none, so its links stay where they are. The small star links all smaller neighbours of
    ``a`` to the least of them. Joins are broadcast if the table of least neighbours is small; beyond
    that, both sides come from a checkpoint, so that a hub's partition can be split at run time.
    """
    state = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        state = state.coalesce(-(-now[0] // LINKS) or 1)
        large = state.join(few(_least(state)), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = durable(large).coalesce(-(-now[0] // LINKS) or 1)
        met = large.join(few(_least(large)), F.col("a") == F.col("u"))
        small = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        state = durable(small.select("x.a", "x.b").where("a <> b").distinct())
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    out = state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    if vertices is None:
        return out
    return vertices.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
