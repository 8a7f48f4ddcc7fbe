"""Complete linkage of groups of any size: reciprocal nearest neighbours merge in rounds over a table of pairs.

Two clusters that are each other's nearest merge in any order of merging, as a merger is never
nearer to a third than the nearer of its two parts was. So all such pairs of all groups merge in one round, and
the pairs that are left take the larger distance. A pair of clusters stays only while all pairs of
their members are known. Ties go to the least first, then the least second cluster, as in the plain
form :func:`network.complete_linkage`, and its labels are found exactly.

Sites at one place are 0 apart and merge first, in order of their names. So a cluster holds of each of its
places the first few sites, and what is cut off are single ones: places with their numbers are linked, never sites.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.operators import network
from fiberloom.operators.components import connected
from fiberloom.runtime import durable, few, stored

#: Places of a group that are linked as a matrix in one task, 128 MB of it, or sites if it has no more.
IN_TASK = 4_000
#: Mergers of a round that may be broadcast, of three short texts each.
BROADCAST_MERGERS = 100_000


def mergers(pairs: DataFrame, group: str) -> DataFrame:
    """``group, d, keep, gone``: every merger of complete linkage over the pairs ``group, a, b, d`` (a < b), each cluster named by its least member.

    Two clusters merge only where all pairs of their members are in the table. A round takes an
    aggregation for the nearest neighbours and one for the new distances.
    """
    edges, out = stored(pairs.select(group, "a", "b", F.col("d").cast("double").alias("d")).groupBy(group, "a", "b").agg(F.min("d").alias("d"))), None
    while not edges.isEmpty():
        key = F.struct("d", "a", "b").alias("k")
        nearest = edges.select(group, F.explode(F.array("a", "b")).alias("c"), key).groupBy(group, "c").agg(F.min("k").alias("k"))
        mutual = nearest.groupBy(group, "k").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        now = stored(mutual.select(group, F.col("k.d").alias("d"), F.col("k.a").alias("keep"), F.col("k.b").alias("gone")))
        out = now if out is None else out.unionByName(now)
        # Each end with the name of its cluster and how many of the clusters of before it is made of.
        parts = now.select(group, F.explode(F.array("keep", "gone")).alias("c"), F.col("keep").alias("name"))
        small = now.count() <= BROADCAST_MERGERS

        def named(rows: DataFrame, end: str) -> DataFrame:
            side = parts.select(group, F.col("c").alias(end), F.col("name").alias("to"))  # noqa: B023
            met = rows.join(F.broadcast(side) if small else side, [group, end], "left")  # noqa: B023
            return met.withColumn(f"n{end}", F.when(F.col("to").isNull(), 1).otherwise(2)).withColumn(end, F.coalesce("to", end)).drop("to")

        met = named(named(edges, "a"), "b").where("a <> b")
        met = met.withColumn("due", F.col("na") * F.col("nb")).select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d", "due")
        whole = met.groupBy(group, "a", "b").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"), F.max("due").alias("due"))
        edges = stored(whole.where("n = due").select(group, "a", "b", "d"))
    return out if out is not None else pairs.select(group, F.col("d").cast("double").alias("d"), F.col("a").alias("keep"), F.col("b").alias("gone")).limit(0)


def _labels(items: DataFrame, merged: DataFrame, group: str) -> DataFrame:
    """``group, id, label`` of items (``group, id``) after the mergers: the least member that they lead to."""
    name = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("i"))
    found = connected(merged.select(name("keep").alias("a"), name("gone").alias("b")))
    found = found.select(F.col("id.g").alias(group), F.col("id.i").alias("id"), F.col("component.i").alias("label"))
    return items.join(found.distinct(), [group, "id"], "left").withColumn("label", F.coalesce("label", "id"))


def by_rounds(sites: DataFrame, dist: DataFrame, group: str, max_distance: float, expectation: int, tolerance: int, rounds: int = 5) -> DataFrame:
    """As :func:`network.cluster`, without a matrix: ``group, site_id, label``.

    Sites at one node are 0 apart; ``dist`` has the pairs of each node's least site. A cluster
    larger than expected is cut where its mergers, in order of distance, leave ceil(n / expectation) groups.
    """
    heads = sites.groupBy(group, "node").agg(F.min("site_id").alias("id"))
    homes = durable(sites.select(group, "site_id", "node").distinct().join(heads, [group, "node"]).select(group, "site_id", F.col("id").alias("head")))
    i, j = F.col("site_i"), F.col("site_j")
    known = dist.where("site_i <> site_j").select(group, F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), F.col("dist").alias("d"))
    for end in ("a", "b"):
        known = known.join(heads.select(group, F.col("id").alias(end)), [group, end], "left_semi")
    known = stored(known.where(F.col("d") < max_distance).groupBy(group, "a", "b").agg(F.min("d").alias("d")))
    first = _labels(heads.select(group, "id"), mergers(known, group), group)
    labels = stored(homes.join(first.withColumnRenamed("id", "head"), [group, "head"]).select(group, "site_id", "head", "label"))
    for _ in range(rounds):
        sizes = labels.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > expectation + tolerance)
        sizes = durable(sizes)
        if sizes.isEmpty():
            break
        big = durable(labels.join(sizes.select(group, "label"), [group, "label"], "left_semi"))
        # Within each large cluster: the sites of one node first, then its nodes by their distances.
        inner = durable(big.groupBy(group, "label", "head").agg(F.min("site_id").alias("id")))
        cell = F.to_json(F.struct(group, "label")).alias("cell")
        zero = big.join(inner, [group, "label", "head"]).where("site_id <> id").select(cell, F.lit(0.0).alias("d"), F.col("id").alias("keep"), F.col("site_id").alias("gone"))
        of = lambda k: inner.select(group, F.col("head").alias(k), F.col("label").alias(f"l{k}"), F.col("id").alias(f"i{k}"))  # noqa: B023, E731
        pairs = known.join(of("a"), [group, "a"]).join(of("b"), [group, "b"]).where("la = lb").withColumn("label", F.col("la"))
        # One node's sites may lie in several clusters once they were cut; each of them has a head of its own there.
        pairs = pairs.select(cell, F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "d")
        every = zero.unionByName(mergers(pairs, "cell"))
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("d", "keep", "gone"))
        due = sizes.select(cell, (F.col("n") - F.ceil(F.col("n") / expectation)).alias("due"))
        done = stored(every.withColumn("nth", nth).join(due, "cell").where("nth <= due").select("cell", "keep", "gone"))
        cut = _labels(big.select(cell, F.col("site_id").alias("id")), done, "cell").select("cell", F.col("id").alias("site_id"), F.col("label").alias("to"))
        renamed = big.select(group, "site_id", "head", "label", cell).join(cut, ["cell", "site_id"]).select(group, "site_id", "head", F.col("to").alias("label"))
        labels = stored(labels.join(sizes.select(group, "label"), [group, "label"], "left_anti").unionByName(renamed))
    return labels.select(group, "site_id", "label")


def _cut(m: np.ndarray, label: np.ndarray, held: np.ndarray, expectation: int, tolerance: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`network.resplit` for places: the cluster of each, and how many of its ``held`` first sites are in it."""
    label, held = label.copy(), held.copy()
    for _ in range(rounds):
        members = pd.Series(np.arange(len(label))).groupby(label).indices
        big = [k for k in members.values() if held[k].sum() > expectation + tolerance]
        if not big:
            break
        for k in big:
            total = int(held[k].sum())
            groups = math.ceil(total / expectation)
            if groups < len(k):  # each place is whole, and places merge
                label[k] = k[network.complete_linkage(m[np.ix_(k, k)], groups=groups)]
                continue
            left = total - groups  # mergers of sites at one place, place by place
            for i in k:
                now = min(left, int(held[i]) - 1)
                label[i], held[i], left = i, now + 1, left - now
    return label, held


def by_places(sites: DataFrame, dist: DataFrame, group: str, max_distance: float, expectation: int, tolerance: int, rounds: int = 5) -> DataFrame:
    """As :func:`network.cluster`: ``group, site_id, label``. A group's places meet in one task, with their numbers of sites, which never do.

    ``sites`` has ``group, site_id, node``; ``dist`` the pairs of each node's least site. Nodes 0 apart are one place, as roads of no length have it.
    """
    heads = stored(sites.groupBy(group, "node").agg(F.min("site_id").alias("head"), F.count(F.lit(1)).alias("w")))
    i, j = F.col("site_i"), F.col("site_j")
    known = dist.where("site_i <> site_j").select(group, F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), "dist")
    same = durable(known.where("dist = 0").groupBy(group, F.col("b").alias("head")).agg(F.min("a").alias("to")))
    if not same.isEmpty():
        heads = stored(heads.join(same, [group, "head"], "left").withColumn("head", F.coalesce("to", "head")).drop("to"))
    places = heads.groupBy(group, "head").agg(F.sum("w").alias("w"))
    places = stored(places.withColumn("no", F.row_number().over(Window.partitionBy(group).orderBy("head")) - 1))
    for end in ("a", "b"):
        known = known.join(places.select(group, F.col("head").alias(end), F.col("no").alias(f"n{end}")), [group, end])
    pairs = known.select(group, "na", "nb", "dist")

    def run(key, p: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("no")
        m = np.full((len(p), len(p)), 1e10)
        np.minimum.at(m, (d["na"].to_numpy(np.int64), d["nb"].to_numpy(np.int64)), d["dist"].to_numpy(float))
        m = np.minimum(m, m.T)
        np.fill_diagonal(m, 0.0)
        base = np.array(network.complete_linkage(m, limit=max_distance), dtype=int)
        label, held = _cut(m, base, p["w"].to_numpy(np.int64), expectation, tolerance, rounds)
        ids = p["head"].to_numpy(object)
        return pd.DataFrame({group: key[0], "head": ids, "label": ids[label], "held": held})

    kind = sites.schema[group].dataType.simpleString()
    found = places.groupBy(group).cogroup(pairs.groupBy(group)).applyInPandas(run, f"{group} {kind}, head string, label string, held long")
    found = few(stored(heads.select(group, "node", "head").join(found, [group, "head"])))
    nth = F.row_number().over(Window.partitionBy(group, "head").orderBy("site_id"))
    own = sites.join(found, [group, "node"]).withColumn("nth", nth)
    return own.select(group, "site_id", F.when(F.col("nth") <= F.col("held"), F.col("label")).otherwise(F.col("site_id")).alias("label"))


def cluster(sites: DataFrame, dist: DataFrame, group: str, max_distance: float, expectation: int = 10, tolerance: int = 2, in_task: int = IN_TASK) -> DataFrame:
    """As :func:`network.cluster`. Groups of up to ``in_task`` sites go through one task each, with more sites their places do; those of more places go through rounds.

    All give the same labels. ``sites`` has ``group, site_id`` and, if several share a place, ``node``.
    """
    if "node" not in sites.columns:
        sites = sites.withColumn("node", F.col("site_id"))
    sites = stored(sites.select(group, "site_id", "node"))
    sizes = sites.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node").alias("places")).where(F.col("n") > in_task)
    large = stored(sizes)
    if large.isEmpty():
        return network.cluster(sites, dist, group, max_distance, expectation, tolerance)
    dist = durable(dist)
    pick = lambda rows, of, how: rows.join(of.select(group), group, how)
    out = network.cluster(pick(sites, large, "left_anti"), pick(dist, large, "left_anti"), group, max_distance, expectation, tolerance)
    for form, which in ((by_places, F.col("places") <= in_task), (by_rounds, F.col("places") > in_task)):
        of = large.where(which)
        if not of.isEmpty():
            out = out.unionByName(form(pick(sites, of, "left_semi"), pick(dist, of, "left_semi"), group, max_distance, expectation, tolerance))
    return out
