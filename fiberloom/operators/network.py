"""Road graph search, ring tours and clustering: one group of rows at a time, in Arrow batches.

A ring or cluster is a handful of sites, so a group fits in memory; the roads that a group needs are
joined to it by its cells before, never collected. Distances that are unreachable are missing rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.runtime import durable

UNREACHABLE = math.inf


# pure parts, on plain dictionaries ---------------------------------------------------------------


def adjacency(edges) -> dict:
    """Neighbours of each node from rows (u, v, weight); of repeated pairs the last counts."""
    graph: dict = defaultdict(dict)
    for u, v, w in edges:
        graph[u][v] = graph[v][u] = w
    return graph


def dijkstra(graph: dict, sources, cutoff: float = math.inf, goal=None, goals=None) -> tuple[dict, dict]:
    """Cost and predecessor of every node within ``cutoff`` of the nearest source; equal costs go to the lower node.

    It ends at a ``goal``, or once all ``goals`` are found.
    """
    cost, came, done = {s: 0.0 for s in sources}, {}, set()
    wanted = None if goals is None else set(goals)
    heap = [(0.0, s) for s in sorted(cost)]
    while heap:
        c, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == goal:
            break
        if wanted is not None:
            wanted.discard(u)
            if not wanted:
                break
        for v, w in graph.get(u, {}).items():
            n = c + w
            if n <= cutoff and (n < cost.get(v, math.inf) or n == cost.get(v) and v not in done and u < came.get(v, u)):
                cost[v], came[v] = n, u
                heapq.heappush(heap, (n, v))
    return {k: c for k, c in cost.items() if k in done}, came


def path(graph: dict, start, end) -> list | None:
    cost, came = dijkstra(graph, [start], goal=end)
    if end not in cost:
        return None
    out = [end]
    while out[-1] != start:
        out.append(came[out[-1]])
    return out[::-1]


def held_karp(d, start: int, end: int | None, nodes: list[int]) -> tuple[float, list[int]]:
    """Cheapest walk from ``start`` through all ``nodes`` to ``end`` (back to the start if None)."""
    last = start if end is None else end
    if not nodes:
        return d[start][last], []
    best = {(1 << i, i): (d[start][v], None) for i, v in enumerate(nodes)}
    for size in range(2, len(nodes) + 1):
        for sub in itertools.combinations(range(len(nodes)), size):
            mask = sum(1 << i for i in sub)
            for i in sub:
                rest = mask ^ (1 << i)
                best[mask, i] = min((best[rest, j][0] + d[nodes[j]][nodes[i]], j) for j in sub if j != i)
    full = (1 << len(nodes)) - 1
    cost, i = min((best[full, i][0] + d[nodes[i]][last], i) for i in range(len(nodes)))
    order, mask = [], full
    while i is not None:
        order.append(nodes[i])
        mask, i = mask ^ (1 << i), best[mask, i][1]
    return cost, order[::-1]


def tour(d, start: int, end: int | None, nodes: list[int], exact: int = 12) -> tuple[float, list[int]]:
    """As :func:`held_karp` up to ``exact`` nodes; beyond, nearest neighbour improved by 2-opt."""
    if len(nodes) <= exact:
        return held_karp(d, start, end, nodes)
    rest, walk = set(nodes), [start]
    while rest:
        walk.append(min(rest, key=lambda v: (d[walk[-1]][v], v)))
        rest.remove(walk[-1])
    walk.append(start if end is None else end)
    better = True
    while better:
        better = False
        for i in range(1, len(walk) - 2):
            for j in range(i + 1, len(walk) - 1):
                a, b, c, e = walk[i - 1], walk[i], walk[j], walk[j + 1]
                if d[a][c] + d[b][e] < d[a][b] + d[c][e] - 1e-9:
                    walk[i : j + 1] = walk[i : j + 1][::-1]
                    better = True
    return sum(d[p][q] for p, q in zip(walk, walk[1:], strict=False)), walk[1:-1]


def complete_linkage(d, limit: float | None = None, groups: int | None = None) -> list[int]:
    """Cluster of each item: merge the closest pair by largest distance while it is below ``limit`` (or down to ``groups``).

    Of equal pairs the one with the least first and then the least second cluster goes first.
    """
    n = len(d)
    far = np.array(d, dtype=float).reshape(n, n)
    far[np.tril_indices(n)] = np.inf  # each pair once, above the diagonal
    out, alive = np.arange(n), np.ones(n, dtype=bool)
    nearest = far.argmin(axis=1) if n else out
    least = far[np.arange(n), nearest]
    left = n
    while left > 1 and (groups is None or left > groups):
        i = int(least.argmin())
        j = int(nearest[i])
        if least[i] == np.inf or limit is not None and least[i] >= limit:
            break
        one, two = (np.concatenate((far[:k, k], far[k, k:])) for k in (i, j))
        both = np.maximum(one, two)
        far[:i, i], far[i, i + 1 :] = both[:i], both[i + 1 :]
        far[:j, j] = far[j, :] = np.inf
        out[out == j] = i
        alive[j], least[j] = False, np.inf
        left -= 1
        stale = np.flatnonzero(alive & ((nearest == i) | (nearest == j) | (np.arange(n) == i)))
        nearest[stale] = far[stale].argmin(axis=1)
        least[stale] = far[stale, nearest[stale]]
    return out.tolist()


def resplit(d, labels: list[int], expectation: int, tolerance: int = 0, rounds: int = 5, at=None) -> list[int]:
    """Split clusters larger than expected into ceil(n / expectation) groups, a few times over.

    ``at`` gives each item's row of ``d`` where several items share one.
    """
    labels, d = list(labels), np.asarray(d, dtype=float)
    at = np.arange(len(labels)) if at is None else np.asarray(at)
    for _ in range(rounds):
        held = defaultdict(list)
        for i, x in enumerate(labels):
            held[x].append(i)
        big = [members for members in held.values() if len(members) > expectation + tolerance]
        if not big:
            break
        for members in big:
            rows = at[members]
            sub = complete_linkage(d[np.ix_(rows, rows)], groups=math.ceil(len(members) / expectation))
            for i, x in zip(members, sub, strict=True):
                labels[i] = members[x]
    return labels


def walk_ring(pairs, start) -> list:
    """Breadth-first order over near/far pairs from the first hub; branches follow in the pairs' order."""
    nxt: dict = defaultdict(list)
    for a, b in pairs:
        nxt[a].append(b)
        nxt[b].append(a)
    out, queue, seen = [], [start], {start}
    while queue:
        u = queue.pop(0)
        out.append(u)
        for v in nxt[u]:
            if v not in seen:
                seen.add(v)
                queue.append(v)
    return out


def hops(graph: dict, nodes, k: int) -> set:
    """Nodes at most k edges from any of the given ones."""
    seen = frontier = set(nodes)
    for _ in range(k):
        frontier = {v for u in frontier for v in graph.get(u, ())} - seen
        seen = seen | frontier
    return seen


def insert_members(order: list, near: dict, rank: dict, limit: int, count) -> list:
    """Insert new sites after their near end, in order of distance, until ``count`` of the ring reaches the limit."""
    out = list(order)
    for site in sorted(near, key=lambda s: (rank[s], s)):
        if count(out) >= limit or near[site] not in out:
            continue
        at = out.index(near[site]) + 1
        while at < len(out) and out[at] in near and near[out[at]] == near[site]:
            at += 1
        out.insert(at, site)
    return out


# group functions --------------------------------------------------------------------------------


def distances(sites: DataFrame, edges: DataFrame, group: str, cutoff: float = math.inf) -> DataFrame:
    """``group, site_i, site_j, dist``: road distance of every ordered pair of a group's sites within the cutoff.

    ``sites`` has ``group, site_id, node``; ``edges`` has ``group, node_start, node_end, weight``.
    Sites at one node are 0 apart. Where ``sites`` has ``asked``, only pairs from those rows are wanted.
    """
    asks = "asked" in sites.columns

    def run(key, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(e[["node_start", "node_end", "weight"]].itertuples(index=False))
        at, asked = defaultdict(list), defaultdict(list)
        for site, node, wanted in zip(s["site_id"], s["node"], s["asked"] if asks else itertools.repeat(True), strict=False):
            at[node].append(site)
            if wanted:
                asked[node].append(site)
        rows = []
        for node, here in asked.items():
            cost, _ = dijkstra(graph, [node], cutoff)
            cost[node] = 0.0
            rows += [(key[0], i, j, float(cost[n])) for n, there in at.items() if n in cost for i in here for j in there if i != j]
        return pd.DataFrame(rows, columns=[group, "site_i", "site_j", "dist"])

    kind = sites.schema[group].dataType.simpleString()
    return sites.groupBy(group).cogroup(edges.groupBy(group)).applyInPandas(run, f"{group} {kind}, site_i string, site_j string, dist double")


#: Starts of a net that one task searches from.
STARTS = 200


def pair_distances(pairs: DataFrame, edges: DataFrame, net: str) -> DataFrame:
    """``net, node_i, node_j, dist`` of pairs ``net, node_i, node_j`` that are linked by the roads ``net, node_start, node_end, weight``.

    A net's starts are dealt over parts of about ``STARTS``, each with the roads; a search ends with the last node that is asked of it.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    pairs = durable(pairs.select(net, long("node_i"), long("node_j")).distinct())
    parts = durable(pairs.groupBy(net).agg(F.ceil(F.count_distinct("node_i") / STARTS).cast("int").alias("__parts")))
    asked = pairs.join(parts, net).withColumn("__part", F.pmod(F.xxhash64("node_i"), F.col("__parts")).cast("int"))
    roads = edges.select(net, "node_start", "node_end", "weight").join(parts, net).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))

    def run(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(e[["node_start", "node_end", "weight"]].itertuples(index=False))
        rows = []
        for i, to in p.groupby("node_i")["node_j"]:
            cost, _ = dijkstra(graph, [i], goals=to)
            rows += [(key[0], i, j, float(cost[j])) for j in to if j in cost]
        return pd.DataFrame(rows, columns=[net, "node_i", "node_j", "dist"])

    kind = pairs.schema[net].dataType.simpleString()
    return asked.groupBy(net, "__part").cogroup(_fresh(roads).groupBy(net, "__part")).applyInPandas(run, f"{net} {kind}, node_i long, node_j long, dist double")


#: Groups that share a net and a task, about.
PART = 32


def _over(rows: DataFrame, edges: DataFrame, group: str, of: DataFrame | None):
    """Rows of groups beside their roads: each group's own, or, by ``of`` (``group, net``), the roads of a net beside some of its groups."""
    if of is None:
        return rows.groupBy(group).cogroup(edges.groupBy(group))
    parts = of.groupBy("net").agg(F.ceil(F.count(F.lit(1)) / PART).alias("__parts"))
    of = durable(of.join(parts, "net").select(group, "net", F.pmod(F.xxhash64(group), "__parts").alias("part")))
    dealt = edges.join(of.select("net", "part").distinct(), "net")
    return _fresh(rows.join(of, group)).groupBy("net", "part").cogroup(_fresh(dealt).groupBy("net", "part"))


def routes(pairs: DataFrame, edges: DataFrame, group: str, feedback: float | None = None, of: DataFrame | None = None) -> DataFrame:
    """Cheapest path of each hop: ``group, seq, start, end, nodes, cost, length``.

    With ``of`` (``group, net``) the edges are those of nets that groups share.

    ``pairs`` has ``group, seq, start, end``. With ``feedback`` the hops are routed in order and the
    edges that one has used cost the next that much less (a divisor). ``length`` adds up all
    roads with both ends on the path.
    """

    def run(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(e[["node_start", "node_end", "weight"]].itertuples(index=False))
        length = {tuple(sorted(r[:2])): r[2] for r in e[["node_start", "node_end", "length"]].itertuples(index=False)}
        rows = []
        for name, own in p.groupby(group, sort=False, dropna=False):
            used = []
            for seq, a, b in own.sort_values("seq")[["seq", "start", "end"]].itertuples(index=False):
                nodes = path(graph, a, b)
                if nodes is None:
                    rows.append((name, seq, a, b, [], None, None))
                    continue
                on, steps = set(nodes), list(zip(nodes, nodes[1:], strict=False))
                total = sum(x for (u, v), x in length.items() if u in on and v in on)
                rows.append((name, seq, a, b, nodes, float(sum(graph[u][v] for u, v in steps)), float(total)))
                if feedback:
                    for u, v in steps:
                        used.append((u, v, graph[u][v]))
                        graph[u][v] = graph[v][u] = graph[u][v] / feedback
            for u, v, w in reversed(used):  # the next group finds the roads as they were
                graph[u][v] = graph[v][u] = w
        return pd.DataFrame(rows, columns=[group, "seq", "start", "end", "nodes", "cost", "length"])

    kind = pairs.schema[group].dataType.simpleString()
    return _over(pairs, edges, group, of).applyInPandas(run, f"{group} {kind}, seq long, start long, end long, nodes array<long>, cost double, length double")


def ring_order(points: DataFrame, dist: DataFrame, ring: str = "ring_name") -> DataFrame:
    """Order of a ring's sites: from the hub and back (one hub), or from the first to the last of two.

    Pairs without a distance count as 999999. Rings with another number of hubs are ``rejected``.
    """

    def run(key, p: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["hub", "ord"], ascending=[False, True])
        ids, hubs = p["site_id"].tolist(), int(p["hub"].sum())
        if hubs not in (1, 2):
            return pd.DataFrame({ring: key[0], "site_id": ids, "place": -1, "cost": math.nan, "rejected": True})
        known = {(i, j): x for i, j, x in d[["site_i", "site_j", "dist"]].itertuples(index=False)}
        m = [[0.0 if i == j else known.get((i, j), 999_999.0) for j in ids] for i in ids]
        cost, order = tour(m, 0, 1 if hubs == 2 else None, list(range(hubs, len(ids))))
        whole = [0, *order, *([1] if hubs == 2 else [])]
        return pd.DataFrame({ring: key[0], "site_id": [ids[i] for i in whole], "place": range(len(whole)), "cost": cost, "rejected": False})

    return points.groupBy(ring).cogroup(dist.groupBy(ring)).applyInPandas(run, f"{ring} string, site_id string, place int, cost double, rejected boolean")


def cluster(sites: DataFrame, dist: DataFrame, group: str, max_distance: float, expectation: int = 10, tolerance: int = 2) -> DataFrame:
    """``group, site_id, label``: complete linkage below ``max_distance`` within a component, large clusters split again.

    Where ``sites`` has ``node``, those at one node are 0 apart and merge first; ``dist`` then needs
    only the pairs of each node's least site, and a component takes memory by its nodes, not its sites.
    """
    noded = "node" in sites.columns

    def run(key, s: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("site_id")
        ids = s["site_id"].tolist()
        first = s.drop_duplicates("node") if noded else s
        place = {x: k for k, x in enumerate(first["site_id"])}
        at = s["node"].map(dict(zip(first["node"], range(len(first)), strict=True))).to_numpy() if noded else np.arange(len(ids))
        m = np.full((len(first), len(first)), 1e10)
        i, j = (d[c].map(place) for c in ("site_i", "site_j"))
        known = (i.notna() & j.notna()).to_numpy()
        i, j, x = i[known].to_numpy(int), j[known].to_numpy(int), d["dist"].to_numpy(float)[known]
        np.minimum.at(m, (i, j), x)
        m = np.minimum(m, m.T)
        np.fill_diagonal(m, 0.0)
        heads = np.flatnonzero(~s["node"].duplicated()) if noded else np.arange(len(ids))
        base = np.array(complete_linkage(m, limit=max_distance), dtype=int)
        labels = resplit(m, heads[base[at]].tolist(), expectation, tolerance, at=at)
        return pd.DataFrame({group: key[0], "site_id": ids, "label": [ids[x] for x in labels]})

    kind = sites.schema[group].dataType.simpleString()
    return sites.groupBy(group).cogroup(dist.groupBy(group)).applyInPandas(run, f"{group} {kind}, site_id string, label string")


def silhouette(labels: DataFrame, dist: DataFrame) -> DataFrame:
    """Silhouette of each site from the pair table, in column expressions."""
    l = lambda k: labels.select(F.col("site_id").alias(f"site_{k}"), F.col("label").alias(f"label_{k}"))  # noqa: E731, E741
    pairs = dist.join(l("i"), "site_i").join(l("j"), "site_j")
    mean = pairs.groupBy("site_i", "label_i", "label_j").agg(F.avg("dist").alias("m"))
    own, other = F.min(F.when(F.col("label_i") == F.col("label_j"), F.col("m"))), F.min(F.when(F.col("label_i") != F.col("label_j"), F.col("m")))
    s = mean.groupBy("site_i").agg(own.alias("a"), other.alias("b"))
    return s.select(F.col("site_i").alias("site_id"), F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"))


def reroute(paths: DataFrame, edges: DataFrame, threshold: float = 3000.0, percent: float = 25.0, protect_hops: int = 10, of: DataFrame | None = None) -> DataFrame:
    """Single points of failure of a ring, and the hops' alternatives where they help.

    ``paths`` has ``ring_name, seq, start, end, nodes``. A hop that shares more than ``threshold``
    metres of road with an earlier one is ``spof``; its road is made dear, and the new path is
    taken (``alternative``) if its new cable is at most ``percent`` more, it shares less, and its
    length less than triples. With ``of`` (``ring_name, net``) the edges are those of nets that rings share.
    """

    def run(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        base = adjacency(e[["node_start", "node_end", "weight"]].itertuples(index=False))
        length = {tuple(sorted(r[:2])): r[2] for r in e[["node_start", "node_end", "length"]].itertuples(index=False)}
        fiber = {tuple(sorted(r[:2])): bool(r[2]) for r in e[["node_start", "node_end", "fiber"]].itertuples(index=False)}
        size = lambda nodes: sum(x for (u, v), x in length.items() if u in nodes and v in nodes)
        new = lambda nodes: sum(x for (u, v), x in length.items() if u in nodes and v in nodes and not fiber[u, v])
        rows = []
        for name, own in p.groupby("ring_name", sort=False, dropna=False):
            before: list = []
            for seq, a, b, nodes in own.sort_values("seq")[["seq", "start", "end", "nodes"]].itertuples(index=False):
                nodes, kind = list(nodes), "initial"
                safe = hops(base, {a}, protect_hops) | hops(base, {b}, protect_hops)
                shared = max((size((set(nodes) & set(q)) - safe) for q in before), default=0.0)
                if shared > threshold:
                    kind = "spof"
                    dear = {u: dict(x) for u, x in base.items()}
                    hit = set().union(*(set(nodes) & set(q) for q in before)) - safe
                    for u in hit:
                        for v in dear[u]:
                            dear[u][v] = dear[v][u] = dear[u][v] + 1e12
                    other = path(dear, a, b)
                    if other:
                        less = max((size((set(other) & set(q)) - safe) for q in before), default=0.0)
                        was, now = size(set(nodes)), size(set(other))
                        if new(set(other)) <= new(set(nodes)) * (1 + percent / 100) and less < shared and abs(now - was) < 2 * was:
                            nodes, kind = other, "alternative"
                before.append(nodes)
                rows.append((name, seq, a, b, nodes, kind, float(size(set(nodes)))))
        return pd.DataFrame(rows, columns=["ring_name", "seq", "start", "end", "nodes", "route_type", "length"])

    return _over(paths, edges, "ring_name", of).applyInPandas(run, "ring_name string, seq long, start long, end long, nodes array<long>, route_type string, length double")


def hop_lengths(paths: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """``ring_name, seq, fo_note, length``: metres of each hop's own steps on fiber (Existing) and off it (New).

    ``paths`` has ``ring_name, seq, nodes``, ``edges`` ``net, node_start, node_end, length, fiber``, and ``of`` each ring's ``net``.
    """
    n = F.greatest(F.size("nodes") - 1, F.lit(0))
    steps = F.zip_with(F.slice("nodes", F.lit(1), n), F.slice("nodes", F.lit(2), n), lambda a, b: F.struct(F.least(a, b).alias("node_start"), F.greatest(a, b).alias("node_end")))
    each = paths.select("ring_name", "seq", F.explode(steps).alias("s")).select("ring_name", "seq", "s.*").join(of, "ring_name")
    note = F.when(F.col("fiber"), "Existing").otherwise("New")
    return each.join(edges.select("net", "node_start", "node_end", "length", note.alias("fo_note")), ["net", "node_start", "node_end"]).groupBy("ring_name", "seq", "fo_note").agg(F.sum("length").alias("length"))


def _fresh(rows: DataFrame) -> DataFrame:
    """The rows with columns of their own, as both sides of a cogroup may come from one table."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def nearest_hubs(points: DataFrame, hubs: DataFrame, edges: DataFrame, group: str, max_distance: float = 10_000.0, k: int = 2) -> DataFrame:
    """``group, hub_id, dist, flag``: the k hubs nearest to any of a group's points by road, at most ``max_distance`` away.

    ``points`` has ``group, node``, ``hubs`` ``group, hub_id, node`` (the candidates of each group,
    one for each place), ``edges`` as in :func:`distances`. One search starts from all points at
    once, up to twice the distance. The nearest is the start, the last one kept the end.
    """

    def run(key, p: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        # Roads and hubs come in one frame, told apart by ``kind``.
        e, h = h[h["kind"] == "road"], h[h["kind"] == "hub"]
        graph = adjacency(e[["a", "b", "weight"]].itertuples(index=False))
        cost, _ = dijkstra(graph, sorted(set(p["node"])), 2 * max_distance)
        found = sorted((cost[n], i) for i, n in h[["hub_id", "a"]].drop_duplicates("a").itertuples(index=False) if cost.get(n, UNREACHABLE) <= max_distance)[:k]
        flags = ["start"] + ["end"] * (len(found) - 1)
        return pd.DataFrame([(key[0], i, float(c), f) for (c, i), f in zip(found, flags, strict=False)], columns=[group, "hub_id", "dist", "flag"])

    roads = edges.select(group, F.lit("road").alias("kind"), F.lit(None).cast("string").alias("hub_id"), F.col("node_start").cast("long").alias("a"), F.col("node_end").cast("long").alias("b"), "weight")
    ends = hubs.orderBy("hub_id").select(group, F.lit("hub").alias("kind"), "hub_id", F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("weight"))
    kind = points.schema[group].dataType.simpleString()
    both = _fresh(roads.unionByName(ends))
    return points.select(group, F.col("node").cast("long").alias("node")).groupBy(group).cogroup(both.groupBy(group)).applyInPandas(run, f"{group} {kind}, hub_id string, dist double, flag string")


def nearest_fiber(points: DataFrame, nodes: DataFrame, edges: DataFrame, group: str, cutoff: float) -> DataFrame:
    """``group, site_id, fiber_node, dist``: the nearest fiber node of each point by road, null beyond the cutoff.

    ``points`` has ``group, site_id, node``; ``nodes`` the fiber nodes (``group, node``). One search
    from all fiber nodes of a group at once gives every node its nearest.
    """

    def run(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(e.loc[e["kind"] == "road", ["a", "b", "weight"]].itertuples(index=False))
        fiber = sorted(set(e.loc[e["kind"] == "fiber", "a"]))
        cost, came = dijkstra(graph, fiber, cutoff)
        first: dict = {}
        for n in sorted(cost, key=lambda v: cost[v]):  # predecessors come before what they lead to
            first[n] = first[came[n]] if n in came and cost[n] > 0 else n
        rows = [(key[0], s, first.get(n), cost.get(n)) for s, n in p[["site_id", "node"]].itertuples(index=False)]
        return pd.DataFrame(rows, columns=[group, "site_id", "fiber_node", "dist"]).astype({"fiber_node": "Int64"})

    roads = edges.select(group, F.lit("road").alias("kind"), F.col("node_start").cast("long").alias("a"), F.col("node_end").cast("long").alias("b"), "weight")
    lit = nodes.select(group, F.lit("fiber").alias("kind"), F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("weight"))
    kind = points.schema[group].dataType.simpleString()
    return points.select(group, "site_id", F.col("node").cast("long").alias("node")).groupBy(group).cogroup(_fresh(roads.unionByName(lit)).groupBy(group)).applyInPandas(run, f"{group} {kind}, site_id string, fiber_node long, dist double")


def follow(pairs, start, stops: set) -> tuple[list, str]:
    """Walk from ``start`` along near/far pairs up to the first of ``stops``, and how it ended: hub, loop or dead end."""
    nxt = {}
    for a, b in pairs:
        nxt.setdefault(a, b)
    out, seen = [start], {start}
    while True:
        if out[-1] not in nxt:
            return out, "dead end"
        to = nxt[out[-1]]
        if to in seen:
            return out, "hub" if to == start and to in stops else "loop"
        out.append(to)
        seen.add(to)
        if to in stops:
            return out, "hub"


def linear_walk(segments: DataFrame, points: DataFrame) -> DataFrame:
    """``ring_name, place, site_id, ended``: points from a ring's first hub along near to far ends up to the next hub.

    ``ended`` is ``hub`` where the walk comes to one (or closes on its start), ``loop`` where it
    meets itself before, ``dead end`` where a point has no successor. Rings without a hub give
    nothing. ``segments`` has ``ring_name, seq, near_end, far_end``, ``points`` ``ring_name, seq, site_id, site_type``.
    """

    def run(key, s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        hubs = p.loc[p["site_type"].fillna("").str.lower().str.contains("hub"), "site_id"].tolist()
        if not hubs:
            return pd.DataFrame([], columns=["ring_name", "place", "site_id", "ended"])
        order, ended = follow(s.sort_values("seq")[["near_end", "far_end"]].itertuples(index=False), hubs[0], set(hubs))
        return pd.DataFrame({"ring_name": key[0], "place": range(len(order)), "site_id": order, "ended": ended})

    return segments.groupBy("ring_name").cogroup(points.groupBy("ring_name")).applyInPandas(run, "ring_name string, place int, site_id string, ended string")


def insertion_routes(order: DataFrame, edges: DataFrame, places: DataFrame, previous: DataFrame, reach: float = 50.0) -> DataFrame:
    """``ring_name, seq, near_end, far_end, existing_length, new_length, length, route_type`` of a ring after insertion.

    ``order`` has ``ring_name, place, site_id, note, node, x, y``; ``edges`` as in :func:`routes`;
    ``places`` ``ring_name, node, x, y``; ``previous`` ``ring_name, near_end, far_end, line``. A hop
    is new if either end is an insert: it is routed over the roads with a drop wire at both ends,
    and what runs along the segment it replaces is existing, from the first such place to the
    last. Two inserts in a row are held against all earlier routes of the ring and the hop before.
    Other hops keep their earlier line, drawn in either direction. Hops without a path, or
    without an earlier line, are left out.
    """
    from fiberloom.functions import kernel

    def run(key, o: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        roads, at, prev = e[e["kind"] == "road"], e[e["kind"] == "place"], e[e["kind"] == "line"]
        graph = adjacency(roads[["a", "b", "weight"]].itertuples(index=False))
        xy = {n: (x, y) for n, x, y in at[["a", "x", "y"]].itertuples(index=False)}
        drawn: dict = {}
        for a, b, line in prev[["near", "far", "line"]].itertuples(index=False):
            drawn.setdefault((a, b), [(p["x"], p["y"]) for p in line])
        o = o.sort_values("place")
        rows = list(o[["site_id", "note", "node", "x", "y"]].itertuples(index=False))
        out, before = [], None
        for i, (s, t) in enumerate(zip(rows, rows[1:], strict=False)):
            if "insert" not in (s.note, t.note):
                line = drawn.get((s.site_id, t.site_id)) or drawn.get((t.site_id, s.site_id))
                if line:
                    n = kernel.length(line)
                    out.append((key[0], i, s.site_id, t.site_id, round(n, 2), 0.0, round(n, 2), "Existing Route"))
                continue
            if s.note == t.note == "insert":
                refs = [*drawn.values(), *([before] if before else [])]
            else:
                a, b = (s.site_id, rows[i + 2].site_id if i + 2 < len(rows) else t.site_id) if t.note == "insert" else (rows[i - 1].site_id if i else s.site_id, t.site_id)
                refs = [drawn[a, b]] if (a, b) in drawn else []
            nodes = path(graph, s.node, t.node)
            if nodes is None:
                continue
            line = [(s.x, s.y), *(xy[n] for n in nodes if n in xy), (t.x, t.y)]
            spans = [x for r in refs for x in kernel.near_spans(line, r, reach)]
            n = kernel.length(line)
            on = max(x[1] for x in spans) - min(x[0] for x in spans) if spans else 0.0
            out.append((key[0], i, s.site_id, t.site_id, round(on, 2), round(n - on, 2), round(n, 2), "New Route"))
            before = line
        return pd.DataFrame(out, columns=["ring_name", "seq", "near_end", "far_end", "existing_length", "new_length", "length", "route_type"])

    none = lambda kind: F.lit(None).cast(kind)
    line = previous.schema["line"].dataType
    rows = edges.select("ring_name", F.lit("road").alias("kind"), F.col("node_start").cast("long").alias("a"), F.col("node_end").cast("long").alias("b"), "weight", none("double").alias("x"), none("double").alias("y"), none("string").alias("near"), none("string").alias("far"), none(line).alias("line"))
    rows = rows.unionByName(places.select("ring_name", F.lit("place").alias("kind"), F.col("node").cast("long").alias("a"), "x", "y"), allowMissingColumns=True)
    rows = rows.unionByName(previous.select("ring_name", F.lit("line").alias("kind"), F.col("near_end").alias("near"), F.col("far_end").alias("far"), "line"), allowMissingColumns=True)
    return order.groupBy("ring_name").cogroup(_fresh(rows).groupBy("ring_name")).applyInPandas(run, "ring_name string, seq int, near_end string, far_end string, existing_length double, new_length double, length double, route_type string")
