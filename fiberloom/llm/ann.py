"""Nearest neighbours by an inverted file whose lists are scanned dimension by dimension.

Vectors are scaled to unit length and rotated at random, so that any prefix of the components tells
how far two vectors are apart. A query meets the vectors of its nearest lists in blocks of
columns; after each block a hypothesis test on the partial distances abandons the candidates that
cannot plausibly be among its best. It first meets its few nearest lists, and takes what it finds
there as a bound to the others. What is left is scored exactly on the original vectors. How many
lists a query probes is what its recall takes on a bounded sample of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.llm.common import durable

#: Vectors the centroids are fitted on at most, the first in order of a hash of their id.
SAMPLE = 20_000
#: Vectors of the sample that the number of probes is fitted on, and the share of their neighbours that it reaches.
ASKED, REACHED = 400, 0.97
#: Lists that give the bound for the others.
FIRST = 4
#: Least and most rows that are searched in one task at a time; a longer list is dealt into parts.
PART, LONGEST_PART = 512, 32_768
#: Columns that are added to the partial distances at a time.
COLUMNS = 8
#: Significance of the test: an abandoned candidate is farther than the bound but for erfc(EPSILON).
EPSILON = 2.1


@dataclass
class Index:
    """Bounded model of the vectors of one length: the rotation, the centroids after it, the number of the first list, and of the probes."""

    rotation: np.ndarray
    centroids: np.ndarray
    first: int
    probes: int


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows with a vector of finite components that is not zero."""
    v = F.col(f"`{vec}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def named(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    return usable(vectors, vec).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("vec")).where("id is not null")


def scaled(values) -> np.ndarray:
    """Rows divided by a power of two each, so that no product of theirs is out of range."""
    x = np.array([np.asarray(v, np.float64) for v in values])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _order(index: Index, x: np.ndarray) -> np.ndarray:
    """Lists of each rotated unit vector, nearest first."""
    return np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")


def _fitted(x: np.ndarray, lists: int, first: int, k: int, steps: int, seed: int, share: float | None) -> Index:
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    x = unit(x) @ rotation
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: max(1, lists)]]
    for _ in range(steps):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    index = Index(rotation, c, first, len(c))
    if share is not None:
        index.probes = max(1, round(share * len(c)))
        return index
    # Place of the neighbours' lists among those of the query, over the distinct vectors of the sample.
    asked = rng.permutation(len(distinct))[:ASKED]
    own, places = np.argmax(distinct @ c.T, axis=1), []
    for a in range(0, len(asked), 50):
        some = asked[a : a + 50]
        near = distinct[some] @ distinct.T
        near[np.arange(len(some)), some] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(distinct) - 1)]
        place = np.argsort(_order(index, distinct[some]), axis=1)
        places.append(np.take_along_axis(place, own[best], axis=1).ravel())
    every = np.sort(np.concatenate(places)) if places else np.zeros(0)
    index.probes = int(every[min(len(every) - 1, int(REACHED * len(every)))]) + 1 if len(every) else 1
    return index


def fit(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", lists: int | None = None, sample: int = SAMPLE, k: int = 5, probe_share: float | None = None, steps: int = 8, seed: int = 7) -> dict[int, Index]:
    """Random rotation, k-means centroids and probes for each length of vector, from a bounded sample; every vector is indexed later.

    The number of lists grows with the root of the number of vectors, up to a twentieth of the
    sample, so that neither assigning a vector nor scanning a list grows with the whole input. A
    length that the sample has not met is one list. One count for each length reaches the driver.
    """
    good = named(vectors, vec_id, vec)
    counts = {r["d"]: r["count"] for r in good.groupBy(F.size("vec").alias("d")).count().collect()}
    n = sum(counts.values())
    share = min(1.0, 2.0 * sample / max(1, n))  # a hash range that holds the sample, so that few vectors are ordered
    some = good.withColumn("h", F.xxhash64("id")).where(F.col("h") <= F.lit(int(share * 2**64) - 2**63 if share < 1 else 2**63 - 1))
    rows = [r["vec"] for r in some.orderBy("h", "id", "vec").limit(sample).select("vec").collect()]
    out, first = {}, 0
    for d in sorted(counts):
        x = [v for v in rows if len(v) == d]
        most = max(1, min(lists or round(2 * counts[d] ** 0.5), sample // 20, len(x)))
        out[d] = _fitted(scaled(x), most, first, k, steps, seed, probe_share) if x else Index(np.eye(d), np.eye(1, d), first, 1)
        first += len(out[d].centroids)
    return out


def _each_length(batch: pd.DataFrame, model: dict[int, Index], rows: int) -> Iterator[tuple[Index, pd.DataFrame]]:
    for d, part in batch.groupby(batch["vec"].map(len)):
        if d in model:
            for a in range(0, len(part), rows):
                yield model[d], part.iloc[a : a + rows]


def _assign(sent):
    """Rows ``(id, list, vec)`` under the nearest centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, rows in _each_length(batch, sent.value, 2000):
                near = np.argmax(unit(scaled(rows["vec"])) @ index.rotation @ index.centroids.T, axis=1)
                yield pd.DataFrame({"id": rows["id"], "list": near + index.first, "vec": rows["vec"]})

    return run


def _probe(sent, place: list[tuple[int, int]], later: bool):
    """Rows ``(id, part, lists, vec, bound)``: each query once for every part that holds a list it probes.

    Its nearest lists come first, and ``later`` the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, rows in _each_length(batch, sent.value, 200):
                order = _order(index, unit(scaled(rows["vec"])) @ index.rotation) + index.first
                order = order[:, FIRST : index.probes] if later else order[:, : min(FIRST, index.probes)]
                out = []
                for query, vec, bound, lists in zip(rows["id"], rows["vec"], rows["bound"], order, strict=True):
                    parts: dict[int, list[int]] = {}
                    for x in lists.tolist():
                        for p in range(place[x][0], place[x][0] + place[x][1]):
                            parts.setdefault(p, []).append(x)
                    out += [(query, p, of, vec, bound) for p, of in parts.items()]
                if out:
                    yield pd.DataFrame(out, columns=["id", "part", "lists", "vec", "bound"])

    return run


def placed(counts: dict[int, int], lists: int, part: int) -> list[tuple[int, int]]:
    """First part and number of parts of each list: short lists share one, a long one is dealt over several."""
    out, at, filled = [], 0, 0
    for i in range(lists):
        n = counts.get(i, 0)
        if filled and filled + n > part:
            at, filled = at + 1, 0
        out.append((at, max(1, -(-n // part))))
        filled += n
        if filled > part:
            at, filled = at + out[-1][1], 0
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine in double precision, row by row in one fixed order, so equal vectors score equally."""
    a, b = scaled(a), scaled(b)
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def scan(query: np.ndarray, rotated: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON, bound: float = np.inf) -> np.ndarray:
    """Candidates of some lists that the dimension scan does not abandon.

    The bound is the least of ``bound`` and the k-th least full distance among the rows that look
    nearest from the first block. After d of D columns, the partial distance times D / d estimates the full one within a
    relative error of epsilon / sqrt(d); rows whose estimate is beyond that above the bound go.
    """
    n, dim = rotated.shape
    if n <= 4 * k and bound == np.inf:
        return np.arange(n)
    alive = np.arange(n)
    first = min(columns, dim)
    partial = ((rotated[:, :first] - query[:first]) ** 2).sum(axis=1)
    if bound == np.inf:
        likely = np.argpartition(partial, 4 * k)[: 4 * k]
        bound = np.partition(((rotated[likely] - query) ** 2).sum(axis=1), k - 1)[k - 1]
    for d in range(first, dim + 1, columns):
        limit = bound * (d / dim) * (1 + epsilon / d**0.5) ** 2
        keep = partial <= (limit if d < dim else bound) + 1e-9
        alive, partial = alive[keep], partial[keep]
        if d + columns > dim and d < dim:
            columns = dim - d
        if d < dim and len(alive):
            partial = partial + ((rotated[alive, d : d + columns] - query[d : d + columns]) ** 2).sum(axis=1)
    return alive


class _Part:
    """Vectors of one part, by list."""

    def __init__(self, rows: pd.DataFrame, model: dict[int, Index]):
        # A list holds vectors of one length, a part maybe lists of several.
        self.lists, self.ids, self.raw = rows["list"].to_numpy(), rows["id"].to_numpy(), rows["vec"].to_numpy()
        self.rotated, self.model = {}, model
        for d, some in rows.reset_index(drop=True).groupby(rows["vec"].map(len).to_numpy()):
            self.rotated[d] = some.index[0], unit(scaled(some["vec"])) @ model[d].rotation

    def best(self, query: int, vec: np.ndarray, lists, bound: float, k: int) -> Iterator[tuple[int, int, float]]:
        if len(vec) not in self.rotated:
            return
        start, rotated = self.rotated[len(vec)]
        q = (unit(scaled([vec])) @ self.model[len(vec)].rotation)[0]
        spans = np.searchsorted(self.lists, np.stack([np.sort(lists), np.sort(lists) + 1]))
        mine = np.concatenate([np.arange(a, b) for a, b in spans.T])
        near = mine[scan(q, rotated[mine - start], k + 1, bound=bound)]  # the query itself may lie in this part
        near = near[self.ids[near] != query]
        if len(near):
            score = cosine(list(self.raw[near]), [vec] * len(near))
            for j in np.lexsort((self.ids[near], -score))[:k]:
                yield query, int(self.ids[near[j]]), float(score[j])


def _search(sent, k: int):
    """The k best of each part for every query that probes a list in it.

    Rows come sorted by part, its vectors first: only these are held, and the queries stream past.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, held = None, [], None
        for batch in batches:
            out = []
            for at, some in batch.groupby("part", sort=False):
                if at != part:
                    part, rows, held = at, [], None
                mine = some[~some["asks"]]
                if len(mine):
                    rows.append(mine)
                asks = some[some["asks"]]
                if len(asks) and rows:
                    held = held or _Part(pd.concat(rows, ignore_index=True), sent.value)
                    for query, vec, lists, bound in zip(asks["id"], asks["vec"], asks["lists"], asks["bound"], strict=True):
                        out += held.best(query, vec, lists, bound, k)
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", k: int = 5, probe_share: float | None = None, model: dict[int, Index] | None = None, part: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row of ``queries``, but itself.

    Every usable vector is indexed under its nearest centroid; rows that are null, zero or hold a
    null or non-finite component take no part, nor do rows without an id. Vectors are compared with
    those of their own length. A list longer than ``part`` rows is dealt by a hash of the id over
    several tasks, and a query goes to all of them, so a vector that is very common fills no single
    task; its best are then merged, k from each part. Ties go to the smaller ``vec_id``. Rows that
    repeat an id are candidates of their own; a query id that repeats is asked once, by its least
    vector. Extra columns don't matter; an empty table gives an empty result. ``probe_share`` sets
    the share of the lists that are probed, instead of what the sample's recall takes.
    """
    spark = vectors.sparkSession
    model = fit(vectors, vec_id=vec_id, vec=vec, k=k, probe_share=probe_share) if model is None else model
    sent = spark.sparkContext.broadcast(model)
    rows = durable(named(vectors, vec_id, vec).mapInPandas(_assign(sent), "id long, list int, vec array<double>"))
    # One count for each list reaches the driver, at most a twentieth of the bounded sample for each length.
    counts = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = part or min(LONGEST_PART, max(PART, sum(counts.values()) // tasks))
    place = placed(counts, sum(len(x.centroids) for x in model.values()), part)
    at = lambda i: F.get(F.array(*[F.lit(p[i]) for p in place]), F.col("list")) if place else F.lit(0)
    none = F.lit(None).cast("double")
    held = rows.select((at(0) + F.pmod(F.xxhash64("id"), at(1))).cast("int").alias("part"), F.lit(False).alias("asks"), "list", "id", "vec", F.lit(None).cast("array<int>").alias("lists"), none.alias("bound"))
    asked = durable(named(queries, vec_id, vec).groupBy("id").agg(F.min("vec").alias("vec")))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def found(asks: DataFrame, later: bool) -> DataFrame:
        asks = asks.mapInPandas(_probe(sent, place, later), "id long, part int, lists array<int>, vec array<double>, bound double")
        asks = asks.select("part", F.lit(True).alias("asks"), F.lit(None).cast("int").alias("list"), "id", "vec", "lists", "bound")
        dealt = held.unionByName(asks).repartition("part").sortWithinPartitions("part", "asks", "list", "id")
        return dealt.mapInPandas(_search(sent, k), "query_id long, vec_id long, score double")

    best = lambda rows: rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    near = durable(best(found(asked.withColumn("bound", F.lit(float("inf"))), False)))
    # The bound: squared distance of the k-th best so far, 2 - 2 * cosine.
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (2 - 2 * F.col("score")).alias("b"))
    rest = asked.join(bounds, "id", "left").select("id", "vec", F.coalesce("b", F.lit(float("inf"))).alias("bound"))
    out = best(near.drop("rank").unionByName(found(rest, True)))
    return out.select("query_id", "rank", "vec_id", "score")
