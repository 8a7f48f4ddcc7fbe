"""Whitening of embeddings by the sums of centred products of every pair of dimensions.

Vectors become whole numbers, so that equal vectors are found exactly and counts, sums and
deviations are exact. Spark SQL expressions, one for each pair of the upper triangle, sum the
centred products in a single aggregation over the distinct vectors; the covariance put together from
them is decomposed by LAPACK on the driver, which sees d * (d + 1) / 2 numbers whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.common import fresh
from fiberloom.runtime import scratch

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Pairs that one aggregation sums at most; more dimensions than 90 take several over the same fit list.
PAIRS = 4_096
#: Eigenvalues below this share of the largest are zero but for rounding, and can't be scaled to one.
RANK = 1e-12
#: Whole numbers from here on are not exact as doubles.
EXACT = 2**53


@dataclass
class Whitening:
    """Of the vectors of one length: their number, exact sums, components (a column each), eigenvalues, share of the trace, error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def floors(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rests(self) -> list[int]:
        """What n times the floor lacks to each sum."""
        return [s % self.n for s in self.sums]


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has an entry, and only finite ones that stay exact as whole numbers."""
    v = F.col(f"`{vec}`")
    most = F.lit(float((EXACT - OFFSET) // SCALE))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < most))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & good)


def whole(vec: str) -> Column:
    return F.transform(f"`{vec}`", lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(OFFSET).cast("long"))


def triangle(rows: DataFrame, centred: list[Column], n: int) -> np.ndarray:
    """Covariance of the columns with divisor ``n``: every pair of the upper triangle is one SQL expression of one aggregation."""
    d = len(centred)
    # Columns that can't be null halve the work of a sum.
    wide = rows.select(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(centred)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for a in range(0, len(pairs), PAIRS):
        some = pairs[a : a + PAIRS]
        sums = wide.selectExpr(*[f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in some]).first()
        for (i, j), s in zip(some, sums, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def _projection(models: dict[int, Whitening], column: str) -> Column:
    """``n, deviation, whitened, explained, identity_error`` of a column of whole numbers."""

    @F.pandas_udf("n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    def project(xs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"n": 0, "deviation": None, "whitened": None, "explained": None, "identity_error": 0.0}, index=xs.index, dtype=object)
        for d, part in xs.groupby(xs.map(len)):
            m = models[d]
            apart = np.array(part.tolist(), np.int64) - np.array(m.floors, np.int64)
            white = (apart - np.array([r / m.n for r in m.rests])) @ m.components / np.sqrt(m.values)
            most = m.n * (int(np.abs(apart).max()) + 1)
            exact = apart if d * most * most < 2**63 else apart.astype(object)  # Python's integers have no end
            deviation = ((m.n * exact - np.array(m.rests, exact.dtype)) ** 2).sum(axis=1)
            cells = {"n": [m.n] * len(part), "deviation": [int(v) if v < 2**63 else None for v in deviation.tolist()], "whitened": list(white), "explained": [m.explained] * len(part), "identity_error": [m.identity_error] * len(part)}
            out.loc[part.index] = pd.DataFrame(cells, index=part.index, dtype=object)
        return out

    return project(F.col(column))


def fit(vectors: DataFrame, *, vec: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model for each length of vector, from its distinct vectors as whole numbers, each counted once.

    The distinct vectors are written once to the shared folder. One aggregation counts them and sums
    each dimension exactly, the next sums the centred products, the last ones hold the covariance of what
    came out against the identity. Components are fewer than asked where the vectors span fewer
    dimensions: one vector, or equal ones, give none.
    """
    rows = usable(vectors, vec).select(whole(vec).alias("x")).distinct()
    place = scratch(vectors.sparkSession)
    rows.write.parquet(place)
    every = vectors.sparkSession.read.schema("x array<bigint>").parquet(place)
    out = {}
    for d in sorted(r["d"] for r in every.select(F.size("x").alias("d")).distinct().collect()):
        listed = every.where(F.size("x") == d)
        sums = listed.selectExpr("count(*)", *[f"sum(cast(x[{i}] AS decimal(38, 0)))" for i in range(d)]).first()
        model = Whitening(sums[0], [int(s) for s in sums[1:]], np.zeros((d, 0)), np.zeros(0), np.zeros(0))
        # The whole part of the mean is taken off exactly, its rest as a double.
        centred = [(F.col("x")[i] - F.lit(low).cast("long")).cast("double") - F.lit(rest / model.n) for i, (low, rest) in enumerate(zip(model.floors, model.rests, strict=True))]
        v = triangle(listed, centred, model.n)
        values, axes = np.linalg.eigh(v)
        order = [i for i in range(d - 1, -1, -1) if values[i] > RANK * values[-1]][:components]
        model.components, model.values, model.explained = axes[:, order], values[order], values[order] / np.trace(v)
        if order:
            white = listed.select(_projection({d: model}, "x")["whitened"].alias("w"))
            names = [F.col("w")[i] for i in range(len(order))]
            means = white.agg(*[F.avg(c) for c in names]).first()
            apart = triangle(white, [c - F.lit(m) for c, m in zip(names, means, strict=True)], model.n)
            model.identity_error = float(np.abs(apart - np.eye(len(order))).max())
        out[d] = model
    return out


def whiten(vectors: DataFrame, models: dict[int, Whitening], *, vec: str = "embedding") -> DataFrame:
    """Usable rows with ``n, deviation, whitened, explained, identity_error`` of their length's model.

    ``whitened`` and ``explained`` have an entry for each component, by falling eigenvalue;
    ``deviation`` is the exact sum of (n * x - S)^2, null where a long can't hold it. Rows whose
    vector is null or empty, or has an entry that is null, not finite or from 2^53 on, are left out.
    Repeated rows and null ids each get their own row. Vectors of several lengths each follow the
    model of theirs. An empty table gives an empty one; input columns of the names appended are replaced.
    """
    names = ("n", "deviation", "whitened", "explained", "identity_error")
    keep = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in names]
    x, out = fresh("x"), fresh("out")
    rows = usable(vectors, vec).where(F.size(f"`{vec}`").isin(list(models))).withColumn(x, whole(vec))
    return rows.withColumn(out, _projection(models, x)).select(*keep, *[F.col(out)[c].alias(c) for c in names])
