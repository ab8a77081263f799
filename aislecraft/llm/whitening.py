"""Whitening of embeddings by a covariance from variances alone.

Components become whole numbers, so that all sums are exact. A pass over the
different vectors sums, for every dimension i and every pair i < j, the squares
of the centred z_i and of the centred z_i + z_j. The polarisation identity

    2 cov(i, j) = var(i + j) - var(i) - var(j)

gives all cross-covariances from these, and an eigendecomposition of the matrix
gives the components. Values are centred on the whole number nearest to their
mean; what is left of the mean, a fraction r / n, is taken off each variance
exactly (n * sum(z^2) - r^2), in integers of any size. A task emits one row of
sums for each dimension, whatever it reads; the driver holds the matrix only.

Cases: rows whose vector is null or holds null or non-finite components, is
empty, or is of another length than most, and rows with components that no long
holds after scaling, are left out; rows without a vec_id take part, with a null
one; rows that repeat a vector are one in the fit list, and each of them is
returned. A component without variance (fewer different vectors than
dimensions) has a null `whitened` and an `explained` of 0; `deviation` is null
where no long holds it; vectors of fewer than four dimensions have as many
components as dimensions; an empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import discard, stored
from aislecraft.llm.vectors import exact, largest, matrix, whole_rows

COMPONENTS = 4
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    """Of n whole vectors: the sums of their dimensions, and n^2 times their covariance, exactly."""

    n: int
    sums: list[int]
    scatter: list[list[int]]

    def covariance(self) -> np.ndarray:
        return np.array([[v / self.n**2 for v in row] for row in self.scatter])


def summed(rows: DataFrame, width: int, height: int, sums: Callable[[np.ndarray], list[list[int]]]) -> list[list[int]]:
    """The sum of `sums` (lists of integers, `height` of them) over all blocks of the rows' x: a row of each list and task is shuffled, one of each list reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[list[int]] | None = None
        for batch in batches:
            if batch.num_rows:
                new = sums(matrix(batch.column(0), width))
                total = [[a + b for a, b in zip(*pair)] for pair in zip(total, new)] if total else new
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array([[str(v) for v in row] for row in total], pa.list_(pa.string()))], ["at", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "sums": [[str(sum(map(int, column))) for column in zip(*pdf["sums"])]]})

    each = rows.select("x").mapInArrow(partial, "at int, sums array<string>").groupBy("at").applyInPandas(add, "at int, sums array<string>")
    return [[int(v) for v in row["sums"]] for row in sorted(each.collect(), key=lambda r: r["at"])]


def moments(fit_list: DataFrame, width: int) -> Moments:
    """The exact moments of the rows' x, all `width` long."""

    def first(x: np.ndarray) -> list[list[int]]:
        return [[len(x), *(int(v) for v in exact(x, largest(x) * len(x)).sum(axis=0))]]

    n, *sums = summed(fit_list, width, 1, first)[0]
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole number nearest to the mean
    left = [s - n * c for s, c in zip(sums, centre)]  # of n times the mean

    def squares(x: np.ndarray) -> list[list[int]]:
        reach = largest(x) + max(map(abs, centre))
        z = exact(x, 4 * reach * reach * len(x)) - exact(np.array(centre, object), 4 * reach * reach * len(x))
        out = []
        for i in range(width):
            together = z[:, i:] + z[:, i : i + 1]
            together[:, 0] = z[:, i]  # the dimension alone
            out.append([int(v) for v in (together * together).sum(axis=0)])
        return out

    sq = summed(fit_list, width, width, squares)
    alone = [n * sq[i][0] - left[i] ** 2 for i in range(width)]
    scatter = [[0] * width for _ in range(width)]
    for i in range(width):
        scatter[i][i] = alone[i]
        for j in range(i + 1, width):
            both = n * sq[i][j - i] - (left[i] + left[j]) ** 2
            scatter[i][j] = scatter[j][i] = (both - alone[i] - alone[j]) // 2
    return Moments(n, sums, scatter)


class Whitener:
    """Projections of whole vectors on the first components, each of variance one over the fit list."""

    def __init__(self, m: Moments, components: int = COMPONENTS):
        self.n, self.sums = m.n, m.sums
        v = m.covariance()
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1)
        trace = float(np.trace(v))
        self.live = values > trace * len(v) * np.finfo(float).eps
        self.explained = np.where(self.live, values / (trace or 1), 0.0)
        self.axes = vectors / np.sqrt(np.where(self.live, values, 1.0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        most = len(self.sums) * (self.n * largest(x) + max(map(abs, self.sums))) ** 2
        return exact(x, most) * self.n - exact(np.array(self.sums, object), most)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.axes


def identity_error(fit_list: DataFrame, width: int, w: Whitener) -> float:
    """The largest entry of |covariance - identity| of the whitened fit list, over the components that have variance."""
    k = int(w.live.sum())
    if not k:
        return 0.0
    spread = fit_list.sparkSession.sparkContext.broadcast(w)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = spread.value.whitened(spread.value.centred(matrix(batch.column(0), width)))[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array([[*y.sum(axis=0), *(y.T @ y).ravel()]], pa.list_(pa.float64()))], ["sums"])

    parts = fit_list.select("x").mapInArrow(products, "sums array<double>")
    row = np.array(parts.agg(*(F.sum(F.col("sums")[i]) for i in range(k + k * k))).first(), float) / w.n
    return float(np.abs(row[k:].reshape(k, k) - np.outer(row[:k], row[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For every usable row and each of the first components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, width = whole_rows(vectors)
    spark = vectors.sparkSession
    if not width:
        return spark.createDataFrame([], OUT)
    fit_list = stored(rows.select("x").distinct(), "vectors")
    w = Whitener(moments(fit_list, width), min(components, width))
    error = identity_error(fit_list, width, w)
    discard(fit_list)
    spread = spark.sparkContext.broadcast(w)
    names = [f.strip().split(" ")[0] for f in OUT.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = spread.value
        k = len(w.live)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = w.centred(matrix(batch.column(1), width))
            deviation = [int(v) if v < 2**63 else None for v in (y * y).sum(axis=1)]
            each = np.repeat(np.arange(batch.num_rows), k)
            component = np.tile(np.arange(k), batch.num_rows)
            white = w.whitened(y).ravel()
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(each), w.n), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(white, pa.float64(), mask=~w.live[component]),
                pa.array(w.explained[component], pa.float64()), pa.array(np.full(len(each), error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("vec_id", "x").mapInArrow(run, OUT)
