"""Whitening of embeddings on integer grids.

Entries become integers, so counts, sums and deviations are exact. The fit list holds each different vector once (the
aggregate combines before its shuffle, so a vector of a third of all rows is a row per task). Each task reduces its centred rows to a
triangle by QR, a slab at a time; triangles meet in groups of ``FAN`` until one is left (levels grow with the
logarithm of the tasks). Only that triangle, one row per dimension, and the sums per dimension reach the driver. Its singular
values come from dqds and its directions from twisted factorisations (``qd``). Every level is a written table, so a lost
executor repeats its own part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.qd import EPS, singular
from rankmill.session import cut_lineage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000  # of the integer grid
FAN = 16  # triangles that meet in one group
SLAB = 4096  # rows reduced at a time
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    n: int  # different vectors
    sums: np.ndarray  # per dimension, over the different vectors
    directions: np.ndarray  # a column for each component
    values: np.ndarray  # eigenvalues of the covariance, falling; exactly 0 where the vectors do not reach
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        return x * self.n - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (self.centred(x) / self.n) @ self.directions / np.sqrt(self.values)
        y[:, self.values == 0.0] = np.nan
        return y


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite entries."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows of the most frequent length (of equally frequent ones the longest), and that length."""
    rows = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v")
    )
    common = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = common["d"] if common else 0
    x = F.transform("_v", lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size("_v") == dim).select("vec_id", x.alias("x")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(parts: DataFrame) -> list:
    """Sum by place of the arrays ``part``, one of them per task."""
    by_place = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return [r["v"] for r in sorted(by_place.collect())]


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(rows), mode="r")


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of (x) rows and the written fit list; None where there are no rows."""
    listed = cut_lineage(rows.select("x").distinct(), "fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            x = _matrix(batch["x"], dim)
            total[0] += len(x)
            total[1:] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["part"])

    totals = _summed(listed.mapInArrow(sums, "part array<long>")) if dim else []
    if not totals or not totals[0]:
        return None, listed
    n, s = totals[0], np.array(totals[1:], np.int64)

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            x = _matrix(batch["x"], dim)
            for at in range(0, len(x), SLAB):
                r = _triangle([r, (x[at : at + SLAB] * n - s) / n])
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"]
            )

    def met(group: pd.DataFrame) -> pd.DataFrame:
        r = _triangle([np.asarray(r).reshape(-1, dim) for r in group.sort_values("part")["r"]])
        return pd.DataFrame({"part": [group["part"].min() // FAN], "r": [r.ravel()]})

    shape = "part long, r array<double>"
    level = cut_lineage(listed.mapInArrow(triangles, shape), "triangles")
    while level.agg(F.max("part")).first()[0] > 0:
        level = cut_lineage(level.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(met, shape), "triangles")
    r = np.array(level.first()["r"]).reshape(-1, dim)
    square = np.zeros((dim, dim))
    square[: len(r)] = r
    squares, directions = singular(square, min(components, dim))
    top = squares.max(initial=0.0)
    squares = np.where(squares <= (10 * dim * EPS) ** 2 * top, 0.0, squares)
    return Whitening(n, s, directions, squares / n, float((r * r).sum() / n)), listed


def identity_error(model: Whitening, listed: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    on = np.flatnonzero(model.values)
    dim, k = len(model.sums), len(on)
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = model.project(_matrix(batch["x"], dim))[:, on]
            total += y.sum(axis=0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, second.ravel()])], pa.list_(pa.float64()))], ["part"])

    sums = np.array(_summed(listed.mapInArrow(products, "part array<double>"))) / model.n
    mean = sums[:k]
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or empty, hold null or non-finite entries, or have another length than most take no part. A null id stays with its rows;
    repeated rows are returned each and fitted once. Where the vectors have no variance along a component (fewer different
    vectors than components, or one vector only) ``whitened`` is null, ``explained`` 0 and ``identity_error`` leaves it out. An empty
    table gives no rows. A deviation beyond 63 bits is an error, never a wrong number.
    """
    rows, dim = grid(vectors, id_col, vector_col)
    model, listed = fit(rows, dim, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    error, k = identity_error(model, listed), len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = _matrix(batch["x"], dim)
            centred = own.centred(x)
            if len(x) and (centred.astype(float) ** 2).sum(axis=1).max() >= 2.0**62:
                raise OverflowError("a deviation does not fit 63 bits")
            each = pa.array(np.repeat(np.arange(len(x)), k))
            flat = own.project(x).ravel()
            size = len(flat)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, own.n)), pa.array(np.repeat((centred * centred).sum(axis=1), k)),
                    pa.array(flat, from_pandas=True), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return rows.mapInArrow(run, OUT)
