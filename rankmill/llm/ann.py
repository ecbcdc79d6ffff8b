"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Unit vectors are hashed by ``hashes`` projections ``floor((a.u + b) / width)`` with Gaussian (2-stable)
directions, in ``tables`` independent tables. Every vector is indexed, one row per table. A query visits its own
bucket and ``probes - 1`` perturbed ones, in the order of their estimated success: the squared distances to
the crossed cell walls are summed and the sets of perturbed coordinates come off a heap. Probes meet the index by one
shuffle on (table, bucket, tile); inside a task the exact cosine of all candidates of a bucket is computed and only the
``k`` best per query leave it, so rows grow with the queries and not with the candidates. Large
buckets (one vector repeated in a third of all rows) are split into tiles of about ``TILE`` rows, and the
probes of such a bucket go to each tile. Queries that found fewer than ``k`` are compared with all rows, again
in tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

TABLES, HASHES, WIDTH, PROBES = 6, 8, 2.0, 300
TILE = 4096
SLAB = 1 << 20  # products held at a time


def probe_order(inside: np.ndarray, count: int) -> np.ndarray:
    """Perturbations (-1, 0, 1 per hash) of the first ``count`` buckets; ``inside``: place in the cell, 0 to 1."""
    k = len(inside)
    walls = sorted([(x * x, i, -1) for i, x in enumerate(inside)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(inside)])
    out = [np.zeros(k, np.int64)]
    heap = [(walls[0][0], (0,))]
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        if len({walls[c][1] for c in chosen}) == len(chosen):  # not both walls of one cell
            step = np.zeros(k, np.int64)
            for c in chosen:
                step[walls[c][1]] = walls[c][2]
            out.append(step)
        last = chosen[-1]
        if last + 1 < 2 * k:
            grown = cost + walls[last + 1][0]
            heapq.heappush(heap, (grown, (*chosen, last + 1)))
            heapq.heappush(heap, (grown - walls[last][0], (*chosen[:-1], last + 1)))
    return np.array(out)


class Hashing:
    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width = width
        self.along = rng.normal(size=(tables, dim, hashes))
        self.shift = rng.uniform(0, width, (tables, 1, hashes))
        self.mix = rng.integers(1, 2**62, hashes, np.int64) * 2 + 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(table, vector, hash): place on each projection, in cells."""
        return (unit @ self.along + self.shift) / self.width

    def code(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(axis=-1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def usable(vector: Column) -> Column:
    """Not null, not empty, only finite components, not all zero."""
    double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & (length > 0) & (length < float("inf")), F.lit(False))


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of each query; ties to the smaller id. Sums have one order, so equal vectors tie exactly."""
    rows: list[tuple[int, int, float]] = []
    norms, query_norms = _norms(vectors), _norms(queries)
    order = np.argsort(ids, kind="stable")
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    step = max(1, SLAB // vectors.size)
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        score = (part[:, None, :] * vectors[None, :, :]).sum(axis=2) / (query_norms[at : at + step, None] * norms[None, :])
        score[query_ids[at : at + step, None] == ids[None, :]] = -np.inf
        nearest = np.argsort(-score, axis=1, kind="stable")[:, :k]
        for i, places in enumerate(nearest):
            rows += [(int(query_ids[at + i]), int(ids[j]), float(score[i, j])) for j in places if score[i, j] > -np.inf]
    return rows


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(index: DataFrame, probes: DataFrame, dim: int, k: int) -> DataFrame:
    """Index rows (bucket, vec_id, vector) against probe rows (bucket, vec_id, vector), k best per probe and tile."""
    tiles = index.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    left = index.join(tiles, "bucket").select(
        "bucket", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).alias("tile"), F.lit(0).alias("is_query"), "vec_id", "vector"
    )
    right = probes.join(tiles, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("is_query"),
        "vec_id", "vector",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            key = [batch[c].to_numpy() for c in ("bucket", "tile", "is_query")]
            if not len(batch):
                continue
            change = np.zeros(len(batch), bool)
            for c in key:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change), len(batch)]
            all_ids, all_vectors, rows = batch["vec_id"].to_numpy(), _vectors(batch["vector"], dim), []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                here = (key[0][lo], key[1][lo])
                if key[2][lo] == 0:  # a tile of the index; it may reach over batches
                    same = at == here
                    ids = np.concatenate([ids, all_ids[lo:hi]]) if same else all_ids[lo:hi]
                    vectors = np.concatenate([vectors, all_vectors[lo:hi]]) if same else all_vectors[lo:hi]
                    at = here
                elif at == here:
                    rows += _best(all_ids[lo:hi], all_vectors[lo:hi], ids, vectors, k)
            columns = zip(*rows, strict=True) if rows else [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"]
            )

    rows = left.unionAll(right).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "is_query")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by cosine found for each row that ``queries`` marks.

    Rows without id, and vectors that are null, empty, zero, of another length than most (of equally frequent ones the longest), or hold
    null or non-finite components, take no part. A repeated id is one candidate per different vector, and no
    candidate of itself. With at most k other rows, all are returned; an empty table gives no rows.
    """
    given = vectors.withColumn("_query", F.coalesce(queries, F.lit(False)))
    given = given.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), "_query"
    )
    usual = given.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = usual["d"] if usual else 1
    given = given.where(F.size("vector") == dim)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Hashing(dim, tables, hashes, width)
        for batch in batches:
            v = _vectors(batch["vector"], dim)
            cells = by.cells(v / _norms(v)[:, None])
            low = np.floor(cells).astype(np.int64)
            codes = by.code(low)
            for t in range(tables):
                bucket = pa.array(codes[t] * tables + t)
                yield pa.RecordBatch.from_arrays([bucket, batch["vec_id"], batch["vector"]], ["bucket", "vec_id", "vector"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Hashing(dim, tables, hashes, width)
        for batch in batches:
            v = _vectors(batch["vector"], dim)
            cells = by.cells(v / _norms(v)[:, None])
            low = np.floor(cells).astype(np.int64)
            for i in range(len(batch)):
                visits = [
                    np.unique(by.code(low[t, i] + probe_order(cells[t, i] - low[t, i], probes))) * tables + t
                    for t in range(tables)
                ]
                bucket = np.concatenate(visits)
                take = pa.array(np.full(len(bucket), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), batch["vec_id"].take(take), batch["vector"].take(take)], ["bucket", "vec_id", "vector"]
                )

    shape = "bucket long, vec_id long, vector array<double>"
    rows = given.select("vec_id", "vector")
    asked = given.where("_query").select("vec_id", "vector")
    index = cut_lineage(rows.mapInArrow(hashed, shape), "index")
    found = cut_lineage(_rank(_meet(index, asked.mapInArrow(probed, shape), dim, k), k), "nearest")
    # queries short of k: all rows, in tiles of one bucket
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut_lineage(asked.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        every = _meet(rows.withColumn("bucket", F.lit(0).cast("long")), short.withColumn("bucket", F.lit(0).cast("long")), dim, k)
        done = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = done.unionByName(_rank(every, k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
