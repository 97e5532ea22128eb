"""Centroid clustering (Lloyd's rounds on integer vectors) with ns-bounds.

A vector keeps, for every centroid, its distance when it was last measured and the round of that measurement; the
history of all centroids is kept too. In a later round a stored distance is loosened by the norm of the centroid's
*total* displacement since that round, which is never more than the sum of its drifts per round. A centroid whose
loosened distance cannot be below that of the vector's own centroid is not measured; the others are measured exactly.

Because loosening works over any number of rounds, the table of stored distances need not be written every round: a
round only reads it and sends sums per cluster and task, and the table is written anew, with what was measured since,
when the share of measured pairs has grown past ``REFRESH``. Distances are whole numbers, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop_table, tidy, write_table

#: Components must be below this in absolute value, so that squared distances of 64 components fit into a long.
LIMIT = 1 << 26
#: Share of pairs measured in a round beyond which the stored distances are written anew.
REFRESH = 0.25
#: Allowance for the rounding of stored distances, which are single-precision floats.
SLACK = 1e-6

#: A row of the table of stored distances; vectors, distances and rounds are packed numbers, which cross to Python as they are.
STATE = "id {id}, v binary, near int, far binary, since binary"
Result = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]


def whole_vectors(df: DataFrame, id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of the vectors that have ``dim`` components, none null, NaN or infinite.

    A vector with a component outside the range whose squared distances fit into a long is an error.
    """

    def component(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LIMIT, scaled).otherwise(F.raise_error(f"component too large: {LIMIT} / {scale} and above have no exact distance")).cast("int")

    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where((F.size(vector) == dim) & finite).select(F.col(f"`{id}`").alias("id"), F.transform(vector, component).alias("v"))


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``; equal ids go by the vector, null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to rows of ``c``."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * v.shape[1] * most * most < 1 << 53:  # then every sum below is a whole number that a double holds
        x, y = v.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + np.einsum("ij,ij->i", y, y)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


@dataclass(frozen=True)
class History:
    """All centroids of all rounds so far, rounds x k x dim; the last round is the current one."""

    rounds: np.ndarray

    @property
    def now(self) -> int:
        return len(self.rounds) - 1

    def nearest(self, v: np.ndarray, near: np.ndarray | None, far: np.ndarray | None, since: np.ndarray | None) -> Result:
        """Nearest centroids now, the stored distances with their rounds, squared distances (-1: not measured), pairs measured."""
        centers = self.rounds[-1]
        n, k = len(v), len(centers)
        if near is None:
            exact = squared(v, centers)
            now = np.full((n, k), self.now, np.int16)
            return exact.argmin(axis=1).astype(np.int32), np.sqrt(exact).astype(np.float32), now, exact, n * k
        moved = np.sqrt(((self.rounds - centers) ** 2).sum(axis=2).astype(np.float64))  # rounds x k: total displacements
        gone = moved[since, np.arange(k)]
        rows = np.arange(n)
        low = far * (1 - SLACK) - gone * (1 + SLACK) - SLACK
        high = far[rows, near] * (1 + SLACK) + gone[rows, near] * (1 + SLACK) + SLACK
        low[rows, near] = np.inf
        exact = np.full((n, k), -1, np.int64)
        unsure = np.flatnonzero(low.min(axis=1) <= high)
        far, since, near = far.copy(), since.copy(), near.copy()
        if len(unsure):  # measure their own centroid first: that alone settles many
            for j in np.unique(near[unsure]).tolist():
                own = unsure[near[unsure] == j]
                exact[own, j] = squared(v[own], centers[j : j + 1])[:, 0]
            high[unsure] = np.sqrt(exact[unsure, near[unsure]]) * (1 + SLACK) + SLACK
            fails = low[unsure] <= high[unsure, None]
            for j in range(k):
                again = unsure[fails[:, j]]
                if len(again):
                    exact[again, j] = squared(v[again], centers[j : j + 1])[:, 0]
            seen = exact[unsure]
            near[unsure] = np.where(seen < 0, np.iinfo(np.int64).max, seen).argmin(axis=1)  # of equal ones the first
            measured = exact >= 0
            far[measured], since[measured] = np.sqrt(exact[measured]), self.now
        return near, far, since, exact, int((exact >= 0).sum())


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _packed(matrix: np.ndarray) -> pa.Array:
    """A row of numbers as one binary value."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2][int(offsets[0]) : int(offsets[-1])]
    return np.frombuffer(data, kind).reshape(len(column), -1)


def _judged(history: History, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Result]]:
    for batch in batches:
        if batch.num_rows:
            if "near" not in batch.schema.names:
                v = _matrix(batch.column("v"), np.int64)
                yield batch, v, history.nearest(v, None, None, None)
                continue
            v = _unpacked(batch.column("v"), np.int32).astype(np.int64)
            near = batch.column("near").to_numpy().astype(np.int32)
            yield batch, v, history.nearest(v, near, _unpacked(batch.column("far"), np.float32), _unpacked(batch.column("since"), np.int16))


def _measure(history: History) -> Callable:
    """Rows with nearest centroids and stored distances brought up to this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v, (near, far, since, _, _) in _judged(history, batches):
            columns = [batch.column("id"), _packed(v.astype(np.int32)), pa.array(near, pa.int32()), _packed(far), _packed(since)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "near", "far", "since"])

    return tidy(run)


def _sums(history: History) -> Callable:
    """Sums per cluster and component of a whole task; component -1 has the counts, cluster -1 the measured pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, k, dim = history.rounds.shape
        total, pairs = np.zeros((k, dim + 1), np.int64), 0
        for _, v, (near, _, _, _, measured) in _judged(history, batches):
            pairs += measured
            for j in np.unique(near).tolist():
                own = v[near == j]
                total[j, 0] += len(own)
                total[j, 1:] += own.sum(axis=0)
        cluster, component = np.divmod(np.arange(k * (dim + 1)), dim + 1)
        names = ["cluster", "component", "total"]
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component - 1, pa.int32()), pa.array(total.ravel())], names)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([pairs])], names)

    return tidy(run)


def _distances(history: History) -> Callable:
    """Nearest centroid and squared distance; the own centroid is measured where the bounds were enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = history.rounds[-1]
        for batch, v, (near, _, _, exact, _) in _judged(history, batches):
            distance = exact[np.arange(len(v)), near]
            for j in np.unique(near).tolist():
                own = np.flatnonzero((near == j) & (distance < 0))
                if len(own):
                    distance[own] = squared(v[own], centers[j : j + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return tidy(run)


@dataclass
class Clustering:
    """``assigned``: id, cluster, distance; ``centroids`` of the last round; ``measured``: pairs measured in each round."""

    assigned: DataFrame
    centroids: np.ndarray
    measured: list[int]
    size: int


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int = 0, refresh: float = REFRESH) -> Clustering:
    """Lloyd's rounds over whole-number vectors ``v`` (array<int> of one length) with an ``id``.

    The driver holds k x dim numbers a round; a vector's state has k distances, so k is meant to be at most some
    hundreds. Ties go to the smaller cluster number, a centroid becomes floor(sum / count), an empty one stays. With
    fewer than k vectors there are as many clusters. Repeated rows and ids count each; null ids are kept. Without
    vectors the result is empty.
    """
    vectors = write_table(vectors, "vectors")
    start = seeds(vectors, k, seed)
    id_type = vectors.schema["id"].dataType.simpleString()
    if not len(start):
        empty = vectors.sparkSession.createDataFrame([], f"id {id_type}, cluster int, distance bigint")
        return Clustering(empty, start, [], 0)
    history, table, measured, size = History(start[None]), vectors, [], 0
    for number in range(rounds + 1):
        if number == 0 or (number < rounds and measured[-1] > refresh * size * len(start)):
            older = table
            table = write_table(table.mapInArrow(_measure(history), STATE.format(id=id_type)), "distances")
            drop_table(older)
        if number == rounds:
            break
        parts = table.mapInArrow(_sums(history), "cluster int, component int, total bigint")
        total = {(r.cluster, r.component): r.total for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()}
        size = sum(total.get((j, -1), 0) for j in range(len(start)))
        measured.append(total[-1, -1] if number else size * len(start))
        centers = history.rounds[-1].copy()
        for j, row in enumerate(centers):
            n = total.get((j, -1), 0)
            if n:
                row[:] = [total[j, c] // n for c in range(len(row))]
        history = History(np.concatenate([history.rounds, centers[None]]))
    assigned = write_table(table.mapInArrow(_distances(history), f"id {id_type}, cluster int, distance bigint"), "assigned")
    drop_table(table)
    return Clustering(assigned, history.rounds[-1], measured, size)


def with_inertia(found: Clustering, id: str) -> DataFrame:
    """``assigned`` with the inertia of each cluster and of all, and the digest of the cluster's centroid."""
    spark = found.assigned.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids.tolist())]
    sums = {r.cluster: r.total for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    rows = [(j, sums.get(j, 0), sum(sums.values()), d) for j, d in digests]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.assigned.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
