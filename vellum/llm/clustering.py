"""Centroid clustering with Elkan's bounds: exact results, few distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import give_back, quoted, with_checkpoint_dir
from vellum.llm.points import PARTIAL, SLACK, above, add_sums, as_long, averaged, below, decode, entries, exact_sums, partial_rows, squared, whole
from vellum.llm.tables import Rolling

CLUSTERS, ROUNDS, DIMENSION, SCALE = 16, 3, 64, 64
#: Bounds are kept in single precision; none is above this.
MOST_BOUND = 3e38


class Centroids:
    """Centroids with what prunes: distances between them, and how far each has moved, on the safe side."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None, dimension: int) -> None:
        self.at = entries(rows, dimension)
        k = len(rows)
        between = np.array([below(squared(self.at, c)) for c in self.at]).reshape(k, k) / 2
        self.half = between * (1 - SLACK)
        alone = between + np.diag(np.full(k, np.inf))
        self.nearest = alone.min(axis=1) * (1 - SLACK) if k else alone[:0, 0]
        self.moved = np.zeros(k) if before is None else above(squared(self.at, entries(before, dimension)))

    def first(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        """All distances of the first assignment: cluster, upper bound, lower bounds, and how many distances were computed."""
        points = whole(points, self.at)
        found = np.stack([squared(points, c) for c in self.at], axis=1)
        cluster = found.argmin(axis=1)  # the first of equal ones
        return cluster, above(found[np.arange(len(points)), cluster]), below(found), np.full(len(points), len(self.at))

    def next(self, values: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: np.ndarray) -> tuple[np.ndarray, ...]:
        """Assign again after the centroids moved.

        A centroid is passed over only if its lower bound, or half its distance
        to the vector's own centroid, is truly above the vector's upper bound;
        so one that is as near is always compared, by whole numbers.
        """
        cluster, computed = cluster.copy(), computed.copy()
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.moved[None, :], 0) * (1 - SLACK)
        open_rows = np.flatnonzero(upper >= self.nearest[cluster])
        if not len(open_rows):
            return cluster, upper, lower, computed
        a, u, low = cluster[open_rows], upper[open_rows], lower[open_rows]
        asked = (low <= u[:, None]) & (self.half[a] <= u[:, None])
        asked[np.arange(len(a)), a] = False
        some = asked.any(axis=1)
        open_rows, a, u, low = open_rows[some], a[some], u[some], low[some]
        points = whole(values[open_rows], self.at)
        best = squared(points, self.at[a])
        computed[open_rows] += 1
        u, low[np.arange(len(a)), a] = above(best), below(best)
        for j in range(len(self.at)):
            rows = np.flatnonzero((a != j) & (low[:, j] <= u) & (self.half[a, j] <= u))
            if not len(rows):
                continue
            found = squared(points[rows], self.at[j])
            computed[open_rows[rows]] += 1
            low[rows, j] = below(found)
            nearer = (found < best[rows]) | ((found == best[rows]) & (j < a[rows]))
            won = rows[nearer.astype(bool)]
            a[won], best[won] = j, found[nearer.astype(bool)]
            u[won] = above(best[won])
        cluster[open_rows], upper[open_rows], lower[open_rows] = a, u, low
        return cluster, upper, lower, computed

    def distances(self, values: np.ndarray, cluster: np.ndarray) -> list[int | None]:
        points = whole(values, self.at)
        return [as_long(d) for d in squared(points, self.at[cluster]).tolist()]


def rounded_down(bounds: np.ndarray) -> np.ndarray:
    """Single precision, never above."""
    bounds = np.minimum(bounds, MOST_BOUND)
    out = bounds.astype(np.float32)
    return np.where(out > bounds, np.nextafter(out, np.float32(0)), out)


STATE = "vec_id bigint, point binary, cluster int, upper double, lower binary, n_distances int"
FINAL = "vec_id bigint, cluster int, distance bigint, n_distances int"


def state_batch(ids: pa.Array, points: list, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: np.ndarray) -> pa.RecordBatch:
    bounds = [row.tobytes() for row in rounded_down(lower)]
    columns = [ids, pa.array(points, pa.binary()), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(bounds, pa.binary()), pa.array(computed.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE.split(", ")])


class Stored:
    """The form in which a vector's integers are stored: in the vector's own precision, which holds them once the scale, a power of two, is taken out."""

    def __init__(self, single: bool, dimension: int, scale: int) -> None:
        self.unit = scale if scale & (scale - 1) == 0 else 1
        self.kind, self.dimension = "<f4" if single and self.unit == scale else "<f8", dimension

    def write(self, values: np.ndarray) -> list[bytes]:
        return [v.tobytes() for v in (values / self.unit).astype(self.kind)]

    def read(self, column: list[bytes]) -> np.ndarray:
        return self.unit * np.frombuffer(b"".join(column), self.kind).astype(np.float64).reshape(-1, self.dimension)


def kept_rows(vectors: DataFrame, id_col: str, vector_col: str, *more: Column) -> tuple[DataFrame, bool]:
    """Ids and vectors under fixed names, ``more`` columns, and whether the vectors have single precision."""
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    values = F.col(quoted(vector_col)) if single else F.col(quoted(vector_col)).cast("array<double>")
    return vectors.select(F.col(quoted(id_col)).cast("bigint").alias("vec_id"), values.alias("embedding"), *more), single


def seeds(rows: DataFrame, form: Stored, dimension: int, scale: int, clusters: int) -> list[list[int]]:
    """The kept vectors with the least hashes of their ids; null ids come last, equal ids by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = decode(batch.column(1), dimension, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(form.write(values), pa.binary())], names=["vec_id", "point"])

    hashed = rows.mapInArrow(run, "vec_id bigint, point binary").withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.col("hash").asc_nulls_last(), "point").limit(clusters).select("point").collect()
    return [[int(x) for x in v] for v in form.read([r["point"] for r in first])]


def cluster_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances`` of every kept vector.

    Kept are vectors of ``dimension`` components, none null or non-finite (nor
    beyond single precision); components become ``floor(scale * x)``. Rows with
    null or repeated ids are rows as any other. With fewer kept vectors than
    ``clusters`` each starts one cluster; with none, or an empty table, there
    are no rows. Ties go to the smaller number. A squared distance beyond 64
    bits is null, and so is the inertia it would belong to. Extra columns are
    not read.

    Each vector's bounds are kept with it in a table of the shared folder, one
    for each round, of which only the last is kept; so a lost executor costs its
    tasks only. ``n_distances`` tells how many distances a vector needed in all.
    """
    rows, single = kept_rows(vectors, id_col, vector_col)
    form = Stored(single, dimension, scale)
    with_checkpoint_dir(rows.sparkSession)
    centroids = seeds(rows, form, dimension, scale, clusters)
    if not centroids:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, n_distances int")
    state, before = Rolling(rows.sparkSession, "clusters"), None
    for number in range(rounds):
        found = assigned(rows if number == 0 else state.rows, Centroids(centroids, before, dimension), form, dimension, scale, first=number == 0)
        now = state.replace(found)
        before, centroids = centroids, averaged(centroids, exact_sums(cluster_sums(now, form)))
    last = Centroids(centroids, before, dimension)
    final = state.replace(finished(state.rows if rounds else rows, last, form, dimension, scale, first=rounds == 0))
    return with_totals(final, centroids)


def assigned(rows: DataFrame, centroids: Centroids, form: Stored, dimension: int, scale: int, *, first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, points, found = one_batch(batch, centroids, form, dimension, scale, first)
            yield state_batch(ids, points, *found)
            del batch, values, points, found
            give_back()

    return rows.mapInArrow(run, STATE)


def one_batch(batch: pa.RecordBatch, centroids: Centroids, form: Stored, dimension: int, scale: int, first: bool) -> tuple:
    """Ids, components, their stored form, and the assignment with its bounds."""
    if first:
        kept, values = decode(batch.column(1), dimension, scale)
        return batch.column(0).take(pa.array(kept)), values, form.write(values), centroids.first(values)
    ids, stored, cluster, upper, lower, computed = batch.columns
    points = stored.to_pylist()
    values = form.read(points)
    bounds = np.frombuffer(b"".join(lower.to_pylist()), np.float32).astype(np.float64).reshape(len(values), -1)
    return ids, values, points, centroids.next(values, cluster.to_numpy().astype(np.int64), upper.to_numpy(), bounds, computed.to_numpy())


def cluster_sums(state: DataFrame, form: Stored) -> DataFrame:
    """Each task's exact sums by cluster; a cluster of any size is some numbers for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            add_sums(sums, batch.column(0).to_numpy(), whole(form.read(batch.column(1).to_pylist())))
        yield partial_rows(sums)

    return state.select("cluster", "point").mapInArrow(run, PARTIAL)


def finished(rows: DataFrame, centroids: Centroids, form: Stored, dimension: int, scale: int, *, first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, _, (cluster, _, _, computed) = one_batch(batch, centroids, form, dimension, scale, first)
            columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(centroids.distances(values, cluster), pa.int64()), pa.array((computed + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "n_distances"])

    return rows.mapInArrow(run, FINAL)


def with_totals(final: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add sums over clusters, and each final centroid's digest; there are as many of them as clusters."""
    wide = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in final.groupBy("cluster").agg(wide.alias("total")).collect()}
    known = [None if v is None else int(v) for v in sums.values()]
    inertia = None if None in known else as_long(sum(known))
    facts = [(c, None if v is None else as_long(int(v)), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in sums.items()]
    per_cluster = final.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return final.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")
