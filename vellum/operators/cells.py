"""Approximate nearest neighbours by a stored index of cells."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.dense import BROADCAST_BYTES, SCORES_AT_ONCE
from vellum.operators.joins import hinted, is_small
from vellum.operators.staging import staged
from vellum.sources.versions import Versions

#: Rows that the cells are fitted on: all of a smaller table, of a larger one about so many, chosen by a hash of the key.
FIT_ROWS = 50_000
#: Centroids go to every task, so their number has a limit.
MOST_CELLS = 4_096
#: Rows of one file; a fuller cell has several.
PART_ROWS = 250_000
#: Share of the cells that a query looks into. It is high because the test vectors hardly cluster; measured recall is in README.
PROBED = 0.6
#: For each wanted neighbour, candidates by codes that are scored again by whole vectors.
REFINE = 4
#: Distances of queries to cells that the driver holds at once.
DISTANCES_AT_ONCE = 1_000_000


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms > 0, norms, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1 if len(column) else 0)


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """The nearest cells of unit rows, best first."""
    far = (centroids * centroids).sum(axis=1)[None, :] - 2 * rows @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def asked_cells(rows: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """For each cell a bit for every query that looks into it; made for some queries at a time, as places would take 64 times as much."""
    bits = np.zeros((len(centroids), -(-len(rows) // 8)), np.uint8)
    step = 8 * max(1, DISTANCES_AT_ONCE // (8 * len(centroids)))
    for low in range(0, len(rows), step):
        some = rows[low : low + step]
        asked = np.zeros((len(some), len(centroids)), bool)
        np.put_along_axis(asked, nearest_cells(some, centroids, count), True, axis=1)
        packed = np.packbits(asked.T, axis=1)
        bits[:, low // 8 : low // 8 + packed.shape[1]] = packed
    return bits


class CellIndex:
    """Vectors by cell, in a folder: codes of one byte a component to find candidates, and whole vectors to score them.

    Cells are k-means centroids of unit vectors, fitted on a bounded sample;
    every row goes to its nearest one, and a search reads the folders of the
    cells nearest to its queries only. Rows are added by segments; a version
    names its segments. Vectors that are null, or of another dimension, are not
    indexed. A key must be added once.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", tenant: str = "user_id") -> None:
        self.spark, self.path, self.key, self.tenant = spark, path.rstrip("/"), key, tenant
        self.versions = Versions(spark, path)

    def fit(self, vectors: DataFrame, *, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 7) -> None:
        """Fit the cells, about the square root of the number of rows if none is given."""
        usable = vectors.filter(F.col("embedding").isNotNull())
        size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        if not size["n"]:
            raise ValueError("there are no vectors to fit cells on")
        every = max(1, size["n"] // fit_rows)
        sample = usable.filter((F.size("embedding") == size["d"]) & (F.pmod(F.xxhash64(self.key), F.lit(every)) == 0)).select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        points = staged(sample.withColumn("norm", norm).filter("norm > 0").select(array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("features")))
        number = max(1, min(MOST_CELLS, cells or round(size["n"] ** 0.5)))
        if points.isEmpty():
            centroids = [[0.0] * size["d"]]
        else:
            centroids = [c.tolist() for c in KMeans(k=max(2, number), seed=seed, maxIter=10).fit(points).clusterCenters()]
        rows = self.spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        name = "c" + uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.path}/centroids/{name}")
        self.versions.change(lambda _: {"centroids": name, "dimension": size["d"], "segments": []})

    def centroids(self, state: dict) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids/{state['centroids']}").orderBy("cell").collect()  # at most MOST_CELLS
        return np.array([r["centroid"] for r in rows])

    def add(self, vectors: DataFrame) -> int:
        """Put every vector into its cell, and commit them as one segment."""
        state = self.versions.state()
        centroids, dimension, name = self.centroids(state), state["dimension"], "s" + uuid.uuid4().hex
        kept = vectors.filter(F.size("embedding") == dimension).select(self.key, self.tenant, "embedding")
        fields = [*[kept.schema[c] for c in (self.key, self.tenant, "embedding")], *T._parse_datatype_string("cell int, code binary, scale float").fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = unit(matrix(batch.column(2)))
                cell = nearest_cells(rows, centroids, 1)[:, 0] if len(rows) else np.zeros(0, np.int64)
                scale = np.abs(rows).max(axis=1, initial=0)
                codes = np.round(rows / np.where(scale > 0, scale, 1)[:, None] * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32))], names=[f.name for f in fields])

        coded = staged(kept.mapInArrow(run, T.StructType(fields)))
        parts = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))  # one row a cell
        dealt = coded.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(self.key), F.col("parts")))
        dealt.repartition("cell", "part").drop("parts", "part").write.partitionBy("cell").parquet(f"{self.path}/cells/segment={name}")
        return self.versions.change(lambda s: s | {"segments": [*s["segments"], name]} if s["centroids"] == state["centroids"] else None)["version"]

    def stored(self, state: dict) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/cells").parquet(*[f"{self.path}/cells/segment={s}" for s in state["segments"]])

    def search(self, queries: DataFrame, *, k: int = 10, probed: float = PROBED, refine: int = REFINE, by_tenant: bool = True, broadcast_bytes: int = BROADCAST_BYTES, version: int | None = None) -> DataFrame:
        """``query_id, <key>, score, rank``, mostly what ``nearest`` gives; the cosine decides, then the key.

        A larger share ``probed`` finds more; with 1 all cells are read. Queries
        go to the tasks in blocks of a checked size.
        """
        state = self.versions.state(version)
        centroids = self.centroids(state)
        count = min(len(centroids), max(1, -(-int(len(centroids) * probed * 1000) // 1000)))
        asked = queries.filter(F.size("embedding") == state["dimension"]).select("query_id", "embedding", *([self.tenant] if by_tenant else []))
        size = max(1, asked.count())
        blocks = max(1, -(-size * (state["dimension"] * 8 + len(centroids) // 8) // max(1, broadcast_bytes)))
        best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), self.key)

        def found(some: DataFrame) -> DataFrame:
            table = some.toArrow()
            rows = unit(matrix(table.column("embedding").combine_chunks()).reshape(table.num_rows, state["dimension"]))
            bits = asked_cells(rows, centroids, count) if count < len(centroids) else None  # else every query looks into every cell
            stored = self.stored(state)
            if bits is not None:
                stored = stored.filter(F.col("cell").isin(np.flatnonzero(bits.any(axis=1)).tolist()))  # folders of other cells are not opened
            tenants = np.array(table.column(self.tenant).to_pylist()) if by_tenant else None
            few = self.scan(stored, table.column("query_id").to_pylist(), rows.astype(np.float32), bits, tenants, k * refine, some.schema["query_id"].dataType)
            best_codes = Window.partitionBy("query_id").orderBy(F.col("score").desc(), self.key)
            few = staged(few.withColumn("place", F.row_number().over(best_codes)).filter(F.col("place") <= k * refine).select("query_id", self.key, "cell"))
            pairs = stored.select(self.key, "cell", "embedding").join(hinted(few, is_small(few)), [self.key, "cell"])
            both = pairs.join(F.broadcast(some.select("query_id", F.col("embedding").alias("asked"))), "query_id")  # a block of checked size
            return both.select("query_id", self.key, cosine_of("embedding", "asked").alias("score")).filter("score is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

        if blocks == 1:
            return found(asked)
        dealt = staged(asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
        return reduce(DataFrame.unionByName, [staged(found(dealt.filter(F.col("_block") == b).drop("_block"))) for b in range(blocks)])

    def scan(self, stored: DataFrame, ids: list, rows: np.ndarray, bits: np.ndarray | None, tenants: np.ndarray | None, keep: int, query_kind: T.DataType) -> DataFrame:
        """Each task's best candidates of each query by codes, from the cells that the query looks into; without ``bits`` from all."""
        schema = T.StructType([T.StructField("query_id", query_kind), stored.schema[self.key], T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())])
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for batch in batches:
                own_cells = batch.column(1).to_numpy()
                for cell in np.unique(own_cells).tolist() if bits is not None else [None]:
                    asking = np.arange(len(ids)) if bits is None else np.flatnonzero(np.unpackbits(bits[cell], count=len(ids)))
                    if not len(asking):
                        continue
                    step = max(1, SCORES_AT_ONCE // len(asking))
                    places = np.arange(batch.num_rows) if bits is None else np.flatnonzero(own_cells == cell)
                    for low in range(0, len(places), step):
                        part = batch.take(pa.array(places[low : low + step]))
                        codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int8).reshape(part.num_rows, -1).astype(np.float32)
                        scores = (rows[asking] @ codes.T) * (part.column(3).to_numpy() / 127)[None, :]
                        if tenants is not None:
                            scores[tenants[asking][:, None] != np.array(part.column(4).to_pylist())[None, :]] = -np.inf
                        keys, of = part.column(0).to_pylist(), part.column(1).to_pylist()
                        for q, row in zip(asking.tolist(), scores, strict=True):
                            some = np.flatnonzero(row >= np.partition(row, -keep)[-keep]) if len(row) > keep else range(len(row))
                            best[q] = heapq.nsmallest(keep, best.get(q, []) + [(-float(row[i]), keys[i], of[i]) for i in some if row[i] > -np.inf])
            out = [(ids[q], k, cell, -score) for q, own in best.items() for score, k, cell in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["query_id", key, "cell", "score"]).cast(arrow_of(schema))

        return stored.select(self.key, "cell", "code", "scale", *([self.tenant] if tenants is not None else [])).mapInArrow(run, schema)


def arrow_of(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


@F.pandas_udf(T.DoubleType())
def cosine_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosines of pairs; null where a vector is zero."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = np.stack(a.to_numpy()).astype(np.float64), np.stack(b.to_numpy()).astype(np.float64)
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series((x * y).sum(axis=1) / np.where(size > 0, size, 1)).where(size > 0)


def recall(found: DataFrame, exact: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """``query_id, wanted, found`` and their quotient: how many of the exact neighbours were found."""
    hit = found.select("query_id", key, F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", key], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
