import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import cells
from vellum.operators.cells import CellIndex, recall
from vellum.operators.dense import nearest
from vellum.plans import corpus as c

SF = "/root/testdata/sf0.1"
KIND = "chunk_id string, user_id string, embedding array<double>"


def index_of(spark, path, vectors, **fit):
    index = CellIndex(spark, str(path))
    index.fit(vectors, **fit)
    index.add(vectors)
    return index


def test_recall_on_all_queries(spark, tmp_path):
    """Every row whose id is divisible by 20, against all rows."""
    vectors, queries = c.vectors(spark, SF), c.vector_queries(spark, SF)
    index = index_of(spark, tmp_path / "all", vectors)
    exact = nearest(vectors, queries, k=10, tenant=None).cache()
    found = index.search(queries, by_tenant=False)
    assert recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert index.search(queries, by_tenant=False, broadcast_bytes=64 * 8 * 30, probed=1.0).count() == exact.count()  # several blocks of queries
    own = index.search(queries, k=5, probed=1.0, refine=16)
    same = nearest(vectors, queries, k=5)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(own) == key(same)


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 32))
    rows = [(f"v{n}", "u", (centers[n % 20] + rng.normal(scale=0.1, size=32)).tolist()) for n in range(2000)]
    vectors = spark.createDataFrame(rows, KIND)
    queries = vectors.limit(60).withColumnRenamed("chunk_id", "query_id")
    index = index_of(spark, tmp_path / "few", vectors, fit_rows=500)
    exact = nearest(vectors, queries, k=10)
    assert recall(index.search(queries, probed=0.15), exact).agg(F.avg("recall")).first()[0] >= 0.9
    plan = index.stored(index.versions.state()).filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_a_hot_vector_and_odd_rows(spark, tmp_path, monkeypatch):
    """A third of all rows are one vector: its cell has several parts, and ties go to the smaller keys."""
    monkeypatch.setattr(cells, "PART_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(f"{n:04d}", "u", [1.0, 0.0, 0.0] if n % 3 == 0 else rng.normal(size=3).tolist()) for n in range(600)]
    rows += [("zero", "u", [0.0, 0.0, 0.0]), ("null", "u", None), ("long", "u", [1.0] * 2)]
    index = index_of(spark, tmp_path / "hot", spark.createDataFrame(rows, KIND).filter("chunk_id <> 'long'"))
    index.add(spark.createDataFrame([("0000-new", "u", [1.0, 0.0, 0.0]), ("long", "u", [1.0] * 2)], KIND))
    queries = spark.createDataFrame([("q", "u", [2.0, 0.0, 0.0]), ("other", "t", [1.0, 0.0, 0.0])], "query_id string, user_id string, embedding array<double>")
    got = index.search(queries, k=3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [("0000", 1.0), ("0000-new", 1.0), ("0003", 1.0)]
    assert [r.chunk_id for r in index.search(queries, k=3, version=2).orderBy("rank").collect()] == ["0000", "0003", "0006"]
    assert index.search(queries.limit(0)).collect() == []


def test_nothing_to_fit(spark, tmp_path):
    with pytest.raises(ValueError):
        CellIndex(spark, str(tmp_path / "none")).fit(spark.createDataFrame([("a", "u", None)], KIND))
    zero = spark.createDataFrame([("a", "u", [0.0, 0.0])], KIND)
    index = index_of(spark, tmp_path / "zero", zero)
    assert index.search(zero.withColumnRenamed("chunk_id", "query_id")).collect() == []


def test_the_driver_holds_bits_of_queries_and_cells(spark, tmp_path):
    """Who looks into which cell is a bit, and its distances are held for some queries at a time: 20,000 queries times 200 cells were 32 MB a copy."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(f"{n:04d}", "u", rng.normal(size=4).tolist()) for n in range(400)], KIND)
    index = index_of(spark, tmp_path / "bits", vectors, cells=200)
    queries = spark.range(20_000).selectExpr("id as query_id", "'u' as user_id", "array(rand(1) - 0.5, rand(2) - 0.5, rand(3) - 0.5, rand(4) - 0.5) as embedding")
    tracemalloc.start()
    found = index.search(queries, k=1, refine=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert found.count() == 20_000


def test_asked_cells_are_the_nearest(monkeypatch):
    monkeypatch.setattr(cells, "DISTANCES_AT_ONCE", 300)
    rng = np.random.default_rng(4)
    rows, centroids = rng.normal(size=(101, 3)), rng.normal(size=(17, 3))
    near, bits = cells.nearest_cells(rows, centroids, 5), cells.asked_cells(rows, centroids, 5)
    for cell in range(17):
        assert np.flatnonzero(np.unpackbits(bits[cell], count=101)).tolist() == np.flatnonzero((near == cell).any(axis=1)).tolist()
