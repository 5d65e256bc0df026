import re

from pyspark.sql import functions as F

from vellum.operators import dense
from vellum.operators.dense import blockwise, embed, hashing, nearest
from vellum.plans import corpus as c
from vellum.plans.queries_retrieval import pool

SF = "/root/testdata/sf0.001"


def test_a_text_is_embedded_once(spark):
    """One Python stage makes the vectors and the next one scores them; none is evaluated for a filter too."""
    texts = c.whole_documents(spark, SF)
    vectors = embed(texts, dimension=32)
    plan = blockwise(vectors, embed(texts.limit(3).withColumnRenamed("chunk_id", "query_id"), dimension=32).toPandas(), 5, "chunk_id", "user_id", "bigint")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan.split("== Initial Plan ==")[0])) == 1


def test_null_vectors_are_left_out(spark):
    rows = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", None), (3, "u", [0.0, 1.0])], "chunk_id long, user_id string, embedding array<double>")
    queries = rows.withColumnRenamed("chunk_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in nearest(rows, queries, k=2).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (3, 1, 3), (3, 2, 1)]
    assert nearest(rows.filter(F.lit(False)), queries).collect() == []


def test_a_worker_remembers_a_bounded_number_of_words():
    encode = hashing(16)
    known = next(c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict))
    for low in range(0, 250_000, 10_000):
        encode([" ".join(f"w{n}" for n in range(low, low + 10_000))])
        assert 0 < len(known) <= 100_000
    assert (encode(["w1 w2", "w2"]) == hashing(16)(["w1 w2", "w2"])).all()


def test_vectors_are_scored_in_pieces(spark, monkeypatch):
    """Any size of the pieces gives the same neighbours."""
    rows = spark.range(300).selectExpr("id as chunk_id", "'u' as user_id", "if(id % 50 = 7, null, array(rand(1) - 0.5, rand(2) - 0.5, rand(3) - 0.5)) as embedding").coalesce(2).localCheckpoint()
    queries = rows.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, nearest(rows, queries, k=5).collect()))
    monkeypatch.setattr(dense, "COMPONENTS_AT_ONCE", 12)
    assert sorted(map(tuple, nearest(rows, queries, k=5).collect())) == whole and len(whole) == 75


def test_texts_of_found_passages_are_not_shuffled(spark):
    """The few found rows go to the passages; a sort-merge join would shuffle and sort all texts."""
    plan = pool(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("== Final Plan ==")[-1]
