"""Registered queries of retrieval: lexical, dense, fused, hybrid and reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import STOP_WORDS
from vellum.operators.cells import CellIndex
from vellum.operators.dense import at_least, nearest, nearest_in_scope
from vellum.operators.fusion import overlap, reciprocal_rank_fusion, sweep
from vellum.operators.joins import hinted, is_small
from vellum.operators.lexical import lexical_search, query_terms, searchable, term_matches, term_weights, with_readiness
from vellum.operators.postings import PostingsIndex
from vellum.operators.rerank import rerank, rerank_head
from vellum.operators.staging import new_folder, staged
from vellum.plans import corpus as c
from vellum.plans.search import diagnostics, eligible_vectors, hybrid_search, reranked_search
from vellum.plans.search import candidates as hybrid_candidates

PHRASE_WORDS = 3
SWEEP_K = [10, 30, 60, 100]
SWEEP_WEIGHTS = [(1.0, 1.0), (1.0, 0.5), (0.5, 1.0), (1.0, 0.25), (0.25, 1.0)]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c_: F.round(c_, places) for c_ in columns})


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search(c.passages(spark, sf_dir), c.catalogue(spark, sf_dir), c.benchmark_queries(spark, sf_dir), limit=10)
    return rounded(found, "score")


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each benchmark item as one phrase."""
    head = F.array_join(F.slice(F.split("query", r"\s+"), 1, PHRASE_WORDS), " ")
    return c.benchmark_queries(spark, sf_dir).withColumn("phrases", F.array(head)).withColumn("words", F.lit(""))


def lexical_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = query_terms(phrase_queries(spark, sf_dir))
    matches = term_matches(c.passages(spark, sf_dir), terms).join(searchable(c.catalogue(spark, sf_dir)).select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")
    return terms.join(matches, ["user_id", "term"]).select("query_id", "term", "chunk_id")


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.catalogue(spark, sf_dir)
    flagged = with_readiness(term_matches(c.passages(spark, sf_dir), query_terms(c.benchmark_queries(spark, sf_dir))), docs)
    return rounded(term_weights(flagged, docs), "idf").filter("df > 0").select("term", F.col("df").cast("long").alias("df"), "idf")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nearest(c.vectors(spark, sf_dir), c.vector_queries(spark, sf_dir), k=10, tenant=None), "score")


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nearest(c.vectors(spark, sf_dir), c.vector_queries(spark, sf_dir), k=5), "score")


def dense_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(at_least(nearest(c.vectors(spark, sf_dir), c.vector_queries(spark, sf_dir), k=10, tenant=None), 0.5), "score")


def two_rankings(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """Two rankings of the same keys: by whole vectors, and by their first halves."""
    vectors, queries = c.vectors(spark, sf_dir), c.vector_queries(spark, sf_dir)
    half = F.slice("embedding", 1, 32)
    dense = nearest(vectors, queries, k=k, tenant=None)
    sparse = nearest(vectors.withColumn("embedding", half), queries.withColumn("embedding", half), k=k, tenant=None)
    return dense.select("query_id", F.lit("dense").alias("retriever"), "chunk_id", "rank").unionByName(sparse.select("query_id", F.lit("sparse").alias("retriever"), "chunk_id", "rank"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reciprocal_rank_fusion(two_rankings(spark, sf_dir), limit=20), "score", places=9)


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reciprocal_rank_fusion(two_rankings(spark, sf_dir), k=30, weights={"dense": 1.0, "sparse": 0.5}, limit=20), "score", places=9)


def rrf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweep(two_rankings(spark, sf_dir), SWEEP_K, SWEEP_WEIGHTS, limit=5), "score", places=9).select("k", "dense_weight", "sparse_weight", "query_id", "chunk_id", "score", "rank")


def fusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(two_rankings(spark, sf_dir), "dense", "sparse")


def document_search(spark: SparkSession, sf_dir: str, retrievers: tuple[str, ...] = ("dense", "sparse"), limit: int = 50, scope: DataFrame | None = None) -> DataFrame:
    """Candidates of whole documents for every benchmark item, of those in ``scope`` if there is one."""
    return hybrid_candidates(c.whole_documents(spark, sf_dir), document_vectors(spark, sf_dir), c.one_chunk_each(c.catalogue(spark, sf_dir)), c.embedded_queries(spark, sf_dir), retrievers=retrievers, limit=limit, scope=scope)


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.plans.search import embedded

    return embedded(c.whole_documents(spark, sf_dir), dimension=c.DIMENSION, element="double")


def hybrid(spark: SparkSession, sf_dir: str, retrievers: tuple[str, ...] = ("dense", "sparse"), top_k: int = 10) -> DataFrame:
    return hybrid_search(c.whole_documents(spark, sf_dir), document_vectors(spark, sf_dir), c.one_chunk_each(c.catalogue(spark, sf_dir)), c.embedded_queries(spark, sf_dir), retrievers=retrievers, top_k=top_k, weights={r: 1.0 for r in retrievers})


def hybrid_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hybrid(spark, sf_dir), "score", places=9).select("query_id", "chunk_id", "score", "dense_rank", "sparse_rank", "rank")


def hybrid_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hybrid(spark, sf_dir, retrievers=("sparse",)), "score", places=9).select("query_id", "chunk_id", "score", "sparse_rank", "rank")


def hybrid_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(document_search(spark, sf_dir)).select("query_id", "dense_candidates", "sparse_candidates", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def scoped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.whole_documents(spark, sf_dir).withColumn("embedding", F.array(F.lit(1.0)))
    return eligible_vectors(vectors, c.catalogue(spark, sf_dir)).select("chunk_id")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages of each query by words, to be reranked."""
    found = staged(lexical_search(c.passages(spark, sf_dir), c.catalogue(spark, sf_dir), c.benchmark_queries(spark, sf_dir), limit=20))
    # The few that were found go to the passages, whose texts are neither shuffled nor sorted.
    texts = c.passages(spark, sf_dir).select("chunk_id", "text").join(hinted(found, is_small(found)), "chunk_id")
    return texts.join(c.benchmark_queries(spark, sf_dir).select("query_id", "query"), "query_id").select("query_id", "query", "chunk_id", "text", F.col("rank").alias("retrieval_rank"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank(pool(spark, sf_dir), top_k=10)


def rerank_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_head(pool(spark, sf_dir), head=5, top_k=15)


def reranked_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked_search(hybrid(spark, sf_dir), c.benchmark_queries(spark, sf_dir))


def passage_index(spark: SparkSession, sf_dir: str) -> PostingsIndex:
    """A stored index of all passages."""
    index = PostingsIndex(spark, new_folder(spark, "postings"))
    index.update(c.passages(spark, sf_dir), c.catalogue(spark, sf_dir))
    return index


def lexical_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(passage_index(spark, sf_dir).search(c.benchmark_queries(spark, sf_dir), limit=10), "score")


def lexical_index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a third of the documents was taken out."""
    index = passage_index(spark, sf_dir)
    index.remove(c.catalogue(spark, sf_dir).filter("document_id % 3 = 0"))
    return rounded(index.search(c.benchmark_queries(spark, sf_dir), limit=10), "score")


def dense_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the vectors of two labels, other ones for each query's own label."""
    vectors = c.vectors(spark, sf_dir).withColumn("document_id", F.col("user_id"))
    queries = c.vector_queries(spark, sf_dir)
    scope = queries.select("query_id", F.explode(F.array((F.col("user_id") + 1) % 10, (F.col("user_id") + 3) % 10)).alias("document_id"))
    return rounded(nearest_in_scope(vectors, queries, scope, k=10, tenant=None), "score")


def lexical_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every fifth document, another fifth for each query; frequencies are those of all."""
    queries = c.benchmark_queries(spark, sf_dir)
    fifth = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 5).alias("part"))
    scope = queries.select("query_id", (F.col("query_id") % 5).alias("part")).join(fifth, "part").select("query_id", "document_id")
    return rounded(lexical_search(c.passages(spark, sf_dir), c.catalogue(spark, sf_dir), queries, limit=10, scope=scope), "score")


def cell_index(spark: SparkSession, sf_dir: str) -> CellIndex:
    """A stored index of all vectors by cell."""
    index = CellIndex(spark, new_folder(spark, "cells"))
    index.fit(c.vectors(spark, sf_dir))
    index.add(c.vectors(spark, sf_dir))
    return index


def cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours from the nearest cells."""
    return rounded(cell_index(spark, sf_dir).search(c.vector_queries(spark, sf_dir), by_tenant=False), "score")


def cells_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from all cells: codes choose the candidates, whole vectors decide."""
    return rounded(cell_index(spark, sf_dir).search(c.vector_queries(spark, sf_dir), by_tenant=False, probed=1.0, refine=16), "score")


QUERIES = {
    "dense_scoped_topk": dense_scoped,
    "lexical_scoped_topk": lexical_scoped,
    "dense_cells_topk": cells_topk,
    "dense_cells_all": cells_all,
    "lexical_topk": lexical_topk,
    "lexical_index_topk": lexical_index_topk,
    "lexical_index_changed": lexical_index_changed,
    "lexical_phrase": lexical_phrase,
    "term_idf": term_idf,
    "dense_topk": dense_topk,
    "dense_topk_filtered": dense_topk_filtered,
    "dense_min_score": dense_min_score,
    "rrf_fusion": rrf_fusion,
    "rrf_weighted": rrf_weighted,
    "rrf_sweep": rrf_sweep,
    "fusion_overlap": fusion_overlap,
    "hybrid_search": hybrid_search_query,
    "hybrid_degraded": hybrid_degraded,
    "hybrid_diagnostics": hybrid_diagnostics,
    "semi_scope": scoped_vectors,
    "rerank_topk": rerank_topk,
    "rerank_head_tail": rerank_head_tail,
    "reranked_search": reranked_hybrid,
}

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def lexical_sql(source: str, limit: int) -> str:
    """Tables up to ``lexical``: the best chunks of ``source`` for each benchmark item."""
    return rf"""{c.LINES_SQL},
chunks AS (SELECT chunk_id, document_id, text FROM {source}),
postings AS (SELECT chunk_id, document_id, unnest(list_distinct({c.TOKENS_SQL.format('text')})) AS term FROM chunks),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({c.TOKENS_SQL.format('text')}) AS term FROM benchmark),
terms AS (SELECT * FROM asked WHERE term NOT IN ({STOPS})),
total AS (SELECT count(*)::DOUBLE AS n FROM chunks WHERE document_id IN (SELECT document_id FROM ready)),
freq AS (
    SELECT term, count(*)::DOUBLE AS df FROM postings
    WHERE document_id IN (SELECT document_id FROM ready) AND term IN (SELECT term FROM terms) GROUP BY term
),
weights AS (SELECT term, df, ln(1 + (greatest(n, df) - df + 0.5) / (df + 0.5)) AS idf FROM freq, total),
scanned AS (
    SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS place
    FROM terms WHERE term IN (SELECT term FROM postings)
),
chosen AS (
    SELECT query_id, term, idf, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS place
    FROM scanned JOIN weights USING (term) WHERE place <= 36
),
scored AS (
    SELECT query_id, chunk_id, document_id, sum(idf) AS score
    FROM (SELECT * FROM chosen WHERE place <= 12) JOIN postings USING (term)
    WHERE document_id IN (SELECT document_id FROM ready) GROUP BY ALL
),
lexical AS (
    SELECT * FROM (
        SELECT query_id, chunk_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM scored
    ) WHERE rank <= {limit}
)"""


WHOLE = "(SELECT doc_id AS chunk_id, doc_id AS document_id, text FROM documents)"
LEXICAL_WHOLE = lexical_sql(WHOLE, 50)


def cosine_sql(name: str, where: str, k: int, part: str = "{0}") -> str:
    a, b = part.format("v.embedding::DOUBLE[]"), part.format("q.embedding::DOUBLE[]")
    return f"""{name} AS (
    SELECT * FROM (
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity({a}, {b}) AS score
            FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND {where}
        )
    ) WHERE rank <= {k}
)"""


TWO = cosine_sql("dense", "true", 50) + "," + cosine_sql("sparse", "true", 50, "list_slice({0}, 1, 32)")


def rrf_sql(k: str, dense: str, sparse: str, limit: int, params: str = "", group: str = "") -> str:
    """A select of the fused ranking of the tables ``dense`` and ``sparse``."""
    extra = f"{group}, " if group else ""
    return f"""
SELECT * FROM (
    SELECT {extra}query_id, chunk_id, score, dense_rank, sparse_rank,
           row_number() OVER (PARTITION BY {extra}query_id ORDER BY round(score, 12) DESC, least(dense_rank, sparse_rank), chunk_id::VARCHAR) AS rank
    FROM (
        SELECT {extra}query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank,
               coalesce({dense} / ({k} + d.rank), 0) + coalesce({sparse} / ({k} + s.rank), 0) AS score
        FROM dense d FULL JOIN sparse s USING (query_id, chunk_id){params}
    )
) WHERE rank <= {limit}"""


HASHED = rf"""
hashed_words AS (
    SELECT word, ('0x' || substr(sha256(word), 1, 8))::BIGINT % {c.DIMENSION} AS slot,
           CASE WHEN ('0x' || substr(sha256(word), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign
    FROM (SELECT term AS word FROM postings UNION SELECT term FROM asked UNION SELECT 'query' UNION SELECT 'passage')
),
word_rows AS (
    SELECT 'c' AS side, doc_id AS id, unnest(list_append({c.TOKENS_SQL.format('text')}, 'passage')) AS word FROM documents
    UNION ALL SELECT 'q', item_id, unnest(list_append({c.TOKENS_SQL.format('text')}, 'query')) FROM benchmark
),
slots AS (SELECT side, id, slot, sum(sign)::DOUBLE AS v FROM word_rows JOIN hashed_words USING (word) GROUP BY ALL),
norms AS (SELECT side, id, sqrt(sum(v * v)) AS norm FROM slots GROUP BY ALL),
dots AS (SELECT q.id AS query_id, k.id AS chunk_id, sum(q.v * k.v) AS dot FROM slots q JOIN slots k USING (slot) WHERE q.side = 'q' AND k.side = 'c' GROUP BY ALL),
dense AS (
    SELECT * FROM (
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM (
            SELECT query_id, chunk_id, dot / (a.norm * b.norm) AS score FROM dots
            JOIN norms a ON a.side = 'q' AND a.id = query_id JOIN norms b ON b.side = 'c' AND b.id = chunk_id
            WHERE chunk_id IN (SELECT document_id FROM ready)
        )
    ) WHERE rank <= 50
)"""
SPARSE = "sparse AS (SELECT query_id, chunk_id, score, rank FROM lexical)"
HYBRID = f"WITH {LEXICAL_WHOLE},{HASHED},{SPARSE}"
WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"
POOL = f"""{lexical_sql('passages', 20)},
pool AS (
    SELECT query_id, chunk_id, p.text, b.text AS query, rank AS retrieval_rank,
           len(list_intersect({WORDS.format('b.text')}, {WORDS.format('p.text')}))::DOUBLE AS overlap
    FROM lexical JOIN passages p USING (chunk_id) JOIN benchmark b ON b.item_id = query_id
)"""

HEAD = r"array_to_string(regexp_split_to_array(text, '\s+')[1:3], ' ')"

LEXICAL_TOPK = f"WITH {lexical_sql('passages', 10)} SELECT query_id, chunk_id, document_id, round(score, 6) AS score, rank FROM lexical"
ORACLE_SQL = {
    "lexical_topk": LEXICAL_TOPK,
    "dense_scoped_topk": f"WITH {cosine_sql('found', 'v.label IN ((q.label + 1) % 10, (q.label + 3) % 10)', 10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM found",
    "lexical_scoped_topk": LEXICAL_TOPK.replace("AS rank FROM scored", "AS rank FROM scored WHERE document_id % 5 = query_id % 5"),
    "lexical_index_topk": LEXICAL_TOPK,
    "dense_cells_all": f"WITH {cosine_sql('found', 'true', 10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM found",
    "lexical_index_changed": LEXICAL_TOPK.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0)"),
    "lexical_phrase": rf"""WITH {c.LINES_SQL},
        asked AS (SELECT item_id AS query_id, array_to_string({c.TOKENS_SQL.format(HEAD)}, ' ') AS term FROM benchmark)
        SELECT query_id, term, chunk_id FROM asked, passages
        WHERE document_id IN (SELECT document_id FROM ready) AND contains(' ' || array_to_string({c.TOKENS_SQL.format('text')}, ' ') || ' ', ' ' || term || ' ')""",
    "term_idf": f"WITH {lexical_sql('passages', 10)} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM weights",
    "dense_topk": f"WITH {cosine_sql('found', 'true', 10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM found",
    "dense_topk_filtered": f"WITH {cosine_sql('found', 'v.label = q.label', 5)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM found",
    "dense_min_score": f"WITH {cosine_sql('found', 'true', 10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM found WHERE score >= 0.5",
    "rrf_fusion": f"WITH {TWO} SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, sparse_rank, rank FROM ({rrf_sql('60', '1.0', '1.0', 20)})",
    "rrf_weighted": f"WITH {TWO} SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, sparse_rank, rank FROM ({rrf_sql('30', '1.0', '0.5', 20)})",
    "rrf_sweep": f"""WITH {TWO}, ks AS (SELECT unnest([10, 30, 60, 100])::INT AS k),
        pairs AS (SELECT unnest([1.0, 1.0, 0.5, 1.0, 0.25])::DOUBLE AS dense_weight, unnest([1.0, 0.5, 1.0, 0.25, 1.0])::DOUBLE AS sparse_weight)
        SELECT k, dense_weight, sparse_weight, query_id, chunk_id, round(score, 9) AS score, rank
        FROM ({rrf_sql('k', 'dense_weight', 'sparse_weight', 5, ', ks, pairs', 'k, dense_weight, sparse_weight')})""",
    "fusion_overlap": f"WITH {TWO} SELECT query_id, count(s.chunk_id) AS overlap FROM dense d LEFT JOIN sparse s USING (query_id, chunk_id) GROUP BY query_id",
    "hybrid_search": f"{HYBRID} SELECT query_id, chunk_id, round(score, 9) AS score, dense_rank, sparse_rank, rank FROM ({rrf_sql('60', '1.0', '1.0', 10)})",
    "hybrid_degraded": f"WITH {LEXICAL_WHOLE} SELECT query_id, chunk_id, round(1.0 / (60 + rank), 9) AS score, rank AS sparse_rank, rank FROM lexical WHERE rank <= 10",
    "hybrid_diagnostics": f"""{HYBRID} SELECT query_id, count(d.rank) AS dense_candidates, count(s.rank) AS sparse_candidates, count(CASE WHEN d.rank IS NOT NULL AND s.rank IS NOT NULL THEN 1 END) AS overlap
        FROM dense d FULL JOIN sparse s USING (query_id, chunk_id) GROUP BY query_id""",
    "semi_scope": f"WITH {c.LINES_SQL} SELECT document_id AS chunk_id FROM ready",
    "rerank_topk": f"""WITH {POOL} SELECT * FROM (
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, retrieval_rank, chunk_id::VARCHAR) AS rank, overlap AS score, retrieval_rank, length(text) > 400 AS truncated FROM pool
        ) WHERE rank <= 10""",
    "rerank_head_tail": f"""WITH {POOL} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, retrieval_rank, chunk_id::VARCHAR) AS rank, overlap AS score, retrieval_rank, length(text) > 400 AS truncated
        FROM pool WHERE retrieval_rank <= 5
        UNION ALL SELECT query_id, chunk_id, retrieval_rank, NULL, retrieval_rank, length(text) > 400 FROM pool WHERE retrieval_rank BETWEEN 6 AND 15""",
    "reranked_search": f"""{HYBRID}, fused AS ({rrf_sql('60', '1.0', '1.0', 10)}),
        rescored AS (SELECT query_id, chunk_id, rank AS retrieval_rank, d.text, len(list_intersect({WORDS.format('b.text')}, {WORDS.format('d.text')}))::DOUBLE AS score
                   FROM fused JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank, chunk_id::VARCHAR) AS rank, score, retrieval_rank, length(text) > 400 AS truncated FROM rescored""",
}
