"""Search plans: semantic, hybrid and reranked search over a query table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.dense import at_least, embed, nearest, nearest_in_scope
from vellum.operators.fusion import K, overlap, reciprocal_rank_fusion
from vellum.operators.lexical import CANDIDATES, lexical_search, searchable
from vellum.operators.rerank import rerank

MAX_QUERY_CHARS, DEFAULT_TOP_K, MAX_TOP_K = 1000, 10, 50


def resolve_top_k(top_k: int | None) -> int:
    """The default for none, never above the maximum."""
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1")
    return min(DEFAULT_TOP_K if top_k is None else top_k, MAX_TOP_K)


def invalid_queries(queries: DataFrame, max_chars: int = MAX_QUERY_CHARS) -> DataFrame:
    """Queries that are empty or too long, each with its reason."""
    text = F.trim(F.coalesce("query", F.lit("")))
    return queries.withColumn("reason", F.when(text == "", "empty").when(F.length(text) > max_chars, "too_long")).filter("reason is not null")


def unowned_scope(scope: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested ``query_id, user_id, document_id`` that the user does not own; any makes the request fail."""
    return scope.distinct().join(documents.select("user_id", "document_id"), ["user_id", "document_id"], "left_anti")


def eligible_vectors(vectors: DataFrame, documents: DataFrame, document_ids: list | None = None) -> DataFrame:
    """Vectors of searchable documents; an empty list filters nothing."""
    ready = searchable(documents)
    if document_ids:
        ready = ready.filter(F.col("document_id").isin(document_ids))
    return vectors.join(ready.select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame, *, active_only: bool = True) -> DataFrame:
    """Metadata of the few chosen chunks; the limit comes first, so the joins stay small.

    Chunks that are gone are left out and ranks renumbered; retriever ranks stay.
    """
    owned = searchable(documents) if active_only else documents
    full = ranked.join(chunks.select("chunk_id", "document_id", "user_id", "text"), "chunk_id").join(owned.select("document_id", "user_id"), ["document_id", "user_id"], "left_semi")
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def semantic_search(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, queries: DataFrame, *, top_k: int | None = None, min_score: float | None = None, document_ids: list | None = None) -> DataFrame:
    """Nearest chunks of each embedded query, hydrated; ``min_score`` filters after ranks are given."""
    ranked = nearest(eligible_vectors(vectors, documents, document_ids), queries, k=resolve_top_k(top_k))
    if min_score is not None:
        ranked = at_least(ranked, min_score)
    return ranked.join(chunks.select("chunk_id", "document_id", "text"), "chunk_id")


def candidates(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, queries: DataFrame, *, retrievers: tuple[str, ...] = ("dense", "sparse"), limit: int = CANDIDATES, scope: DataFrame | None = None) -> DataFrame:
    """Candidates of each retriever as ``query_id, retriever, chunk_id, rank, score``; ``scope`` names the documents of each query."""
    parts = []
    if "dense" in retrievers:
        ready = eligible_vectors(vectors, documents)
        found = nearest(ready, queries, k=limit) if scope is None else nearest_in_scope(ready, queries, scope, k=limit)
        parts.append(found.select("query_id", F.lit("dense").alias("retriever"), "chunk_id", "rank", "score"))
    if "sparse" in retrievers:
        parts.append(lexical_search(chunks, documents, queries, limit=limit, scope=scope).select("query_id", F.lit("sparse").alias("retriever"), "chunk_id", "rank", "score"))
    if not parts:
        raise ValueError("at least one retriever is needed")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hybrid_search(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, queries: DataFrame, *, top_k: int | None = None, retrievers: tuple[str, ...] = ("dense", "sparse"), weights: dict[str, float] | None = None, k: int = K, limit: int = CANDIDATES) -> DataFrame:
    """Fuse the retrievers' candidates, then hydrate the best.

    Leaving a retriever out of ``retrievers`` is the degraded form: the other
    one's ranks are fused alone.
    """
    found = candidates(chunks, vectors, documents, queries, retrievers=retrievers, limit=limit)
    fused = reciprocal_rank_fusion(found, k=k, weights=weights, limit=resolve_top_k(top_k))
    return hydrate(fused, chunks, documents)


def diagnostics(found: DataFrame, retrievers: tuple[str, ...] = ("dense", "sparse")) -> DataFrame:
    """One row for each query: candidates of each retriever and their overlap."""
    counts = found.groupBy("query_id").agg(*[F.count_if(F.col("retriever") == r).alias(f"{r}_candidates") for r in ("dense", "sparse")])
    return counts.join(overlap(found, "dense", "sparse"), "query_id", "left").withColumn("degraded", F.array(*[F.lit(r) for r in ("dense", "sparse") if r not in retrievers]).cast("array<string>"))


def reranked_search(hybrid: DataFrame, queries: DataFrame, *, candidates: int = 10, top_k: int = 10, scorer: str = "overlap") -> DataFrame:
    """The first ``candidates`` of a hybrid result by reranker score; ``top_k`` may not exceed them."""
    if not 0 < top_k <= candidates <= 100:
        raise ValueError("top_k may not exceed candidates, nor candidates 100")
    pool = hybrid.filter(F.col("rank") <= candidates).join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "chunk_id", "text", F.col("rank").alias("retrieval_rank"))
    return rerank(pool, scorer=scorer, top_k=top_k)


def embedded(chunks: DataFrame, *, dimension: int, element: str = "float") -> DataFrame:
    """Vectors of chunks under the default model and passage prefix."""
    return embed(chunks, prefix="passage: ", dimension=dimension, element=element).select("chunk_id", "document_id", "user_id", "embedding")
