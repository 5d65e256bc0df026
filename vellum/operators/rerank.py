"""Reranking: scores of (query, passage) pairs and their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_PASSAGE = 400
Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Make a reranker known: a function of the query and passage columns, such as an iterator pandas UDF."""
    SCORERS[name] = scorer


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def word_overlap(query: Column, passage: Column) -> Column:
    """The default scorer: how many distinct words of the query the passage has."""
    return F.size(F.array_intersect(words(query), words(passage))).cast("double")


register_scorer("overlap", word_overlap)


def rerank(candidates: DataFrame, *, scorer: str = "overlap", top_k: int = 10, key: str = "chunk_id", long_passage: int = LONG_PASSAGE) -> DataFrame:
    """Order ``query_id, query, <key>, text, retrieval_rank`` by raw score.

    A repeated key counts once, at its best rank. Ties fall to the retrieval
    rank and then to the key as text. A score that is not finite is an error,
    as it must never become a rank.
    """
    if top_k <= 0:
        candidates = candidates.limit(0)
    once = candidates.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", key).orderBy("retrieval_rank"))).filter(F.col("turn") == 1)
    raw = SCORERS[scorer](F.col("query"), F.col("text"))
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    scored = once.withColumn("score", F.when(bad, F.raise_error(F.lit("scores must be finite"))).otherwise(raw))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "retrieval_rank", F.col(key).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", key, "rank", "score", "retrieval_rank", (F.length("text") > long_passage).alias("truncated"))


def rerank_head(candidates: DataFrame, *, head: int, scorer: str = "overlap", top_k: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Reorder the first ``head`` candidates and append the rest in retrieval order."""
    first = rerank(candidates.filter(F.col("retrieval_rank") <= head), scorer=scorer, top_k=head, key=key)
    tail = candidates.filter(F.col("retrieval_rank") > head).select("query_id", key, F.col("retrieval_rank").alias("rank"), F.lit(None).cast("double").alias("score"), "retrieval_rank", (F.length("text") > LONG_PASSAGE).alias("truncated"))
    out = first.unionByName(tail)
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def rerank_arms(candidates: DataFrame, depths: list[int], *, scorer: str = "overlap", key: str = "chunk_id") -> DataFrame:
    """``arm, query_id, <key>, rank`` of reranking the first n candidates, for every depth n.

    Each pair of query and passage is scored once, whatever the number of
    depths; the candidates behind the depth keep their order.
    """
    scored = candidates.select("query_id", key, "retrieval_rank", SCORERS[scorer](F.col("query"), F.col("text")).alias("score"))
    depth = F.explode(F.array(*[F.lit(n) for n in depths]))
    head = F.col("retrieval_rank") <= F.col("depth")
    order = Window.partitionBy("depth", "query_id").orderBy((~head).cast("int"), F.when(head, -F.col("score")).otherwise(0.0), "retrieval_rank")
    ranked = scored.withColumn("depth", depth).withColumn("rank", F.row_number().over(order))
    return ranked.select(F.concat(F.lit("hybrid+rerank@"), "depth").alias("arm"), "query_id", key, "rank")
