"""Reciprocal rank fusion and its diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def unique_positions(rankings: DataFrame, key: str) -> DataFrame:
    """First occurrence of each key, positions renumbered without gaps."""
    first = rankings.groupBy("query_id", "retriever", key).agg(F.min("rank").alias("rank"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id", "retriever").orderBy("rank", key)))


def reciprocal_rank_fusion(rankings: DataFrame, *, key: str = "chunk_id", k: int = K, weights: dict[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """Fuse ``(query_id, retriever, <key>, rank)`` into ``query_id, <key>, score, <retriever>_rank ..., rank``.

    A retriever of weight 0 takes no part. Scores are added in the order of the
    retrievers' names; order is by score to 12 places, best single rank, and the
    key as text, so "10" comes before "9".
    """
    weights = weights or {"dense": 1.0, "sparse": 1.0}
    if k < 1 or any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("k must be at least 1 and weights finite and not negative")
    names = sorted(n for n, w in weights.items() if w > 0)
    wide = unique_positions(rankings.filter(F.col("retriever").isin(*names)), key).groupBy("query_id", key).agg(*[F.max(F.when(F.col("retriever") == n, F.col("position"))).alias(f"{n}_rank") for n in names])
    score = F.lit(0.0)
    for n in names:
        score = score + F.coalesce(F.lit(weights[n]) / (k + F.col(f"{n}_rank")), F.lit(0.0))
    best = F.least(*[F.col(f"{n}_rank") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_rank")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), best, F.col(key).cast("string"))
    fused = wide.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return fused if limit is None else fused.filter(F.col("rank") <= max(limit, 0))


def overlap(rankings: DataFrame, first: str, second: str, *, key: str = "chunk_id") -> DataFrame:
    """How many keys two retrievers share, for each query."""
    pair = rankings.filter(F.col("retriever").isin(first, second)).groupBy("query_id", key).agg(F.countDistinct("retriever").alias("n"))
    return pair.groupBy("query_id").agg(F.count_if(F.col("n") == 2).alias("overlap"))


def sweep(rankings: DataFrame, ks: list[int], weight_pairs: list[tuple[float, float]], *, key: str = "chunk_id", limit: int = 10) -> DataFrame:
    """Fused rankings for every combination of ``k`` and weights, in one plan over the recorded rankings."""
    params = rankings.sparkSession.createDataFrame([(k, float(d), float(s)) for k in ks for d, s in weight_pairs], "k int, dense_weight double, sparse_weight double")
    wide = unique_positions(rankings, key).groupBy("query_id", key).agg(*[F.max(F.when(F.col("retriever") == n, F.col("position"))).alias(f"{n}_rank") for n in ("dense", "sparse")])
    own = wide.crossJoin(F.broadcast(params)).withColumn("dense_rank", F.when(F.col("dense_weight") > 0, F.col("dense_rank"))).withColumn("sparse_rank", F.when(F.col("sparse_weight") > 0, F.col("sparse_rank")))
    own = own.filter(F.col("dense_rank").isNotNull() | F.col("sparse_rank").isNotNull())
    score = F.coalesce(F.col("dense_weight") / (F.col("k") + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.col("sparse_weight") / (F.col("k") + F.col("sparse_rank")), F.lit(0.0))
    order = Window.partitionBy("k", "dense_weight", "sparse_weight", "query_id").orderBy(F.round("score", 12).desc(), F.least("dense_rank", "sparse_rank"), F.col(key).cast("string"))
    return own.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
