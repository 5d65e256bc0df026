"""Exact deduplication by a tree merge of digest runs; DataFrame functions only.

Rows are dealt into ``fan_in ** rounds`` runs by a hash of their id. Each run
is first reduced to one entry for each digest. In every round, ``fan_in``
neighbouring runs are merged into one, as in a binomial tree, until one run is
left. An entry is a struct, so Spark aggregates it by sorting: map tasks write
sorted runs that are already reduced, and the merge reads them in order. A
digest that holds a third of all rows is thus one entry for each run and task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, join_by_size, quoted

KEY = ["sha", "n_bytes", "proof"]


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and verified digest: SHA-256, length and an independent 64-bit hash."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), normalised(F.col(quoted(text_col))).alias("text"))
    return rows.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("proof"))


def tree_merge(rows: DataFrame, *, keep: str = "largest", fan_in: int = 4, rounds: int = 3) -> DataFrame:
    """One row for each digest: the id that stays and the size of its group.

    A null id stays only where a group has no other.
    """
    best = F.max if keep == "largest" else F.min
    run = F.pmod(F.xxhash64("id"), F.lit(fan_in**rounds)).cast("int")
    runs = rows.withColumn("run", run).groupBy(*KEY, "run").agg(best(F.when(F.col("id").isNotNull(), F.struct("id"))).alias("best"), F.count(F.lit(1)).alias("size"))
    for _ in range(rounds):
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy(*KEY, "run").agg(best("best").alias("best"), F.sum("size").alias("size"))
    return runs.select(*KEY, F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 4, rounds: int = 3) -> DataFrame:
    """Mark all but one of the rows whose texts are equal up to the case of A-Z.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each
    input row. Null text counts as empty. A null id stays only if its whole
    group has null ids; then each such row is kept. Rows that repeat the id that
    stays are all marked kept, as they are the same document. An empty table
    gives no rows; columns other than the two named are not read.
    """
    rows = cut(digests(docs, id_col, text_col))
    chosen = cut(tree_merge(rows, keep=keep, fan_in=fan_in, rounds=rounds))
    return join_by_size(rows, chosen, KEY, "group_size").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
