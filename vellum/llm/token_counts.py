"""Token counts: an exact histogram of encoded lengths, and its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bpe import MODEL, loaded
from vellum.llm.common import cut, map_rows, quoted, text_of

BLOCK = 4096


def token_lengths(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encoded length of each text, one row for each document; null text has length 0."""
    path = path or public_tokenizers.path(MODEL)

    def start():
        pairs = loaded(path)

        def one(text: str) -> Iterator[tuple]:
            yield (len(pairs.encode(text)) // 4,)

        return one

    return map_rows(docs, [text_of(quoted(text_col))], "n_tokens bigint", start)


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """Histogram of ``n_tokens`` with what lies above and below each length.

    For a context limit L, look up the greatest ``n_tokens`` at or below L: the
    tokens left after truncation to L are ``tokens_at_most + docs_longer * L``.
    Lengths are summed in blocks and the blocks among themselves, so that no
    task needs the whole histogram; its rows are bounded by the longest
    document, not by their number.
    """
    counts = cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).withColumns({"docs_above": F.coalesce(F.sum("d").over(above), F.lit(0)), "tokens_above": F.coalesce(F.sum("t").over(above), F.lit(0))})
    totals = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.join(F.broadcast(blocks.select("block", "docs_above", "tokens_above")), "block").withColumns(
        {"docs_longer": F.col("docs_above") + F.coalesce(F.sum("n_docs").over(within), F.lit(0)), "tokens_longer": F.col("tokens_above") + F.coalesce(F.sum("tokens").over(within), F.lit(0))}
    )
    return longer.crossJoin(F.broadcast(totals)).select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        "docs_longer",
        "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        F.try_divide((F.col("all_docs") - F.col("docs_longer")).cast("double"), F.col("all_docs").cast("double")).alias("quantile"),
    )


def token_counts(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Length histogram of the documents with suffix sums; an empty table gives no rows."""
    return suffix_sums(token_lengths(docs, text_col=text_col, path=path))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens that are left, and documents that are cut, at one context limit.

    Both are read from the suffix sums of the greatest length at or below the
    limit; if every document is longer, each keeps ``limit`` tokens.
    """
    sums = F.max_by(F.struct("tokens_at_most", "docs_longer"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))).alias("at")
    row = histogram.agg(sums, F.coalesce(F.max("docs_at_most"), F.lit(0)).alias("all_docs"))
    longer = F.coalesce("at.docs_longer", "all_docs")
    return row.select((F.coalesce("at.tokens_at_most", F.lit(0)) + longer * limit).alias("tokens_kept"), longer.alias("docs_cut"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed."""
    return histogram.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
