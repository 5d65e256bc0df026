"""Joins against a side of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def is_small(side: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a side has at most ``rows`` rows; the count stops there, so it is cheap for any size."""
    return side.limit(rows + 1).count() <= rows


def hinted(side: DataFrame, small: bool) -> DataFrame:
    """Mark a side of a checked size for broadcast; any other is joined by a shuffle."""
    return F.broadcast(side) if small else side


def with_first(rows: DataFrame, key: tuple[str, ...], arrival: str, carried: str) -> DataFrame:
    """Add ``_is_first``, true for one row of each key, and ``_first``, that row's ``carried``.

    The first is the least by arrival, then by ``carried``, nulls before all. It
    is an aggregate joined back, so a key of any size is never sorted in one
    task; only rows that are alike in all three are told apart by a window.
    """
    head = F.min(F.struct(F.col(arrival).alias("at"), F.col(carried).alias("of")))
    heads = rows.groupBy(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(key)]).agg(head.alias("_head"))
    same = F.lit(True)
    for n, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{n}"))
    alike = F.row_number().over(Window.partitionBy(*key, arrival, carried).orderBy(F.lit(1)))
    out = rows.withColumn("_alike", alike).join(heads, same)
    is_first = (F.col("_alike") == 1) & F.col(arrival).eqNullSafe(F.col("_head.at")) & F.col(carried).eqNullSafe(F.col("_head.of"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], is_first.alias("_is_first"), F.col("_head.of").alias("_first"))
