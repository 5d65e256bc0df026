"""Rate limits by a window that the first hit opens."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def anchored_windows(hits: DataFrame, *, key: str, at: str, order: str, window: timedelta, most: int) -> DataFrame:
    """Add ``attempt`` and ``allowed``: the window opens at a key's first hit and ends a fixed time after it.

    Every attempt counts, also a refused one; the first hit after the end opens
    the next window. Rows come sorted by key and time and pass one by one with
    two values as state, so a key may have any number of hits, though they pass
    through one task: a window's start depends on all before it. A hit without a
    time lies in no window and has null in both columns; null keys are one key.
    """
    span = int(window.total_seconds() * 1_000_000)
    sorted_ = hits.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_at", order)
    places = [sorted_.columns.index(c) for c in (key, "_at")]
    names = [*hits.columns, "attempt"]
    schema = T.StructType([*hits.schema.fields, T.StructField("attempt", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, anchor, count, started = None, 0, 0, False
        for batch in batches:
            attempts: list[int | None] = []
            for k, t in zip(*(batch.column(p).to_pylist() for p in places), strict=True):
                if t is None:
                    attempts.append(None)
                    continue
                if not started or k != owner or t >= anchor + span:
                    owner, anchor, count, started = k, t, 0, True
                count += 1
                attempts.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(attempts, pa.int32())], names=names)

    return sorted_.mapInArrow(run, schema).withColumn("allowed", F.col("attempt") <= most)
