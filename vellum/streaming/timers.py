"""Time-driven state over event streams: stalls, repeats, expiry (R3, R5, R7, R8); what needs order is in ``ordered``."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stalls(heartbeats: DataFrame, *, key: str, at: str, after: timedelta, lateness: str = "10 minutes") -> DataFrame:
    """A row for each key whose last heartbeat is older than ``after`` in event time.

    One time is kept for each key; a timer that the watermark passes reports the
    key and drops it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in heartbeats.schema}
    span = int(after.total_seconds() * 1000)

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [own[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = max(int(f["_us"].max()) for f in frames)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + span, state.getCurrentWatermarkMs() + 1))

    rows = heartbeats.filter(F.col(at).isNotNull()).withWatermark(at, lateness).withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, last_seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def first_of_each(requests: DataFrame, *, keys: list[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """The first request of each key within the lateness; repeats are dropped and state is bounded by it."""
    return requests.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def expired(tokens: DataFrame, as_of, keep: timedelta = timedelta(days=1)) -> DataFrame:
    """Tokens that expired more than ``keep`` ago."""
    return tokens.filter(F.col("expires_at") < as_of - F.expr(f"interval {int(keep.total_seconds())} seconds"))


def revoked_families(tokens: DataFrame) -> DataFrame:
    """Families in which a token was presented after its revocation; all of their tokens are void."""
    return tokens.filter(F.col("presented_at") > F.col("revoked_at")).select("family_id").distinct()
