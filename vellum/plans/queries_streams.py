"""Registered queries of ordered streams: each reads all events as a stream and gives what the batch form gives."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.staging import new_folder
from vellum.streaming.ordered import limited, overdue, rotations

WINDOW_SECONDS, MOST_HITS, SILENCE_HOURS = 3600, 2, 6
#: A time after all events; it stands for the end of the stream.
END = datetime(2100, 1, 1)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, and a last one of no user that lets the watermark pass them."""
    path, end = f"{sf_dir}/events.parquet", new_folder(spark, "end")
    columns = ["event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props"]
    table = spark.read.parquet(path)
    last = spark.createDataFrame([(-1, None, END, None, None)], table.select(*columns).schema)
    last.coalesce(1).write.parquet(end)
    events = spark.readStream.schema(table.schema).parquet(path + "*").select(*columns)  # a pattern, as the table may be one file
    return events.unionByName(spark.readStream.schema(last.schema).parquet(end))


def drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream until nothing is left, and read what it wrote."""
    out = new_folder(spark, "drained")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = limited(event_stream(spark, sf_dir), key="user_id", at="ts", order="event_id", window=timedelta(seconds=WINDOW_SECONDS), most=MOST_HITS)
    return drained(hits, spark).filter("event_id >= 0").select("event_id", "attempt", "allowed")


def stream_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of whom nothing was heard for hours after an event that is no error; an error ends the wait."""
    late = overdue(event_stream(spark, sf_dir), key="user_id", at="ts", order="event_id", after=timedelta(hours=SILENCE_HOURS), alive=F.col("event_type") != "error")
    return drained(late, spark).filter("user_id is not null").select("user_id", F.unix_micros("since").alias("since_us"))


def stream_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a family of tokens, each event as a presentation of the token that its properties name."""
    used = rotations(event_stream(spark, sf_dir), family="user_id", token="props", at="ts", order="event_id", keep=timedelta(days=60))
    return drained(used, spark).filter("event_id >= 0").select("event_id", "outcome")


QUERIES = {f.__name__: f for f in (stream_windows, stream_overdue, stream_rotations)}
ORACLE_SQL = {
    "stream_windows": f"""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        w AS (SELECT event_id, user_id, n, ts AS anchor, 1 AS attempt FROM o WHERE n = 1
              UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN o.ts >= w.anchor + INTERVAL {WINDOW_SECONDS} SECOND THEN o.ts ELSE w.anchor END, CASE WHEN o.ts >= w.anchor + INTERVAL {WINDOW_SECONDS} SECOND THEN 1 ELSE w.attempt + 1 END
              FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
        SELECT event_id, attempt, attempt <= {MOST_HITS} AS allowed FROM w""",
    "stream_overdue": f"""WITH e AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
        SELECT user_id, epoch_us(ts) AS since_us FROM e WHERE event_type <> 'error' AND coalesce(nxt, TIMESTAMP '2099-01-01') > ts + INTERVAL {SILENCE_HOURS} HOUR""",
    "stream_rotations": """WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS use FROM events),
        f AS (SELECT *, min(CASE WHEN use > 1 THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS first FROM e)
        SELECT event_id, CASE WHEN first IS NULL OR (ts, event_id) < first THEN 'rotated' WHEN (ts, event_id) = first THEN 'reused' ELSE 'rejected' END AS outcome FROM f""",
}
