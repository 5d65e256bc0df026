"""Conversations as batch transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import default_title, fingerprint
from vellum.operators.joins import with_first

MOST_MESSAGES, MOST_CONVERSATIONS = 400, 1000
INTERRUPTED_AFTER = 480


def sequenced(messages: DataFrame) -> DataFrame:
    """Gapless numbers from 1 in each conversation."""
    return messages.withColumn("sequence", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def request_fingerprint(question: Column, scope: Column) -> Column:
    """V9: what an idempotency key stands for."""
    return fingerprint(question, scope)


def idempotent(requests: DataFrame, *, key: tuple[str, ...] = ("conv_id", "idempotency_key"), content: str = "request_hash", arrival: str = "arrived") -> DataFrame:
    """The first request of a key is new; a later one with the same content is a replay, with another a conflict."""
    rows = with_first(requests, key, arrival, content)
    return rows.withColumn("outcome", F.when(F.col("_is_first"), "new").when(F.col("_first").eqNullSafe(F.col(content)), "replay").otherwise("conflict")).drop("_is_first", "_first")


def in_flight_conflicts(messages: DataFrame) -> DataFrame:
    """Conversations with more than one question in progress."""
    return messages.filter((F.col("role") == "user") & (F.col("status") == "processing")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def interrupted(messages: DataFrame, as_of: Column, after: int = INTERRUPTED_AFTER) -> DataFrame:
    """Questions in progress for longer than the limit become failed."""
    late = (F.col("status") == "processing") & (F.col("started_at") < as_of - F.expr(f"interval {int(after)} seconds"))
    return messages.withColumns({"failure": F.when(late, "interrupted").otherwise(F.lit(None).cast("string")), "status": F.when(late, "failed").otherwise(F.col("status"))})


def resumed(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """A failed question that is asked again goes on with one attempt more."""
    again = requests.select("message_id", F.lit(True).alias("again")).distinct()
    hit = F.coalesce("again", F.lit(False)) & (F.col("status") == "failed")
    return messages.join(again, "message_id", "left").withColumns({"attempts": F.col("attempts") + hit.cast("int"), "status": F.when(hit, "processing").otherwise(F.col("status"))}).drop("again")


def settled(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Results count only for the attempt that is running."""
    own = results.select("message_id", F.col("attempt").alias("r_attempt"), F.col("outcome").alias("r_outcome"))
    fits = (F.col("status") == "processing") & (F.col("attempts") == F.col("r_attempt"))
    return messages.join(own, "message_id", "left").withColumn("status", F.when(fits, F.col("r_outcome")).otherwise(F.col("status"))).drop("r_attempt", "r_outcome")


def full_conversations(messages: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """Conversations without room for a question and its answer."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")).filter(F.col("messages") + 2 > most)


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations by last activity, with their counts."""
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    out = conversations.join(counts, "conv_id", "left").withColumn("messages", F.coalesce("n", F.lit(0))).drop("n")
    return out.orderBy(F.col("last_activity_at").desc(), "conv_id")


def titles(messages: DataFrame) -> DataFrame:
    """A title for each conversation from its first user message."""
    first = messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return first.select("conv_id", default_title(F.col("first")).alias("title"))
