"""Document processing as one plan: from files to searchable versions, and the sweeps beside it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions.text import script_profile
from vellum.operators import documents as d
from vellum.operators.chunking import Limits, chunk_results, gathered_sections, normalise_sections
from vellum.operators.staging import staged
from vellum.sources.files import extracted

#: Seconds between two recovery sweeps, and between two purges.
RECOVERY_SECONDS, PURGE_SECONDS = 60, 3600


@dataclass
class Processed:
    """What a run leaves: chunks of good documents, failures with reason and class, and the next snapshot of all documents."""

    sections: DataFrame
    chunks: DataFrame
    failures: DataFrame
    documents: DataFrame


def version_snapshot(chunks: DataFrame, sections: DataFrame, limits: Limits) -> DataFrame:
    """``document_id, metadata``: counts, greatest chunk, chunking settings and script profile of a version, as JSON.

    The profile is that of all sections and their headings.
    """
    sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.max(F.length("text")).alias("max_chunk_chars"))
    shown = F.concat_ws("\n", "heading", "text") if "heading" in sections.columns else F.col("text")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", shown.alias("text")))), lambda s: s["text"]), "\n")
    texts = sections.filter(F.col("text").isNotNull()).groupBy("document_id").agg(F.count(F.lit(1)).alias("section_count"), F.sum(F.length("text")).alias("chars"), script_profile(ordered).alias("script"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in asdict(limits).items()])
    both = sizes.join(texts, "document_id")
    return both.select("document_id", F.to_json(F.struct("chunk_count", "max_chunk_chars", "section_count", "chars", "script", settings.alias("chunking"))).alias("metadata"))


def process_documents(documents: DataFrame, files: DataFrame, *, limits: Limits | None = None, stale_before: Column | None = None) -> Processed:
    """Claim, extract, normalise, profile, chunk; each failure is a row with its class, so no document stops a run.

    ``documents`` is a snapshot with ``document_id, filename, status,
    started_at``, ``files`` has ``filename, content``. Only documents that may
    be claimed (P9) are worked on; the others pass through. A document whose file
    is missing fails as ``file_missing``, and one that gives no chunk as
    ``empty_document``. ``files`` has one row for each name.
    """
    limits = limits or Limits()
    claim = d.claimable_for_processing(stale_before if stale_before is not None else F.lit(None).cast("timestamp"))
    claimed = documents.filter(F.coalesce(claim, F.lit(False))).select("document_id", "filename")
    own = claimed.join(files.select("filename", "content"), "filename", "left")
    missing = own.filter(F.col("content").isNull()).select("document_id", F.lit("file_missing").alias("failure_reason"))
    # File names may repeat, and an id may hold any character.
    named = F.concat(F.hex(F.col("document_id").cast("string")), F.lit("/"), F.col("filename"))
    raw = staged(extracted(own.filter(F.col("content").isNotNull()).select(named.alias("filename"), "content")))
    raw = raw.withColumn("document_id", F.decode(F.unhex(F.substring_index("filename", "/", 1)), "UTF-8").cast(claimed.schema["document_id"].dataType))
    unreadable = raw.filter("failure_reason is not null").select("document_id", "failure_reason").distinct()
    sections = staged(normalise_sections(raw.filter("failure_reason is null")))
    results = staged(chunk_results(gathered_sections(sections), limits))
    overlong = results.filter("failure_reason is not null").select("document_id", "failure_reason")
    chunks = results.filter("failure_reason is null").drop("failure_reason")
    known = missing.unionByName(unreadable).unionByName(overlong)
    empty = claimed.select("document_id").join(known.select("document_id").unionByName(chunks.select("document_id")).distinct(), "document_id", "left_anti")
    failures = staged(known.unionByName(empty.withColumn("failure_reason", F.lit("empty_document")))).withColumn("failure_class", d.failure_class(F.col("failure_reason")))
    snapshot = version_snapshot(chunks, sections, limits)
    after = documents.drop("metadata", "failure_reason").join(claimed.select("document_id", F.lit(True).alias("_claimed")), "document_id", "left")
    after = after.join(failures.select("document_id", "failure_reason"), "document_id", "left").join(snapshot, "document_id", "left")
    status = F.when(F.col("failure_reason").isNotNull(), "failed").when(F.col("_claimed"), "chunked").otherwise(F.col("status"))
    return Processed(sections, chunks, failures, after.withColumn("status", status).drop("_claimed"))


def timed_out(documents: DataFrame, as_of: Column, *, soft: timedelta = timedelta(minutes=10), most_attempts: int = 3) -> DataFrame:
    """Documents past the soft limit: processing fails as ``timeout``, embedding goes back while it has attempts left."""
    late = F.col("started_at") < as_of - F.expr(f"interval {int(soft.total_seconds())} seconds")
    processing, embedding = F.col("status").isin("parsing", "chunking"), F.col("status") == "embedding"
    spent = F.col("attempts") >= most_attempts
    after = F.when(late & (processing | (embedding & spent)), "failed").when(late & embedding, "chunked").otherwise(F.col("status"))
    reason = F.when(late & (processing | (embedding & spent)), "timeout")
    return documents.withColumns({"failure_reason": reason, "status": after})


def every(ticks: DataFrame, checkpoint: str, sweep: Callable[[], None], *, seconds: int = RECOVERY_SECONDS, once: bool = False) -> StreamingQuery:
    """Run a sweep at each trigger of a stream of ticks; with ``once`` for what is there, then end.

    A sweep reads the present snapshot and writes the next, so running one twice
    changes nothing more.
    """
    writer = ticks.writeStream.foreachBatch(lambda batch, number: sweep()).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
