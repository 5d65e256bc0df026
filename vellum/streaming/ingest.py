"""Ingestion as a stream: files in, chunks out, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vellum.operators.chunking import Limits, chunk_results, chunk_texts, single_sections
from vellum.operators.staging import staged
from vellum.sources.delta_table import DeltaTable


def document_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of documents as they arrive; a limit on files makes slices of bounded size (R2)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest(stream: DataFrame, output: str, checkpoint: str, *, limits: Limits | None = None, process: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Chunk every new document and replace what the sink has of it.

    The sink is a ``DeltaTable``: a batch writes what it holds, and one that is
    run again after a failure is known by its number and changes nothing. Runs
    are merged as they add up. With ``once`` all that is there is processed and
    the query ends.
    """
    limits = limits or Limits()
    process = process or (lambda docs: chunk_texts(docs, limits))

    def batch(docs: DataFrame, number: int) -> None:
        table = DeltaTable(docs.sparkSession, output)
        table.replace(process(docs).withColumn("text_sha256", F.sha2("text", 256)), keys=docs.select(F.col("doc_id").alias("document_id")), source=checkpoint, batch=number)
        table.compact()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def processed(documents: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """C1 as a batch: chunks of good documents, and a row with its reason for each bad one.

    Failures are rows and not exceptions, so one document never stops a batch.
    """
    most = 20_000_000
    reason = F.when(F.col("text").isNull(), "corrupt_document").when(F.trim("text") == "", "empty_document").when(F.length("text") > most, "content_too_large")
    marked = documents.withColumn("failure_reason", reason)
    results = staged(chunk_results(single_sections(marked.filter("failure_reason is null")), limits or Limits()))
    bad = marked.filter("failure_reason is not null").select(F.col("doc_id").alias("document_id"), "failure_reason")
    failed = results.filter("failure_reason is not null").select("document_id", "failure_reason")
    return results.filter("failure_reason is null").drop("failure_reason"), bad.unionByName(failed)
