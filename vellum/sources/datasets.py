"""Evaluation data sets as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "dataset string, version int, documents array<struct<id: string, title: string, language: string, sections: array<struct<heading: string, passage: struct<id: string, text: string>>>>>"
QUERIES = "dataset string, version int, queries array<struct<id: string, category: string, query: string, relevant: array<string>, neutral: array<string>>>"


def passages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each passage of a corpus file, or of several (U4)."""
    docs = spark.read.schema(CORPUS).json(path, multiLine=True).select("dataset", "version", F.explode("documents").alias("d"))
    rows = docs.select("dataset", "version", F.col("d.id").alias("document_id"), F.col("d.title").alias("title"), F.col("d.language").alias("language"), F.posexplode("d.sections").alias("ordinal", "s"))
    return rows.select("dataset", "version", "document_id", "title", "language", "ordinal", F.col("s.heading").alias("heading"), F.col("s.passage.id").alias("passage_id"), F.col("s.passage.text").alias("text"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each query of a file; missing lists are empty."""
    rows = spark.read.schema(QUERIES).json(path, multiLine=True).select("dataset", F.explode("queries").alias("q")).select("dataset", "q.*").withColumnRenamed("id", "query_id")
    none = F.array().cast("array<string>")
    return rows.withColumns({"relevant": F.coalesce("relevant", none), "neutral": F.coalesce("neutral", none)})


def problems(passages_: DataFrame, queries_: DataFrame) -> DataFrame:
    """``problem, id`` of repeated ids, references to unknown passages, and keys that are relevant and neutral."""
    def repeated(rows: DataFrame, key: str, what: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(what).alias("problem"), "id")

    used = queries_.select("query_id", F.explode(F.concat("relevant", "neutral")).alias("passage_id"))
    unknown = used.join(passages_.select("passage_id"), "passage_id", "left_anti").select(F.lit("unknown_passage").alias("problem"), F.col("passage_id").alias("id"))
    both = queries_.filter(F.arrays_overlap("relevant", "neutral")).select(F.lit("relevant_and_neutral").alias("problem"), F.col("query_id").alias("id"))
    return repeated(passages_, "passage_id", "repeated_passage").unionByName(repeated(queries_, "query_id", "repeated_query")).unionByName(unknown).unionByName(both).distinct()


def as_chunks(passages_: DataFrame, user_id: str = "all") -> DataFrame:
    """Passages as chunks with ids made from theirs."""
    return passages_.select(F.sha2(F.concat_ws("/", "dataset", "passage_id"), 256).alias("chunk_id"), "passage_id", "document_id", F.lit(user_id).alias("user_id"), "ordinal", "heading", "text")
