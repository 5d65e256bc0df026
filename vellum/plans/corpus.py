"""The star-schema test tables read as the library's catalogue, passages and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.dense import embed
from vellum.sources.tables import read_table

DIMENSION = 384
TENANT = "all"
#: Lines that a text can have at most, as an array can; an id below 2**32 leaves room for them.
LINES = 1 << 31


#: Tables whose rows take work to process, and that are spread over the cores if small.
TEXTS = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_table(spark, path) if name in TEXTS else spark.read.parquet(path)


def lines(text) -> F.Column:
    """Trimmed lines of a text, blank ones included so that places stay."""
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document row for each text; those labelled as bad are not ready."""
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    status = F.when(F.coalesce("quality", F.lit(1)) == 1, "ready").otherwise("chunked")
    return docs.select(F.col("doc_id").alias("document_id"), F.lit(TENANT).alias("user_id"), status.alias("status"), F.lit(True).alias("is_active"), F.size(F.filter(lines(F.col("text")), lambda x: x != "")).alias("chunk_count"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines; the id holds document and line number."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "text")).filter(F.col("text") != "")
    return rows.select((F.col("doc_id") * LINES + F.col("pos") + 1).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(TENANT).alias("user_id"), "text")


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as its only chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(TENANT).alias("user_id"), "text")


def one_chunk_each(catalogue_: DataFrame) -> DataFrame:
    return catalogue_.withColumn("chunk_count", F.lit(1))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a query of free words."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(TENANT).alias("user_id"), F.col("text").alias("query"), F.col("text").alias("words"), F.array().cast("array<string>").alias("phrases"))


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(benchmark_queries(spark, sf_dir), text_col="query", prefix="query: ", dimension=DIMENSION, element="double")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test vectors, with their label as tenant."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("user_id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test vector whose id is divisible by 20 as a query."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("user_id"), "embedding")


#: Common tables of the queries' SQL.
TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}]+')"
LINES_SQL = rf"""
lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
),
passages AS (
    SELECT doc_id * {LINES} + pos AS chunk_id, doc_id AS document_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text
    FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''
),
ready AS (
    SELECT d.doc_id AS document_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) = 1
)"""
