"""A corpus pipeline in five stages: each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, join_by_size
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.language import fit, keep_identified
from vellum.llm.packing import pack_documents
from vellum.llm.secrets import redact
from vellum.llm.simhash import near_duplicates

#: No stage but the second can be expressed in SQL.
ORACLE_SQL = None

#: Keys of dropped rows that are broadcast at most, 8 bytes each.
BROADCAST_ROWS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected; the others' ``lang`` becomes the predicted one.

    Where no row has a label and a text there is nothing to learn from, and all documents stay as they are.
    """
    model = fit(docs)
    return keep_identified(docs, model) if model.languages else docs


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, made once, so that a verdict finds its row whatever the ``doc_id``; and a name for it that no column has."""
    taken, name = {c.lower() for c in docs.columns}, "_row"
    while name in taken:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def without_rows(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """The rows whose key is not among the dropped ones.

    Only keys decide. So long as few are dropped they are broadcast, and no text
    is shuffled; beyond ``BROADCAST_ROWS`` both sides meet in a shuffle.
    """
    keys = cut(dropped)
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if few else keys, row, "left_anti").drop(row)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays; a null id counts as less than any other.

    A text that only rows with null ids hold thus stays once. Of rows that
    share the largest id, one stays.
    """
    keyed, row = with_row_key(docs)
    own = keyed.select(F.struct(F.col("doc_id"), F.col(row).alias("row")).alias("id"), "text")
    return without_rows(keyed, exact_dedup(own, id_col="id").filter(~F.col("kept")).select(F.col("doc_id.row").alias(row)), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near-duplicates, the row with the least id stays; a null id counts as greater than any other.

    A group of rows that all have null ids thus keeps one. Of rows that share
    the least id, one stays.
    """
    keyed, row = with_row_key(docs)
    own = keyed.select(F.col(row).alias("row"), "doc_id", "text")
    groups = near_duplicates(own.select("row", "text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id").join(own.select("row", "doc_id"), "row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = cut(groups.select("component_id", "row", place.alias("place")))
    first = cut(groups.groupBy("component_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")))
    rest = join_by_size(groups, first, ["component_id"], "size").filter(F.col("row") != F.col("first.row"))
    return without_rows(keyed, rest.select(F.col("row").alias(row)), row)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked and ``n_chars`` follows the new text."""
    return redact(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and its place there."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is cut in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
