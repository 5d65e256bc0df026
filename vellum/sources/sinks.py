"""Writers of sections, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_documents(rows: DataFrame, path: str, *, buckets: int = 256, key: str = "document_id") -> None:
    """Replace all rows of the documents that ``rows`` has.

    The table is partitioned by a bucket of the document's id, as a directory
    for each document would not scale; a touched bucket keeps its other
    documents. Running the same batch again gives the same table.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if "text" in rows.columns and "text_sha256" not in rows.columns:
        new = new.withColumn("text_sha256", F.sha2("text", 256))
    out = new
    if table_exists(rows, path):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).join(new.select(key).distinct(), key, "left_anti")
        out = staged(old.select(*new.columns).unionByName(new), path)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def staged(rows: DataFrame, path: str) -> DataFrame:
    """A copy beside the table, as a table can't be overwritten while it is read."""
    beside = path.rstrip("/") + "__staged"
    rows.write.mode("overwrite").parquet(beside)
    return rows.sparkSession.read.parquet(beside)


def table_exists(rows: DataFrame, path: str) -> bool:
    jvm = rows.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(target)


def new_vectors(vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose ``chunk_id, config_id`` is not stored yet, once each."""
    return vectors.dropDuplicates(["chunk_id", "config_id"]).join(stored.select("chunk_id", "config_id"), ["chunk_id", "config_id"], "left_anti")


def merged_configs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Configurations by fingerprint; a stored one keeps its id."""
    fresh = incoming.dropDuplicates(["fingerprint"]).join(stored.select("fingerprint"), "fingerprint", "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)
