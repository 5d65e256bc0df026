"""Parquet tables, spread over the cores where there are fewer splits than cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One with fewer splits than the cluster has cores is small enough to be dealt out anew.

    Anything larger is read as it lies, without a shuffle.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
