"""A table of the shared folder that is replaced round by round."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import with_checkpoint_dir


class Rolling:
    """Parquet in the cluster's shared folder: each version is written whole, then the one before it is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        with_checkpoint_dir(spark)
        base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
        self.spark, self.base, self.version = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.rows: DataFrame | None = None

    def path(self, version: int) -> str:
        return f"{self.base}/{version}"

    def replace(self, rows: DataFrame) -> DataFrame:
        self.version += 1
        rows.write.parquet(self.path(self.version))
        if self.version > 1:
            self.drop(self.version - 1)
        self.rows = self.spark.read.schema(rows.schema).parquet(self.path(self.version))
        return self.rows

    def drop(self, version: int) -> None:
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(version))
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
