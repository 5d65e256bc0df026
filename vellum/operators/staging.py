"""Results that several plans read, written once to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets a query's shuffle files go as it ends (Spark 4.1; others don't know the setting).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def with_shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary folder; a cluster, whose
    machines would not share one, gets an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return named or sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{with_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame) -> DataFrame:
    """Materialise rows in the shared folder."""
    with_shared_folder(rows.sparkSession)
    return rows.checkpoint()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run in the block leave no shuffle files; none of them may be run again."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def settled(rows: DataFrame) -> DataFrame:
    """``staged``, without the shuffle files that the rows took."""
    with shuffles_go(rows.sparkSession):
        return staged(rows.select("*"))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that materialises large rows as compressed Parquet. They go when the block ends, so what is made of them must be staged by then."""
    top = new_folder(spark, "scratch")

    def keep(rows: DataFrame) -> DataFrame:
        path = f"{top}/{uuid.uuid4().hex}"
        with shuffles_go(spark):
            rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    try:
        yield keep
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
