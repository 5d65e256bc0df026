"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 2_000


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Keep the cluster's shared ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary folder; a cluster, whose
    machines would not share one, gets an error.
    """
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return spark


def give_back() -> None:
    """Return free memory to the system: a worker lives on after its task, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: A key with more than one of so many rows is hot; there can be no more hot keys than that.
HOT_SHARE = 1024


def join_by_size(rows: DataFrame, facts: DataFrame, key: list[str], size: str) -> DataFrame:
    """Add the facts of its key to each row, without one task for all rows of a key.

    ``facts`` has one row for each key of ``rows``, with the number of rows in
    ``size``; it is read more than once, so it should be materialised. Facts of
    hot keys, at most ``HOT_SHARE`` rows, are broadcast; only the rows of other
    keys are shuffled.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.filter(F.col(size) * HOT_SHARE > total)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(size) * HOT_SHARE <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(few)


def map_rows(df: DataFrame, columns: list[Column], schema: str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Run a per-row Python function in Arrow batches.

    ``start`` runs once for each task and returns a function of one row's
    values that yields output tuples. Output goes out in bounded batches, so
    memory follows the longest text and not the partition.
    """
    chosen = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    width = len(columns)
    out_schema = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i) for i in range(width)), strict=True):
                out.extend(one(*(v.as_py() for v in row)))
                if len(out) >= ROWS_PER_BATCH:
                    yield to_batch(out, out_schema)
                    out = []
            if out:
                yield to_batch(out, out_schema)
            del batch, out
            give_back()

    return chosen.mapInArrow(run, schema)


def map_whole(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Change or drop whole rows in Arrow batches, all columns kept; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            yield one(batch)

    return df.mapInArrow(run, df.schema)


def with_columns(batch: pa.RecordBatch, columns: dict[str, list]) -> pa.RecordBatch:
    """The batch with the named columns replaced, in their own types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def to_arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def text_of(column: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
