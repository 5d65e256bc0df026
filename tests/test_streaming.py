from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.operators.chunking import Limits, chunk_texts
from vellum.sources.delta_table import DeltaTable
from vellum.streaming import ingest, timers

T0 = datetime(2024, 1, 1)


def run(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_ingest_is_exact(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Text number {i}. " * 40) for i in range(12)], "doc_id long, text string")
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    docs.filter("doc_id < 6").write.parquet(src)
    limits = Limits(most=100, overlap=10, least=5)
    for part in (None, docs.filter("doc_id >= 6")):
        if part is not None:
            part.write.mode("append").parquet(src)
        stream = ingest.document_stream(spark, src, docs.schema, files_per_batch=2)
        ingest.ingest(stream, out, state, limits=limits).awaitTermination(120)
    got = sorted((r.document_id, r.chunk_index, r.text) for r in DeltaTable(spark, out).read().collect())
    assert got == sorted((r.document_id, r.chunk_index, r.text) for r in chunk_texts(docs, limits).collect())
    good, bad = ingest.processed(spark.createDataFrame([(1, "ok text"), (2, None), (3, "  ")], "doc_id long, text string"))
    assert good.count() == 1 and {r.document_id: r.failure_reason for r in bad.collect()} == {2: "corrupt_document", 3: "empty_document"}


def hits(spark, tmp_path):
    rows = [(i, i % 3, T0 + timedelta(seconds=17 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "hits"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "hits"))


def test_stalls_and_first(spark, tmp_path):
    beats = spark.createDataFrame([("a", T0), ("b", T0), ("b", T0 + timedelta(hours=3)), ("c", T0 + timedelta(hours=5))], "worker string, ts timestamp")
    for n, part in enumerate((beats.filter("ts < timestamp'2024-01-01 01:00:00'"), beats.filter("ts >= timestamp'2024-01-01 01:00:00'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "beats" / f"{n}"))
    stream = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "beats"))
    got = {r.worker for r in run(timers.stalls(stream, key="worker", at="ts", after=timedelta(hours=1), lateness="1 minute"), tmp_path, "stalls")}
    assert "a" in got and "c" not in got
    _, requests = hits(spark, tmp_path)
    first = run(timers.first_of_each(requests, keys=["user_id"], at="ts"), tmp_path, "first")
    assert len(first) == 3


def test_tokens(spark):
    df = spark.createDataFrame([("f", T0, None, T0), ("g", T0, T0, T0 + timedelta(hours=1))], "family_id string, expires_at timestamp, revoked_at timestamp, presented_at timestamp")
    assert timers.expired(df, F.lit(T0 + timedelta(days=2))).count() == 2
    assert [r.family_id for r in timers.revoked_families(df).collect()] == ["g"]
