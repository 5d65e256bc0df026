"""Registered queries of access, states, versions, collections, messages, vectors and evaluation plans."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import text as t
from vellum.functions import vectors as v
from vellum.operators import conversations as talk
from vellum.operators import documents as d
from vellum.operators.chunking import Limits, chunk_texts
from vellum.operators.dense import ranks_of
from vellum.operators.staging import new_folder
from vellum.plans import corpus as c
from vellum.plans.assessment import model_comparison, rag_results
from vellum.plans.processing import process_documents, timed_out, version_snapshot
from vellum.plans.queries_evaluation import containment
from vellum.plans.queries_text import ORACLE_SQL as TEXT_SQL
from vellum.plans.queries_text import documents, ranked
from vellum.plans.search import hydrate, invalid_queries, unowned_scope
from vellum.sources.delta_table import DeltaTable
from vellum.sources.files import clean_name
from vellum.sources.leases import LeasedTable, Lost
from vellum.streaming.ingest import document_stream, ingest

STATUSES = ("pending", "parsing", "chunking", "chunked", "embedding", "indexing", "ready", "failed")
START, AS_OF = "timestamp '2024-01-01 00:00:00'", "timestamp '2024-01-08 00:00:00'"
REASONS = ("timeout", "corrupt_document", "database_error", "empty_document")


def one_of(names: tuple[str, ...], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a state of their number, and a time that grows with it."""
    i = F.col("doc_id")
    at = F.expr(f"{START} + make_interval(0, 0, 0, 0, 0, cast(doc_id % 20000 as int), 0)")
    return documents(spark, sf_dir).select(i.alias("document_id"), F.col("source").alias("user_id"), one_of(STATUSES, i).alias("status"), F.concat(F.lit("c"), i % 3).alias("config_id"), at.alias("started_at"), at.alias("heartbeat"), (i % 4).cast("int").alias("attempts"), F.when(i % 2 == 0, F.lit(3)).alias("chunk_count"), F.col("n_chars").alias("created_at"))


def claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.expr(AS_OF)
    return lifecycle(spark, sf_dir).select("document_id", d.claimable_for_embedding("c1", before).alias("for_embedding"), d.claimable_for_processing(before).alias("for_processing"))


def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest, which is the operator's slice."""
    return d.to_reindex(lifecycle(spark, sf_dir), "c1").select("document_id")


def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_out(lifecycle(spark, sf_dir), F.expr(AS_OF)).select("document_id", "status", "failure_reason")


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", d.may_see(F.lit("src3"), F.col("doc_id") % 10 == 0, F.col("source")).alias("visible"))


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("doc_id") % 5 > 0, one_of(REASONS, F.col("doc_id")))
    return documents(spark, sf_dir).select("doc_id", d.failure_class(reason).alias("failure_class"), d.backoff(F.col("doc_id") % 8 + 1).alias("backoff"))


def scope_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = documents(spark, sf_dir).select((F.col("doc_id") % 50).alias("query_id"), F.col("source").alias("user_id"), (F.col("doc_id") - F.col("doc_id") % 3).alias("document_id"))
    owned = documents(spark, sf_dir).select(F.col("source").alias("user_id"), F.col("doc_id").alias("document_id"))
    return unowned_scope(scope, owned).select("query_id", "user_id", "document_id")


def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 9 == 0, F.lit("   ")).otherwise(F.col("text")).alias("query"))
    return invalid_queries(asked).select("query_id", "reason")


def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranks for each query; chunks of documents that are not ready drop out."""
    place = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("place")
    found = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), place).select("query_id", (F.col("query_id") + F.col("place") * 7).alias("chunk_id"), (F.col("place") + 1).alias("rank"))
    return hydrate(found, c.whole_documents(spark, sf_dir), c.catalogue(spark, sf_dir)).select("query_id", "chunk_id", "rank")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five versions a family; the second is active."""
    i = F.col("doc_id")
    return documents(spark, sf_dir).select(F.floor(i / 5).alias("family_id"), (i % 5 + 1).alias("version_number"), F.when(i % 3 == 0, "failed").otherwise("ready").alias("status"), (i % 5 == 1).alias("is_active"))


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = families(spark, sf_dir)
    request = versions.filter(F.col("family_id") % 2 == 0).select("family_id", (F.col("family_id") % 5 + 1).alias("version_number")).distinct()
    return d.restored(versions, request).select("family_id", "version_number", "is_active")


def undeletable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.undeletable(families(spark, sf_dir)).select("family_id", "version_number")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = documents(spark, sf_dir).select(F.col("source").alias("collection_id"), F.col("doc_id").alias("document_id"))
    removed = members.filter("document_id % 4 = 0").unionByName(members.select("collection_id", (F.col("document_id") + 1_000_000).alias("document_id")))
    return d.without_members(members, removed)


def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("source").alias("user_id"), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("name"))
    return d.name_conflicts(rows).select("user_id", "name", "n")


def chunk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, of ten chunks."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("chunk_index"))
    return d.chunk_page(rows, number=2, size=10)


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("A.b."), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise("txt"))
    return documents(spark, sf_dir).select("doc_id", d.extension_matches(name, F.col("lang")).alias("matches"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id") * 1000 + F.col("turn")
    state = one_of(("processing", "failed", "answered"), F.col("turn") + F.col("conv_id"))
    at = F.expr(f"{START} + make_interval(0, 0, 0, cast(conv_id % 14 as int), 0, 0, 0)")
    return c.table(spark, sf_dir, "conversations").select(i.alias("message_id"), "conv_id", "turn", "role", state.alias("status"), (F.col("turn") % 3).cast("int").alias("attempts"), at.alias("started_at"))


def message_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted questions fail, every third one is asked again, and results settle what fits their attempt."""
    own = messages(spark, sf_dir)
    late = talk.interrupted(own, F.expr(AS_OF)).drop("failure")
    again = talk.resumed(late, own.filter("message_id % 3 = 0"))
    results = own.select("message_id", F.lit(1).alias("attempt"), F.lit("answered").alias("outcome"))
    return talk.settled(again, results).select("message_id", "status", "attempts")


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.in_flight_conflicts(messages(spark, sf_dir))


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = messages(spark, sf_dir)
    return talk.conversation_list(own.groupBy("conv_id").agg(F.max("started_at").alias("last_activity_at")), own.filter("turn % 2 = 0")).select("conv_id", "messages")


@F.pandas_udf(StringType())
def cleaned(names: pd.Series) -> pd.Series:
    return names.map(clean_name)


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("../x/"), F.substring(F.regexp_replace("text", r"[^A-Za-z ]", ""), 1, 30), F.lit(".PDF"))
    return documents(spark, sf_dir).select("doc_id", cleaned(name).alias("value"))


def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    unit = rows.withColumn("e", F.when(F.col("vec_id") % 2 == 0, F.transform("e", lambda x: x / v.norm(F.col("e")))).otherwise(F.col("e")))
    size = c.table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()
    return unit.select("vec_id", v.is_valid(F.col("e"), size[0] if size else 0).alias("valid"))


def passage_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(t.passage_input(path, F.col("text"), True), 256).alias("value"))


def full_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next vector and the seventh after it stand for each query vector."""
    queries = c.vector_queries(spark, sf_dir)
    wanted = queries.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 7)).alias("chunk_id"))
    return ranks_of(c.vectors(spark, sf_dir), queries, wanted).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def version_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the snapshot of each document's chunks."""
    docs = documents(spark, sf_dir)
    limits = Limits()
    sections = docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), "text")
    found = version_snapshot(chunk_texts(docs, limits), sections, limits)
    value = F.from_json("metadata", "chunk_count long, max_chunk_chars int, section_count long, chars long, chunking struct<most: int>")
    return found.select("document_id", value.alias("m")).select("document_id", "m.chunk_count", "m.max_chunk_chars", "m.section_count", "m.chars", F.col("m.chunking.most").alias("most"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text or Markdown file through the processing plan; some files are missing, some types unknown."""
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.when(i % 9 == 0, ".xyz").when(i % 2 == 0, ".md").otherwise(".txt"))
    own = documents(spark, sf_dir).select(i.alias("document_id"), name.alias("filename"), F.when(i % 4 == 0, "ready").otherwise("pending").alias("status"), F.lit(None).cast("timestamp").alias("started_at"))
    files = documents(spark, sf_dir).filter(i % 7 != 0).select(name.alias("filename"), F.encode("text", "UTF-8").alias("content"))
    return process_documents(own, files).documents.select("document_id", "status", "failure_reason")


def processed_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``processed``, with ids that are no numbers and hold slashes, and the script profile that each version keeps."""
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.when(i % 9 == 0, ".xyz").otherwise(".txt"))
    own = documents(spark, sf_dir).select(F.concat(F.lit("doc/"), F.md5(i.cast("string"))).alias("document_id"), name.alias("filename"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("started_at"))
    files = documents(spark, sf_dir).filter(i % 7 != 0).select(name.alias("filename"), F.encode("text", "UTF-8").alias("content"))
    script = F.from_json("metadata", "script struct<bengali: double, latin: double, other: double, primary_script: string>")["script"]
    return process_documents(own, files).documents.select("document_id", "status", "failure_reason", script.alias("s")).select("document_id", "status", "failure_reason", "s.*")


def question_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions with an invented fact each, run through the answer plan."""
    asked = c.benchmark_queries(spark, sf_dir).select("query_id", "query", F.concat(F.lit("c"), F.col("query_id") % 3).alias("category"), F.array("query_id").alias("relevant"), F.array(F.array(F.lower(F.substring("query", 1, 4)))).alias("facts"))
    return rag_results(asked, ranked(spark, sf_dir)).withColumn("cited", F.size("cited")).withColumn("relevant", F.size("relevant"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions of the hashing embedder; relevant are the documents that hold an item word for word."""
    passages = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = c.benchmark_queries(spark, sf_dir).select("query_id", "query")
    out = model_comparison(passages, asked, containment(spark, sf_dir), [("wide", "hashing", 384), ("narrow", "hashing", 64)])
    return out.select("arm", "questions", "top1_hits", "mrr_at_10")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a sink that a stream of all files has filled, a file at a time."""
    path, output = f"{sf_dir}/documents.parquet", new_folder(spark, "ingested")
    stream = document_stream(spark, path + "*", spark.read.parquet(path).schema, files_per_batch=1)  # a pattern, as the table may be one file
    ingest(stream, output, new_folder(spark, "progress")).awaitTermination()
    return DeltaTable(spark, output).read().groupBy("document_id").agg(F.min("chunk_index").alias("first_chunk"))


def sink_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink after three batches: all documents, a third of them replaced, a seventh removed; runs merged; with the version before the removal."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    table = DeltaTable(spark, new_folder(spark, "sink"))
    table.replace(docs)
    before = table.replace(docs.filter("document_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))))
    table.remove(docs.filter("document_id % 7 = 0"))
    table.compact()
    digest = lambda version: table.read(version).select("document_id", F.sha2("text", 256).alias("text_sha256"))
    return digest(None).withColumn("removed", F.lit(False)).unionByName(digest(before).filter("document_id % 7 = 0").withColumn("removed", F.lit(True)))


def leased_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers claim half of the documents each; one dies, a third takes its documents over, and the dead one's late results are refused."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("text_sha256"))
    table = LeasedTable(spark, new_folder(spark, "leased"))
    half = -(-docs.count() // 2)
    first, second = (table.claim(docs, name, most=half, now=0.0, seconds=60.0) for name in ("a", "b"))
    work = lambda fence, name: docs.join(table.claimed(fence), "document_id").withColumn("worker", F.lit(name))
    late = work(first, "a")
    table.beat(second, now=50.0, seconds=60.0)
    third = table.claim(docs, "c", most=half, now=100.0, seconds=60.0)
    with contextlib.suppress(Lost):
        table.finish(first, late)
    table.finish(third, work(third, "c"))
    table.finish(second, work(second, "b"))
    return table.read().select("document_id", "worker", "text_sha256")


QUERIES = {
    "stream_ingest": stream_ingest,
    "leased_work": leased_work,
    "sink_versions": sink_versions,
    "claimable": claimable,
    "reindex": reindex,
    "timeouts": timeouts,
    "visibility": visibility,
    "failure_classes": failure_classes,
    "scope_errors": scope_errors,
    "query_errors": query_errors,
    "hydrated": hydrated,
    "version_restore": restored,
    "undeletable_versions": undeletable,
    "membership_removal": membership,
    "name_conflicts": name_conflicts,
    "chunk_page": chunk_page,
    "rename_check": renames,
    "message_states": message_states,
    "in_flight_conflicts": in_flight,
    "conversation_list": conversation_list,
    "safe_names": safe_names,
    "valid_vectors": valid_vectors,
    "passage_inputs": passage_inputs,
    "full_ranks": full_ranks,
    "version_metadata": version_metadata,
    "processed_documents": processed,
    "processed_by_name": processed_by_name,
    "question_results": question_results,
    "model_comparison": models,
}

SCRIPT_SQL = TEXT_SQL["script_profile"]
LIFECYCLE_SQL = f"""life AS (
    SELECT doc_id, ['{"', '".join(STATUSES)}'][doc_id % 8 + 1] AS status, 'c' || (doc_id % 3) AS config_id, {START} + to_minutes((doc_id % 20000)::INT) AS begun, doc_id % 4 AS attempts, doc_id % 2 = 0 AS chunked, n_chars FROM documents
)"""

ORACLE_SQL = {
    "claimable": f"""WITH {LIFECYCLE_SQL}
        SELECT doc_id AS document_id, status = 'chunked' OR (status = 'ready' AND config_id <> 'c1') OR (status = 'embedding' AND begun < {AS_OF}) AS for_embedding,
               status = 'pending' OR (status IN ('parsing', 'chunking') AND begun < {AS_OF}) AS for_processing FROM life""",
    "reindex": f"WITH {LIFECYCLE_SQL} SELECT doc_id AS document_id FROM life WHERE (status = 'ready' AND config_id <> 'c1') OR (status = 'failed' AND chunked) ORDER BY n_chars, doc_id LIMIT 100",
    "timeouts": f"""WITH {LIFECYCLE_SQL}, late AS (SELECT *, begun < {AS_OF} - INTERVAL 600 SECONDS AS late FROM life),
        judged AS (SELECT *, late AND (status IN ('parsing', 'chunking') OR (status = 'embedding' AND attempts >= 3)) AS dead FROM late)
        SELECT doc_id AS document_id, CASE WHEN dead THEN 'failed' WHEN late AND status = 'embedding' THEN 'chunked' ELSE status END AS status, CASE WHEN dead THEN 'timeout' END AS failure_reason FROM judged""",
    "visibility": "SELECT doc_id, source = 'src3' OR doc_id % 10 = 0 AS visible FROM documents",
    "failure_classes": """
        WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN ['timeout', 'corrupt_document', 'database_error', 'empty_document'][doc_id % 4 + 1] END AS reason FROM documents)
        SELECT doc_id, CASE WHEN reason IS NULL THEN NULL WHEN reason IN ('storage_unavailable', 'timeout', 'database_error', 'model_unavailable') THEN 'retryable' ELSE 'final' END AS failure_class,
               least(30.0 * power(2.0, doc_id % 8), 600.0)::DOUBLE AS backoff FROM r""",
    "scope_errors": """
        SELECT DISTINCT a.doc_id % 50 AS query_id, a.source AS user_id, a.doc_id - a.doc_id % 3 AS document_id FROM documents a
        WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id = a.doc_id - a.doc_id % 3 AND b.source = a.source)""",
    "query_errors": """
        SELECT doc_id AS query_id, CASE WHEN doc_id % 9 = 0 OR trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'too_long' END AS reason FROM documents
        WHERE doc_id % 9 = 0 OR trim(coalesce(text, '')) = '' OR length(trim(text)) > 1000""",
    "hydrated": """
        WITH found AS (SELECT doc_id AS query_id, doc_id + p * 7 AS chunk_id, p FROM documents, range(3) AS places(p)),
        kept AS (SELECT f.* FROM found f JOIN documents d ON d.doc_id = f.chunk_id LEFT JOIN labels l ON l.doc_id = f.chunk_id WHERE coalesce(l.quality, 1) = 1)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM kept""",
    "version_restore": """
        WITH v AS (SELECT doc_id // 5 AS family_id, doc_id % 5 + 1 AS version_number, doc_id % 3 <> 0 AS ready, doc_id % 5 = 1 AS is_active FROM documents),
        can AS (SELECT *, coalesce(bool_or(family_id % 2 = 0 AND version_number = family_id % 5 + 1 AND ready) OVER (PARTITION BY family_id), false) AS can FROM v)
        SELECT family_id, version_number, CASE WHEN can THEN version_number = family_id % 5 + 1 ELSE is_active END AS is_active FROM can""",
    "undeletable_versions": """
        WITH v AS (SELECT doc_id // 5 AS family_id, doc_id % 5 + 1 AS version_number, doc_id % 5 = 1 AS is_active, count(*) OVER (PARTITION BY doc_id // 5) AS n FROM documents)
        SELECT family_id, version_number FROM v WHERE is_active OR n = 1""",
    "membership_removal": "SELECT source AS collection_id, doc_id AS document_id FROM documents WHERE doc_id % 4 <> 0",
    "name_conflicts": "SELECT source AS user_id, lang AS name, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "chunk_page": "SELECT doc_id AS chunk_id, n_chars AS chunk_index FROM documents ORDER BY n_chars, doc_id LIMIT 10 OFFSET 10",
    "rename_check": "SELECT doc_id, doc_id % 2 = 0 AS matches FROM documents",
    "message_states": f"""
        WITH m AS (SELECT conv_id * 1000 + turn AS message_id, ['processing', 'failed', 'answered'][(turn + conv_id) % 3 + 1] AS status, turn % 3 AS attempts, {START} + to_days((conv_id % 14)::INT) AS begun FROM conversations),
        late AS (SELECT message_id, attempts, CASE WHEN status = 'processing' AND begun < {AS_OF} - INTERVAL 480 SECONDS THEN 'failed' ELSE status END AS status FROM m),
        again AS (SELECT message_id, status = 'failed' AND message_id % 3 = 0 AS hit, status, attempts FROM late),
        resumed AS (SELECT message_id, CASE WHEN hit THEN 'processing' ELSE status END AS status, attempts + hit::INT AS attempts FROM again)
        SELECT message_id, CASE WHEN status = 'processing' AND attempts = 1 THEN 'answered' ELSE status END AS status, attempts FROM resumed""",
    "in_flight_conflicts": "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' AND (turn + conv_id) % 3 = 0 GROUP BY conv_id HAVING count(*) > 1",
    "conversation_list": "SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS messages FROM conversations GROUP BY conv_id",
    "stream_ingest": r"SELECT doc_id AS document_id, 0 AS first_chunk FROM documents WHERE regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]')",
    "leased_work": "SELECT doc_id AS document_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT (count(*) + 1) // 2 FROM documents) THEN 'c' ELSE 'b' END AS worker, sha256(text) AS text_sha256 FROM documents",
    "sink_versions": "SELECT doc_id AS document_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS text_sha256, doc_id % 7 = 0 AS removed FROM documents",
    "safe_names": r"SELECT doc_id, trim(regexp_replace(left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 30) || '.PDF', '\s+', ' ', 'g'), ' .') AS value FROM documents",
    "valid_vectors": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)
        SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN norm > 0 ELSE abs(norm - 1) <= 0.01 END AS valid FROM e""",
    "passage_inputs": "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source || chr(10) || text ELSE text END) AS value FROM documents",
    "full_ranks": """
        WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
        SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE chunk_id IN (query_id + 1, query_id + 7)""",
    "processed_documents": r"""
        WITH d AS (SELECT doc_id, doc_id % 4 <> 0 AS claimed, doc_id % 7 = 0 AS missing, doc_id % 9 = 0 AS unknown, NOT regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') AS empty FROM documents),
        r AS (SELECT *, CASE WHEN NOT claimed THEN NULL WHEN missing THEN 'file_missing' WHEN unknown THEN 'unsupported_format' WHEN empty THEN 'empty_document' END AS failure_reason FROM d)
        SELECT doc_id AS document_id, CASE WHEN failure_reason IS NOT NULL THEN 'failed' WHEN claimed THEN 'chunked' ELSE 'ready' END AS status, failure_reason FROM r""",
    "processed_by_name": rf"""
        WITH p AS ({SCRIPT_SQL}),
        d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'file_missing' WHEN doc_id % 9 = 0 THEN 'unsupported_format' WHEN NOT regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}]') THEN 'empty_document' END AS failure_reason FROM documents)
        SELECT 'doc/' || md5(doc_id::VARCHAR) AS document_id, CASE WHEN failure_reason IS NULL THEN 'chunked' ELSE 'failed' END AS status, failure_reason,
               CASE WHEN failure_reason IS NULL THEN bengali END AS bengali, CASE WHEN failure_reason IS NULL THEN latin END AS latin, CASE WHEN failure_reason IS NULL THEN other END AS other, CASE WHEN failure_reason IS NULL THEN primary_script END AS primary_script
        FROM d JOIN p USING (doc_id)""",
}
