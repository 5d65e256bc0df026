"""Registered queries of documents, versions, vectors, collections, conversations and events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import conversations as talk
from vellum.operators import documents as d
from vellum.operators.context import follow_up_query, history_within_budget, paired_turns, recent_turns
from vellum.operators.grounding import scrubbed
from vellum.operators.limits import anchored_windows
from vellum.plans import corpus as c

CONFIG = "current"
WINDOW_SECONDS, MOST_HITS = 3600, 2
STATES = {"signup": "pending", "view": "parsing", "click": "chunking", "purchase": "ready", "error": "failed"}
TO_EVENT = {"signup": "claim", "view": "extracted", "click": "chunks_stored", "purchase": "embedded", "error": "processing_failed"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files: the source is the user, the language the type, exact copies are versions of one family."""
    quality = c.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = c.table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("user_id"),
        F.concat(F.lit("File_"), F.col("doc_id"), F.lit("%.txt")).alias("filename"),
        F.col("lang").alias("file_type"),
        F.octet_length("text").cast("bigint").alias("file_size"),
        F.sha2("text", 256).alias("checksum"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, "ready").otherwise("chunked").alias("status"),
        F.lit(True).alias("is_current"),
        F.col("n_chars").alias("created_at"),
    )


def doc_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.page(d.listing(files(spark, sf_dir), status="ready", file_type="en", name_like="_1"), number=2, size=20).select("document_id", "filename", "created_at")


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.total(d.listing(files(spark, sf_dir), status="ready", name_like="7%"))


def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.storage_use(files(spark, sf_dir), quota=100_000)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is in the collections of its source and of its language."""
    docs = c.table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("collection_id"), F.col("doc_id").alias("document_id")).unionByName(docs.select(F.col("lang").alias("collection_id"), F.col("doc_id").alias("document_id")))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    found = docs.select(F.explode(F.array("source", "lang", F.concat(F.lit("none_"), F.col("lang")))).alias("collection_id")).distinct()
    return found.withColumns({"name": F.upper("collection_id"), "user_id": F.lit("all")})


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.collection_counts(collections(spark, sf_dir), members(spark, sf_dir)).select("collection_id", "documents")


def collection_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.collection_refs(members(spark, sf_dir), collections(spark, sf_dir)).select("document_id", F.array_join("names", ",").alias("names"))


def collection_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask for all documents of a language in the collection ``src1``, and for one that does not exist in ``src2``."""
    docs = c.table(spark, sf_dir, "documents")
    asked = docs.filter(F.col("lang") == "de").select(F.lit("src1").alias("collection_id"), F.col("doc_id").alias("document_id"))
    wrong = docs.filter(F.col("lang") == "es").select(F.lit("src2").alias("collection_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 10_000_000).alias("document_id"))
    return d.added_members(asked.unionByName(wrong), members(spark, sf_dir), files(spark, sf_dir))


def dup_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = files(spark, sf_dir).select("document_id", F.lit("all").alias("user_id"), "checksum", (F.col("document_id") % 2).alias("family_id"), F.col("document_id").alias("arrived"))
    return d.checksum_duplicates(uploads).select("document_id", "outcome")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies as versions; a version is newly ready if ready and of an even id, and active if it is the first."""
    numbered = d.numbered_versions(files(spark, sf_dir).select("document_id", F.substring("checksum", 1, 16).alias("family_id"), "status", F.col("document_id").alias("arrived")))
    return numbered.withColumns({"newly_ready": (F.col("status") == "ready") & (F.col("document_id") % 2 == 0), "is_active": F.col("version_number") == 1})


def version_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("document_id", "family_id", "version_number", "over_limit")


def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.newest_versions(versions(spark, sf_dir)).select("family_id", "document_id", "version_number", "version_count")


def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.current_versions(d.activated(versions(spark, sf_dir))).select("family_id", "document_id", "version_number")


def activate_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.activated(versions(spark, sf_dir)).select("document_id", "is_active")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.passages(spark, sf_dir).withColumn("text_sha256", F.sha2("text", 256))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of most passages; some were made from an older text, some under another configuration."""
    rows = chunk_rows(spark, sf_dir).filter(F.col("chunk_id") % 5 != 0)
    sha = F.when(F.col("chunk_id") % 7 == 0, F.sha2(F.concat("text", F.lit("old")), 256)).otherwise(F.col("text_sha256"))
    return rows.select("chunk_id", "document_id", F.when(F.col("chunk_id") % 11 == 0, "older").otherwise(CONFIG).alias("config_id"), sha.alias("text_sha256"), (F.length("text") > 2000).alias("truncated"))


def anti_pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.pending_chunks(chunk_rows(spark, sf_dir), stored_vectors(spark, sf_dir), CONFIG).select("chunk_id")


def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.stale_vectors(stored_vectors(spark, sf_dir), chunk_rows(spark, sf_dir)).select("chunk_id")


def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.complete_documents(c.catalogue(spark, sf_dir), stored_vectors(spark, sf_dir), CONFIG)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "conversations")


def history_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_turns(paired_turns(messages(spark, sf_dir)), most=2).select("conv_id", "turn", "position")


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_within_budget(paired_turns(messages(spark, sf_dir)), budget=400, per_message=10_000).select("conv_id", "turn", "cost", "used")


def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return follow_up_query(messages(spark, sf_dir), most_words=20)


def message_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.sequenced(messages(spark, sf_dir)).select("conv_id", "turn", "sequence")


def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.titles(messages(spark, sf_dir))


def citation_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two citations for each document; those of documents divisible by three are scrubbed."""
    def cite(label: str, at) -> F.Column:
        return F.struct(F.lit(label).alias("label"), at.alias("document_id"), F.lit(None).cast("bigint").alias("version_id"), at.alias("chunk_id"), F.concat(F.lit("doc "), at).alias("document_name"), F.lit("h").alias("heading"), F.lit(False).alias("removed"))

    i = F.col("doc_id")
    rows = c.table(spark, sf_dir, "documents").select("doc_id", F.array(cite("S1", i), cite("S2", i + 1)).alias("citations"))
    gone = F.when(i % 3 == 0, i)
    out = rows.withColumn("citations", F.when(gone.isNotNull(), scrubbed(F.col("citations"), gone)).otherwise(F.col("citations")))
    return out.select("doc_id", F.explode("citations").alias("x")).select("doc_id", "x.label", "x.document_id", "x.document_name", "x.removed")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "events")


def stalled_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents in progress: the last event is the sign of life, errors are attempts."""
    rows = events(spark, sf_dir)
    last = rows.groupBy(F.col("user_id").alias("document_id")).agg(F.max("ts").alias("started_at"), F.count_if(F.col("event_type") == "error").alias("attempts")).withColumn("status", F.lit("parsing"))
    now = rows.agg(F.max("ts").alias("now"))
    return d.stalled(last.crossJoin(F.broadcast(now)), F.col("now"), after=timedelta(days=1)).select("document_id", "attempts", "action")


def idempotent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.idempotent(events(spark, sf_dir), key=("user_id", "event_type"), content="props", arrival="event_id").select("event_id", "outcome")


def anchored_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchored_windows(events(spark, sf_dir), key="user_id", at="ts", order="event_id", window=timedelta(seconds=WINDOW_SECONDS), most=MOST_HITS).select("event_id", "attempt", "allowed")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("event_type")]
    rows = events(spark, sf_dir).withColumn("after", state)
    return rows.withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("before is not null")


def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.violations(changes(spark, sf_dir)).select("event_id", "before", "after")


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document meets the last event of the user with its id."""
    name = F.create_map(*[F.lit(x) for pair in TO_EVENT.items() for x in pair])[F.col("event_type")]
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")).select(F.col("user_id").alias("document_id"), name.alias("event"))
    docs = c.catalogue(spark, sf_dir).withColumn("status", F.element_at(F.array(F.lit("pending"), F.lit("parsing"), F.lit("chunking"), F.lit("embedding")), (F.col("document_id") % 4 + 1).cast("int")))
    return d.applied(docs, last).select("document_id", "status", "applied", "chunk_count")


QUERIES = {f.__name__: f for f in (doc_listing_page, page_totals, quota, collection_counts, collection_refs, collection_add, dup_checksum, version_numbering, newest_version, current_version, activate_if_newer, anti_pending_chunks, stale_vectors, completeness_gate, history_turns, history_budget, followup_query, message_sequence, conversation_titles, citation_scrub, stalled_sweep, idempotent_first, anchored_rate_limit, lifecycle_violations, state_transitions)}

FILES = """files AS (
    SELECT d.doc_id AS document_id, source AS user_id, 'File_' || d.doc_id || '%.txt' AS filename, lang AS file_type, octet_length(encode(text)) AS file_size,
           sha256(text) AS checksum, CASE WHEN coalesce(l.quality, 1) = 1 THEN 'ready' ELSE 'chunked' END AS status, n_chars AS created_at
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
VERSIONS = f"""{FILES},
numbered AS (SELECT document_id, left(checksum, 16) AS family_id, status, row_number() OVER (PARTITION BY left(checksum, 16) ORDER BY document_id) AS version_number FROM files),
versions AS (SELECT *, status = 'ready' AND document_id % 2 = 0 AS newly_ready, version_number = 1 AS was_active FROM numbered),
activated AS (
    SELECT *, max(CASE WHEN newly_ready THEN version_number END) OVER w AS newest FROM versions WINDOW w AS (PARTITION BY family_id)
), active AS (SELECT document_id, family_id, version_number, version_number = CASE WHEN newest > 1 THEN newest ELSE 1 END AS is_active FROM activated)"""
VECTORS = f"""{c.LINES_SQL},
rows AS (SELECT chunk_id, document_id, text, sha256(text) AS text_sha256 FROM passages),
vectors AS (
    SELECT chunk_id, document_id, CASE WHEN chunk_id % 11 = 0 THEN 'older' ELSE 'current' END AS config_id,
           CASE WHEN chunk_id % 7 = 0 THEN sha256(text || 'old') ELSE text_sha256 END AS text_sha256, length(text) > 2000 AS truncated FROM rows WHERE chunk_id % 5 <> 0
)"""
PAIRED = """nexts AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, text AS question, answer FROM nexts WHERE role = 'user' AND next_role = 'assistant')"""


def case_sql(of: str, pairs: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def estimate_sql(text: str) -> str:
    other = rf"length(regexp_replace({text}, '[\x00-\x7F]', '', 'g'))"
    return f"ceil({other} + (length({text}) - {other}) / 3.0)::BIGINT"


def escape_sql(text: str) -> str:
    return rf"replace(replace(replace(regexp_replace({text}, '\[\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*\]', '(\1)', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


STRIPPED = r"trim(regexp_replace(regexp_replace(answer, '\s*\[\s*S\d+(?:\s*[,;]\s*S\d+)*\s*\]', '', 'g'), '\s+', ' ', 'g'))"
TITLE = r"trim(regexp_replace(min_by(text, turn), '\s+', ' ', 'g'))"
ALLOWED = ", ".join(f"('{a}', '{b}')" for a, many in d.TRANSITIONS.items() for b in many)
APPLIED = " ".join(f"WHEN event = '{name}' AND status IN ({', '.join(repr(s) for s in before)}) THEN '{after}'" for name, (before, after) in d.EVENTS.items())

ORACLE_SQL = {
    "doc_listing_page": f"WITH {FILES} SELECT document_id, filename, created_at FROM files WHERE status = 'ready' AND file_type = 'en' AND contains(lower(filename), '_1') ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 20",
    "page_totals": f"WITH {FILES} SELECT count(*) AS total FROM files WHERE status = 'ready' AND contains(lower(filename), '7%')",
    "quota": f"WITH {FILES} SELECT user_id, sum(file_size)::BIGINT AS used, sum(file_size) > 100000 AS over_quota FROM files GROUP BY user_id",
    "collection_counts": "WITH m AS (SELECT source AS k FROM documents UNION ALL SELECT lang FROM documents), c AS (SELECT source AS k FROM documents UNION SELECT lang FROM documents UNION SELECT 'none_' || lang FROM documents) SELECT c.k AS collection_id, count(m.k) AS documents FROM c LEFT JOIN m USING (k) GROUP BY c.k",
    "collection_refs": "SELECT doc_id AS document_id, array_to_string(list_sort([upper(source), upper(lang)]), ',') AS names FROM documents",
    "collection_add": """
        WITH m AS (SELECT source AS k, doc_id FROM documents UNION SELECT lang, doc_id FROM documents),
        asked AS (SELECT 'src1' AS k, doc_id FROM documents WHERE lang = 'de' UNION SELECT 'src2', CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 10000000 END FROM documents WHERE lang = 'es'),
        rows AS (SELECT a.k, a.doc_id, d.doc_id IS NULL AS unknown, m.doc_id IS NOT NULL AS have FROM asked a LEFT JOIN documents d ON d.doc_id = a.doc_id LEFT JOIN m ON m.k = a.k AND m.doc_id = a.doc_id)
        SELECT k AS collection_id, doc_id AS document_id, CASE WHEN unknown THEN 'unknown' WHEN bool_or(unknown) OVER (PARTITION BY k) THEN 'rejected' WHEN have THEN 'existing' ELSE 'added' END AS outcome FROM rows""",
    "dup_checksum": f"WITH {FILES} SELECT document_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN first_value(document_id % 2) OVER w = document_id % 2 THEN 'repeat' ELSE 'duplicate' END AS outcome FROM files WINDOW w AS (PARTITION BY checksum ORDER BY document_id)",
    "version_numbering": f"WITH {VERSIONS} SELECT document_id, family_id, version_number, version_number > 20 AS over_limit FROM versions",
    "newest_version": f"WITH {VERSIONS} SELECT family_id, max_by(document_id, version_number) AS document_id, max(version_number) AS version_number, count(*) AS version_count FROM versions GROUP BY family_id",
    "current_version": f"WITH {VERSIONS} SELECT family_id, document_id, version_number FROM active WHERE is_active",
    "activate_if_newer": f"WITH {VERSIONS} SELECT document_id, is_active FROM active",
    "anti_pending_chunks": f"WITH {VECTORS} SELECT chunk_id FROM rows WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE config_id = 'current')",
    "stale_vectors": f"WITH {VECTORS} SELECT v.chunk_id FROM vectors v JOIN rows r USING (chunk_id) WHERE v.text_sha256 <> r.text_sha256",
    "completeness_gate": f"""WITH {VECTORS}, n AS (SELECT document_id, count(*) AS chunk_count FROM rows GROUP BY document_id),
        v AS (SELECT document_id, count(*) AS vectors, count(*) FILTER (WHERE truncated) AS truncated FROM vectors WHERE config_id = 'current' GROUP BY document_id)
        SELECT d.doc_id AS document_id, coalesce(n.chunk_count, 0) AS chunk_count, coalesce(v.vectors, 0) AS vectors, coalesce(v.truncated, 0) AS truncated, coalesce(n.chunk_count, 0) = coalesce(v.vectors, 0) AS complete
        FROM documents d LEFT JOIN n ON n.document_id = d.doc_id LEFT JOIN v ON v.document_id = d.doc_id""",
    "history_turns": f"WITH {PAIRED}, last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM last WHERE back <= 2",
    "history_budget": f"""WITH {PAIRED}, last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns),
        costs AS (SELECT conv_id, turn, {estimate_sql(escape_sql('question'))} + CASE WHEN {STRIPPED} <> '' THEN {estimate_sql(escape_sql(STRIPPED))} ELSE 12 END + 12 AS cost FROM last WHERE back <= 4),
        used AS (SELECT *, (sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS used FROM costs) SELECT conv_id, turn, cost, used FROM used WHERE used <= 400""",
    "followup_query": r"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, n < 20 AND coalesce(earlier, '') <> '' AND 999 - length(text) > 0 AS extended,
               CASE WHEN n < 20 AND coalesce(earlier, '') <> '' AND 999 - length(text) > 0 THEN rtrim(left(earlier, 999 - length(text))) || ' ' || text ELSE text END AS query FROM u""",
    "message_sequence": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations",
    "conversation_titles": f"WITH f AS (SELECT conv_id, {TITLE} AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(CASE WHEN instr(reverse(left(t, 60)), ' ') > 0 AND 60 - instr(reverse(left(t, 60)), ' ') >= 30 THEN left(t, 60 - instr(reverse(left(t, 60)), ' ')) ELSE left(t, 60) END) || '…' END AS title FROM f",
    "citation_scrub": """WITH x AS (SELECT doc_id, 'S1' AS label, doc_id AS document_id FROM documents UNION ALL SELECT doc_id, 'S2', doc_id + 1 FROM documents)
        SELECT doc_id, label, document_id, CASE WHEN doc_id % 3 = 0 AND document_id = doc_id THEN NULL ELSE 'doc ' || document_id END AS document_name, doc_id % 3 = 0 AND document_id = doc_id AS removed FROM x""",
    "stalled_sweep": "WITH l AS (SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY user_id) SELECT user_id AS document_id, attempts, CASE WHEN attempts >= 3 THEN 'fail' ELSE 'release' END AS action FROM l WHERE last < (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND",
    "idempotent_first": "SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN first_value(props) OVER w IS NOT DISTINCT FROM props THEN 'replay' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)",
    "anchored_rate_limit": f"""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        w AS (SELECT event_id, user_id, n, ts AS anchor, 1 AS attempt FROM o WHERE n = 1
              UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN o.ts >= w.anchor + INTERVAL {WINDOW_SECONDS} SECOND THEN o.ts ELSE w.anchor END, CASE WHEN o.ts >= w.anchor + INTERVAL {WINDOW_SECONDS} SECOND THEN 1 ELSE w.attempt + 1 END
              FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
        SELECT event_id, attempt, attempt <= {MOST_HITS} AS allowed FROM w""",
    "lifecycle_violations": f"WITH s AS (SELECT event_id, user_id, ts, {case_sql('event_type', STATES)} AS after FROM events), l AS (SELECT *, lag(after) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT event_id, before, after FROM l WHERE before IS NOT NULL AND (before, after) NOT IN ({ALLOWED})",
    "state_transitions": f"""WITH {c.LINES_SQL}, n AS (SELECT document_id, count(*) AS chunk_count FROM passages GROUP BY document_id),
        last AS (SELECT user_id, {case_sql('max_by(event_type, (ts, event_id))', TO_EVENT)} AS event FROM events GROUP BY user_id),
        docs AS (SELECT doc_id AS document_id, ['pending', 'parsing', 'chunking', 'embedding'][doc_id % 4 + 1] AS status, coalesce(chunk_count, 0) AS chunk_count, event FROM documents LEFT JOIN n ON n.document_id = doc_id LEFT JOIN last ON user_id = doc_id),
        after AS (SELECT *, CASE {APPLIED} END AS nxt FROM docs)
        SELECT document_id, coalesce(nxt, status) AS status, nxt IS NOT NULL AS applied, CASE WHEN nxt IS NOT NULL AND event IN ('processing_failed', 'processing_released', 'extracted') THEN NULL ELSE chunk_count END AS chunk_count FROM after""",
}
