"""Documents, versions, vectors and collections as snapshot transforms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import search_pattern
from vellum.operators.joins import with_first

MOST_VERSIONS, QUOTA_BYTES = 20, 1 << 30
# Allowed changes of a document's status.
TRANSITIONS = {
    "pending": ["parsing", "failed"],
    "parsing": ["chunking", "failed", "pending"],
    "chunking": ["chunked", "failed", "pending"],
    "chunked": ["embedding", "chunking", "pending"],
    "embedding": ["ready", "indexing", "failed", "chunked"],
    "indexing": ["ready", "failed"],
    "ready": ["pending", "embedding", "chunking"],
    "failed": ["pending", "chunked"],
}
# Event, states it applies to, and the state after it.
EVENTS = {
    "claim": (["pending"], "parsing"),
    "extracted": (["parsing"], "chunking"),
    "rechunk": (["chunked", "ready"], "chunking"),
    "chunks_stored": (["chunking"], "chunked"),
    "processing_failed": (["parsing", "chunking"], "failed"),
    "processing_released": (["parsing", "chunking"], "pending"),
    "embedding_claimed": (["chunked", "ready"], "embedding"),
    "embedded": (["embedding"], "ready"),
    "embedding_released": (["embedding"], "chunked"),
    "embedding_failed": (["embedding"], "failed"),
}
# Reasons of a failure that a new try may cure.
RETRYABLE = ["storage_unavailable", "timeout", "database_error", "model_unavailable"]


def listing(documents: DataFrame, *, status: str | None = None, file_type: str | None = None, name_like: str | None = None, collection: DataFrame | None = None) -> DataFrame:
    """Current documents by status, type, a literal part of the name in any case, and membership."""
    out = documents.filter("is_current")
    if status:
        out = out.filter(F.col("status") == status)
    if file_type:
        out = out.filter(F.col("file_type") == file_type)
    if name_like:
        out = out.filter(F.col("filename").ilike(search_pattern(name_like)))
    if collection is not None:
        out = out.join(collection.select("document_id"), "document_id", "left_semi")
    return out


def page(rows: DataFrame, *, number: int = 1, size: int = 20, by: str = "created_at", descending: bool = True, key: str = "document_id") -> DataFrame:
    """One page in a total order; the size is at most 100."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold at most 100 rows")
    order = [F.col(by).desc() if descending else F.col(by).asc(), F.col(key).asc()]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def total(rows: DataFrame) -> DataFrame:
    """Rows under the same predicate as a page."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def storage_use(documents: DataFrame, quota: int = QUOTA_BYTES) -> DataFrame:
    """Bytes of each tenant against the quota."""
    return documents.groupBy("user_id").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("used")).withColumn("over_quota", F.col("used") > quota)


def numbered_versions(uploads: DataFrame, *, family: str = "family_id", arrival: str = "arrived") -> DataFrame:
    """Gapless version numbers in order of arrival; P15: which ones exceed the limit."""
    w = Window.partitionBy(family).orderBy(arrival)
    return uploads.withColumn("version_number", F.row_number().over(w)).withColumn("over_limit", F.col("version_number") > MOST_VERSIONS)


def newest_versions(versions: DataFrame, family: str = "family_id") -> DataFrame:
    """A10: the newest version of each family, and how many it has; one pre-aggregated pass."""
    rest = [c for c in versions.columns if c != family]
    best = versions.groupBy(family).agg(F.max_by(F.struct(*rest), "version_number").alias("v"), F.count(F.lit(1)).alias("version_count"))
    return best.select(family, "v.*", "version_count")


def current_versions(versions: DataFrame, family: str = "family_id") -> DataFrame:
    """The active version of each family, or else the newest."""
    rest = [c for c in versions.columns if c != family]
    return versions.groupBy(family).agg(F.max_by(F.struct(*rest), F.struct(F.col("is_active").cast("int").alias("a"), F.col("version_number"))).alias("v")).select(family, "v.*")


def activated(versions: DataFrame, family: str = "family_id") -> DataFrame:
    """Of versions that became ready for the first time, the newest is active if none newer was.

    ``newly_ready`` marks first readiness; without any, the active version stays,
    so a new index never undoes an explicit restore.
    """
    w = Window.partitionBy(family)
    newest = F.max(F.when(F.col("newly_ready"), F.col("version_number"))).over(w)
    active = F.max(F.when(F.col("is_active"), F.col("version_number"))).over(w)
    winner = F.when(newest.isNotNull() & (active.isNull() | (active < newest)), newest).otherwise(active)
    return versions.withColumn("winner", winner).withColumn("is_active", F.coalesce(F.col("version_number") == F.col("winner"), F.lit(False))).drop("winner")


def restored(versions: DataFrame, request: DataFrame, family: str = "family_id") -> DataFrame:
    """Make the requested ``family, version_number`` active where that version is ready; others stay."""
    wanted = request.select(family, F.col("version_number").alias("wanted"))
    w = Window.partitionBy(family)
    out = versions.join(wanted, family, "left").withColumn("can", F.max((F.col("version_number") == F.col("wanted")) & (F.col("status") == "ready")).over(w))
    active = F.when(F.coalesce("can", F.lit(False)), F.col("version_number") == F.col("wanted")).otherwise(F.col("is_active"))
    return out.withColumn("is_active", active).drop("wanted", "can")


def undeletable(versions: DataFrame, family: str = "family_id") -> DataFrame:
    """Versions that may not be deleted: the active one, and the last of a family."""
    return versions.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(family))).filter(F.col("is_active") | (F.col("n") == 1)).drop("n")


def checksum_duplicates(uploads: DataFrame, *, user: str = "user_id", checksum: str = "checksum", family: str = "family_id", arrival: str = "arrived") -> DataFrame:
    """V8, C11: what becomes of each upload: new, a repeat within its family, or a duplicate of another one."""
    rows = with_first(uploads, (user, checksum), arrival, family)
    return rows.withColumn("outcome", F.when(F.col("_is_first"), "new").when(F.col("_first") == F.col(family), "repeat").otherwise("duplicate")).drop("_is_first", "_first")


def pending_chunks(chunks: DataFrame, vectors: DataFrame, config: str) -> DataFrame:
    """Chunks without a vector under the configuration."""
    return chunks.join(vectors.filter(F.col("config_id") == config).select("chunk_id"), "chunk_id", "left_anti")


def fresh_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk still has the text they were made from."""
    return vectors.join(chunks.select("chunk_id", "text_sha256"), ["chunk_id", "text_sha256"], "left_semi")


def stale_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors of chunks that changed or are gone."""
    return vectors.join(chunks.select("chunk_id", "text_sha256"), ["chunk_id", "text_sha256"], "left_anti")


def complete_documents(documents: DataFrame, vectors: DataFrame, config: str) -> DataFrame:
    """Vectors of each document under the configuration, and whether they are all there."""
    counts = vectors.filter(F.col("config_id") == config).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("truncated"))
    return documents.join(counts, "document_id", "left").select("document_id", "chunk_count", F.coalesce("n", F.lit(0)).alias("vectors"), F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.col("chunk_count") == F.coalesce("n", F.lit(0))).alias("complete"))


def embed_pending(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, config: str, *, dimension: int = 384, model: str = "hashing") -> tuple[DataFrame, DataFrame]:
    """The next snapshots of vectors and documents: stale vectors go, missing ones are made, complete documents become ready.

    Vectors of other configurations of the documents that became ready are dropped.
    """
    from vellum.operators.dense import embed

    kept = fresh_vectors(vectors, chunks)
    made = embed(pending_chunks(chunks, kept, config), prefix="passage: ", dimension=dimension, model=model)
    made = made.select("chunk_id", "document_id", F.lit(config).alias("config_id"), "embedding", "text_sha256", (F.length("text") > 2000).alias("truncated"))
    after = kept.select(*made.columns).unionByName(made)
    done = complete_documents(documents, after, config).filter("complete").select("document_id", F.lit(True).alias("done"))
    nxt = documents.join(done, "document_id", "left").withColumn("status", F.when(F.col("done") & F.col("status").isin("chunked", "embedding", "ready"), "ready").otherwise(F.col("status")))
    other = F.coalesce("done", F.lit(False)) & (F.col("config_id") != config)
    return after.join(done, "document_id", "left").filter(~other).drop("done"), nxt.drop("done")


def to_reindex(documents: DataFrame, config: str, most: int = 100) -> DataFrame:
    """C4: ready under another configuration, or failed after chunking; the oldest first."""
    other = (F.col("status") == "ready") & ~F.col("config_id").eqNullSafe(config)
    return documents.filter(other | ((F.col("status") == "failed") & F.col("chunk_count").isNotNull())).orderBy("created_at", "document_id").limit(most)


def claimable_for_embedding(config: str, stale_before: Column) -> Column:
    """Chunked, ready under another configuration, or embedding without a sign of life."""
    status = F.col("status")
    return (status == "chunked") | ((status == "ready") & ~F.col("config_id").eqNullSafe(config)) | ((status == "embedding") & (F.col("heartbeat") < stale_before))


def claimable_for_processing(stale_before: Column) -> Column:
    """Pending, or in progress for too long."""
    return (F.col("status") == "pending") | (F.col("status").isin("parsing", "chunking") & (F.col("started_at") < stale_before))


def applied(documents: DataFrame, events: DataFrame) -> DataFrame:
    """The next snapshot after at most one event for each document.

    ``retry`` brings a failed document back to chunked if it has chunks and to
    pending if not. An event that does not fit the status leaves it;
    ``applied`` tells. Leaving chunked states drops the chunk count.
    """
    e, status = F.col("event"), F.col("status")
    after = F.when((e == "retry") & (status == "failed"), F.when(F.col("chunk_count").isNotNull(), "chunked").otherwise("pending"))
    for name, (before, then) in EVENTS.items():
        after = after.when((e == name) & status.isin(*before), then)
    both = documents.join(events.select("document_id", "event"), "document_id", "left").withColumn("after", after)
    drops = e.isin("processing_failed", "processing_released", "extracted") & F.col("after").isNotNull()
    return both.withColumns({"applied": F.col("after").isNotNull(), "status": F.coalesce("after", "status"), "chunk_count": F.when(drops, None).otherwise(F.col("chunk_count"))}).drop("after")


def violations(changes: DataFrame) -> DataFrame:
    """P10: rows of ``before, after`` that the lifecycle does not allow."""
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        allowed = allowed | ((F.col("before") == before) & F.col("after").isin(*after))
    return changes.filter(~F.coalesce(allowed, F.lit(False)))


def may_see(actor: Column, is_admin: Column, owner: Column) -> Column:
    """The owner or an administrator; search and versions ask for the owner alone."""
    return (actor == owner) | is_admin


def failure_class(reason: Column) -> Column:
    """Whether a failure may be tried again."""
    return F.when(reason.isNull(), None).when(reason.isin(*RETRYABLE), "retryable").otherwise("final")


def backoff(attempt: Column, base: float = 30.0, most: float = 600.0) -> Column:
    """Seconds before the next try: doubled each time up to a limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def stalled(documents: DataFrame, as_of: Column, *, after: timedelta = timedelta(seconds=300), most_attempts: int = 3) -> DataFrame:
    """Documents in progress since before the limit: released, or failed once their attempts are used up."""
    limit = as_of - F.expr(f"interval {int(after.total_seconds())} seconds")
    old = documents.filter(F.col("status").isin("parsing", "chunking", "embedding") & (F.col("started_at") < limit))
    return old.withColumn("action", F.when(F.col("attempts") >= most_attempts, "fail").otherwise("release"))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """How many documents each collection has, 0 for none."""
    counts = members.groupBy("collection_id").agg(F.countDistinct("document_id").alias("n"))
    return collections.join(counts, "collection_id", "left").withColumn("documents", F.coalesce("n", F.lit(0))).drop("n")


def collection_refs(members: DataFrame, collections: DataFrame) -> DataFrame:
    """Each document's collections, by name in lower case and id."""
    rows = members.join(collections, "collection_id").select("document_id", F.struct(F.lower("name").alias("k"), "collection_id", "name").alias("c"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("c")).alias("c")).select("document_id", F.transform("c", lambda c: c["name"]).alias("names"))


def added_members(request: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """For each requested ``collection_id, document_id``: added, existing, or unknown document.

    Any unknown one rejects the whole request of its collection.
    """
    asked = request.select("collection_id", "document_id").distinct()
    known = documents.select("document_id", F.lit(True).alias("known"))
    have = members.select("collection_id", "document_id", F.lit(True).alias("have")).distinct()
    rows = asked.join(known, "document_id", "left").join(have, ["collection_id", "document_id"], "left")
    bad = asked.join(known, "document_id", "left_anti").select(F.col("collection_id").alias("_of"), F.lit(True).alias("_bad")).distinct()
    rows = rows.join(bad, F.col("collection_id").eqNullSafe(F.col("_of")), "left")
    outcome = F.when(F.col("known").isNull(), "unknown").when(F.col("_bad"), "rejected").when(F.col("have"), "existing").otherwise("added")
    return rows.select("collection_id", "document_id", outcome.alias("outcome"))


def without_members(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Membership after removals; removing what is not there changes nothing."""
    return members.join(removed.select("collection_id", "document_id"), ["collection_id", "document_id"], "left_anti")


def name_conflicts(collections: DataFrame) -> DataFrame:
    """Names that a user has more than once, in any case."""
    return collections.groupBy("user_id", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def chunk_page(chunks: DataFrame, *, number: int = 1, size: int = 20) -> DataFrame:
    """C20: a document's chunks in reading order."""
    return page(chunks, number=number, size=size, by="chunk_index", descending=False, key="chunk_id")


def extension_matches(filename: Column, file_type: Column) -> Column:
    """C20: whether a new name keeps the type's extension."""
    return F.lower(F.element_at(F.split(filename, r"\."), -1)) == file_type
