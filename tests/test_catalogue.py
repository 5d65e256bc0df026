from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.operators import conversations as talk
from vellum.operators import documents as d
from vellum.operators.limits import anchored_windows

T0 = datetime(2024, 1, 1)


def test_listing_and_pages(spark):
    rows = [(i, f"a_{i}%b.txt" if i % 2 else f"axb{i}.txt", "txt", "ready", True, i) for i in range(30)]
    df = spark.createDataFrame(rows, "document_id long, filename string, file_type string, status string, is_current boolean, created_at long")
    assert d.listing(df, name_like="_1%B").count() == 1
    assert d.listing(df, status="failed").count() == 0
    assert [r.document_id for r in d.page(df, number=2, size=10).collect()] == list(range(19, 9, -1))
    assert d.total(df).first()["total"] == 30
    assert d.listing(df, collection=df.filter("document_id < 3")).count() == 3


def versions(spark, rows):
    return spark.createDataFrame(rows, "family_id string, version_number int, status string, is_active boolean, newly_ready boolean")


def test_activation(spark):
    df = versions(spark, [("a", 1, "ready", True, False), ("a", 2, "ready", False, True), ("a", 3, "failed", False, False), ("b", 1, "ready", False, False), ("b", 2, "ready", True, False), ("c", 1, "ready", False, True), ("d", 1, "ready", False, True), ("d", 2, "ready", True, False)])
    active = {(r.family_id, r.version_number) for r in d.activated(df).filter("is_active").collect()}
    assert active == {("a", 2), ("b", 2), ("c", 1), ("d", 2)}
    current = {(r.family_id, r.version_number) for r in d.current_versions(df).collect()}
    assert current == {("a", 1), ("b", 2), ("c", 1), ("d", 2)}
    newest = {(r.family_id, r.version_number, r.version_count) for r in d.newest_versions(df).collect()}
    assert ("a", 3, 3) in newest
    request = spark.createDataFrame([("b", 1), ("a", 3)], "family_id string, version_number int")
    after = {(r.family_id, r.version_number) for r in d.restored(df, request).filter("is_active").collect()}
    assert ("b", 1) in after and ("a", 1) in after
    assert ("c", 1) in {(r.family_id, r.version_number) for r in d.undeletable(df).collect()}


def test_events_and_transitions(spark):
    docs = spark.createDataFrame([(1, "pending", None), (2, "failed", 5), (3, "failed", None), (4, "ready", 7), (5, "chunking", 3)], "document_id long, status string, chunk_count int")
    events = spark.createDataFrame([(1, "claim"), (2, "retry"), (3, "retry"), (4, "claim"), (5, "processing_failed")], "document_id long, event string")
    got = {r.document_id: (r.status, r.applied, r.chunk_count) for r in d.applied(docs, events).collect()}
    assert got == {1: ("parsing", True, None), 2: ("chunked", True, 5), 3: ("pending", True, None), 4: ("ready", False, 7), 5: ("failed", True, None)}
    changes = spark.createDataFrame([("pending", "parsing"), ("ready", "failed"), (None, "ready")], "before string, after string")
    assert {r.after for r in d.violations(changes).collect()} == {"failed", "ready"}
    for name, (before, after) in d.EVENTS.items():
        assert all(after in d.TRANSITIONS[b] for b in before), name


def test_vectors(spark):
    chunks = spark.createDataFrame([(1, 1, "a", "ha"), (2, 1, "b", "hb"), (3, 2, "c", "hc")], "chunk_id long, document_id long, text string, text_sha256 string")
    vectors = spark.createDataFrame([(1, 1, "now", [1.0], "ha", False), (2, 1, "now", [1.0], "old", True), (3, 2, "then", [1.0], "hc", False)], "chunk_id long, document_id long, config_id string, embedding array<float>, text_sha256 string, truncated boolean")
    docs = spark.createDataFrame([(1, "chunked", 2), (2, "ready", 1)], "document_id long, status string, chunk_count int")
    assert [r.chunk_id for r in d.pending_chunks(chunks, vectors, "now").collect()] == [3]
    assert [r.chunk_id for r in d.stale_vectors(vectors, chunks).collect()] == [2]
    after, nxt = d.embed_pending(docs, chunks, vectors, "now", dimension=4)
    assert sorted((r.chunk_id, r.config_id) for r in after.collect()) == [(1, "now"), (2, "now"), (3, "now")]
    assert {r.status for r in nxt.collect()} == {"ready"}


def test_claims_stalls_backoff(spark):
    rows = [(1, "parsing", T0, 1), (2, "parsing", T0 + timedelta(minutes=9), 1), (3, "embedding", T0, 3), (4, "ready", T0, 1)]
    df = spark.createDataFrame(rows, "document_id long, status string, started_at timestamp, attempts int")
    got = {r.document_id: r.action for r in d.stalled(df, F.lit(T0 + timedelta(minutes=10))).collect()}
    assert got == {1: "release", 3: "fail"}
    assert df.filter(d.claimable_for_processing(F.lit(T0 + timedelta(minutes=1)))).count() == 1
    assert [r.b for r in spark.range(1, 7).select(d.backoff(F.col("id")).alias("b")).collect()] == [30, 60, 120, 240, 480, 600]


def test_uploads_and_collections(spark):
    up = spark.createDataFrame([(1, "u", "x", "f1", 1), (2, "u", "x", "f1", 2), (3, "u", "x", "f2", 3), (4, "v", "x", "f3", 4)], "document_id long, user_id string, checksum string, family_id string, arrived int")
    assert [r.outcome for r in d.checksum_duplicates(up).orderBy("document_id").collect()] == ["new", "repeat", "duplicate", "new"]
    docs = spark.createDataFrame([(1,), (2,)], "document_id long")
    members = spark.createDataFrame([("c", 1)], "collection_id string, document_id long")
    asked = spark.createDataFrame([("c", 1), ("c", 2), ("c", 2), ("e", 1), ("e", 9)], "collection_id string, document_id long")
    got = {(r.collection_id, r.document_id): r.outcome for r in d.added_members(asked, members, docs).collect()}
    assert got == {("c", 1): "existing", ("c", 2): "added", ("e", 1): "rejected", ("e", 9): "unknown"}
    names = spark.createDataFrame([("c", "Big"), ("e", "art")], "collection_id string, name string")
    assert {r.collection_id: r.documents for r in d.collection_counts(names, members).collect()} == {"c": 1, "e": 0}
    assert d.without_members(members, asked).count() == 0
    assert d.collection_refs(members, names).first()["names"] == ["Big"]


def test_conversations(spark):
    rows = [("a", 1, "user", "first question", "failed", 1, "m1", T0), ("a", 2, "assistant", "x", "done", 0, "m2", T0), ("b", 1, "user", "q", "processing", 1, "m3", T0), ("b", 2, "user", "r", "processing", 2, "m4", T0 + timedelta(minutes=20))]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, status string, attempts int, message_id string, started_at timestamp")
    assert [r.conv_id for r in talk.in_flight_conflicts(df).collect()] == ["b"]
    late = {r.message_id: r.status for r in talk.interrupted(df, F.lit(T0 + timedelta(minutes=21))).collect()}
    assert late["m3"] == "failed" and late["m4"] == "processing"
    again = {r.message_id: (r.status, r.attempts) for r in talk.resumed(df, df.select("message_id")).collect()}
    assert again["m1"] == ("processing", 2) and again["m3"] == ("processing", 1)
    results = spark.createDataFrame([("m3", 1, "answered"), ("m4", 1, "answered")], "message_id string, attempt int, outcome string")
    done = {r.message_id: r.status for r in talk.settled(df, results).collect()}
    assert done["m3"] == "answered" and done["m4"] == "processing"
    assert talk.titles(df).filter("conv_id = 'a'").first()["title"] == "first question"
    assert talk.full_conversations(df, most=3).count() == 2
    requests = spark.createDataFrame([("a", "k", "h1", 1), ("a", "k", "h1", 2), ("a", "k", "h2", 3)], "conv_id string, idempotency_key string, request_hash string, arrived int")
    assert [r.outcome for r in talk.idempotent(requests).orderBy("arrived").collect()] == ["new", "replay", "conflict"]


def test_anchored_windows(spark):
    at = [0, 10, 50, 61, 62, 200]
    df = spark.createDataFrame([(i, "k" if i < 6 else "other", T0 + timedelta(seconds=s)) for i, s in enumerate([*at, 5])], "event_id long, user_id string, ts timestamp")
    got = {r.event_id: (r.attempt, r.allowed) for r in anchored_windows(df, key="user_id", at="ts", order="event_id", window=timedelta(seconds=60), most=2).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (2, True), 5: (1, True), 6: (1, True)}


def test_anchored_windows_without_time_or_order(spark):
    rows = [(1, "k", T0), (None, "k", T0 + timedelta(seconds=5)), (3, "k", None), (4, None, T0), (5, None, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    got = {(r.event_id, r.attempt, r.allowed) for r in anchored_windows(df, key="user_id", at="ts", order="event_id", window=timedelta(seconds=60), most=1).collect()}
    assert got == {(1, 1, True), (None, 2, False), (3, None, None), (4, 1, True), (5, None, None)}
    assert anchored_windows(df.limit(0), key="user_id", at="ts", order="event_id", window=timedelta(seconds=60), most=1).count() == 0


def test_first_rows_with_ties_and_nulls(spark):
    """One row of a key is first, whatever ties, repeats or nulls it has."""
    rows = [(1, "k", "x", 5), (2, "k", "y", 5), (3, "k", "x", 5), (4, "k", "x", 9), (5, None, "x", 1), (6, None, None, 2), (7, "n", "z", None), (8, "n", "z", 1)]
    df = spark.createDataFrame(rows, "event_id long, k string, request_hash string, arrived long")
    got = {r.event_id: r.outcome for r in talk.idempotent(df, key=("k",)).collect()}
    assert sorted([got[1], got[3]]) == ["new", "replay"] and got[2] == "conflict" and got[4] == "replay"
    assert (got[5], got[6], got[7], got[8]) == ("new", "conflict", "new", "replay")
    assert talk.idempotent(df.limit(0), key=("k",)).count() == 0
