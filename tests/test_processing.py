import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators.chunking import Limits
from vellum.operators import dense
from vellum.operators.dense import ranks_of
from vellum.operators.evaluation import answer_summary, auroc, latency_summary
from vellum.operators.staging import staged
from vellum.plans.assessment import model_comparison, rag_results, suite_report
from vellum.plans.processing import every, process_documents, timed_out
from vellum.plans.rag import register_generator

T0 = datetime(2024, 1, 1)


def test_processing(spark):
    names = ["a.txt", "a.txt", "b.md", "c.pdf", "gone.txt", "blank.txt", "long.txt", "d.txt", "e.txt"]
    status = ["pending"] * 7 + ["ready", "parsing"]
    documents = spark.createDataFrame([(i, n, s, T0) for i, (n, s) in enumerate(zip(names, status))], "document_id long, filename string, status string, started_at timestamp")
    contents = {"a.txt": b"Some words here.", "b.md": b"# Title\n\nBody text of it.", "c.pdf": b"no pdf", "blank.txt": b" \n ", "long.txt": b"word " * 400, "d.txt": b"x", "e.txt": b"late one"}
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in contents.items()], "filename string, content binary")
    out = process_documents(documents, files, limits=Limits(most=40, overlap=0, least=5, chunks=10), stale_before=F.lit(T0 + timedelta(hours=1)))
    reasons = {r.document_id: (r.failure_reason, r.failure_class) for r in out.failures.collect()}
    assert reasons == {3: (reasons[3][0], "final"), 4: ("file_missing", "final"), 5: ("empty_document", "final"), 6: ("too_many_chunks", "final")}
    after = {r.document_id: r for r in out.documents.collect()}
    assert {i: r.status for i, r in after.items()} == {0: "chunked", 1: "chunked", 2: "chunked", 3: "failed", 4: "failed", 5: "failed", 6: "failed", 7: "ready", 8: "chunked"}
    assert sorted((r.document_id, r.text) for r in out.chunks.collect()) == [(0, "Some words here."), (1, "Some words here."), (2, "Body text of it."), (8, "late one")]
    snapshot = json.loads(after[0].metadata)
    assert (snapshot["chunk_count"], snapshot["max_chunk_chars"], snapshot["chunking"]["most"]) == (1, 16, 40) and "primary_script" in snapshot["script"]
    nothing = process_documents(documents.limit(0), files)
    assert nothing.chunks.count() == nothing.failures.count() == nothing.documents.count() == 0


def test_timeouts(spark):
    rows = [(1, "parsing", T0, 1), (2, "embedding", T0, 1), (3, "embedding", T0, 3), (4, "parsing", T0 + timedelta(minutes=55), 1), (5, "ready", T0, 9)]
    df = spark.createDataFrame(rows, "document_id long, status string, started_at timestamp, attempts int")
    got = {r.document_id: (r.status, r.failure_reason) for r in timed_out(df, F.lit(T0 + timedelta(hours=1))).collect()}
    assert got == {1: ("failed", "timeout"), 2: ("chunked", None), 3: ("failed", "timeout"), 4: ("parsing", None), 5: ("ready", None)}


def test_sweeps_run_on_a_stream(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "ticks"))
    ran = []
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "ticks"))
    every(ticks, str(tmp_path / "state"), lambda: ran.append(1), once=True).awaitTermination(60)
    assert ran


def full_ranking(vectors, query):
    unit = [(k, np.array(v) / np.linalg.norm(v)) for k, v in vectors if np.linalg.norm(v) > 0]
    return [k for _, k in sorted((-round(float(v @ (query / np.linalg.norm(query))), 12), k) for k, v in unit)]


@pytest.mark.parametrize("size", [32 << 20, 100])
def test_ranks_of(spark, size):
    rng = random.Random(2)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(80)] + [(90, [0.0] * 4), (91, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(q, [float(rng.randint(1, 3)) for _ in range(4)]) for q in range(4)] + [(9, None)], "query_id long, embedding array<double>")
    wanted = spark.createDataFrame([(q, k) for q in (0, 1, 2, 3, 9) for k in (0, 5, 60, 90, 91, 1000)], "query_id long, chunk_id long")
    got = {(r.query_id, r.chunk_id): r["rank"] for r in ranks_of(vectors, queries, wanted, broadcast_bytes=size).collect()}
    known = [(k, v) for k, v in rows if v is not None]
    expected = {}
    for r in queries.filter("embedding is not null").collect():
        order = full_ranking(known, np.array(r.embedding))
        expected |= {(r.query_id, k): order.index(k) + 1 for k in (0, 5, 60) if k in order}
    assert got == expected
    assert ranks_of(vectors, queries, wanted.limit(0)).count() == 0


QUESTIONS = [(1, "When did the harvest end?", "a", [7], [["12 july", "july 12"]]), (2, "zebra giraffe", "b", [], []), (3, "What was the yield?", "a", [8], [["9 tons"]])]


def test_rag_results_and_report(spark):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, query string, category string, relevant array<long>, facts array<array<string>>")
    text = "The harvest ended on 12 July 2024. The yield was 3.5 tons."
    ranked = spark.createDataFrame([(q, 7, text, 1) for q in (1, 2, 3)], "query_id long, chunk_id long, text string, rank int")
    rows = {r.query_id: r for r in rag_results(questions, ranked).collect()}
    assert rows[1].answered and rows[1].fact_complete and rows[1].cited == [7] and rows[1].error is None
    assert rows[2].abstain_expected and not rows[2].answered and rows[2].cited == []
    assert rows[3].answered and not rows[3].fact_complete
    summary = answer_summary(rag_results(questions, ranked))
    total = summary.first()
    assert (total.questions, total.answered_rate, total.abstention_accuracy, total.fact_recall, total.gold_citation_rate) == (3, 1.0, 1.0, 0.5, 0.5)
    report = suite_report({"answers": summary})
    assert {r.metric: r.value for r in report.collect()}["fact_recall"] == 0.5
    worse = suite_report({"answers": summary.withColumn("fact_recall", F.lit(0.1))}, report)
    assert {r.metric: r.verdict for r in worse.collect()}["fact_recall"] == "worse"


@pytest.mark.parametrize("completion", ['{"answer": "<history> says 77 [S1].", "citations": ["S1"]}', '{"answer": "The yield was 3.5 tons [S8].", "citations": ["S8"]}', '{"answer": "It said “never written” [S1].", "citations": []}', "not json", None])
def test_misbehaving_readers(spark, completion):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, query string, category string, relevant array<long>, facts array<array<string>>")
    ranked = spark.createDataFrame([(q, 7, "The yield was 3.5 tons.", 1) for q in (1, 2, 3)], "query_id long, chunk_id long, text string, rank int")
    register_generator("bad", lambda asked, blocks: asked.select("query_id", F.lit(completion).cast("string").alias("completion")))
    assert not any(r.answered for r in rag_results(questions, ranked, generator="bad").collect())


def test_model_comparison(spark):
    passages = spark.createDataFrame([(1, "wheat harvest in july"), (2, "zebra in the hills"), (3, "trains run late")], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "harvest of wheat"), (2, "late trains")], "query_id long, query string")
    relevant = spark.createDataFrame([(1, 1), (2, 3)], "query_id long, key long")
    got = {r.arm: r.recall_at_1 for r in model_comparison(passages, questions, relevant, [("wide", "hashing", 384), ("narrow", "hashing", 2)]).collect()}
    assert got["wide"] == 1.0 and set(got) == {"wide", "narrow"}


def test_ranks_of_whole_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, 3.0, rng.random()])) for _ in range(700)]
    got = {r.k: r for r in latency_summary(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    for k in ("a", "b", None):
        own = sorted(v for g, v in rows if g == k and v is not None)
        n = len(own)
        assert (got[k].n, got[k]["max"]) == (n, round(own[-1], 2))
        assert got[k].p95 == round(own[-(-n * 95 // 100) - 1], 2) and got[k].p99 == round(own[-(-n * 99 // 100) - 1], 2)
        assert abs(got[k].median - (own[(n - 1) // 2] + own[n // 2]) / 2) < 0.0051
    scored = [(rng.choice([0.1, 0.5, rng.random()]), rng.random() < 0.4) for _ in range(400)] + [(None, True)]
    won = sum((a > b) + (a == b) / 2 for a, p in scored if p and a is not None for b, q in scored if not q)
    pairs = sum(p and a is not None for a, p in scored) * sum(not q for _, q in scored)
    assert abs(auroc(spark.createDataFrame(scored, "score double, positive boolean").repartition(6)).first().auroc - won / pairs) < 1e-9


def test_a_query_meets_a_vector_once_for_all_its_keys(spark, monkeypatch):
    """Blocks of queries follow the number of queries, not of wanted keys; equal vectors rank by key."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (300, 64)).astype(float)
    rows[200:] = rows[:100]
    rows[7] = 0
    asked = rng.integers(-2, 3, (2, 64)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    calls = []
    monkeypatch.setattr(dense, "staged", lambda df: calls.append(1) or staged(df))
    got = {(r.query_id, r.chunk_id): r["rank"] for r in ranks_of(vectors, queries, queries.select("query_id").crossJoin(vectors.select("chunk_id")), broadcast_bytes=100_000).collect()}
    length = np.linalg.norm(rows, axis=1)
    for q, v in enumerate(asked):
        score = np.round(rows @ v / np.where(length > 0, length, 1) / np.linalg.norm(v), 12)
        order = sorted((i for i in range(300) if length[i] > 0), key=lambda i: (-score[i], i))
        assert {i: got[q, i] for i in order} == {i: n + 1 for n, i in enumerate(order)} and (q, 7) not in got
    assert len(calls) == 1
