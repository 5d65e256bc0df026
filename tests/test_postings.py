import random
import shutil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions.varints import gaps, heads, pack, summed, unpack
from vellum.operators import postings
from vellum.operators.lexical import lexical_search
from vellum.operators.postings import PostingsIndex

WORDS = [f"w{n}" for n in range(60)]
CHUNKS, DOCS = "chunk_id long, document_id string, user_id string, text string", "document_id string, user_id string, status string, is_active boolean, chunk_count int"


@given(st.lists(st.lists(st.integers(0, 2**62), min_size=1, max_size=6), max_size=8))
@settings(max_examples=200, deadline=None)
def test_lists_come_back(some):
    values, sizes = np.array([x for own in some for x in own], np.int64), np.array([len(x) for x in some], np.int64)
    packed = pack(values, heads(sizes))
    assert unpack(packed).tolist() == values.tolist() and len(packed) == len(some)
    if some:
        assert [unpack(packed.slice(i, 1)).tolist() for i in range(len(some))] == some
        ascending = np.concatenate([np.sort(np.array(x) // 8) for x in some])
        assert summed(gaps(ascending, heads(sizes)), sizes).tolist() == ascending.tolist()


def corpus(seed, documents=40):
    """Chunks whose words follow a steep law, so that some words are rare and some in nearly all."""
    rng = random.Random(seed)
    chunks, docs = [], []
    for d in range(documents):
        user = "u1" if d % 4 else "u2"
        n = rng.randint(1, 5)
        for k in range(n):
            text = " ".join(WORDS[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 25)))
            chunks.append((1000 * d + k, f"d/{d}", user, text if rng.random() < 0.95 else None))
        docs.append((f"d/{d}", user, "ready" if d % 5 else "chunked", d % 9 != 0, n))
    return chunks, docs


def questions(spark):
    rng = random.Random(1)
    rows = [(q, "u1" if q % 3 else "u2", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))), [" ".join(WORDS[x] for x in (a, a + 1)) for a in rng.sample(range(8), q % 3)]) for q in range(24)]
    rows += [(90, "u1", "w0 w1 w59", ["w0 w0", "w2", "nowhere at all"]), (91, "u3", "w1", []), (92, "u1", "the", [])]
    return spark.createDataFrame(rows, "query_id long, user_id string, words string, phrases array<string>")


def plain(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.document_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "SPREAD", 50)
    monkeypatch.setattr(postings, "LEAD", 1)


def test_search_equals_the_scan(spark, tmp_path, small_blocks):
    chunks, docs = corpus(3)
    index = PostingsIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        index.search(questions(spark))
    # The texts lie in a file that is gone when the search runs.
    spark.createDataFrame(chunks, CHUNKS).write.parquet(str(tmp_path / "texts"))
    documents = spark.createDataFrame(docs, DOCS)
    index.update(spark.read.parquet(str(tmp_path / "texts")), documents)
    shutil.rmtree(tmp_path / "texts")
    for limit, terms in ((3, 12), (10, 2)):
        assert plain(index.search(questions(spark), limit=limit, max_terms=terms)) == plain(lexical_search(spark.createDataFrame(chunks, CHUNKS), documents, questions(spark), limit=limit, max_terms=terms))
    scope = spark.createDataFrame([(q, f"d/{d}") for q in (1, 2, 90) for d in range(0, 40, 3)], "query_id long, document_id string")
    assert plain(index.search(questions(spark), limit=3, scope=scope)) == plain(lexical_search(spark.createDataFrame(chunks, CHUNKS), documents, questions(spark), limit=3, scope=scope))


def test_changes_document_by_document(spark, tmp_path, small_blocks):
    chunks, docs = corpus(3)
    index, make = PostingsIndex(spark, str(tmp_path / "index")), spark.createDataFrame
    index.update(make(chunks, CHUNKS), make(docs, DOCS))
    first = plain(index.search(questions(spark), limit=4))
    # New texts and a new status for some, the removal of others, and new documents.
    others, other_docs = corpus(8, documents=48)
    changed = [d for d in other_docs if int(d[0][2:]) % 6 == 0 or int(d[0][2:]) >= 40]
    names = {d[0] for d in changed}
    index.update(make([c for c in others if c[1] in names], CHUNKS), make(changed, DOCS))
    gone = [(f"d/{d}", "u1" if d % 4 else "u2") for d in (1, 6, 44)]
    index.remove(make(gone, "document_id string, user_id string"))
    left = {d[0] for d in docs} - names
    now_docs = [d for d in docs if d[0] in left] + changed
    now_docs = [d for d in now_docs if d[0] not in {g[0] for g in gone}]
    now_chunks = [c for c in chunks if c[1] in left] + [c for c in others if c[1] in names]
    now_chunks = [c for c in now_chunks if c[1] not in {g[0] for g in gone}]
    expected = plain(lexical_search(make(now_chunks, CHUNKS), make(now_docs, DOCS), questions(spark), limit=4))
    assert plain(index.search(questions(spark), limit=4)) == expected != first
    assert plain(index.search(questions(spark), limit=4, version=1)) == first
    index.merge()
    state = index.versions.state()
    assert len(state["segments"]) == 1 and not state["dirty"]
    assert plain(index.search(questions(spark), limit=4)) == expected


def test_blocks_are_skipped_by_their_bound(spark, tmp_path, monkeypatch):
    """A rare word decides; of the frequent one's blocks only those are read that may hold its chunks."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "LEAD", 1)
    texts = [(n, "d", "u", "common " + ("rare" if n % 500 == 0 else f"x{n}")) for n in range(2000)]
    index = PostingsIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame(texts, CHUNKS), spark.createDataFrame([("d", "u", "ready", True, 2000)], DOCS))
    read = {}
    real = PostingsIndex.covering

    def counted(blocks, *rest):
        out = real(blocks, *rest)
        read["all"], read["some"] = blocks.filter("searchable and token = 'common'").count(), out.count()
        return out

    monkeypatch.setattr(PostingsIndex, "covering", staticmethod(counted))
    queries = spark.createDataFrame([(1, "u", "common rare", [])], "query_id long, user_id string, words string, phrases array<string>")
    assert {r.chunk_id for r in index.search(queries, limit=4).collect()} == {0, 500, 1000, 1500}
    assert 0 < read["some"] <= read["all"] / 5


def test_empty_batches(spark, tmp_path):
    index = PostingsIndex(spark, str(tmp_path / "index"))
    none = spark.createDataFrame([], CHUNKS)
    index.update(none, spark.createDataFrame([("d", "u", "ready", True, None)], DOCS))
    index.update(spark.createDataFrame([(1, "d", "u", "one two"), (2, "d", "u", "?!"), (None, "d", "u", "one")], CHUNKS), spark.createDataFrame([("d", "u", "ready", True, 2)], DOCS))
    queries = spark.createDataFrame([(1, "u", "two", [])], "query_id long, user_id string, words string, phrases array<string>")
    assert [r.chunk_id for r in index.search(queries).collect()] == [1]
    assert index.search(queries.filter(F.lit(False))).collect() == []
