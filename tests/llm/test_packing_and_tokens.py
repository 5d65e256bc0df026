import hashlib
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import packing
from vellum.llm.bpe import BytePairs, bpe_decode, bpe_digests, bpe_encode
from vellum.llm.token_counts import quantile, token_counts, truncated_total

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PAIRS, LIBRARY = BytePairs(BYTE), Tokenizer.from_file(BYTE)
WORDS, WORD_LIBRARY = packing.WordIds(WORD), Tokenizer.from_file(WORD)
ODD = ["", "<|endoftext|>a<|endoftext|>", "a" * 300, "\x1c x\x85 y\xa0z", "It's o'clock 's''re", "ΑΣ Σ İstanbul", "½²③ 中文😀", "aaabab" * 60, " " * 99 + "x", "<|x|>", "\x00\xad"]
MIXED = st.text(alphabet=st.one_of(st.sampled_from("aeinrst 's.\n\té²<|>0"), st.characters(codec="utf-8")), max_size=60)


def same(text):
    ids = np.frombuffer(PAIRS.encode(text), "<u4").tolist()
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == expected
    assert PAIRS.decode(array("I", ids).tobytes()) == LIBRARY.decode(expected, skip_special_tokens=False)
    assert np.frombuffer(WORDS.encode(text), "<u4").tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@given(MIXED)
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    same(text)


@given(st.lists(st.integers(0, 50256), max_size=20))
@settings(max_examples=200, deadline=None)
def test_any_ids(ids):
    assert PAIRS.decode(array("I", ids).tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bins(lengths):
    bins = packing.best_two_fit(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
    assert sum(2 * sum(lengths[i] for i in b) <= 40 for b in bins) <= 1


def test_repair_beats_greed():
    # Greedy fills 6 + 3 and leaves 1; two smaller ones in place of the 3 fill the bin.
    assert sorted(packing.best_two_fit([6, 3, 2, 2], 10)[0]) == [0, 2, 3] and len(packing.best_two_fit([6, 3, 2, 2], 10)) == 2


def rows(spark):
    texts = ["the cat sat on the mat " * n for n in (0, 1, 1, 3, 20, 700, 3)] + [None, "It's <|endoftext|> é"]
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, length int")


def test_packed_table(spark):
    docs = rows(spark)
    out = packing.pack_documents(docs, capacity=64).collect()
    ids = {r.doc_id: WORD_LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in out:
        part = array("I", ids[r.doc_id][r.start : r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length and r.start == 64 * r.piece
        by_doc.setdefault(r.doc_id, []).append(r.length)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sum(x) for i, x in by_doc.items()} == {i: len(x) for i, x in ids.items()}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) == -(-sum(map(len, ids.values())) // 64)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.pack_documents(docs, group_docs=2).select("sequence_id").distinct().count() >= 5


def test_bpe_tables(spark):
    docs = rows(spark)
    got = {r.doc_id: r for r in bpe_digests(docs).collect()}
    assert got[0].n_tokens == 0 and got[7].n_tokens == 0 and got[7].ids_sha256 == got[0].ids_sha256
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        own = got[r.doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs)).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect())


def test_counts(spark):
    docs = rows(spark)
    lengths = [len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    table = token_counts(docs)
    for r in table.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_most == sum(x <= n for x in lengths) and r.tokens_at_most == sum(x for x in lengths if x <= n)
        assert r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
    for limit in (0, 1, 5, 17, *lengths, 10_000):
        found = truncated_total(table, limit).first()
        assert (found.tokens_kept, found.docs_cut) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    assert quantile(table, 0.5).first().n_tokens == sorted(lengths)[(len(lengths) - 1) // 2]
    empty = token_counts(docs.limit(0))
    assert empty.count() == 0 and tuple(truncated_total(empty, 5).first()) == (0, 0)
    long_only = token_counts(docs.filter("doc_id = 5"))
    assert tuple(truncated_total(long_only, 3).first()) == (3, 1)


def test_null_ids_do_not_share_a_group(spark):
    docs = spark.createDataFrame([(None, f"cat {k}") for k in range(40)], "doc_id long, text string")
    out = packing.pack_documents(docs, capacity=1000, group_docs=5).collect()
    assert len(out) == 40 and len({r.sequence_id for r in out}) >= 5


def test_words_that_do_not_end_go_to_the_library():
    words = packing.WordIds(WORD)
    words.ends[:] = False
    assert np.frombuffer(words.encode("the cat sat"), "<u4").tolist() == WORD_LIBRARY.encode("the cat sat", add_special_tokens=False).ids
