import zlib
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import cost_packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def checked(lengths, placed, capacity):
    """Every token lies in one place, and sequences are gapless and full, or a power of two long."""
    own = {}
    for piece, start, length, _, _ in placed:
        own.setdefault(piece, []).append((start, length))
    for piece, n in enumerate(lengths):
        at = 0
        for start, length in sorted(own[piece]):
            assert start == at and length > 0
            at += length
        assert at == n
    sequences = {}
    for _, _, length, sequence, offset in placed:
        sequences.setdefault(sequence, []).append((offset, length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return sequences


@given(st.lists(st.integers(1, 31), max_size=80))
@settings(max_examples=300, deadline=None)
def test_no_padding(lengths):
    lengths = sorted(lengths, reverse=True)
    checked(lengths, cost_packing.balanced(lengths, 32), 32)


@given(st.lists(st.integers(1, 31), max_size=40))
@settings(max_examples=100, deadline=None)
def test_cheapest_sequence_with_room(lengths):
    """The tree gives what a search of all open sequences gives."""
    lengths = sorted(lengths, reverse=True)
    sizes = cost_packing.capacities(sum(lengths), 32)
    spent, left = [6 * cost_packing.WIDTH * (32 - n) for n in sizes], list(sizes)
    parts = {}
    for piece, start, length, sequence, _ in cost_packing.balanced(lengths, 32):
        whole = lengths[piece] - parts.get(piece, 0)
        fits = [(spent[s], s) for s in range(len(sizes)) if left[s] >= whole] or [(spent[s], s) for s in range(len(sizes)) if left[s]]
        assert (spent[sequence], sequence) == min(fits) and length == min(whole, left[sequence]) and start == parts.get(piece, 0)
        parts[piece] = start + length
        left[sequence] -= length
        spent[sequence] += cost_packing.cost(length)


def test_costs_are_balanced():
    """Long and short documents: no sequence costs much more than another, where next fit makes them uneven."""
    lengths = sorted([900] * 20 + [30] * 1500, reverse=True)
    sums = {}
    for _, _, length, sequence, _ in cost_packing.balanced(lengths, 2048):
        sums[sequence] = sums.get(sequence, 0) + length * length
    full = list(sums.values())[: sum(lengths) // 2048]
    assert max(full) - min(full) < 900 * 900 * 1.2


def documents(spark):
    texts = ["the cat sat on the mat " * n for n in (0, 1, 1, 3, 20, 700, 3, 9000)] + [None, "It's <|endoftext|> é", "cat " * 63, "cat " * 127]
    rows = [(i, t, "extra", 1, 2) for i, t in enumerate(texts)] + [(None, "a cat", "x", 1, 2), (None, "a cat", "x", 1, 2), (3, "again", "x", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, pack_group int, `start` int")


def test_table(spark):
    docs = documents(spark).cache()
    for capacity, group in ((64, 16_384), (2048, 16_384), (64, 20)):
        out = cost_packing.pack_by_cost(docs, capacity=capacity, group_pieces=group).collect()
        tokens = {}
        for r in docs.collect():
            tokens.setdefault(r.doc_id, []).append(LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [1])
        assert sum(r.length for r in out) == sum(len(x) for own in tokens.values() for x in own)
        sequences = {}
        for r in out:
            parts = [array("I", x[r.start : r.start + r.length]) for x in tokens[r.doc_id] if len(x) == r.doc_tokens]
            assert any(len(x) == r.length and zlib.crc32(x.tobytes()) == r.ids_crc32 for x in parts)
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, own in tokens.items():
            if len(own) == 1:
                at = 0
                for start, length in sorted((r.start, r.length) for r in out if r.doc_id == i):
                    assert start == at
                    at += length
                assert at == len(own[0])
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at == capacity or at < capacity and at & (at - 1) == 0
    assert cost_packing.pack_by_cost(docs.limit(0)).count() == 0


def test_real_documents(spark):
    """Documents stay whole unless there is no room: cuts are about one for each sequence at most, and nothing is padded."""
    out = cost_packing.pack_by_cost(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    by_sequence = {r["sequence_id"]: r["n"] for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in by_sequence.values())
    pieces = out.count()
    needed = sum(-(-r[0] // 2048) for r in out.select("doc_tokens", "doc_id").distinct().collect())
    assert pieces - needed <= len(by_sequence) + 20
