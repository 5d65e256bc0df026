import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vellum.llm.byte_windows import suffix_dedup
from vellum.llm.chunks import difference_cover
from vellum.llm.suffixes import repeated_prefixes
from vellum.llm.word_windows import substring_dedup, word_lists


def removed(sequences, width):
    """Brute force: for each sequence, which places lie in a window that starts anywhere else too."""
    times = Counter(s[k : k + width] for s in sequences for k in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if times[s[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        out.append(gone)
    return out


def texts(seed=4):
    rng = random.Random(seed)
    words = ["alpha", "beta", "γάμμα", "d", "ee"]
    passage = " ".join(rng.choices(words, k=90))
    own = [" ".join(rng.choices([*words, "x", "y"], k=rng.randint(0, 120))) for _ in range(14)]
    out = [o + (" " + passage[rng.randint(0, 60) : rng.randint(200, 400)] if i % 2 else "") for i, o in enumerate(own)]
    return [*out, out[3], out[3], None, "", " \n\t", "a" * 500, "ab" * 300, "tab\tnew\nline " * 30, passage * 2, "a b c " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, b"clash", 7) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "null id " * 60, b"", 1)], "doc_id long, text string, body binary, chunk int").repartition(3)


@pytest.mark.parametrize("period", [1, 7, 13, 21])
def test_covers(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize(("window", "period"), [(35, 21), (6, 3), (4, 4)])
def test_words(docs, window, period):
    sequences = [tuple((t or "").encode().split()) for t in texts()] + [tuple(("null id " * 60).encode().split())]
    expected = sorted((len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for s, g in zip(sequences, removed(sequences, window)))
    got = substring_dedup(docs, window=window, period=period).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    assert {r.doc_id for r in got} == {*range(len(texts())), None}


@pytest.mark.parametrize("hot", [100_000, 40, 1])
@pytest.mark.parametrize("length", [200, 30])
def test_bytes(docs, length, hot):
    raw = [(t or "").encode() for t in texts()] + [("null id " * 60).encode()]
    expected = sorted((len(s), sum(g), sum(x and not (k and g[k - 1]) for k, x in enumerate(g)), hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()) for s, g in zip(raw, removed(raw, length)))
    got = suffix_dedup(docs, length=length, hot_places=hot).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


def test_chunks_without_keys(spark):
    """Each row is a chunk of its own; some have no gram, no hot gram, no anchor or no word at all."""
    rows = ["", "short", None, "ab" * 300, "ab" * 300, "x y " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartitionByRange(len(rows), "doc_id")
    raw = [(t or "").encode() for t in rows]
    expected = [sum(g) for g in removed(raw, 200)]
    for hot in (100_000, 200, 1):
        assert [r.n_removed for r in suffix_dedup(docs, hot_places=hot).sort("doc_id").collect()] == expected
    words = [tuple(t.split()) for t in raw]
    assert [r.n_removed for r in substring_dedup(docs).sort("doc_id").collect()] == [sum(g) for g in removed(words, 35)]


def test_empty(docs):
    assert substring_dedup(docs.limit(0)).count() == 0
    assert suffix_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="period"):
        substring_dedup(docs, window=5, period=6)


def test_suffixes():
    rng = random.Random(3)
    for _ in range(60):
        depth = rng.choice([26, 27, 40, 75, 200, 203])
        base = bytes(rng.choice(b"ab") for _ in range(600))
        data = b"".join(base[(a := rng.randrange(300)) : a + rng.randrange(1, 300)] for _ in range(8)) + bytes(depth)
        starts = np.array(sorted(rng.sample(range(len(data) - depth + 1), rng.randrange(2, min(600, len(data) - depth)))))
        times = Counter(data[s : s + depth] for s in starts)
        assert repeated_prefixes(np.frombuffer(data, np.uint8), starts, depth, rng.choice([10, 50, 10_000])).tolist() == [times[data[s : s + depth]] > 1 for s in starts]


def test_colliding_words(spark):
    """Polynomial hashes modulo 2**64 collide on a Thue-Morse word and its complement, whatever their odd base."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{rest} {word}"), (4, f"{rest}\n{word}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 35, 4: 35}


def test_word_parts(monkeypatch):
    monkeypatch.setattr("vellum.llm.word_windows.SPLIT_BYTES", 5)
    for text in (b"", b"  ", b"a bb ccc dddd eeeee ffffff ", b"one\ttwo\n\nthreefourfivesix seven", b" x"):
        assert [w for words in word_lists(text, 0, len(text)) for w in words] == text.split()
