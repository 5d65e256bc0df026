import os
import random

import pytest

from vellum.functions.text import match_form
from vellum.operators import duplicates, staging
from vellum.operators.duplicates import key_bits, near_duplicate_classes, near_duplicate_pairs, window_keys, with_windows, word_candidates, word_sets


def brute_classes(spark, rows):
    """Least id of each row's class, by all pairs of places."""
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for b in range(len(rows)) for a in range(b)], "left_id long, right_id long")
    root = list(range(len(rows)))
    for left, right, duplicate in near_duplicate_pairs(texts, pairs).collect():
        if duplicate:
            old, new = root[right], root[left]
            root = [new if r == old else r for r in root]
    ids = {r: [i for (i, _), own in zip(rows, root) if own == r] for r in root}
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return [(i, least[r], len(ids[r])) for (i, _), r in zip(rows, root)]


def fixture():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgßéж", k=rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([9, 10, 20, 60, 200]))) for _ in range(25)]
    texts = [*base, None, None, "", " ", "...", "!!", "short", "shorter short", "Short"]
    for b in base:
        words = b.split()
        texts += [b.upper(), "\n".join(words), " ".join(reversed(words)), "vorab " + b, b + " nachher ist noch etwas mehr", b[3:50], b[5:44], b[5:46]]
        for changes in (1, 2, 5, 12):
            new = list(words)
            for _ in range(changes):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            texts.append(" ".join(new))
    texts += [". ".join(base[:3]), "-" * 39, "-" * 40, "-" * 41, "-" * 70, "Ж" * 40, "Ж" * 55, "Ж" * 39]
    rng.shuffle(texts)
    rows = [(1000 - 7 * k, t) for k, t in enumerate(texts)]
    return [*rows, (None, base[4]), (None, "nothing near to this one"), (rows[3][0], base[5]), (rows[3][0], rows[3][1])]


def test_classes_are_those_of_all_pairs(spark):
    rows = fixture()
    assert match_form("A  b") == "a b"
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, near_duplicate_classes(texts).collect()), key=key) == sorted(brute_classes(spark, rows), key=key)


def test_classes_of_few_rows(spark):
    def classes(rows):
        return sorted(map(tuple, near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))

    assert classes([]) == []
    assert classes([(4, None)]) == [(4, 4, 1)]
    assert classes([(1, "x y"), (50, "other"), (900, "X  y")]) == [(1, 1, 2), (50, 50, 1), (900, 1, 2)]


def test_word_candidates_come_once_and_not_by_chance(spark):
    """Twelve texts share six rare words, the rest is of common ones as in forty others; the last two differ in one word."""
    rng = random.Random(2)
    common = [f"word{k}" for k in range(80)]
    texts = [[*(f"rare{k}" for k in range(6)), *rng.sample(common, 54)] for _ in range(12)] + [rng.sample(common, 54) for _ in range(40)]
    texts += [[f"own{k}" for k in range(60)], [f"own{k}" for k in range(1, 61)]]
    nodes = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "n long, m string")
    assert sorted(map(tuple, word_candidates(word_sets(nodes)).collect())) == [(52, 53)]


def test_only_sought_windows_are_kept(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(8)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "n long, m string")
    probes = with_windows(nodes, 2)
    kept = [(r.n, r.key) for r in with_windows(nodes, sought=key_bits(probes)).collect()]
    assert {(r.n, r.key) for r in probes.collect()} <= set(kept)
    assert len(kept) <= 20 < sum(len(window_keys(t)) for t in texts)


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_texts_and_words_are_not_left_behind(spark):
    """What the classes are made of goes before they are returned, here 3 MB of texts and as much of words."""
    rng = random.Random(5)
    top = staging.with_shared_folder(spark).removeprefix("file:")
    texts = spark.createDataFrame([(n, " ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(350))) for n in range(1000)], "doc_id long, text string")
    before = bytes_below(top)
    assert near_duplicate_classes(texts).select("class_size").distinct().collect() == [(1,)]
    assert bytes_below(top) - before < 1_000_000


def test_shuffles_of_settled_rows_go(spark):
    with staging.shuffles_go(spark):
        assert spark.conf.get(staging.SHUFFLES_GO) == "true"
    assert spark.conf.get(staging.SHUFFLES_GO) == "false"
    with pytest.raises(ValueError), staging.scratch(spark) as keep:
        kept = keep(spark.range(9).groupBy("id").count())
        assert kept.count() == 9
        raise ValueError
    assert not os.path.exists(os.path.dirname(kept.inputFiles()[0].removeprefix("file://")))


def test_texts_and_words_are_not_compared_for_each_pair_of_a_group(spark, monkeypatch):
    """Thirty texts that each lack one other word make 435 pairs, a part of the first one 30 more; 30 of them join the group."""
    compared = []
    for name in ("sharing", "holding"):
        monkeypatch.setattr(duplicates, name, lambda rows, pairs, f=getattr(duplicates, name): (compared.append(pairs.count()), f(rows, pairs))[1])
    words = [f"word{k}" for k in range(60)]
    rows = [(n, " ".join(w for k, w in enumerate(words) if k != n)) for n in range(30)] + [(99, " ".join(words[40:]))]
    found = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r[1:]) for r in found} == {(0, 31)} and sum(compared) < 70
