"""Re-chunking by difference gives the rows of a full run, cuts only new leaves, and embeds each text once."""

import random

import numpy as np
import pytest

from vellum.operators import chunking
from vellum.operators import dense
from vellum.operators.chunking import Limits, chunk_results, chunk_sections, gathered_sections
from vellum.operators.rechunk import leaf_changes, rechunk, with_outputs

LIMITS = Limits(most=80, overlap=20, least=8)
SCHEMA = "document_id string, ordinal int, text string, heading string, heading_level int, page_number int, paragraph_mode string, markdown boolean"


def prose(rng, words):
    return " ".join(rng.choice(["alpha", "beta", "gamma.", "delta", "epsilon!", "\n\nzeta"]) for _ in range(words))


def versions(spark):
    rng = random.Random(11)
    old = {f"d/{d}": [(prose(rng, rng.randint(1, 60)), rng.choice([None, "H"]), 1 + i % 3, i, rng.choice([None, "line"]), rng.choice([None, True])) for i in range(rng.randint(1, 6))] for d in range(12)}
    old["void"] = [("", None, 0, 1, None, None), ("...", None, 0, 1, None, None), (None, "Only a heading", 1, 1, None, None)]
    new = {k: list(v) for k, v in old.items()}
    new["d/1"][0] = (prose(rng, 40), *new["d/1"][0][1:])
    new["d/2"] = [(prose(rng, 30), "First", 1, 0, None, None), *new["d/2"]]
    new["d/3"] = list(reversed(new["d/3"])) + new["d/3"]
    new["d/4"][0] = (new["d/4"][0][0], "Another heading", 2, *new["d/4"][0][3:])
    new["d/5"][0] = (*new["d/5"][0][:4], "line" if new["d/5"][0][4] is None else None, new["d/5"][0][5])
    del new["d/6"]
    new["added"] = [(prose(rng, 50), None, 1, 1, None, None)]
    new["void"] = [("now there are words in here", None, 0, 1, None, None), ("...", None, 0, 1, None, None)]
    rows = lambda v: spark.createDataFrame([(d, i, s[0], s[1], s[2] if s[1] else None, *s[3:]) for d, own in v.items() for i, s in enumerate(own)], SCHEMA)
    return rows(old), rows(new)


def plain(df):
    return sorted((tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limits", [LIMITS, Limits(most=80, overlap=20, least=8, chunks=9)])
def test_equals_a_full_run(spark, limits):
    old, new = versions(spark)
    before = chunk_results(gathered_sections(old), limits)
    got = rechunk(old, before, new, limits)
    assert plain(got) == plain(chunk_results(gathered_sections(new), limits))


def test_only_new_leaves_are_cut(spark):
    old, new = versions(spark)
    counts = {r.document_id: (r.sections, r.reused, r.changed) for r in leaf_changes(old, new).collect()}
    assert counts["d/1"][2] == 1 and counts["d/2"][2] == 1 and counts["d/3"][2] == 0 and counts["d/4"][2] == 0 and counts["d/5"][2] == 1
    assert counts["added"][1] == 0 and "d/6" not in counts
    # Known sections carry their places: a splitter that gives others leaves them alone.
    chunks = chunk_sections(old, LIMITS)
    cut = spark.sparkContext.accumulator(0)
    real = chunking.section_spans

    def counted(*a, **k):
        cut.add(1)
        return real(*a, **k)

    chunking.section_spans = counted
    try:
        rows = [r.asDict(recursive=True) for r in gathered_sections(old.filter("document_id = 'd/3'")).collect()]
        list(chunking.document_chunks(rows[0]["sections"], LIMITS))
        with_text = sum(bool((s["text"] or "").strip()) for s in rows[0]["sections"])
        assert cut.value == with_text
        for s in rows[0]["sections"]:
            s["spans"] = [{"start": a, "end": b, "shared": c} for a, b, c in real(s["text"], s["paragraph_mode"] or "blank_line", bool(s["markdown"]), LIMITS)]
        list(chunking.document_chunks(rows[0]["sections"], LIMITS))
        assert cut.value == with_text
    finally:
        chunking.section_spans = real
    assert chunks.count() > 0


def test_nothing_before_and_nothing_after(spark):
    old, new = versions(spark)
    none = chunk_results(gathered_sections(old.limit(0)), LIMITS)
    assert plain(rechunk(old.limit(0), none, new, LIMITS)) == plain(chunk_results(gathered_sections(new), LIMITS))
    assert rechunk(old, chunk_results(gathered_sections(old), LIMITS), new.limit(0), LIMITS).count() == 0


def test_each_text_meets_the_model_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def factory(dimension):
        def encode(texts):
            seen.add(len(texts))
            return np.array([[float(len(t)), 1.0] for t in texts]).reshape(-1, 2)

        return encode

    dense.register_embedder("counting", factory)
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, ""), (6, "bb"), (7, "ccc")], "chunk_id long, text string").repartition(5)
    cache = spark.createDataFrame([], "text_sha256 string, config_id string, embedding array<float>")
    first, made = with_outputs(rows, cache, "now", dimension=2, model="counting", prefix="")
    got = {r.chunk_id: r.embedding[0] for r in first.collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0, 6: 2, 7: 3}
    assert first.count() == 7 and made.count() == 4 and seen.value == 4
    more = rows.unionByName(spark.createDataFrame([(8, "dddd")], rows.schema))
    second, new = with_outputs(more, made, "now", dimension=2, model="counting", prefix="")
    assert second.count() == 8 and [r.embedding[0] for r in new.collect()] == [4] and seen.value == 5
    other, again = with_outputs(rows, made, "then", dimension=2, model="counting", prefix="")
    assert again.count() == 4 and other.count() == 7


def test_rechunked_query_equals_a_full_run(spark):
    from vellum.plans.queries_versions import LIMITS as OWN
    from vellum.plans.queries_versions import rechunked, revised

    sf = "/root/testdata/sf0.001"
    full = chunk_results(gathered_sections(revised(spark, sf)), OWN).drop("heading_path")
    got = rechunked(spark, sf)
    assert plain(got) == plain(full) and got.count() > 200
