"""Rows that no stage may lose: rare languages, clashing columns, tables without labels."""

import random

import corpus_pipeline as p
from vellum.llm import quality
from vellum.llm.quality import quality_rules

KIND = "doc_id long, text string, lang string"


def invented(lang, seed, n=80):
    """Words of a language of its own: a few common ones, the others rare."""
    own = random.Random(lang)
    common = ["".join(own.choices("abcdefghijklmnop" if lang < "g" else "klmnopqrstuvwxyz", k=own.randint(2, 5))) for _ in range(12)]
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choices("etaoinshrdlu", k=7)) for _ in range(n))


def test_a_rare_language_keeps_its_documents_in_a_large_table(spark):
    """Thirty documents of one language among thirty thousand of another."""
    rows = [(k, invented("en", k % 500), "en") for k in range(30_000)] + [(100_000 + k, invented("zz", k), "zz") for k in range(30)]
    out = quality_rules(spark.createDataFrame(rows, KIND).repartition(4))
    kept = {r.doc_id: r.kept for r in out.filter("doc_id >= 100000 or doc_id < 50").collect()}
    assert len(kept) == 80 and all(kept.values())


def test_beyond_the_most_languages_labels_without_a_reference_pass(spark, monkeypatch):
    rows = [(k, invented("en", k), "en") for k in range(60)] + [(1000 + k, invented("zz", k), "zz") for k in range(30)] + [(2000, invented("zy", 1), "zy"), (2001, invented("zy", 2), None)]
    docs = spark.createDataFrame(rows, KIND)
    few = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert not few[2000] and not few[2001] and all(few[i] for i in few if i < 2000)  # one row makes no reference
    monkeypatch.setattr(quality, "MOST_LANGS", 1)
    assert all(r.kept for r in quality_rules(docs).collect() if r.doc_id != 2001)


def test_summaries_stay_bounded_over_all_languages(spark, monkeypatch):
    """A small bound on a task's entries changes no result."""
    docs = spark.createDataFrame([(k, invented(f"l{k % 9}", k), f"l{k % 9}") for k in range(400)], KIND).coalesce(1)
    expected = sorted(map(tuple, quality_rules(docs).collect()))
    monkeypatch.setattr(quality, "MOST_ENTRIES", 2000)
    assert sorted(map(tuple, quality_rules(docs).collect())) == expected


def corpus(spark, extra="_row int, _ROW_ string, kept boolean, component_id array<int>, id map<string,int>, row struct<a:int>"):
    texts = [f"the quick brown fox number {k} jumps over the lazy dog and goes home to sleep {k}" for k in range(40)] + ["the same text once more as it stands here"] * 3
    rows = [(k, t, None, "s", len(t), 7, "x", True, [k], {"a": k}, (k,)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def test_columns_of_any_name_and_type_stay(spark):
    docs = corpus(spark)
    exact = p.drop_exact_copies(spark, docs, "")
    assert exact.schema == docs.schema and exact.count() == 41
    near = p.drop_near_copies(spark, exact, "")
    assert near.schema == docs.schema
    assert {(r["_row"], r["_ROW_"], r["id"]["a"] == r.doc_id, r["row"]["a"] == r.doc_id) for r in near.collect()} == {(7, "x", True, True)}
    upper = docs.withColumnRenamed("_row", "_ROW")
    assert p.drop_near_copies(spark, p.drop_exact_copies(spark, upper, ""), "").columns == upper.columns


def test_without_labels_all_rows_stay(spark):
    docs = corpus(spark)
    assert p.identify_language(spark, docs, "").count() == docs.count()
    assert p.identify_language(spark, docs.limit(0), "").count() == 0
