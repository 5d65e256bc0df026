"""Registered queries of answers: facts, citations, audits, prompts and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators import evaluation as e
from vellum.operators import grounding as g
from vellum.operators.lexical import lexical_query
from vellum.plans import corpus as c
from vellum.plans.queries_text import BLANK, FLAT, content_sql, cut_sql

#: Groups of alternatives, one of each of which an answer is to have.
EXPECTED = (("the", "der", "les", "los"), ("tion", "ung", "ment", "ción"), ("heit", "and", "que"))
RATES = ("questions", "provider_errors", "answered_rate", "abstention_accuracy", "fact_recall", "gold_citation_rate", "citation_precision", "uncited_answers", "p50", "p95")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))


def answer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(t.answer_text("body"), 256).alias("value"))


def fact_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(*[F.array(*map(F.lit, group)) for group in EXPECTED])
    folded = documents(spark, sf_dir).select("doc_id", t.answer_text("body").alias("folded"))
    return folded.select("doc_id", g.facts_complete(F.col("folded"), groups).alias("complete"))


def without_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("body", F.lit(" [S1, S2] and  [S"), F.col("doc_id").cast("string"), F.lit("].\n [ S3 ;S4 ] end"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(t.without_markers(marked), 256).alias("value"))


def lexical_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their first two words as a phrase, in quotes."""
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: w != "")
    asked = F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 2), " "), F.lit('" '), F.array_join(F.slice(words, 3, 8), " "))
    rows = c.table(spark, sf_dir, "benchmark").select("item_id", lexical_query(asked).alias("q"))
    return rows.select("item_id", "q.words", F.array_join("q.phrases", "|").alias("phrases"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer about each document, some of it wrong, and two sources; the second is missing for some."""
    i = F.col("doc_id").cast("string")
    wrong = (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("string")
    answer = F.concat(F.lit("Document "), i, F.lit(" comes from source "), F.col("source"), F.lit(" [S1]. It is called doc-"), wrong, F.lit(' and says "language '), F.col("lang"), F.lit('" [S1]. The number '), wrong, F.lit(" stands here [S"), (F.col("doc_id") % 4).cast("string"), F.lit("]! Zebras wander over distant hills [S2]. Nobody cites this sentence. [S1]"))
    first = F.concat(F.lit("Document doc-"), i, F.lit(" comes from source "), F.col("source"), F.lit(". It has the language "), F.coalesce(F.when(F.col("doc_id") % 5 > 0, F.col("lang")), F.lit("none")), F.lit(", and number "), i)
    second = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("Number "), i, F.lit(" stands here, as zebras do")))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), answer.alias("answer"), F.array(first, second).alias("sources"))


def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.audit(claims(spark, sf_dir)).select("query_id", "sentence", F.array_join(F.array_sort("flags"), ",").alias("flags"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.audit_summary(g.audit(claims(spark, sf_dir)))


def ground_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims as completions, checked against their sources."""
    rows = claims(spark, sf_dir)
    completion = F.to_json(F.struct(F.lit(True).alias("answerable"), "answer", F.array(F.lit("S1")).alias("citations")))
    shown = F.transform("sources", lambda s, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("label"), s.alias("text")))
    out = g.grounded(rows, completion, shown, output="g").select("query_id", "g.*")
    return out.withColumn("labels", F.array_join("labels", ","))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cited once; some chunks are gone, some versions too or no longer active."""
    i = F.col("doc_id")
    docs = documents(spark, sf_dir)
    cited = docs.select(i.alias("query_id"), F.lit("S1").alias("label"), i.alias("chunk_id"), (i * 10).alias("version_id"))
    chunks = docs.filter(i % 3 != 0).select(i.alias("chunk_id"))
    versions = docs.filter(i % 7 != 0).select((i * 10).alias("version_id"), (i % 5 != 0).alias("is_active"))
    return g.display(cited, chunks, versions).select("query_id", "label", "source_available", "superseded", "removed")


def citation_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = documents(spark, sf_dir)
    answers = docs.select(i.alias("query_id"), F.when(i % 2 == 0, F.array(F.lit("S2"), F.lit("S1"))).otherwise(F.array(F.lit("S1"))).alias("labels"))
    sources = docs.select(i.alias("query_id"), F.explode(F.array(F.lit("S1"), F.lit("S3"))).alias("label"), i.alias("chunk_id"), F.col("body").alias("text"))
    return g.cite(answers, sources).select("query_id", "position", "label", "chunk_id", "excerpt")


def insufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.when(F.col("doc_id") % 3 == 0, F.lit("ধানের দূরত্ব কত?")).otherwise(F.col("body"))
    message = g.insufficiency_message(question, F.col("doc_id") % 2 == 0)
    return documents(spark, sf_dir).select("doc_id", F.sha2(message, 256).alias("value"))


def prompt_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = t.escaped(F.col("body"))
    prompt = F.concat(F.lit("<sources>\n"), body, F.lit("\n</sources>\n<conversation_history>\nx\n</conversation_history>\n<question>\nQ "), F.col("doc_id").cast("string"), F.lit("\n</question>"))
    rows = documents(spark, sf_dir).select("doc_id", g.prompt_regions(prompt).alias("r"))
    return rows.select("doc_id", "r.question", F.sha2("r.sources", 256).alias("sources"), "r.history")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question result for each document."""
    i = F.col("doc_id")
    ids = F.array(i % 4, i % 3)
    return documents(spark, sf_dir).select(
        F.col("lang").alias("category"),
        F.when(i % 11 == 0, "provider").alias("error"),
        (i % 3 != 0).alias("answered"),
        (i % 5 == 0).alias("abstain_expected"),
        F.when(i % 13 == 0, F.array().cast("array<bigint>")).otherwise(ids).alias("cited"),
        F.array(i % 6).alias("relevant"),
        (i % 2 == 0).alias("fact_complete"),
        F.col("n_chars").cast("double").alias("latency_ms"),
    )


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.answer_summary(results(spark, sf_dir), "category").select(F.coalesce("group", F.lit("all")).alias("category"), *RATES)


def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("source").alias("category"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id")).alias("relevant"))
    return e.dataset_card(rows)


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("source").alias("kind"), F.col("lang").alias("category"), (F.col("n_chars") > 1000).alias("passed"))
    return e.check_summary(rows).select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("category", F.lit("all")).alias("category"), "checks", "passed")


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", t.token_estimate(F.col("body")).alias("tokens"))
    return e.token_statistics(rows, "lang")


def settings_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = docs.filter("doc_id % 3 != 0").select(F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("value"))
    after = docs.filter("doc_id % 4 != 0").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("lang")).alias("value"))
    return e.comparable(before, after)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows, which is what the operator is for."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("source").alias("category"), (F.col("n_chars") % 97 == 0).alias("flagged"))
    return e.stratified_sample(rows, 50)


QUERIES = {
    "answer_fold": answer_fold,
    "fact_complete": fact_complete,
    "without_markers": without_markers,
    "lexical_parse": lexical_parse,
    "audit_flags": audit_flags,
    "audit_summary": audit_summary,
    "ground_answer": ground_answer,
    "citation_display": citations,
    "citation_excerpts": citation_excerpts,
    "insufficiency_message": insufficiency,
    "prompt_regions": prompt_regions,
    "answer_metrics": answer_metrics,
    "dataset_card": dataset_card,
    "check_summary": check_summary,
    "token_statistics": token_statistics,
    "settings_differ": settings_differ,
    "stratified_sample": stratified_sample,
}

MARKERS = r"\[\s*S\d+(?:\s*[,;]\s*S\d+)*\s*\]"
DOCS = "docs AS (SELECT *, coalesce(text, '') AS body FROM documents)"


def fold_sql(text: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower(nfc_normalize({text})), 'ß', 'ss'), 'ς', 'σ'), '{BLANK}+', ' ', 'g'))"


def any_of(group: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(a, '{option}')" for option in group) + ")"


AUDIT_SQL = rf"""
    WITH wrong AS (SELECT *, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS w FROM documents),
    answers AS (
        SELECT doc_id, 'Document ' || doc_id || ' comes from source ' || source || ' [S1]. It is called doc-' || w || ' and says "language ' || lang || '" [S1]. The number ' || w || ' stands here [S' || (doc_id % 4) || ']! Zebras wander over distant hills [S2]. Nobody cites this sentence.~[S1]' AS answer,
               [{fold_sql("'Document doc-' || doc_id || ' comes from source ' || source || '. It has the language ' || CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'none' END || ', and number ' || doc_id")},
                {fold_sql("CASE WHEN doc_id % 7 > 0 THEN 'Number ' || doc_id || ' stands here, as zebras do' ELSE '' END")}] AS sources
        FROM wrong
    ),
    pieces AS (SELECT doc_id, sources, replace(unnest(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '~', ' ') AS sentence FROM answers),
    marked AS (SELECT *, list_transform(regexp_extract_all(sentence, '\[S(\d+)\]', 1), lambda x: x::INT) AS labels, trim(regexp_replace(sentence, '\[S\d+\]', '', 'g')) AS clean FROM pieces),
    placed AS (SELECT *, list_filter(labels, lambda n: n BETWEEN 1 AND 2) AS valid, {fold_sql('clean')} AS folded FROM marked WHERE clean <> ''),
    cited AS (SELECT *, array_to_string(list_transform(valid, lambda n: sources[n]), ' ') AS cited, {content_sql('folded')} AS words FROM placed),
    flagged AS (
        SELECT doc_id AS query_id, sentence, CASE WHEN len(labels) = 0 THEN ['no_citation'] ELSE list_filter([
            CASE WHEN len(valid) < len(labels) THEN 'label_not_supplied' END,
            CASE WHEN len(valid) = len(labels) AND trim(cited) = '' THEN 'cited_source_text_missing' END,
            CASE WHEN cited <> '' AND len(list_filter(regexp_extract_all(folded, '\d+(?:[.,]\d+)*'), lambda x: NOT list_contains(regexp_extract_all(cited, '\d+(?:[.,]\d+)*'), x))) > 0 THEN 'number_not_in_cited_source' END,
            CASE WHEN cited <> '' AND len(list_filter(regexp_extract_all(clean, '"([^"]{{3,200}})"', 1), lambda x: NOT contains(cited, {fold_sql('x')}))) > 0 THEN 'quotation_not_in_cited_source' END,
            CASE WHEN cited <> '' AND len(list_filter(regexp_extract_all(clean, '\b[A-Za-z][A-Za-z0-9]*-\d+\b'), lambda x: NOT contains(cited, {fold_sql('x')}))) > 0 THEN 'identifier_not_in_cited_source' END,
            CASE WHEN cited <> '' AND len(words) > 0 AND len(list_intersect(words, {content_sql('cited')})) / len(words) < 0.25 THEN 'low_word_overlap_with_cited_source' END
        ], lambda x: x IS NOT NULL) END AS flags FROM cited
    )"""

ORACLE_SQL = {
    "answer_fold": f"WITH {DOCS} SELECT doc_id, sha256({fold_sql('body')}) AS value FROM docs",
    "fact_complete": f"WITH {DOCS}, folded AS (SELECT doc_id, {fold_sql('body')} AS a FROM docs) SELECT doc_id, {' AND '.join(map(any_of, EXPECTED))} AS complete FROM folded",
    "without_markers": rf"""WITH {DOCS}, marked AS (SELECT doc_id, body || ' [S1, S2] and  [S' || doc_id || '].' || chr(10) || ' [ S3 ;S4 ] end' AS m FROM docs)
        SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(m, '\s*{MARKERS}', '', 'g'), '\s+', ' ', 'g'))) AS value FROM marked""",
    "lexical_parse": r"""
        WITH cut AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> '') AS w FROM benchmark)
        SELECT item_id, trim(array_to_string(w[3:10], ' ')) AS words, trim(array_to_string(w[1:2], ' ')) AS phrases FROM cut""",
    "audit_flags": f"{AUDIT_SQL} SELECT query_id, sentence, array_to_string(list_sort(flags), ',') AS flags FROM flagged",
    "audit_summary": f"""{AUDIT_SQL}, each_flag AS (SELECT query_id, unnest(list_prepend('', flags)) AS flag FROM flagged)
        SELECT flag, count(*) AS sentences, count(DISTINCT query_id) AS questions FROM each_flag GROUP BY flag""",
    "citation_display": """
        WITH versions AS (SELECT doc_id, doc_id % 5 <> 0 AS is_active FROM documents WHERE doc_id % 7 <> 0)
        SELECT d.doc_id AS query_id, 'S1' AS label, d.doc_id % 3 <> 0 AS source_available, coalesce(NOT v.is_active, false) AS superseded, v.is_active IS NULL AS removed
        FROM documents d LEFT JOIN versions v USING (doc_id)""",
    "citation_excerpts": f"""WITH {DOCS}, named AS (SELECT doc_id, body AS text FROM docs)
        SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS position, 'S1' AS label, doc_id AS chunk_id, {cut_sql(FLAT, 300, 151)} AS excerpt FROM named""",
    "insufficiency_message": """
        SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'অনুসন্ধানের একটি অংশ সাময়িকভাবে অনুপলব্ধ ছিল, তাই উত্তর দেওয়া যায়নি।'
            WHEN doc_id % 2 = 0 THEN 'Part of the search was unavailable, so the question could not be answered.'
            WHEN doc_id % 3 = 0 THEN 'প্রদত্ত নথিগুলোতে এই প্রশ্নের উত্তর দেওয়ার মতো যথেষ্ট তথ্য পাওয়া যায়নি।'
            ELSE 'The provided documents do not contain enough information to answer this question.' END) AS value FROM documents""",
    "prompt_regions": rf"""WITH {DOCS},
        escaped AS (SELECT doc_id, replace(replace(replace(regexp_replace(body, '\[\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*\]', '(\1)', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS s FROM docs)
        SELECT doc_id, 'Q ' || doc_id AS question, sha256(regexp_extract('<sources>' || chr(10) || s || chr(10) || '</sources>', '(?s)<sources>\n?(.*?)\n?</sources>', 1)) AS sources, 'x' AS history FROM escaped""",
    "answer_metrics": """
        WITH results AS (
            SELECT lang, doc_id % 11 = 0 AS failed, doc_id % 3 <> 0 AS answered, doc_id % 5 <> 0 AS expected, CASE WHEN doc_id % 13 = 0 THEN []::BIGINT[] ELSE [doc_id % 4, doc_id % 3] END AS cited,
                   doc_id % 6 AS relevant, doc_id % 2 = 0 AS fact, n_chars::DOUBLE AS ms FROM documents
        ),
        grouped AS (SELECT 'all' AS category, * FROM results UNION ALL SELECT lang, * FROM results WHERE lang IS NOT NULL),
        judged AS (SELECT *, NOT failed AND expected AS asked, list_contains(cited, relevant)::INT AS gold, len(list_distinct(cited)) AS n_cited FROM grouped)
        SELECT category, count(*) AS questions, count(*) FILTER (WHERE failed) AS provider_errors,
               round(count(*) FILTER (WHERE asked AND answered) / nullif(count(*) FILTER (WHERE asked), 0), 3) AS answered_rate,
               round(count(*) FILTER (WHERE NOT failed AND NOT expected AND NOT answered) / nullif(count(*) FILTER (WHERE NOT failed AND NOT expected), 0), 3) AS abstention_accuracy,
               round(count(*) FILTER (WHERE asked AND fact) / nullif(count(*) FILTER (WHERE asked), 0), 3) AS fact_recall,
               round(count(*) FILTER (WHERE asked AND answered AND gold > 0) / nullif(count(*) FILTER (WHERE asked AND answered), 0), 3) AS gold_citation_rate,
               round(sum(gold) FILTER (WHERE asked AND answered) / nullif(sum(n_cited) FILTER (WHERE asked AND answered), 0), 3) AS citation_precision,
               count(*) FILTER (WHERE NOT failed AND answered AND len(cited) = 0) AS uncited_answers,
               round(median(ms) FILTER (WHERE NOT failed), 1) AS p50,
               round(list_sort(list(ms) FILTER (WHERE NOT failed))[least(floor(count(*) FILTER (WHERE NOT failed) * 0.95)::INT, count(*) FILTER (WHERE NOT failed) - 1) + 1], 1) AS p95
        FROM judged GROUP BY category""",
    "dataset_card": "SELECT source AS category, lang AS language, count(*) AS queries, count(*) FILTER (WHERE doc_id % 4 = 0) AS unanswerable FROM documents GROUP BY ALL",
    "check_summary": """SELECT coalesce(source, 'all') AS kind, coalesce(lang, 'all') AS category, count(*) AS checks, count(*) FILTER (WHERE n_chars > 1000) AS passed FROM documents GROUP BY ROLLUP (source, lang)""",
    "token_statistics": r"""
        WITH other AS (SELECT lang, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[\x00-\x7F]', '', 'g')) AS o FROM documents),
        tokens AS (SELECT lang, ceil(o + (n - o) / 3.0)::BIGINT AS t FROM other)
        SELECT lang, max(t) AS max_tokens, round(avg(t), 2) AS mean_tokens, count(*) FILTER (WHERE t > 512) AS truncated FROM tokens GROUP BY lang""",
    "settings_differ": """
        WITH b AS (SELECT doc_id::VARCHAR AS name, lang AS before FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS after FROM documents WHERE doc_id % 4 <> 0)
        SELECT name, before, after FROM b FULL JOIN a USING (name) WHERE before IS DISTINCT FROM after""",
    "stratified_sample": """
        WITH drawn AS (SELECT doc_id AS query_id, source AS category, n_chars % 97 = 0 AS flagged, sha256('20261016|' || doc_id) AS draw FROM documents),
        first AS (SELECT *, 0 AS part, 0 AS turn FROM drawn WHERE flagged ORDER BY draw LIMIT 25),
        rest AS (SELECT *, 1 AS part, row_number() OVER (PARTITION BY category ORDER BY draw) AS turn FROM drawn WHERE query_id NOT IN (SELECT query_id FROM first))
        SELECT query_id, category, flagged FROM (SELECT * FROM first UNION ALL SELECT * FROM rest) ORDER BY part, turn, category, draw LIMIT 50""",
}
