"""Registered queries of text functions, spans, chunks and the answer plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.operators.chunking import chunk_quality, chunk_texts
from vellum.operators.context import pack_context
from vellum.operators.duplicates import near_duplicate_classes, near_duplicate_pairs
from vellum.operators.grounding import extract_answers, label_sets
from vellum.operators.segmentation import line_spans, sentence_spans, word_spans
from vellum.plans import corpus as c
from vellum.plans.queries_retrieval import lexical_sql, pool
from vellum.plans.rag import rag_answers


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "documents")


def of_text(column):
    """A query that gives one column for each document."""
    return lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", column(F.col("text")).alias("value"))


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.script_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(t.content_tokens(F.col("text"))), " ").alias("words"))


def near_duplicate_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T23 applied to given pairs, here each document and the next; ``near_duplicate_groups`` finds all pairs of the table."""
    docs = documents(spark, sf_dir)
    return near_duplicate_pairs(docs, docs.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id")))


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document under all near-duplicate pairs of the table."""
    return near_duplicate_classes(documents(spark, sf_dir))


def reader_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).filter(F.col("retrieval_rank") <= 3).select("query_id", F.concat(F.lit("S"), F.col("retrieval_rank")).alias("label"), F.col("retrieval_rank").alias("position"), "text")


def extractive_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_answers(c.benchmark_queries(spark, sf_dir), reader_sources(spark, sf_dir))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("query_id", "chunk_id", "text", F.col("retrieval_rank").alias("rank"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_context(ranked(spark, sf_dir))


def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag_answers(c.benchmark_queries(spark, sf_dir), ranked(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_texts(documents(spark, sf_dir)).drop("heading_path")


def quality_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return chunk_quality(chunk_texts(docs), docs)


def label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers written behind each text, one of them not supplied."""
    cited = F.concat(F.col("text"), F.lit(" [S1, S2] and [S"), (F.col("doc_id") % 7).cast("string"), F.lit("]."))
    sets = documents(spark, sf_dir).select("doc_id", label_sets(cited, F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))).alias("l"))
    return sets.select("doc_id", F.array_join("l.valid", ",").alias("valid"), "l.unknown")


QUERIES = {
    "script_profile": script_profile,
    "token_estimate": of_text(t.token_estimate),
    "bengali_share": of_text(t.bengali_share),
    "excerpt": of_text(t.excerpt),
    "default_title": of_text(t.default_title),
    "sha_fingerprint": of_text(lambda x: F.sha2(x, 256)),
    "normalize_text": of_text(t.normalize_text),
    "neutralise_escape": of_text(t.escaped),
    "tokens": of_text(lambda x: F.size(t.tokens(x))),
    "content_tokens": content_words,
    "line_spans": lambda spark, sf_dir: line_spans(documents(spark, sf_dir)),
    "sentence_spans": lambda spark, sf_dir: sentence_spans(documents(spark, sf_dir)),
    "word_spans": lambda spark, sf_dir: word_spans(documents(spark, sf_dir)),
    "near_duplicate_test": near_duplicate_test,
    "near_duplicate_groups": near_duplicate_groups,
    "extractive_reader": extractive_reader,
    "context_pack": context_pack,
    "rag_answer": rag_answer,
    "chunks": chunks,
    "chunk_quality": quality_of_chunks,
    "label_extract": label_extract,
}

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def cut_sql(flat: str, limit: int, least: int) -> str:
    head, back = f"left({flat}, {limit})", f"instr(reverse(left({flat}, {limit})), ' ')"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(CASE WHEN {back} > 0 AND {limit} - {back} >= {least} THEN left({head}, {limit} - {back}) ELSE {head} END) || '…' END"


#: White space of any script.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def spans_sql(pattern: str, replacement: str) -> str:
    return rf"""
        WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', {replacement}, 'g'), chr(1)) AS p FROM documents),
        pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM cut),
        placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   + length(piece) - length(regexp_replace(piece, '^{BLANK}+', '')) AS start, length(regexp_replace(piece, '^{BLANK}+|{BLANK}+$', '', 'g')) AS size FROM pieces)
        SELECT doc_id, start::BIGINT AS start, (start + size)::BIGINT AS "end" FROM placed WHERE size > 0"""


OUTER = r"""[.,;:!?()\[\]"''।]+"""


def content_sql(text: str) -> str:
    words = rf"string_split(trim(regexp_replace({text}, '\s+', ' ', 'g')), ' ')"
    bare = rf"list_transform({words}, lambda w: replace(replace(lower(regexp_replace(w, '^{OUTER}|{OUTER}$', '', 'g')), 'ς', 'σ'), 'ß', 'ss'))"
    return rf"list_distinct(list_filter({bare}, lambda w: length(w) >= CASE WHEN regexp_matches(w, '[^\x00-\x7F]') THEN 3 ELSE 4 END))"


def value_sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS value FROM documents"


LATIN_SQL, BENGALI_SQL = "A-Za-zÀ-ɏḀ-ỿ", "ঀ-৿"
NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "script_profile": rf"""
        WITH counts AS (
            SELECT doc_id, length(regexp_replace(text, '[^{BENGALI_SQL}]', '', 'g')) AS b, length(regexp_replace(text, '[^{LATIN_SQL}]', '', 'g')) AS l,
                   length(regexp_replace(regexp_replace(text, '[{LATIN_SQL}{BENGALI_SQL}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS o FROM documents
        ), shares AS (SELECT doc_id, b + l + o AS n, CASE WHEN n < 20 THEN 0.0 ELSE b / n END AS b, CASE WHEN n < 20 THEN 0.0 ELSE l / n END AS l, CASE WHEN n < 20 THEN 0.0 ELSE o / n END AS o FROM counts)
        SELECT doc_id, round(b, 3) AS bengali, round(l, 3) AS latin, round(o, 3) AS other,
               CASE WHEN n < 20 THEN 'unknown' WHEN b >= 0.9 THEN 'bengali' WHEN l >= 0.9 THEN 'latin' WHEN o >= 0.9 THEN 'other' ELSE 'mixed' END AS primary_script FROM shares""",
    "token_estimate": value_sql(r"ceil(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + (length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / 3.0)::BIGINT"),
    "bengali_share": value_sql(rf"coalesce(length(regexp_replace(text, '[^{BENGALI_SQL}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0), 0.0)::DOUBLE"),
    "excerpt": value_sql(cut_sql(FLAT, 300, 151)),
    "default_title": value_sql(cut_sql(FLAT, 60, 30)),
    "sha_fingerprint": value_sql("sha256(text)"),
    "normalize_text": value_sql(
        r"trim(regexp_replace(array_to_string(list_transform(string_split(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))"
    ),
    "neutralise_escape": value_sql(r"replace(replace(replace(regexp_replace(text, '\[\s*(S\d+(?:\s*[,;]\s*S\d+)*)\s*\]', '(\1)', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    "tokens": value_sql(f"len({c.TOKENS_SQL.format('text')})::INT"),
    "content_tokens": f"SELECT doc_id, array_to_string(list_sort({content_sql('text')}), ' ') AS words FROM documents",
    "line_spans": spans_sql("(\\n)", "'\\1' || chr(1)"),
    "sentence_spans": spans_sql(rf"""([.!?।॥…]+["'')\]”’»]*)({BLANK})""", r"'\1' || chr(1) || '\2'"),
    "word_spans": spans_sql(rf"({BLANK}+)", r"'\1' || chr(1)"),
    "near_duplicate_test": rf"""
        WITH m AS (SELECT doc_id, {NORMAL} AS m, list_distinct({c.TOKENS_SQL.format(NORMAL)}) AS w FROM documents)
        SELECT a.doc_id AS left_id, b.doc_id AS right_id,
               a.m = b.m OR (length(a.m) >= 40 AND contains(b.m, a.m)) OR (length(b.m) >= 40 AND contains(a.m, b.m))
               OR coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) >= 0.9, false) AS duplicate
        FROM m a JOIN m b ON b.doc_id = a.doc_id + 1""",
    "extractive_reader": rf"""WITH {lexical_sql('passages', 20)},
        sources AS (SELECT query_id, rank, p.text, b.text AS query FROM lexical JOIN passages p USING (chunk_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 3),
        cut AS (SELECT query_id, rank, query, string_split(regexp_replace(trim(text), '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM sources),
        pieces AS (SELECT query_id, rank, query, unnest(p) AS sentence, generate_subscripts(p, 1) AS place FROM cut),
        matched AS (SELECT query_id, rank, place, sentence, len(list_intersect({content_sql('query')}, {content_sql('sentence')})) AS score FROM pieces),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, place) AS r FROM matched WHERE score > 0) WHERE r = 1)
        SELECT item_id AS query_id, 'S' || rank AS label, trim(sentence) AS sentence, coalesce(score, 0)::INT AS score FROM benchmark LEFT JOIN best ON query_id = item_id""",
    "label_extract": r"""
        WITH marks AS (SELECT doc_id, list_transform(regexp_extract_all(text || ' [S1, S2] and [S' || (doc_id % 7) || '].', '\[\s*S\d+(?:\s*[,;]\s*S\d+)*\s*\]'), lambda m: regexp_extract_all(m, 'S\d+')) AS m FROM documents),
        written AS (SELECT doc_id, flatten(m) AS w FROM marks)
        SELECT doc_id, array_to_string(list_filter(['S1', 'S2', 'S3'], lambda x: list_contains(w, x)), ',') AS valid, len(list_filter(w, lambda x: NOT list_contains(['S1', 'S2', 'S3'], x)))::INT AS unknown FROM written""",
}
