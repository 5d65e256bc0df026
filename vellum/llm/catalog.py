"""Queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.bpe import bpe_digests
from vellum.llm.byte_windows import suffix_dedup
from vellum.llm.clustering import cluster_vectors
from vellum.llm.cost_packing import pack_by_cost
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.language import language_id
from vellum.llm.packing import pack_documents
from vellum.llm.quality import LANG_ROWS, MOST_LANGS, WORD_SHARE, quality_rules
from vellum.llm.secrets import secret_scan
from vellum.llm.simhash import near_duplicates
from vellum.llm.token_counts import token_counts
from vellum.llm.vector_codes import compress_vectors
from vellum.llm.vector_sql import cluster_sql, code_sql
from vellum.llm.word_windows import substring_dedup
from vellum.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read_table(spark, f"{sf_dir}/documents.parquet"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, f"{sf_dir}/embeddings.parquet")).drop("n_distances")


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, f"{sf_dir}/embeddings.parquet"))


def native_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": over_documents(suffix_dedup),
    "op2_quality_rules": over_documents(quality_rules),
    "op3_secret_scan": over_documents(secret_scan),
    "op4_substring_dedup": over_documents(substring_dedup),
    "op5_token_counts": over_documents(token_counts),
    "op6_bpe": over_documents(bpe_digests),
    "op7_packing": over_documents(pack_documents),
    "op8_exact_dedup": native_exact_dedup,
    "op9_language_id": over_documents(language_id),
    "op10_simhash": over_documents(near_duplicates),
    "op11_cost_packing": over_documents(pack_by_cost),
    "op12_centroid_clustering": clusters,
    "op13_vector_codes": vector_codes,
}

# Character classes as in the operator.
CLASS_SQL = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?''\"()\-]", r"[#$%&*+/<=>@\[\\\]^_`{|}~]", r"[\x00-\x08\x0E-\x1F\x7F]", r"[^\x00-\x7F]"]
CLASS_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{pattern}+', '', 'g'))" for pattern in CLASS_SQL)


def distance_sql(doc: str, reference: str) -> str:
    """Jensen-Shannon distance of two grouped columns of counts."""
    p, q = f"({doc} / doc_sum)", f"({reference} / ref_sum)"
    m = f"(({p} + {q}) / 2)"
    terms = f"sum(CASE WHEN {doc} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {reference} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)"
    return f"CASE WHEN any_value(doc_sum) > 0 THEN sqrt(greatest(0, {terms} / 2)) ELSE 1.0 END"


QUALITY_SQL = rf"""
    WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    split AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM split),
    windows AS (SELECT doc_id, pos, CASE WHEN pos + 4 <= n THEN list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END AS win FROM words),
    counted AS (SELECT doc_id, pos, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN pos END AS start FROM windows),
    marked AS (SELECT doc_id, coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY pos) >= pos - 4, false) AS again FROM counted),
    repeats AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n FROM marked GROUP BY doc_id),
    base AS (
        SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM split s LEFT JOIN repeats r USING (doc_id)
    ),
    checked AS (SELECT b.*, s.lang, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base b JOIN split s USING (doc_id)),
    enough AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LANG_ROWS}),
    languages AS (SELECT lang FROM enough ORDER BY n DESC, lang LIMIT {MOST_LANGS}),
    learned AS (SELECT doc_id, lang AS ref FROM checked WHERE NOT base_failed AND lang IN (SELECT lang FROM languages)),
    chars AS (SELECT doc_id, unnest([{CLASS_COUNTS}])::DOUBLE AS c, unnest(range(8)) AS k FROM docs),
    char_refs AS (SELECT ref, k, sum(c) AS r, sum(sum(c)) OVER (PARTITION BY ref) AS ref_sum FROM chars JOIN learned USING (doc_id) GROUP BY ref, k),
    char_rows AS (SELECT doc_id, ref, c, r, ref_sum, sum(c) OVER (PARTITION BY doc_id, ref) AS doc_sum FROM chars JOIN char_refs USING (k)),
    by_char AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, ref, {distance_sql('c', 'r')} AS d FROM char_rows GROUP BY doc_id, ref) GROUP BY doc_id),
    lowered AS (SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS c FROM words GROUP BY ALL),
    totals AS (SELECT ref, sum(n_words)::DOUBLE AS ref_sum FROM learned JOIN base USING (doc_id) GROUP BY ref),
    vocabulary AS (
        SELECT ref, word, sum(c)::DOUBLE AS r, any_value(ref_sum) AS ref_sum FROM lowered JOIN learned USING (doc_id) JOIN totals USING (ref)
        WHERE regexp_matches(word, '[a-z]|[^\x00-\x7F]') GROUP BY ref, word HAVING sum(c) * {WORD_SHARE} >= any_value(ref_sum)
    ),
    word_refs AS (SELECT * FROM vocabulary UNION ALL SELECT ref, '' AS word, any_value(ref_sum) - sum(r) AS r, any_value(ref_sum) AS ref_sum FROM vocabulary GROUP BY ref),
    without AS (SELECT ref, {distance_sql('c', 'r')} AS most FROM (SELECT ref, r, ref_sum, CASE WHEN word = '' THEN 1.0 ELSE 0.0 END AS c, 1.0 AS doc_sum FROM word_refs) GROUP BY ref),
    known AS (SELECT b.doc_id, b.n_words, v.ref, v.word, v.r, v.ref_sum, coalesce(l.c, 0)::DOUBLE AS c FROM base b CROSS JOIN vocabulary v LEFT JOIN lowered l ON l.doc_id = b.doc_id AND l.word = v.word),
    others AS (SELECT k.doc_id, k.ref, any_value(k.ref_sum) - sum(k.r) AS r, any_value(k.ref_sum) AS ref_sum, any_value(k.n_words) - sum(k.c) AS c, any_value(k.n_words)::DOUBLE AS doc_sum FROM known k GROUP BY k.doc_id, k.ref),
    word_rows AS (SELECT doc_id, ref, c, r, ref_sum, n_words::DOUBLE AS doc_sum FROM known UNION ALL SELECT doc_id, ref, c, r, ref_sum, doc_sum FROM others),
    by_word AS (SELECT doc_id, min(d / most) AS d FROM (SELECT doc_id, ref, {distance_sql('c', 'r')} AS d FROM word_rows GROUP BY doc_id, ref) JOIN without USING (ref) WHERE most > 0 GROUP BY doc_id),
    judged AS (SELECT b.*, coalesce(c.d, 0) AS cd, coalesce(w.d, 0) AS wd FROM checked b LEFT JOIN by_char c USING (doc_id) LEFT JOIN by_word w USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND (((SELECT count(*) FROM enough) > {MOST_LANGS} AND lang NOT IN (SELECT ref FROM learned)) IS TRUE OR (NOT (word_chars >= 200 AND cd > 0.30) AND NOT (n_words >= 60 AND wd > 0.85))) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM judged
"""

ORACLE_SQL: dict[str, str] = {
    "op12_centroid_clustering": cluster_sql(),
    "op13_vector_codes": code_sql(),
    "op2_quality_rules": QUALITY_SQL,
    "op4_substring_dedup": r"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM split),
        windows AS (
            SELECT doc_id, pos, word, n, CASE WHEN pos + 34 <= n THEN list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM words
        ),
        counted AS (SELECT doc_id, pos, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN pos END AS start FROM windows),
        marked AS (SELECT doc_id, pos, word, coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY pos) >= pos - 34, false) AS gone FROM counted),
        done AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
        SELECT s.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split s LEFT JOIN done USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM rows WINDOW w AS (PARTITION BY norm)
    """,
}
