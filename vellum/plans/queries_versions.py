"""Registered queries of re-chunking by difference and of intervals that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.statistics import DRAWS, POISSON, RESAMPLES
from vellum.operators import evaluation as e
from vellum.operators.chunking import Limits, chunk_results, gathered_sections
from vellum.operators.rechunk import leaf_changes, rechunk, with_outputs
from vellum.plans import corpus as c
from vellum.plans.queries_evaluation import ARMS, scores

LIMITS = Limits()
#: Dimension of the vectors of these queries.
DIMENSION = 64


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank line of a document as a section."""
    return c.passages(spark, sf_dir).select("document_id", (F.col("chunk_id") % c.LINES - 1).cast("int").alias("ordinal"), "text")


def revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later version of every document, in which numbers are masked."""
    return sections(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[0-9]+", "#"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf_changes(sections(spark, sf_dir), revised(spark, sf_dir))


def rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the later version, from those of the earlier one."""
    before = sections(spark, sf_dir)
    return rechunk(before, chunk_results(gathered_sections(before), LIMITS), revised(spark, sf_dir), LIMITS).drop("heading_path")


def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, how many sections of the later version have a vector of the earlier one, and how many a new one."""
    cache = spark.createDataFrame([], "text_sha256 string, config_id string, embedding array<float>")
    _, known = with_outputs(sections(spark, sf_dir), cache, "c", dimension=DIMENSION)
    rows, made = with_outputs(revised(spark, sf_dir), known, "c", dimension=DIMENSION)
    new = made.select("text_sha256", F.lit(True).alias("new"))
    out = rows.join(new, "text_sha256", "left").groupBy("document_id")
    return out.agg(F.count_if(F.col("new").isNull()).alias("moved"), F.count("new").alias("embedded"), F.count_if(F.size("embedding") == DIMENSION).alias("vectors"))


def bootstrap_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 of the labelled quality of each source, over all labelled documents."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "source")
    return e.merged_intervals(c.table(spark, sf_dir, "labels").join(docs, "doc_id"), ["source"], "doc_id", "quality")


def paired_bootstrap_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.merged_delta(scores(spark, sf_dir), "dense", "hybrid", "mrr_at_10")


QUERIES = {
    "leaf_changes": changes,
    "rechunked": rechunked,
    "vector_reuse": vector_reuse,
    "bootstrap_merged": bootstrap_merged,
    "paired_bootstrap_merged": paired_bootstrap_merged,
}

VERSIONS = rf"WITH {c.LINES_SQL}, revised AS (SELECT document_id, regexp_replace(text, '[0-9]+', '#', 'g') AS text FROM passages)"
WEIGHT = "CASE " + " ".join(f"WHEN u < {end} THEN {k}" for k, end in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"


def intervals_sql(values: str, by: str, mean: str = "mean") -> str:
    """Tables and result of ``merged_intervals`` over ``values``, a table of ``by, key, x``."""
    low, high = (f"CASE WHEN n >= 10 THEN round(m[greatest(1, ceil(len(m) * {share}))::INT], 4) END" for share in (0.025, 0.975))
    return f"""known AS (SELECT * FROM {values} WHERE x IS NOT NULL),
seeds AS (SELECT key, b, sha256(key::VARCHAR || '|' || b::VARCHAR) AS seed FROM (SELECT DISTINCT key FROM known), range({RESAMPLES // DRAWS}) t(b)),
draws AS (SELECT key, b * {DRAWS} + j AS resample, ('0x' || substr(seed, (j * 8 + 1)::INT, 8))::BIGINT AS u FROM seeds, range({DRAWS}) t(j)),
poisson AS (SELECT key, resample, {WEIGHT} AS w FROM draws),
means AS (SELECT by_, resample, sum(x * w) / sum(w) AS mean FROM known JOIN poisson USING (key) WHERE w > 0 GROUP BY by_, resample),
lists AS (SELECT by_, list_sort(list(mean)) AS m FROM means GROUP BY by_),
amounts AS (SELECT by_, count(*) AS n, round(avg(x), 4) AS mean FROM known GROUP BY by_)
SELECT {by}n, mean AS {mean}, {low} AS low, {high} AS high FROM amounts JOIN lists ON amounts.by_ IS NOT DISTINCT FROM lists.by_"""


ORACLE_SQL = {
    "leaf_changes": f"""{VERSIONS}, old AS (SELECT DISTINCT document_id, text FROM passages)
        SELECT n.document_id, count(*) AS sections, count(o.text) AS reused, count(*) - count(o.text) AS changed FROM revised n LEFT JOIN old o ON o.document_id = n.document_id AND o.text = n.text GROUP BY n.document_id""",
    "vector_reuse": f"""{VERSIONS}, old AS (SELECT DISTINCT text FROM passages)
        SELECT n.document_id, count(o.text) AS moved, count(*) - count(o.text) AS embedded, count(*) AS vectors FROM revised n LEFT JOIN old o ON o.text = n.text GROUP BY n.document_id""",
    "bootstrap_merged": f"WITH vals AS (SELECT source AS by_, doc_id AS key, quality::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), {intervals_sql('vals', 'amounts.by_ AS source, ')}",
    "paired_bootstrap_merged": f"{ARMS}, vals AS (SELECT 1 AS by_, a.query_id AS key, b.mrr_at_10 - a.mrr_at_10 AS x FROM per_query a JOIN per_query b USING (query_id) WHERE a.arm = 'dense' AND b.arm = 'hybrid'), {intervals_sql('vals', '', 'delta')}",
}
