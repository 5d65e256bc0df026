"""Registered queries of retrieval metrics, statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.statistics import rate, wilson
from vellum.operators import evaluation as e
from vellum.operators.fusion import reciprocal_rank_fusion
from vellum.operators.lexical import query_terms, term_matches
from vellum.operators.rerank import rerank_arms
from vellum.operators.staging import staged
from vellum.plans import corpus as c
from vellum.plans.queries_retrieval import HYBRID, WORDS, document_search, rrf_sql


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose words hold a benchmark item word for word."""
    asked = c.benchmark_queries(spark, sf_dir).withColumns({"phrases": F.array("query"), "words": F.lit("")})
    terms = query_terms(asked)
    found = term_matches(c.whole_documents(spark, sf_dir), terms)
    return terms.join(found, ["user_id", "term"]).select("query_id", F.col("document_id").alias("key"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("key"))


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Relevant and neutral keys: what holds the item; toxic documents among it are neutral."""
    held = staged(containment(spark, sf_dir))
    return held.join(toxic(spark, sf_dir), "key", "left_anti"), held.join(toxic(spark, sf_dir), "key", "left_semi")


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of three arms over whole documents: dense, sparse and fused."""
    found = staged(document_search(spark, sf_dir))
    fused = reciprocal_rank_fusion(found, limit=50).select(F.lit("hybrid").alias("arm"), "query_id", F.col("chunk_id").alias("key"), "rank")
    return staged(found.select(F.col("retriever").alias("arm"), "query_id", F.col("chunk_id").alias("key"), "rank").unionByName(fused))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant, neutral = judged(spark, sf_dir)
    return e.per_query(arms(spark, sf_dir), relevant, neutral)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by the remainder of their number."""
    return c.benchmark_queries(spark, sf_dir).select("query_id", F.concat(F.lit("c"), F.col("query_id") % 3).alias("category"))


def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rows.select("arm", "query_id", *[F.round(m, 6).alias(m) for m in e.METRICS])


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.arm_summary(scores(spark, sf_dir), categories(spark, sf_dir)).select("arm", "category", "questions", *e.METRICS, "top1_hits", "ci.low", "ci.high")


def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant, neutral = judged(spark, sf_dir)
    return e.candidate_recall(arms(spark, sf_dir), relevant, 10, neutral).select("arm", "depth", "questions", "any_relevant", "mean_recall", "ci.low", "ci.high")


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether good documents are longer than bad ones."""
    rows = c.table(spark, sf_dir, "documents").join(c.table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))
    return e.auroc(rows).select(F.round("auroc", 9).alias("auroc"))


def wilson_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "documents").join(c.table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    return rows.select("source", "n", "good", rate(F.col("good"), F.col("n")).alias("rate"), wilson(F.col("good"), F.col("n")).alias("ci")).select("source", "n", "good", "rate", "ci.low", "ci.high")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.latency_summary(c.table(spark, sf_dir, "events"), "event_type", "value")


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.mean_intervals(scores(spark, sf_dir), "mrr_at_10")


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.paired_delta(scores(spark, sf_dir), "dense", "hybrid", "mrr_at_10")


def arm_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant, neutral = judged(spark, sf_dir)
    return e.arm_win_loss(e.top1(arms(spark, sf_dir), relevant, neutral), "hybrid", "sparse")


def arm_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.rerank_effects(scores(spark, sf_dir), "dense", "hybrid", categories(spark, sf_dir))


def failure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant, neutral = judged(spark, sf_dir)
    return e.failures(arms(spark, sf_dir), relevant, neutral)


def run_table(spark: SparkSession, sf_dir: str, arm: str) -> DataFrame:
    """One arm's summary as a run of the arm ``main``."""
    total = e.arm_summary(scores(spark, sf_dir).filter(F.col("arm") == arm))
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in e.METRICS])).alias("m"))
    none = F.lit(None).cast("double")
    return rows.select(F.lit("benchmark").alias("dataset"), F.lit("main").alias("arm"), "m.metric", "m.value", none.alias("low"), none.alias("high"))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.run_compare(run_table(spark, sf_dir, "sparse"), run_table(spark, sf_dir, "dense"))


def retrieval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 (its filtered arms are ``filtered_arms``), C23: the three arms, and the fused one reranked at several depths, over the same queries."""
    plain = arms(spark, sf_dir)
    texts = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    pool = plain.filter(F.col("arm") == "hybrid").join(texts, "key").join(c.benchmark_queries(spark, sf_dir).select("query_id", "query"), "query_id").withColumnRenamed("rank", "retrieval_rank")
    relevant, neutral = judged(spark, sf_dir)
    rows = e.per_query(plain.unionByName(rerank_arms(pool, DEPTHS, key="key")), relevant, neutral)
    return e.arm_summary(rows).select("arm", "questions", *e.METRICS, "top1_hits")


def filter_scopes(spark: SparkSession, sf_dir: str, relevant: DataFrame) -> dict[str, DataFrame]:
    """For each query the documents that are relevant, and one that is not: that of the least id."""
    wanted = relevant.select("query_id", F.col("key").alias("document_id")).distinct()
    asked, ids, count = staged(wanted.select("query_id").distinct()), c.table(spark, sf_dir, "documents").select("doc_id").distinct(), 100
    while True:
        first = [r[0] for r in ids.orderBy("doc_id").limit(count).collect()]
        pairs = asked.withColumn("document_id", F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")))
        other = staged(pairs.join(wanted, ["query_id", "document_id"], "left_anti").groupBy("query_id").agg(F.min("document_id").alias("document_id")))
        if len(first) < count or asked.join(other, "query_id", "left_anti").isEmpty():
            break
        count *= 10  # an item that so many documents hold
    return {"hybrid+filter": wanted, "hybrid+foreign-filter": other}


def filtered_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused arm under both filters, with how many results lie outside them; what is found is the same for one document a passage."""
    relevant, neutral = judged(spark, sf_dir)
    parts = []
    for arm, scope in filter_scopes(spark, sf_dir, relevant).items():
        scope = staged(scope)
        found = reciprocal_rank_fusion(document_search(spark, sf_dir, scope=scope), limit=50).select("query_id", F.col("chunk_id").alias("key"), "rank")
        inside = scope.select("query_id", F.col("document_id").alias("key"), F.lit(True).alias("inside"))
        parts.append(found.join(inside, ["query_id", "key"], "left").withColumn("arm", F.lit(arm)))
    rows = staged(parts[0].unionByName(parts[1]))
    outside = rows.groupBy("arm").agg(F.count_if(F.col("inside").isNull()).alias("violations"), F.countDistinct("query_id").alias("answered"))
    summary = e.arm_summary(e.per_query(rows.select("arm", "query_id", "key", "rank"), relevant, neutral)).select("arm", "questions", *e.METRICS, "top1_hits")
    return summary.join(outside, "arm", "left")


DEPTHS = [10, 20, 50]

QUERIES = {
    "retrieval_matrix": retrieval_matrix,
    "filtered_arms": filtered_arms,
    "recall_mrr_ndcg": recall_mrr_ndcg,
    "arm_summary": arm_summary,
    "candidate_recall": candidate_recall,
    "auroc": auroc,
    "wilson": wilson_by_source,
    "latency_percentiles": latency_percentiles,
    "bootstrap_ci": bootstrap,
    "paired_bootstrap": paired_bootstrap,
    "arm_win_loss": arm_win_loss,
    "rerank_effects": arm_effects,
    "failure_list": failure_list,
    "run_compare": run_compare,
}

def arms_sql(more: str = "") -> str:
    """Tables up to ``per_query`` and ``top1``; ``more`` is a union of further arms over ``hybrid``."""
    return f"""{HYBRID},
hybrid AS ({rrf_sql('60', '1.0', '1.0', 50)}),
held AS (SELECT item_id AS query_id, doc_id AS key, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_neutral FROM documents d, benchmark b
         WHERE contains(' ' || array_to_string({c.TOKENS_SQL.format('d.text')}, ' ') || ' ', ' ' || array_to_string({c.TOKENS_SQL.format('b.text')}, ' ') || ' ')),
relevant AS (SELECT query_id, key FROM held WHERE NOT is_neutral),
found AS (
    SELECT 'dense' AS arm, query_id, chunk_id AS key, rank FROM dense UNION ALL SELECT 'sparse', query_id, chunk_id, rank FROM sparse
    UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hybrid{more}
),
kept AS (SELECT arm, query_id, key, row_number() OVER (PARTITION BY arm, query_id ORDER BY rank) AS rank FROM found WHERE (query_id, key) NOT IN (SELECT query_id, key FROM held WHERE is_neutral)),
hits AS (SELECT k.* FROM kept k JOIN relevant USING (query_id, key)),
sizes AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
grid AS (SELECT arm, query_id, n FROM (SELECT DISTINCT arm FROM found), sizes),
per_query AS (
    SELECT g.arm, g.query_id,
           count(h.key) FILTER (WHERE h.rank <= 1) / any_value(g.n) AS recall_at_1, count(h.key) FILTER (WHERE h.rank <= 3) / any_value(g.n) AS recall_at_3,
           count(h.key) FILTER (WHERE h.rank <= 5) / any_value(g.n) AS recall_at_5, count(h.key) FILTER (WHERE h.rank <= 10) / any_value(g.n) AS recall_at_10,
           coalesce(1.0 / min(h.rank) FILTER (WHERE h.rank <= 10), 0)::DOUBLE AS mrr_at_10,
           coalesce(sum(1.0 / log2(h.rank + 1)) FILTER (WHERE h.rank <= 10), 0) / list_sum(list_transform(range(1, least(any_value(g.n), 10) + 1), lambda r: 1.0 / log2(r + 1))) AS ndcg_at_10
    FROM grid g LEFT JOIN hits h ON h.arm = g.arm AND h.query_id = g.query_id GROUP BY g.arm, g.query_id
),
top1 AS (SELECT g.arm, g.query_id, h.key IS NOT NULL AS hit FROM grid g LEFT JOIN hits h ON h.arm = g.arm AND h.query_id = g.query_id AND h.rank = 1)"""


ARMS = arms_sql()
SCORED = f"(SELECT h.query_id, h.chunk_id, h.rank, len(list_intersect({WORDS.format('b.text')}, {WORDS.format('d.text')})) AS score FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id)"
RERANKED = "".join(f" UNION ALL SELECT 'hybrid+rerank@{n}', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > {n}, CASE WHEN rank <= {n} THEN -score ELSE 0 END, rank) FROM {SCORED}" for n in DEPTHS)
MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in e.METRICS)


def wilson_sql(good: str, n: str, side: str) -> str:
    z, p = 1.96, f"({good} / {n}::DOUBLE)"
    centre, margin = f"({p} + {z * z} / (2.0 * {n}))", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    value = f"greatest(0.0, ({centre} - {margin}) / (1 + {z * z} / {n}))" if side == "low" else f"least(1.0, ({centre} + {margin}) / (1 + {z * z} / {n}))"
    return f"CASE WHEN {n} >= 10 THEN round({value}, 4) END"


HITS = "count(*) FILTER (WHERE recall_at_1 > 0)"
UNPIVOTED = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}) FILTER (WHERE arm = 'sparse'), 4) AS before, round(avg({m}) FILTER (WHERE arm = 'dense'), 4) AS after FROM per_query" for m in e.METRICS)

ORACLE_SQL = {
    "retrieval_matrix": f"{arms_sql(RERANKED)} SELECT arm, count(*) AS questions, {MEANS}, {HITS} AS top1_hits FROM per_query GROUP BY arm",
    "recall_mrr_ndcg": f"{ARMS} SELECT arm, query_id, {', '.join(f'round({m}, 6) AS {m}' for m in e.METRICS)} FROM per_query",
    "arm_summary": f"""{ARMS}, sets AS (SELECT *, NULL AS category FROM per_query UNION ALL SELECT *, 'c' || (query_id % 3) FROM per_query)
        SELECT arm, category, count(*) AS questions, {MEANS}, {HITS} AS top1_hits, {wilson_sql(HITS, 'count(*)', 'low')} AS low, {wilson_sql(HITS, 'count(*)', 'high')} AS high FROM sets GROUP BY arm, category""",
    "candidate_recall": f"""{ARMS},
        cut AS (SELECT g.arm, g.query_id, any_value(n) AS n, count(r.key) AS h FROM grid g LEFT JOIN (SELECT * FROM found WHERE rank <= 10) f ON f.arm = g.arm AND f.query_id = g.query_id LEFT JOIN relevant r ON r.query_id = f.query_id AND r.key = f.key GROUP BY g.arm, g.query_id)
        SELECT arm, 10 AS depth, count(*) AS questions, round(count(*) FILTER (WHERE h > 0) / count(*), 4) AS any_relevant, round(avg(h / n), 4) AS mean_recall,
               {wilson_sql('count(*) FILTER (WHERE h > 0)', 'count(*)', 'low')} AS low, {wilson_sql('count(*) FILTER (WHERE h > 0)', 'count(*)', 'high')} AS high FROM cut GROUP BY arm""",
    "auroc": "WITH s AS (SELECT n_chars AS s, quality = 1 AS p FROM documents JOIN labels USING (doc_id)) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 9) AS auroc FROM s a, s b WHERE a.p AND NOT b.p",
    "wilson": f"WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, n, good, round(good / n, 3) AS rate, {wilson_sql('good', 'n', 'low')} AS low, {wilson_sql('good', 'n', 'high')} AS high FROM g",
    "latency_percentiles": """WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
        SELECT event_type, len(v) AS n, round(list_median(v), 2) AS median, round(v[ceil(len(v) * 0.95)::INT], 2) AS p95, round(v[len(v)], 2) AS max, CASE WHEN len(v) >= 100 THEN round(v[ceil(len(v) * 0.99)::INT], 2) END AS p99 FROM v""",
    "arm_win_loss": f"{ARMS} SELECT a.query_id, CASE WHEN a.hit THEN 'hybrid' ELSE 'sparse' END AS winner FROM top1 a JOIN top1 b USING (query_id) WHERE a.arm = 'hybrid' AND b.arm = 'sparse' AND a.hit <> b.hit",
    "rerank_effects": f"""{ARMS}, w AS (SELECT query_id, max(mrr_at_10) FILTER (WHERE arm = 'dense') AS a, max(mrr_at_10) FILTER (WHERE arm = 'hybrid') AS b FROM per_query GROUP BY query_id),
        s AS (SELECT *, NULL AS category FROM w UNION ALL SELECT *, 'c' || (query_id % 3) FROM w)
        SELECT category, count(*) FILTER (WHERE b > a) AS helped, count(*) FILTER (WHERE b < a) AS hurt FROM s GROUP BY category""",
    "failure_list": f"{ARMS} SELECT t.arm, t.query_id, (SELECT min(rank) FROM hits h WHERE h.arm = t.arm AND h.query_id = t.query_id) AS first_relevant FROM top1 t WHERE NOT hit",
    "run_compare": f"{ARMS}, u AS ({UNPIVOTED}) SELECT 'benchmark' AS dataset, 'main' AS arm, metric, before, after, CASE WHEN before - after > 0.1 THEN 'worse' ELSE 'ok' END AS verdict FROM u",
}
