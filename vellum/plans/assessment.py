"""Evaluation plans: answers to a question table, models side by side, one report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import answer_text
from vellum.operators import evaluation as e
from vellum.operators.context import pack_context
from vellum.operators.dense import embed, ranks_of
from vellum.operators.grounding import facts_complete
from vellum.operators.staging import staged
from vellum.plans.rag import rag_answers


def rag_results(questions: DataFrame, ranked: DataFrame, *, generator: str = "extractive", **budgets: int) -> DataFrame:
    """C14: a row for each question of ``query_id, query, category, relevant, facts`` run through C8.

    ``relevant`` lists chunk ids, empty where no answer is expected; ``facts`` is
    an array of arrays of alternatives. The columns are those that
    ``answer_summary`` (A14) reads; a batch has no latency, so that is null.
    """
    answers = staged(rag_answers(questions, ranked, generator=generator, **budgets))
    blocks = pack_context(ranked, **budgets).select("query_id", "label", "chunk_id")
    cited = answers.filter("answered").select("query_id", F.explode("labels").alias("label")).join(blocks, ["query_id", "label"]).groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("cited"))
    folded = answers.select("query_id", "answered", "reason", answer_text("answer").alias("folded"))
    rows = questions.join(folded, "query_id", "left").join(cited, "query_id", "left")
    none = F.array().cast(cited.schema["cited"].dataType)
    return rows.select(
        "query_id",
        "category",
        F.when(F.col("answered").isNull(), "no_result").alias("error"),
        F.coalesce("answered", F.lit(False)).alias("answered"),
        (F.size("relevant") == 0).alias("abstain_expected"),
        F.coalesce("cited", none).alias("cited"),
        "relevant",
        (F.coalesce("answered", F.lit(False)) & facts_complete(F.col("folded"), F.col("facts"))).alias("fact_complete"),
        F.lit(None).cast("double").alias("latency_ms"),
        "reason",
    )


def model_comparison(passages: DataFrame, questions: DataFrame, relevant: DataFrame, models: Sequence[tuple[str, str, int]]) -> DataFrame:
    """C17: retrieval metrics of each ``(arm, embedder, dimension)`` over the same passages and questions.

    Only the ranks of relevant passages are needed for them, so each model is
    one exhaustive count (A29) and no ranking is sorted. ``passages``:
    ``chunk_id, text``; ``questions``: ``query_id, query``; ``relevant``:
    ``query_id, key``.
    """

    def arm(name: str, model: str, dimension: int) -> DataFrame:
        vectors = staged(embed(passages, model=model, dimension=dimension, prefix="passage: ", element="double").select("chunk_id", "embedding"))
        asked = embed(questions, text_col="query", model=model, dimension=dimension, prefix="query: ", element="double")
        found = ranks_of(vectors, asked, relevant.withColumnRenamed("key", "chunk_id"))
        return found.select(F.lit(name).alias("arm"), "query_id", F.col("chunk_id").alias("key"), "rank")

    arms = reduce(DataFrame.unionByName, [arm(*m) for m in models])
    scores = e.per_query(staged(arms), relevant)
    return e.arm_summary(scores)


def suite_report(parts: dict[str, DataFrame], baseline: DataFrame | None = None) -> DataFrame:
    """``dataset, arm, metric, value, low, high`` of summaries by name, with a verdict against a baseline report.

    A part has the numeric metrics of an arm (``arm``, or ``group``) in a row.
    Names and numbers only: no question or text is carried over.
    """

    def long(name: str, part: DataFrame) -> DataFrame:
        arm = F.col("arm") if "arm" in part.columns else F.coalesce("group", F.lit("all")) if "group" in part.columns else F.lit("all")
        if "category" in part.columns:
            part = part.filter(F.col("category").isNull())
        numbers = [f.name for f in part.schema if f.dataType.simpleString() in ("double", "bigint", "int")]
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers]))
        return part.select(F.lit(name).alias("dataset"), arm.alias("arm"), pairs.alias("m")).select("dataset", "arm", "m.metric", "m.value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    report = reduce(DataFrame.unionByName, [long(name, part) for name, part in sorted(parts.items())])
    if baseline is None:
        return report
    return report.join(e.run_compare(baseline, report).select("dataset", "arm", "metric", "verdict"), ["dataset", "arm", "metric"], "full_outer")
