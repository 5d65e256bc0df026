"""The answer plan: context, completion, grounding and citations for a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.context import pack_context, render_prompts
from vellum.operators.grounding import cite, completion_of, extract_answers, grounded, insufficiency_message

Generator = Callable[[DataFrame, DataFrame], DataFrame]
GENERATORS: dict[str, Generator] = {}


def register_generator(name: str, generator: Generator) -> None:
    """Make a language model known: from questions and blocks to ``query_id, completion``."""
    GENERATORS[name] = generator


def extractive(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """The deterministic default."""
    sources = blocks.select("query_id", "label", F.substring("label", 2, 9).cast("int").alias("position"), "text")
    found = extract_answers(questions, sources)
    return found.select("query_id", completion_of(F.col("label"), F.col("sentence")).alias("completion"))


register_generator("extractive", extractive)


def grounded_answers(questions: DataFrame, blocks: DataFrame, *, generator: str = "extractive") -> DataFrame:
    """Completions of the generator, checked against the blocks that were shown."""
    completions = GENERATORS[generator](questions, blocks)
    shown = blocks.groupBy("query_id").agg(F.collect_list(F.struct("label", "text")).alias("sources"))
    checked = grounded(completions.join(shown, "query_id", "left"), F.col("completion"), F.col("sources"), output="g")
    return questions.select("query_id", "query").join(checked.select("query_id", "g.*"), "query_id", "left")


def rag_answers(questions: DataFrame, ranked: DataFrame, *, sources: int = 5, per_source: int = 600, budget: int = 2400, generator: str = "extractive") -> DataFrame:
    """For each question an answer with its labels, or a message that the sources do not suffice.

    ``ranked`` is a search result: ``query_id, chunk_id, text, rank``.
    """
    blocks = pack_context(ranked, sources=sources, per_source=per_source, budget=budget)
    out = grounded_answers(questions, blocks, generator=generator)
    message = insufficiency_message(F.col("query"), F.lit(False))
    answered = F.coalesce("answerable", F.lit(False))
    return out.select("query_id", answered.alias("answered"), F.when(answered, F.col("text")).otherwise(message).alias("answer"), "labels", F.coalesce("reason", F.when(~answered, "no_sources")).alias("reason"), "granularity", "removed_unknown_labels", "removed_uncited_sentences", "removed_fabricated_quotes", "removed_unsupported_literals")


def cited_chunks(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """The chunks behind an answer's labels."""
    return cite(answers.filter("answered"), blocks.select("query_id", "label", "chunk_id", "text"))


def prompts(questions: DataFrame, blocks: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """What a real model would be sent."""
    return render_prompts(questions, blocks, history)
