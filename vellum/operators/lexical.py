"""Lexical retrieval: terms, document frequencies, IDF scores and top-k."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import STOP_WORDS, tokens
from vellum.operators.joins import hinted, is_small

# Opening quotes and what closes them.
QUOTES = {'"': '"', "“": "”", "„": "”", "«": "»"}
MAX_PHRASES, MAX_PHRASE_CHARS = 5, 200
MAX_TERMS, CANDIDATES = 12, 50
#: Scores are summed in whole numbers of this part of 1, so that equal terms tie in whatever order they come.
PART = 1e14
#: Phrases whose tokens a chunk is compared with before it is taken apart.
FEW_PHRASES = 1_000
PARSED = T.StructType([T.StructField("words", T.StringType()), T.StructField("phrases", T.ArrayType(T.StringType()))])


def split_query(query: str) -> tuple[str, list[str]]:
    """Free words and quoted phrases; an unmatched quote and phrases beyond the limits are free words."""
    free: list[str] = []
    phrases: list[str] = []
    at = 0
    while at < len(query):
        opening = next((i for i in range(at, len(query)) if query[i] in QUOTES), -1)
        if opening < 0:
            break
        free.append(query[at:opening])
        closing = query.find(QUOTES[query[opening]], opening + 1)
        if closing < 0:
            at = opening + 1
            break
        inner = query[opening + 1 : closing].strip()
        fits = inner and len(phrases) < MAX_PHRASES and len(inner) <= MAX_PHRASE_CHARS
        (phrases if fits else free).append(inner)
        at = closing + 1
    free.append(query[at:])
    return " ".join(x.strip() for x in free if x.strip()), phrases


@F.pandas_udf(PARSED)
def lexical_query(query: pd.Series) -> pd.DataFrame:
    """``struct<words, phrases>`` of a query."""
    return pd.DataFrame([split_query(q or "") for q in query], columns=["words", "phrases"])


def searchable(documents: DataFrame) -> DataFrame:
    """Documents that any retrieval may show."""
    return documents.filter((F.col("status") == "ready") & F.col("is_active"))


def query_terms(queries: DataFrame, *, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Distinct ``(query_id, user_id, term, priority)``; ``term`` is a token or adjacent tokens joined by a space.

    Free words are tokenised, without function words, at priority 0; phrases
    keep all of theirs, at priority 1. A word that is a phrase too counts twice.
    """
    words = queries.select("query_id", "user_id", F.explode(F.array_except(tokens(F.col("words")), F.array(*[F.lit(w) for w in stop_words]).cast("array<string>"))).alias("term"), F.lit(0).alias("priority"))
    phrases = queries.select("query_id", "user_id", F.explode("phrases").alias("phrase")).select("query_id", "user_id", F.array_join(tokens(F.col("phrase")), " ").alias("term"), F.lit(1).alias("priority"))
    return words.unionByName(phrases.filter(F.col("term") != "")).distinct()


def term_matches(chunks: DataFrame, terms: DataFrame, *, small: bool | None = None) -> DataFrame:
    """Distinct ``(user_id, term, chunk_id, document_id)`` where the chunk holds the term.

    A chunk and a term meet by equality on one token, the phrase's longest; only
    then are the adjacent tokens of a phrase compared. So nothing is crossed.
    Terms of a checked number go to every task, and no text is shuffled.
    """
    small = is_small(terms) if small is None else small
    longest = F.array_max(F.transform(F.split("term", " "), lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]
    wanted = terms.select("user_id", "term").distinct().withColumn("token", longest)
    columns = ["user_id", "term", "chunk_id", "document_id"]
    held = chunks.select("user_id", "chunk_id", "document_id", tokens(F.col("text")).alias("tokens"))
    single = held.select("user_id", "chunk_id", "document_id", F.explode(F.array_distinct("tokens")).alias("token"))
    out = single.join(hinted(wanted.filter(F.col("term") == F.col("token")), small), ["user_id", "token"]).select(*columns)
    phrases = wanted.filter(F.col("term") != F.col("token"))
    if phrases.isEmpty():
        return out
    found = phrase_matches(held, phrases, small=small).select(*columns)
    return found if wanted.filter(F.col("term") == F.col("token")).isEmpty() else out.unionByName(found)


def phrase_starts(held: DataFrame, phrases: DataFrame) -> DataFrame:
    """Each chunk, as ``spaced`` tokens, with every ``token`` of it that phrases may be sought by, or with null for none.

    Each row is a copy of the chunk. So where there are few phrases, a chunk is
    exploded only to those of its tokens that one is sought by; else its copies
    grow with the square of its length. Null and empty arrays are not filtered
    out early, as Spark would then take the tokens twice.
    """
    spaced = F.coalesce(F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")), F.lit("")).alias("spaced")
    sought = F.array_distinct("tokens")
    if is_small(phrases, FEW_PHRASES):
        held = held.join(F.broadcast(phrases.groupBy("user_id").agg(F.collect_set("token").alias("anchors"))), "user_id")
        sought = F.array_intersect("tokens", "anchors")
    rows = held.select("user_id", "chunk_id", "document_id", spaced, sought.alias("sought"))
    return rows.select("user_id", "chunk_id", "document_id", "spaced", F.explode_outer("sought").alias("token"))


def phrase_matches(held: DataFrame, phrases: DataFrame, *, small: bool) -> DataFrame:
    """The chunks, given with their ``tokens``, that have a phrase's token and the whole phrase in them."""
    has_phrase = F.contains("spaced", F.concat(F.lit(" "), F.col("term"), F.lit(" ")))
    return phrase_starts(held, phrases).join(hinted(phrases, small), ["user_id", "token"]).filter(has_phrase)


def idf(n: Column, df: Column) -> Column:
    """A3: always positive, also where the recorded size ``n`` is stale."""
    return F.log(1 + (F.greatest(n, df) - df + 0.5) / (df + 0.5))


def parts(weight: Column) -> Column:
    """A weight in whole ``PART``s; some 2,000 of the largest weights fit a sum."""
    return F.rint(weight * PART).cast("bigint")


def corpus_size(documents: DataFrame) -> DataFrame:
    """A1: chunks of each tenant's searchable documents; no filter of a query applies."""
    return searchable(documents).groupBy("user_id").agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("double").alias("n"))


def with_readiness(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Matches with a flag for searchable documents. It is an outer join, as a semi join would be pushed below the tokens and shuffle them."""
    ready = searchable(documents).select("user_id", "document_id", F.lit(True).alias("is_ready"))
    return matches.join(ready, ["user_id", "document_id"], "left")


def term_weights(flagged: DataFrame, documents: DataFrame) -> DataFrame:
    """A2, A3: ``(user_id, term, df, idf)`` of all terms that occur; ``df`` counts searchable documents' chunks only.

    It reads the same columns as the scores do, so that Spark reuses one
    exchange of the matches for both.
    """
    df = flagged.groupBy("user_id", "term").agg(F.count_if(F.col("is_ready") & F.col("chunk_id").isNotNull()).cast("double").alias("df"))
    return df.join(corpus_size(documents), "user_id").withColumn("idf", idf(F.col("n"), F.col("df"))).select("user_id", "term", "df", "idf")


def chosen_terms(terms: DataFrame, weights: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Of the terms that occur, phrases and long ones first up to three times the limit; then the rarest searchable ones."""
    scan = Window.partitionBy("query_id").orderBy(F.col("priority").desc(), F.length("term").desc(), "term")
    rare = Window.partitionBy("query_id").orderBy(F.col("idf").desc(), "term", F.col("priority").desc())
    scanned = terms.join(weights, ["user_id", "term"]).withColumn("place", F.row_number().over(scan)).filter(F.col("place") <= 3 * max_terms)
    return scanned.filter(F.col("df") > 0).withColumn("place", F.row_number().over(rare)).filter(F.col("place") <= max_terms).select("query_id", "user_id", "term", "priority", "df", "idf")


def lexical_search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, *, limit: int = CANDIDATES, max_terms: int = MAX_TERMS, stop_words: list[str] = STOP_WORDS, scope: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, document_id, score, rank)``, best first, ties by chunk.

    ``queries`` has ``query_id, user_id, words, phrases``. ``scope`` limits the
    result to its ``query_id, document_id`` pairs; frequencies ignore it.
    """
    terms = query_terms(queries, stop_words=stop_words)
    small = is_small(terms)
    flagged = with_readiness(term_matches(chunks, terms, small=small), documents)
    weights = chosen_terms(terms, term_weights(flagged, documents), max_terms).select("query_id", "user_id", "term", "idf")
    hits = flagged.join(hinted(weights, small), ["user_id", "term"])
    if scope is not None:
        hits = hits.join(scope.select("query_id", "document_id"), ["query_id", "document_id"], "left_semi")
    scores = hits.groupBy("query_id", "chunk_id", "document_id").agg((F.sum(F.when(F.col("is_ready"), parts(F.col("idf")))) / PART).alias("score")).filter("score is not null")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
