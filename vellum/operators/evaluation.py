"""Retrieval and answer metrics, and comparisons of runs (A12-A28, A30-A32, C13 in part, C15, C22, C23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.statistics import MIN_SAMPLES, RESAMPLES, bootstrap_ci, poisson_weights, rate, wilson
from vellum.operators.staging import staged

METRICS = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10")
LATENCY_RATIO, LATENCY_MS, TOLERANCE, FALLBACK = 1.5, 5.0, 0.005, 0.10
RunKey = ["arm", "query_id"]


def without_neutral(rankings: DataFrame, neutral: DataFrame | None) -> DataFrame:
    """Rankings of ``arm, query_id, key, rank`` without neutral keys, ranks renumbered."""
    if neutral is None:
        return rankings
    kept = rankings.join(neutral.select("query_id", "key"), ["query_id", "key"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*RunKey).orderBy("rank")))


def per_query(rankings: DataFrame, relevant: DataFrame, neutral: DataFrame | None = None) -> DataFrame:
    """Metrics of every arm for each query that has a relevant key.

    Recall divides by all relevant keys. A query that an arm found nothing for
    counts with zeros.
    """
    wanted = relevant.select("query_id", "key").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = without_neutral(rankings, neutral).join(wanted, ["query_id", "key"], "left_semi")
    gain = F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    found = hits.groupBy(*RunKey).agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5, 10)], F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    grid = rankings.select("arm").distinct().crossJoin(sizes)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = grid.join(found, RunKey, "left")
    return out.select(
        *RunKey,
        *[(F.coalesce(f"h{k}", F.lit(0)) / F.col("n")).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_at_10"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_10"),
    )


def arm_summary(scores: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Means, top-1 hits and their interval of each arm, overall (category null) and by category."""
    rows = scores.join(categories.select("query_id", "category"), "query_id", "left") if categories is not None else scores.withColumn("category", F.lit(None).cast("string"))
    sets = rows.select("arm", F.explode(F.array(F.lit(None).cast("string"), F.col("category")) if categories is not None else F.array(F.lit(None).cast("string"))).alias("category"), *METRICS)
    hits = F.count_if(F.col("recall_at_1") > 0)
    return sets.groupBy("arm", "category").agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS], hits.alias("top1_hits"), wilson(hits, F.count(F.lit(1))).alias("ci"))


def mean_intervals(scores: DataFrame, metric: str) -> DataFrame:
    """Bootstrap interval of a metric for each arm; values in the order of the query ids.

    The interval depends on that order, so an arm's values meet in one row: a
    number for each evaluation question, and none for each document.
    """
    rows = scores.groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", metric))), lambda r: r[metric]).alias("values"))
    return rows.select("arm", bootstrap_ci("values").alias("ci")).select("arm", "ci.low", "ci.high")


def paired_delta(scores: DataFrame, baseline: str, candidate: str, metric: str) -> DataFrame:
    """Mean change from one arm to another over the same queries, and its interval; one number a question meets in a row."""
    a = scores.filter(F.col("arm") == baseline).select("query_id", F.col(metric).alias("a"))
    b = scores.filter(F.col("arm") == candidate).select("query_id", F.col(metric).alias("b"))
    rows = a.join(b, "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", (F.col("b") - F.col("a")).alias("d")))), lambda r: r["d"]).alias("d"), F.round(F.avg(F.col("b") - F.col("a")), 4).alias("delta"))
    return rows.select("delta", bootstrap_ci("d").alias("ci")).select("delta", "ci.low", "ci.high")


def merged_intervals(values: DataFrame, by: list[str], key: str, value: str, *, confidence: float = 0.95, resamples: int = RESAMPLES) -> DataFrame:
    """A16 for any number of rows: mean, and the bootstrap interval of it, for each ``by``; ``key`` tells rows apart.

    Every row's weight in every resample comes from a hash of its key, so a
    resample is a weighted sum that map tasks reduce first; what meets in one row
    is the means of the resamples, whatever the number of values. Not the same
    draws as ``mean_intervals``, which stays for parity on small sets: ends of
    both differ by about the noise of 2,000 resamples. Null values are left out;
    below 10 values there is no interval, and a resample without any row is left out.
    """
    known = values.filter(F.col(value).isNotNull())
    drawn = known.select(*by, F.col(value).cast("double").alias("_x"), F.explode(poisson_weights(F.col(key), resamples)).alias("_d"))
    means = drawn.groupBy(*by, "_d.resample").agg((F.sum(F.col("_x") * F.col("_d.weight")) / F.sum("_d.weight")).alias("_mean"))
    ordered = means.groupBy(*by).agg(F.array_sort(F.collect_list("_mean")).alias("_means"))
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(value).cast("double")), 4).alias("mean"))
    names = [F.col(c).alias(f"_{c}") for c in by]
    tail = (1 - confidence) / 2

    def at(share: float) -> Column:
        place = F.greatest(F.lit(1), F.ceil(F.size("_means") * F.lit(round(share, 9))).cast("int"))
        return F.when(F.col("n") >= MIN_SAMPLES, F.round(F.get("_means", place - 1), 4))

    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = sizes.join(ordered.select(*names, "_means"), same, "left")
    return rows.select(*by, "n", "mean", at(tail).alias("low"), at(1 - tail).alias("high"))


def merged_delta(scores: DataFrame, baseline: str, candidate: str, metric: str, *, resamples: int = RESAMPLES) -> DataFrame:
    """A17 for any number of queries: mean change between two arms over the same queries, with ``merged_intervals``."""
    a = scores.filter(F.col("arm") == baseline).select("query_id", F.col(metric).alias("a"))
    b = scores.filter(F.col("arm") == candidate).select("query_id", F.col(metric).alias("b"))
    changes = a.join(b, "query_id").select("query_id", (F.col("b") - F.col("a")).alias("d"))
    return merged_intervals(changes, [], "query_id", "d", resamples=resamples).withColumnRenamed("mean", "delta")


def candidate_recall(rankings: DataFrame, relevant: DataFrame, depth: int, neutral: DataFrame | None = None) -> DataFrame:
    """Share of queries with a relevant key among the first ``depth``, cut before neutral keys go."""
    pool = rankings.filter(F.col("rank") <= depth)
    scores = relevant.select("query_id", "key").distinct()
    sizes = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    if neutral is not None:
        pool = pool.join(neutral.select("query_id", "key"), ["query_id", "key"], "left_anti")
    hits = pool.join(scores, ["query_id", "key"], "left_semi").groupBy(*RunKey).agg(F.count(F.lit(1)).alias("h"))
    rows = rankings.select("arm").distinct().crossJoin(sizes).join(hits, RunKey, "left").withColumn("h", F.coalesce("h", F.lit(0)))
    any_hit = F.count_if(F.col("h") > 0)
    return rows.groupBy("arm").agg(F.lit(depth).alias("depth"), F.count(F.lit(1)).alias("questions"), rate(any_hit, F.count(F.lit(1)), 4).alias("any_relevant"), F.round(F.avg(F.col("h") / F.col("n")), 4).alias("mean_recall"), wilson(any_hit, F.count(F.lit(1))).alias("ci"))


def with_below(levels: DataFrame, by: list[str], order: str, amount: str) -> DataFrame:
    """Add ``below``: the sum of ``amount`` over rows of the same ``by`` with a smaller ``order``.

    ``levels`` has a row for each value. Values are dealt out in ranges, summed
    by range and the ranges' sums run up, so no task holds a whole group.
    """
    placed = staged(levels.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_range").agg(F.sum(amount).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), before.alias("_before"))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(starts, same).withColumn("below", F.col("_before") + within).select(*levels.columns, "below")


def auroc(scores: DataFrame) -> DataFrame:
    """Of ``score, positive``: the chance that a positive scores above a negative, ties half; null if a side is empty.

    By rank sums over distinct scores, so equal scores are one row and nothing
    is crossed. Rows with a null on either side are left out.
    """
    known = scores.filter(F.col("score").isNotNull() & F.col("positive").isNotNull())
    levels = known.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    won = with_below(levels, [], "score", "n").withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2.0))
    return won.agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def top1(rankings: DataFrame, relevant: DataFrame, neutral: DataFrame | None = None) -> DataFrame:
    """``arm, query_id, hit``: whether the first key is relevant."""
    first = without_neutral(rankings, neutral).filter(F.col("rank") == 1).join(relevant.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi").select(*RunKey, F.lit(True).alias("hit"))
    grid = rankings.select("arm").distinct().crossJoin(relevant.select("query_id").distinct())
    return grid.join(first, RunKey, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def arm_win_loss(hits: DataFrame, first: str, second: str) -> DataFrame:
    """Queries that one arm has right at rank 1 and the other has not."""
    wide = hits.groupBy("query_id").agg(F.max(F.when(F.col("arm") == first, F.col("hit"))).alias("a"), F.max(F.when(F.col("arm") == second, F.col("hit"))).alias("b"))
    return wide.filter(F.col("a") != F.col("b")).select("query_id", F.when(F.col("a"), first).otherwise(second).alias("winner"))


def rerank_effects(scores: DataFrame, before: str, after: str, categories: DataFrame | None = None) -> DataFrame:
    """How many queries an arm helps or hurts, by reciprocal rank; category null is the total."""
    wide = scores.groupBy("query_id").agg(F.max(F.when(F.col("arm") == before, F.col("mrr_at_10"))).alias("a"), F.max(F.when(F.col("arm") == after, F.col("mrr_at_10"))).alias("b"))
    rows = wide.join(categories.select("query_id", "category"), "query_id", "left") if categories is not None else wide.withColumn("category", F.lit(None).cast("string"))
    sets = rows.select("a", "b", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("category")))).alias("category"))
    return sets.groupBy("category").agg(F.count_if(F.col("b") > F.col("a")).alias("helped"), F.count_if(F.col("b") < F.col("a")).alias("hurt"))


def failures(rankings: DataFrame, relevant: DataFrame, neutral: DataFrame | None = None) -> DataFrame:
    """Answerable queries whose first key is wrong, with the rank of the first relevant one, null for none."""
    hits = without_neutral(rankings, neutral).join(relevant.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi").groupBy(*RunKey).agg(F.min("rank").alias("first_relevant"))
    missed = top1(rankings, relevant, neutral).filter(~F.col("hit")).select(*RunKey)
    return missed.join(hits, RunKey, "left")


def latency_summary(times: DataFrame, by: str, value: str) -> DataFrame:
    """Count, median, nearest-rank p95, maximum, and p99 from 100 values on; null values are left out.

    Ranks are found among counted values (``with_below``), so a group may have
    any number of rows.
    """
    n = F.col("n")
    half, last = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    out = at_ranks(times.select(F.col(by).alias("by"), F.col(value).alias("value")), {"m1": half, "m2": last, "p95": nearest_place(n, 0.95), "max": n, "p99": nearest_place(n, 0.99)})
    out = out.withColumn("median", (F.col("m1") + F.col("m2")) / 2).withColumnRenamed("by", by)
    return out.select(by, F.col("n").cast("int").alias("n"), *[F.round(c, 2).alias(c) for c in ("median", "p95", "max")], F.when(F.col("n") >= 100, F.round("p99", 2)).alias("p99"))


def nearest_place(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(share)))


def at_ranks(values: DataFrame, places: dict[str, Column]) -> DataFrame:
    """Of ``by, value``: for each ``by`` the count ``n`` of values and the values at 1-based places, which may use ``n``."""
    levels = values.filter(F.col("value").isNotNull()).groupBy("by", "value").agg(F.count(F.lit(1)).alias("times"))
    ranked = with_below(levels, ["by"], "value", "times")
    sizes = levels.groupBy(F.col("by").alias("of")).agg(F.sum("times").alias("n"))
    rows = ranked.join(sizes, F.col("by").eqNullSafe(F.col("of")))
    return rows.groupBy("by").agg(F.max("n").alias("n"), *[F.max(F.when((F.col("below") < r) & (r <= F.col("below") + F.col("times")), F.col("value"))).alias(name) for name, r in places.items()])


def answer_summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """Rates over question results; a rate over nothing is null. ``by`` adds a row for each value beside the total."""
    key = F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col(by).cast("string")))) if by else F.lit(None).cast("string")
    rows = results.withColumn("group", key)
    ok, answered, expected = F.col("error").isNull(), F.col("answered"), ~F.col("abstain_expected")
    gold = F.size(F.array_intersect(F.array_distinct("cited"), "relevant"))
    n = F.col("n")
    times = rows.select(F.col("group").alias("by"), F.when(ok, F.col("latency_ms")).cast("double").alias("value"))
    # The 95th percentile is at the 0-based place floor(0.95 n), unlike A18.
    slow = at_ranks(times, {"m1": F.floor((n + 1) / 2), "m2": F.floor(n / 2) + 1, "high": F.least(n, F.floor(n * F.lit(0.95)) + 1)})
    slow = slow.select("by", F.round((F.col("m1") + F.col("m2")) / 2, 1).alias("p50"), F.round("high", 1).alias("p95"))
    rates = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(~ok).alias("provider_errors"),
        rate(F.count_if(ok & expected & answered), F.count_if(ok & expected)).alias("answered_rate"),
        rate(F.count_if(ok & ~expected & ~answered), F.count_if(ok & ~expected)).alias("abstention_accuracy"),
        rate(F.count_if(ok & expected & F.coalesce("fact_complete", F.lit(False))), F.count_if(ok & expected)).alias("fact_recall"),
        rate(F.count_if(ok & expected & answered & (gold > 0)), F.count_if(ok & expected & answered)).alias("gold_citation_rate"),
        rate(F.sum(F.when(ok & expected & answered, gold)), F.sum(F.when(ok & expected & answered, F.size(F.array_distinct("cited"))))).alias("citation_precision"),
        F.count_if(ok & answered & (F.size("cited") == 0)).alias("uncited_answers"),
    )
    return rates.join(slow, F.col("group").eqNullSafe(F.col("by")), "left").drop("by")


def run_compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics of two runs, ``dataset, arm, metric, value, low, high``, and what is worth a warning.

    Quality may fall by half of the baseline's interval, or by a fallback;
    latency may grow by half and five milliseconds. A row that the candidate
    lacks is missing, which is a failure of its own.
    """
    key = ["dataset", "arm", "metric"]
    b = baseline.select(*key, F.col("value").alias("before"), ((F.col("high") - F.col("low")) / 2).alias("half"))
    rows = b.join(candidate.select(*key, F.col("value").alias("after"), F.lit(True).alias("there")), key, "full_outer")
    slow = (F.col("metric") == "latency_ms") & (F.col("after") > F.col("before") * LATENCY_RATIO) & (F.col("after") - F.col("before") > LATENCY_MS)
    worse = (F.col("metric") != "latency_ms") & (F.col("before") - F.col("after") > F.coalesce("half", F.lit(FALLBACK)))
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("there").isNull(), "missing").when(F.coalesce(slow, F.lit(False)), "slower").when(F.coalesce(worse, F.lit(False)), "worse").otherwise("ok")
    return rows.select(*key, "before", "after", verdict.alias("verdict"))


def comparable(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Settings ``name, value`` that differ; none must for quality to be compared."""
    return baseline.select("name", F.col("value").alias("before")).join(candidate.select("name", F.col("value").alias("after")), "name", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def dataset_card(queries: DataFrame) -> DataFrame:
    """Queries by category and language, and how many have no answer."""
    return queries.groupBy("category", "language").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.size("relevant") == 0).alias("unanswerable"))


def stratified_sample(rows: DataFrame, size: int, seed: int = 20261016, *, key: str = "query_id") -> DataFrame:
    """Flagged rows first, up to half; then one of each category in turn, in a seeded order by hash.

    The order is a hash of id and seed, so any engine and partitioning draws the same rows.
    """
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = rows.withColumn("draw", draw)
    flagged = rows.filter("flagged").orderBy("draw").limit(size // 2)
    rest = rows.join(flagged.select(key), key, "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy("category").orderBy("draw"))).filter(F.col("turn") <= size)
    others = rest.orderBy("turn", "category").limit(size).withColumn("part", F.lit(1))
    both = flagged.withColumns({"part": F.lit(0), "turn": F.lit(0)}).unionByName(others)
    return both.orderBy("part", "turn", "category", "draw").limit(size).drop("part", "turn", "draw")


def check_summary(checks: DataFrame) -> DataFrame:
    """Checks and passes by class and category; nulls are totals."""
    return checks.rollup("kind", "category").agg(F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"))


def token_statistics(tokens: DataFrame, by: str, most: int = 512) -> DataFrame:
    """Longest, mean and truncated inputs of a model with a limit."""
    return tokens.groupBy(by).agg(F.max("tokens").alias("max_tokens"), F.round(F.avg("tokens"), 2).alias("mean_tokens"), F.count_if(F.col("tokens") > most).alias("truncated"))
