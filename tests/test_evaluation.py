import math
import random
import statistics

from pyspark.sql import functions as F

from vellum.functions.statistics import bootstrap_interval, floor_rank, nearest_rank, wilson
from vellum.operators import evaluation as e


def test_metrics(spark):
    rankings = spark.createDataFrame([("x", 1, "n", 1), ("x", 1, "b", 2), ("x", 1, "a", 3), ("x", 2, "z", 1)], "arm string, query_id long, key string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (1, "missing"), (2, "q")], "query_id long, key string")
    neutral = spark.createDataFrame([(1, "n")], "query_id long, key string")
    got = {r.query_id: r for r in e.per_query(rankings, relevant, neutral).collect()}
    assert got[1].recall_at_1 == 1 / 3 and got[1].recall_at_3 == 2 / 3 and got[1].mrr_at_10 == 1
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert abs(got[1].ndcg_at_10 - (1 + 1 / math.log2(3)) / ideal) < 1e-12
    assert got[2].mrr_at_10 == 0
    recall = e.candidate_recall(rankings, relevant, 1, neutral).first()
    assert recall.any_relevant == 0 and recall.ci is None
    assert [(r.query_id, r.first_relevant) for r in e.failures(rankings, relevant, neutral).collect()] == [(2, None)]


def test_auroc(spark):
    rows = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "score double, positive boolean")
    assert e.auroc(rows).first()["auroc"] == (1 + 1 + 0.5 + 1) / 4
    assert e.auroc(rows.filter("positive")).first()["auroc"] is None


def test_intervals(spark):
    assert bootstrap_interval([1.0] * 9) is None
    values = [random.Random(3).random() for _ in range(30)]
    rng = random.Random(5)
    means = sorted(statistics.fmean(rng.choices(values, k=30)) for _ in range(200))
    assert bootstrap_interval(values, resamples=200, seed=5) == (round(means[4], 4), round(means[194], 4))
    row = spark.range(1).select(wilson(F.lit(8), F.lit(10)).alias("a"), wilson(F.lit(8), F.lit(9)).alias("b")).first()
    assert row["a"]["low"] == 0.4902 and row["a"]["high"] == 0.9433 and row["b"] is None


def test_two_percentiles(spark):
    values = F.array(*[F.lit(float(i)) for i in range(1, 21)])
    row = spark.range(1).select(nearest_rank(values, 0.95).alias("a"), floor_rank(values, 0.95).alias("b"), nearest_rank(F.array().cast("array<double>"), 0.5).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (19, 20, None)


def test_answers(spark):
    rows = [("q1", "c", True, False, None, True, ["a"], ["a"], 100.0), ("q2", "c", False, True, None, None, [], [], 200.0), ("q3", "d", True, True, None, None, ["x"], [], 300.0), ("q4", "d", False, False, "down", None, [], ["a"], 400.0)]
    df = spark.createDataFrame(rows, "id string, category string, answered boolean, abstain_expected boolean, error string, fact_complete boolean, cited array<string>, relevant array<string>, latency_ms double")
    got = {r.group: r for r in e.answer_summary(df, "category").collect()}
    assert got[None].questions == 4 and got[None].provider_errors == 1
    assert got[None].answered_rate == 1.0 and got[None].abstention_accuracy == 0.5 and got[None].citation_precision == 1.0
    assert got["d"].answered_rate is None and got[None].p50 == 200 and got[None].p95 == 300


def test_run_compare(spark):
    schema = "dataset string, arm string, metric string, value double, low double, high double"
    before = spark.createDataFrame([("d", "x", "mrr", 0.9, 0.8, 1.0), ("d", "x", "recall", 0.9, None, None), ("d", "x", "latency_ms", 10.0, None, None), ("d", "gone", "mrr", 0.5, None, None)], schema)
    after = spark.createDataFrame([("d", "x", "mrr", 0.7, None, None), ("d", "x", "recall", 0.85, None, None), ("d", "x", "latency_ms", 20.0, None, None)], schema)
    got = {(r.arm, r.metric): r.verdict for r in e.run_compare(before, after).collect()}
    assert got == {("x", "mrr"): "worse", ("x", "recall"): "ok", ("x", "latency_ms"): "slower", ("gone", "mrr"): "missing"}
    settings = spark.createDataFrame([("k", "1"), ("n", None)], "name string, value string")
    assert e.comparable(settings, settings).count() == 0


def test_sample(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 10 == 0) for i in range(60)], "query_id long, category string, flagged boolean")
    one, two = (sorted(r.query_id for r in e.stratified_sample(x, 12).collect()) for x in (df, df.repartition(7)))
    assert one == two and len(one) == 12
    assert sum(i % 10 == 0 for i in one) >= 6
    assert e.check_summary(df.select(F.lit("hard").alias("kind"), "category", F.col("flagged").alias("passed"))).count() == 5


def test_filtered_arms(spark):
    """Nothing outside a filter comes back; a filter of the relevant documents finds them all, a foreign one finds none."""
    from vellum.plans.queries_evaluation import filtered_arms

    rows = {r.arm: r for r in filtered_arms(spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == {"hybrid+filter", "hybrid+foreign-filter"} and all(r.violations == 0 for r in rows.values())
    assert rows["hybrid+filter"].top1_hits > 0.5 * rows["hybrid+filter"].questions > 0
    assert rows["hybrid+foreign-filter"].top1_hits == 0 and rows["hybrid+foreign-filter"].answered > 0


def test_merged_intervals(spark):
    """Ends near those of the exact form, the same rows under any partitioning, and a Python form of the draws."""
    import hashlib

    from vellum.functions.statistics import POISSON

    rng = random.Random(7)
    rows = [(i, "ab"[i % 2], rng.random()) for i in range(400)] + [(1000 + i, "few", 1.0) for i in range(9)] + [(2000, "a", None)] + [(3000 + i, None, float(i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id long, arm string, x double")
    got = {r.arm: r for r in e.merged_intervals(df, ["arm"], "query_id", "x").collect()}
    again = {r.arm: r for r in e.merged_intervals(df.repartition(9), ["arm"], "query_id", "x").collect()}
    assert got == again
    for arm in ("a", "b", None):
        values = [x for _, a, x in rows if a == arm and x is not None]
        low, high = bootstrap_interval(values)
        width = high - low
        assert got[arm].n == len(values) and got[arm].mean == round(statistics.fmean(values), 4)
        assert abs(got[arm].low - low) < 0.15 * width and abs(got[arm].high - high) < 0.15 * width
    assert got["few"].low is None and got["few"].n == 9

    def weight(key, b):
        digest = hashlib.sha256(f"{key}|{b // 8}".encode()).hexdigest()
        draw = int(digest[b % 8 * 8 : b % 8 * 8 + 8], 16)
        return next((k for k, end in enumerate(POISSON) if draw < end), len(POISSON))

    own = [(i, x) for i, a, x in rows if a is None]
    means = sorted(sum(weight(i, b) * x for i, x in own) / sum(weight(i, b) for i, x in own) for b in range(100))
    small = {r.arm: r for r in e.merged_intervals(df, ["arm"], "query_id", "x", resamples=100).collect()}
    assert (small[None].low, small[None].high) == (round(means[2], 4), round(means[97], 4))
    assert e.merged_intervals(df.limit(0), ["arm"], "query_id", "x").count() == 0
    two = df.filter("arm = 'a'").selectExpr("query_id", "'one' as arm", "x").unionByName(df.filter("arm = 'a'").selectExpr("query_id", "'two' as arm", "x + 0.5 as x"))
    delta = e.merged_delta(two, "one", "two", "x").first()
    assert delta.delta == 0.5 and delta.low == delta.high == 0.5
