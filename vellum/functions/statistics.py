"""Statistics as column expressions and grouped aggregates."""

from __future__ import annotations

import math
import random
import statistics

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
MIN_SAMPLES = 10
RESAMPLES = 2000
SEED = 20261016
# Normal quantiles by confidence.
Z = {0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """``struct<low, high>`` of a proportion, null below 10 trials."""
    z, n = Z[confidence], total.cast("double")
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(total >= MIN_SAMPLES, F.struct(F.round(F.greatest(F.lit(0.0), centre - margin), 4).alias("low"), F.round(F.least(F.lit(1.0), centre + margin), 4).alias("high")))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place ceil(n * share) of an array, 1 at least; null for an empty one."""
    ordered = F.array_sort(values)
    place = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(share)).cast("int"))
    return F.get(ordered, F.least(place, F.size(values)) - 1)


def floor_rank(values: Column, share: float) -> Column:
    """The value at index int(n * share) of an array; not the same as ``nearest_rank``."""
    place = F.floor(F.size(values) * F.lit(share)).cast("int")
    return F.get(F.array_sort(values), F.least(place, F.size(values) - 1))


def rate(numerator: Column, denominator: Column, places: int = 3) -> Column:
    """Rounded share, null for nothing."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), places)


def bootstrap_interval(values: list[float], confidence: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float] | None:
    """Percentile bootstrap of the mean, null below 10 values. The order of the values matters."""
    if len(values) < MIN_SAMPLES:
        return None
    draw, n = random.Random(seed), len(values)
    means = sorted(statistics.fmean(draw.choices(values, k=n)) for _ in range(resamples))
    tail = (1 - confidence) / 2

    def at(share: float) -> float:
        return round(means[min(resamples - 1, max(0, math.ceil(share * resamples) - 1))], 4)

    return at(tail), at(1 - tail)


#: Draws that one hash gives: eight of 32 bits.
DRAWS = 8
#: Upper ends, of 2**32, of the draws that give weight 0, 1, ...: the distribution function of Poisson(1).
POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def poisson_weights(key: Column, resamples: int = RESAMPLES) -> Column:
    """``array<struct<resample, weight>>`` of a row, from hashes of its key, without zeros.

    A row's weight in a resample depends on nothing but both, so resamples are
    sums that any partitioning gives alike. Every 32-bit draw meets the table of
    Poisson(1), whose weights add to the number of rows on average.
    """

    def weight(draw: Column) -> Column:
        out = F.lit(len(POISSON))
        for k in reversed(range(len(POISSON))):
            out = F.when(draw < POISSON[k], k).otherwise(out)
        return out

    def draws(seed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda j: F.conv(F.substring(seed, j * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    # One step for each value, so that none is worked out again inside the next.
    seeds = F.transform(F.sequence(F.lit(0), F.lit(-(-resamples // DRAWS) - 1)), lambda block: F.sha2(F.concat_ws("|", key.cast("string"), block.cast("string")), 256))
    weights = F.transform(F.flatten(F.transform(seeds, draws)), lambda u, i: F.struct(i.alias("resample"), weight(u).alias("weight")))
    return F.filter(weights, lambda d: (d["weight"] > 0) & (d["resample"] < resamples))


@F.pandas_udf(INTERVAL)
def bootstrap_ci(values: pd.Series) -> pd.DataFrame:
    """A16 over an array column: gather per group in a fixed order first, as the interval depends on it."""
    out = [bootstrap_interval([float(x) for x in v]) or (None, None) for v in values]
    return pd.DataFrame(out, columns=["low", "high"], dtype="float64")
