"""Vector functions over ``array<float>`` columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """V1: cosine similarity; null if a side is zero. The distance is 1 less this."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_valid(a: Column, dimension: int) -> Column:
    """V2: right size, finite values, and a norm of 1 within a hundredth."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite & (F.abs(norm(a) - 1) <= 1e-2), F.lit(False))


def hashed_slots(words: Column, dimension: int) -> Column:
    """V4: for each word its slot and sign, from its SHA-256."""

    def one(word: Column) -> Column:
        digest = F.sha2(word, 256)
        slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension
        sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
        return F.struct(slot.cast("int").alias("slot"), sign.alias("sign"))

    return F.transform(words, one)


def hashed_vector(words: Column, dimension: int = 384) -> Column:
    """V4: unit vector of hashed words; a text without words, or one that cancels out, has its own."""
    some = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("<empty>")))
    slots = hashed_slots(some, dimension)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(slots, lambda s: s["slot"] == i), F.lit(0.0), lambda t, s: t + s["sign"]))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda t, x: t + x * x))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(size > 0, F.transform(raw, lambda x: x / size)).otherwise(unit).cast("array<float>")


def config_fingerprint(provider: Column, model: Column, revision: Column, dimension: Column, **more: Column) -> Column:
    """V5: SHA-256 of the identity of an embedding configuration, keys in order."""
    parts = {"provider": provider, "model": model, "revision": revision, "dimension": dimension.cast("string")} | more
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)
