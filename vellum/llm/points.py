"""Exact integer points: decoding, distances with safe bounds, and sums that no table can overflow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values from here on count as non-finite; single precision has none.
TOO_LARGE = 2.0**128
#: Sums travel as four whole numbers: three of 40 bits, and what is above them.
LIMB = 40
LIMBS = 4
#: Bounds lose or gain this share, far more than a square root, a sum or a difference of doubles can be off.
SLACK = 2.0**-45


def decode(vectors: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are kept, and ``floor(scale * x)`` of their components as doubles, in which they are exact.

    Kept are vectors of ``dimension`` components, none of them null or non-finite.
    """
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False).to_numpy(zero_copy_only=False))
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) < TOO_LARGE).all(axis=1)
    return rows[good], np.floor(scale * values[good])


def whole(values: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Integers of the doubles: 64 bits where no squared distance of such vectors overflows, else Python's own."""
    limit = int((2**60 / max(1, values.shape[-1])) ** 0.5)
    small = not values.size or np.abs(values).max() <= limit
    if small and (others is None or others.dtype != object):
        return values.astype(np.int64)
    out = np.empty(values.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in values.ravel()]
    return out


def entries(rows: list, dimension: int) -> np.ndarray:
    """Centroids or codebook entries, given as lists of integers, in an array that squared distances can't overflow."""
    limit = int((2**60 / max(1, dimension)) ** 0.5)
    large = any(abs(v) > limit for row in rows for v in row)
    return np.array(rows, dtype=object if large else np.int64).reshape(len(rows), dimension)


def squared(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    gap = points - other
    return (gap * gap).sum(axis=-1)


def above(distances: np.ndarray) -> np.ndarray:
    """Doubles that are not below the roots."""
    return np.sqrt(distances.astype(np.float64)) * (1 + SLACK)


def below(distances: np.ndarray) -> np.ndarray:
    """Doubles that are not above the roots."""
    return np.sqrt(distances.astype(np.float64)) * (1 - SLACK)


def as_long(value: int) -> int | None:
    """The number, or null beyond 64 bits."""
    return int(value) if -(2**63) <= value < 2**63 else None


def limbs(value: int) -> list[int]:
    """Whole numbers whose separate sums give the sum."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


PARTIAL = "slot int, place int, " + ", ".join(f"limb{i} bigint" for i in range(LIMBS))


def partial_rows(counts: dict[int, list[int]]) -> pa.RecordBatch:
    """A task's sums, slot by slot, in the form of ``PARTIAL``."""
    rows = [(slot, place, *limbs(int(v))) for slot, own in counts.items() for place, v in enumerate(own)]
    columns = list(zip(*rows, strict=True)) or [[]] * (2 + LIMBS)
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * LIMBS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in PARTIAL.split(", ")])


def exact_sums(partials: DataFrame) -> dict[int, dict[int, int]]:
    """Sums by slot and place. Their number is fixed by parameters, so they are small on the driver at any size of table."""
    found = partials.groupBy("slot", "place").agg(*[F.sum(f"limb{i}").alias(f"limb{i}") for i in range(LIMBS)]).collect()
    out: dict[int, dict[int, int]] = {}
    for r in found:
        out.setdefault(r["slot"], {})[r["place"]] = sum(r[f"limb{i}"] << (LIMB * i) for i in range(LIMBS))
    return out


def add_sums(sums: dict[int, list[int]], slots: np.ndarray, points: np.ndarray) -> None:
    """Add the points of each slot, and as a last place their number."""
    for slot in np.unique(slots).tolist():
        own = points[slots == slot]
        new = [*own.sum(axis=0).tolist(), len(own)]
        old = sums.get(slot)
        sums[slot] = new if old is None else [int(a) + int(b) for a, b in zip(old, new, strict=True)]


def averaged(old: list[list[int]], sums: dict[int, dict[int, int]], first: int = 0) -> list[list[int]]:
    """Entries replaced by the floors of their averages; those without points stay. ``first`` is the slot of entry 0."""
    out = []
    for slot, entry in enumerate(old, first):
        own = sums.get(slot)
        out.append([own[i] // own[len(entry)] for i in range(len(entry))] if own else list(entry))
    return out
