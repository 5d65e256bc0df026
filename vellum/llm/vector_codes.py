"""Vector codes: each part of a vector by its nearest codebook entry, found in a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.clustering import Stored, kept_rows
from vellum.llm.common import cut, give_back, join_by_size, quoted
from vellum.llm.points import PARTIAL, above, add_sums, as_long, averaged, below, decode, entries, exact_sums, partial_rows, squared, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries below a node that are compared one by one.
LEAF = 8


class Vantage:
    """A tree over a codebook's entries.

    An inner node has one entry and two children, the nearer and the farther
    half of the others, each with the range of its entries' distances from it.
    Ranges are rounded outwards.
    """

    def __init__(self, at: np.ndarray, members: np.ndarray) -> None:
        self.members, self.children = members, []
        if len(members) <= LEAF:
            return
        # The entry farthest from the first one parts the others well.
        self.entry = int(members[squared(at[members], at[members[0]]).argmax()])
        others = members[members != self.entry]
        apart = squared(at[others], at[self.entry])
        order = np.argsort(apart, kind="stable")
        middle = len(order) // 2
        self.border = apart[order[middle]]
        for some in (order[:middle], order[middle:]):
            own = apart[some]
            self.children.append((Vantage(at, np.sort(others[some])), float(below(own.min(keepdims=True))[0]), float(above(own.max(keepdims=True))[0])))


class Codebook:
    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.at = entries(rows, width)
        self.root = Vantage(self.at, np.arange(len(rows)))

    def search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each point, the lowest of equal ones, its squared distance, and how many were compared.

        Branch and bound: a child is left out only if the triangle inequality
        puts all of it truly farther than the best so far, and so an entry that
        is as near is always compared. What decides are whole numbers.
        """
        points = whole(values, self.at)
        best = squared(points, self.at[0]) if len(points) else np.zeros(0, np.int64)
        index = np.zeros(len(points), np.int64)
        compared = len(points)

        def better(rows: np.ndarray, found: np.ndarray, which: np.ndarray | int) -> None:
            wins = ((found < best[rows]) | ((found == best[rows]) & (which < index[rows]))).astype(bool)
            won = rows[wins]
            best[won] = found[wins]
            index[won] = which[wins] if isinstance(which, np.ndarray) else which

        def may_hold(rows: np.ndarray, near: np.ndarray, far: np.ndarray, low: float, high: float) -> np.ndarray:
            return np.maximum(near - high, low - far) <= above(best[rows])

        def visit(node: Vantage, rows: np.ndarray) -> None:
            nonlocal compared
            if not len(rows):
                return
            if not node.children:
                found = squared(points[rows][:, None, :], self.at[node.members][None, :, :])
                least = found.argmin(axis=1)  # the first of equal ones, and members ascend
                compared += found.size
                better(rows, found[np.arange(len(rows)), least], node.members[least])
                return
            found = squared(points[rows], self.at[node.entry])
            compared += len(rows)
            better(rows, found, node.entry)
            near, far, inner = below(found), above(found), (found < node.border).astype(bool)
            # First the child on whose side a point lies, which mostly lowers its bound; then the other, if it still may hold more.
            for own in (True, False):
                for (child, low, high), inside in zip(node.children, (True, False), strict=True):
                    side = np.flatnonzero(inner == (inside == own))
                    side = side[may_hold(rows[side], near[side], far[side], low, high)]
                    visit(child, rows[side])

        visit(self.root, np.arange(len(points)))
        return index, best, compared


def codes(values: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, list, int]:
    """Entry numbers by part, squared distances by part, and how many entries were compared."""
    width = values.shape[1] // len(books)
    numbers, distances, compared = np.empty((len(values), len(books)), np.int64), [], 0
    for part, book in enumerate(books):
        numbers[:, part], best, n = book.search(values[:, part * width : (part + 1) * width])
        distances.append(best)
        compared += n
    return numbers, distances, compared


def first_entries(rows: DataFrame, single: bool, dimension: int | None, parts: int, scale: int, count: int) -> tuple[int, list[list[int]]]:
    """The kept vectors with the smallest ids, null ids last, equal ids by their components; and their dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [n for n in pc.unique(pc.list_value_length(batch.column(1))).to_pylist() if n and n % parts == 0]
            for length in lengths if dimension is None else [dimension]:
                kept, values = decode(batch.column(1), length, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array([length] * len(kept), pa.int32()), pa.array(Stored(single, length, scale).write(values), pa.binary())], names=["vec_id", "n", "point"])

    found = rows.mapInArrow(run, "vec_id bigint, n int, point binary").orderBy(F.col("vec_id").asc_nulls_last(), "point").limit(count).collect()
    if dimension is None and len({r["n"] for r in found}) > 1:
        return first_entries(rows, single, found[0]["n"], parts, scale, count)
    return (found[0]["n"] if found else 0), [[int(x) for x in Stored(single, r["n"], scale).read([r["point"]])[0]] for r in found]


def entry_sums(rows: DataFrame, books: list[list[list[int]]], dimension: int, scale: int) -> DataFrame:
    """Each task's exact sums by part and entry."""
    size, width = len(books[0]), dimension // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums = [Codebook(b, width) for b in books], {}
        for batch in batches:
            _, values = decode(batch.column(1), dimension, scale)
            numbers, _, _ = codes(values, trees)
            for part in range(len(trees)):
                add_sums(sums, part * size + numbers[:, part], whole(values[:, part * width : (part + 1) * width]))
            del batch, values, numbers
            give_back()
        yield partial_rows(sums)

    return rows.mapInArrow(run, PARTIAL)


def encoded(rows: DataFrame, books: list[list[list[int]]], dimension: int, scale: int) -> DataFrame:
    """``vec_id, code, error, label_key`` of the kept vectors."""
    width = dimension // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(b, width) for b in books]
        for batch in batches:
            kept, values = decode(batch.column(1), dimension, scale)
            numbers, distances, _ = codes(values, trees)
            errors = [as_long(sum(own)) for own in zip(*(d.tolist() for d in distances), strict=True)]
            names = [row.tobytes().hex() for row in numbers.astype(np.uint8)]
            places = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), pa.array(names, pa.string()), pa.array(errors, pa.int64()), batch.column(2).take(places)], names=["vec_id", "code", "error", "label_key"])
            del batch, values, numbers, distances
            give_back()

    return rows.mapInArrow(run, "vec_id bigint, code string, error bigint, label_key string")


def compress_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dimension: int | None = None, parts: int = PARTS, count: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector.

    Dropped are null vectors and those with a component that is null or
    non-finite (or beyond single precision). All must have one ``dimension``,
    a multiple of ``parts``: without one given it is that of the kept vector
    with the smallest id, and vectors of other lengths are dropped. With fewer
    vectors than entries, codebooks are smaller; with none, or an empty table,
    there are no rows. Rows with null or repeated ids are rows as any other;
    null ids come last among the first entries. Ties go to the lower entry. An
    error beyond 64 bits is null, and so is its label's sum. Extra columns are
    not read.

    Each round is one pass over the vectors. A task hands on sums for each entry
    and nothing for each vector; what the driver holds is fixed by the parameters.
    """
    label = F.col(quoted(label_col))
    labels = F.when(label.isNull(), "-").otherwise(F.concat(F.lit("="), label.cast("string")))  # nulls are equal, and like no other
    rows, single = kept_rows(vectors, id_col, vector_col, labels.alias("label_key"))
    own = rows.select("vec_id", "embedding")
    dimension, first = first_entries(own, single, dimension, parts, scale, count)
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = dimension // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        sums = exact_sums(entry_sums(own, books, dimension, scale))
        books = [averaged(book, sums, first=p * len(first)) for p, book in enumerate(books)]
    found = cut(encoded(rows, books, dimension, scale))
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)")))
    facts = cut(found.groupBy("label_key").agg(total.alias("total"), F.count(F.lit(1)).alias("n_rows")))
    longest = F.lit(2**63 - 1).cast("decimal(38,0)")
    facts = facts.select("label_key", F.when(F.col("total") <= longest, F.col("total")).cast("bigint").alias("label_error"), "n_rows")
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return join_by_size(found, facts, ["label_key"], "n_rows").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
