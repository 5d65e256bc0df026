"""Chunks of whole documents, and the search for keys that repeat between chunks.

A chunk holds a few megabytes of complete texts, compressed. Substring
operators derive sorted, distinct keys from a chunk, deal them by their leading
bits into buckets, and get back one bit for each key: whether any other chunk
has it too. So a passage that stands in a third of all documents costs one key
for each chunk and not one for each place, and no place has to travel: a chunk
derives the same keys again and reads the bits in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, give_back, quoted, to_arrow

CHUNK_BYTES = 2 << 20
KEYS_PER_BUCKET = 400_000
CHUNKS = "chunk bigint, ids array<bigint>, sizes array<bigint>, body binary, n_bytes bigint"
KEYS = "chunk bigint, bucket bigint, body binary"
BITS = "chunk bigint, bucket bigint, bits binary"
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


@dataclass
class Chunk:
    """Texts end to end; ``starts`` has one bound more than there are documents."""

    ids: list[int | None]
    starts: np.ndarray
    data: bytes


def chunk_table(docs: DataFrame, *, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of about ``chunk_bytes``; a longer document is a chunk of its own. Null text is empty."""
    chosen = docs.select(F.col(quoted(id_col)).cast("bigint").alias("i"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("t"))
    schema = to_arrow(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, ids, parts, size = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, [], [], 0

        def full() -> pa.RecordBatch:
            row = [[number], [ids], [[len(p) for p in parts]], [packer.compress(b"".join(parts))], [size]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_py().encode()
                if ids and size + len(raw) > chunk_bytes:
                    yield full()
                    number, ids, parts, size = number + 1, [], [], 0
                ids.append(i)
                parts.append(raw)
                size += len(raw)
        if ids:
            yield full()

    return cut(chosen.mapInArrow(run, CHUNKS))


def opened(ids: list, sizes: list, body: bytes) -> Chunk:
    return Chunk(ids, np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]), zstandard.ZstdDecompressor().decompress(body))


def buckets_for(total_keys: int, least: int) -> int:
    """Leading bits of a key that name its bucket."""
    return max(least, -(-total_keys // KEYS_PER_BUCKET)).bit_length()


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values, by significance, so that the leading zeros of small ones are runs."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def from_planes(raw: memoryview, kind: np.dtype, count: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, count).T).view(kind).ravel()


def distinct_keys(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs, and for each given key its place among them."""
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(h) else np.zeros(0, bool)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    return h[first], w[first], np.bincount(place, minlength=int(first.sum())), place


def key_rows(chunk: int, high: np.ndarray, low: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted distinct keys as rows of ``KEYS``; a chunk without keys has none."""
    bucket = (high >> np.uint64(64 - bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(high)] if len(high) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        step = np.diff(high[a:b], prepend=high[a : a + 1])
        yield chunk, int(bucket[a]), np.array([high[a]], "<u8").tobytes() + planes(step) + planes(low[a:b])


def repeated_bits(keys: DataFrame, hot: int | None = None) -> DataFrame:
    """For each row of keys, a bit for each key: whether another chunk has it.

    With ``hot``, the low parts are not of the keys but say how often each
    occurs in its chunk, and as many bits follow that tell whether it occurs so
    often in all.
    """
    schema = to_arrow(BITS)
    record = 12

    def one(table: pa.Table) -> pa.Table:
        bits = bucket_bits([memoryview(body.as_buffer()) for body in table["body"]], record, hot)
        out = pa.Table.from_arrays([table["chunk"], table["bucket"], pa.array(bits, pa.binary())], schema=schema)
        del bits
        give_back()
        return out

    return keys.groupBy("bucket").applyInArrow(one, BITS)


def bucket_bits(bodies: list[memoryview], record: int, hot: int | None) -> list[bytes]:
    sizes = [(len(raw) - 8) // record for raw in bodies]
    ends = np.cumsum(sizes)
    high, low = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
    for raw, n, e in zip(bodies, sizes, ends.tolist(), strict=True):
        high[e - n : e] = np.cumsum(from_planes(raw[8 : 8 + 8 * n], np.dtype("<u8"), n), dtype=np.uint64) + np.frombuffer(raw[:8], "<u8")
        low[e - n : e] = from_planes(raw[8 + 8 * n :], np.dtype("<u4"), n)
    order = (np.argsort(high) if hot is not None else np.lexsort((low, high))).astype(np.uint32)
    high, low = high[order], low[order]
    differ = high[1:] != high[:-1]
    if hot is None:
        differ |= low[1:] != low[:-1]
    new = np.flatnonzero(np.concatenate([[True], differ]))
    own = np.diff(new, append=len(order))

    def spread(group: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), bool)
        out[order] = np.repeat(group, own)
        return out

    sets = [spread(own > 1)]
    if hot is not None:
        sets.append(spread(np.add.reduceat(low.astype(np.uint64), new) >= hot))
    return [np.packbits(np.concatenate([x[e - n : e] for x in sets])).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]


def with_bits(chunks: DataFrame, bits: DataFrame) -> DataFrame:
    """The chunks, each with its bits in the order of the buckets (null if it has no keys)."""
    gathered = bits.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("found")).select("chunk", F.col("found.bits").alias("bits"))
    return chunks.join(gathered, "chunk", "left")


def read_bits(bits: list[bytes] | None, high: np.ndarray, leading: int, sets: int = 1) -> np.ndarray:
    """The bits of a chunk's sorted distinct keys; with more than one set, a row for each."""
    if not len(high):
        return np.zeros((sets, 0), bool) if sets > 1 else np.zeros(0, bool)
    bucket = high >> np.uint64(64 - leading)
    _, counts = np.unique(bucket, return_counts=True)
    found = [np.unpackbits(np.frombuffer(b, np.uint8), count=sets * n).reshape(sets, n) for b, n in zip(bits, counts.tolist(), strict=True)]
    out = np.concatenate(found, axis=1).astype(bool)
    return out if sets > 1 else out[0]


def each_chunk(chunks: DataFrame, schema: str, one: Callable[..., Iterator[tuple]], extra: tuple[str, ...] = ()) -> DataFrame:
    """Run ``one(number, chunk, *extra)`` over chunks; it yields rows of ``schema``."""
    out_schema = to_arrow(schema)
    names = ["chunk", "ids", "sizes", "body", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, ids, sizes, body, *more = (batch.column(n)[k].as_py() for n in range(len(names)))
                rows, weight = [], 0
                for row in one(number, opened(ids, sizes, body), *more):
                    rows.append(row)
                    weight += 64 + sum(len(x) for x in row if isinstance(x, bytes))
                    if weight > 8 << 20:
                        yield as_batch(rows, out_schema)
                        rows, weight = [], 0
                if rows:
                    yield as_batch(rows, out_schema)
                del rows
                give_back()

    return chunks.select(*names).mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Rolling:
    """Polynomial hashes of all windows of a sequence, modulo 2**64, mixed at the end."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            n = max(size, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:size], self.down[:size]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers(len(values))[0], dtype=np.uint64)])

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.powers(len(sums))[1][starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def strong_keys(data: bytes | memoryview, starts: np.ndarray, size: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the XXH3-128 digest of ``size`` items of ``step`` bytes from each start."""
    view, digest, width = memoryview(data), xxhash.xxh3_128_digest, size * step
    high, low = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint32)
    for at in range(0, len(starts), 1 << 16):
        some = (starts[at : at + (1 << 16)] * step).tolist()
        found = np.frombuffer(b"".join([digest(view[a : a + width]) for a in some]), ">u8").reshape(-1, 2)
        high[at : at + len(some)], low[at : at + len(some)] = found[:, 0], found[:, 1] >> np.uint64(32)
    return high, low


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in any of the given spans."""
    edges = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(edges)[:size] > 0


def difference_cover(period: int) -> list[int]:
    """A least set of residues, 0 among them, whose differences give every residue of ``period``."""
    from itertools import combinations

    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            own = (0, *rest)
            if len({(a - b) % period for a in own for b in own}) == period:
                return list(own)
        size += 1
