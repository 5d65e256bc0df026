"""Substring deduplication over bytes, by suffix sorting with a difference cover.

All suffixes that agree in their first ``length`` bytes must be sorted side by
side, so they are dealt to tasks by a property of those bytes alone: the least
hash among their grams. Where that gram occurs once, the prefix does too, and
the suffix drops out before the sort. Neighbouring suffixes mostly share the
gram and travel as one segment, at the cost of one byte for each and
``length`` for all. A task sorts its suffixes up to the depth (``suffixes``)
and compares neighbours, and answers with one bit for each.

A gram that occurs very often would bring one task too many segments. Suffixes
below such a gram are dealt one by one, by 96 bits of a digest of their whole
prefix, and compared by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.chunks import BITS, BYTE_VALUES, KEYS, Chunk, Rolling, buckets_for, chunk_table, covered, distinct_keys, each_chunk, key_rows, read_bits, repeated_bits, strong_keys, with_bits
from vellum.llm.common import cut, give_back, to_arrow
from vellum.llm.suffixes import repeated_prefixes

LENGTH = 200
#: Occurrences of a gram from which its suffixes are dealt one by one; up to there, its segments take some 30 MB.
HOT_PLACES = 100_000
#: Bytes of segments that a bucket has on average, and that a task sorts at once.
BUCKET_BYTES = 2 << 20
SORTED_BYTES = 1 << 20
LONGEST_RUN = 4096
GRAMS = Rolling(0x9E3779B97F4A7C15)
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
HALF = "chunk bigint, ids array<bigint>, sizes array<bigint>, body binary, runs binary, hot binary, n_hot bigint, done_id array<bigint>, done_bytes array<bigint>, done_sha array<string>"
NONE = np.uint64(2**64 - 1)


def slide(values: np.ndarray, width: int, best: np.ufunc, filler: np.uint64) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, in two running passes over blocks of that width."""
    size = len(values)
    blocks = np.concatenate([values, np.full(-size % width, filler)]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: size - width + 1], ahead[width - 1 : size])


class Minimizers:
    """For every prefix in a chunk the least hash of its grams, and the places where grams are least."""

    def __init__(self, chunk: Chunk, length: int, gram: int) -> None:
        self.data = np.frombuffer(chunk.data, np.uint8)
        size, width = len(self.data), length - gram + 1
        self.least = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        if size < length:
            return
        sums = GRAMS.sums(BYTE_VALUES[self.data])
        starts = np.arange(size - gram + 1)
        hashes = np.minimum(GRAMS.spans(sums, starts, starts + gram), NONE - np.uint64(1)) | np.uint64(1)
        inside = np.ones(size - length + 1, bool)
        for end in chunk.starts[1:-1].tolist():
            inside[max(0, end - length + 1) : end] = False
        self.least = np.where(inside, slide(hashes, width, np.minimum, NONE), np.uint64(0))
        edge = np.zeros(width - 1, np.uint64)
        chosen = slide(np.concatenate([edge, self.least, edge]), width, np.maximum, np.uint64(0)) == hashes
        self.at = np.flatnonzero(chosen)
        self.hashes = hashes[self.at]

    def keys(self):
        return distinct_keys(self.hashes, np.zeros(len(self.hashes), np.uint32))

    def runs(self, repeated: np.ndarray, hot: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start, count and gram of each run of neighbouring suffixes below one repeated gram, and which runs are hot."""
        least = self.least
        if not len(least) or not len(high):
            return np.zeros((0, 3), np.int64), np.zeros(0, bool)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.concatenate([first, [len(least)]]))
        key = least[first]
        place = np.minimum(np.searchsorted(high, key), len(high) - 1)
        keep = (key > 0) & repeated[place]
        first, count, key, hot = first[keep], count[keep], key[keep], hot[place[keep]]
        parts = -(-count // LONGEST_RUN)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count, key, hot = (np.repeat(x, parts) for x in (first, count, key, hot))
        first, count = first + part * LONGEST_RUN, np.minimum(LONGEST_RUN, count - part * LONGEST_RUN)
        return np.stack([first, count, key.view(np.int64)], axis=1), hot


def segments(data: bytes, runs: np.ndarray, length: int, leading: int) -> tuple[list[tuple[int, int, bytes, int]], np.ndarray, np.ndarray]:
    """Distinct segments of a chunk, the number of each run's, and how often each occurs.

    A segment is its bucket, a part of its gram's hash, its bytes and its
    number of suffixes; segments stand in the order of the first two.
    """
    known: dict[bytes, int] = {}
    number = np.empty(len(runs), np.int64)
    of: list[tuple[int, int, bytes, int]] = []
    for k, (first, count, key) in enumerate(runs.tolist()):
        value = data[first : first + count + length - 1]
        found = known.setdefault(value, len(of))
        if found == len(of):
            key &= 2**64 - 1
            of.append((key >> (64 - leading), key >> max(0, 32 - leading) & 0xFFFFFFFF, value, count))
        number[k] = found
    order = sorted(range(len(of)), key=lambda k: of[k][:2])
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))
    number = place[number] if len(of) else number
    return [of[k] for k in order], number, np.bincount(number, minlength=len(of))


def segment_rows(chunk: int, found: list[tuple[int, int, bytes, int]], times: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    packer, at = zstandard.ZstdCompressor(level=3), 0
    while at < len(found):
        end = at
        while end < len(found) and found[end][0] == found[at][0]:
            end += 1
        part = found[at:end]
        head = np.array([len(part), *[c for *_, c in part], *[g for _, g, *_ in part]], "<u4").tobytes() + np.minimum(times[at:end], 2).astype(np.uint8).tobytes()
        yield chunk, part[0][0], head + packer.compress(b"".join([v for _, _, v, _ in part]))
        at = end


def sorted_buckets(keys: DataFrame, length: int) -> DataFrame:
    """For each row of segments, a bit for each of its suffixes: whether its prefix occurs again."""
    schema = to_arrow(BITS)

    def one(table: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        values: list[bytes] = []
        counts: list[int] = []
        grams: list[int] = []
        again: list[bool] = []
        rows: list[list[int]] = []
        for body in table["body"]:
            raw = body.as_py()
            n = int.from_bytes(raw[:4], "little")
            size, gram = (np.frombuffer(raw, "<u4", n, at).tolist() for at in (4, 4 + 4 * n))
            data, at, own = opener.decompress(raw[4 + 9 * n :]), 0, []
            for count, g, t in zip(size, gram, raw[4 + 8 * n : 4 + 9 * n], strict=True):
                value = data[at : at + count + length - 1]
                at += len(value)
                k = known.setdefault(value, len(values))
                if k == len(values):
                    values.append(value)
                    counts.append(count)
                    grams.append(g)
                    again.append(t > 1)
                else:
                    again[k] = True
                own.append(k)
            rows.append(own)
        known.clear()
        of = sorted_segments(values, counts, grams, again, length)
        bits = [np.packbits(np.concatenate([of[k] for k in own])).tobytes() for own in rows]
        give_back()
        return pa.Table.from_arrays([table["chunk"], table["bucket"], pa.array(bits, pa.binary())], schema=schema)

    return keys.groupBy("bucket").applyInArrow(one, BITS)


def sorted_segments(values: list[bytes], counts: list[int], grams: list[int], again: list[bool], length: int) -> list[np.ndarray]:
    """Flags of each distinct segment's suffixes. Segments of one gram are sorted together, others need not be."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(values)
    order = sorted(range(len(values)), key=grams.__getitem__)
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (size < SORTED_BYTES or grams[order[end]] == grams[order[end - 1]]):
            size += len(values[order[end]])
            end += 1
        own = order[at:end]
        count = np.array([counts[k] for k in own])
        ends = np.cumsum(count)
        begin = np.concatenate([[0], np.cumsum(count + length - 1)[:-1]])
        kind = np.int32 if size < 2**31 else np.int64
        starts = np.arange(ends[-1], dtype=kind)
        starts += np.repeat((begin - (ends - count)).astype(kind), count)
        flags = repeated_prefixes(np.frombuffer(b"".join([values[k] for k in own]), np.uint8), starts, length)
        for k, e in zip(own, ends.tolist(), strict=True):
            out[k] = flags[e - counts[k] : e] | again[k]
        at = end
    return out


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, hot_places: int = HOT_PLACES) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts elsewhere.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, a row for each
    input row. Null text is empty. A text shorter than ``length`` is kept whole.
    Repeated rows count as documents of their own, so each repeats the other.
    """
    gram = gram or max(1, length * 2 // 5)
    chunks = chunk_table(docs, id_col=id_col, text_col=text_col)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    least = 2 * docs.sparkSession.sparkContext.defaultParallelism
    of_grams = buckets_for(2 * total // (length - gram + 2), least)
    of_segments = max(1, max(least, total // BUCKET_BYTES).bit_length())

    def gram_keys(number: int, chunk: Chunk) -> Iterator[tuple]:
        high, _, times, _ = Minimizers(chunk, length, gram).keys()
        yield from key_rows(number, high, times.astype(np.uint32), of_grams)

    first = with_bits(chunks, repeated_bits(each_chunk(chunks, KEYS, gram_keys), hot=hot_places))

    def split(number: int, chunk: Chunk, bits: list[bytes] | None) -> Iterator[tuple]:
        """Results of documents without a repeated gram; the others stay as a smaller chunk with their runs."""
        grams = Minimizers(chunk, length, gram)
        high, _, times, _ = grams.keys()
        repeated, hot = read_bits(bits, high, of_grams, sets=2)
        runs, single = grams.runs(repeated | (times > 1), hot, high)
        doc = np.searchsorted(chunk.starts, runs[:, 0], side="right") - 1
        busy = np.zeros(len(chunk.ids), bool)
        busy[doc] = True
        sizes = np.diff(chunk.starts)
        runs[:, 0] -= np.cumsum(np.where(busy, 0, sizes))[doc]  # what is left out before a document
        texts = [chunk.data[chunk.starts[k] : chunk.starts[k + 1]] for k in range(len(chunk.ids))]
        own, done = np.flatnonzero(busy), np.flatnonzero(~busy)
        packer = zstandard.ZstdCompressor(level=3)
        yield (
            number,
            [chunk.ids[k] for k in own],
            sizes[own].tolist(),
            packer.compress(b"".join([texts[k] for k in own])),
            packer.compress(runs[~single].astype("<i8").tobytes()),
            packer.compress(runs[single].astype("<i8").tobytes()),
            int(runs[single, 1].sum()),
            [chunk.ids[k] for k in done],
            sizes[done].tolist(),
            [hashlib.sha256(texts[k]).hexdigest() for k in done],
        )

    halves = cut(each_chunk(first, HALF, split, extra=("bits",)))
    zero = F.lit(0).cast("bigint")
    done = halves.select(F.explode(F.arrays_zip("done_id", "done_bytes", "done_sha")).alias("d")).select(F.col("d.done_id").alias("doc_id"), F.col("d.done_bytes").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("d.done_sha").alias("kept_sha256"))
    open_ = halves.filter(F.size("ids") > 0).select("chunk", "ids", "sizes", "body", "runs", "hot")
    hot_suffixes = halves.agg(F.sum("n_hot")).first()[0] or 0
    of_prefixes = buckets_for(hot_suffixes, least)

    def unpacked(runs: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(runs), "<i8").reshape(-1, 3)

    def suffix_keys(number: int, chunk: Chunk, runs: bytes) -> Iterator[tuple]:
        found, _, times = segments(chunk.data, unpacked(runs), length, of_segments)
        yield from segment_rows(number, found, times)

    def prefix_keys(number: int, chunk: Chunk, hot: bytes) -> Iterator[tuple]:
        high, low, _, _ = distinct_keys(*strong_keys(chunk.data, expanded(unpacked(hot)), length))
        yield from key_rows(number, high, low, of_prefixes)

    second = with_bits(open_, sorted_buckets(each_chunk(open_, KEYS, suffix_keys, extra=("runs",)), length))
    if hot_suffixes:
        second = with_bits(second.withColumnRenamed("bits", "own_bits"), repeated_bits(each_chunk(open_, KEYS, prefix_keys, extra=("hot",)))).withColumnsRenamed({"bits": "hot_bits", "own_bits": "bits"})
    else:
        second = second.withColumn("hot_bits", F.lit(None).cast("array<binary>"))

    def finish(number: int, chunk: Chunk, runs: bytes, bits: list[bytes], hot: bytes, hot_bits: list[bytes]) -> Iterator[tuple]:
        spans, singles = unpacked(runs), expanded(unpacked(hot))
        found, number_of, _ = segments(chunk.data, spans, length, of_segments)
        flags = suffix_flags(found, bits)
        ends = np.cumsum([c for *_, c in found])
        starts = [s + np.flatnonzero(flags[ends[k] - c : ends[k]]) for (s, c, _), k in zip(spans.tolist(), number_of.tolist(), strict=True)]
        if len(singles):
            high, _, times, place = distinct_keys(*strong_keys(chunk.data, singles, length))
            starts.append(singles[(read_bits(hot_bits, high, of_prefixes) | (times > 1))[place]])
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        gone = covered(len(chunk.data), at, at + length)
        data = np.frombuffer(chunk.data, np.uint8)
        for i, a, b in zip(chunk.ids, chunk.starts.tolist(), chunk.starts[1:].tolist(), strict=False):
            own = gone[a:b]
            spans_of = int(own[:1].sum() + np.count_nonzero(own[1:] & ~own[:-1]))
            yield i, b - a, int(own.sum()), spans_of, hashlib.sha256(data[a:b][~own].tobytes()).hexdigest()

    return done.unionByName(each_chunk(second, RESULT, finish, extra=("runs", "bits", "hot", "hot_bits")))


def expanded(runs: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of the runs."""
    count = runs[:, 1]
    return np.repeat(runs[:, 0] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def suffix_flags(found: list[tuple[int, int, bytes, int]], bits: list[bytes] | None) -> np.ndarray:
    """The bits of a chunk's distinct segments, bucket by bucket."""
    sizes: dict[int, int] = {}
    for bucket, _, _, count in found:
        sizes[bucket] = sizes.get(bucket, 0) + count
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(bits or [], sizes.values(), strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
