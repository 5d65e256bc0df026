"""Substring deduplication over words, by difference-cover anchors.

Of every document, windows are hashed only where the word's place, modulo a
period, lies in a difference cover. For any two places there is a shift below
the period that brings both onto the cover; so two equal passages of
``window`` words share an equal anchor of ``window - period + 1`` words at the
same distance from their starts. Anchors that occur once are dropped; their
hash only chooses candidates. Each other one extends to the whole windows
around it, which are compared in turn by a digest over digests of their words;
only those that repeat are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.chunks import KEYS, Chunk, Rolling, buckets_for, chunk_table, covered, difference_cover, distinct_keys, each_chunk, key_rows, read_bits, repeated_bits, strong_keys, with_bits
from vellum.llm.common import cut

PERIOD = 21
PLACES = Rolling(0xD6E8FEB86659FD93)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
#: Bytes of a text that are split into words at once.
SPLIT_BYTES = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")
DIGEST_BYTES = 16


def word_lists(data: bytes, start: int, end: int) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    while start < end:
        stop = start + SPLIT_BYTES
        stop = white.start() if stop < end and (white := WHITE.search(data, stop, end)) else end
        yield data[start:stop].split()
        start = stop


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Numbers:
    """A number for each word that only equal words share, and the digest behind it."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.fresh = count()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.setdefault, words, self.fresh), np.int64, len(words))

    def digests(self, numbers: np.ndarray) -> bytes:
        own = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=DIGEST_BYTES).digest() for w in self.known]), f"V{DIGEST_BYTES}")
        held = np.fromiter(self.known.values(), np.int64, len(self.known))
        return own[np.searchsorted(held, numbers)].tobytes()


class Words:
    """The words of a chunk, each as the value that ``of`` gives it, and the first word of each document."""

    def __init__(self, chunk: Chunk, of: Callable[[list[bytes]], np.ndarray]) -> None:
        values, first, total = [], [0], 0
        for a, b in zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist(), strict=True):
            for words in word_lists(chunk.data, a, b):
                values.append(of(words))
                total += len(words)
            first.append(total)
        self.values = np.concatenate(values) if values else np.zeros(0, np.int64)
        self.first = np.array(first)
        self.count = np.diff(self.first)
        self.start = np.repeat(self.first[:-1], self.count)
        self.last = self.start + np.repeat(self.count, self.count)


def anchor_hashes(words: Words, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows have equal hashes; different ones may share one."""
    own = PLACES.spans(PLACES.sums(words.values), at, at + width) if len(at) else np.zeros(0, np.uint64)
    return own, np.zeros(len(own), np.uint32)


def window_keys(chunk: Chunk, marks: list[bytes], width: int) -> tuple[Words, np.ndarray, tuple]:
    """The words, the marked starts, and the keys of the windows from there."""
    numbers = Numbers()
    words = Words(chunk, numbers)
    at = marked(words, marks)
    return words, at, distinct_keys(*strong_keys(numbers.digests(words.values) if len(at) else b"", at, width, DIGEST_BYTES))


def kept_digest(data: bytes, start: int, end: int, stays: np.ndarray | None = None) -> str:
    """SHA-256 of a text's words, or of those that stay, joined by one space."""
    out, at, glue = hashlib.sha256(), 0, b""
    for words in word_lists(data, start, end):
        own = words if stays is None else list(compress(words, stays[at : at + len(words)].tolist()))
        at += len(words)
        if own:
            out.update(glue + b" ".join(own))
            glue = b" "
    return out.hexdigest()


class Anchors:
    """Keys of a chunk's cover places, and the windows that repeated ones extend to."""

    def __init__(self, window: int, period: int) -> None:
        self.window, self.width = window, window - period + 1
        self.on_cover = np.isin(np.arange(period), difference_cover(period))
        self.period = period

    def keys(self, words: Words):
        at = np.arange(len(words.values))
        at = at[self.on_cover[(at - words.start) % self.period] & (at + self.width <= words.last)]
        return at, *distinct_keys(*anchor_hashes(words, at, self.width))

    def candidates(self, words: Words, bits: list[bytes] | None, leading: int) -> np.ndarray:
        """Starts of windows that hold a repeated anchor."""
        at, high, _, times, place = self.keys(words)
        repeated = (read_bits(bits, high, leading) | (times > 1))[place] if len(at) else np.zeros(0, bool)
        at = at[repeated]
        near = covered(len(words.values), np.maximum(at - (self.window - self.width), words.start[at]), at + 1)
        starts = np.flatnonzero(near)
        return starts[starts + self.window <= words.last[starts]]


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, period: int = PERIOD) -> DataFrame:
    """Remove every word in a window of ``window`` words that also starts elsewhere.

    Returns ``doc_id, n_words, n_removed, kept_sha256``, a row for each input
    row. Null text has no words. A text shorter than the window keeps all of its
    words. Repeated rows count as documents of their own, so their windows
    repeat. ``period`` may not exceed ``window``.
    """
    if not 0 < period <= window:
        raise ValueError("period must lie from 1 to window")
    spark = docs.sparkSession
    chunks = chunk_table(docs, id_col=id_col, text_col=text_col)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    anchors = Anchors(window, period)
    share = anchors.on_cover.sum() / period
    leading = buckets_for(int(total / 6 * share), 2 * spark.sparkContext.defaultParallelism)

    def anchor_keys(number: int, chunk: Chunk) -> Iterator[tuple]:
        _, high, low, _, _ = anchors.keys(Words(chunk, word_hashes))
        yield from key_rows(number, high, low, leading)

    first = with_bits(chunks, repeated_bits(each_chunk(chunks, KEYS, anchor_keys)))

    def split(number: int, chunk: Chunk, bits: list[bytes] | None) -> Iterator[tuple]:
        """Results of documents without candidates; the others stay as a smaller chunk."""
        words = Words(chunk, word_hashes)
        starts = anchors.candidates(words, bits, leading)
        busy = np.zeros(len(chunk.ids), bool)
        busy[np.searchsorted(words.first, starts, side="right") - 1] = True
        rows = [(i, n, kept_digest(chunk.data, a, b)) for i, n, a, b, more in zip(chunk.ids, words.count.tolist(), chunk.starts.tolist(), chunk.starts[1:].tolist(), busy.tolist(), strict=False) if not more]
        own = np.flatnonzero(busy)
        texts = [chunk.data[chunk.starts[k] : chunk.starts[k + 1]] for k in own]
        marks = np.zeros(len(words.values), bool)
        marks[starts] = True
        mark = [np.packbits(marks[words.first[k] : words.first[k + 1]]).tobytes() for k in own]
        yield packed(number, [chunk.ids[k] for k in own], texts, mark, rows)

    halves = cut(each_chunk(first, HALF, split, extra=("bits",)))
    done = halves.select(F.explode(F.arrays_zip("done_id", "done_words", "done_sha")).alias("d")).select(F.col("d.done_id").alias("doc_id"), F.col("d.done_words").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.col("d.done_sha").alias("kept_sha256"))
    open_ = halves.filter(F.size("ids") > 0)

    def marked_keys(number: int, chunk: Chunk, marks: list[bytes]) -> Iterator[tuple]:
        _, _, (high, low, _, _) = window_keys(chunk, marks, window)
        yield from key_rows(number, high, low, leading)

    second = with_bits(open_.select("chunk", "ids", "sizes", "body", "marks"), repeated_bits(each_chunk(open_, KEYS, marked_keys, extra=("marks",))))

    def finish(number: int, chunk: Chunk, marks: list[bytes], bits: list[bytes] | None) -> Iterator[tuple]:
        words, starts, (high, _, times, place) = window_keys(chunk, marks, window)
        starts = starts[(read_bits(bits, high, leading) | (times > 1))[place]] if len(starts) else starts
        gone = covered(len(words.values), starts, starts + window)
        for i, a, n, *text in zip(chunk.ids, words.first.tolist(), words.count.tolist(), chunk.starts.tolist(), chunk.starts[1:].tolist(), strict=False):
            stays = ~gone[a : a + n]
            yield i, n, n - int(stays.sum()), kept_digest(chunk.data, *text, stays)

    return done.unionByName(each_chunk(second, RESULT, finish, extra=("marks", "bits")))


HALF = "chunk bigint, ids array<bigint>, sizes array<bigint>, body binary, marks array<binary>, done_id array<bigint>, done_words array<bigint>, done_sha array<string>"


def packed(number: int, ids: list, texts: list[bytes], marks: list[bytes], rows: list[tuple]) -> tuple:
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
    return number, ids, [len(t) for t in texts], body, marks, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def marked(words: Words, marks: list[bytes]) -> np.ndarray:
    """Places of the marked words of a chunk."""
    if not len(words.values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks, words.count.tolist(), strict=True)]))
