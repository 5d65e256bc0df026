"""Cost-balanced packing: sequences of one length whose attention cost is about the same."""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_rows, quoted, text_of, to_arrow
from vellum.llm.packing import MODEL, loaded

#: Pieces that are packed together. Each carries two bytes a token, so a group has at most 67 MB at 2,048 tokens.
GROUP_PIECES = 16_384
#: Width of the model whose cost is estimated: for each layer, work outside attention grows with 6 * WIDTH for each unit of attention's n * n.
WIDTH = 1_024
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECE}, sequence_id bigint, offset bigint"
NONE = (float("inf"), -1)


def cost(length: int, width: int = WIDTH) -> int:
    """Estimated work for a piece: a linear part and attention of each token to the piece's own tokens."""
    return 6 * width * length + length * length


class Open:
    """Sequences by the room that is left, in a tree of least costs: the cheapest with enough room is found in the tree's depth."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.least: list[tuple] = [NONE] * (2 * self.size)

    def changed(self, room: int) -> None:
        heap, least, i = self.heaps[room], self.least, room + self.size
        least[i] = heap[0] if heap else NONE
        i >>= 1
        while i:
            a, b = least[2 * i], least[2 * i + 1]
            new = a if a <= b else b
            if new == least[i]:
                return
            least[i] = new
            i >>= 1

    def add(self, room: int, spent: int, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (spent, sequence))
        self.changed(room)

    def cheapest(self, at_least: int) -> tuple:
        """Cost and number of the cheapest sequence with so much room; number -1 if there is none."""
        least, best, low, high = self.least, NONE, at_least + self.size, 2 * self.size
        while low < high:
            if low & 1:
                best = min(best, least[low])
                low += 1
            low >>= 1
            high >>= 1
        return best

    def take(self, room: int) -> None:
        heapq.heappop(self.heaps[room])
        self.changed(room)


def capacities(tokens: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold just so many tokens: full ones, then powers of two, which need no padding."""
    full, rest = divmod(tokens, capacity)
    powers = [1 << n for n in range(rest.bit_length() - 1, -1, -1) if rest >> n & 1]
    return [capacity] * full + powers


def balanced(lengths: list[int], capacity: int, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """``(piece, place in it, length, sequence, offset)`` for pieces in descending order of length.

    Each piece, and so the costliest first, goes to the cheapest sequence that
    can take it whole. Where none can, the cheapest with any room takes as much
    as fits, and the rest waits for its turn among the others. The sequences
    have room for exactly what there is, so all get full. A sequence shorter
    than the capacity counts as if what it lacks had been spent.
    """
    sizes = capacities(sum(lengths), capacity)
    tree, left, used = Open(capacity), list(sizes), [0] * len(sizes)
    for sequence, size in enumerate(sizes):
        tree.add(size, 6 * width * (capacity - size), sequence)
    out, rests, at = [], [], 0
    while at < len(lengths) or rests:
        if rests and (at == len(lengths) or -rests[0][0] > lengths[at]):
            length, piece, start = heapq.heappop(rests)
            length = -length
        else:
            length, piece, start = lengths[at], at, 0
            at += 1
        spent, sequence = tree.cheapest(length)
        if sequence < 0:
            spent, sequence = tree.cheapest(1)
        room = left[sequence]
        part = min(length, room)
        tree.take(room)
        left[sequence] = room - part
        if room > part:
            tree.add(room - part, spent + cost(part, width), sequence)
        out.append((piece, start, part, sequence, used[sequence]))
        used[sequence] += part
        if part < length:
            heapq.heappush(rests, (part - length, piece, start + part))
    return out


def token_parts(docs: DataFrame, *, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and the end id: full sequences without ids, as nothing can be cut there, and the rest with them."""
    end = array("I", [end_id]).tobytes()

    def start():
        model = loaded(path)
        kind = "<u2" if max(len(model.ends), end_id + 1) <= 1 << 16 else "<u4"

        def one(doc_id: int | None, text: str) -> Iterator[tuple]:
            ids = model.encode(text) + end
            tokens = len(ids) // 4
            for at in range(0, tokens, capacity):
                part = ids[4 * at : 4 * (at + capacity)]
                length = len(part) // 4
                yield doc_id, at, length, zlib.crc32(part), tokens, None if length == capacity else np.frombuffer(part, "<u4").astype(kind).tobytes()

        return one

    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col))], f"{PIECE}, ids binary", start)


def pack_balanced(parts: DataFrame, *, groups: int, capacity: int, width: int) -> DataFrame:
    """Give all tokens of the pieces a sequence and a place in it; each group is packed on its own."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        docs, starts, lengths, sums, tokens = (table[c].to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
        ids, first = table["ids"], table["pack_group"][0].as_py() << 32
        full = next((i for i, n in enumerate(lengths) if n < capacity), len(lengths))
        rows = [(docs[i], starts[i], capacity, sums[i], tokens[i], first + i, 0) for i in range(full)]
        for piece, start, length, sequence, offset in balanced(lengths[full:], capacity, width):
            i = full + piece
            crc = sums[i]
            if length < lengths[i]:
                own = ids[i].as_buffer()
                crc = zlib.crc32(np.frombuffer(own, f"<u{own.size // lengths[i]}")[start : start + length].astype("<u4").tobytes())
            rows.append((docs[i], starts[i] + start, length, crc, tokens[i], first + full + sequence, offset))
        columns = zip(*rows, strict=True)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=to_arrow(PACKED))

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))
    return parts.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(one, PACKED)


def pack_by_cost(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 1, width: int = WIDTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens with balanced cost and no padding.

    A document is cut where it is longer than a sequence, and where no sequence
    of its group has room for it whole. A group's last sequences are as long as
    powers of two. Null text is empty and becomes the end id alone; null and
    repeated ids are packed as any other, and so are extra columns, which are
    not returned. An empty table gives no rows.

    The number of groups follows the table's bytes, with which pieces and their
    ids grow, so a task's memory does not. Rows are dealt by what they hold,
    never by their place, so a task that runs again deals them alike.
    """
    path = path or public_tokenizers.path(MODEL)
    pieces = docs.agg(F.sum(1 + F.floor(F.octet_length(text_of(quoted(text_col))) / capacity))).first()[0] or 0
    parts = token_parts(docs, id_col=id_col, text_col=text_col, path=path, capacity=capacity, end_id=end_id)
    return pack_balanced(parts, groups=max(1, -(-pieces // group_pieces)), capacity=capacity, width=width)
