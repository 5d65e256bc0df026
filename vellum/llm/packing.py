"""Best-fit packing of documents into sequences, with best-two-fit repair of each bin."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.common import map_rows, quoted, text_of, to_arrow

MODEL = "word_bpe_49k.json"
CACHED_PARTS = 600_000
# Letters, numbers and white space of Latin-1 in lower case, and the vocabulary's pre-tokens over them.
LETTERS, NUMBERS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r\x85\xa0"
PRE_TOKEN = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
WORD_END = "</w>"
#: Documents that are packed together. A group leaves one open bin at most, which is nothing beside so many.
GROUP_DOCS = 200_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids by the tokenizers library, remembered for each pre-token.

    The ids of a text are those of its pre-tokens one after the other. Each of
    them ends in a token with the mark of a word's end; so new ones are encoded
    together, and their ids are cut at these marks. A text with a special
    token, or with characters beyond Latin-1, whose form may depend on others,
    goes to the library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[str, bytes] = {}
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text:
            return self.whole(text)
        parts = PRE_TOKEN.findall(text.lower())
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) >= CACHED_PARTS:
                self.known.clear()
            if not self.learn(list(set(parts).difference(self.known))):
                return self.whole(text)
            found = [self.known[p] for p in parts]
        return b"".join(found)

    def learn(self, new: list[str]) -> bool:
        """Remember the ids of new pre-tokens; false if the library does not end one word for each of them."""
        ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(new):
            return False
        packed = ids.tobytes()
        self.known.update({p: packed[4 * a : 4 * b] for p, a, b in zip(new, [0, *cuts], cuts, strict=False)})
        return True


LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    if path not in LOADED:
        LOADED.clear()
        LOADED[path] = WordIds(path)
    return LOADED[path]


class Unpacked:
    """The pieces that are left, by length; bit n of ``mask`` tells if any has length n."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.capacity = capacity
        self.by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in range(len(lengths) - 1, -1, -1):
            self.by_length[lengths[i]].append(i)
        self.mask = sum(1 << n for n, x in enumerate(self.by_length) if x)
        self.mirror = sum(1 << (capacity - n) for n, x in enumerate(self.by_length) if x)

    def largest(self, at_most: int) -> int:
        """The greatest length that fits, 0 if none does."""
        return (self.mask & ((2 << at_most) - 2)).bit_length() - 1 if at_most > 0 and self.mask & ((2 << at_most) - 2) else 0

    def take(self, length: int) -> int:
        index = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))
        return index

    def give(self, length: int, index: int) -> None:
        self.by_length[length].append(index)
        self.mask |= 1 << length
        self.mirror |= 1 << (self.capacity - length)

    def pair(self, most: int, least: int) -> tuple[int, int] | None:
        """Two lengths with the greatest sum from ``least`` to ``most``."""
        for total in range(most, least - 1, -1):
            both = self.mask & (self.mirror >> (self.capacity - total)) & ((2 << total) - 2)
            if total % 2 == 0 and len(self.by_length[total // 2]) == 1:
                both &= ~(1 << (total // 2))
            if both:
                longer = both.bit_length() - 1
                return longer, total - longer
        return None


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices. Every length lies from 1 to ``capacity``.

    A bin starts with the longest piece and takes the longest that fits, again
    and again. If room is left, its smallest piece goes back in exchange for two
    unpacked ones that leave less room; so long as that helps, it is repeated.
    """
    left = Unpacked(lengths, capacity)
    bins = []
    while first := left.largest(capacity):
        own, room = [(first, left.take(first))], capacity - first
        while fit := left.largest(room):
            own.append((fit, left.take(fit)))
            room -= fit
        while room and len(own) > 1:
            smallest = own[-1][0]
            two = left.pair(room + smallest, smallest + 1)
            if two is None:
                break
            length, index = own.pop()
            own += [(n, left.take(n)) for n in two]
            left.give(length, index)
            room += length - sum(two)
            own.sort(reverse=True)
        bins.append([index for _, index in own])
    return bins


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``capacity``."""
    path = path or public_tokenizers.path(MODEL)
    end = array("I", [end_id]).tobytes()

    def start():
        model = loaded(path)

        def one(doc_id: int | None, text: str) -> Iterator[tuple]:
            ids = model.encode(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)

        return one

    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col))], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", start)


def pack(pieces: DataFrame, *, groups: int, capacity: int = 2048) -> DataFrame:
    """Give every piece a sequence and a place in it; each group is packed on its own."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths, group = table["length"].to_pylist(), table["pack_group"][0].as_py()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, members in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for index in members:
                sequence[index], offset[index] = (group << 32) + number, at
                at += lengths[index]
        out = table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return out.select([f.name for f in to_arrow(PIECE)])

    # Null ids are dealt by their content, so that they don't all meet in one group.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("ids_crc32", "piece")).otherwise(F.xxhash64("doc_id", "piece"))
    group = F.pmod(key, F.lit(groups))
    return pieces.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(one, PIECE)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Null text is empty and becomes the end id alone. Only documents longer than
    a sequence are cut. The number of groups follows the number of documents, so
    a task's memory does not grow with the table; an empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    return pack(token_pieces(docs, id_col=id_col, text_col=text_col, path=path, capacity=capacity, end_id=end_id), groups=groups, capacity=capacity)
