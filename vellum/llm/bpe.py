"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A sequence of tokens is the result of the merges exactly if every neighbouring
pair is: joined and merged again, the pair comes out as it went in. The encoder
walks from left to right, takes the longest token that starts at its place and
fits the token before it, falls back to the token's own prefixes, and steps
back once none fits. A place it has stepped back from is closed for good, so
each is left at most once and the time is linear in the text.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_rows, quoted, text_of

CACHED_PIECES = 300_000
CACHED_PAIRS = 1_000_000
MODEL = "byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        plain = {bytes(alphabet[c] for c in shown): i for shown, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*plain.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for value, i in plain.items():
            self.bytes_of[i] = value
        for value, i in self.special.items():
            self.bytes_of[i] = value.encode()
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.joined[pair] = whole
            self.halves[whole] = pair
        self.prefix = {i: next((plain[v[:k]] for k in range(len(v) - 1, 0, -1) if v[:k] in plain), -1) for v, i in plain.items()}
        self.matches = ahocorasick.Automaton()
        for value, i in plain.items():
            self.matches.add_word(value.decode("latin-1"), i)
        self.matches.make_automaton()
        self.pieces = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.known_pieces: dict[str, bytes] = {}
        lengths = np.array([len(v) for v in self.bytes_of], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, put side by side, stay as they are."""
        key = (left, right)
        found = self.known_pairs.get(key)
        if found is None:
            if len(self.known_pairs) >= CACHED_PAIRS:
                self.known_pairs.clear()
            found = self.known_pairs[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' last merges, step by step.

        At each step the two parts that touch must not merge earlier than what
        was undone; ids rise in the order of the merges. Of equal ranks the
        left one goes first.
        """
        below = self.size
        while True:
            if self.joined.get((left, right), below) < below:
                return False
            if left > right and left in self.halves:
                below, left = left, self.halves[left][1]
            elif right in self.halves:
                below, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                below, left = left, self.halves[left][1]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The merges of one pre-token."""
        size = len(piece)
        longest = [0] * size
        length = self.bytes_of
        for end, token in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - len(length[token])] = token  # a later end is a longer token
        closed = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(length[token])
            if not closed[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest[at]
            elif (shorter := self.prefix[token]) >= 0:
                token = shorter
            else:
                closed[at] = 1
                token = out.pop()
                at -= len(length[token])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.specials.split(text) if self.specials else [text]
        known, out = self.known_pieces, []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            for piece in self.pieces.findall(part):
                ids = known.get(piece)
                if ids is None:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    ids = array("I", self.encode_piece(piece.encode())).tobytes()
                    if len(piece) <= 64:
                        known[piece] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, gathered from the vocabulary's bytes by offset."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        return self.blob[at].tobytes().decode("utf-8", "replace")


LOADED: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """The vocabulary, read once for each worker process."""
    if path not in LOADED:
        LOADED.clear()
        LOADED[path] = BytePairs(path)
    return LOADED[path]


def bpe_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token count of each text, and digests of its ids and of the text decoded from them.

    Null text counts as empty: no tokens. The vocabulary's special strings are
    encoded as their own ids wherever they stand in a text.
    """
    path = path or public_tokenizers.path(MODEL)

    def start():
        pairs = loaded(path)

        def one(doc_id: int | None, text: str) -> Iterator[tuple]:
            ids = pairs.encode(text)
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(pairs.decode(ids).encode()).hexdigest()

        return one

    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col))], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)


def bpe_encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids of each text as an array."""
    path = path or public_tokenizers.path(MODEL)

    def start():
        pairs = loaded(path)

        def one(doc_id: int | None, text: str) -> Iterator[tuple]:
            yield doc_id, np.frombuffer(pairs.encode(text), "<u4").tolist()

        return one

    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col))], "doc_id bigint, ids array<bigint>", start)


def bpe_decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of arrays of ids; null is read as no ids."""
    path = path or public_tokenizers.path(MODEL)

    def start():
        pairs = loaded(path)

        def one(doc_id: int | None, ids: list[int] | None) -> Iterator[tuple]:
            yield doc_id, pairs.decode(array("I", ids or []).tobytes())

        return one

    return map_rows(encoded, [F.col(quoted(id_col)).cast("bigint"), F.col(quoted(ids_col))], "doc_id bigint, text string", start)
