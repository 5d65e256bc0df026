"""Quality rules: base counts, and divergence from language references that are learned from the table."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, give_back, map_rows, quoted, text_of, to_arrow

#: A word is common in a language if it is at least one of so many of its words.
WORD_SHARE = 200
#: Rows with its label that a language needs for a reference, and languages that have one at most: those with the most rows.
LANG_ROWS = 20
MOST_LANGS = 1000
#: Counters of a task's summary for each language, and entries of all languages together at which one is cut down to them.
COUNTERS = 4 * WORD_SHARE
MOST_ENTRIES = 1_000_000
LETTER = re.compile(rb"[a-z\x80-\xff]")
# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "wide")


def class_table() -> np.ndarray:
    """For each byte its character class; continuation bytes have none (-1)."""
    table = np.full(256, -1)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b] = 7
        elif b < 0x80:
            table[b] = 3 if b in SPACES else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 6 if b < 0x20 or b == 0x7F else 4 if c in ".,;:!?'\"()-" else 5
    return table


CLASS_OF = class_table()
CLASS_MATRIX = np.array([(CLASS_OF == k) for k in range(len(CLASSES))], dtype=np.int64)


def histograms(raw: bytes) -> tuple[np.ndarray, list[bytes], Counter]:
    """Byte counts, words as they stand, and counts of the lower-cased words."""
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return bytes_of, raw.split(), Counter(raw.lower().split())


def word_histogram(counts: Counter, vocabulary: list[bytes]) -> np.ndarray:
    """Counts of the common words, and of all others last."""
    known = [counts.get(w, 0) for w in vocabulary]
    return np.array([*known, counts.total() - sum(known)], dtype=np.float64)


def ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs at least twice.

    Words become numbers below the text's length, and windows numbers in turn,
    one word longer in each step; they are named anew where they outgrow 64 bits.
    """
    size = len(words)
    if size <= width:
        return 0
    known: dict[bytes, int] = {}
    numbers = np.fromiter(map(known.setdefault, words, count()), np.uint64, size)
    keys, bound = numbers, size
    for k in range(1, width):
        if bound * size >= 1 << 64:
            keys, bound = ranked(keys), size
        keys, bound = keys[: size - k] * np.uint64(size) + numbers[k:], bound * size
    in_order = np.sort(keys)
    again = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(keys, again))
    return int(np.minimum(np.diff(starts, append=starts[-1] + width), width).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def distances(own: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``own`` from the same row of ``refs``; 1 where a side is empty."""
    sums, ref_sums = own.sum(axis=1, keepdims=True), refs.sum(axis=1, keepdims=True)
    empty = (sums == 0) | (ref_sums == 0)
    p, q = own / np.where(sums == 0, 1, sums), refs / np.where(ref_sums == 0, 1, ref_sums)
    m = (p + q) / 2
    m[m == 0] = 1
    total = (p * np.log2(np.where(p > 0, p / m, 1)) + q * np.log2(np.where(q > 0, q / m, 1))).sum(axis=1)
    return np.where(empty[:, 0], 1.0, np.sqrt(np.maximum(0, total / 2)))


@dataclass
class References:
    """Character classes, common words and their counts of each language; its size is bounded by the shares that both need."""

    languages: list[str]
    chars: np.ndarray
    vocabularies: list[list[bytes]]
    words: np.ndarray
    #: Distance of a text without any common word; 0 for a language that has none.
    without: np.ndarray
    #: Whether there are languages with enough rows that have no reference, as there are too many.
    more: bool

    @classmethod
    def of(cls, chars: dict[str, np.ndarray], words: dict[str, dict[bytes, int]], totals: dict[str, int], more: bool = False) -> References:
        languages = sorted(chars)
        vocabularies = [sorted(w for w, n in words.get(lang, {}).items() if n * WORD_SHARE >= totals[lang] and LETTER.search(w)) for lang in languages]
        table = np.zeros((len(languages), 1 + max(map(len, vocabularies), default=0)))
        for row, lang, vocabulary in zip(table, languages, vocabularies, strict=True):
            row[: len(vocabulary)] = [words[lang][w] for w in vocabulary]
            row[-1] = totals[lang] - row.sum()
        only_others = np.zeros_like(table)
        only_others[:, -1] = 1
        return cls(languages, np.array([chars[lang] for lang in languages], dtype=np.float64).reshape(-1, len(CLASSES)), vocabularies, table, distances(only_others, table), more)

    def char_distance(self, chars: np.ndarray) -> float:
        return float(distances(np.broadcast_to(chars, self.chars.shape).astype(np.float64), self.chars).min(initial=1.0)) if self.languages else 0.0

    def word_distance(self, counts: Counter) -> float:
        """The least distance, each as a share of that of a text without any common word."""
        speak = self.without > 0
        if not speak.any():
            return 0.0
        own, total = np.zeros_like(self.words), counts.total()
        for row, vocabulary in zip(own, self.vocabularies, strict=True):
            row[: len(vocabulary)] = [counts.get(w, 0) for w in vocabulary]
            row[-1] = total - row.sum()
        return float((distances(own, self.words)[speak] / self.without[speak]).min())


def cut_down(counts: Counter, most: int) -> Counter:
    """At most ``most`` counters: the next greatest count is taken off each, and what is left of none is dropped."""
    if len(counts) <= most:
        return counts
    least = heapq.nlargest(most + 1, counts.values())[-1]
    return Counter({w: n - least for w, n in counts.items() if n > least})


def gathered(docs: DataFrame, schema: str, add: Callable[[dict, str, bytes, list[bytes]], None], rows: Callable[[dict], list[tuple]], text_col: str, lang_col: str) -> DataFrame:
    """What ``add`` gathers in a state of each task from its documents that pass the base rule."""
    chosen = docs.select(F.col(quoted(lang_col)).alias("lang"), text_of(quoted(text_col)).alias("text"))
    out_schema = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                words = raw.split()
                if not base_failed(len(words), repeated_words(words)):
                    add(state, lang.as_py(), raw, words)
            give_back()
        if out := rows(state):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)

    return chosen.mapInArrow(run, schema)


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> References:
    """Learn each language's reference from all its documents that pass the base rule.

    A language needs ``LANG_ROWS`` labelled rows, however large the table; of
    more than ``MOST_LANGS`` those with the most rows have one. Its common words are those
    that hold one in ``WORD_SHARE`` of its words, at most so many. They are
    found in two passes: each task keeps a bounded summary (Misra-Gries), whose
    sums miss no word of that share, and the words found are then counted
    exactly over all documents.
    """
    lang = F.col(quoted(lang_col)).alias("lang")
    labelled = docs.filter(lang.isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    languages = [r["lang"] for r in labelled.filter(F.col("n") >= LANG_ROWS).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGS + 1).collect()]
    more, languages = len(languages) > MOST_LANGS, languages[:MOST_LANGS]
    if not languages:
        return References.of({}, {}, {})
    known = docs.filter(F.col(quoted(lang_col)).isin(languages))

    def summarise(state: dict, lang: str, raw: bytes, words: list[bytes]) -> None:
        own = state.setdefault(lang, [np.zeros(len(CLASSES), np.int64), 0, Counter()])
        own[0] += CLASS_MATRIX @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        own[1] += len(words)
        own[2].update(raw.lower().split())
        if len(own[2]) > max(COUNTERS + COUNTERS // 4, MOST_ENTRIES // len(state)):
            own[2] = cut_down(own[2], COUNTERS)

    def summary_rows(state: dict) -> list[tuple]:
        return [row for lang, (chars, n, counts) in state.items() for row in [(lang, -1, "", n), *((lang, k, "", int(c)) for k, c in enumerate(chars)), *((lang, len(CLASSES), w.decode(), c) for w, c in cut_down(counts, COUNTERS).items())]]

    sums = cut(gathered(known, "lang string, kind bigint, word string, n bigint", summarise, summary_rows, text_col, lang_col).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")))
    words_of = sums.filter("kind = -1").select("lang", F.col("n").alias("all"))
    # The summaries of a language fall short of a word's count by at most one in COUNTERS of its words.
    kept = sums.join(F.broadcast(words_of), "lang").filter((F.col("kind") < len(CLASSES)) | (F.col("n") * WORD_SHARE * 4 >= F.col("all") * 3)).drop("all").collect()
    totals = {r["lang"]: r["n"] for r in kept if r["kind"] == -1}
    chars = {lang: np.zeros(len(CLASSES)) for lang in totals}
    found: dict[str, set[bytes]] = {lang: set() for lang in totals}
    for r in kept:
        if r["kind"] == len(CLASSES):
            found[r["lang"]].add(r["word"].encode())
        elif r["kind"] >= 0:
            chars[r["lang"]][r["kind"]] = r["n"]

    def tally(state: dict, lang: str, raw: bytes, words: list[bytes]) -> None:
        state.setdefault(lang, Counter()).update(filter(found[lang].__contains__, raw.lower().split()))

    def tally_rows(state: dict) -> list[tuple]:
        return [(lang, w.decode(), n) for lang, counts in state.items() for w, n in counts.items()]

    exact = gathered(known, "lang string, word string, n bigint", tally, tally_rows, text_col, lang_col).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    words: dict[str, dict[bytes, int]] = {}
    for r in exact:
        words.setdefault(r["lang"], {})[r["word"].encode()] = r["n"]
    return References.of(chars, words, totals, more)


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = 0.30,
    max_word_distance: float = 0.85,
    min_chars: int = 200,
    min_words: int = 60,
) -> DataFrame:
    """Base counts of each document and the verdict of the divergence rules.

    A document is compared with every language reference and judged by the
    nearest one, so its own language column is not needed. The word distance is
    a share of the distance that a text without any common word has, so its
    limit does not depend on how much of a language its common words make up.
    The character rule speaks from ``min_chars`` non-space characters on and the
    word rule from ``min_words`` words on; below, a document passes. Null text
    has no words; documents of a null language, or of one with too few rows, add
    to no reference; without any reference, or any common word, the rules are
    silent. Where there are more than ``MOST_LANGS`` languages, they are also
    silent for documents whose label names one without a reference.
    """
    known = references(docs, text_col=text_col, lang_col=lang_col)
    lang = F.col(quoted(lang_col))
    comparable = lang.isNull() | lang.isin(known.languages) if known.more else F.lit(True)

    def start():
        def one(doc_id: int | None, text: str, comparable: bool) -> Iterator[tuple]:
            raw = text.encode()
            bytes_of, words, counts = histograms(raw)
            n_words, chars = len(words), CLASS_MATRIX @ bytes_of
            word_chars = int(chars.sum() - chars[CLASSES.index("space")])
            n_symbols = int(bytes_of[list(SYMBOLS)].sum())
            lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
            repeats = repeated_words(words)
            failed = base_failed(n_words, repeats)
            by_char, by_word = known.char_distance(chars), known.word_distance(counts)
            far = comparable and ((word_chars >= min_chars and by_char > max_char_distance) or (n_words >= min_words and by_word > max_word_distance))
            yield doc_id, n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, failed, not failed and not far, round(by_char, 6), round(by_word, 6)

        return one

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col)), comparable], schema, start)
