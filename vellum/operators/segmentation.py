"""Spans of lines, sentences, words and blocks, with exact offsets."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
# Terminators of a sentence, closing quotes and brackets that may follow them.
SENTENCE_END = re.compile("(?<![.!?\u0964\u0965\u2026])[.!?\u0964\u0965\u2026]++[\"')\\]\u201d\u2019\u00bb]*+(?=\\s)")
MOST_CLUSTER = 64
Span = tuple[int, int]


def trimmed(text: str, start: int, end: int) -> list[Span]:
    """The span without white space at its ends, or none."""
    inner = text[start:end]
    left = len(inner) - len(inner.lstrip())
    size = len(inner.strip())
    return [(start + left, start + left + size)] if size else []


def lines_in(text: str, start: int, end: int) -> list[Span]:
    """T3."""
    out, at = [], start
    for line in text[start:end].split("\n"):
        out += trimmed(text, at, at + len(line))
        at += len(line) + 1
    return out


def sentences_in(text: str, start: int, end: int) -> list[Span]:
    """T4: a sentence ends after terminators and closing quotes that white space follows."""
    ends = [m.end() for m in SENTENCE_END.finditer(text, start, end)]
    return [s for a, b in zip([start, *ends], [*ends, end], strict=True) for s in trimmed(text, a, b)]


def words_in(text: str, start: int, end: int) -> list[Span]:
    """T5."""
    return [m.span() for m in re.compile(r"\S+").finditer(text, start, end)]


def glued(text: str, at: int) -> bool:
    """Whether a cut before ``at`` splits a base from its marks, or a conjunct."""
    after, before = text[at], text[at - 1]
    joiner = "\u200c\u200d"
    return after in joiner or before in joiner or unicodedata.category(after)[0] == "M" or unicodedata.combining(before) == 9


def safe_cut(text: str, start: int, cut: int) -> int:
    """The nearest place to the left that splits no cluster; ``cut`` itself if there is none nearby."""
    return next((at for at in range(cut, max(start, cut - MOST_CLUSTER), -1) if not glued(text, at)), cut)


def is_table_line(line: str) -> bool:
    return line.count("|") >= 2 or " | " in line


def blocks(text: str, mode: str = "blank_line", markdown: bool = False) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of paragraphs, tables and code.

    Each line gets a kind; neighbours of one kind are one block, but for
    paragraphs in ``line`` mode. A fence closes on a line of the same character,
    at least as long, and runs to the end if it never does. One table line alone
    is a paragraph.
    """
    out: list[list] = []
    grows, fence, at = False, "", 0
    for line in text.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        mark = FENCE.match(line) if markdown else None
        if fence:
            out[-1][1] = end
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence, grows = "", False
            continue
        if mark:
            fence = mark[1]
            out.append([start, end, "code"])
            continue
        inner = line.strip()
        kind = "" if not inner else "table" if is_table_line(inner) else "para"
        if not kind:
            grows = False
        elif grows and out[-1][2] == kind and (kind == "table" or mode != "line"):
            out[-1][1] = end
        else:
            out.append([start, end, kind])
            grows = True
    return [(a, b, "para" if kind == "table" and "\n" not in text[a:b] else kind) for a, b, kind in out]


#: White space as ``str.isspace`` has it, and what is not.
BLANK, INK = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def piece_spans(docs: DataFrame, pieces: Column, id_col: str) -> DataFrame:
    """``<id>, start, end`` of the trimmed pieces of each text.

    ``pieces`` is an array that gives the text when joined, so offsets are
    running sums of the pieces' lengths and all of it stays in the JVM. Ids are
    unique. A null text has no pieces.
    """
    rows = docs.select(id_col, F.posexplode(pieces).alias("pos", "piece"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("base", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    left = F.length("piece") - F.length(F.regexp_replace("piece", f"(?U)^{BLANK}+", ""))
    inner = F.length(F.regexp_replace("piece", f"(?U)^{BLANK}+|{BLANK}+$", ""))
    return placed.filter(inner > 0).select(id_col, (F.col("base") + left).alias("start"), (F.col("base") + left + inner).alias("end"))


def line_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T3 over a table."""
    return piece_spans(docs, F.split(text_col, "(?<=\n)"), id_col)


def sentence_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T4 over a table."""
    end = "(?<![.!?\u0964\u0965\u2026])[.!?\u0964\u0965\u2026]++[\"')\\]\u201d\u2019\u00bb]*+"
    return piece_spans(docs, F.regexp_extract_all(text_col, F.lit(f"(?Us).*?{end}(?={BLANK})|.+"), F.lit(0)), id_col)


def word_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T5 over a table."""
    return piece_spans(docs, F.regexp_extract_all(text_col, F.lit(f"(?U){BLANK}*{INK}+|{BLANK}+"), F.lit(0)), id_col)
