"""Structure-aware chunking of document sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.batches import pieces
from vellum.functions.text import normalise
from vellum.operators.segmentation import Span, blocks, lines_in, safe_cut, sentences_in, words_in

VERSION = "c1.0"
CHUNK = "chunk_index int, section_ordinal int, text string, start_char int, end_char int, overlap_chars int, page_number int, heading string, heading_level int, heading_path array<string>"
Measure = Callable[[str, int, int], int]


def characters(text: str, start: int, end: int) -> int:
    """The default measure. Any other one must not shrink as a span grows."""
    return end - start


@dataclass(frozen=True)
class Limits:
    """Sizes in the unit of the measure."""

    most: int = 1000
    overlap: int = 150
    least: int = 20
    chunks: int = 50_000

    def __post_init__(self) -> None:
        if min(self.most, self.least, self.chunks) < 1 or self.overlap < 0:
            raise ValueError("sizes must be positive; the overlap may be zero")
        if 2 * self.overlap > self.most or self.least >= self.most:
            raise ValueError("overlap is at most half of the largest size, and the least size below it")


def atoms(text: str, span: Span, splitters: tuple, limits: Limits, size: Measure) -> Iterator[Span]:
    """Spans that fit, by the first splitter that helps; a hard cut at a safe place where none does."""
    start, end = span
    if size(text, start, end) <= limits.most:
        yield span
        return
    for n, split in enumerate(splitters):
        parts = split(text, start, end)
        if len(parts) > 1:
            for part in parts:
                yield from atoms(text, part, splitters[n + 1 :], limits, size)
            return
    while start < end:
        low, high = start + 1, end
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(text, start, middle) <= limits.most else (low, middle - 1)
        cut = low if low >= end else safe_cut(text, start, low)
        yield start, cut
        start = cut


def section_spans(text: str, mode: str, markdown: bool, limits: Limits, size: Measure = characters) -> list[tuple[int, int, int]]:
    """``(start, end, overlap)`` of a section's chunks.

    Atoms are packed while they fit. The next chunk goes back over the last
    atoms of this one only within the same block, if they fit the overlap and
    leave room for the next atom; the first atom is never repeated. A last chunk
    that is too small joins the one before if both fit.
    """
    units: list[tuple[int, int, int]] = []
    for n, (start, end, kind) in enumerate(blocks(text, mode, markdown)):
        splitters = (sentences_in, words_in) if kind == "para" else (lines_in, sentences_in, words_in)
        units += [(a, b, n) for a, b in atoms(text, (start, end), splitters, limits, size)]
    out: list[tuple[int, int, int]] = []
    first = shared = 0
    while first < len(units):
        start, after = units[first][0], first + 1
        while after < len(units) and size(text, start, units[after][1]) <= limits.most:
            after += 1
        end = units[after - 1][1]
        out.append((start, end, shared))
        back, shared = after, 0
        if limits.overlap and after < len(units) and units[after][2] == units[after - 1][2]:
            for k in range(first + 1, after):
                again = size(text, units[k][0], end)
                if units[k][2] == units[after][2] and again <= limits.overlap and size(text, units[k][0], units[after][1]) <= limits.most:
                    back, shared = k, again
                    break
        first = back
    if len(out) > 1 and size(text, *out[-1][:2]) < limits.least and size(text, out[-2][0], out[-1][1]) <= limits.most:
        out[-2:] = [(out[-2][0], out[-1][1], out[-2][2])]
    return out


class TooManyChunksError(ValueError):
    """A document has more chunks than the limit."""


def document_chunks(sections: list[dict], limits: Limits, size: Measure = characters) -> Iterator[tuple]:
    """Chunks of one document's sections in order, numbered through.

    T8: a heading replaces those of its level and below; sections without one
    stand below the current path, and a heading counts even if its section has
    no text. A chunk without letter or digit is dropped and takes no number.
    A section that carries ``spans`` is cut there.
    """
    path: list[tuple[int, str]] = []
    number = 0
    for s in sections:
        text = s["text"] or ""
        if s.get("heading") and s.get("heading_level"):
            path = [p for p in path if p[0] < s["heading_level"]]
            path.append((s["heading_level"], s["heading"]))
        if not text.strip():
            continue
        known = [(p["start"], p["end"], p["shared"]) for p in s.get("spans") or []]
        for start, end, shared in known or section_spans(text, s.get("paragraph_mode") or "blank_line", bool(s.get("markdown")), limits, size):
            if not any(map(str.isalnum, text[start:end])):
                continue
            if number >= limits.chunks:
                raise TooManyChunksError(f"more than {limits.chunks} chunks")
            yield number, s["ordinal"], text[start:end], start, end, shared, s.get("page_number"), s.get("heading"), s.get("heading_level"), [h for _, h in path]
            number += 1


SECTION_FIELDS = ("ordinal", "text", "heading", "heading_level", "page_number", "paragraph_mode", "markdown")


FIELD_KINDS = {"heading": "string", "heading_level": "int", "page_number": "int", "paragraph_mode": "string", "markdown": "boolean"}


def gathered_sections(sections: DataFrame, *more: str) -> DataFrame:
    """``document_id, sections`` with a document's sections in one row, in order; fields that are not there are null.

    ``more`` names further columns that the sections carry.
    """
    have = [F.col(f) if f in sections.columns else F.lit(None).cast(FIELD_KINDS[f]) for f in SECTION_FIELDS]
    own = sections.select("document_id", F.struct(*[h.alias(f) for h, f in zip(have, SECTION_FIELDS, strict=True)], *more).alias("s"))
    return own.groupBy("document_id").agg(F.array_sort(F.collect_list("s")).alias("sections"))


def chunk_sections(sections: DataFrame, limits: Limits | None = None, *, size: Measure = characters) -> DataFrame:
    """Chunks of ``document_id`` and the section fields, one document at a time.

    Sections are gathered into one row for each document before Python sees
    them, so no document is spread over tasks; its size is that of its text.
    """
    return chunk_documents(gathered_sections(sections), limits or Limits(), size=size)


def single_sections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of one plain-text section each, as ``document_id, sections``."""
    section = F.struct(F.lit(0).alias("ordinal"), F.col(text_col).alias("text"), *[F.lit(None).cast(t).alias(f) for f, t in FIELD_KINDS.items()])
    return docs.select(F.col(id_col).alias("document_id"), F.array(section).alias("sections"))


def chunk_texts(docs: DataFrame, limits: Limits | None = None, *, id_col: str = "doc_id", text_col: str = "text", size: Measure = characters) -> DataFrame:
    """T7 for documents of one plain-text section each; needs no shuffle."""
    return chunk_documents(single_sections(docs, id_col=id_col, text_col=text_col), limits or Limits(), size=size)


def chunk_documents(documents: DataFrame, limits: Limits, *, size: Measure = characters) -> DataFrame:
    """Chunks of ``document_id, sections array<struct>``; a document beyond the limit has none (see ``chunk_results``)."""
    return chunk_results(documents, limits, size=size).filter("failure_reason is null").drop("failure_reason")


def chunk_results(documents: DataFrame, limits: Limits, *, size: Measure = characters) -> DataFrame:
    """Chunks, and a row with a ``failure_reason`` for each document that has too many of them, so that none stops a job.

    Document ids keep their type.
    """
    columns = ["document_id", *(c.split()[0] for c in CHUNK.split(", ")), "failure_reason"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def of(document: object, own: list[dict]) -> list[tuple]:
        try:
            return [(document, *chunk, None) for chunk in document_chunks(own, limits, size)]
        except TooManyChunksError:
            return [(document, *[None] * (len(columns) - 2), "too_many_chunks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rows = [row for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in of(i, own or [])]
            if rows:
                own_kinds = [batch.column(0).type, *kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), own_kinds, strict=True)], names=columns)

    schema = f"document_id {dict(documents.dtypes)['document_id']}, {CHUNK}, failure_reason string"
    return documents.select("document_id", "sections").mapInArrow(run, schema)


def normalise_sections(sections: DataFrame, *, collapse: str = "collapse") -> DataFrame:
    """Normalised heading and text; an empty heading loses its level. ``collapse`` names a boolean column."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series, flag: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else normalise(t, bool(f)) for t, f in zip(text, flag, strict=True)], dtype=object)

    heading = F.nullif(F.substring(clean(F.col("heading"), F.lit(True)), 1, 500), F.lit(""))
    out = sections.withColumn("text", clean(F.col("text"), F.col(collapse))).withColumn("heading", heading)
    return out.withColumn("heading_level", F.when(F.col("heading").isNotNull(), F.col("heading_level")))


def empty_documents(sections: DataFrame) -> DataFrame:
    """Documents without any text or heading."""
    return sections.groupBy("document_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("heading").alias("headings")).filter("chars = 0 and headings = 0").select("document_id")


def chunk_quality(chunks: DataFrame, docs: DataFrame, limits: Limits | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document, how its chunks keep to size, slices, coverage and boundaries."""
    limits = limits or Limits()
    texts = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("whole"))
    rows = chunks.join(texts, "document_id")
    w = Window.partitionBy("document_id", "section_ordinal").orderBy("start_char")
    new = F.greatest(F.lit(0), F.col("end_char") - F.greatest(F.col("start_char"), F.coalesce(F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    size = F.length("text")
    rows = rows.select("document_id", size.alias("size"), "overlap_chars", new.alias("new"), (F.substring("whole", F.col("start_char") + 1, size) == F.col("text")).alias("exact"), F.col("text").rlike("[.!?\u0964\u0965\u2026][\"')\\]\u201d\u2019\u00bb]*$").alias("ends_well"), F.length("whole").alias("whole_chars"))
    return rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg((F.col("size") <= limits.most).cast("double")), 4).alias("size_compliance"),
        F.round(F.avg(F.col("exact").cast("double")), 4).alias("slice_integrity"),
        F.round(F.sum("new") / F.max("whole_chars"), 4).alias("coverage"),
        F.round(F.avg(F.col("ends_well").cast("double")), 4).alias("boundary_quality"),
        F.round(F.sum("overlap_chars") / F.sum("size"), 4).alias("overlap_ratio"),
        F.round(F.avg((F.col("size") < limits.least).cast("double")), 4).alias("fragment_ratio"),
        F.element_at(F.array_sort(F.collect_list("size")), F.ceil(F.count(F.lit(1)) * 0.1).cast("int")).alias("p10"),
        F.element_at(F.array_sort(F.collect_list("size")), F.ceil(F.count(F.lit(1)) * 0.9).cast("int")).alias("p90"),
    )
