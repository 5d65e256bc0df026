"""Files into sections: inspection, extraction and checks."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.segmentation import FENCE

MOST_CHARS, MOST_UNPACKED, MOST_ENTRIES, MOST_RATIO, MOST_PAGES = 20_000_000, 200 << 20, 5_000, 200, 2_000
MOST_NAME = 255
SECTION = "filename string, ordinal int, kind string, text string, page_number int, heading string, heading_level int, collapse boolean, failure_reason string, properties map<string,string>"
# Extension, accepted media types and canonical media type.
TYPES = {
    "pdf": (["application/pdf", "application/x-pdf"], "application/pdf"),
    "docx": (["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"], "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "txt": (["text/plain"], "text/plain"),
    "md": (["text/markdown", "text/x-markdown", "text/plain"], "text/markdown"),
}
UNSPECIFIED = ["", "application/octet-stream"]
DOCX_PARTS = ["[Content_Types].xml", "word/document.xml"]
HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ExtractionError(ValueError):
    """A classified failure; its message is the reason."""


Section = tuple[str, str, int | None, str | None, int | None]
Extractor = Callable[[bytes], tuple[list[Section], dict[str, str]]]
EXTRACTORS: dict[str, tuple[Extractor, bool]] = {}


def register_extractor(file_type: str, extractor: Extractor, collapse: bool) -> None:
    """Make a file type known. ``collapse`` tells whether inline spaces carry no meaning."""
    EXTRACTORS[file_type] = extractor, collapse


def decoded(data: bytes) -> str:
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise ExtractionError("corrupt_document") from None
    if len(text) > MOST_CHARS:
        raise ExtractionError("content_too_large")
    return text


def plain(data: bytes) -> tuple[list[Section], dict[str, str]]:
    """S4."""
    return [("body", decoded(data), None, None, None)], {}


def sections_of(lines: Iterator[tuple[str, tuple[int, str] | None]]) -> list[Section]:
    """Sections opened by headings; text before the first one is a body, if it is not blank."""
    out: list[Section] = []
    head: tuple[int, str] | None = None
    own: list[str] = []
    for line, opens in [*lines, ("", (0, ""))]:
        if opens is None:
            own.append(line)
            continue
        if head is not None or any(x.strip() for x in own):
            out.append(("section" if head else "body", "\n".join(own), None, head[1] if head else None, head[0] if head else None))
        head, own = opens, []
    return out


def markdown_lines(text: str) -> Iterator[tuple[str, tuple[int, str] | None]]:
    """Lines of Markdown, each with the heading that it opens, if any; not inside fences."""
    fence = ""
    for line in text.splitlines():
        mark = FENCE.match(line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
            yield line, None
            continue
        head = None if fence else HEADING.match(line)
        yield line, (len(head[1]), head[2]) if head and head[2] else None


def markdown(data: bytes) -> tuple[list[Section], dict[str, str]]:
    """S5."""
    return sections_of(markdown_lines(decoded(data))), {}


def docx(data: bytes) -> tuple[list[Section], dict[str, str]]:
    """S3, S17 by the standard library: paragraphs, headings by style, a line for each table row, and core properties."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ExtractionError("corrupt_document") from None
    entries = archive.infolist()
    unpacked = sum(e.file_size for e in entries)
    if len(entries) > MOST_ENTRIES or unpacked > MOST_UNPACKED or unpacked / max(1, sum(e.compress_size for e in entries)) > MOST_RATIO:
        raise ExtractionError("content_too_large")
    try:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
        levels = style_levels(archive)
        out = sections_of(docx_lines(body, levels))
        return out, core_properties(archive)
    except (KeyError, ElementTree.ParseError, TypeError):
        raise ExtractionError("corrupt_document") from None


def style_levels(archive: zipfile.ZipFile) -> dict[str, int]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    out = {}
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
        name = style.find(f"{W}name")
        value = name.get(f"{W}val", "") if name is not None else ""
        number = re.fullmatch(r"heading\s+([1-9])", value, re.IGNORECASE)
        if value == "Title" or number:
            out[style.get(f"{W}styleId")] = int(number[1]) if number else 1
    return out


def paragraph_text(paragraph) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(node.text or "" if node.tag == f"{W}t" else marks.get(node.tag, "") for node in paragraph.iter())


def docx_lines(body, levels: dict[str, int]) -> Iterator[tuple[str, tuple[int, str] | None]]:
    for child in body:
        if child.tag == f"{W}p":
            text, style = paragraph_text(child), child.find(f"{W}pPr/{W}pStyle")
            level = levels.get(style.get(f"{W}val")) if style is not None else None
            yield text, (level, text.strip()) if level and text.strip() else None
        elif child.tag == f"{W}tbl":
            for row in child.iter(f"{W}tr"):
                cells = ("\n".join(paragraph_text(p) for p in cell.iter(f"{W}p")) for cell in row.iter(f"{W}tc"))
                yield " | ".join(c.replace("\n", " ").strip() for c in cells), None


def core_properties(archive: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in archive.namelist():
        return {}
    names = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "created": "created", "modified": "modified"}
    found = ElementTree.fromstring(archive.read("docProps/core.xml"))
    return {names[n.tag.rpartition("}")[2]]: n.text for n in found if n.tag.rpartition("}")[2] in names and n.text and n.text.strip()}


def needs_ocr(text: str, images: int, least: int = 25) -> bool:
    """Whether a page is to be recognised: it has images and hardly any text."""
    return images > 0 and sum(not c.isspace() for c in text) < least


def pdf(data: bytes, recognise: Callable[[bytes, int], str] | None = None, most_recognised: int = 60) -> tuple[list[Section], dict[str, str]]:
    """S1, S2 by an optional library: a section for each page; a page that can't be read is empty.

    ``recognise(data, page)`` is the pluggable text recognition (X6); pages it
    fails on keep their own text and count all the same.
    """
    try:
        import pymupdf
    except ImportError:
        raise ExtractionError("unsupported_format") from None
    try:
        document = pymupdf.open(stream=data, filetype="pdf")
    except Exception:  # the library has no common error for damaged files
        raise ExtractionError("corrupt_document") from None
    if document.needs_pass:
        raise ExtractionError("encrypted_document")
    if document.page_count > MOST_PAGES:
        raise ExtractionError("too_many_pages")
    out: list[Section] = []
    broken = recognised = 0
    for number in range(document.page_count):
        try:
            page = document[number]
            text = page.get_text()
            if recognise and recognised < most_recognised and needs_ocr(text, len(page.get_images())):
                recognised += 1
                text = recognise(data, number) or text
        except Exception:
            broken, text = broken + 1, ""
        out.append(("page", text, number + 1, None, None))
    if broken == len(out):
        raise ExtractionError("corrupt_document")
    return out, {k: v for k, v in (document.metadata or {}).items() if v}


register_extractor("txt", plain, False)
register_extractor("md", markdown, False)
register_extractor("docx", docx, True)
register_extractor("pdf", pdf, True)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``filename, content, length`` of every file below a path of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def file_type(filename: Column) -> Column:
    """The type by extension, null for an unknown one."""
    found = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.when(found.isin(*TYPES), found)


def inspected(files: DataFrame, *, most_bytes: int = 50 << 20) -> DataFrame:
    """Type, size, checksum, and why a file is refused (null if it is not).

    ``files``: ``filename, content`` and optionally ``content_type``. Only
    signatures are looked at; all of it stays in the JVM.
    """
    kind, content = file_type(F.col("filename")), F.col("content")
    declared = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1))) if "content_type" in files.columns else F.lit("")
    accepted = F.lit(False)
    for name, (kinds, _) in TYPES.items():
        accepted = accepted | ((kind == name) & declared.isin(*kinds))
    size = F.length(content)
    text = F.decode(content, "ISO-8859-1")
    is_pdf = F.contains(F.substring(text, 1, 1024), F.lit("%PDF-")) & F.contains(F.substring(text, -4096, 4096), F.lit("%%EOF"))
    is_docx = F.startswith(text, F.lit("PK\x03\x04")) & F.forall(F.array(*[F.lit(p) for p in DOCX_PARTS]), lambda p: F.contains(text, p))
    is_text = F.is_valid_utf8(content.cast("string")) & ~F.contains(text, F.lit("\x00"))
    refused = (
        F.when(kind.isNull(), "unsupported_type")
        .when(~declared.isin(*UNSPECIFIED) & ~accepted, "type_mismatch")
        .when(size == 0, "empty_file")
        .when(size > most_bytes, "too_large")
        .when((kind == "pdf") & ~is_pdf, "content_mismatch")
        .when((kind == "docx") & ~is_docx, "content_mismatch")
        .when(kind.isin("txt", "md") & ~is_text, "content_mismatch")
    )
    return files.withColumns({"file_type": kind, "size_bytes": size, "sha256": F.sha2(content, 256), "refused": refused})


def clean_name(raw: str | None) -> str | None:
    """A display name without folders and control characters, at most 255 long, its extension kept; null if nothing is left."""
    if not raw:
        return None
    name = re.split(r"[\\/]", unicodedata.normalize("NFC", raw))[-1]
    name = re.sub(r"\s+", " ", "".join(c for c in name if unicodedata.category(c)[0] != "C")).strip(" .")
    if len(name) > MOST_NAME:
        stem, dot, extension = name.rpartition(".")
        name = stem[: MOST_NAME - len(extension) - 1] + "." + extension if dot and len(extension) <= 10 else name[:MOST_NAME]
    return name or None


def extracted(files: DataFrame) -> DataFrame:
    """A row for each section of each file, or one with the reason of failure."""
    columns = [p.split()[0] for p in SECTION.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string())]

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        kind = name.rpartition(".")[2].lower() if "." in name else ""
        if kind not in EXTRACTORS:
            yield (name, 0, None, None, None, None, None, None, "unsupported_format", [])
            return
        extract, collapse = EXTRACTORS[kind]
        try:
            found, properties = extract(data)
        except ExtractionError as failure:
            yield (name, 0, None, None, None, None, None, None, str(failure), [])
            return
        for n, (section, text, page, heading, level) in enumerate(found):
            yield (name, n, section, text, page, heading, level, collapse, None, list(properties.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = list(rows(name, data.as_py() or b""))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

    return files.select("filename", "content").mapInArrow(run, SECTION)


def wrong_files(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogued files that are missing or have another size than recorded."""
    have = files.select("filename", F.col("length").alias("found"))
    rows = catalogue.join(have, "filename", "left")
    return rows.withColumn("failure_reason", F.when(F.col("found").isNull(), "storage_missing").when(F.col("found") != F.col("file_size"), "corrupt_document")).filter("failure_reason is not null").drop("found")


def clean_properties(properties: Column, most: int = 500) -> Column:
    """Trimmed properties of bounded size, without empty ones."""
    bounded = F.transform_values(properties, lambda k, v: F.substring(F.trim(F.regexp_replace(v, r"\s+", " ")), 1, most))
    return F.map_filter(bounded, lambda k, v: v != "")
