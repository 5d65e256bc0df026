import io
import json
import zipfile

from pyspark.sql import functions as F

from vellum.sources import datasets, files
from vellum.sources.sinks import merged_configs, new_vectors, replace_documents

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes():
    def p(text, style=None):
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"

    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = p("preamble") + p("Chapter", "H1") + p("text") + "<w:tbl><w:tr>" + cell.format("a") + cell.format("b") + "</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title>My title</dc:title><dc:creator> </dc:creator></c>')
    return out.getvalue()


MARKDOWN = b"\xef\xbb\xbfintro\n# One\ntext\n```\n# not a heading\n```\n##\n### Three ##\nend"


def test_markdown():
    got = [(k, h, n, t) for k, t, _, h, n in files.markdown(MARKDOWN)[0]]
    assert got == [("body", None, None, "intro"), ("section", "One", 1, "text\n```\n# not a heading\n```\n##"), ("section", "Three", 3, "end")]


def test_docx():
    sections, properties = files.docx(docx_bytes())
    assert [(s[0], s[1], s[3], s[4]) for s in sections] == [("body", "preamble", None, None), ("section", "text\na | b", "Chapter", 2)]
    assert properties == {"title": "My title"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain")
    (tmp_path / "b.md").write_bytes(MARKDOWN)
    (tmp_path / "c.docx").write_bytes(docx_bytes())
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 x %%EOF")
    (tmp_path / "f.exe").write_bytes(b"MZ")
    (tmp_path / "g.docx").write_bytes(b"no zip")
    empty = spark.createDataFrame([("h.txt", bytearray(), 0)], "filename string, content binary, length long")
    df = files.read_files(spark, str(tmp_path)).unionByName(empty)
    refused = {r.filename: r.refused for r in files.inspected(df).collect()}
    assert refused == {"a.txt": None, "b.md": None, "c.docx": None, "d.txt": "content_mismatch", "e.pdf": None, "f.exe": "unsupported_type", "g.docx": "content_mismatch", "h.txt": "empty_file"}
    declared = files.inspected(df.withColumn("content_type", F.lit("application/pdf; x=1")))
    assert {r.filename: r.refused for r in declared.collect()}["a.txt"] == "type_mismatch"
    rows = files.extracted(df).collect()
    failed = {r.filename: r.failure_reason for r in rows if r.failure_reason}
    assert failed == {"d.txt": "corrupt_document", "e.pdf": "unsupported_format", "f.exe": "unsupported_format", "g.docx": "corrupt_document"}
    assert sum(r.filename == "b.md" for r in rows) == 3
    listed = spark.createDataFrame([("a.txt", 5), ("b.md", 1), ("zz.txt", 3)], "filename string, file_size long")
    assert {r.filename: r.failure_reason for r in files.wrong_files(listed, df).collect()} == {"b.md": "corrupt_document", "zz.txt": "storage_missing"}


def test_names_and_ocr():
    assert files.clean_name("..\\dir/na\x00me ‮ x.txt. ") == "name x.txt"
    assert files.clean_name("...") is None and files.clean_name(None) is None
    long = files.clean_name("x" * 300 + ".txt")
    assert len(long) == 255 and long.endswith(".txt")
    assert files.needs_ocr("  a ", 1) and not files.needs_ocr("a", 0) and not files.needs_ocr("x" * 25, 3)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda x: spark.createDataFrame(x, "document_id long, chunk_index int, text string")
    replace_documents(rows([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]), path, buckets=2)
    replace_documents(rows([(1, 0, "new"), (3, 0, "d")]), path, buckets=2)
    replace_documents(rows([(1, 0, "new"), (3, 0, "d")]), path, buckets=2)
    assert sorted((r.document_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "c"), (3, "d")]
    stored = spark.createDataFrame([(1, "c")], "chunk_id long, config_id string")
    assert new_vectors(spark.createDataFrame([(1, "c"), (1, "d"), (1, "d")], "chunk_id long, config_id string"), stored).count() == 1
    merged = merged_configs(spark.createDataFrame([("f", 1)], "fingerprint string, id int"), spark.createDataFrame([("f", 2), ("g", 3)], "fingerprint string, id int"))
    assert {r.fingerprint: r.id for r in merged.collect()} == {"f": 1, "g": 3}


def test_datasets(spark, tmp_path):
    corpus = {"dataset": "d", "version": 1, "documents": [{"id": "x", "title": "t", "language": "en", "sections": [{"heading": "h", "passage": {"id": f"p{i}", "text": "abc"}} for i in (1, 2, 2)]}]}
    queries = {"dataset": "d", "version": 1, "queries": [{"id": "q1", "category": "c", "query": "?", "relevant": ["p1"], "neutral": ["p1"]}, {"id": "q2", "category": "c", "query": "?", "relevant": ["nope"]}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus, indent=1))
    (tmp_path / "q.json").write_text(json.dumps(queries, indent=1))
    p, q = datasets.passages(spark, str(tmp_path / "c.json")), datasets.queries(spark, str(tmp_path / "q.json"))
    assert {(r.problem, r.id) for r in datasets.problems(p, q).collect()} == {("repeated_passage", "p2"), ("unknown_passage", "nope"), ("relevant_and_neutral", "q1")}
    assert datasets.as_chunks(p).count() == 3
