import io
import zipfile
import zlib

from millrace.sources import files


def test_validation_and_sniffing(spark, tmp_path):
    good = {"a.pdf": b"%PDF-1.7 ...", "b.csv": b"a,b\n1,2\n3,4\n", "c.txt": "Grüße aus dem Werk\n".encode("latin-1"), "d.eml": b"From: a@b.c\nSubject: x\n\nhello", "e.png": b"\x89PNG\r\n\x1a\n1234"}
    bad = {"f.exe": b"MZ\x00\x01", "h.txt": bytes(range(256)) * 4}
    for name, content in (good | bad).items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: r for r in files.validated(files.binary(spark, str(tmp_path))).collect()}
    assert {n: got[n].family for n in good} == {"a.pdf": "pdf", "b.csv": "delimited", "c.txt": "text", "d.eml": "email", "e.png": "image"}
    assert all(got[n].reason is None for n in good)
    assert (got["f.exe"].reason, got["h.txt"].reason) == ("extension", "type")
    # Spark's binary source leaves out files without bytes; rows from elsewhere may have none.
    empty = spark.createDataFrame([("x/g.txt", 0, bytearray())], "path string, length long, content binary")
    assert files.validated(empty).first().reason == "empty"


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo\n\nthree\n")
    assert [r.text for r in files.text_paragraphs(spark, str(tmp_path / "t.txt")).orderBy("position").collect()] == ["one\ntwo", "three\n"]
    (tmp_path / "t.csv").write_text("a,b\n1,\n")
    assert sorted(r.text for r in files.delimited_rows(spark, str(tmp_path / "t.csv")).collect()) == ["1 | ", "a | b"]
    docx = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    xlsx = io.BytesIO()
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>tag</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    office = tmp_path / "office"
    office.mkdir()
    (office / "a.docx").write_bytes(docx.getvalue())
    (office / "b.xlsx").write_bytes(xlsx.getvalue())
    (office / "c.eml").write_bytes(b"From: a@b.c\nSubject: leak\n\nfirst\n\nsecond")
    (office / "d.docx").write_bytes(b"no zip")
    rows = files.parsed(files.binary(spark, str(office))).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.path, r.position)):
        texts.setdefault(r.path.rpartition("/")[2], []).append(r.text)
    assert texts["a.docx"] == ["Hello", "x | y"]
    assert texts["b.xlsx"] == ["tag | 7"]
    assert texts["c.eml"] == ["From: a@b.c", "Subject: leak", "first", "second"]
    assert [r.error is not None for r in rows if r.path.endswith("d.docx")] == [True]


def pdf(pages, deflate=True):
    """A small file of pages, each a list of lines."""
    parts = [b"%PDF-1.4\n"]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    parts.append(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + kids + b"] /Count %d >> endobj\n" % len(pages))
    for k, lines in enumerate(pages):
        data = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(lines) + b" ET"
        data = zlib.compress(data) if deflate else data
        parts.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * k, 11 + 2 * k))
        parts.append(b"%d 0 obj << /Length %d %s>> stream\n" % (11 + 2 * k, len(data), b"/Filter /FlateDecode " if deflate else b"") + data + b"\nendstream endobj\n")
    return b"".join(parts)


def test_pdf_pages(spark, tmp_path):
    pages = [[b"(Pump \\(P-1\\) leaks) Tj", b"[(Se) -20 (al)] TJ"], [b"<48656C6C6F> Tj", b"(caf\\351) Tj"]]
    (tmp_path / "a.pdf").write_bytes(pdf(pages))
    (tmp_path / "b.pdf").write_bytes(pdf(pages, deflate=False))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    rows = files.parsed(files.binary(spark, str(tmp_path))).orderBy("path", "position").collect()
    assert [r.text for r in rows][:2] == ["Pump (P-1) leaks\nSeal", "Hello\ncafé"] == [r.text for r in rows][2:4]
    assert rows[4].error == "ValueError: encrypted"


def test_one_delimiter_for_all_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a,b\nc;d\ne\tf\n")
    (tmp_path / "y.txt").write_text("a|b\nc|d\ne|f\n")
    got = {r.path[-5:]: r.family for r in files.validated(files.binary(spark, str(tmp_path))).collect()}
    assert got == {"x.txt": "text", "y.txt": "delimited"}


def test_table_text(spark):
    rows = spark.createDataFrame([("t", 0, ["a", "b"]), ("t", 1, ["1", None])], "t string, p int, cells array<string>")
    assert files.table_text(rows, "t", "p", "cells").first().text == "a | b\n--- | ---\n1 | "
