import io
import zipfile
import zlib

from topicwright.plans.analysis import analyse_files
from topicwright.sources import files


def archive(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = archive({"word/document.xml": "<w:p><w:t>Paper 2024</w:t></w:p><w:p><w:t xml:space='preserve'>Q1. Rotate an AVL </w:t><w:t>tree &amp;lt; now</w:t></w:p><w:p></w:p>"})
PPTX = archive({f"ppt/slides/slide{n}.xml": f"<a:p><a:t>{t}</a:t></a:p>" for n, t in ((10, "last"), (2, "AVL tree"))}, zipfile.ZIP_STORED)


def pdf(compress):
    stream = b"BT /F1 11 Tf 50 700 Td 15 TL (1. Define an AVL tree. \\(5 marks\\)) Tj T* [(Ki) -20 (ng)] TJ T* (2. Run BFS) Tj 0 0 Td (\\101gain) Tj ET"
    body, kind = (zlib.compress(stream), b"/Filter /FlateDecode ") if compress else (stream, b"")
    return b"%PDF-1.4\n3 0 obj\n<< " + kind + b"/Length 1 >>\nstream\n" + body + b"\nendstream\nendobj\n4 0 obj\n<< /Type /Page /Contents 3 0 R >>\nendobj\n5 0 obj\n<< /Type /Pages >>\nendobj\n%%EOF"


def test_office():
    assert files.read_docx(DOCX) == "Paper 2024\nQ1. Rotate an AVL tree &lt; now"
    assert files.read_pptx(PPTX) == "AVL tree\nlast"


def test_pdf():
    for compress in (False, True):
        assert files.read_pdf(pdf(compress)) == "1. Define an AVL tree. (5 marks)\nKing\n2. Run BFS Again"


def test_legacy():
    data = b"\x00\x01\x02" + "AVL Tree".encode("utf-16-le") + b"\x03\x00\x01\x02" + b"\x05plain words\x00\x07abc\x00\x01\x00\x01" + "Prim".encode("utf-16-le")
    lines = files.read_legacy(data).split("\n")
    assert "AVL Tree" in lines and "plain words" in lines and "Prim" in lines and "abc" not in lines


def test_bad_files_keep_the_job_going(spark):
    rows = [("/a/p-2024.docx", DOCX), ("/a/slides.PPTX", PPTX), ("/a/x.pdf", pdf(True)), ("/a/bad.docx", b"nothing"), ("/a/n.xyz", b"a"), ("/a/e.txt", b"  "), ("/a/s.md", b"== 2020 ==\nQ1: AVL Tree"), ("/a/noext", b"x"), ("/a/hollow.pptx", archive({"x": "y"}))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    read = {r.path: r for r in files.read_files(df).collect()}
    assert read["/a/bad.docx"].error == "Not a ZIP file" and read["/a/n.xyz"].error == ".xyz files are not supported" and read["/a/noext"].error == ".? files are not supported"
    assert read["/a/e.txt"].error and read["/a/hollow.pptx"].error == "This .pptx has no slides"
    result, report = analyse_files(df)
    status = {r.path: (r.status, r.label) for r in report.collect()}
    assert status["/a/p-2024.docx"] == ("ok", "2024") and status["/a/bad.docx"][0] == "error"
    assert {r.key: r.frequency for r in result.table.collect()}["avl tree"] == 4


def test_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Q1: Heap")
    (tmp_path / "in" / "b.bin").write_text("no")
    assert [r.text for r in files.scan(spark, str(tmp_path)).collect()] == ["Q1: Heap"]
