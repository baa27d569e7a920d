"""Files to text: plain text, PDF, Word, PowerPoint and old Office files, by extension.

read_files() takes the rows of spark.read.format("binaryFile"); a file that
can't be read gets a row with its error, and the job goes on.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions that are read.
ACCEPTED = ("pdf", "docx", "pptx", "doc", "ppt", "txt", "md")

_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_xml(text: str) -> str:
    """XML references to characters; &amp; last, so that an escaped reference stays one."""
    text = re.sub(r"&(lt|gt|quot|apos);", lambda m: _NAMED[m[1]], text)
    text = re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), text)
    text = re.sub(r"&#x([0-9a-f]+);", lambda m: chr(int(m[1], 16)), text, flags=re.I)
    return text.replace("&amp;", "&")


def list_zip(data: bytes) -> zipfile.ZipFile:
    if b"PK\x05\x06" not in data[-65557:]:
        raise ValueError("Not a ZIP file")
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("Damaged ZIP directory") from e


def zip_text(archive: zipfile.ZipFile, name: str) -> str:
    entry = archive.getinfo(name)
    if entry.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"Unsupported ZIP compression method {entry.compress_type}")
    return archive.read(entry).decode("utf-8", "replace")


def _paragraphs(xml: str, end: str, run: str) -> str:
    lines = ("".join(decode_xml(x) for x in re.findall(run, part)) for part in xml.split(end))
    return "\n".join(x for x in lines if x.strip())


def read_docx(data: bytes) -> str:
    archive = list_zip(data)
    if "word/document.xml" not in archive.namelist():
        raise ValueError("This .docx has no document body")
    return _paragraphs(zip_text(archive, "word/document.xml"), "</w:p>", r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>")


def read_pptx(data: bytes) -> str:
    archive = list_zip(data)
    slides = sorted((int(m[1]), m[0]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", x) for x in archive.namelist()) if m and int(m[1]))
    if not slides:
        raise ValueError("This .pptx has no slides")
    return "\n".join(_paragraphs(zip_text(archive, name), "</a:p>", r"<a:t>([^<]*)</a:t>") for _, name in slides)


def read_legacy(data: bytes) -> str:
    """Runs of readable characters, as UTF-16 from even and from odd bytes and as ASCII; each line once."""
    plain = r"\t\n\r\x20-\x7e"
    wide = plain + "\xa0-\xff\u2010-\u2026"
    found: dict[str, None] = {}

    def take(run: str) -> None:
        for line in re.split(r"[\r\n\v]+", run):
            line = line.strip()
            if len(line) >= 4 and len(re.findall("[a-zA-Z]", line)) >= 3:
                found[line] = None

    for offset in (0, 1):
        units = data[offset : offset + (len(data) - offset) // 2 * 2].decode("utf-16-le", "replace")
        end = len(units)
        for m in re.finditer(f"[{wide}]+", units):
            if len(m[0]) >= 4 or m.end() == end:
                take(m[0])
    text = data.decode("latin-1")
    for m in re.finditer(f"[{plain}]+", text):
        if len(m[0]) >= 6 or m.end() == len(text):
            take(m[0])
    return "\n".join(found)


_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def plain(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r", b"\r\n") else _PDF_ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S).decode("cp1252", "replace")


def pdf_items(data: bytes) -> Iterator[tuple[int, float, float, str]]:
    """(page, x, y, text) of each string shown, in page order; streams plain or by Flate, one-byte fonts."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}

    def content(number: int) -> bytes:
        m = re.search(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", objects.get(number, b""), re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]

    page = 0
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page(?![a-zA-Z])", body):
            continue
        page += 1
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        numbers = re.findall(rb"(\d+)\s+\d+\s+R", contents[1]) if contents else []
        stack: list = []
        x = y = line_x = leading = 0.0
        inside = 0  # of an array
        for m in _PDF_TOKEN.finditer(b"\n".join(content(int(k)) for k in numbers)):
            t = m[0]
            if t[:1] in b"(<":
                stack.append(_pdf_string(t))
            elif t == b"[" or t == b"]":
                inside = t == b"["
                if inside:
                    stack.append([])
                    mark = len(stack)
                else:
                    items, stack[mark - 1 :] = stack[mark:], [stack[mark:]]
            elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
                stack.append(float(t))
            elif t[:1] != b"/":
                numbers_ = [v for v in stack if isinstance(v, float)]
                if t == b"BT":
                    x = y = line_x = 0.0
                elif t in (b"Td", b"TD") and len(numbers_) >= 2:
                    line_x, y = line_x + numbers_[-2], y + numbers_[-1]
                    x = line_x
                    leading = -numbers_[-1] if t == b"TD" else leading
                elif t == b"Tm" and len(numbers_) >= 6:
                    line_x = x = numbers_[-2]
                    y = numbers_[-1]
                elif t == b"TL" and numbers_:
                    leading = numbers_[-1]
                elif t == b"T*":
                    x, y = line_x, y - leading
                if t in (b"Tj", b"'", b'"', b"TJ") and stack:
                    if t in (b"'", b'"'):
                        x, y = line_x, y - leading
                    shown = stack[-1]
                    text = "".join(v if isinstance(v, str) else " " * (v < -200) for v in shown) if isinstance(shown, list) else shown
                    if isinstance(text, str) and text:
                        yield page, x, y, text
                        x += 0.5 * len(text)  # only the order on a line matters
                stack = []


def read_pdf(data: bytes) -> str:
    """Lines of text: strings whose heights round to the same multiple of three, from top to bottom, each from left to right."""
    rows: dict[tuple[int, int], list[tuple[float, str]]] = {}
    for page, x, y, text in pdf_items(data):
        rows.setdefault((page, -3 * int((y / 3 + 0.5) // 1)), []).append((x, text))
    lines = (" ".join(" ".join(t for _, t in sorted(rows[k], key=lambda v: v[0])).split()) for k in sorted(rows))
    return "\n".join(x for x in lines if x)


def note(extension: str) -> str | None:
    if extension in ("doc", "ppt"):
        return f"Old .{extension} format: topics found, question numbers may be missing. Saving as .{extension}x or PDF gives better results."
    return None


def read_one(extension: str, data: bytes) -> str:
    readers = {"pdf": read_pdf, "docx": read_docx, "pptx": read_pptx, "doc": read_legacy, "ppt": read_legacy}
    if extension in ("txt", "md"):
        return data.decode("utf-8", "replace").removeprefix("\ufeff")
    if extension not in readers:
        raise ValueError(f".{extension or '?'} files are not supported")
    return readers[extension](data)


def read_files(files: DataFrame) -> DataFrame:
    """(path, ext, text, note, error) of rows with path and content; of text and error one is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, data in zip(pdf["path"], pdf["ext"], pdf["content"], strict=True):
                try:
                    text = read_one(ext, bytes(data or b""))
                    failed = None if text.strip() else "No text found. Scanned files can't be read."
                except Exception as e:  # one bad file doesn't fail the job: its error is its result
                    text, failed = None, str(e) or type(e).__name__
                rows.append((path, ext, None if failed else text, note(ext), failed))
            yield pd.DataFrame(rows, columns=["path", "ext", "text", "note", "error"])

    named = files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), "content")
    return named.mapInPandas(read, "path string, ext string, text string, note string, error string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files of the accepted kinds under a path, read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    accepted = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*ACCEPTED)
    return read_files(files.filter(accepted).select("path", "content"))
