"""File sources: validation, type sniffing and readers, partition by partition."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024
EXTENSIONS = ["pdf", "docx", "xlsx", "csv", "tsv", "txt", "md", "eml", "png", "jpg", "jpeg", "tif", "tiff"]


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def sniffed(content: Column) -> Column:
    """The family of a file by its first bytes: pdf, image, zip, ole, email, delimited or text."""
    head = F.hex(F.substring(content, 1, 1024))
    text = F.try_to_binary(F.lit(""), F.lit("utf-8"))  # an empty binary, for nulls
    plain = F.decode(F.coalesce(F.substring(content, 1, 4096), text), "ISO-8859-1")
    printable = F.length(F.regexp_replace(plain, r"[^\x09\x0A\x0D\x20-\x7E\xA0-\xFF]", ""))
    is_text = printable >= 0.9 * F.length(plain)
    lines = F.slice(F.filter(F.split(plain, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0), 1, 6)
    # One and the same delimiter, as often in each of the first lines.

    def even(mark: str) -> Column:
        counted = F.transform(lines, lambda x: F.regexp_count(x, F.lit(mark)))
        return (F.size(lines) >= 3) & (F.size(F.array_distinct(counted)) == 1) & (F.element_at(counted, 1) > 0)

    delimited = even(",") | even("\t") | even(";") | even("[|]")
    return (
        F.when(head.contains("25504446"), "pdf")
        .when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("49492A00") | head.startswith("4D4D002A"), "image")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(is_text & plain.rlike(r"(?mi)\A(?:(?:from|to|subject|date|received|return-path|message-id):)"), "email")
        .when(is_text & delimited, "delimited")
        .when(is_text & (F.length(plain) > 0), "text")
        .otherwise("unknown")
    )


def validated(files: DataFrame) -> DataFrame:
    """(path, bytes, extension, family, content_hash, reason): reason is null for a file that passes."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(~extension.isin(EXTENSIONS), "extension").when(sniffed(F.col("content")) == "unknown", "type")
    return files.select("path", F.col("length").alias("bytes"), extension.alias("extension"), sniffed(F.col("content")).alias("family"), F.sha2("content", 256).alias("content_hash"), reason.alias("reason"))


def text_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, text): paragraphs of text files, parted by blank lines."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n\s*\r?\n").alias("parts"))
    return rows.select("path", F.posexplode("parts").alias("position", "text")).where(F.length(F.trim("text")) > 0)


def delimited_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(path, text): rows of delimited files with their fields joined by a bar."""
    rows = spark.read.option("sep", separator).option("header", "false").csv(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in rows.columns]).alias("text"))


def table_text(rows: DataFrame, group: str, position: str, cells: str) -> DataFrame:
    """(group, text): a table as bar-separated lines with a rule under its header; cells is an array."""
    line = F.concat_ws(" | ", F.transform(cells, lambda c: F.coalesce(c, F.lit(""))))
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("line"), F.size(cells).alias("n")))).alias("lines"))
    texts = F.transform("lines", lambda x: x["line"])
    rule = F.array_join(F.array_repeat(F.lit("---"), F.element_at("lines", 1)["n"]), " | ")
    return listed.select(group, F.array_join(F.concat(F.slice(texts, 1, 1), F.array(rule), F.expr("slice(transform(lines, x -> x.line), 2, size(lines))")), "\n").alias("text"))


def _docx(content: bytes) -> list[str]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{space}body")
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{space}p":
            out.append("".join(t.text or "" for t in node.iter(f"{space}t")))
        elif node.tag == f"{space}tbl":
            out += [" | ".join("".join(t.text or "" for t in cell.iter(f"{space}t")) for cell in row.iter(f"{space}tc")) for row in node.iter(f"{space}tr")]
    return [x for x in out if x.strip()]


def _xlsx(content: bytes) -> list[str]:
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    out = []
    for name in sorted((n for n in book.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1])):
        for row in ElementTree.fromstring(book.read(name)).iter(f"{space}row"):
            cells = []
            for cell in row.iter(f"{space}c"):
                value = cell.find(f"{space}v")
                text = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{space}t"))
                cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            out.append(" | ".join(cells))
    return [x for x in out if x.strip(" |")]


def _eml(content: bytes) -> list[str]:
    message = email.message_from_bytes(content, policy=email.policy.default)
    head = [f"{k}: {message[k]}" for k in ("From", "To", "Subject", "Date") if message[k]]
    body = message.get_body(preferencelist=("plain",))
    return head + [p for p in re.split(r"\n\s*\n", body.get_content().strip() if body else "") if p.strip()]


_PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>", re.S)
_PDF_SHOW = re.compile(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>)\s*(?:TJ|Tj|'|\")|(T\*|[-\d.]+\s+[-\d.]+\s+T[dD]|ET)", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(len(raw) % 2, "0"))
        return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return plain.decode("latin-1")


def _pdf(content: bytes) -> list[str]:
    """The text of each page, in the order of its drawing, for fonts that write Latin letters as themselves.

    Pages are the page objects in the order they are listed; streams are plain or deflated.
    An encrypted file raises.
    """
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}

    def stream(body: bytes) -> bytes:
        head, _, rest = body.partition(b"stream")
        data = rest.lstrip(b"\r").removeprefix(b"\n").rpartition(b"endstream")[0]
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in head else data

    kids = [int(k) for body in objects.values() if b"/Kids" in body for k in re.findall(rb"(\d+)\s+\d+\s+R", re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)[1])]
    pages = [k for k in kids if re.search(rb"/Type\s*/Page\b(?!s)", objects.get(k, b""))] or [k for k, body in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    out = []
    for page in pages:
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[page])
        data = b"\n".join(stream(objects[int(k)]) for k in re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if int(k) in objects) if found else b""
        text = ""
        for m in _PDF_SHOW.finditer(data):
            text += "".join(map(_pdf_string, _PDF_STRING.findall(m[1]))) if m[1] else "\n"
        out.append(re.sub(r"\n{2,}", "\n", text).strip())
    return out


#: A reader by extension: a new format is a new entry.
PARSERS = {"docx": _docx, "xlsx": _xlsx, "eml": _eml, "pdf": _pdf}


def parsed(files: DataFrame) -> DataFrame:
    """(path, position, text, error) of office documents and mails; a file that cannot be read gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in frame.itertuples(index=False):
                parser = PARSERS.get(path.rpartition(".")[2].lower())
                if parser is None:
                    continue
                try:
                    rows += [(path, k, text, None) for k, text in enumerate(parser(bytes(content)))]
                except Exception as error:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path, 0, None, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "position", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, position int, text string, error string")
