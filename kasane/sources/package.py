"""Files of a release package: inventory and readers (one task per file, nothing collected)."""

from __future__ import annotations

import csv
import importlib.util
import io
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kasane.functions.text import source_id
from kasane.operators import publish

MAX_FILE = 16 * 1024 * 1024
MAX_FILES, MAX_BYTES = 10_000, 2 * 1024**3
#: Suffix to (file type, parser) (fixed values).
KINDS = {"csv": ("csv", "python-csv"), "xml": ("xml", "xml"), "xsl": ("xsl", "xml-retained"), "html": ("html", "html"), "htm": ("html", "html"), "pdf": ("pdf", "pdf")}


def reject_links(root: str) -> None:
    """No symbolic links anywhere below the package root."""
    for base, dirs, files in os.walk(root):
        for name in (*dirs, *files):
            if os.path.islink(os.path.join(base, name)):
                raise ValueError(f"link in package: {name}")


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8 with or without mark, else CP932."""
    try:
        return raw.decode("utf-8-sig"), "utf-8-sig" if raw.startswith(b"\xef\xbb\xbf") else "utf-8"
    except UnicodeDecodeError:
        return raw.decode("cp932"), "cp932"


def parse_xml(raw: bytes) -> ElementTree.Element:
    """Strict XML without document types; a wrongly declared CP932 file is read without its declaration."""
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("document types are not allowed")
    try:
        return ElementTree.fromstring(raw)
    except (ElementTree.ParseError, ValueError, LookupError):
        text, _ = decode(raw)
        return ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))


class TableReader(HTMLParser):
    """Title, and every table row with its th / td cells (tag, colspan, text); unclosed tags are recovered."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.title, self.rows = "", []
        self._row, self._cell, self._in_title = None, None, False
        self.feed(text)
        self.close()
        self._end_row()

    def _end_cell(self) -> None:
        if self._cell is not None and self._row is not None:
            self._row.append((self._cell[0], self._cell[1], "".join(self._cell[2]).strip()))
        self._cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self._row is not None:
            self.rows.append(self._row)
        self._row = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._end_row()
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._end_cell()
            span = dict(attrs).get("colspan") or "1"
            self._cell = (tag, int(span) if span.isdigit() else 1, [])
        elif tag == "title":
            self._in_title = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()
        elif tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if self._cell is not None:
            self._cell[2].append(data)
        elif self._in_title:
            self.title += data


def probe(raw: bytes | None, kind: str, size: int) -> tuple[str | None, str, str | None]:
    """(encoding, status, error) of one file; a failure is reported, never dropped."""
    if size > MAX_FILE:
        return None, "failed", f"ValueError: file exceeds {MAX_FILE} bytes"
    try:
        if kind == "csv":
            text, encoding = decode(raw)
            for _ in csv.reader(io.StringIO(text, newline="")):
                pass
            return encoding, "parsed", None
        if kind in ("xml", "xsl"):
            parse_xml(raw)
            return None, "retained" if kind == "xsl" else "parsed", None
        if kind == "html":
            text, encoding = decode(raw)
            TableReader(text)
            return encoding, "parsed", None
        if kind == "pdf":
            if not raw.startswith(b"%PDF-"):
                raise ValueError("not a PDF")
            return None, "parsed", None
        if kind == "text":
            return decode(raw)[1], "retained", None
        raise ValueError("unsupported file type")
    except Exception as gone:  # every input stays visible
        return None, "failed", f"{type(gone).__name__}: {gone}"[:500]


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size_bytes, content) of every file below root."""
    base = os.path.abspath(root)
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(F.substring("path", F.lit(len("file:" + base) + 2), F.length("path")).alias("relative_path"), F.col("length").alias("size_bytes"), "content")
    )


_FILE = "relative_path string, size_bytes long, sha256 string, file_type string, encoding string, data_group string, parser string, status string, error string"


def inventory(spark: SparkSession, root: str, release_id: str) -> DataFrame:
    """source_file rows of a package, numbered in path order."""
    reject_links(root)
    import hashlib

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, size, raw in zip(pdf["relative_path"], pdf["size_bytes"], pdf["content"]):
                parts = path.split("/")
                name = parts[-1].upper()
                kind, parser = ("text", "utf-8-text") if name == "COPYRGHT" else KINDS.get(name.lower().rpartition(".")[2], (None, "unresolved"))
                encoding, status, error = probe(raw, kind or "", size)
                group = "/".join(parts[:2]) if len(parts) >= 3 else parts[0] if len(parts) == 2 else name
                if size > MAX_FILE:
                    parser = "resource-limit"
                elif status == "failed":
                    parser, group = "unresolved", parts[0]
                out.append((path, size, hashlib.sha256(raw).hexdigest().upper(), kind or "text", encoding, group, parser, status, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FILE.split(", ")])

    files = contents(spark, root).mapInPandas(look, _FILE)
    w = Window.orderBy("relative_path")  # at most MAX_FILES rows, checked by check_limits
    return files.select(
        F.row_number().over(w).cast("long").alias("file_id"), F.lit(release_id).alias("release_id"),
        source_id(F.col("relative_path"), F.col("sha256")).alias("source_id"), *(c.split()[0] for c in _FILE.split(", ")),
    )


def check_limits(files: DataFrame) -> None:
    t = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    if t.n > MAX_FILES or t.b > MAX_BYTES:
        raise ValueError(f"package too large: {t.n} files, {t.b} bytes")


def reference_date(files: DataFrame) -> str:
    """The single date in the names of the CSV files."""
    day = F.try_to_date(F.regexp_extract("relative_path", r"_(\d{8})\.csv$", 1), "yyyyMMdd")
    days = [r[0] for r in files.select(day.alias("d")).where("d is not null").distinct().limit(2).collect()]
    if len(days) != 1:
        raise ValueError("the package needs exactly one reference date")
    return days[0].isoformat()


def write_inventory(files: DataFrame, out: str) -> None:
    """source-manifest.jsonl and summary.json, each moved into place."""
    os.makedirs(out, exist_ok=True)
    lines = [json.dumps(r.asDict(), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in files.drop("file_id", "release_id").orderBy("relative_path").collect()]
    write_json(os.path.join(out, "source-manifest.jsonl"), None, "\n".join(lines) + "\n")
    from kasane.operators.quality import inventory_summary

    summary: dict = {}
    for r in inventory_summary(files).collect():
        summary.setdefault(r.dimension, {})[r.value] = r.n
    summary["manifest_sha256"] = publish.manifest_digest(files).first().digest
    write_json(os.path.join(out, "summary.json"), summary)


def write_json(path: str, value: object, text: str | None = None) -> None:
    """Atomic and synced."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="\n") as f:
        f.write(text if text is not None else json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def _of_kind(spark: SparkSession, root: str, files: DataFrame, kind: str) -> DataFrame:
    want = files.where((F.col("file_type") == kind) & (F.col("status") == "parsed")).select("file_id", "relative_path", "data_group")
    return contents(spark, root).join(F.broadcast(want), "relative_path")  # a package has at most MAX_FILES files


def csv_rows(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(file_id, data_group, record_number, cells): ragged and multi-line rows kept as they are."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for pdf in batches:
            for fid, group, raw in zip(pdf["file_id"], pdf["data_group"], pdf["content"]):
                rows = list(csv.reader(io.StringIO(decode(raw)[0], newline="")))
                yield pd.DataFrame({"file_id": fid, "data_group": group, "record_number": range(1, len(rows) + 1), "cells": rows})

    return _of_kind(spark, root, files, "csv").mapInPandas(read, "file_id long, data_group string, record_number long, cells array<string>")


def xml_rows(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(file_id, target, record_number, code, translated, text, xml), one row per ``infor`` element."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fid, path, raw in zip(pdf["file_id"], pdf["relative_path"], pdf["content"]):
                top = parse_xml(raw)
                stem = os.path.splitext(os.path.basename(path))[0]
                rows = [
                    (fid, top.get("trg") or stem, i, e.findtext("FI") or "", e.findtext("trans") or "",
                     "\n".join(t for v in e.itertext() if (t := v.replace("\r\n", "\n").replace("\r", "\n").strip())), ElementTree.tostring(e, encoding="unicode"))
                    for i, e in enumerate(top.findall("infor"), 1)
                ]
                yield pd.DataFrame(rows, columns=["file_id", "target", "record_number", "code", "translated", "text", "xml"])

    return _of_kind(spark, root, files, "xml").mapInPandas(read, "file_id long, target string, record_number long, code string, translated string, text string, xml string")


def html_rows(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(file_id, data_group, title, record_number, kind, cells): rows classed as empty, retained (one wide cell), header, data."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, group, raw in zip(pdf["file_id"], pdf["data_group"], pdf["content"]):
                page = TableReader(decode(raw)[0])
                for i, row in enumerate(page.rows, 1):
                    texts = [unicodedata.normalize("NFKC", c[2]).strip() for c in row]
                    if not any(texts):
                        kind = "html-empty-row"
                    elif len(row) == 1 and row[0][1] >= 4:
                        kind = "html-retained-row"
                    elif any(c[0] == "th" for c in row):
                        kind = "html-header-row"
                    else:
                        kind = "html-table-row"
                    out.append((fid, group, page.title.strip(), i, kind, [c[2] for c in row]))
            yield pd.DataFrame(out, columns=["file_id", "data_group", "title", "record_number", "kind", "cells"])

    return _of_kind(spark, root, files, "html").mapInPandas(read, "file_id long, data_group string, title string, record_number long, kind string, cells array<string>")


def pdf_pages(spark: SparkSession, root: str, files: DataFrame) -> DataFrame | None:
    """(file_id, page, text) of all pages, numbered from 1, text '' where a page has none; None without a PDF reader."""
    if importlib.util.find_spec("pypdf") is None:
        return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdf

        for pdf in batches:
            rows = [(fid, n, p.extract_text() or "") for fid, raw in zip(pdf["file_id"], pdf["content"]) for n, p in enumerate(pypdf.PdfReader(io.BytesIO(raw)).pages, 1)]
            yield pd.DataFrame(rows, columns=["file_id", "page", "text"])

    return _of_kind(spark, root, files, "pdf").mapInPandas(read, "file_id long, page long, text string")


def attribution(spark: SparkSession, root: str) -> str:
    """The text of the one COPYRGHT file."""
    found = contents(spark, root).where(F.upper(F.element_at(F.split("relative_path", "/"), -1)) == "COPYRGHT").limit(2).collect()
    if len(found) != 1 or not (text := decode(bytes(found[0].content))[0].strip()):
        raise ValueError("the package needs exactly one non-empty COPYRGHT")
    return text
